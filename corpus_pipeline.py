"""A corpus pipeline: language, near-duplicates, repeated passages, benchmark leaks, tokens.

Each stage works on the rows and texts that the stage before it kept. All but the last return the
columns of ``documents``; the last returns token ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm import bpe, decontaminate, language, simhash, substring
from halyard.session import discard, shared_path

#: Five words to a shingle, a similarity of 0.8 or more.
SHINGLE, LEAST = 5, 0.8


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts that are null, have no letter, or that no language explains (op 9)."""
    return language.accepted(docs, language.fit(docs.where(~language.held_out())))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that with the smallest id, of each group of SimHash near-duplicates (op 1).

    Rows that repeat an id count as one document, that of the smallest text, before any comparison.
    Null is no id: such rows are told apart by their texts.
    """
    repeated = repeated_ids(docs)
    own = first_texts(docs) if repeated else docs
    kept = simhash.representatives(own, SHINGLE, least=LEAST).select(F.col("doc_id").alias("kept_id"), F.col("key").alias("kept_key"))
    rows = own.join(kept.where("kept_id is not null").select("kept_id"), F.col("doc_id") == F.col("kept_id"), "left_semi")
    rows = rows.dropDuplicates(["doc_id"]) if repeated else rows
    bare = own.where("doc_id is null").withColumn("text_key", simhash.text_key(F.col("text")))
    bare = bare.join(kept.where("kept_id is null").select("kept_key"), F.col("text_key") == F.col("kept_key"), "left_semi").dropDuplicates(["text_key"])
    return rows.unionByName(bare.drop("text_key"))


def repeated_ids(docs: DataFrame) -> bool:
    return not docs.groupBy("doc_id").count().where("count > 1").isEmpty()


def first_texts(docs: DataFrame) -> DataFrame:
    """Without rows whose id, if not null, has a smaller text in another row."""
    firsts = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("first")).where("n > 1").select(F.col("doc_id").alias("id"), "first")
    return docs.join(firsts, F.col("doc_id") == F.col("id"), "left").where(F.col("id").isNull() | F.col("text").eqNullSafe(F.col("first"))).drop("id", "first")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 35 words or more that occur elsewhere (op 3)."""
    return with_length(substring.strip(docs))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of the benchmark (op 7)."""
    return decontaminate.strip(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode what is left (op 2)."""
    return bpe.encoded(docs)


def with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", by_language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("tokens", tokens),
]

#: SimHash components need a transitive closure over bit distances, and BPE a merge loop.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read again; a stage's rows go when the next has written its own."""
    docs, old = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if old is not None:
            discard(spark, old)
        old = path
    return docs

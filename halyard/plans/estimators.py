"""Queries that train models; fits are checked by their held-out accuracy, not by SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.operators import decision as D
from halyard.operators import learning as L
from halyard.plans.registry import query
from halyard.sources.domain import predictions, table, tickets



def held_out(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    rows = L.with_vectors(table(spark, sf_dir, "embeddings"))
    return L.holdout_predictions(rows, kind, 64, 10, F.col("vec_id") % 4 == 1)


@query()
def ml01_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out(spark, sf_dir, "logistic")


@query()
def ml02_svc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out(spark, sf_dir, "svc")


@query()
def ml03_isotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.decided(predictions(spark, sf_dir))
    return L.isotonic(d.select("row_id", F.col("confidence").alias("score"), (F.col("truth") == F.col("predicted")).alias("hit")))


@query()
def ml04_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out(spark, sf_dir, "forest")


@query()
def ml05_perceptron(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out(spark, sf_dir, "perceptron")


@query()
def ml08_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    rows = L.categorical(tickets(spark, sf_dir).select("request_id", "service", "priority", "category"), ["service", "priority", "category"])
    return rows.select("request_id", F.aggregate(vector_to_array("features"), F.lit(0.0), lambda s, x: s + x).cast("int").alias("n_set"))


@query()
def ml09_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.with_vectors(table(spark, sf_dir, "embeddings")).withColumn("target", F.col("label") / 10)
    return L.ridge(rows, "target", 0.1).select("vec_id", F.round("prediction", 6).alias("projected"))


@query()
def pl04_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best ten of a dense retriever, put in order by a Python scorer."""
    from halyard.operators import dense
    from halyard.operators import retrieval as R

    v = R.vectors(table(spark, sf_dir, "embeddings"))
    found = dense.top_k(dense.build(v), v.where(F.col("vec_id") % R.EVERY == 0), 10).select("query_id", "doc_id", "score")
    again = L.scored_by(found, lambda part: part["score"] * (1 + (part["doc_id"] % 2) * 0.1), "query_id long, doc_id long, score double")
    return R.best(again, 3)

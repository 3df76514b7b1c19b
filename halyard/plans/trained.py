"""Queries that train several models at once: stacks, models by segment, boosted trees on categories."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions import scalars as S
from halyard.operators import decision as D
from halyard.operators import stacking as K
from halyard.operators import sweeps as W
from halyard.plans.registry import query
from halyard.session import stored
from halyard.sources.domain import predictions, table

LANGUAGES = ["de", "en", "es", "fr"]
HASHED = 32


def held_out() -> Column:
    """A fourth of the documents, by hash."""
    return S.hash_bucket("id", 4) == 1


@query()
def ml10_trained_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out accuracy of three branches on hashed words and of the meta-model on their out-of-fold scores."""
    rows = stored(hashed_words(spark, sf_dir).where("label >= 0"))
    n = len(LANGUAGES)
    branches = [K.Branch("logistic", K.logistic(n)), K.Branch("prototype", K.prototype(n)), K.Branch("nearest", K.nearest(n))]
    found = K.stacked(rows.where(~held_out()), rows.where(held_out()), branches, n)
    hits = found.join(rows.select("id", "label"), "id").groupBy("branch").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == F.col("predicted")).cast("int")).alias("accuracy"))
    return hits.select("branch", "n", F.round("accuracy", 6).alias("accuracy"))


@query()
def ex08_label_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A meta-model on the labels of two models, each fold by the others; differing truths would raise."""
    models = [D.decided(predictions(spark, sf_dir, m)).select(F.col("row_id").alias("id"), "truth", "predicted") for m in "ab"]
    return K.stacked_labels(models)


def shares(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` with ``features`` in place of ``w``, buckets below ``size``: the share of each; null for each where ``w`` is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = batch.column("w")
            n = pc.fill_null(w.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            cell = np.repeat(np.arange(batch.num_rows) * size, n) + w.flatten().to_numpy(zero_copy_only=False)
            share = np.bincount(cell, minlength=batch.num_rows * size) / np.repeat(np.maximum(n, 1), size)
            values = pa.array(share, mask=np.repeat(w.is_null().to_numpy(zero_copy_only=False), size))
            features = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * size), values)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), features], [*kept, "features"])

    kept = [c for c in rows.columns if c != "w"]
    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.select(*kept, "w").mapInArrow(run, f"{fields}, features array<double>")


def hashed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, segment, label, features``: shares of hashed words of each document, its source and its language."""
    words = F.transform(S.tokens("text"), lambda w: F.pmod(F.xxhash64(w), F.lit(HASHED)))
    label = (F.array_position(F.array(*map(F.lit, LANGUAGES)), F.col("lang")) - 1).cast("int")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("segment"), label.alias("label"), words.alias("w"))
    return shares(rows, HASHED)


@query()
def ml14_ridge_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out accuracy by source of the models of all sources, which one pass fits."""
    rows = hashed_words(spark, sf_dir).where("label >= 0")
    models = K.ridge_by_segment(rows.where(~held_out()), HASHED, len(LANGUAGES), 0.01)
    hits = K.by_segment(rows.where(held_out()), models, HASHED, len(LANGUAGES)).groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == F.col("predicted")).cast("int")).alias("accuracy"))
    return hits.select("segment", "n", F.round("accuracy", 6).alias("accuracy"))


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows of categories: source, first and last word; a fourth of them without label."""
    t = S.tokens("text")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.element_at(t, 1).alias("first"), F.element_at(t, -1).alias("last"), F.col("lang").alias("truth"))
    return rows.withColumn("label", F.when(F.col("id") % 4 != 1, F.col("truth")))


WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?:[.,]\p{N}+)?')"
SHARE = "round((count(*) FILTER (label = '{v}') OVER {w} + 0.25) / (count(label) OVER {w} + 1), 9) AS first_{v}"


@query(f"WITH c AS (SELECT doc_id AS id, {WORDS}[1] AS first, CASE WHEN doc_id % 4 <> 1 THEN lang END AS label, substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16) AS h FROM documents), o AS (SELECT *, CASE WHEN label IS NULL THEN 64 ELSE ('0x' || substr(h, 1, 4))::BIGINT % 64 END AS b FROM c) SELECT id, {', '.join(SHARE.format(v=v, w='w') for v in LANGUAGES)} FROM o WINDOW w AS (PARTITION BY first ORDER BY b, CASE WHEN label IS NULL THEN '' ELSE h END, CASE WHEN label IS NOT NULL THEN id END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def ml04_target_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of each language among earlier documents with the same first word."""
    rows = K.target_statistics(categories(spark, sf_dir), ["first"], LANGUAGES)
    return rows.select("id", *(F.round(f"first_{v}", 9).alias(f"first_{v}") for v in LANGUAGES))


@query()
def ml04_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of held-out documents from categories alone."""
    rows = categories(spark, sf_dir)
    found = K.boosted(rows.drop("truth"), ["source", "first", "last"], LANGUAGES)
    return found.join(rows.select("id", "truth"), "id")


@query()
def ex13_tuned_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads by penalty and weights on the development folds; the best one with its specialist, temperature and review policy.

    The fourth of the documents that is held out takes no part.
    """
    n = len(LANGUAGES)
    rows = hashed_words(spark, sf_dir).where("label >= 0").where(~held_out())
    grid = W.head_grid(n, (0.001, 0.01, 0.1))
    scores = stored(W.fold_scores(rows, [*grid, K.Branch("specialist", K.prototype(n))], 3), "scores")
    places = stored(W.compared(W.measured(scores.where("branch <> 'specialist'"))), "places")
    best = places.where("place = 1").first()["branch"]
    mended = stored(W.specialised(scores.where(F.col("branch") == best), scores.where("branch = 'specialist'")), "mended")
    t, nll = W.temperature(mended)
    policy = W.review_policy(mended.withColumn("p", W.tempered(F.col("p"), t))).select(*(F.round(c, 6).alias(c) for c in ("threshold", "margin", "f1", "coverage", "accepted_accuracy", "review_error_rate")))
    swaps = mended.agg(F.count_if("swapped").alias("swapped"))
    chosen = policy.join(F.broadcast(swaps)).select(F.lit(1).alias("place"), F.lit(round(t, 6)).alias("temperature"), F.lit(nll and round(nll, 6)).cast("double").alias("nll"), *policy.columns, "swapped")
    return places.drop("top1_std").join(chosen, "place", "left")


@query()
def ex14_candidate_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads on vectors, fitted fold by fold: means and the spread of each candidate."""
    rows = table(spark, sf_dir, "embeddings").where("label IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("features"))
    branches = [K.Branch("logistic", K.logistic(10, 0.01)), K.Branch("prototype", K.prototype(10)), K.Branch("nearest", K.nearest(10))]
    return W.compared(W.measured(W.fold_scores(rows, branches, 4)))

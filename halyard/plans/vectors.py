"""Queries on embeddings: norms, centroids, neighbours, near-duplicates, hybrid ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halyard.functions import scalars as S
from halyard.operators import dense as D
from halyard.operators import prefix
from halyard.operators import retrieval as R
from halyard.operators.similarity import greedy_dropped
from halyard.plans.registry import query
from halyard.plans.selection import GREEDY
from halyard.session import stored
from halyard.sources.domain import table

V = "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), v AS (SELECT vec_id, label, [y / sqrt(list_dot_product(x, x)) FOR y IN x] AS v FROM e)"
C = V + """, means AS (SELECT label, i, avg(v[i]) AS m FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS i FROM v) GROUP BY ALL), ml AS (SELECT label, list(m ORDER BY i) AS m FROM means GROUP BY 1), c AS (SELECT label, [y / sqrt(list_dot_product(m, m)) FOR y IN m] AS c FROM ml)"""
NEAR = V + ", near AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_dot_product(q.v, d.v), 9) AS score FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0)"
RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)"


def unit_vectors(spark: SparkSession, sf_dir: str, dims: int | None = None) -> DataFrame:
    return R.vectors(table(spark, sf_dir, "embeddings"), dims)


def neighbours(v: DataFrame, k: int) -> DataFrame:
    """The k nearest rows of every fiftieth row."""
    return D.top_k(D.build(v), v.where(F.col("vec_id") % R.EVERY == 0), k)


@query("SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings")
def sc13_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(S.norm("embedding"), 6).alias("norm"))


@query("WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[])[1:16] AS x FROM embeddings) SELECT vec_id, round(x[1] / sqrt(list_dot_product(x, x)), 6) AS first, round(x[16] / sqrt(list_dot_product(x, x)), 6) AS last FROM e")
def sc24_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = unit_vectors(spark, sf_dir, 16)
    return v.select("vec_id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[15], 6).alias("last"))


@query(C + " SELECT label, round(c[1], 6) AS c1, round(c[64], 6) AS c64 FROM c")
def ag24_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.centroids(unit_vectors(spark, sf_dir)).select("label", F.round(F.col("c")[0], 6).alias("c1"), F.round(F.col("c")[63], 6).alias("c64"))


def to_centroids(v: DataFrame) -> DataFrame:
    """Each row's cosine with each label's centroid; there are as many centroids as labels."""
    c = R.centroids(v).select(F.col("label").alias("other"), "c")
    return v.join(c).select("vec_id", "label", "other", F.round(S.dot("v", "c"), 9).alias("score"))


@query(C + ", s AS (SELECT vec_id, v.label, c.label AS other, round(list_dot_product(v, c), 9) AS score FROM v, c), n AS (SELECT label, other FROM s WHERE other <> label QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, other) = 1), k AS (SELECT label, other, count(*) AS n FROM n GROUP BY ALL) SELECT label, other, n FROM k QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC, other) <= 5")
def ag38_nearest_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = to_centroids(unit_vectors(spark, sf_dir)).where("other <> label")
    first = s.groupBy("vec_id", "label").agg(F.max_by("other", F.struct("score", (-F.col("other")).alias("o"))).alias("other"))
    counts = first.groupBy("label", "other").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("label").orderBy(F.desc("n"), "other")
    return counts.withColumn("r", F.row_number().over(own)).where("r <= 5").drop("r")


@query(C + ", s AS (SELECT vec_id, v.label AS truth, c.label AS other, exp(round(list_dot_product(v, c), 9) / 0.08) AS e FROM v, c), p AS (SELECT vec_id, truth, other, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM s) SELECT vec_id, truth, other AS predicted, round(p, 6) AS p FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, other) = 1")
def ml07_prototype(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = to_centroids(unit_vectors(spark, sf_dir)).withColumn("e", F.exp(F.col("score") / 0.08))
    best = s.groupBy("vec_id", "label").agg(F.sum("e").alias("z"), F.max_by(F.struct("other", "e"), F.struct("score", (-F.col("other")).alias("o"))).alias("b"))
    return best.select("vec_id", F.col("label").alias("truth"), F.col("b.other").alias("predicted"), F.round(F.col("b.e") / F.col("z"), 6).alias("p"))


@query(NEAR + f", k AS (SELECT query_id, doc_id, score, {RANK} AS rank FROM near QUALIFY rank <= 9), w AS (SELECT query_id, label, sum(1 / greatest(1 - score, 0.000001)) AS w FROM k JOIN v ON v.vec_id = doc_id GROUP BY ALL) SELECT query_id, label AS predicted, round(w / sum(w) OVER (PARTITION BY query_id), 6) AS p FROM w QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY w DESC, label) = 1")
def ml06_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine neighbours, weighted by their inverse distance."""
    v = unit_vectors(spark, sf_dir)
    votes = neighbours(v, 9).join(v.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id").groupBy("query_id", "label").agg(F.sum(1 / F.greatest(1 - F.col("score"), F.lit(1e-6))).alias("w"))
    own = Window.partitionBy("query_id")
    ranked = votes.withColumns({"p": F.round(F.col("w") / F.sum("w").over(own), 6), "r": F.row_number().over(own.orderBy(F.desc("w"), "label"))})
    return ranked.where("r = 1").select("query_id", F.col("label").alias("predicted"), "p")


@query(V + " SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.v, b.v), 6) AS score FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE round(list_dot_product(a.v, b.v), 9) >= 0.3")
def jn15_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one label at a cosine of 0.3 or more."""
    return D.label_pairs(unit_vectors(spark, sf_dir), 0.3).withColumn("score", F.round("score", 6))


@query(NEAR + f" SELECT query_id, doc_id, round(score, 6) AS score, {RANK} AS rank FROM near QUALIFY rank <= 5")
def pl03_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(unit_vectors(spark, sf_dir), 5).withColumn("score", F.round("score", 6))


TWO = NEAR + ", t AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_dot_product(q.x[1:16], d.x[1:16]), 9) AS score FROM e q JOIN e d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0), n1 AS (SELECT query_id, doc_id, (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) AS s FROM near WINDOW w AS (PARTITION BY query_id)), n2 AS (SELECT query_id, doc_id, (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) AS s FROM t WINDOW w AS (PARTITION BY query_id))"


@query(TWO + f", h AS (SELECT query_id, doc_id, round(0.7 * n1.s + 0.3 * n2.s, 9) AS score FROM n1 JOIN n2 USING (query_id, doc_id)) SELECT query_id, doc_id, round(score, 6) AS score, {RANK} AS rank FROM h QUALIFY rank <= 5")
def pl03_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine and, as a second retriever, dot products of the first 16 dimensions, at 0.7 and 0.3."""
    e = table(spark, sf_dir, "embeddings")
    rows = stored(e.select(F.col("vec_id").cast("long").alias("vec_id"), S.unit("embedding").alias("v"), F.slice(F.col("embedding").cast("array<double>"), 1, 16).alias("x")).where("v IS NOT NULL"), "vectors")
    return D.mixed_top_k(rows, 5, (0.7, 0.3), R.EVERY).withColumn("score", F.round("score", 6))


@query(NEAR + f", g AS (SELECT query_id, doc_id, score, d.label = q.label AS rel FROM near JOIN v d ON d.vec_id = doc_id JOIN v q ON q.vec_id = query_id), c AS (SELECT score, sum(n) OVER (ORDER BY score DESC) AS na, sum(k) OVER (ORDER BY score DESC) AS ka FROM (SELECT round(score, 4) AS score, count(*) AS n, count(*) FILTER (rel) AS k FROM g GROUP BY 1)) SELECT min(score) AS threshold, CAST(max(na) AS BIGINT) AS accepted FROM c WHERE ka >= 0.8 * na")
def wn09_relevance_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(unit_vectors(spark, sf_dir).where("v IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "label", "v"), "vectors")
    c = prefix.running(D.score_counts(rows, R.EVERY), "s", ["n", "k"], descending=True).withColumnsRenamed({"n_upto": "n_above", "k_upto": "k_above"}).where("k_above >= 0.8 * n_above")
    return c.agg(F.min("s").alias("threshold"), F.max("n_above").alias("accepted"))


@query(V + ", k AS (SELECT vec_id, label, v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM v) SELECT CASE WHEN label >= 8 THEN 'out_of_scope' WHEN i > 45 THEN 'over_cap' WHEN v[1] < 0 THEN 'low_first' ELSE 'kept' END AS reason, count(*) AS n FROM k GROUP BY 1")
def pl17_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first failing check of each row, counted."""
    i = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    rows = unit_vectors(spark, sf_dir).withColumn("i", i)
    reason = F.when(F.col("label") >= 8, "out_of_scope").when(F.col("i") > 45, "over_cap").when(F.col("v")[0] < 0, "low_first").otherwise("kept")
    return rows.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(V.replace("WITH e", "WITH RECURSIVE e") + ", links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE round(list_dot_product(a.v, b.v), 9) >= 0.6), " + GREEDY + " SELECT vec_id, label, vec_id NOT IN (SELECT id FROM dropped) AS kept FROM embeddings")
def wn16_greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a label, by id, that are not within a cosine of 0.6 of a row kept before."""
    v = unit_vectors(spark, sf_dir)
    dropped = greedy_dropped(D.label_pairs(v, 0.6)).select(F.col("id").alias("vec_id"), F.lit(False).alias("k"))
    return v.join(dropped, "vec_id", "left").select("vec_id", "label", F.coalesce("k", F.lit(True)).alias("kept"))

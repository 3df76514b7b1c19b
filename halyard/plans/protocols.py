"""Queries on arrays, sealed protocols, model bundles and candidate funnels."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import HashingTF, StringIndexer
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions import scalars as S
from halyard.operators import decision as D
from halyard.plans.registry import query
from halyard.session import shared_path
from halyard.sources import arrays as A
from halyard.sources import seals as Z
from halyard.sources.domain import predictions, predictions_sql, table


@query("SELECT vec_id AS id, len(embedding) AS n, round(CAST(embedding[1] AS DOUBLE), 6) AS first, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings")
def src12_array_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings written as archives of arrays, and read back by row ranges, ids and values aligned."""
    uri, _ = A.write_arrays(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", rows=20_000)
    rows = A.aligned(A.read_arrays(spark, uri, "ids", 4096), A.read_arrays(spark, uri, "values", 4096))
    total = F.aggregate("values", F.lit(0.0), lambda s, x: s + x)
    return rows.select("id", F.size("values").cast("long").alias("n"), F.round(F.col("values")[0], 6).alias("first"), F.round(total, 6).alias("total"))


SUMS = " || ',' || ".join(f"CAST(sum(CAST(('0x' || substr(h, {8 * i + 1}, 8)) AS BIGINT)) AS VARCHAR)" for i in range(Z.PARTS))


@query(f"WITH r AS (SELECT o_orderkey % 3 AS repeat, sha256('{{\"o_orderkey\":' || o_orderkey || ',\"o_custkey\":' || o_custkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}}') AS h FROM orders) SELECT repeat, count(*) AS n, sha256(count(*) || ',' || {SUMS}) AS digest, 'verified' AS status FROM r GROUP BY 1")
def ex12_sealed_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of each repeat's rows, sealed, and verified by a second run in another order."""
    root = shared_path(spark, "protocol")
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 3).alias("repeat"), Z.row_hash("o_orderkey", "o_custkey", "o_orderstatus").alias("h"))
    place, fs = Z.place(spark, root)
    fs.mkdirs(place)

    def sealed(rows: DataFrame) -> tuple[list, str]:
        found = rows.groupBy("repeat").agg(F.count(F.lit(1)).alias("n"), Z.digest().alias("digest")).orderBy("repeat").collect()
        return found, Z.seal(spark, f"{root}/protocol.json", {str(r.repeat): [r.n, r.digest] for r in found})

    sealed(rows)
    found, status = sealed(rows.repartition(5, "h"))
    return spark.createDataFrame([(r.repeat, r.n, r.digest, status) for r in found], "repeat long, n long, digest string, status string")


@query()
def ex16_build_and_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language model of the documents, built, kept as a version beside an older one, reloaded, and applied to all documents."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", S.tokens("text").alias("words"))
    root = shared_path(spark, "bundle")
    for smoothing in (5.0, 1.0):
        stages = [StringIndexer(inputCol="lang", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip"), HashingTF(inputCol="words", outputCol="features", numFeatures=1 << 12), NaiveBayes(smoothing=smoothing)]
        model = Pipeline(stages=stages).fit(rows)
        Z.save_bundle(spark, root, lambda folder, m=model: m.write().save(folder), {"smoothing": smoothing, "labels": model.stages[0].labels})
    folder, metadata = Z.bundle(spark, root)
    again = PipelineModel.load(folder)
    label = F.element_at(F.array(*map(F.lit, metadata["labels"])), F.col("prediction").cast("int") + 1)
    one, two = (PipelineModel(m.stages[1:]).transform(rows).select("doc_id", label.alias(name)) for m, name in ((model, "built"), (again, "reloaded")))
    return one.join(two, "doc_id").join(rows.select("doc_id", "lang"), "doc_id")


def utility(rows: DataFrame) -> object:
    """Evaluates ``threshold, margin`` on decided rows: right answers less three times the wrong ones among those accepted, a row."""

    def run(candidates: DataFrame) -> DataFrame:
        grid = candidates.agg(F.collect_list(F.struct("run_id", "threshold", "margin")).alias("grid"))
        gain = F.when(F.col("truth") == F.col("predicted"), 1).otherwise(-3)
        met = rows.join(F.broadcast(grid)).select(F.explode("grid").alias("g"), "confidence", F.col("margin").alias("m"), gain.alias("gain"))
        accepted = (F.col("confidence") >= F.col("g.threshold")) & (F.col("m") >= F.col("g.margin"))
        return met.groupBy("g.run_id").agg((F.sum(F.when(accepted, F.col("gain")).otherwise(0)) / F.count(F.lit(1))).alias("metric"))

    return run


FUNNEL = f"""WITH {predictions_sql()}, d AS (SELECT row_id, truth, max(p) AS confidence, max(p) - list_sort(list(p), 'DESC')[2] AS margin, arg_max(label, (p, -ascii(label))) AS predicted FROM predictions GROUP BY ALL),
g AS (SELECT row_id, CASE WHEN truth = predicted THEN 1 ELSE -3 END AS gain, round(confidence, 9) AS confidence, round(margin, 9) AS margin FROM d),
one AS (SELECT t / 10 AS threshold, m / 20 AS margin FROM (SELECT unnest(range(3, 9)) AS t), (SELECT unnest(range(0, 4)) AS m)),
u1 AS (SELECT o.threshold, o.margin, sum(CASE WHEN g.confidence >= o.threshold AND g.margin >= o.margin THEN gain ELSE 0 END) / count(*) AS metric FROM one o, g GROUP BY ALL),
best AS (SELECT threshold, margin FROM u1 ORDER BY metric DESC, substr(sha256('coarse|{{\"threshold\":' || threshold || ',\"margin\":' || margin || '}}'), 1, 16) LIMIT 1),
two AS (SELECT round(threshold + i / 50, 2) AS threshold, margin FROM best, (SELECT unnest(range(-2, 3)) AS i)),
u2 AS (SELECT t.threshold, t.margin, sum(CASE WHEN g.confidence >= t.threshold AND g.margin >= t.margin THEN gain ELSE 0 END) / count(*) AS metric FROM two t, g GROUP BY ALL)"""


@query(FUNNEL + " SELECT 'coarse' AS stage, threshold, margin, round(metric, 6) AS metric FROM u1 UNION ALL SELECT 'fine', threshold, margin, round(metric, 6) FROM u2")
def pl20_resumed_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stages of candidates on the predictions of all rows: the first is cut off half-way and resumed, the second starts from its best."""
    d = D.decided(predictions(spark, sf_dir)).select("truth", "predicted", F.round("confidence", 9).alias("confidence"), F.round("margin", 9).alias("margin"))
    runs = Z.Runs(spark, shared_path(spark, "runs"))
    grid = spark.range(3, 9).select((F.col("id") / 10).alias("threshold")).join(spark.range(4).select((F.col("id") / 20).alias("margin")))
    runs.stage("coarse", grid.where("threshold < 0.55"), utility(d))
    runs.stage("coarse", grid, utility(d))
    kept = F.from_json("candidate", "threshold double, margin double").alias("c")
    first = runs.best("coarse").select(kept).select("c.threshold", "c.margin")
    fine = first.join(spark.range(-2, 3)).select(F.round(F.col("threshold") + F.col("id") / 50, 2).alias("threshold"), "margin")
    runs.stage("fine", fine, utility(d))
    return runs.table().select("stage", kept, "metric").select("stage", "c.threshold", "c.margin", F.round("metric", 6).alias("metric"))

"""Queries on splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halyard.functions import scalars as S
from halyard.operators import splits as P
from halyard.plans.registry import query
from halyard.sources.domain import TICKETS, table, tickets

KEY = "substr(sha256(CAST(user_name AS VARCHAR)), 1, 16)"


def fold_sql(r: int) -> str:
    return f"CASE WHEN partition = 'development' THEN (row_number() OVER (PARTITION BY label, partition ORDER BY substr(sha256('{r}/' || user_name), 1, 16), user_name) - 1) % 4 END AS fold{r}"


SPLIT = f"""WITH {TICKETS}, g AS (SELECT user_name, category AS label, count(*) AS n FROM tickets GROUP BY ALL), o AS (SELECT user_name, label FROM g QUALIFY row_number() OVER (PARTITION BY user_name ORDER BY n DESC, label) = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {KEY}, user_name) - 1 AS place, count(*) OVER (PARTITION BY label) AS of FROM o),
a AS (SELECT user_name, label, CASE WHEN of < 4 THEN 'development' WHEN place < ceil(of * 0.2) THEN 'lockbox' WHEN place < ceil(of * 0.2) + ceil(of * 0.15) THEN 'calibration' ELSE 'development' END AS partition FROM p)"""


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.grouped(tickets(spark, sf_dir), "user_name", "category")


@query(SPLIT + f" SELECT user_name, label, partition, {fold_sql(0)}, {fold_sql(1)}, {fold_sql(2)} FROM a")
def pl16_grouped_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(spark, sf_dir).withColumns({f"fold{r}": F.col(f"fold{r}").cast("long") for r in range(3)})


@query(SPLIT + " SELECT CAST(count(*) AS BIGINT) AS overlapping FROM (SELECT user_name FROM a GROUP BY 1 HAVING count(DISTINCT partition) > 1)")
def se4_split_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.overlap(split(spark, sf_dir), "user_name").agg(F.count(F.lit(1)).alias("overlapping"))


@query(f"WITH {TICKETS}, x AS (SELECT registration_date AS d, row_number() OVER (ORDER BY registration_date) - 1 AS i, count(*) OVER () AS n FROM tickets), e AS (SELECT d AS edge FROM x WHERE i = (SELECT min(b) FROM (SELECT d, min(i) AS b, any_value(n) AS n FROM x GROUP BY d) WHERE b >= floor(n * 0.8))) SELECT request_id, registration_date >= edge AS is_test FROM tickets, e")
def pl16_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.temporal(tickets(spark, sf_dir).select("request_id", "registration_date"), "registration_date").select("request_id", "is_test")


@query(f"WITH {TICKETS}, t AS (SELECT *, registration_date >= TIMESTAMP '2000-06-01' AS test FROM tickets WHERE category NOT IN ('NATION_3') OR registration_date >= TIMESTAMP '2000-06-01') SELECT count(*) FILTER (seen) AS evaluable, count(*) FILTER (NOT seen) AS unseen FROM (SELECT category IN (SELECT category FROM t WHERE NOT test) AS seen FROM t WHERE test)")
def ex21_evaluable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows whose label the training part has, and those of labels it never saw."""
    late = F.col("registration_date") >= F.lit("2000-06-01").cast("timestamp")
    rows = tickets(spark, sf_dir).where((F.col("category") != "NATION_3") | late)
    known = rows.where(~late).select("category").distinct().withColumn("seen", F.lit(True))
    return rows.where(late).join(known, "category", "left").agg(F.count_if(F.col("seen").isNotNull()).alias("evaluable"), F.count_if(F.col("seen").isNull()).alias("unseen"))


@query(f"WITH {TICKETS} SELECT request_id, (row_number() OVER (PARTITION BY category ORDER BY request_id) - 1) % 5 AS fold FROM tickets")
def wn17_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tickets(spark, sf_dir).select("request_id", ((F.row_number().over(Window.partitionBy("category").orderBy("request_id")) - 1) % 5).cast("long").alias("fold"))


@query(f"WITH {TICKETS}, r AS (SELECT request_id, category, row_number() OVER (PARTITION BY category ORDER BY substr(sha256(CAST(request_id AS VARCHAR)), 1, 16), request_id) AS r, count(*) OVER (PARTITION BY category) AS n FROM tickets) SELECT request_id, category FROM r WHERE r <= least(40, greatest(1, ceil(n * 0.05)))")
def wn18_class_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("category")
    rows = tickets(spark, sf_dir).select("request_id", "category", F.row_number().over(own.orderBy(S.fingerprint("request_id", 16), "request_id")).alias("r"), F.count(F.lit(1)).over(own).alias("n"))
    return rows.where(F.col("r") <= F.least(F.lit(40), F.greatest(F.lit(1), F.ceil(F.col("n") * 0.05)))).select("request_id", "category")


@query("WITH r AS (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT p_partkey FROM r WHERE i IN (SELECT floor(k * (r.n - 1) / 4) FROM (SELECT unnest(range(5)) AS k))")
def wn20_even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five evenly spaced rows of each group."""
    own = Window.partitionBy("p_brand")
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.row_number().over(own.orderBy("p_partkey")) - 1).alias("i"), F.count(F.lit(1)).over(own).alias("n"))
    places = F.transform(F.array(*map(F.lit, range(5))), lambda k: F.floor(k * (F.col("n") - 1) / 4))
    return rows.where(F.array_contains(places, F.col("i").cast("long"))).select("p_partkey")


@query("SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256(CAST(doc_id AS VARCHAR))) % 2 AS half FROM documents")
def wn21_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("lang").orderBy(F.sha2(F.col("doc_id").cast("string").cast("binary"), 256))
    return table(spark, sf_dir, "documents").select("doc_id", (F.row_number().over(order) % 2).cast("long").alias("half"))


@query("WITH known AS (SELECT DISTINCT label FROM embeddings WHERE ('0x' || substr(sha256(CAST(label AS VARCHAR)), 1, 8))::BIGINT % 10 < 7) SELECT vec_id, label, label NOT IN (SELECT label FROM known) AS out_of_scope FROM embeddings")
def pl14_known_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", (S.hash_bucket("label") >= 7).alias("out_of_scope"))


@query(SPLIT + ", c AS (SELECT partition, count(*) AS n FROM a GROUP BY 1) SELECT partition, n, n >= 100 AS complete FROM c")
def ex02_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(spark, sf_dir).groupBy("partition").agg(F.count(F.lit(1)).alias("n")).withColumn("complete", F.col("n") >= 100)


@query("SELECT a, b, c, substr(sha256(a || '|' || b || '|' || c), 1, 16) AS run_id FROM (SELECT unnest(['logistic', 'svc', 'knn']) AS a), (SELECT unnest(['text', 'combined']) AS b), (SELECT unnest(['balanced', 'none']) AS c) WHERE NOT (a = 'knn' AND c = 'balanced')")
def pl20_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate grid with stable run ids, without those that are done."""
    grid = spark.range(1).select(F.explode(F.array(*map(F.lit, ("logistic", "svc", "knn")))).alias("a")).select("a", F.explode(F.array(*map(F.lit, ("text", "combined")))).alias("b")).select("a", "b", F.explode(F.array(*map(F.lit, ("balanced", "none")))).alias("c"))
    done = grid.where("a = 'knn' AND c = 'balanced'")
    return grid.join(done, ["a", "b", "c"], "left_anti").withColumn("run_id", S.fingerprint(F.concat_ws("|", "a", "b", "c"), 16))

"""Queries on data quality: profiles, lengths, duplicate groups, label conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions import scalars as S
from halyard.plans.registry import query
from halyard.sources.domain import table

COLUMNS = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
NORM = r"trim(regexp_replace(lower(text), '[ \t\n\x0B\f\r]+', ' ', 'g'))"


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER ({c} IS NULL OR CAST({c} AS VARCHAR) = '') AS missing, count(DISTINCT {c}) AS n_distinct, round(count(*) FILTER ({c} IS NULL OR CAST({c} AS VARCHAR) = '') / count(*), 6) AS missing_share FROM customer" for c in COLUMNS))
def ag13_column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass: columns are unpivoted to rows, and aggregated by name."""
    rows = table(spark, sf_dir, "customer").select(*(F.col(c).cast("string").alias(c) for c in COLUMNS)).unpivot([], list(COLUMNS), "field", "value")
    empty = F.col("value").isNull() | (F.col("value") == "")
    return rows.groupBy("field").agg(F.count_if(empty).alias("missing"), F.count_distinct("value").alias("n_distinct"), F.round(F.count_if(empty) / F.count(F.lit(1)), 6).alias("missing_share"))


@query("SELECT lang, count(*) AS n, min(length(text)) AS least, max(length(text)) AS most, quantile_disc(length(text), 0.5) AS p50, quantile_disc(length(text), 0.9) AS p90, quantile_disc(length(text), 0.99) AS p99, round(avg(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+'))), 6) AS mean_words FROM documents GROUP BY 1".replace("\\\\", "\\"))
def ag17_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("lang", F.length("text").cast("long").alias("c"), F.size(F.regexp_extract_all("text", F.lit(r"([^ \t\n\x0B\f\r]+)"), F.lit(1))).alias("w"))
    disc = lambda q, name: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY c)").cast("long").alias(name)
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least"), F.max("c").alias("most"), disc(0.5, "p50"), disc(0.9, "p90"), disc(0.99, "p99"), F.round(F.avg("w"), 6).alias("mean_words"))


GROUPS = f"WITH g AS (SELECT sha256({NORM}) AS key, count(*) AS n, min(doc_id) AS first_id, count(DISTINCT lang) AS n_labels, count(DISTINCT source) AS n_sources FROM documents GROUP BY 1)"


def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.sha2(F.trim(F.regexp_replace(F.lower("text"), r"[ \t\n\x0B\f\r]+", " ")).cast("binary"), 256).alias("key"), "doc_id", "lang", "source")
    return docs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.count_distinct("lang").alias("n_labels"), F.count_distinct("source").alias("n_sources"))


@query(GROUPS + " SELECT substr(key, 1, 16) AS key, n, first_id, n_labels > 1 AS conflict FROM g WHERE n > 1")
def ag19_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(spark, sf_dir).where("n > 1").select(F.substring("key", 1, 16).alias("key"), "n", "first_id", (F.col("n_labels") > 1).alias("conflict"))


@query(GROUPS + " SELECT substr(key, 1, 12) AS fingerprint, n, n_sources FROM g WHERE n_sources > 1")
def ag20_label_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(spark, sf_dir).where("n_sources > 1").select(F.substring("key", 1, 12).alias("fingerprint"), "n", "n_sources")


@query(GROUPS + " SELECT (SELECT count(*) FROM documents) AS n_rows, count(*) AS n_groups, count(*) FILTER (n > 1) AS n_repeated, count(*) FILTER (n_labels > 1) AS n_conflicts, (SELECT count(*) FROM labels) AS n_labelled FROM g")
def ag15_corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = table(spark, sf_dir, "labels").agg(F.count(F.lit(1)).alias("n_labelled"))
    own = duplicate_groups(spark, sf_dir).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("n") > 1).alias("n_repeated"), F.count_if(F.col("n_labels") > 1).alias("n_conflicts"))
    return own.join(F.broadcast(labelled))


@query(f"SELECT doc_id, substr(sha256(CASE WHEN {NORM} <> '' THEN {NORM} ELSE 'request:' || doc_id END), 1, 20) AS group_key FROM documents")
def sc01_group_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.fingerprint(S.group_key("text", "doc_id"), 20).alias("group_key"))


DURATIONS = "('00:00:00'), ('24:00:00'), ('217:23:03'), ('0.5'), ('86400'), ('n/a'), ('-1'), (NULL)"


@query("SELECT CAST(v AS VARCHAR) AS value, CAST(s AS BIGINT) AS seconds, t AS text FROM (VALUES ('00:00:00', 0, '00:00:00'), ('24:00:00', 86400, '24:00:00'), ('217:23:03', 782583, '217:23:03'), ('0.5', 43200, '12:00:00'), ('86400', 86400, '24:00:00'), ('n/a', NULL, NULL), ('-1', NULL, NULL), (NULL, NULL, NULL)) x(v, s, t)")
def sc02_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(f"SELECT * FROM VALUES {DURATIONS} AS x(value)").withColumn("seconds", S.duration_seconds("value"))
    return rows.withColumn("text", S.human_duration("seconds"))


@query("SELECT user_id AS value, CAST(user_id AS VARCHAR) AS id, event_type IN ('error') OR value < 1 AS overdue FROM events")
def sc03_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("value"), S.request_id(F.col("user_id").cast("double")).alias("id"), S.overdue(F.when((F.col("event_type") == "error") | (F.col("value") < 1), "Overdue").otherwise("no")).alias("overdue"))


@query("SELECT event_id, TIMESTAMP '1899-12-30 00:00:00' + to_seconds(CAST(45000 AS BIGINT) * 86400 + event_id) AS at FROM events")
def sc06_excel_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    serial = (F.lit(45000.0) + F.col("event_id") / 86400).cast("string")
    return table(spark, sf_dir, "events").select("event_id", S.excel_or_iso(serial).alias("at"))

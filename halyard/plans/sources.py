"""Queries that go through a source or sink and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions import scalars as S
from halyard.plans.registry import query
from halyard.session import shared_path
from halyard.sources import files as X
from halyard.sources.domain import TICKETS, table, tickets
from halyard.sources.workbook import write_workbooks


@query("SELECT CAST(user_id AS VARCHAR) AS request_id, event_type AS status, date_trunc('second', ts) AS entered_at FROM events")
def src04_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as CSV and read as an event log."""
    path = shared_path(spark, "log")
    X.write_csv(table(spark, sf_dir, "events").select(F.col("user_id").alias("request_id"), F.col("event_type").alias("status"), F.date_format(F.col("ts"), "yyyy-MM-dd HH:mm:ss").alias("entered_at")), path)
    return X.read_event_log(spark, path).select("request_id", "status", "entered_at")


@query("SELECT CAST(user_id AS VARCHAR) AS request_id, event_type AS status, date_trunc('second', ts) AS entered_at, CASE WHEN event_id % 3 = 0 THEN date_trunc('second', ts) + INTERVAL 1 HOUR END AS left_at FROM events WHERE event_id % 7 <> 0")
def src04_workbook_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as workbooks and read as an event log; every seventh row has a blank status and is dropped."""
    path = f"{shared_path(spark, 'log')}.xlsx"
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    log = table(spark, sf_dir, "events").select(F.col("user_id").cast("double").alias("request_id"), F.when(F.col("event_id") % 7 != 0, F.col("event_type")).otherwise(" ").alias("status"), text(F.col("ts")).alias("entered_at"), F.when(F.col("event_id") % 3 == 0, text(F.col("ts") + F.expr("INTERVAL 1 HOUR"))).alias("left_at"))
    write_workbooks(log, path)
    return X.read_event_log(spark, path).select("request_id", "status", "entered_at", "left_at")


#: Physical columns of the raw rows, and the SQL of their text.
RAW = {
    "Asked": "CAST(clarifications AS VARCHAR)",
    "Kind": "category",
    "L1 react": "CASE WHEN line1 > 0 THEN '00:00:05' ELSE '00:00:00' END",
    "L2 work": "CASE WHEN line2 > 0 THEN '0.5' END",
    "Late": "CASE WHEN overdue THEN ' Overdue' ELSE 'no' END",
    "Number": "request_id || '.0'",
    "Registered": "CASE WHEN request_id % 2 = 0 THEN CAST(date_diff('day', DATE '1899-12-30', CAST(registration_date AS DATE)) AS VARCHAR) ELSE strftime(registration_date, '%Y-%m-%d') || ' 00:00:00' END",
    "Requester": "CASE WHEN request_id % 3 = 0 THEN ' ' ELSE user_name END",
    "Service": "service",
    "Solver": "final_line",
    "Text": "upper(category) || '  ' || service",
    "Took": "CASE WHEN duration_seconds IS NOT NULL THEN lpad(CAST(duration_seconds // 3600 AS VARCHAR), CAST(greatest(2, length(CAST(duration_seconds // 3600 AS VARCHAR))) AS INT), '0') || ':' || lpad(CAST(duration_seconds % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(duration_seconds % 60 AS VARCHAR), 2, '0') END",
}
NAMES = {"request_id": "Number", "registration_date": "Registered", "service": "Service", "category": "Kind", "description": "Text", "overdue": "Late", "final_line": "Solver", "actual_duration": "Took", "clarifications_count": "Asked", "line1_reaction": "L1 react", "line2_work": "L2 work"}
RAW_JSON = "'{' || " + " || ',' || ".join(f"'\"{name}\":' || coalesce('\"' || ({sql}) || '\"', 'null')" for name, sql in RAW.items()) + " || '}'"
EMPTY = ", ".join(f"'' AS {c}" for c in ("request_type", "criticality", "urgency", "priority", "service_class", "timezone", "status", "result"))


@query(f"""WITH {TICKETS} SELECT CAST(request_id AS VARCHAR) AS request_id, date_trunc('day', registration_date) AS registration_date, CASE WHEN request_id % 3 <> 0 THEN user_name END AS user_name, service, CAST(NULL AS VARCHAR) AS component, category,
 upper(category) || '  ' || service AS description, lower(category) || ' ' || lower(service) AS normalized_description, {EMPTY}, CAST(overdue AS INT) AS overdue, final_line, duration_seconds AS actual_duration_seconds, CAST(clarifications AS INT) AS clarifications_count, CAST(NULL AS BIGINT) AS clarification_seconds,
 CAST(line1 > 0 AS INT) AS line1_participated, CAST(line2 > 0 AS INT) AS line2_participated, 0 AS line3_participated, 0 AS line4_participated, CAST(line1 > 0 AS INT) + CAST(line2 > 0 AS INT) AS participants_count, {RAW_JSON} AS raw_json, 'hash' AS source_hash, 'now' AS updated_at FROM tickets""")
def prj1_full_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows of text as whole records of 29 columns, their ids unique."""
    t = tickets(spark, sf_dir)
    flag = lambda c, yes, no=None: F.when(F.col(c) > 0, yes).otherwise(F.lit(no).cast("string"))
    day = F.col("registration_date").cast("date")
    values = {
        "Number": F.concat(F.col("request_id").cast("string"), F.lit(".0")),
        "Registered": F.when(F.col("request_id") % 2 == 0, F.date_diff(day, F.lit("1899-12-30").cast("date")).cast("string")).otherwise(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 00:00:00"))),
        "Requester": F.when(F.col("request_id") % 3 == 0, " ").otherwise(F.col("user_name")),
        "Service": F.col("service"),
        "Kind": F.col("category"),
        "Text": F.concat(F.upper("category"), F.lit("  "), F.col("service")),
        "Late": F.when(F.col("overdue"), " Overdue").otherwise("no"),
        "Solver": F.col("final_line"),
        "Took": S.human_duration("duration_seconds"),
        "Asked": F.col("clarifications").cast("string"),
        "L1 react": flag("line1", "00:00:05", "00:00:00"),
        "L2 work": flag("line2", "0.5"),
    }
    raw = t.select(*(x.alias(c) for c, x in values.items()))
    return X.unique_ids(X.full_record(raw, NAMES, "hash", "now", ("User", "Requester")))


@query(f"WITH {TICKETS} SELECT request_id, category FROM tickets ORDER BY request_id")
def src05_ordered_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tickets(spark, sf_dir).select("request_id", "category").orderBy("request_id")


@query("SELECT doc_id, CASE WHEN trim(coalesce(CASE WHEN doc_id % 6 <> 0 THEN text END, '')) <> '' OR trim(coalesce(lang, '')) <> '' THEN 'uploaded' ELSE 'failed' END AS state, length(trim(coalesce(CASE WHEN doc_id % 6 <> 0 THEN text END, ''))) < 10 AS low_information FROM documents")
def src06_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 6 != 0, F.col("text")).alias("text"), "lang")
    return X.staged(docs, "b1", text="text", key="doc_id").select("doc_id", "state", "low_information")


@query("SELECT text, lang AS label FROM documents WHERE trim(text) <> '' AND doc_id % 5 <> 0")
def src09_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples written as JSON lines, one in five without a label, and read back."""
    path = shared_path(spark, "lines")
    X.write_lines(table(spark, sf_dir, "documents").select("text", F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("label")), path)
    return X.read_samples(spark, path, "text string, label string")


@query("SELECT d.doc_id, e.label FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id")
def src12_embeddings_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return table(spark, sf_dir, "documents").select("doc_id").join(vectors, "doc_id")


@query("SELECT length(text) AS value, count(*) AS n FROM documents GROUP BY 1")
def snk08_cached_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A costly value by content: half of the texts come from a cache, only the rest is computed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    length = lambda d: d.select("key", F.length("text").alias("value"))
    _, cache = X.cached_scores(docs.where("doc_id % 2 = 0"), None, length)
    rows, _ = X.cached_scores(docs, cache, length)
    return rows.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, event_type FROM events WHERE event_type NOT IN ('purchase', 'error')")
def flt06_open_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows still in the queue: neither saved nor failed."""
    return table(spark, sf_dir, "events").where(~F.col("event_type").isin("purchase", "error")).select("event_id", "event_type")


@query("SELECT event_id, event_type = 'signup' AS reviewed FROM events WHERE event_type IN ('signup', 'view')")
def flt10_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "view")).select("event_id", (F.col("event_type") == "signup").alias("reviewed"))

"""Queries on records: projections, merges, logs, staged states, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halyard.functions import scalars as S
from halyard.operators import records as R
from halyard.plans.registry import query
from halyard.sources.domain import TICKETS, table, tickets

FIELDS = ["service", "category", "priority", "final_line"]
OLD = "old AS (SELECT request_id, service, category, priority, final_line FROM tickets WHERE request_id % 7 <> 0)"
NEW = "new AS (SELECT request_id, service, category, CASE WHEN request_id % 5 = 0 THEN NULL ELSE priority END AS priority, final_line FROM tickets WHERE request_id % 3 = 0)"


def old_and_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = tickets(spark, sf_dir).select("request_id", *FIELDS)
    return rows.where("request_id % 7 <> 0"), rows.where("request_id % 3 = 0").withColumn("priority", F.when(F.col("request_id") % 5 != 0, F.col("priority")))


def merge_sql(deleted: str) -> str:
    return f"""WITH {TICKETS}, {OLD}, {NEW} SELECT coalesce(n.request_id, o.request_id) AS request_id,
      CASE WHEN n.request_id IS NULL THEN o.priority ELSE n.priority END AS priority,
      CASE WHEN o.request_id IS NULL THEN 'inserted' WHEN n.request_id IS NULL THEN '{deleted}' WHEN o.priority IS NOT DISTINCT FROM n.priority THEN 'unchanged' ELSE 'updated' END AS change
      FROM old o FULL JOIN new n ON o.request_id = n.request_id"""


@query(merge_sql("kept"))
def dml1_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.merged(*old_and_new(spark, sf_dir), "request_id").select("request_id", "priority", "change")


@query(f"SELECT change, count(*) AS n FROM ({merge_sql('deleted')}) GROUP BY 1")
def dml1_replace_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.merged(*old_and_new(spark, sf_dir), "request_id", "replace").groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, event_type, date_trunc('day', ts) AS day FROM events WHERE event_id % 2 = 0 GROUP BY ALL EXCEPT SELECT user_id, event_type, date_trunc('day', ts) FROM events WHERE event_id % 2 = 1")
def dml2_insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.date_trunc("day", "ts").alias("day"))
    keys = ["user_id", "event_type", "day"]
    return R.appended(rows.where("event_id % 2 = 1"), rows.where("event_id % 2 = 0"), keys).select(*keys)


@query("SELECT user_id AS key, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def dml3_latest_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest(table(spark, sf_dir, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select(F.col("user_id").alias("key"), "value")


@query(f"""WITH {TICKETS}, e AS (SELECT request_id, CASE WHEN request_id % 2 = 0 THEN 'BUILDING' ELSE service END AS service, category, CASE WHEN request_id % 4 = 0 THEN NULL ELSE priority END AS priority, final_line FROM tickets WHERE request_id % 11 = 0)
SELECT t.request_id, concat_ws(',', CASE WHEN t.service IS DISTINCT FROM e.service THEN 'service' END, CASE WHEN t.priority IS DISTINCT FROM e.priority THEN 'priority' END) AS changed
FROM tickets t JOIN e USING (request_id) WHERE t.service IS DISTINCT FROM e.service OR t.priority IS DISTINCT FROM e.priority""")
def dml5_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tickets(spark, sf_dir).select("request_id", *FIELDS)
    edits = rows.where("request_id % 11 = 0").withColumns({"service": F.when(F.col("request_id") % 2 == 0, F.lit("BUILDING")).otherwise(F.col("service")), "priority": F.when(F.col("request_id") % 4 != 0, F.col("priority"))})
    return R.revisions(rows, edits, "request_id", FIELDS).select("request_id", F.array_join("changed_fields", ",").alias("changed"))


@query("""WITH RECURSIVE log AS MATERIALIZED (SELECT user_id, event_type AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
walk AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 'uploaded' AS state, FALSE AS category, FALSE AS route, 0::INT AS n_applied FROM log UNION ALL
 SELECT w.user_id, l.i, CASE WHEN state <> 'saved' AND k = 'view' THEN 'waiting_review' WHEN state <> 'saved' AND k = 'error' THEN 'failed' WHEN k = 'signup' AND state = 'waiting_review' AND category AND route THEN 'saved' ELSE state END,
  CASE WHEN state <> 'saved' AND k = 'view' THEN FALSE WHEN k = 'click' AND state = 'waiting_review' THEN TRUE ELSE category END,
  CASE WHEN state <> 'saved' AND k = 'view' THEN FALSE WHEN k = 'click' AND state = 'waiting_review' THEN FALSE WHEN k = 'purchase' AND state = 'waiting_review' AND category THEN TRUE ELSE route END,
  n_applied + CAST((state <> 'saved' AND k IN ('view', 'error')) OR (state = 'waiting_review' AND (k = 'click' OR (k = 'purchase' AND category) OR (k = 'signup' AND category AND route))) AS INT) FROM walk w JOIN log l ON l.user_id = w.user_id AND l.i = w.i + 1)
SELECT user_id, state, category, route, n_applied FROM walk QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1""")
def dml6_staged_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.element_at(F.create_map(*(F.lit(x) for p in {"view": "analysis", "error": "error", "click": "category_confirmed", "purchase": "route_confirmed", "signup": "saved"}.items() for x in p)), F.col("event_type"))
    return R.folded(table(spark, sf_dir, "events").withColumn("kind", kinds), "user_id", "kind", "ts", "event_id")


@query("""SELECT event_id, event_type AS kind, '{"user_id":' || user_id || ',"value":' || value || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || '"}' AS snapshot FROM events""")
def dml7_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"), F.to_json(F.struct("user_id", "value", "ts")).alias("snapshot"))


@query("SELECT user_id, event_id, 'NEW-' || strftime(ts, '%d') || '-' || user_id || CASE WHEN r > 1 THEN '-' || r ELSE '' END AS id FROM (SELECT *, row_number() OVER (PARTITION BY strftime(ts, '%d'), user_id ORDER BY event_id) AS r FROM events)")
def dml8_unique_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.concat(F.lit("NEW-"), F.date_format("ts", "dd"), F.lit("-"), F.col("user_id").cast("string"))
    rows = table(spark, sf_dir, "events").withColumn("base", base)
    r = F.row_number().over(Window.partitionBy("base").orderBy("event_id"))
    return rows.withColumn("r", r).select("user_id", "event_id", F.when(F.col("r") > 1, F.concat_ws("-", "base", F.col("r").cast("string"))).otherwise(F.col("base")).alias("id"))


@query(f"""WITH {TICKETS} SELECT request_id, concat_ws(',', CASE WHEN line1 > 0 THEN 'line1' END, CASE WHEN line2 > 0 THEN 'line2' END, CASE WHEN line3 > 0 THEN 'line3' END) AS available,
CAST(round(least(1, 0.5 * CAST(overdue AS INT) + 0.3 * CASE WHEN clarifications >= 6 THEN 1 ELSE 0 END + 0.4 * CASE WHEN duration_seconds IS NULL THEN 1 ELSE 0 END), 6) AS DOUBLE) AS learning_priority FROM tickets""")
def dml9_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    available = F.filter(F.array(*(F.when(F.col(f"line{i}") > 0, F.lit(f"line{i}")) for i in (1, 2, 3))), lambda x: x.isNotNull())
    score = 0.5 * F.col("overdue").cast("int") + 0.3 * (F.col("clarifications") >= 6).cast("int") + 0.4 * F.col("duration_seconds").isNull().cast("int")
    return tickets(spark, sf_dir).select("request_id", F.array_join(available, ",").alias("available"), F.round(F.least(F.lit(1.0), score), 6).alias("learning_priority"))


@query(f"WITH {TICKETS} SELECT request_id, month(registration_date) AS month, isodow(registration_date) - 1 AS weekday, hour(registration_date) AS hour, coalesce(nullif(trim(service), ''), '__MISSING__') AS service, CASE WHEN request_id % 9 = 0 THEN '__MISSING__' ELSE category END AS category FROM tickets")
def prj7_structured_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.try_to_timestamp(F.col("registration_date").cast("string"))
    return tickets(spark, sf_dir).select("request_id", F.month(d).cast("long").alias("month"), F.weekday(d).cast("long").alias("weekday"), F.hour(d).cast("long").alias("hour"), S.or_missing("service").alias("service"), S.or_missing(F.when(F.col("request_id") % 9 != 0, F.col("category"))).alias("category"))


@query(f"WITH {TICKETS} SELECT request_id, concat_ws(chr(10), 'service: ' || service, CASE WHEN request_id % 4 <> 0 THEN 'category: ' || category END, 'priority: ' || priority) AS text FROM tickets")
def prj8_tagged_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tickets(spark, sf_dir).select("request_id", S.tagged_text(service="service", category=F.when(F.col("request_id") % 4 != 0, F.col("category")), priority="priority").alias("text"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(CAST(json_extract(props, '$.missing') AS BIGINT), -1) AS missing FROM events")
def prj9_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.from_json("props", "k long, missing long")
    return table(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"), F.coalesce(parsed["missing"], F.lit(-1)).alias("missing"))


@query("SELECT event_id, CAST(coalesce(CASE WHEN event_id % 3 = 0 THEN nullif(trim(event_type), '') END, CASE WHEN event_id % 3 = 1 THEN CAST(user_id AS VARCHAR) END, 'unknown') AS VARCHAR) AS name FROM events")
def prj4_first_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", S.first_filled(F.when(F.col("event_id") % 3 == 0, F.col("event_type")), F.when(F.col("event_id") % 3 == 1, F.col("user_id").cast("string")), F.lit("unknown")).alias("name"))


@query(f"WITH {TICKETS} SELECT request_id, coalesce(user_name, '') AS user, service, priority FROM tickets")
def prj6_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields known at registration; targets and later fields never reach a model."""
    return tickets(spark, sf_dir).select("request_id", F.coalesce("user_name", F.lit("")).alias("user"), "service", "priority")


@query("SELECT doc_id, length(trim(text)) < 10 AS low_information, round((CASE WHEN trim(coalesce(text, '')) <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(lang, '') <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(source, '') <> '' THEN 1 ELSE 0 END) / 3, 6) AS completeness FROM documents")
def flt8_low_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.array(*(F.trim(F.coalesce(c, F.lit(""))) for c in ("text", "lang", "source")))
    return table(spark, sf_dir, "documents").select("doc_id", (F.length(F.trim("text")) < 10).alias("low_information"), F.round(F.size(F.filter(fields, lambda x: x != "")) / 3, 6).alias("completeness"))


@query("SELECT event_id FROM events WHERE event_type = 'error' OR value < 3 OR CAST(json_extract(props, '$.k') AS BIGINT) > 90")
def flt9_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where((F.col("event_type") == "error") | (F.col("value") < 3) | (F.from_json("props", "k long")["k"] > 90)).select("event_id")


@query("SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN 0 WHEN event_type = 'purchase' THEN 1 ELSE 2 END AS rank FROM events ORDER BY rank, event_id")
def st3_queue_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue in order of rank and id."""
    rank = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    return table(spark, sf_dir, "events").select("event_id", "event_type", rank.alias("rank")).orderBy("rank", "event_id")


@query("SELECT doc_id, CASE WHEN regexp_matches(lower(text), '(^|[^a-z])password') THEN 'secret' WHEN regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+') THEN 'mail' WHEN regexp_matches(text, '[0-9]{4}') THEN 'number' ELSE 'none' END AS rule FROM documents")
def flt14_first_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    rule = F.when(F.lower(text).rlike("(^|[^a-z])password"), "secret").when(text.rlike("[A-Za-z0-9._]+@[A-Za-z0-9.]+"), "mail").when(text.rlike("[0-9]{4}"), "number").otherwise("none")
    return table(spark, sf_dir, "documents").select("doc_id", rule.alias("rule"))


ORDERS_AND_CUSTOMERS = "a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F')"


def two_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    return orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k")), orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))


@query(f"WITH {ORDERS_AND_CUSTOMERS} SELECT k FROM a UNION SELECT k FROM b")
def se1_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = two_sets(spark, sf_dir)
    return a.union(b).distinct()


@query(f"WITH {TICKETS}, {OLD}, {NEW} SELECT * FROM new UNION ALL SELECT * FROM old ANTI JOIN new USING (request_id)")
def se2_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.precedence_union(*old_and_new(spark, sf_dir), key="request_id")


@query("SELECT o_orderkey AS request_id, unnest(range(1 + o_orderkey % 3)) AS copy FROM orders")
def se3_repeat_by_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("o_orderkey") % 3)).alias("copy"))


@query(f"WITH {ORDERS_AND_CUSTOMERS} SELECT k FROM a INTERSECT SELECT k FROM b")
def se5_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = two_sets(spark, sf_dir)
    return a.intersect(b)


@query(f"WITH {ORDERS_AND_CUSTOMERS} SELECT k FROM a EXCEPT SELECT k FROM b")
def se6_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = two_sets(spark, sf_dir)
    return a.subtract(b)


@query("SELECT c_custkey, c_nationkey FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_totalprice > 450000) ON c_custkey = o_custkey")
def jn04_left_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(orders, "c_custkey", "left_anti").select("c_custkey", "c_nationkey")


@query("SELECT c_custkey FROM customer SEMI JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey")
def jn03_left_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(orders, "c_custkey", "left_semi").select("c_custkey")


@query("SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id)")
def jn01_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "quality")


@query("SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49) OR EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0) AS taken FROM orders")
def jn11_existence(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("a", F.lit(True))
    poor = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("b"))
    rows = table(spark, sf_dir, "orders").join(big, "o_orderkey", "left").join(poor, "o_custkey", "left")
    return rows.select("o_orderkey", (F.coalesce("a", F.lit(False)) | F.coalesce("b", F.lit(False))).alias("taken"))


@query("WITH a AS (SELECT o_orderkey AS k FROM orders), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem) SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS left_only, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS right_only")
def jn16_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.lit(1).alias("a"))
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")).distinct().withColumn("b", F.lit(1))
    return a.join(b, "k", "full_outer").agg(F.count_if(F.col("b").isNull()).alias("left_only"), F.count_if(F.col("a").isNull()).alias("right_only"))


@query("SELECT array_to_string(list_distinct_keep, ',') AS fields FROM (SELECT ['id', 'text', 'service'] AS list_distinct_keep)")
def se9_ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(F.array_join(F.array_distinct(F.array(*map(F.lit, ("id", "text", "id", "service", "text")))), ",").alias("fields"))

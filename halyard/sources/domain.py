"""Domain views over the stored tables, in Spark and as SQL text.

``tickets`` are operational records with a timestamp, four facets, a duration, an overdue flag and
participation flags; ``status_events`` is an event log; ``predictions`` are class probabilities in long
form with the true label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OVERDUE_DAYS = 365
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a ticket. Durations below zero, and of tickets without lines, are null."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.max("l_shipdate").alias("closed"),
        F.count(F.lit(1)).alias("n_lines"),
        *(F.max((F.col("l_returnflag") == flag).cast("int")).alias(f"line{i}") for i, flag in enumerate("ANR", 1)),
        F.max((F.col("l_linestatus") == "O").cast("int")).alias("line4"),
    )
    people = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(people, F.col("o_custkey") == F.col("c_custkey"))
    seconds = F.unix_timestamp("closed") - F.unix_timestamp("o_orderdate")
    return rows.select(
        F.col("o_orderkey").alias("request_id"),
        F.col("o_orderdate").alias("registration_date"),
        F.col("c_name").alias("user_name"),
        F.col("c_mktsegment").alias("service"),
        F.col("n_name").alias("category"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("final_line"),
        F.when(seconds >= 0, seconds).alias("duration_seconds"),
        F.coalesce(seconds > OVERDUE_DAYS * 86400, F.lit(False)).alias("overdue"),
        F.coalesce("n_lines", F.lit(0)).alias("clarifications"),
        *(F.coalesce(f"line{i}", F.lit(0)).alias(f"line{i}") for i in range(1, 5)),
        F.when(F.col("o_orderkey") % 50 == 0, "operator-review").otherwise("import").alias("source_hash"),
    )


TICKETS = """tickets AS (
  SELECT o_orderkey AS request_id, o_orderdate AS registration_date, c_name AS user_name, c_mktsegment AS service, n_name AS category,
         o_orderpriority AS priority, o_orderstatus AS final_line,
         CASE WHEN date_diff('second', o_orderdate, closed) >= 0 THEN date_diff('second', o_orderdate, closed) END AS duration_seconds,
         coalesce(date_diff('second', o_orderdate, closed) > 365 * 86400, FALSE) AS overdue,
         coalesce(n_lines, 0) AS clarifications, coalesce(line1, 0) AS line1, coalesce(line2, 0) AS line2, coalesce(line3, 0) AS line3, coalesce(line4, 0) AS line4,
         CASE WHEN o_orderkey % 50 = 0 THEN 'operator-review' ELSE 'import' END AS source_hash
  FROM orders
  LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS closed, count(*) AS n_lines, max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS line1,
                    max(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS line2, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS line3,
                    max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS line4 FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log: when a request entered a status."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("request_id"), F.col("event_type").alias("status"), F.col("ts").alias("entered_at"), F.col("event_id"))


STATUS_EVENTS = "status_events AS (SELECT user_id AS request_id, event_type AS status, ts AS entered_at, event_id FROM events)"

#: Class weights of two models, as (key, customer) multipliers for each label: invented, so that shares are exact ratios.
MODELS = {"a": {"F": (13, 7), "O": (5, 31), "P": (29, 3)}, "b": {"F": (11, 17), "O": (23, 2), "P": (3, 19)}}
BONUS = {"a": 60, "b": 45}


def predictions(spark: SparkSession, sf_dir: str, model: str = "a") -> DataFrame:
    """``row_id, repeat, fold, label, p, truth``: three class probabilities for each order."""
    orders = table(spark, sf_dir, "orders")
    weight = {label: (F.col("o_orderkey") * a + F.col("o_custkey") * b) % 97 + 1 + F.when(F.col("o_orderstatus") == label, BONUS[model]).otherwise(0) for label, (a, b) in MODELS[model].items()}
    total = weight["F"] + weight["O"] + weight["P"]
    rows = orders.select(F.col("o_orderkey").alias("row_id"), (F.col("o_orderkey") % 3).alias("repeat"), (F.col("o_custkey") % 4).alias("fold"), F.col("o_orderstatus").alias("truth"), F.explode(F.array(*(F.struct(F.lit(label).alias("label"), (w / total).alias("p")) for label, w in weight.items()))).alias("x"))
    return rows.select("row_id", "repeat", "fold", "x.label", "x.p", "truth")


def predictions_sql(model: str = "a", name: str = "predictions") -> str:
    w = {label: f"((o_orderkey * {a} + o_custkey * {b}) % 97 + 1 + CASE WHEN o_orderstatus = '{label}' THEN {BONUS[model]} ELSE 0 END)" for label, (a, b) in MODELS[model].items()}
    total = "(" + " + ".join(w.values()) + ")"
    parts = " UNION ALL ".join(f"SELECT o_orderkey AS row_id, o_orderkey % 3 AS repeat, o_custkey % 4 AS fold, '{label}' AS label, CAST({x} AS DOUBLE) / {total} AS p, o_orderstatus AS truth FROM orders" for label, x in w.items())
    return f"{name} AS ({parts})"

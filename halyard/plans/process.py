"""Queries on the event log and on participation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.operators import analytics as A
from halyard.operators import process as P
from halyard.plans.registry import query
from halyard.sources.domain import STATUS_EVENTS, TICKETS, status_events, table, tickets

STEPS = f"WITH {STATUS_EVENTS}, steps AS (SELECT *, lead(status) OVER w AS next_status, lead(entered_at) OVER w AS left_at FROM status_events WINDOW w AS (PARTITION BY request_id ORDER BY entered_at, event_id))"
COMBO = "concat_ws('+', CASE WHEN line1 > 0 THEN '1' END, CASE WHEN line2 > 0 THEN '2' END, CASE WHEN line3 > 0 THEN '3' END, CASE WHEN line4 > 0 THEN '4' END)"
COMBOS = f"WITH {TICKETS}, combos AS (SELECT {COMBO} AS combination, count(*) AS n, round(avg(CAST(overdue AS INT)), 6) AS overdue_rate, round(median(duration_seconds), 1) AS median_duration FROM tickets WHERE {COMBO} <> '' GROUP BY 1)"
LINES = f"""WITH {TICKETS}, lines AS (SELECT request_id, final_line, 1 AS line FROM tickets WHERE line1 > 0 UNION ALL SELECT request_id, final_line, 2 FROM tickets WHERE line2 > 0
UNION ALL SELECT request_id, final_line, 3 FROM tickets WHERE line3 > 0 UNION ALL SELECT request_id, final_line, 4 FROM tickets WHERE line4 > 0)"""


@query(STEPS + " SELECT request_id, status, entered_at, next_status, left_at FROM steps")
def wn01_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.steps(status_events(spark, sf_dir)).select("request_id", "status", "entered_at", "next_status", "left_at")


@query(STEPS + " SELECT status, next_status, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM steps WHERE next_status IS NOT NULL GROUP BY ALL")
def ag09_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.transitions(status_events(spark, sf_dir))


@query(STEPS + " SELECT status, count(*) AS n, round(median(epoch_us(left_at) - epoch_us(entered_at)) / 1000000, 3) AS median_seconds FROM steps WHERE left_at >= entered_at GROUP BY 1")
def ag10_dwell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.dwell(status_events(spark, sf_dir))


@query(COMBOS + " SELECT * FROM combos")
def ag08_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.combinations(tickets(spark, sf_dir))


@query(LINES + " SELECT line, final_line, count(*) AS n FROM lines GROUP BY ALL")
def jn07_resolver_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.resolver_edges(tickets(spark, sf_dir))


@query(LINES + " SELECT a.line AS a, b.line AS b, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM lines a JOIN lines b ON a.request_id = b.request_id AND a.line < b.line GROUP BY ALL")
def jn05_co_participation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.co_participation(tickets(spark, sf_dir))


@query(f"""WITH {TICKETS}, d AS (SELECT contains({COMBO}, '+') AS multi, duration_seconds AS v FROM tickets WHERE duration_seconds IS NOT NULL),
r AS (SELECT multi, v, row_number() OVER (PARTITION BY multi ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY multi) AS n FROM d)
SELECT multi, CAST(any_value(n) AS BIGINT) AS n, round(median(v), 1) AS median_duration, max(CASE WHEN i = round_even((n - 1) * 0.9, 0) THEN v END) AS p90 FROM r GROUP BY multi""")
def ag11_single_and_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.single_and_multi(tickets(spark, sf_dir))


@query(COMBOS + " SELECT * FROM (SELECT 'frequent' AS card, combination, n FROM combos WHERE contains(combination, '+') ORDER BY n DESC, combination LIMIT 6) UNION ALL SELECT * FROM (SELECT 'risky', combination, n FROM combos WHERE contains(combination, '+') AND n >= 5 ORDER BY overdue_rate DESC, combination LIMIT 6) UNION ALL SELECT * FROM (SELECT 'slow', combination, n FROM combos WHERE contains(combination, '+') ORDER BY median_duration DESC NULLS LAST, combination LIMIT 6)")
def ex18_process_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    combos = P.combinations(tickets(spark, sf_dir)).where(F.col("combination").contains("+"))
    card = lambda name, own: own.select(F.lit(name).alias("card"), "combination", "n")
    frequent = A.top(combos, 6, F.desc("n"), F.asc("combination"))
    risky = A.top(combos.where("n >= 5"), 6, F.desc("overdue_rate"), F.asc("combination"))
    slow = A.top(combos, 6, F.desc_nulls_last("median_duration"), F.asc("combination"))
    return card("frequent", frequent).unionAll(card("risky", risky)).unionAll(card("slow", slow))


@query(LINES + " SELECT line, final_line, count(*) AS n FROM lines GROUP BY ALL ORDER BY n DESC, line, final_line LIMIT 6")
def st5_top_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top(P.resolver_edges(tickets(spark, sf_dir)), 6, F.desc("n"), F.asc("line"), F.asc("final_line"))


@query("SELECT l_orderkey AS request_id, l_linenumber AS line, CASE WHEN coalesce(l_quantity, 0) > 25 OR coalesce(l_extendedprice, 0) > 50000 THEN 1 ELSE 0 END AS took_part, replace(lower(l_returnflag || '-' || l_linestatus), '-', ' line ') AS label FROM lineitem")
def sc04_participation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from halyard.functions import scalars as S

    label = F.replace(F.lower(F.concat_ws("-", "l_returnflag", "l_linestatus")), F.lit("-"), F.lit(" line "))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("line"), S.participated(F.col("l_quantity") - 25, F.col("l_extendedprice") - 50000).alias("took_part"), label.alias("label"))

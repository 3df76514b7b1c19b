"""Queries of the ticket workflow: routing by a row's own evidence, states and audits from one log, completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halyard.functions import scalars as S
from halyard.operators import analytics as A
from halyard.plans.analytics import PRIOR
from halyard.plans.registry import query
from halyard.sources.domain import TICKETS, predictions, predictions_sql, table, tickets

EVIDENCE = """sp AS (SELECT service, category, count(*) AS n FROM tickets GROUP BY ALL), pp AS (SELECT priority, category, count(*) AS n FROM tickets GROUP BY ALL), cc AS (SELECT category, count(*) AS n FROM tickets GROUP BY ALL),
cells AS (SELECT DISTINCT service, priority FROM tickets), ev AS (SELECT service, priority, c.category, round((coalesce(sp.n, 0) + 1) * (coalesce(pp.n, 0) + 1) / cc.n, 9) AS w FROM cells CROSS JOIN cc c JOIN cc USING (category) LEFT JOIN sp USING (service, category) LEFT JOIN pp USING (priority, category)),
top AS (SELECT service, priority, category, w / sum(w) OVER (PARTITION BY service, priority) AS weight, row_number() OVER (PARTITION BY service, priority ORDER BY w DESC, category) AS i FROM ev),
likely AS (SELECT t.request_id, CASE WHEN source_hash = 'operator-review' THEN 'confirmed_category' ELSE 'category_topk' END AS mode, CASE WHEN source_hash = 'operator-review' THEN t.category ELSE top.category END AS category, CASE WHEN source_hash = 'operator-review' THEN 1.0 ELSE weight END AS weight
  FROM tickets t JOIN top ON top.service = t.service AND top.priority = t.priority AND i <= CASE WHEN source_hash = 'operator-review' THEN 1 ELSE 3 END)"""


@query(f"""WITH {TICKETS}, {PRIOR}, {EVIDENCE}, {predictions_sql('a', 'model')},
mixed AS (SELECT request_id, final_line, sum(weight * prior) / sum(weight) AS prior FROM likely JOIN prior USING (category) GROUP BY ALL), modes AS (SELECT DISTINCT request_id, mode FROM likely),
r AS (SELECT row_id AS request_id, label AS final_line, CASE WHEN x.prior IS NULL THEN m.p ELSE 0.45 * m.p + 0.55 * x.prior END AS p FROM model m LEFT JOIN mixed x ON x.request_id = m.row_id AND x.final_line = m.label),
n AS (SELECT request_id, final_line, round(p / sum(p) OVER (PARTITION BY request_id), 4) AS p FROM r)
SELECT request_id, mode, row_number() OVER (PARTITION BY request_id ORDER BY p DESC, final_line) AS rank, final_line, p, max(p) OVER (PARTITION BY request_id) >= 0.55 AS accepted FROM n JOIN modes USING (request_id)""")
def pl05_row_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of each ticket in order: the model's probabilities mixed with the history of the ticket's own likely categories, or of its confirmed one."""
    rows = tickets(spark, sf_dir)
    likely = A.category_evidence(rows, ["service", "priority"], 3)
    model = predictions(spark, sf_dir).select(F.col("row_id").alias("request_id"), F.col("label").alias("final_line"), "p")
    return A.routed_by_evidence(model, likely, A.route_prior(rows))


@query(f"WITH {TICKETS}, t AS (SELECT request_id, duration_seconds AS s FROM tickets), h AS (SELECT request_id, s, CASE WHEN s IS NOT NULL THEN lpad(CAST(s // 3600 AS VARCHAR), CAST(greatest(2, length(CAST(s // 3600 AS VARCHAR))) AS INT), '0') || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') END AS human FROM t) SELECT request_id, human, CASE WHEN request_id % 10 = 0 THEN NULL ELSE s END AS parsed FROM h")
def sc02_ticket_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations of tickets as text and back; every tenth text is no duration."""
    rows = tickets(spark, sf_dir).select("request_id", S.human_duration("duration_seconds").alias("human"))
    text = F.when(F.col("request_id") % 10 == 0, F.concat(F.col("human"), F.lit(" h"))).otherwise(F.col("human"))
    return rows.select("request_id", "human", S.duration_seconds(text).alias("parsed"))


@query("WITH f AS (SELECT user_id, event_type, min(struct_pack(ts := ts, id := event_id)) AS first FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS kinds FROM f GROUP BY 1")
def se9_kinds_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of events of each user, each once, in the order in which they first came; firsts are found before they are gathered."""
    firsts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    kinds = firsts.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("first", "event_type"))).alias("kinds"))
    return kinds.select("user_id", F.array_join(F.col("kinds.event_type"), ",").alias("kinds"))


@query("""WITH s AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'skipped' WHEN 'error' THEN 'failed' END AS state FROM events),
k AS (SELECT user_id, event_id % 20 AS candidate, bool_or(state = 'completed') AS c, bool_or(state = 'skipped') AS s, bool_or(state = 'failed') AS f FROM s GROUP BY ALL)
SELECT user_id, count(*) AS candidates, count(*) FILTER (c) AS completed, count(*) FILTER (s) AS skipped, count(*) FILTER (f) AS failed, count(*) FILTER (c AND s) AS overlapping,
 count(*) FILTER (f) = 0 AND count(*) FILTER (c AND s) = 0 AND count(*) FILTER (c) + count(*) FILTER (s) = count(*) AS complete FROM k GROUP BY 1""")
def ex02_run_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each user's candidates are all completed or skipped, none both and none failed."""
    state = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "click", "skipped").when(F.col("event_type") == "error", "failed")
    log = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 20).alias("candidate"), state.alias("state"))
    return A.run_gate(log, "user_id", "candidate")

"""Queries on tickets: filters, aggregates, series, pages and risk."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halyard.functions import scalars as S
from halyard.operators import analytics as A
from halyard.plans.registry import query
from halyard.sources.domain import TICKETS, predictions, predictions_sql, table, tickets

START, END = date(1996, 3, 1), date(1999, 10, 31)
WHERE = "registration_date >= TIMESTAMP '1996-03-01' AND registration_date < TIMESTAMP '1999-11-01'"
MEASURES = """count(*) AS n, CAST(sum(CAST(overdue AS INT)) AS BIGINT) AS n_overdue,
  round(sum(CAST(overdue AS INT)) / count(*), 6) AS raw_rate,
  round((sum(CAST(overdue AS INT)) + 30 * (SELECT avg(CAST(overdue AS INT)) FROM tickets)) / (count(*) + 30), 6) AS smoothed_risk,
  CAST(coalesce(floor(round(quantile_cont(duration_seconds, 0.5), 3)), 0) AS BIGINT) AS p50, CAST(coalesce(floor(round(quantile_cont(duration_seconds, 0.9), 3)), 0) AS BIGINT) AS p90,
  round(avg(duration_seconds), 3) AS mean_duration, round(avg(clarifications), 6) AS mean_clarifications"""


@query(f"""WITH {TICKETS}, t AS (SELECT greatest(3, (SELECT clarifications FROM tickets ORDER BY clarifications LIMIT 1 OFFSET (SELECT CAST(ceil(0.9 * (count(*) - 1)) AS BIGINT) FROM tickets))) AS threshold)
SELECT {MEASURES}, CAST(sum(CASE WHEN line1 + line2 + line3 + line4 > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_multi_line,
       CAST(sum(CASE WHEN clarifications >= threshold THEN 1 ELSE 0 END) AS BIGINT) AS n_many_clarifications
FROM tickets, t WHERE {WHERE}""")
def ag01_kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tickets(spark, sf_dir)
    own = A.filtered(rows, START, END).join(F.broadcast(A.threshold(rows)))
    multi = F.sum((F.col("line1") + F.col("line2") + F.col("line3") + F.col("line4") > 1).cast("int")).alias("n_multi_line")
    many = F.sum((F.col("clarifications") >= F.col("threshold")).cast("int")).alias("n_many_clarifications")
    return A.finished(own.agg(*A.measures(), multi, many), A.global_rate(rows))


@query(f"WITH {TICKETS} SELECT coalesce(nullif(category, ''), 'not specified') AS value, {MEASURES} FROM tickets WHERE {WHERE} GROUP BY 1")
def ag02_breakdown_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tickets(spark, sf_dir)
    return A.breakdown(A.filtered(rows, START, END), "category", A.global_rate(rows))


@query(f"""WITH {TICKETS} {" UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS value, {MEASURES} FROM tickets GROUP BY {d}" for d in A.DIMENSIONS)}
UNION ALL SELECT 'total', 'all', {MEASURES} FROM tickets""")
def ag02_breakdown_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tickets(spark, sf_dir)
    return A.breakdowns(rows, A.global_rate(rows))


@query(f"WITH {TICKETS} SELECT strftime(registration_date, '%Y-%m') AS month, count(*) AS n, CAST(sum(CAST(overdue AS INT)) AS BIGINT) AS n_overdue FROM tickets WHERE service = 'MACHINERY' GROUP BY 1")
def ag03_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.monthly(A.filtered(tickets(spark, sf_dir), service="MACHINERY"))


@query(f"WITH {TICKETS} SELECT count(*) AS n, CAST(coalesce(sum(CAST(overdue AS INT)), 0) AS BIGINT) AS n_overdue FROM tickets WHERE category = 'NATION_3' AND priority = '2-HIGH'")
def ag04_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = A.filtered(tickets(spark, sf_dir), category="NATION_3", priority="2-HIGH")
    return own.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("overdue").cast("int")), F.lit(0)).alias("n_overdue"))


@query("SELECT CAST(user_id AS BIGINT) AS batch_id, event_type AS state, count(*) AS n FROM events GROUP BY ALL")
def ag05_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("batch_id"), F.col("event_type").alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 12")
def ag06_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).where("n > 12")


@query(f"WITH {TICKETS} {' UNION '.join(f'''SELECT '{d}' AS field, {d} AS option FROM tickets WHERE trim({d}) <> '' ''' for d in A.DIMENSIONS)}")
def ag07_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tickets(spark, sf_dir).select(F.explode(F.map_from_arrays(F.array(*map(F.lit, A.DIMENSIONS)), F.array(*A.DIMENSIONS))).alias("field", "option"))
    return rows.where(F.trim("option") != "").distinct()


@query(f"WITH {TICKETS} SELECT greatest(3, (SELECT clarifications FROM tickets ORDER BY clarifications LIMIT 1 OFFSET (SELECT CAST(ceil(0.9 * (count(*) - 1)) AS BIGINT) FROM tickets))) AS threshold")
def ag12_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.threshold(tickets(spark, sf_dir))


@query(f"WITH {TICKETS} SELECT category AS value, count(*) AS n FROM tickets GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def ag14_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top(tickets(spark, sf_dir).groupBy(F.col("category").alias("value")).agg(F.count(F.lit(1)).alias("n")), 10, F.desc("n"), F.asc("value"))


@query(f"""WITH {TICKETS}, c AS (SELECT category, final_line, count(*) AS n FROM tickets GROUP BY ALL)
SELECT category, final_line, n, round(n / sum(n) OVER (PARTITION BY category), 6) AS p, round(max(n) OVER (PARTITION BY category) / sum(n) OVER (PARTITION BY category), 6) AS dominant FROM c""")
def ag16_line_given_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("category")
    counts = tickets(spark, sf_dir).groupBy("category", "final_line").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumns({"p": F.round(F.col("n") / F.sum("n").over(own), 6), "dominant": F.round(F.max("n").over(own) / F.sum("n").over(own), 6)})


@query(f"WITH {TICKETS} SELECT category, count(DISTINCT user_name) AS n_groups FROM tickets GROUP BY 1")
def ag18_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tickets(spark, sf_dir).groupBy("category").agg(F.count_distinct("user_name").alias("n_groups"))


@query(f"WITH {TICKETS} SELECT user_name, max(registration_date) AS latest FROM tickets GROUP BY 1")
def ag21_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tickets(spark, sf_dir).groupBy("user_name").agg(F.max("registration_date").alias("latest"))


MODE = f"""WITH {TICKETS}, c AS (SELECT category, service, priority, final_line, count(*) AS n FROM tickets GROUP BY ALL),
m AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY category ORDER BY n DESC, service, priority, final_line) = 1)"""


def prototypes(rows: DataFrame) -> DataFrame:
    """Each category's most frequent combination; ties go to the one that sorts first."""
    counts = rows.groupBy("category", "service", "priority", "final_line").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("category").orderBy(F.desc("n"), "service", "priority", "final_line")
    return counts.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


@query(MODE + " SELECT category, service, priority, final_line, n FROM m")
def ag22_prototype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prototypes(tickets(spark, sf_dir))


@query(MODE + " SELECT r.request_id, m.service, m.priority, m.final_line FROM tickets r JOIN m USING (category) WHERE r.source_hash = 'operator-review'")
def jn17_prototype_of_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tickets(spark, sf_dir)
    return rows.where("source_hash = 'operator-review'").select("request_id", "category").join(prototypes(rows), "category").select("request_id", "service", "priority", "final_line")


@query(f"""WITH {TICKETS}, c AS (SELECT category, service, count(*) AS n FROM tickets GROUP BY ALL)
SELECT category, service, n, row_number() OVER (PARTITION BY category ORDER BY n DESC, service) AS rank FROM c QUALIFY rank <= 2""")
def ag23_top_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tickets(spark, sf_dir).groupBy("category", "service").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), "service")).cast("long")).where("rank <= 2")


@query(f"WITH {TICKETS} SELECT request_id FROM tickets WHERE {WHERE} AND service = 'BUILDING' AND category = 'NATION_5' AND final_line = 'F'")
def flt1_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.filtered(tickets(spark, sf_dir), START, END, service="BUILDING", category="NATION_5", priority=None, final_line="F").select("request_id")


@query(f"WITH {TICKETS} SELECT request_id, registration_date FROM tickets WHERE registration_date >= TIMESTAMP '1997-05-01' AND registration_date < TIMESTAMP '1997-05-11'")
def flt2_date_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.filtered(tickets(spark, sf_dir), date(1997, 5, 1), date(1997, 5, 10)).select("request_id", "registration_date")


@query(f"WITH {TICKETS} SELECT request_id, user_name FROM tickets WHERE (contains(CAST(request_id AS VARCHAR), '777') OR contains(user_name, '00042')) AND service = 'FURNITURE'")
def flt3_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.col("request_id").cast("string").contains("777") | F.col("user_name").contains("00042")
    return A.filtered(tickets(spark, sf_dir), service="FURNITURE").where(found).select("request_id", "user_name")


@query(f"WITH {TICKETS} SELECT final_line, count(*) AS n FROM tickets WHERE final_line IN ('F', 'P') AND priority NOT IN ('5-LOW', '4-NOT SPECIFIED') AND source_hash <> 'operator-review' GROUP BY 1")
def flt4_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tickets(spark, sf_dir).where(F.col("final_line").isin("F", "P") & ~F.col("priority").isin("5-LOW", "4-NOT SPECIFIED"))
    return (rows.where("source_hash <> 'operator-review'") if "source_hash" in rows.columns else rows).groupBy("final_line").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TICKETS}, top AS (SELECT category FROM tickets GROUP BY 1 ORDER BY count(*) DESC, category LIMIT 15) SELECT request_id, category FROM tickets SEMI JOIN top USING (category)")
def flt12_label_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tickets(spark, sf_dir)
    view = A.top(rows.groupBy("category").count(), 15, F.desc("count"), F.asc("category"))
    return rows.join(view, "category", "left_semi").select("request_id", "category")


@query(f"WITH {TICKETS}, ok AS (SELECT category, priority FROM tickets GROUP BY ALL HAVING count(*) >= 120) SELECT request_id FROM tickets SEMI JOIN ok USING (category, priority) WHERE trim(service) <> ''")
def flt13_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tickets(spark, sf_dir)
    enough = rows.groupBy("category", "priority").count().where("count >= 120")
    return rows.where(F.trim("service") != "").join(enough, ["category", "priority"], "left_semi").select("request_id")


@query(f"""WITH {TICKETS}, rate AS (SELECT avg(CAST(overdue AS INT)) AS g FROM tickets),
c1 AS (SELECT category, priority, service, count(*) AS n, sum(CAST(overdue AS INT)) AS k FROM tickets GROUP BY ALL),
c2 AS (SELECT category, priority, count(*) AS n, sum(CAST(overdue AS INT)) AS k FROM tickets GROUP BY ALL),
c3 AS (SELECT category, count(*) AS n, sum(CAST(overdue AS INT)) AS k FROM tickets GROUP BY ALL),
x AS (SELECT t.request_id, CASE WHEN c1.n >= 40 THEN 'category+priority+service' WHEN c2.n >= 40 THEN 'category+priority' WHEN c3.n >= 40 THEN 'category' ELSE 'global' END AS level,
  CASE WHEN c1.n >= 40 THEN c1.n WHEN c2.n >= 40 THEN c2.n WHEN c3.n >= 40 THEN c3.n ELSE (SELECT count(*) FROM tickets) END AS support,
  CASE WHEN c1.n >= 40 THEN c1.k WHEN c2.n >= 40 THEN c2.k WHEN c3.n >= 40 THEN c3.k ELSE (SELECT sum(CAST(overdue AS INT)) FROM tickets) END AS k
  FROM tickets t JOIN c1 USING (category, priority, service) JOIN c2 USING (category, priority) JOIN c3 USING (category)),
r AS (SELECT request_id, level, support, (k + 30 * g) / (support + 30) AS risk FROM x, rate)
SELECT request_id, level, CAST(support AS BIGINT) AS support, round(risk, 6) AS risk, round(greatest(0, risk - 1.96 * sqrt(risk * (1 - risk) / support)), 6) AS low,
  round(least(1, risk + 1.96 * sqrt(risk * (1 - risk) / support)), 6) AS high, CASE WHEN support >= 100 THEN 'high' WHEN support >= 30 THEN 'medium' ELSE 'low' END AS reliability FROM r""")
def pl06_segment_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.segment_risk(tickets(spark, sf_dir), [["category", "priority", "service"], ["category", "priority"], ["category"]], 40)


@query(f"""WITH {TICKETS}, p AS (SELECT category, final_line, count(*) AS n FROM tickets WHERE source_hash <> 'operator-review' GROUP BY ALL),
lines AS (SELECT DISTINCT final_line FROM tickets), cats AS (SELECT category, sum(n) AS total FROM p GROUP BY 1 HAVING sum(n) >= 3),
prior AS (SELECT c.category, l.final_line, (coalesce(p.n, 0) + 1) / (c.total + 3) AS prior FROM cats c, lines l LEFT JOIN p ON p.category = c.category AND p.final_line = l.final_line)
SELECT category, final_line, round(0.45 * (1 / 3) + 0.55 * prior, 6) AS p, row_number() OVER (PARTITION BY category ORDER BY round(0.45 * (1 / 3) + 0.55 * prior, 6) DESC, final_line) AS rank FROM prior""")
def pl05_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of a category: an even model mixed with the history of rows that no operator reviewed."""
    rows = tickets(spark, sf_dir)
    counts = rows.where("source_hash <> 'operator-review'").groupBy("category", "final_line").agg(F.count(F.lit(1)).alias("n"))
    enough = counts.groupBy("category").agg(F.sum("n").alias("total")).where("total >= 3")
    lines = rows.select("final_line").distinct().agg(F.sort_array(F.collect_set("final_line")).alias("lines"))  # a fixed handful of lines
    spine = enough.join(F.broadcast(lines)).select("category", "total", F.explode("lines").alias("final_line"))
    prior = spine.join(counts, ["category", "final_line"], "left").select("category", "final_line", ((F.coalesce("n", F.lit(0)) + 1) / (F.col("total") + 3)).alias("prior"))
    mixed = prior.select("category", "final_line", F.round(0.45 * F.lit(1 / 3) + 0.55 * F.col("prior"), 6).alias("p"))
    return mixed.withColumn("rank", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("p"), "final_line")).cast("long"))


PRIOR = """p AS (SELECT category, final_line, count(*) AS n FROM tickets WHERE source_hash <> 'operator-review' GROUP BY ALL), lines AS (SELECT DISTINCT final_line FROM tickets),
cats AS (SELECT category, sum(n) AS total FROM p GROUP BY 1 HAVING sum(n) >= 3),
prior AS (SELECT c.category, l.final_line, (coalesce(p.n, 0) + 1) / (c.total + 3) AS prior FROM cats c, lines l LEFT JOIN p ON p.category = c.category AND p.final_line = l.final_line)"""


@query(f"""WITH {TICKETS}, {PRIOR}, {predictions_sql('a', 'model')},
counted AS (SELECT service, category, count(*) AS n FROM tickets GROUP BY ALL), likely AS (SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY service ORDER BY n DESC, category) <= 3),
mixed AS (SELECT service, final_line, sum(n * prior) / sum(n) AS prior FROM likely JOIN prior USING (category) GROUP BY ALL),
r AS (SELECT t.request_id, m.label AS final_line, CASE WHEN x.prior IS NULL THEN m.p ELSE 0.45 * m.p + 0.55 * x.prior END AS p FROM tickets t JOIN model m ON m.row_id = t.request_id LEFT JOIN mixed x ON x.service = t.service AND x.final_line = m.label),
n AS (SELECT request_id, final_line, round(p / sum(p) OVER (PARTITION BY request_id), 4) AS p FROM r)
SELECT request_id, final_line, p, p >= 0.55 AS accepted FROM n QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY p DESC, final_line) = 1""")
def pl05_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of each ticket: its model's probabilities mixed with the history of the three likeliest categories of its service."""
    rows = tickets(spark, sf_dir)
    likely = rows.groupBy("service", "category").agg(F.count(F.lit(1)).alias("n"))
    likely = likely.withColumn("i", F.row_number().over(Window.partitionBy("service").orderBy(F.desc("n"), "category"))).where("i <= 3")
    model = predictions(spark, sf_dir).select(F.col("row_id").alias("request_id"), F.col("label").alias("final_line"), "p")
    routed = A.routed(rows.select("request_id", "service"), model, likely.select("service", "category", F.col("n").alias("weight")), A.route_prior(rows))
    return routed.select("request_id", "final_line", "p", (F.col("p") >= 0.55).alias("accepted"))


@query(f"WITH {TICKETS} SELECT request_id, registration_date, (SELECT count(*) FROM tickets WHERE service = 'HOUSEHOLD') AS total, (SELECT CAST(ceil(count(*) / 20) AS BIGINT) FROM tickets WHERE service = 'HOUSEHOLD') AS total_pages FROM tickets WHERE service = 'HOUSEHOLD' ORDER BY registration_date DESC, request_id LIMIT 20 OFFSET 40")
def st1_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = A.filtered(tickets(spark, sf_dir), service="HOUSEHOLD").select("request_id", "registration_date")
    total = own.agg(F.count(F.lit(1)).alias("total")).withColumn("total_pages", F.ceil(F.col("total") / 20))
    return A.page(own, [F.desc("registration_date"), F.asc("request_id")], 3, 20).join(F.broadcast(total))


@query(f"WITH {TICKETS} SELECT request_id, source_hash FROM tickets WHERE category = 'NATION_7' ORDER BY source_hash, request_id LIMIT 50")
def st2_sources_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top(A.filtered(tickets(spark, sf_dir), category="NATION_7").select("request_id", "source_hash"), 50, F.asc("source_hash"), F.asc("request_id"))


BY_CATEGORY = f"WITH {TICKETS}, b AS (SELECT category AS value, {MEASURES} FROM tickets GROUP BY 1)"


@query(BY_CATEGORY + " SELECT * FROM (SELECT 'attention' AS card, value, n FROM b WHERE n >= 10 AND n_overdue > 0 ORDER BY n_overdue DESC, value LIMIT 6) UNION ALL SELECT * FROM (SELECT 'risk', value, n FROM b ORDER BY smoothed_risk DESC, value LIMIT 4) UNION ALL SELECT * FROM (SELECT 'clarifications', value, n FROM b ORDER BY mean_clarifications DESC, value LIMIT 3) UNION ALL SELECT * FROM (SELECT 'slow', value, n FROM b WHERE n >= 5 ORDER BY p50 DESC, value LIMIT 4)")
def st4_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tickets(spark, sf_dir)
    b = A.breakdown(rows, "category", A.global_rate(rows))
    card = lambda name, own: own.select(F.lit(name).alias("card"), "value", "n")
    cards = [
        card("attention", A.top(b.where("n >= 10 AND n_overdue > 0"), 6, F.desc("n_overdue"), F.asc("value"))),
        card("risk", A.top(b, 4, F.desc("smoothed_risk"), F.asc("value"))),
        card("clarifications", A.top(b, 3, F.desc("mean_clarifications"), F.asc("value"))),
        card("slow", A.top(b.where("n >= 5"), 4, F.desc("p50"), F.asc("value"))),
    ]
    return cards[0].unionAll(cards[1]).unionAll(cards[2]).unionAll(cards[3])


@query(BY_CATEGORY + " SELECT value, n FROM (SELECT value, n FROM b ORDER BY n DESC, value LIMIT 15) ORDER BY n DESC, value LIMIT 6")
def ex19_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tickets(spark, sf_dir).groupBy(F.col("category").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    order = F.desc("n"), F.asc("value")
    return A.top(A.top(counts, 15, *order), 6, *order)


@query(f"""WITH {TICKETS}, c AS (SELECT date_trunc('month', registration_date) AS month, count(*) AS n FROM tickets WHERE category = 'NATION_1' AND service = 'BUILDING' AND priority = '1-URGENT' GROUP BY 1),
s AS (SELECT unnest(range((SELECT min(month) FROM c)::TIMESTAMP, (SELECT max(month) FROM c)::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 1 MONTH)) AS month)
SELECT strftime(s.month, '%Y-%m') AS month, coalesce(n, 0) AS n FROM s LEFT JOIN c ON s.month = c.month""")
def wn22_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.gap_filled(A.filtered(tickets(spark, sf_dir), category="NATION_1", service="BUILDING", priority="1-URGENT"))


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 25")
def wn23_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top(table(spark, sf_dir, "events").select("event_id", "ts"), 25, F.desc("ts"), F.asc("event_id"))


@query(f"WITH {TICKETS} SELECT category, request_id FROM (SELECT category, request_id, row_number() OVER (PARTITION BY category ORDER BY request_id) AS r, count(*) OVER (PARTITION BY category) AS n FROM tickets) WHERE r IN (1, n // 2 + 1, n)")
def wn19_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("category")
    rows = tickets(spark, sf_dir).select("category", "request_id", F.row_number().over(own.orderBy("request_id")).alias("r"), F.count(F.lit(1)).over(own).alias("n"))
    return rows.where("r IN (1, n div 2 + 1, n)").select("category", "request_id")


@query(f"WITH {TICKETS} SELECT request_id, CAST(floor(duration_seconds / 3600) AS BIGINT) AS hours, upper(substr(sha256(CAST(request_id AS VARCHAR)), 1, 12)) AS fingerprint, ('0x' || substr(sha256(CAST(request_id AS VARCHAR)), 1, 8))::BIGINT % 10 AS bucket FROM tickets")
def sc08_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tickets(spark, sf_dir).select("request_id", F.floor(F.col("duration_seconds") / 3600).alias("hours"), F.upper(S.fingerprint("request_id", 12)).alias("fingerprint"), S.hash_bucket("request_id").cast("long").alias("bucket"))

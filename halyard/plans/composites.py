"""Queries that put several operators together, and small rules of the workflow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halyard.functions import scalars as S
from halyard.operators import decision as D
from halyard.operators import policies as P
from halyard.plans.decisions import DECIDED, FOLDS, TWO, decided, fold_metrics, second_model
from halyard.plans.registry import query
from halyard.sources.domain import TICKETS, predictions, predictions_sql, table, tickets


@query(DECIDED + " SELECT row_id, CAST(round(least(0.4 * CAST(confidence < 0.5 AS INT) + 0.25 * CAST(row_id % 7 = 0 AS INT) + 0.2 * CAST(margin < 0.1 AS INT) + 0.15 * CAST(row_id % 11 = 0 AS INT), 1), 3) AS DOUBLE) AS priority FROM d")
def sc17_learning_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).select("row_id", P.learning_priority(F.col("confidence") < 0.5, F.col("row_id") % 7 == 0, F.col("margin"), F.col("row_id") % 11 == 0).alias("priority"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN least(o_orderkey % 10 / 20, 0.05) WHEN o_orderstatus = 'O' THEN least(o_orderkey % 10 / 20, 0.10) ELSE o_orderkey % 10 / 20 END AS weight, CASE WHEN o_orderkey % 60 <= 1 THEN 220 WHEN o_orderkey % 60 <= 5 THEN 180 WHEN o_orderkey % 60 <= 10 THEN 120 WHEN o_orderkey % 60 <= 20 THEN 80 WHEN o_orderkey % 60 <= 50 THEN 45 ELSE 25 END AS allocated FROM orders")
def sc18_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.when(F.col("o_orderstatus") == "F", "SYNTHETIC_ONLY").when(F.col("o_orderstatus") == "O", "SINGLE_REAL_ANCHOR").otherwise("MULTIPLE")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), P.capped_weight(F.col("o_orderkey") % 10 / 20, tier).alias("weight"), P.allocation(F.col("o_orderkey") % 60).alias("allocated"))


@query(DECIDED + " SELECT row_id, CASE WHEN confidence < 0.45 THEN 'confidence below 45.0%' WHEN margin < 0.1 THEN 'candidates are close' ELSE 'unlike known cases' END AS reason, CASE WHEN confidence >= 0.45 THEN predicted ELSE 'UNKNOWN' END AS label FROM d")
def pl07_unknown_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).select("row_id", P.review_reason(F.col("confidence"), F.col("margin"), 0.45, 0.1).alias("reason"), P.gated(F.col("predicted"), F.col("confidence"), 0.45).alias("label"))


def chance(*parts: str) -> str:
    """SQL of ``scalars.uniform``; the first part is the seed."""
    return f"(CAST(('0x' || substr(sha256(concat_ws('|', {', '.join(parts)})), 1, 8)) AS BIGINT) / 4294967296.0)"


def left(field: str, column: str) -> str:
    """SQL of a field under all scenarios."""
    gone = ", ".join(f"'{name}'" for name, fields in P.REMOVED.items() if field in fields) or "''"
    rates = " ".join(f"WHEN '{name}' THEN {share}" for name, share in P.CHANCE.items())
    name, shares = P.EMPIRICAL
    rate = f"CASE scenario {rates} WHEN '{name}' THEN {shares.get(field, 0.0)} ELSE 0.0 END"
    return f"CASE WHEN scenario NOT IN ({gone}) AND {chance("'31'", 'scenario', 'request_id', f"'{field}'")} >= {rate} THEN {column} END AS \"{field}\""


SCENARIO_FIELDS = {"user": "user_name", "service": "service", "request_type": "category", "priority": "priority", "description": "category || ' ' || service"}
SCENARIOS = ", ".join(left(f, SCENARIO_FIELDS[f]) if f in SCENARIO_FIELDS else f"CAST(NULL AS VARCHAR) AS {f}" for f in P.OPTIONAL)
NAMES = ", ".join(f"'{n}'" for n in (*P.REMOVED, *P.CHANCE, P.EMPIRICAL[0]))


@query(f"WITH {TICKETS} SELECT request_id, {', '.join(f"CASE WHEN {chance("'5'", "'random'", 'request_id', f"'{f}'")} >= 0.3 THEN {f} END AS {f}" for f in ('service', 'category', 'priority'))} FROM tickets")
def sc19_missingness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tickets(spark, sf_dir).select("request_id", "service", "category", "priority")
    return P.dropped(rows, ["service", "category", "priority"], "random", 0.3, 5, "request_id")


@query(f"WITH {TICKETS} SELECT request_id, scenario, {SCENARIOS} FROM tickets, (SELECT unnest([{NAMES}]) AS scenario)")
def sc19_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets under all eleven scenarios."""
    rows = tickets(spark, sf_dir).select("request_id", F.col("user_name").alias("user"), "service", F.col("category").alias("request_type"), "priority", F.concat_ws(" ", "category", "service").alias("description"))
    return P.scenarios(rows, "request_id")


@query(f"WITH p AS (SELECT p_partkey, p_name AS t, CAST(floor({chance("'3'", 'p_partkey')} * (length(p_name) - 3)) AS INT) + 2 AS i FROM part) SELECT p_partkey, CASE WHEN length(t) < 4 THEN t ELSE substr(t, 1, i - 1) || substr(t, i + 1, 1) || substr(t, i, 1) || substr(t, i + 2) END AS name FROM p")
def sc20_typos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", P.with_typo(F.col("p_name"), "p_partkey", 3).alias("name"))


@query("SELECT event_id, json_valid(CASE WHEN event_id % 5 = 0 THEN 'raw ' || props ELSE props END) AS parsed FROM events")
def sc23_json_or_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("raw "), "props")).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.try_parse_json(value).isNotNull().alias("parsed"))


@query("SELECT l_orderkey AS id, l_linenumber AS n, CAST(regexp_extract('line ' || l_linenumber || ' team', '[0-9]+') AS INT) AS line FROM lineitem")
def sc22_line_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("line "), F.col("l_linenumber").cast("string"), F.lit(" team"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.regexp_extract(name, "[0-9]+", 0).cast("int").alias("line"))


@query("SELECT event_id FROM events WHERE len(list_filter([CASE WHEN event_id % 3 = 0 THEN event_type ELSE '' END, CASE WHEN value > 40 THEN 'v' ELSE ' ' END], lambda x: trim(x) <> '')) > 0")
def flt7_any_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.array(F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(""), F.when(F.col("value") > 40, "v").otherwise(" "))
    return table(spark, sf_dir, "events").where(F.exists(fields, lambda x: F.trim(x) != "")).select("event_id")


@query(f"WITH {TICKETS}, o AS (SELECT DISTINCT user_name AS option FROM tickets) SELECT option FROM o WHERE contains(lower(option), lower('R#00000012'))")
def flt11_option_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = tickets(spark, sf_dir).select(F.col("user_name").alias("option")).distinct()
    return options.where(F.lower("option").contains("R#00000012".lower()))


@query(DECIDED + f", {predictions_sql('b', 'other')}, o AS (SELECT DISTINCT row_id, truth FROM other) SELECT d.row_id, d.truth = o.truth AS consistent FROM d JOIN o USING (row_id)")
def jn10_all_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (predictions(spark, sf_dir, m) for m in "ab")
    return P.in_all([a, b], "row_id")


@query("SELECT r_name, n_name, c_mktsegment FROM (SELECT DISTINCT c_mktsegment FROM customer), nation JOIN region ON n_regionkey = r_regionkey")
def jn09_rows_by_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row with each label; labels are few and travel as one array."""
    labels = table(spark, sf_dir, "customer").agg(F.collect_set("c_mktsegment").alias("labels"))
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return places.join(F.broadcast(labels)).select("r_name", "n_name", F.explode("labels").alias("c_mktsegment"))


@query("SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type")
def wn02_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    from halyard.operators.process import shared

    return shared(table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")))


@query("SELECT count(*) FILTER (known) AS inside, count(*) FILTER (NOT known) AS outside FROM (SELECT l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') AS known FROM lineitem)")
def se7_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(True).alias("known"))
    return table(spark, sf_dir, "lineitem").join(allowed, "l_orderkey", "left").agg(F.count_if(F.col("known").isNotNull()).alias("inside"), F.count_if(F.col("known").isNull()).alias("outside"))


@query("SELECT DISTINCT p_brand FROM part WHERE p_size > 25 EXCEPT SELECT p_brand FROM part WHERE p_size = 1")
def se8_new_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.where("p_size > 25").select("p_brand").subtract(part.where("p_size = 1").select("p_brand"))


@query(f"WITH {TICKETS} SELECT request_id, service, priority FROM tickets")
def prj5_safe_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tickets(spark, sf_dir).select("request_id", "service", "priority")
    if {"final_line", "duration_seconds", "overdue"} & set(rows.columns):
        raise AssertionError("fields that are known only later must not reach a model")
    return rows


@query(f"WITH {TICKETS} SELECT CAST(request_id AS VARCHAR) AS request_id, lower(trim(user_name)) AS user_name, line1 + line2 + line3 + line4 AS n_lines, CAST(overdue AS INT) AS overdue, duration_seconds, strftime(registration_date, '%Y-%m-%d') AS day, source_hash FROM tickets")
def prj1_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tickets(spark, sf_dir).select(F.col("request_id").cast("string").alias("request_id"), S.normalised("user_name").alias("user_name"), (F.col("line1") + F.col("line2") + F.col("line3") + F.col("line4")).alias("n_lines"), F.col("overdue").cast("int").alias("overdue"), "duration_seconds", F.date_format("registration_date", "yyyy-MM-dd").alias("day"), "source_hash")


@query("SELECT event_id, coalesce(json_extract_string(j, '$.a.k'), 'none') AS k, coalesce(json_extract_string(j, '$.a.z'), 'none') AS z FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '{}' ELSE '{\"a\": ' || props || '}' END AS j FROM events)")
def prj10_nested_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.when(F.col("event_id") % 4 == 0, "{}").otherwise(F.concat(F.lit('{"a": '), "props", F.lit("}")))
    return table(spark, sf_dir, "events").select("event_id", *(F.coalesce(F.get_json_object(doc, f"$.a.{k}"), F.lit("none")).alias(k) for k in ("k", "z")))


@query(DECIDED + ", s AS (SELECT row_id, CASE WHEN margin < 0.1 AND (row_id * 31 + 7) % 100 > (row_id * 17 + 3) % 100 + 5 THEN second ELSE predicted END AS predicted FROM d) SELECT row_id, predicted FROM s")
def pl13_margin_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Swap a close call if a semantic score favours the second by more than a margin."""
    from halyard.plans.decisions import with_second

    p = predictions(spark, sf_dir)
    d = with_second(p).join(D.decided(p).select("row_id", "margin"), "row_id")
    first, second = (F.col("row_id") * 17 + 3) % 100, (F.col("row_id") * 31 + 7) % 100
    swap = (F.col("margin") < 0.1) & (second > first + 5)
    return d.select("row_id", F.when(swap, F.col("second")).otherwise(F.col("predicted")).alias("predicted"))


@query("WITH d AS (SELECT strftime(ts, '%d') AS day, count(*) AS n, avg(CASE WHEN value > 20 THEN 1 ELSE 0 END) AS accepted FROM events GROUP BY 1) SELECT day, n, round(accepted, 6) AS accepted, abs(accepted - (SELECT avg(CASE WHEN value > 20 THEN 1 ELSE 0 END) FROM events)) > 0.05 AS alert FROM d")
def pl18_monitoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.date_format("ts", "dd").alias("day"), (F.col("value") > 20).cast("int").alias("ok"))
    base = events.agg(F.avg("ok").alias("base"))
    daily = events.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.avg("ok").alias("accepted"))
    return daily.join(F.broadcast(base)).select("day", "n", F.round("accepted", 6).alias("accepted"), (F.abs(F.col("accepted") - F.col("base")) > 0.05).alias("alert"))


@query("""WITH log AS (SELECT user_id AS version, event_id AS seen, CASE WHEN event_type = 'purchase' THEN 'promote' ELSE 'register' END AS action FROM events),
f AS (SELECT version, min(seen) AS registered FROM log WHERE action = 'register' GROUP BY 1), p AS (SELECT version, max(seen) AS promoted FROM log JOIN f USING (version) WHERE action = 'promote' AND seen >= registered GROUP BY 1)
SELECT version, CASE WHEN promoted IS NULL THEN 'challenger' WHEN promoted = max(promoted) OVER () THEN 'champion' ELSE 'archived' END AS status FROM f LEFT JOIN p USING (version)""")
def pl19_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("version"), F.col("event_id").alias("at"), F.when(F.col("event_type") == "purchase", "promote").otherwise("register").alias("action"))
    return P.registry_state(log)


@query(f"WITH {predictions_sql('a', 'a')}, {predictions_sql('b', 'b')}, h AS (SELECT row_id, label, 0.9 * a.p + 0.05 * b.p + 0.05 / 3 AS p FROM a JOIN b USING (row_id, label)) SELECT row_id, label, round(p / sum(p) OVER (PARTITION BY row_id), 4) AS p FROM h")
def ml11_blended_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three heads at 0.90, 0.05 and 0.05; the third is even."""
    a, b = (predictions(spark, sf_dir, m) for m in "ab")
    even = a.withColumn("p", F.lit(1 / 3))
    p = D.blended([(a, 0.9), (b, 0.05), (even, 0.05)])
    return p.select("row_id", "label", F.round(F.col("p") / F.sum("p").over(Window.partitionBy("row_id")), 4).alias("p"))


@query(f"WITH {TICKETS}, r AS (SELECT request_id, category, service, row_number() OVER (PARTITION BY category ORDER BY substr(sha256(CAST(request_id AS VARCHAR)), 1, 16), request_id) - 1 AS i FROM tickets) SELECT CAST(i // 4 AS BIGINT) AS batch, category, request_id FROM r")
def ml13_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows in batches with four rows of every class that has as many left."""
    own = Window.partitionBy("category").orderBy(S.fingerprint("request_id", 16), "request_id")
    rows = tickets(spark, sf_dir).select("request_id", "category", (F.row_number().over(own) - 1).alias("i"))
    return rows.select(F.expr("cast(i div 4 AS bigint)").alias("batch"), "category", "request_id")


@query(f"WITH {TICKETS}, t AS (SELECT service, category, final_line, count(*) AS n FROM tickets WHERE request_id % 4 <> 1 GROUP BY ALL), m AS (SELECT service, category, final_line AS guess FROM t QUALIFY row_number() OVER (PARTITION BY service, category ORDER BY n DESC, final_line) = 1) SELECT service, count(*) AS n, round(avg(CAST(final_line = guess AS INT)), 6) AS accuracy FROM tickets JOIN m USING (service, category) WHERE request_id % 4 = 1 GROUP BY 1")
def ml14_segment_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model for each service: the most frequent line of a category, tested on other rows."""
    rows = tickets(spark, sf_dir)
    counts = rows.where("request_id % 4 <> 1").groupBy("service", "category", "final_line").agg(F.count(F.lit(1)).alias("n"))
    model = counts.groupBy("service", "category").agg(F.min(F.struct((-F.col("n")).alias("n"), "final_line"))["final_line"].alias("guess"))
    test = rows.where("request_id % 4 = 1").join(model, ["service", "category"])
    return test.groupBy("service").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("final_line") == F.col("guess")).cast("int")), 6).alias("accuracy"))


@query(TWO + """, x AS (SELECT d.row_id, d.truth, d.predicted, o.guess, d.row_id % 4 AS fold FROM d JOIN o USING (row_id)), c AS (SELECT f.fold, predicted, guess, truth, count(*) AS n FROM x, (SELECT unnest(range(4)) AS fold) f WHERE x.fold <> f.fold GROUP BY ALL),
m AS (SELECT fold, predicted, guess, truth AS label FROM c QUALIFY row_number() OVER (PARTITION BY fold, predicted, guess ORDER BY n DESC, truth) = 1) SELECT row_id, coalesce(label, predicted) AS stacked FROM x LEFT JOIN m USING (fold, predicted, guess)""")
def ml10_oof_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A meta-table over two models' predictions, always fitted on the other folds.

    A fold's counts are the total minus its own, so one aggregate serves all folds.
    """
    rows = decided(spark, sf_dir).join(second_model(spark, sf_dir), "row_id").select("row_id", "truth", "predicted", "other", (F.col("row_id") % 4).alias("fold"))
    own = rows.groupBy("fold", "predicted", "other", "truth").agg(F.count(F.lit(1)).alias("n"))
    total = own.groupBy("predicted", "other", "truth").agg(F.sum("n").alias("t"))
    cells = total.withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))).join(own, ["fold", "predicted", "other", "truth"], "left")
    rest = cells.select("fold", "predicted", "other", "truth", (F.col("t") - F.coalesce("n", F.lit(0))).alias("n")).where("n > 0")
    meta = rest.groupBy("fold", "predicted", "other").agg(F.min(F.struct((-F.col("n")).alias("n"), "truth"))["truth"].alias("label"))
    return rows.join(meta, ["fold", "predicted", "other"], "left").select("row_id", F.coalesce("label", "predicted").alias("stacked"))


@query(FOLDS + " SELECT repeat, count(*) AS n, round(avg(top1), 6) AS top1 FROM a GROUP BY 1 HAVING count(*) = 4")
def ex03_complete_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_metrics(spark, sf_dir).groupBy("repeat").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("top1"), 6).alias("top1")).where("n = 4")


@query(f"WITH {predictions_sql('a', 'a')}, {predictions_sql('b', 'b')}, f AS (SELECT 'a' AS view, fold, row_id, label = truth AS hit FROM a QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY p DESC, label) = 1 UNION ALL SELECT 'b', fold, row_id, label = truth FROM b QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY p DESC, label) = 1), m AS (SELECT view, fold, avg(CAST(hit AS INT)) AS t, count(*) AS n FROM f GROUP BY ALL) SELECT view, round(avg(t), 6) AS mean, CAST(max(n) AS BIGINT) AS most_rows, CAST(sum(n) AS BIGINT) AS calls FROM m GROUP BY 1 HAVING count(*) = 4")
def ex04_two_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = [D.top_k(predictions(spark, sf_dir, m), 1).withColumn("view", F.lit(m)) for m in "ab"]
    folds = both[0].unionByName(both[1]).groupBy("view", "fold").agg(F.avg((F.col("label") == F.col("truth")).cast("int")).alias("t"), F.count(F.lit(1)).alias("n"))
    return folds.groupBy("view").agg(F.count(F.lit(1)).alias("k"), F.round(F.avg("t"), 6).alias("mean"), F.max("n").alias("most_rows"), F.sum("n").alias("calls")).where("k = 4").drop("k")


@query("WITH m AS (SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN value END) AS a, max(CASE WHEN event_type = 'click' THEN value END) AS b, max(CASE WHEN event_type = 'view' AND value > 60 THEN value END) AS c FROM events GROUP BY 1) SELECT user_id, coalesce(c, a, b) AS value, CASE WHEN c IS NOT NULL THEN 'view' WHEN a IS NOT NULL THEN 'purchase' ELSE 'click' END AS variant FROM m")
def ex09_preferred_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda kind, more=F.lit(True): F.max(F.when((F.col("event_type") == kind) & more, F.col("value")))
    m = table(spark, sf_dir, "events").groupBy("user_id").agg(of("purchase").alias("a"), of("click").alias("b"), of("view", F.col("value") > 60).alias("c"))
    return m.select("user_id", F.coalesce("c", "a", "b").alias("value"), F.when(F.col("c").isNotNull(), "view").when(F.col("a").isNotNull(), "purchase").otherwise("click").alias("variant"))


@query("SELECT lang, CASE WHEN lang IN ('en', 'de') THEN 'APPROVE' ELSE 'REJECT' END AS verdict, count(*) AS n, count(*) FILTER (doc_id % 10 = 0) AS reviewed FROM documents GROUP BY ALL")
def ex10_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("lang").isin("en", "de"), "APPROVE").otherwise("REJECT")
    return table(spark, sf_dir, "documents").groupBy("lang", verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("doc_id") % 10 == 0).alias("reviewed"))


@query("WITH ok AS (SELECT lang FROM documents GROUP BY 1 HAVING count(*) > 120), c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), proto AS (SELECT lang, source FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) = 1) SELECT d.doc_id, d.lang, p.source AS prototype FROM documents d JOIN proto p ON p.lang = d.lang WHERE d.lang IN (SELECT lang FROM ok) AND d.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def ex11_synthetic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    ok = docs.groupBy("lang").count().where("count > 120")
    bad = table(spark, sf_dir, "labels").where("toxic = 1")
    proto = docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")).groupBy("lang").agg(F.min(F.struct((-F.col("n")).alias("n"), "source"))["source"].alias("prototype"))
    return docs.join(ok, "lang", "left_semi").join(bad, "doc_id", "left_anti").join(proto, "lang").select("doc_id", "lang", "prototype")


@query(FOLDS + ", m AS (SELECT fold, avg(top1) AS t, min(top1) AS low FROM a GROUP BY 1) SELECT fold, round(0.6 * t + 0.3 * low + CASE WHEN low > 0.5 THEN 0.05 ELSE 0 END, 6) AS objective FROM m")
def ex06_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fold_metrics(spark, sf_dir).groupBy("fold").agg(F.avg("top1").alias("t"), F.min("top1").alias("low"))
    return m.select("fold", F.round(0.6 * F.col("t") + 0.3 * F.col("low") + F.when(F.col("low") > 0.5, 0.05).otherwise(0.0), 6).alias("objective"))


@query(DECIDED + """, g AS (SELECT predicted, confidence, count(*) AS n, count(*) FILTER (truth = predicted) AS k FROM d GROUP BY ALL), c AS (SELECT *, sum(n) OVER w AS na, sum(k) OVER w AS ka FROM g WINDOW w AS (PARTITION BY predicted ORDER BY confidence DESC ROWS UNBOUNDED PRECEDING)),
t AS (SELECT predicted, round(confidence, 6) AS threshold FROM c WHERE ka >= 0.8 * na AND na >= 5 QUALIFY row_number() OVER (PARTITION BY predicted ORDER BY na DESC, confidence) = 1)
SELECT truth, count(*) AS n, count(*) FILTER (round(confidence, 6) >= threshold) AS accepted, count(*) FILTER (round(confidence, 6) >= threshold AND truth = predicted) AS right FROM d LEFT JOIN t USING (predicted) GROUP BY 1""".replace(" AS right FROM", " AS correct FROM"))
def ex15_routing_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decided(spark, sf_dir)
    rows = d.join(F.broadcast(D.class_thresholds(d, 0.8, 5)), "predicted", "left")
    ok = F.round("confidence", 6) >= F.col("threshold")
    return rows.groupBy("truth").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("accepted"), F.count_if(ok & (F.col("truth") == F.col("predicted"))).alias("correct"))


@query("SELECT lang, count(*) AS n, sha256(CAST(sum(CAST(('0x' || substr(sha256(text || '/' || doc_id), 1, 12)) AS BIGINT)) AS VARCHAR)) AS seal FROM documents GROUP BY 1")
def ex12_seal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of the sum of the rows' hashes: any order of rows gives it, and no group is held together."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("/", "text", F.col("doc_id").cast("string")).cast("binary"), 256), 1, 12), 16, 10).cast("decimal(20,0)")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.sum(h).cast("string").cast("binary"), 256).alias("seal"))


@query(f"WITH {TICKETS} SELECT request_id, CASE WHEN registration_date >= TIMESTAMP '1998-01-01' OR request_id % 2 = 0 THEN category END AS category, CASE WHEN registration_date >= TIMESTAMP '1998-01-01' THEN 'new' ELSE 'none' END AS added FROM tickets")
def dml10_added_column_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old rows without a column beside new rows with it, old and new by date."""
    rows = tickets(spark, sf_dir).select("request_id", "category", (F.col("registration_date") >= F.lit("1998-01-01").cast("timestamp")).alias("late"))
    old = rows.where("NOT late").drop("late").withColumn("category", F.when(F.col("request_id") % 2 == 0, F.col("category")))
    new = rows.where("late").drop("late").withColumn("added", F.lit("new"))
    return old.unionByName(new, allowMissingColumns=True).withColumn("added", F.coalesce("added", F.lit("none")))

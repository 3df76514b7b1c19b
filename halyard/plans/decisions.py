"""Queries on class probabilities: ranking, calibration, selection, conformal sets, ensembles, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halyard.operators import decision as D
from halyard.plans.registry import query
from halyard.sources.domain import predictions, predictions_sql, table

RANKED = f"{predictions_sql()}, ranked AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY p DESC, label) AS rank FROM predictions)"
DECIDED = f"""WITH {RANKED}, d AS (SELECT row_id, any_value(truth) AS truth, max(CASE WHEN rank = 1 THEN label END) AS predicted, max(CASE WHEN rank = 2 THEN label END) AS second,
 max(CASE WHEN rank = 1 THEN p END) AS confidence, max(CASE WHEN rank = 1 THEN p END) - max(CASE WHEN rank = 2 THEN p END) AS margin,
 sum(-p * ln(p)) / ln(3) AS entropy, max(CASE WHEN label = truth THEN rank END) AS truth_rank FROM ranked GROUP BY row_id)"""
REPORT = """, r AS (SELECT l.label, coalesce(s.n, 0) AS support, coalesce(g.n, 0) AS guessed, coalesce(s.tp, 0) AS tp FROM (SELECT truth AS label FROM d UNION SELECT predicted FROM d) l
 LEFT JOIN (SELECT truth AS label, count(*) AS n, count(*) FILTER (truth = predicted) AS tp FROM d GROUP BY 1) s USING (label) LEFT JOIN (SELECT predicted AS label, count(*) AS n FROM d GROUP BY 1) g USING (label)),
f AS (SELECT label, support, guessed, CASE WHEN guessed > 0 THEN tp / guessed ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM r),
rep AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM f)"""


def decided(spark: SparkSession, sf_dir: str, model: str = "a") -> DataFrame:
    return D.decided(predictions(spark, sf_dir, model))


@query(f"WITH {RANKED} SELECT row_id, label, round(p, 9) AS p, rank FROM ranked WHERE rank <= 2")
def wn03_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.top_k(predictions(spark, sf_dir), 2).select("row_id", "label", F.round("p", 9).alias("p"), F.col("rank").cast("long").alias("rank"))


@query(DECIDED + " SELECT row_id, predicted, round(confidence, 6) AS confidence, round(margin, 6) AS margin, round(entropy, 6) AS entropy FROM d")
def wn04_margin_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).select("row_id", "predicted", *(F.round(c, 6).alias(c) for c in ("confidence", "margin", "entropy")))


@query(DECIDED + " SELECT truth_rank, count(*) AS n FROM d GROUP BY 1")
def wn05_truth_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).groupBy("truth_rank").agg(F.count(F.lit(1)).alias("n"))


@query(DECIDED + " SELECT truth, predicted, count(*) AS n FROM d GROUP BY ALL")
def ag27_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.confusion(decided(spark, sf_dir))


@query(DECIDED + REPORT + " SELECT label, support, guessed, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM rep")
def ag28_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.report(decided(spark, sf_dir)).select("label", "support", "guessed", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(DECIDED + REPORT + " SELECT round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(avg(recall) FILTER (support > 0), 6) AS balanced_accuracy, round(avg(f1) FILTER (support > 0), 6) AS supported_macro_f1, (SELECT label FROM rep ORDER BY f1, label LIMIT 1) AS worst FROM rep")
def ag28_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.summary(D.report(decided(spark, sf_dir)))


@query(DECIDED + REPORT + " SELECT CASE WHEN support <= 5 THEN '1-5' WHEN support <= 20 THEN '6-20' WHEN support <= 50 THEN '21-50' ELSE '>50' END AS band, count(*) AS labels, CAST(sum(support) AS BIGINT) AS support, round(avg(f1), 6) AS macro_f1 FROM rep WHERE support > 0 GROUP BY 1")
def ag29_band_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro F1 of the labels in each band of support."""
    labels = D.report(decided(spark, sf_dir)).where("support > 0")
    return labels.groupBy(D.support_band(F.col("support")).alias("band")).agg(F.count(F.lit(1)).alias("labels"), F.sum("support").alias("support"), F.round(F.avg("f1"), 6).alias("macro_f1"))


@query(DECIDED + " SELECT round(avg(CAST(truth_rank <= 1 AS INT)), 6) AS top1, round(avg(CAST(truth_rank <= 2 AS INT)), 6) AS top2, round(avg(CAST(truth_rank <= 3 AS INT)), 6) AS top3, round(avg(CAST(truth_rank <= 5 AS INT)), 6) AS top5, round(avg(1 / truth_rank), 6) AS mrr FROM d")
def ag30_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.ranking(decided(spark, sf_dir))


@query(DECIDED + """, b AS (SELECT row_id, sum(pow(p - CAST(label = truth AS INT), 2)) AS b, sum(CASE WHEN label = truth THEN -ln(p) ELSE 0 END) AS l FROM predictions GROUP BY 1),
c AS (SELECT least(floor(confidence * 10), 9) AS bin, count(*) AS n, avg(CAST(truth = predicted AS INT)) AS a, avg(confidence) AS c FROM d GROUP BY 1)
SELECT (SELECT round(sum(n * abs(a - c)) / sum(n), 6) FROM c) AS ece, round(avg(b), 6) AS brier, round(avg(l), 6) AS nll FROM b""")
def ag32_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    return D.calibration(p, D.decided(p))


@query(DECIDED + """, s AS (SELECT round(confidence, 4) AS s, truth = predicted AS y FROM d), g AS (SELECT s, count(*) AS n, count(*) FILTER (y) AS k FROM s GROUP BY 1),
c AS (SELECT *, sum(n) OVER w AS na, sum(k) OVER w AS ka, sum(k) OVER () AS pos, sum(n - k) OVER () AS neg FROM g WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING))
SELECT round(sum(k * (neg - (na - ka) + (n - k) / 2)) / any_value(pos) / any_value(neg), 6) AS auroc, round(sum(k * ka / na) / any_value(pos), 6) AS average_precision,
 round(min(CASE WHEN ka >= 0.95 * pos THEN (na - ka) / neg END), 6) AS fpr95 FROM c""")
def ag33_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decided(spark, sf_dir).withColumn("s", F.round("confidence", 4))
    return D.auroc(d, "s", F.col("truth") == F.col("predicted"))


@query("""WITH x AS (SELECT event_type, count(*) / sum(count(*)) OVER () AS x FROM events WHERE ts < TIMESTAMP '2024-01-11' GROUP BY 1), y AS (SELECT event_type, count(*) / sum(count(*)) OVER () AS y FROM events WHERE ts >= TIMESTAMP '2024-01-11' GROUP BY 1),
j AS (SELECT coalesce(x, 0) AS x, coalesce(y, 0) AS y, (coalesce(x, 0) + coalesce(y, 0)) / 2 AS m FROM x FULL JOIN y USING (event_type))
SELECT round(sum(CASE WHEN x > 0 THEN x * log2(x / m) ELSE 0 END + CASE WHEN y > 0 THEN y * log2(y / m) ELSE 0 END) / 2, 6) AS js FROM j""")
def ag34_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return D.divergence(events.where("ts < '2024-01-11'"), events.where("ts >= '2024-01-11'"), "event_type")


TWO = DECIDED + f""", {predictions_sql("b", "other")}, o AS (SELECT row_id, label AS guess FROM other QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY p DESC, label) = 1)"""


def second_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir, "b").select("row_id", F.col("predicted").alias("other"))


@query(TWO + " SELECT CAST(count(*) FILTER (predicted <> truth AND guess = truth) AS BIGINT) AS corrected, CAST(count(*) FILTER (predicted = truth AND guess <> truth) AS BIGINT) AS introduced FROM d JOIN o USING (row_id)")
def ag35_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decided(spark, sf_dir).join(second_model(spark, sf_dir), "row_id")
    right, now = F.col("predicted") == F.col("truth"), F.col("other") == F.col("truth")
    return rows.agg(F.count_if(~right & now).alias("corrected"), F.count_if(right & ~now).alias("introduced"))


@query(DECIDED + """, x AS (SELECT row_number() OVER (ORDER BY confidence DESC, row_id) AS i, CAST(truth = predicted AS INT) AS hit, count(*) OVER () AS n FROM d), r AS (SELECT i, n, sum(hit) OVER (ORDER BY i) AS k FROM x), c AS (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9, 1.0]) AS coverage)
SELECT CAST(coverage AS DOUBLE) AS coverage, i AS accepted, CAST(i - k AS BIGINT) AS errors, round(k / i, 6) AS accuracy FROM r JOIN c ON i = ceil(n * coverage)""")
def wn06_risk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.risk_coverage(decided(spark, sf_dir), [0.1, 0.25, 0.5, 0.75, 0.9, 1.0])


@query(DECIDED + """, g AS (SELECT predicted, confidence, count(*) AS n, count(*) FILTER (truth = predicted) AS k FROM d GROUP BY ALL), c AS (SELECT *, sum(n) OVER w AS na, sum(k) OVER w AS ka FROM g WINDOW w AS (PARTITION BY predicted ORDER BY confidence DESC ROWS UNBOUNDED PRECEDING))
SELECT predicted, round(confidence, 6) AS threshold, CAST(na AS BIGINT) AS accepted FROM c WHERE ka >= 0.8 * na AND na >= 5 QUALIFY row_number() OVER (PARTITION BY predicted ORDER BY na DESC, confidence) = 1""")
def wn08_class_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.class_thresholds(decided(spark, sf_dir), 0.8, 5)


@query(DECIDED + """, g AS (SELECT confidence, count(*) AS n, count(*) FILTER (truth = predicted) AS k FROM d GROUP BY 1), c AS (SELECT *, sum(n) OVER w AS na, sum(k) OVER w AS ka FROM g WINDOW w AS (ORDER BY confidence DESC ROWS UNBOUNDED PRECEDING))
SELECT CAST(max(na) FILTER (ka >= 0.75 * na) AS BIGINT) AS accepted, round(min(confidence) FILTER (ka >= 0.75 * na), 6) AS threshold FROM c""")
def wn07_coverage_at_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = D.curve(decided(spark, sf_dir), "confidence", F.col("truth") == F.col("predicted")).where("k_above >= 0.75 * n_above")
    return c.agg(F.max("n_above").alias("accepted"), F.round(F.min("confidence"), 6).alias("threshold"))


@query(DECIDED + """, g AS (SELECT margin, count(*) AS n, count(*) FILTER (truth <> predicted) AS k FROM d GROUP BY 1), c AS (SELECT *, sum(n) OVER w AS na, sum(k) OVER w AS ka, sum(k) OVER () AS pos FROM g WINDOW w AS (ORDER BY margin ROWS UNBOUNDED PRECEDING))
SELECT round(min(margin), 6) AS threshold, CAST(min(na - ka) AS BIGINT) AS false_alarms FROM c WHERE ka >= 0.9 * pos""")
def wn10_oos_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least score at which nine in ten errors are flagged; the score is the negative margin."""
    d = decided(spark, sf_dir).withColumn("score", -F.col("margin"))
    c = D.curve(d, "score", F.col("truth") != F.col("predicted")).where("k_above >= 0.9 * k_all")
    return c.agg(F.round(-F.max("score"), 6).alias("threshold"), F.min(F.col("n_above") - F.col("k_above")).alias("false_alarms"))


@query(f"""WITH {predictions_sql()}, c AS (SELECT *, round(sum(p) OVER (PARTITION BY row_id ORDER BY p DESC, label ROWS UNBOUNDED PRECEDING), 9) AS cum FROM predictions),
s AS (SELECT cum, row_number() OVER (ORDER BY cum) AS i, count(*) OVER () AS n FROM c WHERE row_id % 2 = 0 AND label = truth), q AS (SELECT cum AS q FROM s WHERE i = least(n, ceil((n + 1) * 0.9)))
SELECT row_id, truth, string_agg(label, ',' ORDER BY label) AS set, max(CAST(label = truth AS INT)) AS covered FROM c, q WHERE row_id % 2 = 1 AND round(cum - p, 9) < q GROUP BY ALL""")
def wn11_conformal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.conformal_sets(predictions(spark, sf_dir), F.col("row_id") % 2 == 0, 0.1)


@query(f"WITH {predictions_sql()}, e AS (SELECT row_id, label, exp(p / 0.5) AS e FROM predictions) SELECT row_id, label, round(e / sum(e) OVER (PARTITION BY row_id), 6) AS p FROM e")
def wn15_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("row_id")
    e = F.exp((F.col("p") - F.max("p").over(own)) / 0.5)
    return predictions(spark, sf_dir).withColumn("e", e).select("row_id", "label", F.round(F.col("e") / F.sum("e").over(own), 6).alias("p"))


GRID_T, GRID_M = [0.35, 0.45, 0.55, 0.65], [0.0, 0.05, 0.1, 0.2]


@query(DECIDED + f""", g AS (SELECT threshold, least_margin, count(*) AS n, count(*) FILTER (confidence >= threshold AND margin >= least_margin) AS accepted, count(*) FILTER (confidence >= threshold AND margin >= least_margin AND truth = predicted) AS ok
 FROM d, (SELECT CAST(unnest({GRID_T}) AS DOUBLE) AS threshold), (SELECT CAST(unnest({GRID_M}) AS DOUBLE) AS least_margin) GROUP BY ALL)
SELECT threshold, least_margin, accepted, round(CASE WHEN accepted > 0 THEN ok / accepted ELSE 0 END, 6) AS accuracy, round(0.65 * CASE WHEN accepted > 0 THEN ok / accepted ELSE 0 END + 0.35 * accepted / n, 6) AS utility FROM g""")
def pl08_policy_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.grid_policy(decided(spark, sf_dir), GRID_T, GRID_M)


@query(f"""WITH {predictions_sql()}, s AS (SELECT row_id, t, sum(pow(p, 1 / t)) AS z, sum(CASE WHEN label = truth THEN pow(p, 1 / t) ELSE 0 END) AS own FROM predictions, (SELECT CAST(unnest([0.6, 0.8, 1.0, 1.4, 2.0]) AS DOUBLE) AS t) GROUP BY ALL)
SELECT t, round(avg(-ln(own / z)), 6) AS nll FROM s GROUP BY 1""")
def pl09_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.temperatures(predictions(spark, sf_dir), [0.6, 0.8, 1.0, 1.4, 2.0])


@query(f"""WITH {predictions_sql("a", "a")}, {predictions_sql("b", "b")}, m AS (SELECT row_id, label, a.truth, 0.75 * a.p + 0.25 * b.p AS p FROM a JOIN b USING (row_id, label)),
r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY round(p, 9) DESC, label) AS rank FROM m) SELECT row_id, label AS predicted, round(round(p, 9), 6) AS p FROM r WHERE rank = 1""")
def pl10_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.blended([(predictions(spark, sf_dir, "a"), 0.75), (predictions(spark, sf_dir, "b"), 0.25)])
    return D.top_k(p.withColumn("p", F.round("p", 9)), 1).select("row_id", F.col("label").alias("predicted"), F.round("p", 6).alias("p"))


@query(TWO + """, v AS (SELECT row_id, predicted AS label FROM d UNION ALL SELECT row_id, guess FROM o UNION ALL SELECT row_id, truth FROM d WHERE row_id % 5 = 0)
SELECT row_id, label, n FROM (SELECT row_id, label, count(*) AS n FROM v GROUP BY row_id, label) QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY n DESC, label) = 1""")
def pl11_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decided(spark, sf_dir)
    votes = d.select("row_id", F.col("predicted").alias("label")).unionAll(second_model(spark, sf_dir)).unionAll(d.where("row_id % 5 = 0").select("row_id", "truth"))
    counts = votes.groupBy("row_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("row_id").orderBy(F.desc("n"), "label"))).where("r = 1").drop("r")


PAIRS = TWO + """, x AS (SELECT d.*, o.guess, CASE WHEN predicted < second THEN predicted || '|' || second ELSE second || '|' || predicted END AS pair, row_id % 4 AS f FROM d JOIN o USING (row_id)),
pairs AS (SELECT pair, count(*) FILTER (predicted <> truth AND guess = truth AND guess = second) AS corrected, count(*) FILTER (predicted = truth AND guess = second) AS introduced FROM x GROUP BY 1)"""


def with_second(p: DataFrame) -> DataFrame:
    first = D.ranked(p).where("rank <= 2").groupBy("row_id", "truth").agg(F.max(F.when(F.col("rank") == 1, F.col("label"))).alias("predicted"), F.max(F.when(F.col("rank") == 2, F.col("label"))).alias("second"))
    return first


def confused_pairs(d: DataFrame, other: DataFrame) -> DataFrame:
    rows = d.join(other, "row_id").withColumn("pair", F.array_join(F.sort_array(F.array("predicted", "second")), "|"))
    take = F.col("other") == F.col("second")
    return rows.groupBy("pair").agg(F.count_if((F.col("predicted") != F.col("truth")) & (F.col("other") == F.col("truth")) & take).alias("corrected"), F.count_if((F.col("predicted") == F.col("truth")) & take).alias("introduced"))


@query(PAIRS + " SELECT pair, corrected, introduced FROM pairs")
def pl12_confused_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confused_pairs(with_second(predictions(spark, sf_dir)), second_model(spark, sf_dir))


@query(PAIRS + ", good AS (SELECT pair FROM pairs WHERE corrected >= 3 ORDER BY corrected - introduced DESC, pair LIMIT 2) SELECT row_id, CASE WHEN good.pair IS NOT NULL AND guess = second THEN second ELSE predicted END AS predicted FROM x LEFT JOIN good USING (pair)")
def pl12_swapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, other = with_second(predictions(spark, sf_dir)), second_model(spark, sf_dir)
    pairs = confused_pairs(d, other).where("corrected >= 3").orderBy(F.desc(F.col("corrected") - F.col("introduced")), "pair").limit(2)
    return D.swapped(d, pairs, other).select("row_id", "predicted")


@query(TWO + ", w AS (SELECT CAST(unnest([0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS DOUBLE) AS w), m AS (SELECT w, a.row_id, a.label, a.truth, row_number() OVER (PARTITION BY w, a.row_id ORDER BY round(w * a.p + (1 - w) * b.p, 9) DESC, a.label) AS r FROM predictions a JOIN other b USING (row_id, label), w) SELECT w AS weight, round(avg(CAST(label = truth AS INT)), 6) AS accuracy FROM m WHERE r = 1 GROUP BY 1")
def pl10_weight_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of every blend weight in one pass: a row's labels meet once, as a list that every weight reads."""
    a, b = predictions(spark, sf_dir, "a"), predictions(spark, sf_dir, "b").select("row_id", "label", F.col("p").alias("q"))
    rows = a.join(b, ["row_id", "label"]).groupBy("row_id", "truth").agg(F.collect_list(F.struct("label", "p", "q")).alias("found"))

    def predicted(weight: float) -> Column:
        mixed = lambda x: F.round(weight * x["p"] + (1 - F.lit(weight)) * x["q"], 9)
        return F.array_min(F.transform("found", lambda x: F.struct((-mixed(x)).alias("m"), x["label"].alias("label"))))["label"]

    hits = F.array(*(F.struct(F.lit(w).alias("weight"), (predicted(w) == F.col("truth")).cast("int").alias("hit")) for w in (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)))
    return rows.select(F.explode(hits).alias("x")).groupBy("x.weight").agg(F.round(F.avg("x.hit"), 6).alias("accuracy"))


FOLDS = f"""WITH {predictions_sql()}, f AS (SELECT repeat, fold, row_id, label = truth AS hit FROM predictions QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY p DESC, label) = 1), a AS (SELECT repeat, fold, avg(CAST(hit AS INT)) AS top1 FROM f GROUP BY ALL)"""


def fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = D.top_k(predictions(spark, sf_dir), 1)
    return best.groupBy("repeat", "fold").agg(F.avg((F.col("label") == F.col("truth")).cast("int")).alias("top1"))


@query(FOLDS + " SELECT count(*) AS folds, round(avg(top1), 6) AS mean, round(stddev_pop(top1), 6) AS deviation FROM a")
def ag25_fold_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_metrics(spark, sf_dir).agg(F.count(F.lit(1)).alias("folds"), F.round(F.avg("top1"), 6).alias("mean"), F.round(F.stddev_pop("top1"), 6).alias("deviation"))


@query(FOLDS + " SELECT fold, round(avg(top1), 6) AS top1, count(*) AS n FROM a GROUP BY 1 HAVING count(*) = 3 ORDER BY top1 DESC, fold LIMIT 3")
def ag26_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fold_metrics(spark, sf_dir).groupBy("fold").agg(F.round(F.avg("top1"), 6).alias("top1"), F.count(F.lit(1)).alias("n")).where("n = 3")
    return own.orderBy(F.desc("top1"), "fold").limit(3)


@query(FOLDS + ", g AS (SELECT fold, round(avg(top1), 6) AS t, round(min(top1), 6) AS m FROM a GROUP BY 1), b AS (SELECT * FROM g WHERE fold = 1) SELECT g.fold FROM g, b WHERE g.t >= b.t AND g.m >= b.m AND (g.t > b.t OR g.m > b.m)")
def ag36_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fold_metrics(spark, sf_dir).groupBy("fold").agg(F.round(F.avg("top1"), 6).alias("t"), F.round(F.min("top1"), 6).alias("m"))
    base = g.where("fold = 1").select(F.col("t").alias("bt"), F.col("m").alias("bm"))
    return g.join(F.broadcast(base), (F.col("t") >= F.col("bt")) & (F.col("m") >= F.col("bm")) & ((F.col("t") > F.col("bt")) | (F.col("m") > F.col("bm")))).select("fold")


@query(FOLDS + " SELECT fold, round(avg(top1) - 0.02 * ln(1 + fold) - 0.5 * stddev_pop(top1), 6) AS score FROM a GROUP BY 1 ORDER BY score DESC, fold LIMIT 1")
def st7_finalist(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.avg("top1") - 0.02 * F.ln(1 + F.col("fold")) - 0.5 * F.stddev_pop("top1")
    return fold_metrics(spark, sf_dir).groupBy("fold").agg(F.round(score, 6).alias("score")).orderBy(F.desc("score"), "fold").limit(1)


@query(FOLDS + " SELECT repeat, fold FROM a QUALIFY row_number() OVER (PARTITION BY repeat ORDER BY top1 DESC, fold) = 1")
def st6_best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_metrics(spark, sf_dir).groupBy("repeat").agg(F.max_by("fold", F.struct("top1", (-F.col("fold")).alias("f"))).alias("fold"))


@query(TWO + ", n AS (SELECT row_id, predicted FROM d JOIN o USING (row_id) WHERE predicted <> guess) SELECT predicted, count(*) AS n FROM n GROUP BY 1")
def ex07_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decided(spark, sf_dir).join(second_model(spark, sf_dir), "row_id").where("predicted <> other")
    return rows.groupBy("predicted").agg(F.count(F.lit(1)).alias("n"))


POISSON = "CASE " + " ".join(f"WHEN u < {c} THEN {k}" for k, c in enumerate(D.POISSON_CUTS)) + " ELSE 5 END"


@query(TWO + f""", x AS (SELECT row_id, CAST(guess = truth AS INT) - CAST(predicted = truth AS INT) AS gain, replicate FROM d JOIN o USING (row_id), (SELECT unnest(range(1, 51)) AS replicate)),
u AS (SELECT *, CAST(('0x' || substr(sha256(concat_ws('|', '17', row_id, replicate)), 1, 8)) AS BIGINT) / 4294967296.0 AS u FROM x), m AS (SELECT replicate, sum({POISSON} * gain) / sum({POISSON}) AS m FROM u GROUP BY 1)
SELECT round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m""")
def pl15_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paired bootstrap of the accuracy difference of two models, by Poisson weights from a hash of row and replicate."""
    rows = decided(spark, sf_dir).join(second_model(spark, sf_dir), "row_id")
    gain = (F.col("other") == F.col("truth")).cast("int") - (F.col("predicted") == F.col("truth")).cast("int")
    means = D.drawn(rows.select("row_id", gain.alias("gain")), "row_id", 50, 17).groupBy("replicate").agg((F.sum(F.col("w") * F.col("gain")) / F.sum("w")).alias("m"))
    return means.agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.percentile("m", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("m", F.lit(0.975)), 6).alias("high"))


#: A cluster's own counts are small, so they are added up before replicates are drawn, and a replicate weighs whole clusters.
CLUSTERED = TWO + f""", x AS (SELECT o_custkey AS cluster, d.truth, predicted, guess FROM d JOIN o USING (row_id) JOIN orders ON o_orderkey = row_id),
c AS (SELECT cluster, label, count(*) FILTER (truth = label) AS n, count(*) FILTER (truth = label AND predicted = label) AS ka, count(*) FILTER (predicted = label) AS ga, count(*) FILTER (truth = label AND guess = label) AS kb, count(*) FILTER (guess = label) AS gb
  FROM x, (SELECT unnest(['F', 'O', 'P']) AS label) GROUP BY ALL),
u AS (SELECT cluster, replicate, CAST(('0x' || substr(sha256(concat_ws('|', '23', cluster, replicate)), 1, 8)) AS BIGINT) / 4294967296.0 AS u FROM (SELECT DISTINCT cluster FROM c), (SELECT unnest(range(1, 41)) AS replicate)),
s AS (SELECT replicate, label, sum({POISSON} * n) AS n, sum({POISSON} * ka) AS ka, sum({POISSON} * ga) AS ga, sum({POISSON} * kb) AS kb, sum({POISSON} * gb) AS gb FROM c JOIN u USING (cluster) GROUP BY ALL),
f AS (SELECT replicate, sum(kb - ka) / sum(n) AS accuracy, avg(2 * kb / nullif(n + gb, 0)) - avg(2 * ka / nullif(n + ga, 0)) AS f1 FROM s GROUP BY 1)"""
CLUSTER_REPORT = " SELECT metric, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, round(avg(CAST(v > 0 AS INT)), 6) AS better FROM (SELECT 'accuracy' AS metric, accuracy AS v FROM f UNION ALL SELECT 'macro_f1', f1 FROM f) GROUP BY 1"


@query(CLUSTERED + CLUSTER_REPORT)
def pl15_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of two models in accuracy and macro F1 under a bootstrap of customers, whose rows stay together."""
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("cluster"))
    rows = decided(spark, sf_dir).join(second_model(spark, sf_dir), "row_id").join(own, "row_id")
    return D.clustered_bootstrap(rows.select("cluster", "truth", "predicted", F.col("other")), 40, 23)

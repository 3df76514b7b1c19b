"""Decisions on class probabilities in long form: ``row_id, label, p, truth``.

Ties always go to the label, then the id, that sorts first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.functions import scalars as S
from halyard.operators import prefix


def ranked(p: DataFrame, *keys: str) -> DataFrame:
    own = Window.partitionBy(*(keys or ("row_id",))).orderBy(F.desc("p"), "label")
    return p.withColumn("rank", F.row_number().over(own))


def top_k(p: DataFrame, k: int) -> DataFrame:
    return ranked(p).where(F.col("rank") <= k)


def decided(p: DataFrame) -> DataFrame:
    """One row a case: prediction, its probability, margin to the second, normalised entropy, rank of the truth.

    One aggregate by row, and no window: the two best come from the two greatest structs.
    """
    best = F.sort_array(F.collect_list(F.struct((-F.col("p")).alias("np"), F.col("label").alias("label"))))
    rows = p.groupBy("row_id", "truth").agg(best.alias("best"), F.sum(F.when(F.col("p") > 0, -F.col("p") * F.ln("p")).otherwise(0.0)).alias("h"))
    top, second = F.col("best")[0], F.get(F.col("best"), F.lit(1))
    return rows.select(
        "row_id",
        "truth",
        top["label"].alias("predicted"),
        (-top["np"]).alias("confidence"),
        (F.coalesce(second["np"], F.lit(0.0)) - top["np"]).alias("margin"),
        F.when(F.size("best") > 1, F.col("h") / F.ln(F.size("best").cast("double"))).otherwise(0.0).alias("entropy"),
        F.array_position(F.transform("best", lambda x: x["label"]), F.col("truth")).alias("truth_rank"),
    )


def confusion(d: DataFrame) -> DataFrame:
    return d.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))


def report(d: DataFrame) -> DataFrame:
    """Precision, recall and F1 of every label that occurs as truth or prediction; 0 where undefined."""
    hit = (F.col("truth") == F.col("predicted")).cast("int")
    by_truth = d.groupBy(F.col("truth").alias("label")).agg(F.count(F.lit(1)).alias("support"), F.sum(hit).alias("tp"))
    by_guess = d.groupBy(F.col("predicted").alias("label")).agg(F.count(F.lit(1)).alias("guessed"))
    rows = by_truth.join(by_guess, "label", "full_outer").na.fill(0)
    precision = F.when(F.col("guessed") > 0, F.col("tp") / F.col("guessed")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    rows = rows.withColumns({"precision": precision, "recall": recall})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return rows.select("label", "support", "guessed", "precision", "recall", f1.alias("f1"))


def summary(r: DataFrame) -> DataFrame:
    """Macro and weighted F1, balanced accuracy, the worst class and macro F1 of labels with support."""
    return r.agg(
        F.round(F.avg("f1"), 6).alias("macro_f1"),
        F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 6).alias("weighted_f1"),
        F.round(F.avg(F.when(F.col("support") > 0, F.col("recall"))), 6).alias("balanced_accuracy"),
        F.round(F.avg(F.when(F.col("support") > 0, F.col("f1"))), 6).alias("supported_macro_f1"),
        F.min_by("label", F.struct(F.col("f1"), F.col("label"))).alias("worst"),
    )


def support_band(n: Column) -> Column:
    return F.when(n <= 5, "1-5").when(n <= 20, "6-20").when(n <= 50, "21-50").otherwise(">50")


def ranking(d: DataFrame) -> DataFrame:
    r = F.col("truth_rank")
    return d.agg(*(F.round(F.avg((r <= k).cast("int")), 6).alias(f"top{k}") for k in (1, 2, 3, 5)), F.round(F.avg(1 / r), 6).alias("mrr"))


def calibration(p: DataFrame, d: DataFrame, bins: int = 10) -> DataFrame:
    """Brier score, expected calibration error in equal bins (the last one closed) and negative log likelihood."""
    brier = p.groupBy("row_id").agg(F.sum(F.pow(F.col("p") - (F.col("label") == F.col("truth")).cast("int"), 2)).alias("b"), F.sum(F.when(F.col("label") == F.col("truth"), -F.ln(F.greatest("p", F.lit(1e-12)))).otherwise(0.0)).alias("l")).agg(F.round(F.avg("b"), 6).alias("brier"), F.round(F.avg("l"), 6).alias("nll"))
    hit = (F.col("truth") == F.col("predicted")).cast("int")
    cells = d.groupBy(F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("a"), F.avg("confidence").alias("c"))
    return cells.agg(F.round(F.sum(F.col("n") * F.abs(F.col("a") - F.col("c"))) / F.sum("n"), 6).alias("ece")).join(brier)


def curve(scores: DataFrame, score: str, hit: Column, *keys: str) -> DataFrame:
    """Numbers of rows and hits at or above each distinct score, and ``n_all`` and ``k_all`` of the key. Counts by score come first."""
    counts = scores.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("n"), F.sum(hit.cast("int")).alias("k"))
    return prefix.running(counts, score, ["n", "k"], keys, descending=True).withColumnsRenamed({"n_upto": "n_above", "k_upto": "k_above"})


def class_thresholds(d: DataFrame, target: float, least: int) -> DataFrame:
    """For each predicted class the threshold that accepts most at the target accuracy, with ``least`` accepted."""
    c = curve(d, "confidence", F.col("truth") == F.col("predicted"), "predicted")
    fits = c.where((F.col("k_above") >= target * F.col("n_above")) & (F.col("n_above") >= least))
    return fits.groupBy("predicted").agg(F.max_by(F.struct("confidence", "n_above"), F.struct("n_above", (-F.col("confidence")).alias("c"))).alias("x")).select("predicted", F.round("x.confidence", 6).alias("threshold"), F.col("x.n_above").alias("accepted"))


def risk_coverage(d: DataFrame, coverages: list[float]) -> DataFrame:
    """Accuracy of the most confident ``ceil(n * c)`` rows.

    A running count by distinct confidence finds the score at which each coverage ends; rows that tie there
    are taken by id, found by one filter on that score.
    """
    n = d.count()
    hit = F.col("truth") == F.col("predicted")
    levels = d.sparkSession.sql("VALUES " + ", ".join(f"({c}D, {math.ceil(n * c)}L)" for c in coverages)).toDF("coverage", "wanted")
    c = curve(d, "confidence", hit).withColumns({"before": F.col("n_above") - F.col("n"), "hits_before": F.col("k_above") - F.col("k")})
    at = levels.join(c, (F.col("before") < F.col("wanted")) & (F.col("wanted") <= F.col("n_above"))).select("coverage", "wanted", "confidence", "before", "hits_before")
    tied = d.join(F.broadcast(at), "confidence").withColumn("r", F.row_number().over(Window.partitionBy("coverage").orderBy("row_id")))
    own = tied.where(F.col("r") <= F.col("wanted") - F.col("before")).groupBy("coverage", "wanted", "hits_before").agg(F.sum(hit.cast("int")).alias("k"))
    return own.select("coverage", F.col("wanted").alias("accepted"), (F.col("wanted") - F.col("hits_before") - F.col("k")).alias("errors"), F.round((F.col("hits_before") + F.col("k")) / F.col("wanted"), 6).alias("accuracy"))


def conformal_sets(p: DataFrame, calibration_rows: Column, alpha: float) -> DataFrame:
    """Prediction sets of the rows outside the calibration half, by adaptive cumulative probability.

    The score of a calibration row is the probability summed down to its true label. The threshold is the
    score at place ``ceil((n + 1) * (1 - alpha))``, found from counts by distinct score.
    """
    own = Window.partitionBy("row_id").orderBy(F.desc("p"), "label").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = p.withColumn("cum", F.round(F.sum("p").over(own), 9))
    scores = cum.where(calibration_rows & (F.col("label") == F.col("truth"))).groupBy("cum").agg(F.count(F.lit(1)).alias("n"))
    upto = prefix.running(scores, "cum", ["n"])
    q = upto.where(F.col("n_upto") >= F.least(F.col("n_all"), F.ceil((F.col("n_all") + 1) * (1 - alpha)))).agg(F.min("cum").alias("q"))
    inside = cum.where(~calibration_rows).join(F.broadcast(q)).where(F.round(F.col("cum") - F.col("p"), 9) < F.col("q"))
    return inside.groupBy("row_id", "truth").agg(F.array_join(F.sort_array(F.collect_list("label")), ",").alias("set"), F.max((F.col("label") == F.col("truth")).cast("int")).alias("covered"))


def auroc(scores: DataFrame, score: str, positive: Column) -> DataFrame:
    """Area under the ROC curve with mid-ranks, average precision and the false positive rate at 95 % recall."""
    t = curve(scores, score, positive).withColumns({"pos": F.col("k_all"), "neg": F.col("n_all") - F.col("k_all")})
    above_neg = F.col("n_above") - F.col("k_above")
    return t.agg(
        F.round(F.sum(F.col("k") * (F.col("neg") - above_neg + (F.col("n") - F.col("k")) / 2)) / F.first("pos") / F.first("neg"), 6).alias("auroc"),
        F.round(F.sum(F.col("k") * F.col("k_above") / F.col("n_above")) / F.first("pos"), 6).alias("average_precision"),
        F.round(F.min(F.when(F.col("k_above") >= 0.95 * F.col("pos"), above_neg / F.col("neg"))), 6).alias("fpr95"),
    )


def divergence(a: DataFrame, b: DataFrame, label: str) -> DataFrame:
    """Jensen-Shannon divergence, in bits, of two label distributions."""
    share = lambda d, name: d.groupBy(label).count().select(label, (F.col("count") / F.sum("count").over(Window.partitionBy())).alias(name))
    rows = share(a, "x").join(share(b, "y"), label, "full_outer").na.fill(0.0)
    m = (F.col("x") + F.col("y")) / 2
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / m)).otherwise(0.0)
    return rows.agg(F.round(F.sum(part("x") + part("y")) / 2, 6).alias("js"))


def grid_policy(d: DataFrame, thresholds: list[float], margins: list[float]) -> DataFrame:
    """Accuracy and coverage of every (threshold, margin) in one pass: the grid travels as an array."""
    cells = F.array(*(F.struct(F.lit(t).alias("threshold"), F.lit(m).alias("least_margin")) for t in thresholds for m in margins))
    hit = F.col("truth") == F.col("predicted")
    rows = d.select(F.explode(cells).alias("g"), "confidence", "margin", hit.alias("hit"))
    ok = (F.col("confidence") >= F.col("g.threshold")) & (F.col("margin") >= F.col("g.least_margin"))
    agg = rows.groupBy("g.threshold", "g.least_margin").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("accepted"), F.count_if(ok & F.col("hit")).alias("right"))
    accuracy = F.when(F.col("accepted") > 0, F.col("right") / F.col("accepted")).otherwise(0.0)
    return agg.select("threshold", "least_margin", "accepted", F.round(accuracy, 6).alias("accuracy"), F.round(0.65 * accuracy + 0.35 * F.col("accepted") / F.col("n"), 6).alias("utility"))


def temperatures(p: DataFrame, grid: list[float]) -> DataFrame:
    """Negative log likelihood after scaling probabilities by ``p ** (1 / T)``, for each T."""
    rows = p.select("row_id", "p", (F.col("label") == F.col("truth")).alias("is_truth"), F.explode(F.array(*map(F.lit, grid))).alias("t"))
    scaled = rows.withColumn("s", F.pow("p", 1 / F.col("t"))).groupBy("row_id", "t").agg(F.sum("s").alias("z"), F.sum(F.when(F.col("is_truth"), F.col("s")).otherwise(0.0)).alias("own"))
    return scaled.groupBy("t").agg(F.round(F.avg(-F.ln(F.col("own") / F.col("z"))), 6).alias("nll"))


def blended(models: list[tuple[DataFrame, float]]) -> DataFrame:
    """A weighted soft vote over models that have the same rows and labels."""
    total = sum(w for _, w in models)
    rows = None
    for p, w in models:
        p = p.select("row_id", "label", "truth", (F.col("p") * F.lit(w / total)).alias("p"))
        rows = p if rows is None else rows.unionByName(p)
    return rows.groupBy("row_id", "label", "truth").agg(F.sum("p").alias("p"))


def swapped(d: DataFrame, pairs: DataFrame, other: DataFrame) -> DataFrame:
    """Predictions in which a confused pair's decision is taken from another model, if that favours the second."""
    key = F.array_join(F.sort_array(F.array("predicted", "second")), "|")
    rows = d.withColumn("pair", key).join(F.broadcast(pairs.select("pair", F.lit(True).alias("known"))), "pair", "left").join(other, "row_id")
    take = F.coalesce("known", F.lit(False)) & (F.col("other") == F.col("second"))
    return rows.select("row_id", "truth", F.when(take, F.col("second")).otherwise(F.col("predicted")).alias("predicted"), take.alias("swapped"))


#: Cumulative shares of a Poisson count of mean one, for 0 to 4; the rest counts as 5.
POISSON_CUTS = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015]


def poisson(u: Column) -> Column:
    """A Poisson count of mean one from a uniform number."""
    weight = F.lit(len(POISSON_CUTS))
    for k in range(len(POISSON_CUTS) - 1, -1, -1):
        weight = F.when(u < POISSON_CUTS[k], k).otherwise(weight)
    return weight


def drawn(rows: DataFrame, key: str, replicates: int, seed: int) -> DataFrame:
    """``rows`` by ``replicate`` with ``w``, a Poisson count from a hash of key and replicate.

    The uniform number is a column of its own: written into each step of the count it would be hashed for each.
    """
    spread = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    return spread.withColumn("u", S.uniform(key, "replicate", seed=seed)).withColumn("w", poisson(F.col("u"))).drop("u")


def clustered_bootstrap(rows: DataFrame, replicates: int, seed: int) -> DataFrame:
    """``metric, mean, low, high, better``: how ``other`` differs from ``predicted`` in accuracy and macro F1 (``cluster, truth, predicted, other``).

    A replicate weighs each cluster by a Poisson count from a hash of cluster and replicate. Counts by cluster and label come first, so a
    cluster of any size is one row a label, and replicates are drawn over clusters. A label that is neither
    a truth nor a guess in a replicate is no part of its mean.
    """
    part = lambda label, n=0, ka=0, ga=0, kb=0, gb=0: F.struct(F.col(label).alias("label"), *(F.lit(v).cast("long").alias(k) for k, v in (("n", n), ("ka", ka), ("ga", ga), ("kb", kb), ("gb", gb))))
    right = lambda c: (F.col("truth") == F.col(c)).cast("long")
    of_truth = F.struct(F.col("truth").alias("label"), F.lit(1).cast("long").alias("n"), right("predicted").alias("ka"), F.lit(0).cast("long").alias("ga"), right("other").alias("kb"), F.lit(0).cast("long").alias("gb"))
    parts = rows.select("cluster", F.explode(F.array(of_truth, part("predicted", ga=1), part("other", gb=1))).alias("x")).select("cluster", "x.*")
    names = ("n", "ka", "ga", "kb", "gb")
    counts = parts.groupBy("cluster", "label").agg(*(F.sum(c).alias(c) for c in names))
    weighed = drawn(counts, "cluster", replicates, seed)
    sums = weighed.groupBy("replicate", "label").agg(*(F.sum(F.col("w") * F.col(c)).alias(c) for c in names))
    f1 = lambda k, g: F.avg(2 * F.col(k) / F.nullif(F.col("n") + F.col(g), F.lit(0)))
    deltas = sums.groupBy("replicate").agg((F.sum(F.col("kb") - F.col("ka")) / F.sum("n")).alias("accuracy"), (f1("kb", "gb") - f1("ka", "ga")).alias("macro_f1"))
    long = deltas.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("accuracy", "macro_f1")))).alias("x")).select("x.*")
    return long.groupBy("metric").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.percentile("v", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("v", F.lit(0.975)), 6).alias("high"), F.round(F.avg((F.col("v") > 0).cast("int")), 6).alias("better"))


def front(candidates: DataFrame, metrics: list[str], baseline: Column) -> DataFrame:
    """``candidates`` with ``better``, no worse than the baseline in all metrics and better in one, and ``front``, dominated by none.

    Candidates are a short list of finished runs: all of them travel as one array.
    """
    every = candidates.agg(F.collect_list(F.struct(*metrics)).alias("every"), F.max(F.when(baseline, F.struct(*metrics))).alias("base"))

    def beats(a, b) -> Column:
        no_worse, more = F.lit(True), F.lit(False)
        for m in metrics:
            no_worse, more = no_worse & (a[m] >= b[m]), more | (a[m] > b[m])
        return no_worse & more

    own = F.struct(*metrics)
    return candidates.join(F.broadcast(every)).select(*candidates.columns, beats(own, F.col("base")).alias("better"), (~F.exists("every", lambda o: beats(o, own))).alias("front"))

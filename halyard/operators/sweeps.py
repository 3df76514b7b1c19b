"""Sweeps of trained heads over folds: measures by fold, the winner, its temperature, specialists and the review policy.

Scores are rows ``id, branch, fold, truth, p`` of the development part: ``p`` has a probability for each label
in order, ``truth`` is the place of the label, and no branch has seen the row's fold.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.operators import stacking as K
from halyard.session import stored


def head_grid(n_labels: int, penalties: Sequence[float], max_iter: int = 20) -> list[K.Branch]:
    """Logistic heads for each penalty, with labels that weigh alike and with rows that do."""
    return [K.Branch(f"penalty={c:g} weights={'labels' if w else 'rows'}", K.logistic(n_labels, c, max_iter, w)) for c in penalties for w in (True, False)]


def fold_scores(rows: DataFrame, branches: Sequence[K.Branch], k: int, group: str = "id") -> DataFrame:
    """Out-of-fold scores of every branch on ``id, label, features``, with the fold and the truth of the row."""
    folded = stored(K.fold_of(rows, group, k), "folds")
    return K.out_of_fold(folded, branches, k).join(folded.select("id", "fold", F.col("label").alias("truth")), "id")


def first(p: str = "p") -> Column:
    """The place of the highest probability, the first of equal ones."""
    return F.array_position(p, F.array_max(p)).cast("int") - 1


def measured(scores: DataFrame) -> DataFrame:
    """``branch, fold, n, top1, top3, mrr, macro_f1``; the mean of F1 is over labels that the fold has."""
    own = F.element_at("p", F.col("truth") + 1)
    ahead = F.size(F.filter("p", lambda x, i: (x > F.col("own")) | ((x == F.col("own")) & (i < F.col("truth")))))
    ranked = scores.withColumn("own", own).select("branch", "fold", "truth", first().alias("predicted"), (ahead + 1).alias("rank"))
    ranks = ranked.groupBy("branch", "fold").agg(F.count(F.lit(1)).alias("n"), *(F.avg((F.col("rank") <= k).cast("int")).alias(f"top{k}") for k in (1, 3)), F.avg(1 / F.col("rank")).alias("mrr"))
    part = lambda label, n, hit, guess: F.struct(F.col(label).alias("label"), F.lit(n).alias("n"), hit.cast("int").alias("hit"), F.lit(guess).alias("guess"))
    parts = ranked.select("branch", "fold", F.explode(F.array(part("truth", 1, F.col("truth") == F.col("predicted"), 0), part("predicted", 0, F.lit(0), 1))).alias("x")).select("branch", "fold", "x.*")
    by_label = parts.groupBy("branch", "fold", "label").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit"), F.sum("guess").alias("guess")).where("n > 0")
    f1 = by_label.groupBy("branch", "fold").agg(F.avg(2 * F.col("hit") / (F.col("n") + F.col("guess"))).alias("macro_f1"))
    return ranks.join(f1, ["branch", "fold"])


def compared(measures: DataFrame) -> DataFrame:
    """``branch, folds, n`` with means over folds and ``place``: by top 1, then macro F1, top 3, reciprocal rank and name."""
    names = ("top1", "macro_f1", "top3", "mrr")
    means = measures.groupBy("branch").agg(F.count(F.lit(1)).alias("folds"), F.sum("n").alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in names), F.round(F.stddev_pop("top1"), 6).alias("top1_std"))
    return means.withColumn("place", F.row_number().over(Window.orderBy(*map(F.desc, names), "branch")))


def tempered(p: Column, t: Column | float) -> Column:
    """Probabilities to the power 1 / t, adding up to one."""
    powers = F.transform(p, lambda x: F.exp((F.ln(F.greatest(x, F.lit(1e-12))) - F.ln(F.array_max(p))) / t))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda s, y: s + y))


def temperature(scores: DataFrame, low: float = 0.1, high: float = 10.0, points: int = 9, rounds: int = 5) -> tuple[float, float | None]:
    """The temperature of least negative log likelihood, and that likelihood; (1, None) without rows.

    The likelihood has one minimum, so each round is one aggregate at ``points`` temperatures and goes on
    between the neighbours of the best.
    """
    logs = scores.select("truth", F.transform("p", lambda x: F.ln(F.greatest(x, F.lit(1e-12)))).alias("x"))
    top = F.array_max("x")
    a, b, found = math.log(low), math.log(high), (1.0, None)
    for _ in range(rounds):
        grid = [math.exp(a + (b - a) * i / (points - 1)) for i in range(points)]
        loss = lambda t: F.ln(F.aggregate("x", F.lit(0.0), lambda s, x: s + F.exp((x - top) / t))) - (F.element_at("x", F.col("truth") + 1) - top) / t
        row = logs.agg(*(F.avg(loss(t)).alias(f"t{i}") for i, t in enumerate(grid))).first()
        if row[0] is None:
            return found
        best = min(range(points), key=lambda i: row[i])
        found = (grid[best], row[best])
        a, b = math.log(grid[max(0, best - 1)]), math.log(grid[min(points - 1, best + 1)])
    return found


def specialised(base: DataFrame, other: DataFrame, least: int = 3, margin: float = 0.0) -> DataFrame:
    """``base`` with the two best probabilities swapped where a specialist prefers the second by over ``margin``, and ``swapped``.

    Only for pairs of labels that a swap corrects ``least`` times and more often than it harms, by the rows of the
    other folds: no row has a say in its own swap.
    """
    order = F.sort_array(F.transform("p", lambda x, i: F.struct((-x).alias("np"), i.alias("i"))))
    two = base.withColumn("best", F.slice(order, 1, 2)).withColumns({"a": F.col("best")[0]["i"], "b": F.get("best", F.lit(1))["i"]}).drop("best")
    rows = two.join(other.select("id", F.col("p").alias("q")), "id").withColumn("prefers", F.coalesce(F.get("q", F.col("b")) - F.get("q", F.col("a")) > margin, F.lit(False)))
    rows = rows.withColumns({"low": F.least("a", "b"), "high": F.greatest("a", "b")})
    counts = rows.where("prefers").groupBy("low", "high", "fold").agg(F.count_if(F.col("truth") == F.col("b")).alias("right"), F.count_if(F.col("truth") == F.col("a")).alias("wrong"))
    whole = counts.groupBy(F.col("low").alias("l"), F.col("high").alias("h")).agg(F.sum("right").alias("all_right"), F.sum("wrong").alias("all_wrong"))
    own = counts.select(F.col("low").alias("l"), F.col("high").alias("h"), F.col("fold").alias("f"), "right", "wrong")
    found = rows.join(whole, (F.col("low") == F.col("l")) & (F.col("high") == F.col("h")), "left").drop("l", "h")
    found = found.join(own, (F.col("low") == F.col("l")) & (F.col("high") == F.col("h")) & (F.col("fold") == F.col("f")), "left").drop("l", "h", "f")
    right, wrong = (F.coalesce(F.col(f"all_{c}") - F.coalesce(F.col(c), F.lit(0)), F.lit(0)) for c in ("right", "wrong"))
    take = F.col("prefers") & (right >= least) & (right > wrong)
    swap = F.transform("p", lambda x, i: F.when(i == F.col("a"), F.get("p", F.col("b"))).when(i == F.col("b"), F.get("p", F.col("a"))).otherwise(x))
    return found.withColumn("swapped", take).withColumn("p", F.when(F.col("swapped"), swap).otherwise(F.col("p"))).select(*base.columns, "swapped")


#: Steps of a hundredth: thresholds of the confidence from 0.10 to 0.90, of the margin from 0.00 to 0.30.
THRESHOLDS = [round(0.10 + 0.01 * i, 2) for i in range(81)]
MARGINS = [round(0.01 * i, 2) for i in range(31)]


def review_policy(scores: DataFrame, thresholds: Sequence[float] = THRESHOLDS, margins: Sequence[float] = MARGINS) -> DataFrame:
    """One row: the threshold and margin whose acceptance best tells right from wrong by F1, ties by accuracy, coverage, lower limits.

    Rows are counted by the limits they pass, so the grid is summed up over a table of its own size and
    never meets the rows. No row without scores.
    """
    order = F.sort_array("p", asc=False)
    passed = lambda c, limits: F.size(F.filter(F.array(*map(F.lit, limits)), lambda t: t <= c))
    rows = scores.select((first() == F.col("truth")).cast("long").alias("hit"), order[0].alias("confidence"), (order[0] - F.coalesce(F.get(order, F.lit(1)), F.lit(0.0))).alias("margin"))
    counts = rows.select("hit", passed(F.col("confidence"), thresholds).alias("i"), passed(F.col("margin"), margins).alias("j")).groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("k"))
    spark = scores.sparkSession
    grid = spark.range(len(thresholds) + 1).select(F.col("id").cast("int").alias("i")).crossJoin(spark.range(len(margins) + 1).select(F.col("id").cast("int").alias("j")))
    dense = grid.join(counts, ["i", "j"], "left").na.fill(0, ["n", "k"])
    along = lambda key, by: Window.partitionBy(key).orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for key, by in (("i", "j"), ("j", "i")):
        dense = dense.withColumns({"n": F.sum("n").over(along(key, by)), "k": F.sum("k").over(along(key, by))})
    total = counts.agg(F.sum("n").alias("rows"), F.sum("k").alias("right"))
    cells = dense.where("i > 0 AND j > 0").join(F.broadcast(total)).where("rows > 0")
    f1 = F.coalesce(2 * F.col("k") / F.nullif(F.col("n") + F.col("right"), F.lit(0)), F.lit(0.0))
    accuracy = F.coalesce(F.col("k") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0))
    errors = F.coalesce((F.col("rows") - F.col("n") - F.col("right") + F.col("k")) / F.nullif(F.col("rows") - F.col("n"), F.lit(0)), F.lit(0.0))
    limit = lambda values, i: F.element_at(F.array(*map(F.lit, values)), F.col(i))
    out = cells.select(limit(thresholds, "i").alias("threshold"), limit(margins, "j").alias("margin"), f1.alias("f1"), (F.col("n") / F.col("rows")).alias("coverage"), accuracy.alias("accepted_accuracy"), errors.alias("review_error_rate"), "i", "j")
    return out.orderBy(F.desc("f1"), F.desc("accepted_accuracy"), F.desc("coverage"), "i", "j").limit(1).drop("i", "j")

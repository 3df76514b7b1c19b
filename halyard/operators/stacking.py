"""Stacking of trained branches, models by segment fitted in one pass, and ordered target statistics.

A branch learns from rows and returns a scorer. Out-of-fold scores come from branches that never saw the
row's fold, they are kept as a table, and a meta-model learns from that table alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halyard.functions import scalars as S
from halyard.operators import learning as L
from halyard.session import stored

#: From rows (``id, ..., p``) to rows (``id, p``) with a probability for each label in order.
Scorer = Callable[[DataFrame], DataFrame]


class Branch(NamedTuple):
    name: str
    fit: Callable[[DataFrame], Scorer]


def fold_of(rows: DataFrame, group: str, k: int) -> DataFrame:
    """``rows`` with ``fold``, which the group decides, so that no group is in two folds."""
    return rows.withColumn("fold", S.hash_bucket(group, k))


def logistic(n_labels: int, reg: float = 0.01, max_iter: int = 20, even: bool = True) -> Callable[[DataFrame], Scorer]:
    """A multinomial fit on ``features``, with labels of ``even`` weight or all rows alike; ``label`` is the place of the label."""

    def fit(train: DataFrame) -> Scorer:
        rows = train.select("id", F.col("label").cast("double").alias("label"), array_to_vector("features").alias("features"))
        rows = L.balanced(rows, "label") if even else rows.withColumn("weight", F.lit(1.0))
        model = LogisticRegression(family="multinomial", weightCol="weight", maxIter=max_iter, regParam=reg).fit(rows)
        full = lambda p: F.transform(F.sequence(F.lit(1), F.lit(n_labels)), lambda i: F.coalesce(F.try_element_at(p, i), F.lit(0.0)))
        return lambda test: model.transform(test.select("id", array_to_vector("features").alias("features"))).select("id", full(vector_to_array("probability")).alias("p"))

    return fit


def prototype(n_labels: int, temperature: float = 0.08) -> Callable[[DataFrame], Scorer]:
    """Softmax of the cosine with the mean vector of each label; labels without rows get zero."""

    def fit(train: DataFrame) -> Scorer:
        means = train.select("label", F.posexplode("features").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
        centres = means.groupBy("label").agg(S.unit(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"])).alias("c"))
        known = [(int(r.label), [float(x) for x in r.c]) for r in centres.collect()]
        e = {label: F.exp(S.dot("u", F.array(*map(F.lit, c))) / temperature) for label, c in known}
        scores = F.array(*(e.get(i, F.lit(0.0)) for i in range(n_labels)))
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
        return lambda test: test.select("id", S.unit("features").alias("u")).select("id", scores.alias("e")).select("id", F.transform("e", lambda x: x / total(F.col("e"))).alias("p"))

    return fit


def nearest(n_labels: int, k: int = 9) -> Callable[[DataFrame], Scorer]:
    """Votes of the k nearest rows by inverse distance, from an index of the training rows."""
    from halyard.operators import dense

    def fit(train: DataFrame) -> Scorer:
        index = dense.build(train.select(F.col("id").alias("vec_id"), S.unit("features").alias("v")))
        labels = train.select(F.col("id").alias("doc_id"), "label")

        def score(test: DataFrame) -> DataFrame:
            found = dense.top_k(index, test.select(F.col("id").alias("vec_id"), S.unit("features").alias("v")), k).join(labels, "doc_id")
            votes = [F.sum(F.when(F.col("label") == i, 1 / F.greatest(1 - F.col("score"), F.lit(1e-6))).otherwise(0.0)) for i in range(n_labels)]
            summed = found.groupBy("query_id").agg(F.array(*votes).alias("w"), F.sum(1 / F.greatest(1 - F.col("score"), F.lit(1e-6))).alias("total"))
            return summed.select(F.col("query_id").alias("id"), F.transform("w", lambda x: x / F.col("total")).alias("p"))

        return score

    return fit


def at_once(spark: SparkSession, jobs: Sequence[Callable[[], DataFrame]], parallelism: int = 4) -> list[DataFrame]:
    """Results of jobs that are started together, in the threads of the driver."""
    with ThreadPoolExecutor(parallelism) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]


def out_of_fold(rows: DataFrame, branches: Sequence[Branch], k: int) -> DataFrame:
    """``id, branch, p``: scores of each row by branches fitted on the other folds, as a stored table."""

    def job(branch: Branch, fold: int) -> Callable[[], DataFrame]:
        return lambda: stored(branch.fit(rows.where(F.col("fold") != fold))(rows.where(F.col("fold") == fold)).select("id", F.lit(branch.name).alias("branch"), "p"), "oof")

    parts = at_once(rows.sparkSession, [job(b, f) for f in range(k) for b in branches])
    return reduce(DataFrame.unionByName, parts)


def meta_features(scores: DataFrame, branches: Sequence[Branch]) -> DataFrame:
    """``id, features``: the probabilities of all branches side by side, in the order of ``branches``."""
    order = {b.name: i for i, b in enumerate(branches)}
    place = F.element_at(F.create_map(*(F.lit(x) for pair in order.items() for x in pair)), F.col("branch"))
    rows = scores.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(place.alias("i"), "p"))).alias("found"))
    whole = F.when(F.size("found") == len(branches), F.flatten(F.transform("found", lambda x: x["p"])))
    return rows.select("id", F.coalesce(whole, F.raise_error(F.concat(F.lit("row without the scores of every branch: "), F.col("id").cast("string"))).cast("array<double>")).alias("features"))


def stacked(train: DataFrame, test: DataFrame, branches: Sequence[Branch], n_labels: int, group: str = "id", k: int = 4) -> DataFrame:
    """``id, branch, predicted``: labels of the test rows by each branch and, as ``stack``, by the meta-model.

    Rows have ``id, label, features`` and the group column. The meta-model learns from out-of-fold scores only; the
    branches that score the test rows learn from all training rows.
    """
    folded = stored(fold_of(train, group, k), "train")
    scores = out_of_fold(folded, branches, k)
    missing = folded.select("id").distinct().join(scores.select("id").distinct(), "id", "left_anti").limit(1).collect()
    if missing:
        raise RuntimeError("out-of-fold scores do not cover every training row")
    meta = logistic(n_labels, 0.05, 50)(meta_features(scores, branches).join(folded.select("id", "label"), "id"))
    tested = reduce(DataFrame.unionByName, at_once(test.sparkSession, [lambda b=b: stored(b.fit(folded)(test).select("id", F.lit(b.name).alias("branch"), "p"), "scores") for b in branches]))
    final = meta(meta_features(tested, branches)).select("id", F.lit("stack").alias("branch"), "p")
    best = F.array_position("p", F.array_max("p")).cast("int") - 1
    return tested.unionByName(final).select("id", "branch", best.alias("predicted"))


def consistent_truth(models: Sequence[DataFrame]) -> DataFrame:
    """``id, truth`` of the rows that all models have; two truths of one id raise an error."""
    rows = reduce(DataFrame.unionByName, [m.select("id", "truth").distinct().withColumn("model", F.lit(i)) for i, m in enumerate(models)])
    found = rows.groupBy("id").agg(F.min("truth").alias("truth"), F.max("truth").alias("other"), F.count_distinct("model").alias("n"))
    same = F.when(F.col("truth").eqNullSafe(F.col("other")), F.col("truth")).otherwise(F.raise_error(F.concat(F.lit("models differ on the truth of "), F.col("id").cast("string"))).cast("string"))
    return found.withColumn("truth", same).where(F.col("n") == len(models)).select("id", "truth")


def stacked_labels(models: Sequence[DataFrame], k: int = 4) -> DataFrame:
    """``id, truth, stacked``: a meta-model on the labels that models gave (``id, truth, predicted``), each fold by the others.

    Rows with the same labels are the same to the model, so a fold's fit is over counted cells: one aggregate of
    the rows, then a fit over as many cells as there are combinations of labels.
    """
    truth = consistent_truth(models)
    wide = reduce(lambda a, b: a.join(b, "id"), [m.select("id", F.col("predicted").alias(f"m{i}")).dropDuplicates(["id"]) for i, m in enumerate(models)], truth)
    rows = stored(fold_of(wide, "id", k), "labels")
    names = [f"m{i}" for i in range(len(models))]
    cells = rows.groupBy(*names, "truth", "fold").agg(F.count(F.lit(1)).alias("n")).toPandas()
    labels = sorted(set(cells["truth"]))
    values = [sorted(set(cells[c])) for c in names]
    combos = cells[names].drop_duplicates()
    hot = lambda part: np.concatenate([(part[c].to_numpy()[:, None] == np.array(v, dtype=object)[None, :]) for c, v in zip(names, values, strict=True)], axis=1).astype(float)
    parts = []
    for fold in range(k):
        rest = cells[cells["fold"] != fold].groupby([*names, "truth"], as_index=False)["n"].sum()
        if rest.empty:
            continue
        per_label = rest.groupby("truth")["n"].transform("sum")
        weight = rest["n"] * (rest["n"].sum() / (rest["truth"].nunique() * per_label))
        frame = pd.DataFrame({"features": list(hot(rest)), "label": [float(labels.index(t)) for t in rest["truth"]], "weight": weight})
        spark = rows.sparkSession
        train = spark.createDataFrame(frame.assign(features=[list(map(float, x)) for x in frame["features"]])).select("label", "weight", array_to_vector("features").alias("features"))
        model = LogisticRegression(family="multinomial", weightCol="weight", maxIter=50, regParam=0.001).fit(train)
        scores = hot(combos) @ model.coefficientMatrix.toArray().T + model.interceptVector.toArray()
        best = [labels[i] for i in scores.argmax(axis=1)]
        parts.append(combos.assign(fold=fold, stacked=best))
    table = rows.sparkSession.createDataFrame(pd.concat(parts)) if parts else None
    if table is None:
        return rows.select("id", "truth", F.col("truth").alias("stacked")).limit(0)
    return rows.join(table.withColumn("fold", F.col("fold").cast("int")), [*names, "fold"], "left").select("id", "truth", F.coalesce("stacked", names[0]).alias("stacked"))


MOMENTS = pa.schema([("segment", pa.string()), ("n", pa.float64()), ("xx", pa.list_(pa.float64())), ("xy", pa.list_(pa.float64()))])


def ridge_by_segment(rows: DataFrame, n_features: int, n_labels: int, alpha: float = 1.0, held: int = 256) -> DataFrame:
    """``segment, coefficients``: a ridge classifier for each segment, all fitted in one pass over ``segment, label, features``.

    A task adds up the normal equations of the segments it meets, rows of any number in a matrix of fixed size;
    what is shuffled is one matrix for each task and segment, so a segment of any size is spread over all tasks. Targets are 1 for the row's
    label and -1 for the others, and labels of a segment weigh alike. Coefficients are for the features and a last
    constant one, label by label.
    """
    d = n_features + 1

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], list[np.ndarray]] = {}

        def flushed() -> pa.RecordBatch:
            kept = [(f"{label}\x00{s}", n, xx.ravel(), x) for (s, label), (n, xx, x) in sums.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*kept, strict=True), MOMENTS, strict=True)], schema=MOMENTS)

        for batch in batches:
            x = np.array(batch.column("features").to_pylist(), dtype=float).reshape(batch.num_rows, n_features)
            x = np.hstack([x, np.ones((len(x), 1))])
            keys = list(zip(batch.column("segment").to_pylist(), batch.column("label").to_pylist(), strict=True))
            for key in dict.fromkeys(keys):
                part = x[[k == key for k in keys]]
                if key not in sums and len(sums) >= held:
                    yield flushed()
                    sums.clear()
                n, xx, s = sums.setdefault(key, [0.0, np.zeros((d, d)), np.zeros(d)])
                sums[key] = [n + len(part), xx + part.T @ part, s + part.sum(axis=0)]
        if sums:
            yield flushed()

    def solved(table: pa.Table) -> pa.Table:
        labels = [int(k.partition("\x00")[0]) for k in table.column("segment").to_pylist()]
        n, xx, x = table.column("n").to_numpy(), np.array(table.column("xx").to_pylist()), np.array(table.column("xy").to_pylist())
        counts = np.bincount(labels, weights=n, minlength=n_labels)
        share = counts.sum() / (np.count_nonzero(counts) * np.maximum(counts, 1))
        left, right = np.zeros((d, d)), np.full((d, n_labels), 0.0)
        for i, label in enumerate(labels):
            left += share[label] * xx[i].reshape(d, d)
            target = -np.ones(n_labels)
            target[label] = 1
            right += share[label] * np.outer(x[i], target)
        penalty = alpha * np.eye(d)
        penalty[-1, -1] = 0
        w = np.linalg.lstsq(left + penalty, right, rcond=None)[0]
        w[-1, counts == 0] = -np.inf
        return pa.table({"segment": [table.column("own")[0].as_py()], "coefficients": [w.T.ravel()]})

    rows = rows.where("segment IS NOT NULL AND label IS NOT NULL AND features IS NOT NULL").select(F.col("segment").cast("string").alias("segment"), F.col("label").cast("int").alias("label"), F.col("features").cast("array<double>").alias("features"))
    parts = rows.mapInArrow(moments, "segment string, n double, xx array<double>, xy array<double>").withColumn("own", F.expr("substring(segment, instr(segment, char(0)) + 1)"))
    return parts.groupBy("own").applyInArrow(solved, "segment string, coefficients array<double>")


def by_segment(rows: DataFrame, models: DataFrame, n_features: int, n_labels: int) -> DataFrame:
    """``rows`` with ``predicted``, the label of highest score by the row's segment, null where the segment has no model."""
    d = n_features + 1
    joined = rows.withColumn("segment", F.col("segment").cast("string")).join(models, "segment", "left")
    x = F.concat(F.col("features").cast("array<double>"), F.array(F.lit(1.0)))
    scores = F.transform(F.sequence(F.lit(0), F.lit(n_labels - 1)), lambda i: S.dot(x, F.slice("coefficients", i * d + 1, d)))
    best = F.array_position(F.col("scores"), F.array_max("scores")).cast("int") - 1
    return joined.withColumn("scores", F.when(F.col("coefficients").isNotNull(), scores)).withColumn("predicted", best).drop("scores", "coefficients")


def target_statistics(rows: DataFrame, columns: Sequence[str], labels: Sequence[str], buckets: int = 64, weight: float = 1.0) -> DataFrame:
    """``rows`` with ``<column>_<label>``: the share of the label among earlier rows of the same value, in an order by hash.

    A row is never part of its own statistics: the order is that of SHA-256 of ``id``, and only training rows (``label`` not
    null) count; rows without label come last and see all. Counts start at ``weight`` rows with even shares. A value that a third of
    all rows hold is no single window: counts of hash buckets are summed first, and windows run inside a bucket.
    """
    rows = rows.withColumn("_h", S.fingerprint("id", 16)).withColumn("_b", F.when(F.col("label").isNull(), buckets).otherwise(F.pmod(F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"), F.lit(buckets))))
    out = rows
    for c in columns:
        known = rows.where("label IS NOT NULL").groupBy(c, "_b").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("label") == v).alias(f"n_{i}") for i, v in enumerate(labels)))
        spread = known.withColumn("_later", F.explode(F.sequence(F.col("_b") + 1, F.lit(buckets))))
        before = spread.groupBy(F.col(c).alias("_c"), F.col("_later").alias("_b")).agg(F.sum("n").alias("_n"), *(F.sum(f"n_{i}").alias(f"_n_{i}") for i in range(len(labels))))
        inside = Window.partitionBy(c, "_b").orderBy("_h", "id").rowsBetween(Window.unboundedPreceding, -1)
        zero = F.lit(0).cast("long")
        own = F.col("label").isNotNull()
        joined = out.join(before.withColumnRenamed("_b", "_bb"), F.col(c).eqNullSafe(F.col("_c")) & (F.col("_b") == F.col("_bb")), "left")
        n = F.coalesce("_n", zero) + F.when(own, F.count(F.lit(1)).over(inside)).otherwise(0)
        more = {f"{c}_{v}": (F.coalesce(f"_n_{i}", zero) + F.when(own, F.coalesce(F.count_if(F.col("label") == v).over(inside), zero)).otherwise(0) + weight / len(labels)) / (n + weight) for i, v in enumerate(labels)}
        out = joined.withColumns(more).drop("_c", "_bb", "_n", *(f"_n_{i}" for i in range(len(labels))))
    return out.drop("_h", "_b")


def boosted(rows: DataFrame, columns: Sequence[str], labels: Sequence[str], trees: int = 10, depth: int = 3) -> DataFrame:
    """``id, predicted`` of the rows without label: boosted trees, one label against the rest, on ordered target statistics."""
    features = [f"{c}_{v}" for c in columns for v in labels]
    place = F.array_position(F.array(*map(F.lit, labels)), F.col("label")) - 1
    ready = stored(VectorAssembler(inputCols=features, outputCol="features").transform(target_statistics(rows, columns, labels)).select("id", place.cast("double").alias("label"), "features"), "statistics")
    model = OneVsRest(classifier=GBTClassifier(maxIter=trees, maxDepth=depth, seed=L.SEED), parallelism=len(labels)).fit(ready.where("label IS NOT NULL"))
    names = F.array(*map(F.lit, labels))
    return model.transform(ready.where("label IS NULL").drop("label")).select("id", F.element_at(names, F.col("prediction").cast("int") + 1).alias("predicted"))

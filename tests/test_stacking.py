"""Stacks, models by segment and target statistics against separate fits and brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.operators import stacking as K


def clusters(spark, n=240, dims=4, labels=3, seed=2):
    rng = np.random.default_rng(seed)
    label = rng.integers(0, labels, n)
    x = rng.normal(size=(labels, dims))[label] * 2 + rng.normal(size=(n, dims))
    return [(i, f"g{i // 2}", int(label[i]), [float(v) for v in x[i]]) for i in range(n)]


def test_out_of_fold_scores_never_see_their_rows(spark):
    rows = K.fold_of(spark.createDataFrame(clusters(spark), "id long, grp string, label int, features array<double>"), "grp", 3).cache()
    folds = {r.id: (r.fold, r.grp) for r in rows.collect()}
    assert all(folds[i][0] == folds[i + 1][0] for i in range(0, 240, 2))
    seen = []

    def fit(train):
        known = {r.id for r in train.select("id").collect()}

        def score(test):
            seen.append((known, {r.id for r in test.select("id").collect()}))
            return test.select("id", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("p"))

        return score

    got = K.out_of_fold(rows, [K.Branch("one", fit), K.Branch("two", fit)], 3)
    assert got.count() == 480 and len(seen) == 6
    assert all(not known & scored and {folds[i][1] for i in known}.isdisjoint({folds[i][1] for i in scored}) for known, scored in seen)
    with pytest.raises(Exception, match="every branch"):
        K.meta_features(got.where("NOT (branch = 'two' AND id = 7)"), [K.Branch("one", fit), K.Branch("two", fit)]).collect()


def test_stack_is_as_good_as_its_branches(spark):
    data = clusters(spark)
    rows = spark.createDataFrame(data, "id long, grp string, label int, features array<double>")
    branches = [K.Branch("prototype", K.prototype(3)), K.Branch("logistic", K.logistic(3))]
    got = K.stacked(rows.where("id % 4 <> 1"), rows.where("id % 4 = 1"), branches, 3, "grp", 2)
    truth = {i: label for i, _, label, _ in data}
    accuracy = {b: np.mean([truth[r.id] == r.predicted for r in got.where(F.col("branch") == b).collect()]) for b in ("prototype", "logistic", "stack")}
    assert accuracy["stack"] >= max(accuracy["prototype"], accuracy["logistic"]) - 0.05 and accuracy["stack"] > 0.7


def test_label_stack_and_differing_truths(spark):
    rows = [(i, "ab"[i % 2], "ab"[i % 2] if i % 5 else "a", "ab"[i % 2] if i % 3 else "b") for i in range(300)]
    one = spark.createDataFrame([r[:3] for r in rows], "id long, truth string, predicted string")
    two = spark.createDataFrame([(*r[:2], r[3]) for r in rows if r[0] != 4], "id long, truth string, predicted string")
    got = K.stacked_labels([one, two]).collect()
    assert len(got) == 299 and sum(r.truth == r.stacked for r in got) >= 240
    other = two.withColumn("truth", F.when(F.col("id") == 9, F.lit("c")).otherwise(F.col("truth")))
    with pytest.raises(Exception, match="differ on the truth of 9"):
        K.consistent_truth([one, other]).collect()


def test_segments_in_one_pass_equal_separate_fits(spark):
    rng = np.random.default_rng(1)
    rows = []
    for segment, n in (("hot", 500), ("a", 40), ("b", 9), ("one", 3)):
        x = rng.normal(size=(n, 3))
        label = (x @ rng.normal(size=(3, 3))).argmax(axis=1) if segment != "one" else np.zeros(n, int)
        rows += [(segment, int(label[i]), [float(v) for v in x[i]]) for i in range(n)]
    frame = spark.createDataFrame([*rows, (None, 1, [1.0] * 3), ("a", None, [1.0] * 3), ("a", 1, None)], "segment string, label int, features array<double>").repartition(5)
    for held in (256, 1):
        got = {r.segment: np.array(r.coefficients).reshape(3, 4) for r in K.ridge_by_segment(frame, 3, 3, 0.5, held).collect()}
        assert got.keys() == {"hot", "a", "b", "one"}
        for segment, w in got.items():
            x = np.array([[*f, 1.0] for s, _, f in rows if s == segment])
            label = np.array([k for s, k, _ in rows if s == segment])
            share = {k: len(label) / (len(set(label)) * (label == k).sum()) for k in set(label)}
            weight = np.array([share[k] for k in label])[:, None]
            y = np.where(label[:, None] == np.arange(3), 1.0, -1.0)
            want = np.linalg.lstsq(x.T @ (weight * x) + np.diag([0.5] * 3 + [0.0]), x.T @ (weight * y), rcond=None)[0].T
            known = [k for k in range(3) if k in set(label)]
            assert np.allclose(w[known], want[known], atol=1e-8) and all(w[k][-1] == -np.inf for k in range(3) if k not in known)
    models = K.ridge_by_segment(frame, 3, 3)
    found = K.by_segment(spark.createDataFrame([("one", [0.0] * 3), ("unknown", [0.0] * 3)], "segment string, features array<double>"), models, 3, 3)
    assert {r.segment: r.predicted for r in found.collect()} == {"one": 0, "unknown": None}


def test_target_statistics(spark):
    rng = np.random.default_rng(8)
    rows = [(i, ["hot", "b", None, "c"][int(rng.integers(0, 4)) if i % 3 else 0], None if i % 5 == 4 else "xy"[int(rng.integers(0, 2))]) for i in range(300)]
    got = {r.id: r for r in K.target_statistics(spark.createDataFrame(rows, "id long, c string, label string"), ["c"], ["x", "y"], buckets=8, weight=2.0).collect()}
    h = {i: hashlib.sha256(str(i).encode()).hexdigest()[:16] for i, _, _ in rows}
    order = {i: (int(h[i][:4], 16) % 8, h[i], i) for i, _, _ in rows}
    for i, c, label in rows:
        earlier = [k for j, d, k in rows if d == c and k is not None and j != i and (label is None or order[j] < order[i])]
        assert abs(got[i].c_x - (earlier.count("x") + 1) / (len(earlier) + 2)) < 1e-12 and abs(got[i].c_x + got[i].c_y - 1) < 1e-12


def test_boosted_trees_beat_a_forest_on_many_categories(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    rng = np.random.default_rng(3)
    rows = []
    for i in range(1200):
        word = int(rng.integers(0, 150))
        truth = "xyz"[(word * 7) % 3] if rng.random() < 0.9 else "xyz"[int(rng.integers(0, 3))]
        rows.append((i, f"w{word}", f"n{int(rng.integers(0, 40))}", truth, None if i % 4 == 1 else truth))
    frame = spark.createDataFrame(rows, "id long, word string, noise string, truth string, label string")
    found = K.boosted(frame.drop("truth"), ["word", "noise"], ["x", "y", "z"], trees=5).join(frame.select("id", "truth"), "id")
    own = found.where("truth = predicted").count() / found.count()
    stages = [StringIndexer(inputCols=["word", "noise"], outputCols=["a", "b"], stringOrderType="alphabetAsc"), StringIndexer(inputCol="truth", outputCol="y"), VectorAssembler(inputCols=["a", "b"], outputCol="features")]
    ready = Pipeline(stages=stages).fit(frame).transform(frame)
    forest = RandomForestClassifier(labelCol="y", numTrees=20, maxDepth=6, maxBins=160, seed=7).fit(ready.where("label IS NOT NULL"))
    tested = forest.transform(ready.where("label IS NULL"))
    other = tested.where("prediction = y").count() / tested.count()
    assert own > 0.8 and own > other, (own, other)


def test_hashed_words_are_counted_once(spark):
    """Shares of buckets, nulls for a null text; before, a row's words were gone over once for each bucket."""
    from halyard.plans import trained

    rows = spark.createDataFrame([(1, [0, 2, 2, 1]), (2, []), (3, None)], "id long, w array<long>")
    got = {r.id: r.features for r in trained.shares(rows, 3).collect()}
    assert got == {1: [0.25, 0.25, 0.5], 2: [0.0, 0.0, 0.0], 3: [None, None, None]}

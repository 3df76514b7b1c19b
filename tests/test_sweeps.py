"""Measures, temperature, specialists and the review policy against brute force."""

import numpy as np
import pytest

from halyard.operators import stacking as K
from halyard.operators import sweeps as W

SCHEMA = "id long, branch string, fold int, truth int, p array<double>"


def scored(seed, n=240, labels=3, sharp=2.0):
    rng = np.random.default_rng(seed)
    truth = rng.integers(0, labels, n)
    x = rng.normal(size=(n, labels)) + 1.2 * np.eye(labels)[truth]
    p = np.exp(sharp * x)
    return truth, p / p.sum(axis=1, keepdims=True)


def frame(spark, truth, p, branch="one", folds=3):
    return spark.createDataFrame([(i, branch, i % folds, int(t), [float(v) for v in r]) for i, (t, r) in enumerate(zip(truth, p, strict=True))], SCHEMA)


def test_measures_by_fold(spark):
    truth, p = scored(1)
    p[:10] = 1 / 3
    got = {r.fold: r for r in W.measured(frame(spark, truth, p)).collect()}
    for fold in range(3):
        t, q = truth[fold::3], p[fold::3]
        rank = np.array([1 + sum(v > r[y] or (v == r[y] and j < y) for j, v in enumerate(r)) for y, r in zip(t, q, strict=True)])
        guess = q.argmax(axis=1)
        f1 = np.mean([2 * ((guess == y) & (t == y)).sum() / ((guess == y).sum() + (t == y).sum()) for y in set(t)])
        r = got[fold]
        assert (r.n, r.top1, r.top3) == (80, pytest.approx((rank == 1).mean()), 1.0)
        assert r.mrr == pytest.approx((1 / rank).mean()) and r.macro_f1 == pytest.approx(f1)
    two = frame(spark, truth, p).unionByName(frame(spark, truth, np.eye(3)[truth], "two"))
    assert [r.branch for r in W.compared(W.measured(two)).orderBy("place").collect()] == ["two", "one"]


def test_temperature_is_the_least_loss(spark):
    truth, p = scored(2, sharp=4.0)
    t, nll = W.temperature(frame(spark, truth, p))

    def loss(t):
        q = p ** (1 / t)
        q /= q.sum(axis=1, keepdims=True)
        return -np.log(q[np.arange(len(q)), truth]).mean()

    assert nll == pytest.approx(loss(t)) and nll <= min(loss(x) for x in np.geomspace(0.1, 10, 400)) + 1e-6 and t > 1.5
    again = frame(spark, truth, p).select("truth", W.tempered(W.F.col("p"), t).alias("p"))
    assert W.temperature(again)[0] == pytest.approx(1, abs=0.02)
    assert W.temperature(frame(spark, truth, p).limit(0)) == (1.0, None)


def test_swaps_are_decided_by_other_folds(spark):
    truth, p = scored(3)
    q = 0.5 * p + 0.5 * np.eye(3)[truth]
    _, noise = scored(4)
    for other in (q, noise):
        order = np.argsort(-p, axis=1, kind="stable")[:, :2]
        want = 0
        prefers = np.array([other[i, b] > other[i, a] for i, (a, b) in enumerate(order)])
        got = {r.id: r for r in W.specialised(frame(spark, truth, p), frame(spark, truth, other), 3).collect()}
        for i, (a, b) in enumerate(order):
            rest = [j for j in range(len(p)) if prefers[j] and j % 3 != i % 3 and set(order[j]) == {a, b}]
            right, wrong = sum(truth[j] == order[j, 1] for j in rest), sum(truth[j] == order[j, 0] for j in rest)
            take = bool(prefers[i] and right >= 3 and right > wrong)
            own = p[i].copy()
            if take:
                own[[a, b]] = own[[b, a]]
            want += take
            assert got[i].swapped == take and got[i].p == pytest.approx(list(own))
        assert len(got) == len(p) and (other is noise or want > 5)
    one = spark.createDataFrame([(1, "one", 0, 0, [1.0])], SCHEMA)
    assert not W.specialised(one, one).first().swapped


def test_review_policy_is_the_best_of_the_grid(spark):
    truth, p = scored(5)
    top = np.sort(p, axis=1)[:, ::-1]
    hit, confidence, margin = p.argmax(axis=1) == truth, top[:, 0], top[:, 0] - top[:, 1]
    best = None
    for t in W.THRESHOLDS:
        for m in W.MARGINS:
            ok = (confidence >= t) & (margin >= m)
            key = (2 * (ok & hit).sum() / (ok.sum() + hit.sum()), hit[ok].mean() if ok.any() else 0.0, ok.mean())
            if best is None or key > best[0]:
                best = (key, t, m, (~hit[~ok]).mean() if (~ok).any() else 0.0)
    r = W.review_policy(frame(spark, truth, p)).first()
    assert (r.threshold, r.margin) == best[1:3] and (r.f1, r.accepted_accuracy, r.coverage) == pytest.approx(best[0]) and r.review_error_rate == pytest.approx(best[3])
    assert W.review_policy(frame(spark, truth, p).limit(0)).count() == 0


def test_grid_fits_each_head_on_other_folds(spark):
    rng = np.random.default_rng(6)
    label = rng.integers(0, 3, 150)
    x = 2 * np.eye(3)[label] + rng.normal(size=(150, 3))
    rows = spark.createDataFrame([(i, int(t), [float(v) for v in r]) for i, (t, r) in enumerate(zip(label, x, strict=True))], "id long, label int, features array<double>")
    grid = W.head_grid(3, (0.01, 10.0))
    scores = W.fold_scores(rows, grid, 2)
    assert scores.count() == 600 and scores.groupBy("id", "branch").count().where("count > 1").isEmpty()
    places = W.compared(W.measured(scores)).orderBy("place").collect()
    assert [r.n for r in places] == [150] * 4 and places[0].top1 > 0.7 and len({b.name for b in grid}) == 4
    assert isinstance(grid[0], K.Branch)

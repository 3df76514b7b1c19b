"""Hard negatives against brute force, whatever the blocks."""

import math

import numpy as np
import pyarrow as pa
import pytest

from halyard.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def brute(rows, every=100):
    """``rows``: (vec_id, components, label) that take part, labels as moved."""
    out = []
    for a_id, a, a_label in rows:
        if a_id % every:
            continue
        dot = [(sum(x * y for x, y in zip(a, v)), i, label) for i, v, label in rows if i != a_id]
        positives = sorted((-s, i) for s, i, label in dot if label == a_label)[:5]
        for p, pid in ((-s, i) for s, i in positives):
            fit = sorted((-s, i) for s, i, label in dot if label != a_label and 80 * p <= 100 * s <= 100 * p)[:5]
            out += [(a_id, pid, r, i, p, -s) for r, (s, i) in enumerate(fit, 1)]
    return sorted(out)


def table(n=700, dims=12, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, dims))
    labels = rng.integers(0, 10, n)
    labels[: n // 3] = 3
    v = (centres[labels] + rng.normal(scale=1.5, size=(n, dims))).astype(np.float32)
    v[5:40] = v[5]
    return [(i, [float(x) for x in v[i]], int(labels[i])) for i in range(n)]


def taking_part(rows):
    return [(i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)]


@pytest.mark.parametrize("anchor_bytes", [32 << 20, 400])
def test_equals_brute_force(spark, monkeypatch, anchor_bytes):
    monkeypatch.setattr(negatives, "ANCHOR_BYTES", anchor_bytes)
    rows = table()
    rows[200], rows[201], rows[202] = (200, None, 1), (201, rows[201][1], None), (202, [math.nan] * 12, 1)
    rows[203], rows[204], rows[300] = (203, [math.inf] + [0.0] * 11, 1), (204, [None] * 12, 2), (300, [0.0] * 12, 2)
    rows += [(None, rows[1][1], 1), (701, [0.5] * 3, 2), (702, [], 3), (703, [900.0] * 12, 4)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3)
    got = negatives.hard_negatives(df).collect()
    assert sorted(tuple(r) for r in got) == brute(taking_part(rows))


def test_repeated_rows_and_empty_tables(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.1], 2), (2, [0.9, 0.1], 2)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = negatives.mine(negatives.integers(df), negatives.F.col("vec_id") % 100 == 0).collect()
    # Two anchors of id 0, each with two positives (rows of id 1), each of which has the two rows of id 2.
    assert len(got) == 8 and {r.negative_id for r in got} == {2}
    assert negatives.hard_negatives(df.limit(0)).count() == 0
    assert negatives.hard_negatives(df.where("vec_id > 0")).count() == 0


def test_intervals_hold_and_halve():
    rng = np.random.default_rng(3)
    for size in (4, 300, 1 << 24):
        a, b = rng.integers(-size, size, (7, 9)), rng.integers(-size, size, (11, 9))
        exact = a @ b.T
        p = negatives.Products(a, b)
        widths = []
        while p.left:
            p.tighten()
            low, high = p.intervals()
            assert (low <= exact).all() and (exact <= high).all()
            widths.append((high - low).max())
        assert (p.sums == exact).all() and all(w * 2 <= v for v, w in zip(widths, widths[1:]))
    with pytest.raises(OverflowError):
        negatives.Products(np.full((1, 9), 1 << 40), np.full((1, 9), 1 << 40))


def test_pairs_are_dropped_early(monkeypatch):
    """Few of the pairs live through all planes, and the positives are those of brute force."""
    monkeypatch.setattr(negatives, "ROWS", 64)
    monkeypatch.setattr(negatives, "ANCHORS", 2)
    rows = taking_part(table(2000, 32, 5))
    ids, v, labels = (np.array(x) for x in ([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]))
    seen = []
    found = negatives.Products.found
    monkeypatch.setattr(negatives.Products, "found", lambda self: seen.append(found(self)) or seen[-1])
    batch = pa.record_batch({"vec_id": ids, "label": pa.array(labels, pa.int32()), "v": pa.array(v.tolist(), pa.list_(pa.int64()))})
    some = negatives.Vectors(ids[:5], labels[:5], v[:5])
    kept = negatives.positives_of(some, iter([batch]), 5)
    got = {(int(g) + 2 * n, int(i), int(s)) for n, held in enumerate(kept) for g, i, s in zip(held.group, held.ids, held.score)}
    want = {(a, i, -s) for a in range(5) for s, i in sorted((-int(v[a] @ v[i]), i) for i in range(2000) if i != a and labels[i] == labels[a])[:5]}
    assert got == want
    assert sum(len(x[0]) for x in seen) < 0.35 * (labels[:5, None] == labels).sum()

import math
import random
import zlib
from collections import Counter

import numpy as np

from halyard.llm import ngram as N


def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(150):
        own = [0]
        for _ in range(rng.randint(0, 60)):
            own.append((own[-1] * 7 + 3) % 40 if rng.random() < 0.7 else min(39, int(rng.expovariate(0.15))))
        rows.append((i, " ".join(words[k] for k in own[1:])))
    return [*rows, (900, None), (901, ""), (901, ""), (None, "W1 w2\tw3"), (902, "w1 " * 400)]


def tokens(text):
    return (text or "").encode().lower().split() + [N.END]


def fold(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7


def plain(rows):
    one, two, kept1, kept2, deleted = Counter(), Counter(), Counter(), Counter(), Counter()
    for i, t in rows:
        w = tokens(t)
        pairs = list(zip([N.START, *w], w, strict=False))
        if fold(i) != 2:
            one.update([N.START, *w])
            two.update(pairs)
            if fold(i) != 3:
                kept1.update([N.START, *w])
                kept2.update(pairs)
            else:
                deleted.update(pairs)
    total = sum(one.values()) - one[N.START]
    types = len(one) - (N.START in one)
    cells = Counter()
    bucket = lambda c: min(N.BUCKETS - 1, math.ceil(math.log2(c + 1)))
    for (h, w), n in deleted.items():
        ratio = int(np.rint(-8 * np.log2(kept2[h, w] / kept1[h]))) + 1 if kept2[h, w] else 0
        cells[bucket(kept1[h]), ratio, int(np.rint(8 * np.log2(kept1[w]))) + 1 if kept1[w] else 0] += n
    kept_total = sum(kept1.values()) - kept1[N.START]
    weights = N.weights([(*k, n) for k, n in cells.items()], kept_total, len(kept1) - (N.START in kept1))
    out = []
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((one[x] + 1) / (total + types + 1)) for x in w)
        score = 0.0
        for h, x in zip([N.START, *w], w, strict=False):
            a, b, c = weights[bucket(one[h])]
            score += math.log10(a * two[h, x] / max(1, one[h]) + b * one[x] / total + c / (types + 1))
        out.append((i, fold(i) == 2, len(w), sum(one[x] > 0 for x in w), total, base, score))
    return out


def test_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, score string")
    for batch_bytes in (1 << 20, 2000):
        got = sorted(map(tuple, N.scores(docs, batch_bytes=batch_bytes).collect()), key=str)
        want = sorted(plain(rows), key=str)
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


def test_model_is_a_distribution_and_beats_the_base(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r for r in N.scores(docs).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    w = N.weights([(3, 9, 9, 5), (0, 0, 4, 2)], 100, 10)
    assert np.allclose(w.sum(axis=1), 1) and w[0, 0] == 0


def test_empty(spark):
    assert N.scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_counts_survive_packing():
    counts = np.array([0, 1, 254, 255, 256, 10**12])
    assert (N.unpack_counts(N.pack_counts(counts), 6) == counts).all()


def exact_weights(kept1, kept2, deleted, total, types):
    """Expectation-maximisation on every deleted bigram with its exact estimates, plainly."""
    out = {}
    by_bucket = {}
    for (h, w), n in deleted.items():
        by_bucket.setdefault(min(N.BUCKETS - 1, math.ceil(math.log2(kept1[h] + 1))), []).append((kept2[h, w] / max(1, kept1[h]), kept1[w] / total, 1 / (types + 1), n))
    for b, own in by_bucket.items():
        w = [1 / 3] * 3 if b else [0.0, 0.5, 0.5]
        for _ in range(N.EM_ROUNDS):
            sums = [0.0] * 3
            for *p, n in own:
                z = sum(x * y for x, y in zip(w, p, strict=True))
                for k in range(3):
                    sums[k] += n * w[k] * p[k] / z
            w = [x / sum(sums) for x in sums]
        out[b] = w
    return out


def test_steps_of_counts_lose_little(spark):
    """Weights from exact counts against those of the operator: held-out text gets nearly the same probability."""
    rows = corpus()
    got = {(r.doc_id, r.n_tokens): r.score for r in N.scores(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()}
    one, two, kept1, kept2, deleted = Counter(), Counter(), Counter(), Counter(), Counter()
    for i, t in rows:
        w = [N.START, *tokens(t)]
        if fold(i) != 2:
            one.update(w)
            two.update(zip(w, w[1:], strict=False))
            (kept1 if fold(i) != 3 else Counter()).update(w)
            (kept2 if fold(i) != 3 else deleted).update(zip(w, w[1:], strict=False))
    total, types = sum(one.values()) - one[N.START], len(one) - 1
    fit = exact_weights(kept1, kept2, deleted, sum(kept1.values()) - kept1[N.START], len(kept1) - 1)
    loss, n = 0.0, 0
    for i, t in rows:
        w = [N.START, *tokens(t)]
        if fold(i) == 2:
            score = 0.0
            for h, x in zip(w, w[1:], strict=False):
                a, b, c = fit.get(min(N.BUCKETS - 1, math.ceil(math.log2(one[h] + 1))), (1 / 3, 1 / 3, 1 / 3) if one[h] else (0, 0.5, 0.5))
                score += math.log10(a * two[h, x] / max(1, one[h]) + b * one[x] / total + c / (types + 1))
            loss += score - got[i, len(w) - 1]
            n += len(w) - 1
    assert n > 300 and abs(loss) / n < 0.005

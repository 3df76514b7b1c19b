"""Similarity joins, greedy selection and dense search against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.operators import dense, similarity


def random_sets(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            tokens = set(rng.choice(out)[1])
            for w in rng.sample(words, rng.randint(0, 3)):
                tokens ^= {w}
        else:
            tokens = set(rng.sample(words, rng.randint(1, 20)))
        out.append((i, sorted(tokens)))
    return out + [(n, []), (n + 1, None)]


def jaccard(x, y):
    return len(set(x) & set(y)) / len(set(x) | set(y))


@pytest.mark.parametrize("least", [0.5, 0.8, 1.0])
def test_set_pairs(spark, least):
    left, right = random_sets(150, 1), random_sets(60, 2)
    a, b = (spark.createDataFrame(x, "id long, tokens array<string>") for x in (left, right))
    got = {(r.a, r.b): r.similarity for r in similarity.set_pairs(a, least=least).collect()}
    want = {(i, j): jaccard(x, y) for i, x in left for j, y in left if i < j and x and y and jaccard(x, y) >= least}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and want
    both = {(r.a, r.b) for r in similarity.set_pairs(a, b, least).collect()}
    assert both == {(i, j) for i, x in left for j, y in right if x and y and jaccard(x, y) >= least}
    assert similarity.set_pairs(a.limit(0)).count() == 0


def test_pairs_that_share_a_rare_token_only_do_not_reach_the_whole_sets(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "x", ["rare", *(f"t{i}x{j}" for j in range(9))]) for i in range(200)] + [(200, "x", [f"t0x{j}" for j in range(9)] + ["rare", "o"]), (201, "y", [f"t1x{j}" for j in range(9)] + ["rare"])], "id long, label string, tokens array<string>")
    sent = []
    verified = similarity.F.array_intersect
    counted = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: counted.add(1) or x, "array<string>").asNondeterministic()
    monkeypatch.setattr(similarity.F, "array_intersect", lambda x, y: sent.append(1) or verified(seen(x), y))
    got = [(r.a, r.b) for r in similarity.set_pairs(rows, within="label").collect()]
    assert got == [(0, 200)] and sent and counted.value < 100


def test_sketches_differ_no_more_than_sets():
    rng = np.random.default_rng(3)
    x = [rng.integers(0, 2**63, 300).astype(np.uint64) for _ in range(40)]
    x += [np.r_[a[:280], rng.integers(0, 2**63, 9).astype(np.uint64)] for a in x]
    bits = similarity.sketches(np.repeat(np.arange(80), [len(a) for a in x]), np.concatenate(x), 80).view(np.uint64)
    apart = lambda i, j: int(np.bitwise_count(bits[i] ^ bits[j]).sum())
    assert all(apart(i, j) <= len(set(x[i].tolist()) ^ set(x[j].tolist())) for i in range(80) for j in range(80))
    assert min(apart(i, j) for i in range(40) for j in range(i)) > 300 / 4.5


def greedy(links):
    gone = set()
    for b in sorted({b for _, b in links}):
        if any(a not in gone for a, c in links if c == b):
            gone.add(b)
    return gone


def test_greedy_equals_the_sequential_pass(spark):
    rng = random.Random(5)
    cases = [{(i, i + 1) for i in range(12)}, {(0, i) for i in range(1, 30)}, {tuple(sorted(rng.sample(range(80), 2))) for _ in range(200)}, {(1, 3), (2, 3), (3, 4)}]
    for links in cases:
        rows = spark.createDataFrame([*links, *list(links)[:3]], "a long, b long")
        got = [r.id for r in similarity.greedy_dropped(rows).collect()]
        assert sorted(got) == sorted(greedy(links))
    assert similarity.greedy_dropped(rows.limit(0)).count() == 0


def test_first_reason_keeps_the_first(spark):
    rows = spark.createDataFrame([(1, 5), (2, 50), (3, None)], "id long, x long")
    found = similarity.first_reason(rows, [("small", F.col("x") < 10), ("any", F.col("x") < 100)])
    found = similarity.first_reason(found, [("late", F.lit(True))])
    assert {r.id: r.reason for r in found.collect()} == {1: "small", 2: "any", 3: "late"}


def test_cascade_checks_in_order(spark):
    common = [f"c{i}" for i in range(55)]
    text = lambda i: [*common, *(f"r{i}x{j}" for j in range(25))]
    rows = [(1, "a", 80, text(1)), (2, "a", 80, text(1)), (3, None, 80, text(3)), (4, "zz", 80, text(4)), (5, "a", 3, ["c1", "c2", "c3"]), (6, "a", 80, text(6)), (7, "a", 80, [f"q{j}" for j in range(80)]), (8, "b", 80, [f"d{j}" for j in range(80)]), (9, "b", 80, [*(f"d{j}" for j in range(79)), "e"]), (10, "b", 5, None), (11, "a", 80, [f"d{j}" for j in range(80)])]
    frame = spark.createDataFrame(rows, "id long, label string, n_words int, tokens array<string>")
    real = spark.createDataFrame([(1, text(6)), (2, None)], "id long, tokens array<string>")
    support = spark.createDataFrame([("a", 3), ("b", 1)], "label string, n long")
    got = {r.id: (r.reason, r.tier) for r in similarity.cascade(frame, real, support).collect()}
    assert got == {1: (None, "REAL_ANCHORED"), 2: ("near_duplicate", "REAL_ANCHORED"), 3: ("unknown_label", "SYNTHETIC_ONLY"), 4: ("unknown_label", "SYNTHETIC_ONLY"), 5: ("length", "REAL_ANCHORED"), 6: ("contamination", "REAL_ANCHORED"), 7: (None, "REAL_ANCHORED"), 8: (None, "SINGLE_REAL_ANCHOR"), 9: ("near_duplicate", "SINGLE_REAL_ANCHOR"), 10: (None, "SINGLE_REAL_ANCHOR"), 11: ("label_mismatch", "REAL_ANCHORED")}


def unit(n, dims, seed, centres=8):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dims))
    v = c[rng.integers(0, centres, n)] + 0.3 * rng.normal(size=(n, dims))
    v[10:14] = v[10]
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_top_k_with_pivots(spark, monkeypatch):
    v = unit(600, 8, 3)
    frame = spark.createDataFrame([(i, i % 3, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, label int, v array<double>").repartition(3)
    for query_bytes in (64 << 20, 500):
        monkeypatch.setattr(dense, "QUERY_BYTES", query_bytes)
        got = dense.top_k(dense.build(frame, 16), frame.where("vec_id % 50 = 0"), 5).collect()
        scores = np.round(v @ v.T, 9)
        for q in range(0, 600, 50):
            want = sorted((-scores[q, j], j) for j in range(600) if j != q)[:5]
            assert [(-r.score, r.doc_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want
    assert dense.top_k(dense.build(frame), frame.limit(0), 5).count() == 0
    assert dense.top_k(dense.build(frame.limit(0)), frame.where("vec_id = 0"), 5).count() == 0


def test_cells_are_left_out(monkeypatch):
    """With clusters, few rows are multiplied, and a bound is never below a row's score."""
    v = unit(2000, 8, 4)
    pivots, queries = v[:16], v[:3]
    cell = (v @ pivots.T).argmax(axis=1)
    radii = np.array([dense.angle((v[cell == c] @ pivots[c])).max(initial=0) for c in range(16)])
    bound = np.cos(np.maximum(dense.angle(queries @ pivots.T) - radii, 0)) + 1e-8
    assert all((queries[q] @ v[cell == c].T).max(initial=-1) <= bound[q, c] for q in range(3) for c in range(16))
    best = dense.Nearest(np.arange(3), queries, 5)
    met = 0
    for c in range(16):
        active = np.nonzero(bound[:, c] >= best.floor)[0]
        if len(active):
            met += len(active) * int((cell == c).sum())
            best.offer(active, np.nonzero(cell == c)[0], v[cell == c])
    assert met < 0.7 * 3 * 2000


def test_label_pairs_in_blocks(spark):
    v = unit(90, 5, 6)
    frame = spark.createDataFrame([(i, i % 2, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, label int, v array<double>")
    scores = np.round(v @ v.T, 9)
    want = {(a, b) for a in range(90) for b in range(a + 1, 90) if a % 2 == b % 2 and scores[a, b] >= 0.7}
    for block in (7, 1000):
        got = [(r.a, r.b) for r in dense.label_pairs(frame, 0.7, block).collect()]
        assert sorted(got) == sorted(want)


def test_lexical_scores(spark, monkeypatch):
    """Several groups of queries, batches of few documents and steps of few entries, weights of either sign, copies, no terms."""
    from halyard.operators import lexical

    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    rows = [(d, t, rng.choice([-0.5, 0.25, 1.0, 1.5]), rng.choice([0.5, 1.0, 2.0])) for d in range(120) for t in ["w0"] * (d % 3 > 0) + rng.sample(words[1:], rng.randint(0, 8))]
    postings = spark.createDataFrame(rows, "doc_id long, term string, w double, q double")
    for name, value in (("QUERY_BYTES", 600), ("CELLS", 12), ("ENTRIES", 5)):
        monkeypatch.setattr(lexical, name, value)
    facets = spark.createDataFrame([(d, [None if d % 5 == 0 else f"f{d % 3}"]) for d in range(120)], "doc_id long, facets array<string>")
    groups = spark.createDataFrame([(d, d // 2) for d in range(120)], "doc_id long, own long")
    by_doc = {}
    for d, t, w, q in rows:
        by_doc.setdefault(d, {})[t] = (w, q)
    pairs = {(i, j): round(sum(by_doc[j][t][0] * by_doc[i][t][1] for t in shared), 9) for i in by_doc if i % 10 == 0 for j in by_doc if i != j and (shared := by_doc[i].keys() & by_doc[j].keys())}

    def best(scores, k):
        return {(i, j, s) for i in {i for i, _ in scores} for s, j in [(-s, j) for s, j in sorted((-s, j) for (a, j), s in scores.items() if a == i)[:k]]}

    got = lexical.top_k(lexical.build(postings, 10), 4)
    assert {(r.query_id, r.doc_id, r.score) for r in got.collect()} == best(pairs, 4)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()  # no pair is shuffled
    got = lexical.top_k(lexical.build(postings, 10, groups=groups, facets=facets), 4, {0: 0.5}, 1.0)
    boosted = {(i, j): s + 0.5 * (i % 5 > 0 and j % 5 > 0 and i % 3 == j % 3) for (i, j), s in pairs.items() if i // 2 != j // 2}
    assert {(r.query_id, r.doc_id, r.score) for r in got.collect()} == best({p: s for p, s in boosted.items() if s >= 1.0}, 4)
    ends = {i: [s for (a, _), s in pairs.items() if a == i] for i, _ in pairs}
    want = {(i, j): (s - min(ends[i])) / (max(ends[i]) - min(ends[i])) if max(ends[i]) > min(ends[i]) else 0.0 for (i, j), s in pairs.items()}
    found = {(r.query_id, r.doc_id): r.score for r in lexical.minmax(lexical.build(postings, 10)).collect()}
    assert found.keys() == want.keys() and all(abs(found[p] - want[p]) < 1e-9 for p in want)
    assert lexical.top_k(lexical.build(postings.limit(0), 10), 4).count() == 0


def test_dense_scores_in_tasks(spark, monkeypatch):
    """Two scores mixed, and counts by score, in several groups and batches, against all pairs."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(90, 6))
    v /= np.linalg.norm(v, axis=1)[:, None]
    labels = rng.integers(0, 3, 90)
    rows = spark.createDataFrame([(i, int(labels[i]), v[i].tolist(), v[i, :2].tolist()) for i in range(90)], "vec_id long, label int, v array<double>, x array<double>")
    monkeypatch.setattr(dense, "QUERY_BYTES", 300)
    monkeypatch.setattr(dense, "CELLS", 8)
    want, counts = set(), {}
    for q in range(0, 90, 10):
        others = [d for d in range(90) if d != q]
        scaled = []
        for w in (v, v[:, :2]):
            s = np.round(w[others] @ w[q], 9)
            scaled.append((s - s.min()) / (s.max() - s.min()))
        mixed = np.round(0.7 * scaled[0] + 0.3 * scaled[1], 9)
        want |= {(q, others[i], rank + 1) for rank, i in enumerate(sorted(range(89), key=lambda i: (-mixed[i], others[i]))[:3])}
        for d in others:
            s = round(float(np.round(v[d] @ v[q], 9)), 2)
            n, k = counts.get(s, (0, 0))
            counts[s] = n + 1, k + int(labels[d] == labels[q])
    found = dense.mixed_top_k(rows, 3, (0.7, 0.3), 10)
    assert {(r.query_id, r.doc_id, r.rank) for r in found.collect()} == want
    assert {r.s: (r.n, r.k) for r in dense.score_counts(rows, 10, 2).collect()} == counts
    pairs = dense.label_pairs(rows, 0.2, block=7, strip=3)
    every = {(i, j) for i in range(90) for j in range(i + 1, 90) if labels[i] == labels[j] and round(v[i] @ v[j], 9) >= 0.2}
    assert sorted((r.a, r.b) for r in pairs.collect()) == sorted(every)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()  # no pair is shuffled


def test_search_holds_bounded_scores(spark, monkeypatch):
    class Small(dense.Nearest):
        def offer(self, active, ids, rows):
            if len(active) * len(ids) > 5 * 16:
                raise ValueError("too many scores at once")
            dense.Nearest.offer(self, active, ids, rows)

    v = unit(90, 6, 4)
    rows = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "vec_id long, v array<double>")
    index = dense.build(rows, 4)
    monkeypatch.setattr(dense, "QUERIES", 5, raising=False)
    monkeypatch.setattr(dense, "ROWS", 16)
    monkeypatch.setattr(dense, "Nearest", Small)
    got = {(r.query_id, r["rank"]): r.doc_id for r in dense.top_k(index, rows, 3).collect()}
    scores = np.round(v @ v.T, 9)
    want = {(i, k + 1): j for i in range(90) for k, j in enumerate(sorted((j for j in range(90) if j != i), key=lambda j: (-scores[i, j], j))[:3])}
    assert got == want


def test_limits_from_a_sample_leave_few_rows(spark):
    """Ties and copies among them; before, the first rows that a task met were all sorted, in full precision."""
    v = np.repeat(unit(1500, 8, 7), 2, axis=0)
    rows = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "vec_id long, v array<double>")
    index = dense.build(rows, 4)
    asked = {r.vec_id: r.floor for r in dense.floors(index, rows.where("vec_id % 100 = 0"), 5).collect()}
    scores = np.round(v @ v.T, 9)
    np.fill_diagonal(scores, -np.inf)
    assert all(-np.inf < floor <= np.sort(scores[q])[-5] for q, floor in asked.items()) and len(asked) == 30
    ids = np.array(sorted(asked))
    best = dense.Nearest(ids, v[ids], 5, np.array([asked[i] for i in ids]))
    sorted_at_once = []
    best_keep = best.keep
    best.keep = lambda query, doc, score, met: (sorted_at_once.append(len(query)), best_keep(query, doc, score, met))
    for start in range(0, 3000, 500):
        best.offer(np.arange(30), np.arange(start, start + 500), v[start : start + 500])
    want = [(q, j) for q in range(30) for j in sorted(range(3000), key=lambda j: (-scores[ids[q], j], j))[:5]]
    assert list(zip(best.query.tolist(), best.doc.tolist())) == want and max(sorted_at_once) < 30 * 500 / 20


@pytest.mark.parametrize("known", [1 << 20, 7, 0])
def test_index_of_texts_equals_joins(spark, monkeypatch, known):
    """Known and rare terms, a row a document; before, each document's terms were shuffled one by one, several times."""
    from halyard.operators import lexical
    from halyard.operators import retrieval as R

    rng = random.Random(8)
    words = [f"w{i}" for i in range(50)]
    rows = [(d, " ".join(rng.choices(words, [1 / (i + 1) for i in range(50)], k=rng.randint(0, 30)))) for d in range(80)] + [(80, None), (7, "w1 w49 only"), (81, "once")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(lexical, "KNOWN", known)
    texts = lexical.read(docs, 10)
    tf = R.terms(docs)
    want = {"cosine": R.cosine(R.tfidf(tf, docs.agg(F.count(F.lit(1)).alias("n"))), 10), "bm25": R.bm25(tf, 10)}
    for name, scores in want.items():
        index = getattr(lexical, name)(texts)
        found = {(r.query_id, r.doc_id): r.score for r in lexical.top_k(index, 100).collect()}
        exact = {(r.query_id, r.doc_id): r.score for r in scores.collect()}
        assert found.keys() == exact.keys() and all(abs(found[p] - exact[p]) < 2e-6 for p in exact) and len(exact) > 300
    assert {c for c, kind in texts.rows.dtypes if kind.startswith("array")} == {"facets", "terms", "tf", "df"}  # no weight is stored


def test_copies_are_linked_like_others(spark, monkeypatch, tmp_path):
    """Every pair of documents counts, those of two copies too; before, copies were linked to the first of them only."""
    from halyard.plans import registry

    monkeypatch.setattr(similarity, "COPIES", 2)
    texts = {**{i: "a b c d e f g h i" for i in (1, 4, 6, 9, 12)}, **{i: "i h g f e d c b a j" for i in (2, 3, 5)}, 7: "a b c d e f g h k", 8: "x y", 10: "y x x", 11: None}
    rows = [(i, "fr" if i == 12 else "en", t) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r.a, r.b, r.similarity) for r in registry.QUERIES["jn15_set_similarity"](spark, str(tmp_path)).collect()]
    lang = {i: x for i, x, _ in rows}
    sets = {i: set(t.split()) for i, t in texts.items() if t}
    want = [(i, j, round(jaccard(sets[i], sets[j]), 6)) for i in sorted(sets) for j in sorted(sets) if i < j and lang[i] == lang[j] and jaccard(sets[i], sets[j]) >= 0.8]
    assert sorted(got) == want and len(want) > 25


@pytest.mark.parametrize("least", [0.5, 0.8])
def test_tokens_of_many_rows_meet_in_blocks(spark, monkeypatch, least):
    for name, value in (("BLOCK", 8), ("PAIRS", 16), ("SKETCHES", 4), ("TOKENS_AT_ONCE", 64)):
        monkeypatch.setattr(similarity, name, value)
    left, right = random_sets(120, 3), random_sets(50, 4)
    a, b = (spark.createDataFrame(x, "id long, tokens array<string>").repartition(3) for x in (left, right))
    got = sorted((r.a, r.b) for r in similarity.set_pairs(a, least=least).collect())
    assert got == [(i, j) for i, x in left for j, y in left if i < j and x and y and jaccard(x, y) >= least]
    both = sorted((r.a, r.b) for r in similarity.set_pairs(a, b, least).collect())
    assert both == [(i, j) for i, x in left for j, y in right if x and y and jaccard(x, y) >= least]


def test_large_false_pairs_are_refused_where_they_meet(spark):
    """Sets of 1,500 tokens with rare ones in common; before, their sketches of 384 bits let whole sets be sent for them."""
    rng = random.Random(9)
    common = [f"c{i}" for i in range(3000)]
    rows = [(i, rng.sample(common, 1200) + [f"r{(i * 7 + j * j) % 900}" for j in range(300)]) for i in range(60)]
    rows = [(i, sorted(set(x))) for i, x in rows] + [(60, sorted({*rows[0][1][20:], "o"}))]
    frame = spark.createDataFrame(rows, "id long, tokens array<string>").selectExpr("id", "'a' AS side", "0 AS within", "tokens")
    parts = similarity.prefixes(frame, 0.8).repartition(1).sortWithinPartitions("s")
    batches = similarity.whole_groups(iter(parts.toArrow().combine_chunks().to_batches(500)))
    met = {tuple(sorted((r["a"], r["b"]))) for batch in batches for out in similarity.pairs_of(batch, 0.8, False) for r in out.to_pylist()}
    assert (0, 60) in met and len(met) < 5


def test_ranks_stay_in_their_rows(spark):
    """Before, whole sets were joined by id with their ranks, and dealt by label."""
    rows = spark.createDataFrame([(1, "a", ["x", "y"], None), (2, "b", ["x", "y"], None), (3, "b", None, "length")], "id long, label string, tokens array<string>, reason string")
    known = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x", "z"])], "label string, terms array<string>")
    found = similarity.with_rank(rows, known)
    assert {r.id: (r.rank, r.margin) for r in found.collect()} == {1: (1, 0.5), 2: (2, -0.5), 3: (None, None)}
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()

"""Ranked search against brute force, whatever the blocks, groups of queries and thresholds."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from halyard.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def brute(docs, queries, k):
    found = [(i, Counter(w)) for i, w in ((i, TERM.findall((t or "").translate(UPPER))) for i, t in docs) if w]
    n_docs, total = len(found), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    asked = {}
    for item, text in queries:
        asked.setdefault(item, set()).update(TERM.findall((text or "").translate(UPPER)))
    out = set()
    for item, words in asked.items():
        scores = []
        for i, c in found:
            m = 10 + (90 * c.total() * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in words if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out |= {(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scores)[:k], 1)}
    return out


def corpus(n=400):
    rng = np.random.default_rng(4)
    words = ["a", "The", "ÉTÉ", "été", "x9", "naïve", "日本", *(f"w{i}" for i in range(300))]
    p = 1 / np.arange(1, len(words) + 1)
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 60), p=p / p.sum())).replace(" w1 ", "_w1-\x85")) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, " ,. "), (None, "w7 w8 w9"), (5, "w250 w251 w252"), (n + 3, " ".join(rng.choice(words, 20_000)))]
    return docs + [(n + 10 + i, "w200 the w201") for i in range(30)]


QUERIES = [(1, "the w200 W201"), (2, "été w3 w3 w299"), (3, None), (4, "..."), (5, "absent"), (6, "w250"), (None, "w7"), (1, "w5"), (7, "ÉTÉ É"), (8, "w40 w41 w42 w43 w44 w45 a the")]


@pytest.mark.parametrize(("docs_of_block", "query_bytes"), [(128, 8 << 20), (3, 300), (1, 64)])
def test_equals_brute_force(spark, monkeypatch, docs_of_block, query_bytes):
    monkeypatch.setattr(search, "QUERY_BYTES", query_bytes)
    docs = corpus()
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, score string").repartition(3)
    queries = spark.createDataFrame([(*q, "clash") for q in QUERIES], "item_id long, text string, rank string")
    index = search.build(df, block_docs=docs_of_block)
    assert index.blocks(spark).count() >= len(docs) / (2 * docs_of_block)
    got = search.search(index, queries, 10).collect()
    assert {tuple(r) for r in got} == brute(docs, QUERIES, 10) and len(got) == len({tuple(r) for r in got})


def test_a_block_is_left_out_only_below_the_threshold():
    """Scored pairs of query and block are few where one block holds the matches, and the result is unchanged."""
    docs = [(i, Counter({b"common": 1, b"t%d" % i: 1}), 2) for i in range(200)]
    docs += [(1000 + i, Counter({b"rare": 5, b"common": 1}), 6) for i in range(20)]
    index = search.Index("", len(docs), sum(d[2] for d in docs))
    rows = [search.block_row(str(i), docs[i : i + 20]) for i in range(0, len(docs), 20)]

    class Row:
        terms = (b"common", b"rare")

    queries = search.arrays([Row], {b"common": 0, b"rare": 1}, index.n_docs, {0: len(docs), 1: 20})
    blocks = list(search.opened_batches(iter(rows), queries, index))
    found = [int(search.bounds(b, queries)[0]) for b in blocks]
    exact = [search.scores(b, queries, 0) for b in blocks]
    assert all(b >= s.max() for b, s in zip(found, exact, strict=True))
    best = search.Best(1, 10, np.zeros(1, dtype=np.int64))
    scored = 0
    for i in np.argsort(-np.array(found), kind="stable"):
        if found[i] < best.threshold(0):
            break
        scored += 1
        best.offer(0, blocks[i].ids, exact[i])
    assert scored == 1 and [r[1] for r in best.rows()] == list(range(1000, 1010))


def test_empty_tables(spark):
    none, queries = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(QUERIES, "item_id long, text string")
    assert search.ranked(none, queries).count() == 0
    assert search.ranked(spark.createDataFrame([(1, "w1")], "doc_id long, text string"), queries.limit(0)).count() == 0

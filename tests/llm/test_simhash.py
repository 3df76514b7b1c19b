import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from halyard.llm import simhash as S


def plain_fingerprint(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < k else [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(codes, bits):
    up = list(range(len(codes)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


@given(st.one_of(st.none(), st.text(alphabet="aB \t\x0bé", max_size=60)))
@settings(max_examples=200)
def test_fingerprint(text):
    assert S.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def test_gray_rank_is_the_inverse_of_the_gray_code():
    ranks = np.arange(4096, dtype=np.uint64)
    assert (S.gray_rank(ranks ^ (ranks >> np.uint64(1))) == ranks).all()


@pytest.mark.parametrize("bits", [2, 4])
def test_links_connect_as_all_pairs_do(bits):
    rng = random.Random(bits)
    codes = {rng.getrandbits(64) for _ in range(150)}
    for c in list(codes)[:40]:
        for _ in range(6):
            codes.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    codes = sorted(codes)
    own = plain_components(codes, bits)
    array = np.array(codes, dtype=np.uint64)
    nodes, members = [], []
    for kind, m in enumerate(S.block_masks(bits)):
        nodes += [hash((kind, c & m)) for c in codes]
        members += codes
    a, b = S.partition_links(np.array(nodes), np.array(members, dtype=np.uint64), bits)
    labels = S.Labels(len(codes))
    labels.link(np.searchsorted(array, a), np.searchsorted(array, b))
    groups = lambda x: {tuple(v) for v in by(x).values()}
    assert groups(labels.of.tolist()) == groups(own)


def by(labels):
    out = defaultdict(list)
    for i, v in enumerate(labels):
        out[v].append(i)
    return out


def test_large_bucket_uses_the_tree_and_agrees():
    rng = random.Random(5)
    center = rng.getrandbits(64)
    codes = sorted({center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 9))) for _ in range(700)})
    array = np.array(codes, dtype=np.uint64)
    order = np.argsort(S.gray_rank(array))
    found = S.bucket_links(array[order], 4)
    own = plain_components([int(x) for x in array[order]], 4)
    assert {tuple(v) for v in by(found.tolist()).values()} == {tuple(v) for v in by(own).values()}


def test_query_on_edge_cases(spark):
    rows = [(5, "a b c d e", "x"), (3, "A  b c\td e", "x"), (9, None, None), (8, "", ""), (None, "a b c d e", None), (7, "q", "x"), (7, "q", "x"), (1, "lonely text that has no twin at all here", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in S.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (9, 8), (8, 8), (None, 3), (7, 7), (7, 7), (1, 1)], key=str)
    assert S.near_duplicates(docs.limit(0)).count() == 0


@pytest.fixture(params=[0, 100, 10**6])
def settled_edges(request, monkeypatch):
    monkeypatch.setattr(S, "SETTLED_EDGES", request.param)


def test_components_of_a_long_chain_by_rounds_and_at_once(spark, settled_edges):
    edges = spark.range(120).selectExpr("id AS a", "id + 1 AS b")
    found = S.components(edges)
    assert found.select("root").distinct().count() == 1 and found.count() == 121
    assert S.components(edges.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).selectExpr("id AS a", "id + 1 AS b")
    found = S.components(edges)
    assert found.select("root").distinct().count() == 1 and found.count() == 301


def test_representatives_keep_what_is_not_similar(spark):
    rng = random.Random(12)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(400)]
    near = base[:]
    near[200] = "changed"
    other = [f"w{rng.randint(0, 10**6)}" for _ in range(400)]
    rows = [(5, " ".join(base)), (3, " ".join(base)), (4, " ".join(near)), (6, " ".join(other)), (7, None), (8, ""), (9, "short text"), (None, " ".join(base))]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, fp string")
    kept = sorted(r["doc_id"] for r in S.representatives(docs).collect())
    bits = (S.fingerprint(rows[0][1].encode(), 5) ^ S.fingerprint(rows[2][1].encode(), 5)).bit_count()
    assert bits <= 10 and S.similarity(rows[0][1].encode(), rows[2][1].encode(), 5) > 0.95
    assert kept == [3, 6, 7, 9]
    # far texts stay even where the links are so loose that all are one component
    assert {3, 6, 9} <= {r["doc_id"] for r in S.representatives(docs, max_bits=40).collect()}
    assert S.representatives(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [60, 700])
def test_pairs_are_all_pairs_once(spark, n):
    rng = random.Random(n)
    center = rng.getrandbits(64)
    codes = sorted({center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 9))) for _ in range(n)})
    frame = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "fp long")
    got = [frozenset((r["a"] % (1 << 64), r["b"] % (1 << 64))) for r in S.pairs(frame, 4).collect()]
    assert len(got) == len(set(got)) and set(got) == {frozenset((a, b)) for a in codes for b in codes if a < b and (a ^ b).bit_count() <= 4}


def test_representatives_check_members_that_are_not_the_head(spark):
    rng = random.Random(13)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    base, head = [word() for _ in range(400)], [word() for _ in range(400)]
    near = base[:]
    near[200] = "changed"
    rows = [(1, " ".join(head)), (2, " ".join(base)), (3, " ".join(near)), (4, " ".join(word() for _ in range(400)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # so loose that all are one component, whose smallest id is like none of the others
    assert sorted(r["doc_id"] for r in S.representatives(docs, max_bits=40).collect()) == [1, 2, 4]


def test_texts_of_one_fingerprint_are_compared(spark):
    rng = random.Random(14)
    filler = "0 " * 400
    rows = [(i, filler + " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(60))) for i in range(3)]
    rows += [(3, rows[1][1].upper().replace(" ", "  "))]
    assert len({S.fingerprint(t.encode(), 5) for _, t in rows}) == 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in S.representatives(docs).collect()) == [0, 1, 2]


def family(rng, n, words, edits):
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(words)]
    out = [base]
    for _ in range(n - 1):
        copy = base[:]
        for at in rng.sample(range(words), edits):
            copy[at] = f"w{rng.randint(0, 10**6)}"
        out.append(copy)
    return [" ".join(x) for x in out]


def plain_groups(texts, least):
    sets = [set(S.hashed(t.encode(), 5)) for t in texts]
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {find(i) for i in range(len(texts))}


def test_groups_in_one_block_and_in_many(spark):
    rng = random.Random(21)
    # copies that are similar to the text they come from and, mostly, not to each other
    texts = family(rng, 60, 200, 4) + family(rng, 30, 200, 4)[1:] + family(rng, 12, 40, 1) + ["alone " * 9, ""]
    want = plain_groups(texts, 0.8)
    assert 3 < len(want) < 60
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [{r["doc_id"] for r in S.representatives(docs, block_docs=b).collect()} for b in (512, 7)]
    assert found[0] == found[1]
    assert len(found[0] ^ want) <= 0.1 * len(texts)


def test_recall_at_the_stated_similarity(spark):
    rng = random.Random(22)
    texts = [t for _ in range(150) for t in family(rng, 2, 120, 2)]
    likeness = [S.similarity(texts[i].encode(), texts[i + 1].encode(), 5) for i in range(0, len(texts), 2)]
    pairs = [i for i, s in enumerate(likeness) if s >= 0.8]
    assert len(pairs) > 100 and min(likeness[i] for i in pairs) < 0.87
    kept = {r["doc_id"] for r in S.representatives(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(2 * i in kept for i in range(150))
    assert sum(2 * i + 1 not in kept for i in pairs) >= 0.9 * len(pairs)
    assert all(2 * i + 1 in kept for i in range(150) if i not in pairs)
    assert S.recall(0.8, 26) >= 0.9


def test_wide_index_connects_as_all_pairs_of_one_node(spark):
    rng = np.random.default_rng(23)
    center = rng.integers(0, 1 << 63, size=2, dtype=np.uint64)
    codes = np.array([center ^ np.packbits(rng.random(128) < 0.12, bitorder="little").view("<u8") for _ in range(300)])
    a, b = S.connected(np.zeros(300, dtype=np.int64), codes, 20)
    labels = S.Labels(300)
    labels.link(a, b)
    whole = [int(x) | int(y) << 64 for x, y in codes]
    assert {tuple(v) for v in by(labels.of.tolist()).values()} == {tuple(v) for v in by(plain_components(whole, 20)).values()}


def test_representatives_with_clashing_columns_and_repeated_rows(spark):
    rows = [(2, "a b c d e f", 1, 2, 3)] * 5 + [(1, "A b  c d e f", 4, 5, 6), (None, "g h i j k l", 7, 8, 9), (None, None, 1, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int, root int, n int")
    assert sorted((r["doc_id"] for r in S.representatives(docs).collect()), key=str) == [1, None, None]


def test_keys_agree(spark):
    from pyspark.sql import functions as F

    texts = [None, "", " ", "A  b\tC", "a b c", "\u00c9 \u00e9\u0085x\u00a0y", "x\x0b\x0c\ry\n", "\x1c a"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", S.text_key(F.col("t")).alias("k")).collect()
    assert {r["i"]: bytes(r["k"]) for r in rows} == {i: S.key_of(None if t is None else t.encode()) for i, t in enumerate(texts)}

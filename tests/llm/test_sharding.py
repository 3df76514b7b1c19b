import zlib
from collections import Counter

from halyard.llm import sharding as S


def docs(spark, n=2000):
    rows = [(i, f"text {i % 700}", "k") for i in range(n)] + [(None, None, "k")] * 3 + [(7, "same", "k")] * 5 + [(8, "", None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, shard string")


def test_rows_law(spark):
    rows, d = docs(spark)
    got = S.assign(d).collect()
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    text = {i: t or "" for i, t, _ in rows}
    assert all((r["size"], r["text_crc32"]) == (len(text[r["doc_id"]].encode()) + 8, zlib.crc32(text[r["doc_id"]].encode())) for r in got if r["doc_id"] not in (7, 8))


def test_equals_one_key_at_a_time(spark):
    _, d = docs(spark, 400)
    keys = S.keyed(d, S.SLOTS).orderBy("slot", "key", "doc_id", "text_crc32").collect()
    nodes = S.ring(spark, 24, S.VNODES, S.SLOTS)
    room = S.capacities(len(keys), 24, 0.1)
    want = Counter()
    for k in keys:
        at = next((i for i, (slot, _) in enumerate(nodes) if slot >= k["slot"]), 0)
        while not room[nodes[at % len(nodes)][1]]:
            at += 1
        shard = nodes[at % len(nodes)][1]
        room[shard] -= 1
        want[k["doc_id"], k["text_crc32"], shard] += 1
    assert Counter((r["doc_id"], r["text_crc32"], r["shard"]) for r in S.assign(d, slack=0.1).collect()) == want


def test_growth_moves_few_rows(spark):
    d = spark.range(8000).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    place = lambda n: {r["doc_id"]: r["shard"] for r in S.assign(d, n, slack=0.25).collect()}
    a, b = place(24), place(25)
    assert max(Counter(a.values()).values()) <= 1.25 * 8000 / 24 + 1
    assert sum(a[i] != b[i] for i in a) / 8000 < 0.25


def test_empty(spark):
    assert S.assign(docs(spark)[1].limit(0)).count() == 0


def test_copies_are_counted_before_they_are_ranked(spark, monkeypatch):
    monkeypatch.setattr(S, "COPIES", 40)
    d = spark.range(900).selectExpr("if(id % 3 = 0, 1, id) AS doc_id", "if(id % 3 = 0, 'hot', cast(id AS string)) AS text")
    got = S.assign(d).collect()
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == 900 and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    assert Counter(r["doc_id"] for r in got)[1] >= 300

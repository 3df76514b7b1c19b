import hashlib
import random
import re

from halyard.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def plain(text, items, size=10):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        x = words(t)
        n = min(size, len(x))
        wins = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in wins:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def tables(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)] + ["Été", "ß"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 30])))) for i in range(25)] + [(100, None), (100, "twice. the same id here")]
    docs = []
    for i in range(120):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        if rng.random() < 0.4:
            x = words(rng.choice(items)[1])
            w[0:0] = x[rng.randint(0, 3) :]
        docs.append((i, rng.choice([" ", ", ", "-", "\n"]).join(w).title()))
    docs += [(500, None), (500, None), (None, ""), (501, "w1 " * 3000)]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")


def test_equals_brute_force_in_one_block_or_many(spark):
    docs, items, d, b = tables(spark)
    want = sorted([(i, *plain(t, items)) for i, t in docs], key=str)
    for block_bytes in (1 << 26, 20_000):
        assert D.blocks_of(b.select("text"), block_bytes) > 1 or block_bytes > 20_000
        assert sorted(map(tuple, D.report(d, b, block_bytes=block_bytes).collect()), key=str) == want


def test_strip(spark):
    item = "one two three four five six seven eight nine ten eleven"
    d = spark.createDataFrame([(1, f"Before. {item.title()}! after", "k"), (2, "clean  as before", None), (3, None, "k")], "doc_id long, text string, items string")
    b = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted(r["doc_id"] for r in D.strip(d, b).collect()) == [2, 3]
    spans = {r["doc_id"]: (r["text"], r["items"]) for r in D.strip(d, b, "spans").collect()}
    assert spans == {1: ("Before. ! after", "k"), 2: ("clean  as before", None), 3: (None, "k")}
    assert D.report(d.limit(0), b).count() == 0 and D.report(d, b.limit(0)).where("contaminated").count() == 0


def test_strip_does_not_depend_on_the_blocks(spark):
    rng = random.Random(4)
    docs, items, d, b = tables(spark)
    # windows that overlap and belong to different items, so that blocks share a passage
    chain = [f"w{i}" for i in range(24)]
    items += [(200 + i, " ".join(chain[i : i + 10])) for i in range(0, 15)]
    docs += [(700, "start " + " ".join(chain) + " tail"), (701, " ".join(chain[3:17])), (700, "start " + " ".join(chain) + " tail")]
    d = spark.createDataFrame([(*r, rng.choice("xy")) for r in docs], "doc_id long, text string, mark string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for mode in ("spans", "documents"):
        one = D.strip(d, b, mode)
        want = sorted(map(tuple, one.collect()), key=str)
        assert one.columns == d.columns and any(t == "start  tail" for _, t, _ in want) == (mode == "spans")
        for block_bytes in (20_000, 9_000):
            assert D.blocks_of(D.items_of(b), block_bytes) > 1
            many = D.strip(d, b, mode, block_bytes=block_bytes)
            assert many.columns == d.columns and sorted(map(tuple, many.collect()), key=str) == want
        assert D.strip(d.limit(0), b, mode).count() == 0 and D.strip(d, b.limit(0), mode).count() == len(docs)


def test_set_is_no_larger_than_counted(spark):
    items = [(str(i), b"a b c d e f g h i j k l m n o p q r s t u v w x y z" * 20) for i in range(50)]
    windows = D.Windows(items, 10)
    held = len(windows.buffer) + sum(c.nbytes for columns in windows.by_words.values() for c in columns)
    table = spark.createDataFrame([(i, t.decode()) for i, t in items], "item_id string, text string")
    assert D.blocks_of(table, held) > 1
    # one window in many items is found in all of them
    assert windows.hits(b"a b c d e f g h i j")[2] == {str(i) for i in range(50)}

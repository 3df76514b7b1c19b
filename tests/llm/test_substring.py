import random

import pytest

from halyard.llm import substring as S


@pytest.mark.parametrize("period", [1, 3, 7, 13, 21, 40])
def test_difference_cover(period):
    own = S.difference_cover(period)
    assert {(a - b) % period for a in own for b in own} == set(range(period))


def made(rng, n):
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for _ in range(n):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(0, 120))]
        if rng.random() < 0.5:
            at, s = rng.randint(0, len(words)), rng.randint(0, 30)
            words[at:at] = passage[s : s + rng.randint(20, 60)]
        texts.append(rng.choice([" ", "\n", " \t"]).join(words))
    return [*texts, None, "", texts[0], "same " * 90, "x y " * 40]


@pytest.mark.parametrize("size", [35, 8, 3])
def test_equals_all_windows(spark, size):
    texts = made(random.Random(size), 60)
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in S.report(docs, size).collect()}
    want = S.brute_force([None if t is None else t.encode() for t in texts], size)
    assert got == dict(enumerate(want))


def test_many_batches_agree(spark):
    texts = made(random.Random(9), 80)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = S.removed(docs, 35, batch_bytes=600).selectExpr("rest.doc_id", "n_words", "n_removed", "sha2(kept, 256) AS k").collect()
    want = S.brute_force([None if t is None else t.encode() for t in texts])
    assert {r[0]: tuple(r)[1:] for r in rows} == dict(enumerate(want))


def test_strip_keeps_columns_and_clean_texts(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(1, f"a  b\n{passage} c", "rest", 1), (2, f"{passage}", "kept", 2), (3, "clean  text\n", None, 3), (4, None, "x", None), (None, "", "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rest string, batch int")
    got = {r["doc_id"]: (r["text"], r["rest"], r["batch"]) for r in S.strip(docs).collect()}
    assert got == {1: ("a b c", "rest", 1), 3: ("clean  text\n", None, 3), 4: (None, "x", None), None: ("", "x", 5)}
    assert S.strip(docs.limit(0)).count() == 0 and S.strip(docs).columns == docs.columns


def test_rows_that_are_all_equal_go_to_many_batches(spark):
    from halyard.llm import tally

    hot = " ".join(f"w{i}" for i in range(60))
    other = [(i, " ".join(f"v{i}x{j}" for j in range(50))) for i in range(100)]
    docs = spark.createDataFrame([(700, hot, "a")] * 60 + [(i, t, "b") for i, t in other], "doc_id long, text string, row string")
    placed, n, _ = tally.batches(docs, batch_bytes=3000)
    sizes = [r["b"] for r in placed.groupBy("batch").agg({"text": "count"}).toDF("batch", "b").collect()]
    assert n > 5 and placed.count() == 160 and max(sizes) < 60
    assert placed.where("rest.row = 'a'").select("batch").distinct().count() > 2
    for got in (S.removed(docs, batch_bytes=3000), S.removed(docs)):
        assert sorted((r["rest"]["doc_id"], r["n_removed"]) for r in got.collect()) == sorted([(700, 60)] * 60 + [(i, 0) for i, _ in other])

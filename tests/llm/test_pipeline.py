import random

from halyard.llm import bpe, decontaminate, substring


def test_stages_take_effect(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(8)
    lex = {"aa": ["the", "water", "house", "under", "river", "green"], "bb": ["wasser", "über", "unter", "haus", "fluss", "grün"]}
    text = lambda lang, n: " ".join(rng.choice(lex[lang]) + str(rng.randint(0, 9999)) for _ in range(n))
    passage = text("aa", 55)
    leak = " ".join(f"item{i}" for i in range(12))
    rows = [(i, text("aa" if i % 2 else "bb", 80), "aa" if i % 2 else "bb") for i in range(60)]
    rows += [(100, rows[5][1], "aa"), (101, text("aa", 60) + " " + passage, "aa"), (102, passage + " " + text("aa", 60), "aa"), (103, text("bb", 40) + " " + leak, "bb"), (104, None, "aa"), (105, "123 456", "bb"), (106, passage, "aa")]
    folder = str(tmp_path)
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = {r["doc_id"]: r for r in P.run(spark, folder).collect()}
    assert set(got) == set(range(60)) | {101, 102}
    codec = bpe.Codec(bpe.vocabulary_path())
    for i, t, _ in rows:
        if i < 60:
            assert got[i]["ids"] == codec.encode(t)
    for i in (101, 102):
        kept = " ".join(w for w in dict((a, b) for a, b, _ in rows)[i].split() if w not in passage.split())
        assert got[i]["ids"] == codec.encode(kept)
    stages = dict(P.STAGES)
    for name in ("language", "near_duplicates", "repeated_passages", "benchmark_leaks"):
        assert stages[name](spark, docs, folder).columns == docs.columns
    assert substring.SIZE == 35 and decontaminate.SIZE == 10


def test_repeated_ids_count_once(spark):
    import corpus_pipeline as P

    docs = spark.createDataFrame([(1, "one two three four five six"), (1, "other words that differ from the first row"), (2, "one two three four five six")], "doc_id long, text string")
    assert [r["doc_id"] for r in P.near_duplicates(spark, docs, "").collect()] == [1]


def test_rows_without_an_id_are_told_apart_by_text(spark):
    import corpus_pipeline as P

    rows = [(None, "one two three four five six"), (None, "other words that differ from the first row"), (None, "Other  words that differ from the first row"), (None, "seven eight nine"), (3, "one two three four five six")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"].lower().split()) for r in P.near_duplicates(spark, docs, "").collect()), key=str)
    assert got == sorted([(3, rows[0][1].split()), (None, rows[1][1].split()), (None, rows[3][1].split())], key=str)


def test_text_of_a_repeated_id_that_stays_is_the_one_compared(spark):
    import corpus_pipeline as P

    docs = spark.createDataFrame([(1, "zz words that differ"), (1, "a b c d e f"), (2, "zz words that differ"), (2, "zz words that differ")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in P.near_duplicates(spark, docs, "").collect()) == [(1, "a b c d e f"), (2, "zz words that differ")]

"""Quality rules against a brute force of the base counts, and the labels of the given tables."""

import math
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from halyard.llm import quality

SCHEMA = "doc_id long, text string, lang string, n_words string, kept string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = "the cat sat on the mat and the dog ran to the river while birds sang in a tall tree near our old house by some hills"


def brute(text: str) -> tuple[int, int, int, int, int]:
    words = WORDS.findall(text)
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [line for line in text.split("\n") if WORDS.search(line)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(line in lines[:i] for i, line in enumerate(lines)), len(hit)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é\n\r\t\x0b\x0c#|<　\x85𝄞", max_size=80))
def test_base_counts(text):
    assert quality.base_counts(text.encode()) == brute(text)


def prose(i: int, n: int = 120) -> str:
    words = PROSE.split()
    rng = np.random.default_rng(i)
    rare = lambda: "".join(rng.choice(list("aeioulmnrst"), 7))
    return ". ".join(" ".join(w for _ in range(5) for w in (rng.choice(words), rare())).capitalize() for _ in range(n // 10))


def test_verdicts(spark):
    long = " ".join(prose(i) for i in range(300, 500))
    rows = [(i, prose(i), "en") for i in range(40)]
    rows += [(100, None, "en"), (101, "", None), (102, "a few words", "en"), (103, "same words again " * 60, "en")]
    rows += [(104, re.sub(r"\S+", lambda m: m[0] + "$$$", prose(104)), "en"), (105, prose(105).upper().replace(" ", "!! "), None)]
    rows += [(106, " ".join(f"qx{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}zv" for i in range(300)), "en"), (107, "字 " * 20 + " ".join(chr(0x4E00 + i) for i in range(300)), "zh")]
    rows += [(108, long, "en"), (0, prose(0), "en"), (None, prose(1), None)]
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    got = quality.report(docs.repartition(3)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for doc_id, text, _ in rows:
        r = by_id[doc_id]
        assert tuple(r[c] for c in quality.BASE) == brute(text or ""), doc_id
        assert r.base_failed == quality.failed(r.n_words, r.n_repeat_words)
    assert all(by_id[i].kept for i in (*range(40), 108, None))
    assert not any(by_id[i].kept for i in (100, 101, 102, 103, 104, 105, 106))
    assert [by_id[i].base_failed for i in (104, 105, 106)] == [False] * 3
    assert by_id[107].kept and by_id[107].word_distance is None  # no reference for its language
    assert sum(r.doc_id == 0 and r.kept for r in got) == 2
    assert quality.report(docs.limit(0)).count() == 0


def test_a_hot_text_teaches_once(spark):
    rows = [(i, prose(i), "en") for i in range(60)] + [(100 + i, prose(777, 60), "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    once = quality.references(docs.where("doc_id <= 100"))
    many = quality.references(docs.repartition(5))
    assert once[0].words == many[0].words and np.allclose(once[0].shares, many[0].shares)
    assert quality.report(docs).where("kept").count() == 100


def test_without_reference_base_rules_count(spark):
    docs = spark.createDataFrame([(1, prose(1), None), (2, "$ " * 20, "en")], "doc_id long, text string, lang string")
    assert {r.doc_id: (r.kept, r.class_distance) for r in quality.report(docs).collect()} == {1: (True, None), 2: (False, None)}


def test_references_and_distances_are_those_of_brute_force(spark):
    docs = spark.createDataFrame([(i, prose(i, 100 + 10 * i), "en" if i % 3 else "xx") for i in range(60)], "doc_id long, text string, lang string")
    known = {r.lang: r for r in quality.references(docs, common=5, least_words=100)}
    texts = [r.text for r in docs.where("lang = 'en'").collect()]
    words = Counter(w for t in texts for w in re.findall(r"[a-z]+", t.lower()))
    top = sorted(words, key=lambda w: (-words[w], w))[:5]
    total = words.total()
    assert known["en"].words == top and np.allclose(known["en"].shares, [*(words[w] / total for w in top), 1 - sum(words[w] for w in top) / total])

    text = prose(999)
    own = Counter(re.findall(r"[a-z]+", text.lower()))
    n = own.total()
    p = [own[w] / n for w in top] + [1 - sum(own[w] for w in top) / n]
    js = sum(0.5 * a * math.log2(2 * a / (a + b)) for x, y in ((p, known["en"].shares), (known["en"].shares, p)) for a, b in zip(x, y, strict=True) if a)
    want = math.sqrt(max(js - 5 / (8 * n * math.log(2)), 0))
    found = quality.Judge([known["en"]]).distances(text, "en")
    assert math.isclose(found[1], want, abs_tol=1e-9) and found[2] == "en"


def test_labels_of_the_given_tables(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.report(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("NOT base_failed")
    good, bad = got.where("quality = 1"), got.where("quality = 0")
    assert good.where("kept").count() >= 0.99 * good.count() and bad.where("kept").count() <= 0.2 * bad.count()

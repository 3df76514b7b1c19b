import itertools
import random

import numpy as np

from halyard.llm import language as L


def test_forward_sums_all_segmentations():
    lattice = L.Lattice(["a", "b", "ab", "ba", "abb"])
    p = np.random.default_rng(0).random((6, 2))
    for word in ("a", "abba", "abbab", "xay"):
        want = np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            parts, last = [], 0
            for i, c in enumerate([*cuts, 1], 1):
                if c:
                    parts.append(word[last:i])
                    last = i
            ids = [lattice.index.get(x, lattice.unknown if len(x) == 1 else None) for x in parts]
            if None not in ids:
                want += np.prod(p[ids], axis=0)
        assert np.allclose(np.exp(lattice.forward([word], p)[0]), want)


def test_expected_counts_cover_every_letter():
    vocabulary = ["a", "b", "ab", "ba", "abb"]
    lattice = L.Lattice(vocabulary)
    p = np.random.default_rng(1).random((6, 2))
    words = ["abba", "bb", "xab"]
    counts = np.array([[2.0, 0], [1, 3], [0, 1]])
    e = lattice.expected(words, counts, p)
    letters = np.array([len(v) for v in vocabulary] + [1])
    assert np.allclose((e * letters[:, None]).sum(axis=0), (counts * np.array([[4], [2], [3]])).sum(axis=0))


def corpus(spark):
    rng = random.Random(2)
    lex = {"aa": ["the", "water", "house", "under"], "bb": ["wasser", "über", "unter", "haus"]}
    rows = [(i, " ".join(rng.choice(lex[lang]) + rng.choice(["", "en", "s", ","]) for _ in range(30)), lang) for i in range(200) for lang in [rng.choice(["aa", "bb"])]]
    rows += [(900, None, "aa"), (901, "123 ... !!", "bb"), (902, "the house " * 3000, None), (903, "", "aa"), (None, "wasser haus", "bb"), (904, "x" * 5000, "aa")]
    return spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, lang string, lang_pred string")


def test_held_out_accuracy_and_edge_cases(spark):
    docs = corpus(spark)
    model = L.fit(docs.where(~L.held_out()))
    assert model[0] == ["aa", "bb"]
    got = {r["doc_id"]: r for r in L.predict(docs, model, also=L.held_out().alias("held_out")).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 903))
    assert got[902]["lang_pred"] == "aa" and got[None]["lang_pred"] == "bb"
    truth = {r["doc_id"]: r["lang"] for r in docs.where("doc_id < 200").collect()}
    held = [i for i in truth if got[i]["held_out"]]
    assert held and np.mean([got[i]["lang_pred"] == truth[i] for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = L.accepted(docs, model)
    assert kept.columns == docs.columns and not {900, 901, 903} & {r["doc_id"] for r in kept.collect()} and kept.count() >= 200


def test_empty_tables(spark):
    docs = corpus(spark)
    nothing = L.fit(docs.limit(0))
    assert nothing[0] == [] and {r["lang_pred"] for r in L.predict(docs, nothing).collect()} == {"und"}
    assert L.predict(docs.limit(0), L.fit(docs)).count() == 0


def all_ways(lattice, word, p):
    """Sums over segmentations by recursion on exact fractions of the word."""
    from fractions import Fraction

    exact = [[Fraction(float(x)) for x in row] for row in p]
    sums = [[Fraction(1)] * p.shape[1]]
    for j in range(1, len(word) + 1):
        row = [Fraction(0)] * p.shape[1]
        for i in range(max(0, j - lattice.longest), j):
            piece = lattice.index.get(word[i:j], lattice.unknown if j - i == 1 else None)
            if piece is not None:
                row = [r + s * q for r, s, q in zip(row, sums[i], exact[piece], strict=True)]
        sums.append(row)
    return sums[-1]


def test_a_long_run_is_one_word():
    import math

    lattice = L.Lattice(["a", "b", "ab", "ba", "abb"])
    p = np.random.default_rng(3).random((6, 2)) / 50
    rng = random.Random(3)
    for n in (24, 25, 26, 45, 120):
        word = "".join(rng.choice("abx") for _ in range(n))
        want = [math.log(f.numerator) - math.log(f.denominator) for f in all_ways(lattice, word, p)]
        assert np.allclose(lattice.forward([word], p)[0], want)
        assert np.allclose(lattice.forward(["ab", word, "x"], p)[1], want)
    # two halves are not the whole where a piece spans the cut
    assert not np.allclose(lattice.forward(["abab" * 12], p), lattice.forward(["abab" * 5 + "a"], p) + lattice.forward(["bab" + "abab" * 6], p))
    # far below the least number
    word = "abx" * 2000
    assert np.isfinite(lattice.forward([word], p)).all()


def test_expected_counts_of_long_words_in_spans(monkeypatch):
    lattice = L.Lattice(["a", "b", "ab", "ba", "abb"])
    p = np.random.default_rng(4).random((6, 2))
    word, counts = "abbaxabbab" * 2 + "abb", np.array([[2.0, 1.0]])
    assert len(word) <= L.SHORT
    want = lattice.expected([word], counts, p)
    assert np.allclose(lattice.expected_long(word, counts[0], p), want)
    monkeypatch.setattr(L, "SPAN", 5)
    assert np.allclose(lattice.expected_long(word, counts[0], p), want)
    letters = np.array([1, 1, 2, 2, 3, 1])
    long = word * 20
    assert np.allclose((lattice.expected([long, "ab"], np.ones((2, 2)), p) * letters[:, None]).sum(axis=0), len(long) + 2)


def test_predictions_equal_brute_force(spark):
    docs = corpus(spark)
    langs, p = L.fit(docs.where(~L.held_out()))
    lattice = L.Lattice(L.pieces())
    memo = {}

    def plain(text):
        words = L.WORD.findall(text or "")
        if not words:
            return "und", 0.0
        total = np.zeros(len(langs))
        for w in words:
            if w not in memo:
                sums = all_ways(lattice, "▁" + w, p) if len(w) < 60 else None
                memo[w] = np.log([float(x) for x in sums]) if sums else lattice.forward(["▁" + w], p)[0]
            total = total + memo[w]
        top = int(np.argmax(total))
        return langs[top], float(1 / np.exp(total - total[top]).sum())

    got = {(r["doc_id"]): (r["lang_pred"], r["score"]) for r in L.predict(docs, (langs, p)).collect()}
    for r in docs.collect():
        lang, score = plain(r["text"])
        assert got[r["doc_id"]][0] == lang and abs(got[r["doc_id"]][1] - score) < 1e-9
    assert got[904][0] == "aa"


def test_store_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(L, "KEPT_BYTES", 1 << 20)
    lattice = L.Lattice(L.pieces())
    p = np.full((len(lattice.index) + 1, 3), 1e-4)
    scorer = L.Scorer(lattice, p)
    rng = random.Random(9)
    most = 0
    for _ in range(30):
        texts = [("é".join(rng.choice("abcdefg") for _ in range(1500))).encode() for _ in range(30)]
        assert all(x is not None for x in scorer.best(texts))
        most = max(most, scorer.held)
    assert most <= 1 << 20 and len(scorer.place) < 900


def test_rare_languages_keep_their_rows(spark):
    rows = [(i, "the house under water " + str(i), "aa") for i in range(900)] + [(None, "wasser unter haus", "bb"), (5000, "fluss grün", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, p = L.fit(docs, sample_rows=40)
    lattice = L.Lattice(L.pieces())
    scores = lattice.forward(["▁wasser", "▁house"], p)
    assert langs == ["aa", "bb"] and scores[0].argmax() == 1 and scores[1].argmax() == 0


def test_more_languages_than_are_learned(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_LANGUAGES", 3)
    rows = [(i, "the and of water house", "en") for i in range(30)] + [(100 + i, "der die und wasser haus", "de") for i in range(20)] + [(200 + i, "la casa el agua que", "es") for i in range(10)] + [(300 + i, "quux", f"x{i}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs)
    assert model[0] == ["de", "en", "es"]
    assert L.predict(docs, model).count() == len(rows)

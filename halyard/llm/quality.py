"""Quality rules: counts of a text, and the divergence of its histograms from those of its language.

Two histograms describe a text: its characters by class, and its words by the most common words of a
language, with one bin for all others. Each language has a reference for both, gathered over all
documents that pass the base rules. A text is kept if one reference is near in both histograms, by the
Jensen-Shannon distance (base 2, from 0 to 1); the nearest of all counts, as stated languages may be
wrong. A histogram of too few items says little, so two guards apply: below a least length a histogram
is not judged, and above it the divergence that chance alone gives a sample of that length is subtracted.

Defined results. Null text counts as empty: no words, base rules failed. A null ``lang`` adds to no
reference. A text whose stated language has too few words for a reference is judged by the base rules
alone; without a stated language it is compared with all. Repeated rows, equal ids and null ids are judged one by one; equal texts get equal verdicts.
Without any reference (an empty table, or too few words in every language) only the base rules count.
Texts are read whole, whatever their length. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm.common import bounded, rows_of
from halyard.session import discard, shared_path

LETTERS = re.compile(r"[^\W\d_]+")
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"

LOWER, UPPER, OTHER_LETTER, DIGIT, SPACE, BREAK, STOP, MARK, SYMBOL, REST = range(10)
N_CLASSES = 10

#: Common words of a language that have a bin of their own: so many at most, with so large a share of its words.
COMMON, COMMON_SHARE = 100, 0.001
#: A text that makes up more than one in so many rows teaches as one row; there are fewer such texts than that.
HOT = 1_000
#: A language needs so many words in base-passing documents to be a reference; the languages with most words are taken.
REFERENCE_WORDS, REFERENCES = 2_000, 256
#: Guards: characters and letter runs below which a histogram is not judged.
LEAST_CHARS, LEAST_WORDS = 200, 50
#: The largest distances of a text that is kept.
CLASS_LIMIT, WORD_LIMIT = 0.2, 0.4

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


class Reference(NamedTuple):
    """Shares of one language: character classes, and common words with a last bin for the others."""

    lang: str
    classes: np.ndarray
    words: list[str]
    shares: np.ndarray


@cache
def class_table() -> np.ndarray:
    """The class of every code point, from its Unicode category."""
    by_category = {"Ll": LOWER, "Lu": UPPER, "Lt": UPPER, "Lm": OTHER_LETTER, "Lo": OTHER_LETTER, "Mn": OTHER_LETTER, "Mc": OTHER_LETTER, "Nd": DIGIT, "Nl": DIGIT, "No": DIGIT, "Zs": SPACE, "Zl": BREAK, "Zp": BREAK, "Pc": MARK, "Pd": MARK, "Ps": MARK, "Pe": MARK, "Pi": MARK, "Pf": MARK, "Po": MARK, "Sm": SYMBOL, "Sc": SYMBOL, "Sk": SYMBOL, "So": SYMBOL}
    table = np.fromiter((by_category.get(unicodedata.category(chr(i)), REST) for i in range(0x110000)), dtype=np.uint8, count=0x110000)
    for chars, kind in (("\t", SPACE), ("\n\x0b\x0c\r", BREAK), (".,;:!?", STOP), ("#*$%&|<>@\\^~_=+/{}[]", SYMBOL)):
        table[[ord(c) for c in chars]] = kind
    return table


def class_counts(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    return np.bincount(class_table()[points], minlength=N_CLASSES)


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words in windows of ``size`` words that stand twice or more in the text, the first one included."""
    windows = list(zip(*(words[i:] for i in range(size)), strict=False))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    starts = np.fromiter((seen[w] > 1 for w in windows), dtype=bool, count=len(windows))
    hit = np.zeros(len(words), dtype=bool)
    for i in range(size):
        hit[i : i + len(starts)] |= starts
    return int(hit.sum())


def symbols(data: bytes) -> int:
    return sum(data.count(bytes([c])) for c in SYMBOLS)


def base_counts(data: bytes) -> tuple[int, int, int, int, int]:
    """``BASE`` of one text."""
    words = data.split()
    points = len(data) - int(((np.frombuffer(data, dtype=np.uint8) & 0xC0) == 0x80).sum())
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (
        len(words),
        points - sum(data.count(bytes([c])) for c in SPACES),
        symbols(data),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def failed(n_words: int, n_repeat_words: int) -> bool:
    """The base rules: fewer than 50 words, or over half of them in repeated windows."""
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


COUNTS = pa.schema([("lang", pa.string()), ("kind", pa.string()), ("item", pa.string()), ("n", pa.float64())])


def hot_texts(rows: DataFrame) -> dict[int, int]:
    """Hashes of the texts that copies make hot, and the number of their rows."""
    counts = rows.groupBy(F.xxhash64("text").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return {r.key: r.n for r in counts.join(F.broadcast(total)).where(F.col("n") > F.greatest(F.lit(1), F.col("total") / HOT)).collect()}


def counted(batches: Iterator[pa.RecordBatch], hot: dict[int, int], at_most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Class and word counts by language, added up in the task while they fit.

    Texts that fail the base rules, or hold a symbol for every ten words, teach nothing.
    """
    found: Counter = Counter()
    for data, lang, key in rows_of(batches, "text", "lang", "key"):
        data = data or b""
        words = data.split()
        if len(words) < 50 or 10 * symbols(data) > len(words) or failed(len(words), repeated_words(words)):
            continue
        text, copies = data.decode("utf-8", "replace"), hot.get(key, 1)
        for i, n in enumerate(class_counts(text)):
            found[lang, "class", str(i)] += int(n) / copies
        for word, n in Counter(LETTERS.findall(text.lower())).items():
            found[lang, "word", word] += n / copies
        if len(found) >= at_most:
            yield from bounded(((*key, n) for key, n in found.items()), COUNTS, 50_000)
            found.clear()
    yield from bounded(((*key, n) for key, n in found.items()), COUNTS, 50_000)


def references(docs: DataFrame, common: int = COMMON, least_words: int = REFERENCE_WORDS, at_most: int = REFERENCES) -> list[Reference]:
    """The references of ``docs`` (``text, lang``), from all rows that pass the base rules.

    What comes to the driver is bounded: hot texts, and ``at_most`` languages with ``common`` words and the classes.
    """
    rows = docs.where("lang IS NOT NULL").select(F.col("text").cast("binary").alias("text"), F.col("lang").cast("string").alias("lang"))
    hot = hot_texts(rows)
    path = shared_path(docs.sparkSession, "histograms")
    keyed = rows.withColumn("key", F.xxhash64("text")) if hot else rows.withColumn("key", F.lit(0).cast("long"))
    counts = keyed.mapInArrow(lambda batches: counted(batches, hot), "lang string, kind string, item string, n double")
    counts.groupBy("lang", "kind", "item").agg(F.round(F.sum("n"), 6).alias("n")).write.parquet(path)
    counts = docs.sparkSession.read.parquet(path)
    totals = counts.where("kind = 'word'").groupBy("lang").agg(F.sum("n").alias("total")).where(F.col("total") >= least_words)
    taken = totals.orderBy(F.desc("total"), "lang").limit(at_most).collect()
    own = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "item")
    rows = counts.where(F.col("lang").isin([r.lang for r in taken])).withColumn("i", F.row_number().over(own)).where(F.col("i") <= max(common, N_CLASSES)).orderBy("lang", "kind", "i").collect()
    discard(docs.sparkSession, path)
    out = []
    for r in sorted(taken):
        classes = np.zeros(N_CLASSES)
        for c in (c for c in rows if c.lang == r.lang and c.kind == "class"):
            classes[int(c.item)] = c.n
        top = [c for c in rows if c.lang == r.lang and c.kind == "word" and c.n >= COMMON_SHARE * r.total][:common]
        n = np.array([c.n for c in top], dtype=float)
        out.append(Reference(r.lang, classes / classes.sum(), [c.item for c in top], np.append(n, r.total - n.sum()) / r.total))
    return out


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of the rows of ``p`` and ``q``."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0.0) + np.where(q > 0, q * np.log2(q / m), 0.0)
    return np.clip(parts.sum(axis=-1) / 2, 0.0, 1.0)


def distance(counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Distance of a text's counts from the shares of each reference, less what chance gives.

    A sample of n items from a distribution of k bins diverges from it by about (k - 1) / (8 n ln 2) bits.
    """
    n = counts.sum(axis=-1, keepdims=True)
    chance = (np.count_nonzero(shares, axis=-1) - 1) / (8 * n[..., 0] * np.log(2))
    return np.sqrt(np.maximum(divergence(counts / n, shares) - chance, 0.0))


class Judge:
    """Compares texts with all references at once."""

    def __init__(self, known: list[Reference]):
        self.known = known
        self.langs = {r.lang for r in known}
        self.classes = np.array([r.classes for r in known])
        width = max((len(r.shares) for r in known), default=1)
        self.shares = np.array([np.concatenate([r.shares[:-1], np.zeros(width - len(r.shares)), r.shares[-1:]]) for r in known])
        self.bins: dict[str, list[tuple[int, int]]] = {}
        for row, r in enumerate(known):
            for i, word in enumerate(r.words):
                self.bins.setdefault(word, []).append((row, i))

    def distances(self, text: str, lang: str | None) -> tuple[float | None, float | None, str | None]:
        """Distances of classes and of words from the nearest reference, null where a guard or the lack of a reference forbids one."""
        if not self.known or (lang is not None and lang not in self.langs):
            return None, None, None
        by_class = by_word = None
        counts = class_counts(text)
        if counts.sum() >= LEAST_CHARS:
            by_class = distance(counts[None, :], self.classes)
        words = Counter(LETTERS.findall(text.lower()))
        total = words.total()
        if total >= LEAST_WORDS:
            table = np.zeros_like(self.shares)
            for word in words.keys() & self.bins.keys():
                for row, i in self.bins[word]:
                    table[row, i] = words[word]
            table[:, -1] = total - table.sum(axis=1)
            by_word = distance(table, self.shares)
        if by_class is None and by_word is None:
            return None, None, None
        worst = np.maximum(0 if by_class is None else by_class / CLASS_LIMIT, 0 if by_word is None else by_word / WORD_LIMIT)
        best = int(np.argmin(worst))
        return *(None if d is None else float(d[best]) for d in (by_class, by_word)), self.known[best].lang


VERDICTS = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in BASE), ("base_failed", pa.bool_()), ("class_distance", pa.float64()), ("word_distance", pa.float64()), ("reference", pa.string())])


def report(docs: DataFrame, known: list[Reference] | None = None, id_col: str = "doc_id") -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, both distances with the reference they are from, and ``kept``.

    ``known`` are the references of the documents themselves unless given. Distances are null where
    the base rules fail or a guard applies; a null distance speaks against no text.
    """
    known = references(docs) if known is None else known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(known)

        def rows() -> Iterator[tuple]:
            for doc_id, data, lang in rows_of(batches, "doc_id", "text", "lang"):
                data = data or b""
                base = base_counts(data)
                bad = failed(base[0], base[4])
                found = (None, None, None) if bad else judge.distances(data.decode("utf-8", "replace"), lang)
                yield (doc_id, *base, bad, *found)

        yield from bounded(rows(), VERDICTS)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.col("lang").cast("string").alias("lang"))
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, class_distance double, word_distance double, reference string"
    return rows.mapInArrow(run, schema).withColumn("kept", verdict())


def verdict() -> Column:
    near = (F.coalesce("class_distance", F.lit(0.0)) <= CLASS_LIMIT) & (F.coalesce("word_distance", F.lit(0.0)) <= WORD_LIMIT)
    return ~F.col("base_failed") & near

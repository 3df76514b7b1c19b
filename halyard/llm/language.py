"""Language identification by segmentation-marginalised unigrams.

For each language, pieces of a fixed public vocabulary have a probability; a word's probability is the
sum, over all its segmentations into pieces, of the product of their probabilities, by the forward
algorithm. A text's log score is the sum over its words. Piece probabilities are fitted by expected
counts over all segmentations (the backward pass of the same lattice), starting from equal weights.
Words are runs of letters, as written, behind the vocabulary's mark for word starts; pieces with
anything but letters cannot occur in them. Short words go through the lattice together, longer ones
alone in log space, so a run of letters is one word whatever its length.

The fit reads labelled rows, at most ``sample_rows`` in expectation and an even share of them for each
language, taken by a hash of id and text (a documented bound: the model has no more than languages x
pieces numbers, whatever the corpus is). A language with fewer rows than its share is read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.llm.bpe import vocabulary_path
from halyard.llm.common import arrow, bounded, portions, rows_of
from halyard.session import cut

VOCABULARY = "piece_bpe_32k.model"
SAMPLE_ROWS = 8_000
ROUNDS = 2
FLOOR = 0.05  # pseudo-count of each piece in each language
KEPT_BYTES = 96 << 20  # of chunks and their scores, in a worker
SHORT = 24  # words of more letters are summed alone, in log space; their scores are the same
SPAN = 1 << 15  # positions of a long word that the fit holds at once
MOST_LANGUAGES = 1000
UNKNOWN = "und"
START = "▁"
#: ASCII characters that are no letters part words; all other bytes stay.
FOLD = bytes(c if c >= 128 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))
WORD = regex.compile(r"\p{L}+")


def pieces(name: str = VOCABULARY) -> list[str]:
    """Pieces of the public vocabulary that words can be made of: letters, with or without the mark of a word start."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=vocabulary_path(name))
    found = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_byte(i) and not model.is_unknown(i)}
    return sorted(p for p in found if p == START or WORD.fullmatch(p.removeprefix(START)))


class Lattice:
    """Segmentations of words into pieces, many words at once; a letter outside the vocabulary is one unknown piece."""

    def __init__(self, vocabulary: list[str]):
        self.index = {p: i for i, p in enumerate(vocabulary)}
        self.unknown = len(vocabulary)
        self.starts = {p[:n] for p in vocabulary for n in range(2, len(p) + 1)}
        self.longest = max((len(p) for p in vocabulary), default=1)

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, from, to, piece) of every piece occurrence, sorted by where it ends."""
        get, starts, unknown = self.index.get, self.starts, self.unknown
        out: list[int] = []
        for k, w in enumerate(words):
            n = len(w)
            for i in range(n):
                out += (k, i, i + 1, get(w[i], unknown))
                for j in range(i + 2, n + 1):
                    part = w[i:j]
                    if part not in starts:
                        break
                    piece = get(part)
                    if piece is not None:
                        out += (k, i, j, piece)
        table = np.array(out, dtype=np.int64).reshape(-1, 4)
        return tuple(table.T)

    def forward(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language; ``p``: pieces x languages."""
        short = [k for k, w in enumerate(words) if len(w) <= SHORT]
        if len(short) == len(words):
            return self.forward_short(words, p)
        out = np.empty((len(words), p.shape[1]))
        if short:
            out[short] = self.forward_short([words[k] for k in short], p)
        logs = np.log(p)
        for k, w in enumerate(words):
            if len(w) > SHORT:
                out[k] = self.forward_long(w, logs)
        return out

    def ways(self, word: str, at: int, most: int) -> list[tuple[int, int]]:
        """(length, piece) of the pieces that begin at a place of a word, up to ``most`` letters."""
        get, starts = self.index.get, self.starts
        out = [(1, get(word[at], self.unknown))]
        for n in range(2, min(self.longest, most) + 1):
            part = word[at : at + n]
            if part not in starts:
                break
            piece = get(part)
            if piece is not None:
                out.append((n, piece))
        return out

    def forward_long(self, word: str, logs: np.ndarray, start: int = 0, stop: int | None = None, ahead: np.ndarray | None = None, keep: bool = False) -> np.ndarray:
        """Log sums over the ways from the word's start, by place; only the last is kept unless asked.

        ``ahead`` (places from ``start`` on, as far as a piece reaches) is what earlier places gave; a ring
        of that many rows is all that a pass holds.
        """
        stop, ring = len(word) if stop is None else stop, self.longest + 1
        if ahead is None:
            ahead = np.full((ring, logs.shape[1]), -np.inf)
            ahead[0] = 0
        ahead = ahead.copy()
        rows = np.empty((stop - start, logs.shape[1])) if keep else None
        for at in range(start, stop):
            own = ahead[at % ring].copy()
            ahead[at % ring] = -np.inf
            if keep:
                rows[at - start] = own
            for n, piece in self.ways(word, at, len(word) - at):
                to = (at + n) % ring
                np.logaddexp(ahead[to], own + logs[piece], out=ahead[to])
        self.ring = ahead
        return rows if keep else ahead[stop % ring].copy()

    def expected_long(self, word: str, counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """As :meth:`expected` for one word, holding ``SPAN`` places at a time."""
        logs, ring, n = np.log(p), self.longest + 1, len(word)
        heads = [None]
        for at in range(0, n, SPAN):
            self.forward_long(word, logs, at, min(n, at + SPAN), heads[-1])
            heads.append(self.ring)
        total = heads[-1][n % ring]
        out = np.zeros_like(p)
        back = np.full((ring, logs.shape[1]), -np.inf)
        back[n % ring] = 0
        for k in range(len(heads) - 2, -1, -1):
            first, last = k * SPAN, min(n, (k + 1) * SPAN)
            rows = self.forward_long(word, logs, first, last, heads[k], keep=True)
            for at in range(last - 1, first - 1, -1):
                own = np.full(logs.shape[1], -np.inf)
                for length, piece in self.ways(word, at, n - at):
                    way = logs[piece] + back[(at + length) % ring]
                    np.logaddexp(own, way, out=own)
                    out[piece] += counts * np.exp(rows[at - first] + way - total)
                back[at % ring] = own
        return out

    def forward_short(self, words: list[str], p: np.ndarray) -> np.ndarray:
        word, start, end, piece = self.edges(words)
        n = max(map(len, words))
        alpha = np.zeros((len(words), n + 1, p.shape[1]))
        alpha[:, 0] = 1
        by_end = np.argsort(end, kind="stable")
        cuts = np.searchsorted(end[by_end], np.arange(1, n + 2))
        for j in range(1, n + 1):
            e = by_end[cuts[j - 1] : cuts[j]]
            add_rows(alpha[:, j], word[e], alpha[word[e], start[e]] * p[piece[e]])
        return np.log(alpha[np.arange(len(words)), [len(w) for w in words]])

    def expected(self, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected counts of pieces (pieces x languages) over all segmentations; ``counts``: words x languages."""
        long = [k for k, w in enumerate(words) if len(w) > SHORT]
        if long:
            short = [k for k, w in enumerate(words) if len(w) <= SHORT]
            sums = self.expected([words[k] for k in short], counts[short], p) if short else np.zeros_like(p)
            for k in long:
                sums += self.expected_long(words[k], counts[k], p)
            return sums
        word, start, end, piece = self.edges(words)
        n = max(map(len, words))
        lengths = np.array([len(w) for w in words])
        alpha = np.zeros((len(words), n + 1, p.shape[1]))
        beta = np.zeros_like(alpha)
        alpha[:, 0] = 1
        beta[np.arange(len(words)), lengths] = 1
        by_end = np.argsort(end, kind="stable")
        cuts = np.searchsorted(end[by_end], np.arange(1, n + 2))
        for j in range(1, n + 1):
            e = by_end[cuts[j - 1] : cuts[j]]
            add_rows(alpha[:, j], word[e], alpha[word[e], start[e]] * p[piece[e]])
        by_start = np.argsort(start, kind="stable")
        cuts = np.searchsorted(start[by_start], np.arange(0, n + 1))
        for i in range(n - 1, -1, -1):
            e = by_start[cuts[i] : cuts[i + 1]]
            add_rows(beta[:, i], word[e], beta[word[e], end[e]] * p[piece[e]])
        total = alpha[np.arange(len(words)), lengths]
        share = alpha[word, start] * p[piece] * beta[word, end] * (counts / total)[word]
        out = np.zeros_like(p)
        add_rows(out, piece, share)
        return out


def add_rows(target: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    for k in range(target.shape[1]):
        target[:, k] += np.bincount(at, weights=values[:, k], minlength=len(target))


def chunks_of(text: bytes | None) -> list[bytes]:
    """Stretches of a text between ASCII characters that are no letters."""
    return (text or b"").translate(FOLD).split()


def words_of(chunk: bytes) -> list[str]:
    """Runs of letters of a chunk, each behind the mark of a word start."""
    found = [chunk.decode()] if chunk.isalpha() else WORD.findall(chunk.decode("utf-8"))
    return [START + w for w in found]


def by_word(chunks: Counter) -> Counter:
    out: Counter = Counter()
    for c, n in chunks.items():
        for w in words_of(c):
            out[w] += n
    return out


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, vocabulary: str = VOCABULARY, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the pieces x languages matrix of probabilities.

    ``labelled`` has ``doc_id, text, lang``; rows with a null text or lang are left out, those with a null
    id are not. The ``MOST_LANGUAGES`` values of ``lang`` with most rows are learned, ties by the name; rarer ones
    are never predicted. Other columns are not read; without rows there is no language.
    """
    rows = labelled.select("doc_id", F.col("text").cast("binary").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    counted = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    langs = sorted(r["lang"] for r in counted)
    if not langs:
        return [], np.zeros((0, 0))
    share = max(1, sample_rows // len(langs))
    rates = F.create_map(*(F.lit(x) for r in counted for x in (r["lang"], min(1.0, share / r["count"]))))
    place_in = F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(1 << 30)) / (1 << 30)
    place = {x: i for i, x in enumerate(langs)}
    seen = pa.schema([("word", pa.string()), ("lang", pa.int32()), ("n", pa.int64())])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(rows_of(batches, "text", "lang"), 8 << 20, 0):
            counts = [Counter() for _ in langs]
            for text, lang in part:
                counts[place[lang]].update(chunks_of(text))
            yield from bounded(((w, i, n) for i, c in enumerate(counts) for w, n in by_word(c).items()), seen, 20_000, lambda r: len(r[0]))

    sample = rows.where(place_in < F.element_at(rates, F.col("lang"))).select("text", "lang")
    counted = sample.mapInArrow(words, "word string, lang int, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    by_words = counted.groupBy("word").agg(F.collect_list("lang").alias("langs"), F.collect_list("n").alias("counts"))
    # few bytes and much work: a stated number of partitions, so that they are not merged by size
    table = cut(by_words.repartition(max(labelled.sparkSession.sparkContext.defaultParallelism, 8), "word"))
    own = pieces(vocabulary)
    lattice_size = len(own) + 1
    p = np.full((lattice_size, len(langs)), 1 / lattice_size)
    context = labelled.sparkSession.sparkContext
    schema = pa.schema([("piece", pa.int64()), ("lang", pa.int64()), ("n", pa.float64())])
    for _ in range(rounds):
        shared = context.broadcast(p)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lattice, model = Lattice(own), shared.value
            sums = np.zeros_like(model)
            for part in portions(rows_of(batches, "word", "langs", "counts"), 1 << 16, 0):
                counts = np.zeros((len(part), len(langs)))
                for k, (_, at, n) in enumerate(part):
                    counts[k, at] = n
                sums += lattice.expected([w for w, *_ in part], counts, model)
            piece, lang = np.nonzero(sums)
            if len(piece):
                yield arrow(schema, (piece, lang, sums[piece, lang]))

        sums = np.zeros_like(p)
        found = table.mapInArrow(run, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
        for r in found.toLocalIterator():  # no more than pieces x languages
            sums[r["piece"], r["lang"]] = r["n"]
        p = (sums + FLOOR) / (sums + FLOOR).sum(axis=0)
    return langs, p


class Scorer:
    """Scores of texts, with a store of chunks that is bounded by bytes. Row 0 is for chunks without a letter."""

    def __init__(self, lattice: Lattice, p: np.ndarray):
        self.lattice, self.p = lattice, p
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.used = 1
        self.table = np.zeros((1 << 12, self.p.shape[1]))
        self.held = 0

    def weight(self, chunk: bytes) -> int:
        """What a chunk takes in the store: its bytes, its entry, and its row of scores, which may double."""
        return len(chunk) + 150 + 16 * self.p.shape[1]

    def scores(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of chunks, and which of them have a letter."""
        split = [words_of(c) for c in chunks]
        owner = [k for k, own in enumerate(split) for _ in own]
        words = [w for own in split for w in own]
        out = np.zeros((len(chunks), self.p.shape[1]))
        if words:
            add_rows(out, np.array(owner, dtype=np.int64), self.lattice.forward(words, self.p))
        return out, np.array([bool(own) for own in split])

    def learn(self, chunks: list[bytes]) -> None:
        scores, lettered = self.scores(chunks)
        n = int(lettered.sum())
        if self.used + n > len(self.table):
            grown = np.zeros((max(2 * len(self.table), self.used + n), self.table.shape[1]))
            grown[: self.used] = self.table[: self.used]
            self.table = grown
        rows = np.zeros(len(chunks), dtype=np.int64)
        rows[lettered] = np.arange(self.used, self.used + n)
        self.table[rows[lettered]] = scores[lettered]
        self.used += n
        self.place.update(zip(chunks, rows.tolist(), strict=True))
        self.held += sum(map(self.weight, chunks))

    def best(self, texts: list[bytes | None]) -> list[tuple[int, float] | None]:
        """The likeliest language of each text and its posterior; None without a letter."""
        if not self.p.shape[1]:
            return [None] * len(texts)
        split = [chunks_of(t) for t in texts]
        place = self.place
        new = {c for own in split for c in own if c not in place}
        if self.held + sum(map(self.weight, new)) > KEPT_BYTES:
            self.clear()
            place, new = self.place, {c for own in split for c in own}
        ordered, part, size = sorted(new), [], 0
        for c in ordered:  # some thousand words, or a few long chunks, at a time
            part.append(c)
            size += len(c) + 8
            if size > 1 << 16:
                self.learn(part)
                part, size = [], 0
        if part:
            self.learn(part)
        out: list[tuple[int, float] | None] = []
        for own in split:
            rows = np.fromiter(map(place.__getitem__, own), dtype=np.int64, count=len(own))
            if not rows.any():
                out.append(None)
                continue
            total = self.table[rows].sum(axis=0)
            top = int(np.argmax(total))
            out.append((top, float(1 / np.exp(total - total[top]).sum())))
        return out


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", also: Column | None = None) -> DataFrame:
    """``doc_id, lang_pred, score``: the likeliest language of each whole text and its posterior share.

    ``also`` is a boolean column that goes along under its own name.

    A text that is null or has no letter gets ``und`` and score 0, as do all texts if the model knows no
    language. Ties go to the language that sorts first. Only the text decides; equal texts get equal
    rows, and other columns are not read.
    """
    langs, p = model
    shared = docs.sparkSession.sparkContext.broadcast(p)
    own = pieces(vocabulary)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.lit(None).cast("boolean").alias("also") if also is None else also)
    name = rows.columns[-1]
    schema = pa.schema([("doc_id", pa.int64()), (name, pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Lattice(own), shared.value)

        def scored(part: list[tuple]) -> Iterator[tuple]:
            for (doc_id, _, flag), best in zip(part, scorer.best([t for _, t, _ in part]), strict=True):
                yield (doc_id, flag, UNKNOWN, 0.0) if best is None or not langs else (doc_id, flag, langs[best[0]], best[1])

        yield from bounded((row for part in portions(rows_of(batches, "doc_id", "text", name), 2 << 20) for row in scored(part)), schema)

    found = rows.mapInArrow(run, f"doc_id long, `{name}` boolean, lang_pred string, score double")
    return found.drop(name) if also is None else found


def accepted(docs: DataFrame, model: tuple[list[str], np.ndarray], least: float = 0.5, vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows of ``docs``, with all columns, whose text has a known language at a posterior of ``least``.

    A text that is null or has no letter goes, as does one that no language explains better than the
    others together. Texts are read whole; repeated rows stay repeated or go together, an empty table
    stays empty, and only ``text`` is read, whatever the other columns are called. If the model knows no
    language, all rows go.
    """
    langs, p = model
    shared = docs.sparkSession.sparkContext.broadcast(p)
    own = pieces(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Lattice(own), shared.value)
        for batch in batches:
            texts = [None if t is None else t.encode() for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            keep = [bool(langs) and best is not None and best[1] >= least for part in portions(((i, t) for i, t in enumerate(texts)), 2 << 20) for best in scorer.best([t for _, t in part])]
            yield batch.filter(pa.array(keep, type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id", of: int = 4, is_: int = 2):
    """Whether crc32 of the id as text leaves this remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % of == is_

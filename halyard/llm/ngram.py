"""Language-model scores by deleted interpolation.

A bigram, a unigram and a uniform estimate are mixed with weights that depend on how often the context
was seen. Bigram and unigram estimates are relative frequencies over all training documents. The
weights come from expectation-maximisation: a part of the training documents is deleted from the
counts, and each context bucket's weights are fitted to the deleted part's tokens.

Every count covers the whole corpus. A batch of documents asks once for its distinct unigrams and
bigrams, with its own counts; sums over a range of keys return in the order asked (see ``tally``). For
the weights, deleted tokens are summed up by bucket and by the logarithms of their counts in steps of
an eighth of an octave, so what reaches the fit is bounded and covers every deleted token.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.llm import tally

FOLDS, TEST_FOLD, DELETED_FOLD = 7, 2, 3
BUCKETS = 24  # of contexts, by the binary logarithm of their count
STEPS = 8  # of an octave
EM_ROUNDS = 60
ANSWER = "batch int, part int, answer binary"
ANSWER_SCHEMA = pa.schema([("batch", pa.int32()), ("part", pa.int32()), ("answer", pa.binary())])
END, START = b"\n</s>", b"\n<s>"  # no word holds white space


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts as bytes, those from 255 on in a list behind."""
    large = counts >= 255
    return np.where(large, 255, counts).astype(np.uint8).tobytes() + counts[large].astype("<i8").tobytes()


def unpack_counts(blob: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(blob, dtype=np.uint8, count=n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(blob, dtype="<i8", offset=n)
    return counts


def pack_two(a: np.ndarray, b: np.ndarray) -> bytes:
    first = pack_counts(a)
    return len(first).to_bytes(4, "little") + first + pack_counts(b)


def unpack_two(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    cut = 4 + int.from_bytes(blob[:4], "little")
    return unpack_counts(blob[4:cut], n), unpack_counts(blob[cut:], n)


class Batch:
    """Tokens of a batch of documents and its distinct n-grams."""

    def __init__(self, texts: list[bytes | None], folds: list[int]):
        place: dict[bytes, int] = {END: 0, START: 1}
        flat: list[int] = []
        lengths = []
        for t in texts:
            words = (t or b"").lower().split()
            for w in words:
                if w not in place:
                    place[w] = len(place)
            flat += map(place.__getitem__, words)
            flat.append(0)
            lengths.append(len(words) + 1)
        self.lengths = np.array(lengths, dtype=np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.tokens = np.array(flat, dtype=np.int64)
        self.before = np.r_[np.int64(1), self.tokens[:-1]]
        self.before[self.first] = 1
        fold = np.array(folds, dtype=np.int64)
        self.kept, self.deleted = (fold != TEST_FOLD) & (fold != DELETED_FOLD), fold == DELETED_FOLD
        types = len(place)
        pair = self.before * types + self.tokens
        self.pairs, self.pair_of = np.unique(pair, return_inverse=True)
        self.left, self.right = self.pairs // types, self.pairs % types
        words = np.array([xxhash.xxh3_64_intdigest(w) for w in place], dtype=np.uint64)
        one = mixed(words) | np.uint64(1)  # odd keys: unigrams that count as tokens
        one[1] ^= np.uint64(1)
        two = mixed(words[self.left] * np.uint64(0x9E3779B97F4A7C15) + words[self.right]) & ~np.uint64(1)
        keys = np.r_[one, two]
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.types = types

    def counts(self, of: np.ndarray) -> np.ndarray:
        """Counts of the sorted keys over the documents that ``of`` marks."""
        token = np.repeat(of, self.lengths)
        one = np.bincount(self.tokens[token], minlength=self.types)
        one[1] = int(of.sum())
        two = np.bincount(self.pair_of[token], minlength=len(self.pairs))
        return np.r_[one, two][self.order]

    def ask(self, batch: int, bits: int) -> pa.Table:
        kept, deleted = self.counts(self.kept), self.counts(self.deleted)
        return tally.ask(batch, bits, self.keys, lambda s, e: pack_two(kept[s:e], deleted[s:e]))

    def told(self, answers: pa.Table, bits: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Global kept and deleted counts, of word types and of pairs."""
        cuts = tally.cuts_of(self.keys, bits)
        kept, deleted = np.zeros(len(self.keys), dtype=np.int64), np.zeros(len(self.keys), dtype=np.int64)
        for part, answer in tally.answers_in_order(answers):
            s, e = int(cuts[part]), int(cuts[part + 1])
            kept[self.order[s:e]], deleted[self.order[s:e]] = unpack_two(answer, e - s)
        return (kept[: self.types], deleted[: self.types]), (kept[self.types :], deleted[self.types :])


def reply(key: tuple, table: pa.Table) -> pa.Table:
    """Sums over a range of keys, for each batch that asked; in batch -1 tokens and types of the range."""
    own = [tally.unpack(b) for b in table["keys"].to_pylist()]
    sizes = np.array([len(x) for x in own])
    two = [unpack_two(x, n) for x, n in zip(table["extra"].to_pylist(), sizes.tolist(), strict=True)]
    keys, place = np.unique(np.concatenate(own), return_inverse=True)
    kept = np.bincount(place, weights=np.concatenate([x[0] for x in two]), minlength=len(keys)).astype(np.int64)
    deleted = np.bincount(place, weights=np.concatenate([x[1] for x in two]), minlength=len(keys)).astype(np.int64)
    ends = np.cumsum(sizes)
    answers = [pack_two(kept[place[s:e]], deleted[place[s:e]]) for s, e in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
    token = (keys & np.uint64(1)).astype(bool)
    totals = np.array([kept[token].sum(), (kept[token] > 0).sum(), (kept + deleted)[token].sum(), ((kept + deleted)[token] > 0).sum()], dtype="<i8").tobytes()
    part = key[0].as_py()
    return pa.Table.from_arrays([pa.array([*table["batch"].to_pylist(), -1], type=pa.int32()), pa.array([part] * (len(sizes) + 1), type=pa.int32()), pa.array([*answers, totals], type=pa.binary())], schema=ANSWER_SCHEMA)


def bucket(counts: np.ndarray) -> np.ndarray:
    return np.minimum(BUCKETS - 1, np.ceil(np.log2(counts + 1.0)).astype(np.int64))


def octaves(x: np.ndarray) -> np.ndarray:
    """Logarithms in steps, from 1 on; 0 stands for zero."""
    out = np.zeros(len(x), dtype=np.int64)
    some = x > 0
    out[some] = np.rint(STEPS * np.log2(x[some])).astype(np.int64) + 1
    return out


def weights(cells: list[tuple[int, int, int, int]], n: int, v: int) -> np.ndarray:
    """Mixture weights (bigram, unigram, uniform) by bucket, by expectation-maximisation.

    A cell: bucket, step of the bigram estimate (counted down from 1), step of the unigram count, tokens.
    """
    out = np.full((BUCKETS, 3), 1 / 3)
    out[0] = (0, 0.5, 0.5)  # an unseen context has no bigram estimate
    table = np.array(sorted(cells), dtype=np.int64).reshape(-1, 4)
    for b in np.unique(table[:, 0]).tolist():
        own = table[table[:, 0] == b]
        p = np.stack([np.where(own[:, 1] > 0, 2.0 ** (-(own[:, 1] - 1) / STEPS), 0), np.where(own[:, 2] > 0, 2.0 ** ((own[:, 2] - 1) / STEPS) / max(1, n), 0), np.full(len(own), 1 / (v + 1))], axis=1)
        w = out[b]
        for _ in range(EM_ROUNDS):
            share = p * w
            share *= (own[:, 3] / share.sum(axis=1))[:, None]
            w = share.sum(axis=0) / own[:, 3].sum()
        # no estimate loses all weight, so that any text has a probability
        out[b] = w * (1 - 1e-6) + np.array([0, 5e-7, 5e-7])
    return out


def fitted(key: tuple, table: pa.Table) -> pa.Table:
    """One row: totals and weights, from all cells and totals."""
    totals = sum((np.frombuffer(a, dtype="<i8") for b, a in zip(table["batch"].to_pylist(), table["answer"].to_pylist(), strict=True) if b == -1), np.zeros(4, dtype=np.int64))
    cells: dict[tuple, int] = {}
    for b, q1, q2, n in zip(*(table[c].to_pylist() for c in ("batch", "q1", "q2", "n")), strict=True):
        if b >= 0:
            cells[b, q1, q2] = cells.get((b, q1, q2), 0) + n
    w = weights([(*k, n) for k, n in cells.items()], int(totals[0]), int(totals[1]))
    return pa.table({"model": pa.array([totals.astype("<i8").tobytes() + w.astype("<f8").tobytes()], type=pa.binary())})


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = tally.BATCH_BYTES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row of ``docs``.

    Documents whose crc32 of the id leaves 2 modulo 7 are held out; all others train the model. A null
    or empty text is a lone end token, a null id counts as empty text in the fold. Repeated rows count
    as often as they occur. An empty table gives an empty result.
    """
    fold = (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS).cast("int")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), fold.alias("fold"))
    placed, _, total = tally.batches(rows, batch_bytes=batch_bytes)
    bits = tally.part_bits(total // 9)

    def read(table: pa.Table) -> tuple[Batch, pa.Array, np.ndarray]:
        rest = table["rest"].combine_chunks()
        folds = rest.field("fold").to_pylist()
        return Batch(table["text"].to_pylist(), folds), rest.field("doc_id"), np.array(folds)

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        return read(table)[0].ask(key[0].as_py(), bits)

    def deleted_cells(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["batch", "q1", "q2", "n"]
        own = read(table)[0]
        (word, _), (pair, _) = own.told(answers, bits)
        token = np.repeat(own.deleted, own.lengths)
        p = own.pair_of[token]
        context = word[own.left[p]]
        ratio = np.where(pair[p] > 0, np.rint(-STEPS * np.log2(np.maximum(pair[p], 1) / np.maximum(context, 1))).astype(np.int64) + 1, 0)
        cell, count = np.unique(np.stack([bucket(context), ratio, octaves(word[own.right[p]])], axis=1), axis=0, return_counts=True)
        return pa.table([pa.array(cell[:, 0]), pa.array(cell[:, 1]), pa.array(cell[:, 2]), pa.array(count)], names=names)

    def final(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        own, ids, folds = read(table)
        model = table["model"][0].as_py()
        _, _, tokens, types = np.frombuffer(model, dtype="<i8", count=4).tolist()
        w = np.frombuffer(model, dtype="<f8", offset=32).reshape(-1, 3)
        one, two = own.told(answers, bits)
        word, pair = one[0] + one[1], two[0] + two[1]
        context = word[own.left]
        mix = w[bucket(context)]
        p = mix[:, 0] * pair / np.maximum(context, 1) + mix[:, 1] * word[own.right] / max(1, tokens) + mix[:, 2] / (types + 1)
        by_word = np.log10((word + 1.0) / (tokens + types + 1.0))
        columns = {
            "doc_id": ids,
            "held_out": pa.array(folds == TEST_FOLD),
            "n_tokens": pa.array(own.lengths),
            "n_known": pa.array(np.add.reduceat((word > 0).astype(np.int64)[own.tokens], own.first)),
            "train_tokens": pa.array(np.full(len(folds), tokens, dtype=np.int64)),
            "base_score": pa.array(np.add.reduceat(by_word[own.tokens], own.first)),
            "score": pa.array(np.add.reduceat(np.log10(p)[own.pair_of], own.first)),
        }
        return pa.table(columns)

    # one exchange of texts and one of answers, which all uses below share
    placed = placed.repartition("batch")
    by_batch = placed.groupBy("batch")
    answers = by_batch.applyInArrow(ask, tally.ASK).groupBy("part").applyInArrow(reply, ANSWER)
    told = answers.where("batch >= 0").groupBy("batch")
    cells = by_batch.cogroup(told).applyInArrow(deleted_cells, "batch long, q1 long, q2 long, n long")
    cells = cells.groupBy("batch", "q1", "q2").agg(F.sum("n").alias("n"))
    totals = answers.where("batch = -1").select(F.col("batch").cast("long").alias("batch"), "answer")
    model = cells.unionByName(totals, allowMissingColumns=True).groupBy().applyInArrow(fitted, "model binary")
    modelled = placed.join(F.broadcast(model)).groupBy("batch")  # the model is one row of fixed size
    result = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")), *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score"))])
    return modelled.cogroup(told).applyInArrow(final, result)

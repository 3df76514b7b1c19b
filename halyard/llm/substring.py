"""Removal of repeated passages, with difference-cover anchors.

A passage of ``size`` words that occurs anywhere else is removed, every occurrence of it. Windows of
``anchor`` words are hashed only at word positions whose remainder modulo ``period`` lies in a
difference cover: for any two positions some shift below ``period`` brings both onto the cover, and
``anchor + period - 1 = size``, so two equal passages share an anchor at the same shift. Anchors that
occur once rule out most of the corpus. Around each repeated anchor the match is extended: all full
windows that contain it are hashed (96 bits) and counted over the corpus, which also settles matches
that an anchor alone only suggests. Occurrences are never paired, so a passage that a third of all
rows holds costs no more than any other text.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.llm import tally
from halyard.llm.common import word_spans

SIZE = 35


@lru_cache
def difference_cover(period: int) -> tuple[int, ...]:
    """A small set of remainders whose differences are all remainders."""
    if period <= 31:
        for n in range(1, period + 1):
            for rest in combinations(range(1, period), n - 1):
                own = (0, *rest)
                if len({(a - b) % period for a in own for b in own}) == period:
                    return own
    root = int(np.ceil(np.sqrt(period)))
    return tuple(sorted({*range(root), *(min(period - 1, i) for i in range(root - 1, period + root, root))}))


def period_for(size: int) -> int:
    """A period with a perfect difference set, at most six tenths of the window."""
    return max(p for p in (1, 3, 7, 13, 21) if p <= max(1, 0.6 * size))


class Batch:
    """The texts of a batch, its anchors, and the windows around repeated ones."""

    def __init__(self, texts: list[bytes | None], size: int):
        self.size, self.period = size, period_for(size)
        self.anchor = size - self.period + 1
        cover = np.zeros(self.period, dtype=bool)
        cover[list(difference_cover(self.period))] = True
        self.words = [(t or b"").split() for t in texts]
        self.spans = [word_spans(w) if len(w) >= size else None for w in self.words]
        hashes: list[int] = []
        digest = xxhash.xxh3_64_intdigest
        self.at: list[np.ndarray | None] = []
        for words, span in zip(self.words, self.spans, strict=True):
            if span is None:
                self.at.append(None)
                continue
            buffer, starts, ends = span
            at = np.arange(len(words) - self.anchor + 1)
            at = at[cover[at % self.period]]
            self.at.append(at)
            hashes += [digest(buffer[s:e]) for s, e in zip(starts[at].tolist(), ends[at + self.anchor - 1].tolist(), strict=True)]
        self.keys, self.place, counts = np.unique(np.array(hashes, dtype=np.uint64), return_inverse=True, return_counts=True)
        self.twice = counts > 1

    def ask_anchors(self, batch: int, bits: int) -> pa.Table:
        return tally.ask(batch, bits, self.keys, lambda s, e: np.packbits(self.twice[s:e]).tobytes())

    def candidates(self, repeated: np.ndarray) -> list[np.ndarray]:
        """For each text, the starts of full windows that hold a repeated anchor at an early shift."""
        out, used = [], 0
        flags = repeated[self.place] if len(self.place) else np.zeros(0, dtype=bool)
        for words, at in zip(self.words, self.at, strict=True):
            if at is None:
                out.append(np.zeros(0, dtype=np.int64))
                continue
            own = at[flags[used : used + len(at)]]
            used += len(at)
            n = len(words) - self.size + 1
            edges = np.zeros(len(words) + 2, dtype=np.int64)
            np.add.at(edges, np.maximum(0, own - self.period + 1), 1)
            np.add.at(edges, own + 1, -1)
            out.append(np.flatnonzero(np.cumsum(edges)[:n] > 0))
        return out

    def windows(self, starts: list[np.ndarray]) -> None:
        """Hash the full windows at these starts; equal ones become one question."""
        digest = xxhash.xxh3_128_digest
        raw: list[bytes] = []
        for own, span in zip(starts, self.spans, strict=True):
            if len(own):
                buffer, s, e = span
                raw += [digest(buffer[a:b]) for a, b in zip(s[own].tolist(), e[own + self.size - 1].tolist(), strict=True)]
        both = np.frombuffer(b"".join(raw), dtype=">u8").reshape(-1, 2)
        high, low = both[:, 0].astype(np.uint64), (both[:, 1] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        new = np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])] if len(high) else np.zeros(0, dtype=bool)
        self.window_place = np.empty(len(order), dtype=np.int64)
        self.window_place[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        self.window_high, self.window_low = high[first], low[first]
        self.window_twice = np.diff(np.r_[first, len(high)]) > 1

    def ask_windows(self, batch: int, bits: int) -> pa.Table:
        return tally.ask(batch, bits, self.window_high, lambda s, e: self.window_low[s:e].astype("<u4").tobytes() + np.packbits(self.window_twice[s:e]).tobytes())


def reply(key: tuple, table: pa.Table, wide: bool) -> pa.Table:
    """Which of the keys of a range occur twice or more, for each batch that asked."""
    own = [tally.unpack(b) for b in table["keys"].to_pylist()]
    sizes = [len(x) for x in own]
    keys = np.concatenate(own)
    extra = table["extra"].to_pylist()
    cut = [4 * n if wide else 0 for n in sizes]
    low = np.concatenate([np.frombuffer(x[:c], dtype="<u4") for x, c in zip(extra, cut, strict=True)]) if wide else np.zeros(len(keys), dtype=np.uint32)
    twice = np.concatenate([np.unpackbits(np.frombuffer(x[c:], dtype=np.uint8), count=n).astype(bool) for x, c, n in zip(extra, cut, sizes, strict=True)])
    order = np.lexsort((low, keys)) if wide else np.argsort(keys, kind="stable")
    k, v = keys[order], low[order]
    new = np.r_[True, (k[1:] != k[:-1]) | (v[1:] != v[:-1])]
    first = np.flatnonzero(new)
    repeated = (np.diff(np.r_[first, len(k)]) > 1) | np.logical_or.reduceat(twice[order], first)
    found = np.empty(len(k), dtype=bool)
    found[order] = repeated[np.cumsum(new) - 1]
    answers = [np.packbits(x).tobytes() for x in np.split(found, np.cumsum(sizes)[:-1])]
    schema = pa.schema([("batch", pa.int32()), ("part", pa.int32()), ("wide", pa.bool_()), ("answer", pa.binary())])
    return pa.Table.from_arrays([table["batch"].cast(pa.int32()), pa.array([key[0].as_py()] * len(sizes), type=pa.int32()), pa.array([wide] * len(sizes)), pa.array(answers, type=pa.binary())], schema=schema)


def flags_of(table: pa.Table, keys: np.ndarray, bits: int, wide: bool) -> np.ndarray:
    """The answers of one kind, in the order of the batch's sorted keys."""
    cuts = tally.cuts_of(keys, bits)
    out = np.zeros(len(keys), dtype=bool)
    for part, answer in tally.answers_in_order(table.filter(pc.equal(table["wide"], wide))):
        s, e = int(cuts[part]), int(cuts[part + 1])
        out[s:e] = np.unpackbits(np.frombuffer(answer, dtype=np.uint8), count=e - s).astype(bool)
    return out


def removed(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = tally.BATCH_BYTES) -> DataFrame:
    """``rest, text, n_words, n_removed, kept``: each row of ``docs`` with what is left of its text.

    ``rest`` is a struct of the other columns. A null text has no words and stays null; ``kept`` is the
    kept words joined by one space. Windows are judged on the input. Equal rows, if long enough, are
    repeats of each other; texts shorter than ``size`` words stay whole.
    """
    placed, n, total = tally.batches(docs, text_col, id_col, batch_bytes)
    bits = tally.part_bits(total // 20)  # a word is about six bytes, an anchor comes every four words
    wide_bits = tally.part_bits(total // 18)
    own = placed.groupBy("batch")
    answer = "batch int, part int, wide boolean, answer binary"

    def anchors(key: tuple, table: pa.Table) -> pa.Table:
        return Batch(table["text"].to_pylist(), size).ask_anchors(key[0].as_py(), bits)

    def windows(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return pa.Table.from_arrays([pa.array([], type=f.type) for f in tally.ASK_SCHEMA], schema=tally.ASK_SCHEMA)
        batch = Batch(table["text"].to_pylist(), size)
        batch.windows(batch.candidates(flags_of(answers, batch.keys, bits, False)))
        return batch.ask_windows(key[0].as_py(), wide_bits)

    def final(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        batch = Batch(table["text"].to_pylist(), size)
        starts = batch.candidates(flags_of(answers, batch.keys, bits, False))
        batch.windows(starts)
        hit = flags_of(answers, batch.window_high, wide_bits, True)[batch.window_place] if len(batch.window_place) else np.zeros(0, dtype=bool)
        used = 0
        n_removed, kept = [], []
        for words, first in zip(batch.words, starts, strict=True):
            own = first[hit[used : used + len(first)]]
            used += len(first)
            if len(own):
                edges = np.zeros(len(words) + 1, dtype=np.int64)
                edges[own] += 1
                np.add.at(edges, own + size, -1)
                gone = np.cumsum(edges[:-1]) > 0
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]))
            else:
                n_removed.append(0)
                kept.append(b" ".join(words))
        more = [pa.array([len(w) for w in batch.words], type=pa.int64()), pa.array(n_removed, type=pa.int64()), pa.array(kept, type=pa.binary())]
        return pa.Table.from_arrays([table["rest"], table["text"], *more], names=["rest", "text", "n_words", "n_removed", "kept"])

    first = own.applyInArrow(anchors, tally.ASK).groupBy("part").applyInArrow(lambda key, table: reply(key, table, False), answer)
    second = own.cogroup(first.groupBy("batch")).applyInArrow(windows, tally.ASK).groupBy("part").applyInArrow(lambda key, table: reply(key, table, True), answer)
    result = T.StructType([*placed.select("rest", "text").schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.BinaryType())])
    return own.cogroup(first.unionByName(second).groupBy("batch")).applyInArrow(final, result)


def report(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``, a row for each row of ``docs``."""
    return removed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), size).select(F.col("rest.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def strip(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``docs`` with all its columns and without repeated passages; a text that keeps no word goes.

    A row from which nothing is removed keeps its text byte for byte, null included.
    """
    rows = removed(docs, size).where("n_removed < n_words or n_words = 0")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")).cast("string")
    return rows.select(*(text.alias("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns))


def brute_force(texts: list[bytes | None], size: int = SIZE) -> list[tuple[int, int, str]]:
    """The contract by a dictionary of all windows, for tests."""
    words = [(t or b"").split() for t in texts]
    seen: dict[bytes, int] = {}
    for w in words:
        for i in range(len(w) - size + 1):
            x = b" ".join(w[i : i + size])
            seen[x] = seen.get(x, 0) + 1
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[b" ".join(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return out

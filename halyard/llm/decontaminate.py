"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

Words are runs of ASCII letters and digits and of any other characters beyond ASCII, after lowering
A-Z. A window is ``size`` consecutive words of a benchmark item; a shorter item is one window. Windows
go into a sorted set of hashes that each executor holds with the items' words; hashes of document
windows come from those of their words, and what is found is compared byte for byte, so a hit is a
verified match. The set's size is counted
before it is broadcast. Beyond ``block_bytes`` the items are dealt into blocks: each block is one pass
over the texts that returns rows with hits only, the hits of a row are put together, and whatever is cut
or dropped is decided once, on the whole set of hits. So the result does not depend on the blocks, no
executor holds more than one, and the corpus is never written in between.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.llm.common import bounded, rows_of, word_spans
from halyard.session import cut

SIZE = 10
BLOCK_BYTES = 64 << 20
#: ASCII bytes that end a word become spaces, A-Z become a-z, all others stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def folded_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


class Windows:
    """Windows of a block of items: sorted hashes, the item of each and its place in the items' words, by number of words."""

    def __init__(self, items: list[tuple[str, bytes]], size: int):
        self.items = [i for i, _ in items]
        self.words: dict[bytes, int] = {}  # 0 is for words that no item has
        split = [folded_words(text) for _, text in items]
        for words in split:
            for w in words:
                self.words.setdefault(w, len(self.words) + 1)
        self.codes = np.array([0, *(xxhash.xxh64_intdigest(w) for w in self.words)], dtype=np.uint64)
        found: dict[int, list[tuple[np.ndarray, ...]]] = {}
        buffers, base = [], 0
        for k, words in enumerate(split):
            n = min(size, len(words))
            if not n:
                continue
            buffer, starts, ends = word_spans(words)
            starts, ends = starts[: len(words) - n + 1], ends[n - 1 :]
            found.setdefault(n, []).append((self.hashes(words, n), np.full(len(starts), k, dtype=np.int32), starts + base, (ends - starts).astype(np.int32)))
            buffers.append(buffer)
            base += len(buffer)
        self.buffer = b"".join(buffers)
        self.by_words: dict[int, tuple[np.ndarray, ...]] = {}
        for n, parts in found.items():
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
            order = np.argsort(columns[0], kind="stable")
            self.by_words[n] = tuple(c[order] for c in columns)

    def hashes(self, words: list[bytes], n: int) -> np.ndarray:
        """A hash of each run of n words, from the hashes of its words."""
        get = self.words.get
        return rolled(self.codes[[get(w, 0) for w in words]], n)

    def hits(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, spans (first, number) of hit windows, and the items found."""
        words = folded_words(text)
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        if not words or not self.by_words:
            return len(words), spans, items
        get = self.words.get
        codes = self.codes[[get(w, 0) for w in words]]
        placed = None
        for n, (hashes, item, at, length) in self.by_words.items():
            if len(words) < n:
                continue
            own = rolled(codes, n)
            left = np.searchsorted(hashes, own)
            for i in np.flatnonzero(hashes[np.minimum(left, len(hashes) - 1)] == own).tolist():
                placed = placed or word_spans(words)
                buffer, starts, ends = placed
                window = buffer[starts[i] : ends[i + n - 1]]
                right = np.searchsorted(hashes, own[i], "right")
                same = [k for k in range(left[i], right) if length[k] == len(window) and self.buffer[at[k] : at[k] + length[k]] == window]
                if same:
                    spans.append((i, n))
                    items.update(self.items[k] for k in item[same].tolist())
        return len(words), spans, items


def rolled(codes: np.ndarray, n: int) -> np.ndarray:
    """A polynomial in the codes of each n neighbours."""
    m = len(codes) - n + 1
    out = codes[:m].copy()
    for k in range(1, n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[k : m + k]
    return out


def covered(n: int, spans: list[tuple[int, int]]) -> int:
    """How many of n words the spans cover."""
    if not spans:
        return 0
    edges = np.zeros(n + 1, dtype=np.int64)
    for i, k in spans:
        edges[i] += 1
        edges[i + k] -= 1
    return int((np.cumsum(edges[:-1]) > 0).sum())


def items_of(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text")).where("item_id is not null and text is not null")


def blocks_of(benchmark: DataFrame, block_bytes: int, size: int = SIZE) -> int:
    """Into how many blocks the items go, from what their windows, words and ids take while a set is built."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, distinct = 0, set()
        for (text,) in rows_of(batches, "text"):
            split = folded_words(text)
            words = len(split)
            distinct.update(split)
            if len(distinct) > 100_000:
                total, distinct = total + sum(len(w) + 160 for w in distinct), set()
            total += 1000 + 4 * len(text or b"") + 96 * (words - min(size, words) + 1)  # objects, words, arrays and their sorted copies
        total += sum(len(w) + 160 for w in distinct)
        yield pa.RecordBatch.from_arrays([pa.array([total], type=pa.int64())], names=["b"])

    taken = benchmark.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "b long")
    return max(1, -(-taken.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()["b"] // block_bytes))


def windows_of(items: DataFrame, blocks: int, block: int, size: int) -> Broadcast:
    own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
    return items.sparkSession.sparkContext.broadcast(Windows([(r["item_id"], bytes(r["text"])) for r in own.toLocalIterator()], size))


def text_mark() -> Column:
    """What tells texts apart where hits are put together."""
    return F.unhex(F.md5(F.coalesce(F.col("text").cast("binary"), F.lit(b""))))


def gathered(docs: DataFrame, items: DataFrame, blocks: int, size: int) -> DataFrame:
    """``mark, spans, items`` of the texts that any block hits, one row for equal texts."""
    schema = pa.schema([("mark", pa.binary()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
    rows = docs.select(text_mark().alias("mark"), F.col("text").cast("binary").alias("text")).where("text is not null")

    def scanned(block: int) -> DataFrame:
        shared = windows_of(items, blocks, block, size)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def hit() -> Iterator[tuple]:
                for mark, text in rows_of(batches, "mark", "text"):
                    _, spans, found = shared.value.hits(text)
                    if spans:
                        yield mark, [x for s in spans for x in s], sorted(found)

            yield from bounded(hit(), schema)

        return cut(rows.mapInArrow(run, "mark binary, spans array<long>, items array<string>").distinct())

    parts = [scanned(block) for block in range(blocks)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.groupBy("mark").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def scan(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_words, spans, items``: hit windows (first word, number of words) of each row.

    ``docs`` has ``doc_id, text``, ``benchmark`` has ``item_id, text``; other columns are not read. A
    null text has no words; an item that is null, or has no words, or has a null id, has no windows.
    Equal rows give equal rows; empty tables give no hits or no rows. Texts may be of any length: a row
    is held with the codes of its words and the hashes of its windows, some 24 bytes a word.
    """
    items = items_of(benchmark)
    blocks = blocks_of(items, block_bytes, size)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
    result = "doc_id long, n_words long, spans array<long>, items array<string>"
    if blocks == 1:
        shared = windows_of(items, 1, 0, size)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def step(doc_id, text) -> tuple:
                n, spans, found = shared.value.hits(text)
                return doc_id, n, [x for s in spans for x in s], sorted(found)

            yield from bounded((step(*row) for row in rows_of(batches, "doc_id", "text")), schema)

        return rows.mapInArrow(run, result)
    found = gathered(rows, items, blocks, size)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from bounded(((i, len(folded_words(t)), s or [], x or []) for i, t, s, x in rows_of(batches, "doc_id", "text", "spans", "items")), schema)

    marked = rows.withColumn("own_mark", text_mark())
    return marked.join(found, F.col("own_mark") == F.col("mark"), "left").select("doc_id", "text", "spans", "items").mapInArrow(counted, result)


def report(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Counts and digests of :func:`scan`, a row for each row of ``docs``."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def digest(doc_id, n, spans, items) -> tuple:
            hit = covered(n, list(zip(spans[::2], spans[1::2], strict=True)))
            return doc_id, n, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0

        yield from bounded((digest(*row) for row in rows_of(batches, "doc_id", "n_words", "spans", "items")), schema)

    return scan(docs, benchmark, size, block_bytes).mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def strip(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", size: int = SIZE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without contamination, with all its columns.

    ``documents`` drops rows with a hit. ``spans`` keeps them and cuts each hit passage out of the text,
    from the first byte of its first word to the last of its last; the rest stays byte for byte. Passages
    are those of the text as it came, so what a cut brings together is no new passage. A null or wordless
    text stays as it is, repeated rows stay repeated, an empty table stays empty, and without items
    nothing is cut; of ``docs`` only ``text`` is read, whatever the other columns are called.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(mode)
    items = items_of(benchmark)
    blocks = blocks_of(items, block_bytes, size)
    if blocks > 1:
        return stripped_in_blocks(docs, items, blocks, mode, size)
    shared = windows_of(items, 1, 0, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [None if t is None else t.encode() for t in batch.column(at).to_pylist()]
            found = [shared.value.hits(t)[1] for t in texts]
            yield batch.filter(pa.array([not x for x in found])) if mode == "documents" else cutout(batch, at, texts, found)

    return docs.mapInArrow(run, docs.schema)


def stripped_in_blocks(docs: DataFrame, items: DataFrame, blocks: int, mode: str, size: int) -> DataFrame:
    found = gathered(docs, items, blocks, size)
    names = [F.col(f"d.`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    back = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    joined = docs.select("*", text_mark().alias("own_mark")).alias("d").join(found.alias("h"), F.col("d.own_mark") == F.col("h.mark"), "left")
    if mode == "documents":
        return joined.where(F.col("h.mark").isNull() | F.col("d.text").isNull()).select(*names).select(*back)
    at, width = docs.columns.index("text"), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else t.encode() for t in batch.column(at).to_pylist()]
            found = [[] if t is None or not s else list(zip(s[::2], s[1::2], strict=True)) for t, s in zip(texts, batch.column(width).to_pylist(), strict=True)]
            yield cutout(batch.select(range(width)), at, texts, found)

    placed = joined.select(*names, F.col("h.spans").alias("spans"))
    kinds = T.StructType([T.StructField(f"c{i}", f.dataType, True) for i, f in enumerate(docs.schema.fields)])
    return placed.mapInArrow(run, kinds).select(*back)


def cutout(batch: pa.RecordBatch, at: int, texts: list[bytes | None], found: list[list[tuple[int, int]]]) -> pa.RecordBatch:
    """The batch with the hit passages cut out of its texts."""
    cut_texts = pa.array([t if not x else without(t, x) for t, x in zip(texts, found, strict=True)], type=pa.binary())
    return batch.set_column(at, batch.schema.field(at), cut_texts.cast(batch.schema.field(at).type))


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without the bytes of its hit passages."""
    fold = np.frombuffer(text.translate(FOLD), dtype=np.uint8) != 32
    # the fold leaves no other white space, as every ASCII byte below 48 became a space
    edges = np.diff(np.r_[False, fold, False].astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    hit = np.zeros(len(text), dtype=bool)
    for i, n in spans:
        hit[starts[i] : ends[i + n - 1]] = True
    return np.frombuffer(text, dtype=np.uint8)[~hit].tobytes()

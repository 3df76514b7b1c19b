"""Ranked lexical search with block-max pruning, in 64-bit integers.

``build`` cuts the documents into blocks, ranges of neighbouring documents bounded by number and by
entries, and stores each as one row: a forward index (terms and counts of each document) and, for each
term of the block, the largest part that it adds to any of its documents. ``search`` bounds the score of
every block for every query by these maxima, sorts blocks by bound and scores their documents until the
bound is below the query's threshold, the score that its k-th best document has so far. A first pass over
the maxima alone scores the most promising blocks of each query, so that all tasks of the second pass
start with a high threshold. Nothing is approximate: a block is left out only if its bound is below k scores.

The score of a document is the sum, over the query's distinct terms, of ``weight(df) * impact(tf, m)``.

Defined results. Null or empty text, and text without a term, has no document entry and is never
found; null or empty queries find nothing. Rows of equal id are separate documents, and their order among
equal scores is that of id, null last, then arbitrary. Queries of equal id are one query with the terms
of all; a null id is an id. Long texts fill a block of their own. An empty table gives no rows. Only the
named columns are read, so names of other columns cannot clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm.common import arrow, rows_of
from halyard.session import cut, discard, shared_path

#: Documents and entries (distinct terms of documents) of a block.
BLOCK_DOCS, BLOCK_ENTRIES = 128, 1 << 16
#: Blocks whose bounds are sorted together in a task.
TOGETHER = 64
#: Blocks that the first pass scores for a query.
PROMISING = 2
#: UTF-8 bytes of query terms that one pass over the index answers.
QUERY_BYTES = 8 << 20
#: Bytes of a row group of the index, so that a reader holds few blocks.
ROW_GROUP = 16 << 20

#: Letters and digits of ASCII, in lower case, and all bytes beyond ASCII; everything else parts terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

#: A block: ids of its documents, their lengths and numbers of entries, all terms joined by spaces with their numbers of
#: documents, and the entries (place of the term, count) of one document after another. Numbers are arrays of ``INT`` as bytes.
INDEX = pa.schema([("block", pa.string()), ("ids", pa.list_(pa.int64())), ("n_terms", pa.int64()), *((c, pa.binary()) for c in ("lengths", "counts", "vocabulary", "df", "entries", "tf"))])
INT = np.dtype("<i4")
SCORES = pa.schema([("query", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


class Index(NamedTuple):
    """A stored index: ``blocks`` as written, the number of documents and of their terms."""

    path: str
    n_docs: int
    n_terms: int

    def blocks(self, spark) -> DataFrame:
        return spark.read.parquet(self.path)


def terms(data: bytes) -> list[bytes]:
    return data.translate(TERM_BYTES).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What an entry adds for each unit of weight; ``tf`` and the length of its document, as 64-bit integers."""
    m = 10 + (90 * lengths * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def block_row(name: str, docs: list[tuple[int | None, Counter, int]]) -> pa.RecordBatch:
    """One block: its vocabulary in order, then documents one after another as (term, count) entries."""
    known = sorted({t for _, found, _ in docs for t in found})
    place = {t: i for i, t in enumerate(known)}
    entries = np.fromiter((place[t] for _, found, _ in docs for t in found), dtype=INT)
    tf = np.fromiter((n for _, found, _ in docs for n in found.values()), dtype=INT)
    lengths, counts = np.array([d[2] for d in docs], dtype=INT), np.array([len(d[1]) for d in docs], dtype=INT)
    df = np.bincount(entries, minlength=len(known)).astype(INT)
    numbers = [lengths.tobytes(), counts.tobytes(), b" ".join(known), df.tobytes(), entries.tobytes(), tf.tobytes()]
    return arrow(INDEX, ([v] for v in (name, [d[0] for d in docs], int(lengths.sum(dtype=np.int64)), *numbers)))


def indexed(batches: Iterator[pa.RecordBatch], block_docs: int) -> Iterator[pa.RecordBatch]:
    """Blocks of the documents of one task, in their order."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    held: list[tuple[int | None, Counter, int]] = []
    entries = done = 0
    for doc_id, data in rows_of(batches, "doc_id", "text"):
        words = terms(data or b"")
        if not words:
            continue
        found = Counter(words)
        if held and (len(held) >= block_docs or entries + len(found) > BLOCK_ENTRIES):
            yield block_row(f"{part}-{done}", held)
            held, entries, done = [], 0, done + 1
        held.append((doc_id, found, len(words)))
        entries += len(found)
    if held:
        yield block_row(f"{part}-{done}", held)


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_docs: int = BLOCK_DOCS) -> Index:
    """Index all ``docs`` in the shared folder."""
    spark, path = docs.sparkSession, shared_path(docs.sparkSession, "index")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    schema = "block string, ids array<long>, n_terms long, lengths binary, counts binary, vocabulary binary, df binary, entries binary, tf binary"
    rows.mapInArrow(lambda batches: indexed(batches, block_docs), schema).write.option("parquet.block.size", ROW_GROUP).parquet(path)
    total = spark.read.schema(schema).parquet(path).agg(F.sum(F.size("ids")).alias("n"), F.sum("n_terms").alias("terms")).first()
    return Index(path, total.n or 0, total.terms or 0)


class Queries(NamedTuple):
    """A bounded set of queries as arrays: ``terms`` of all, their weights, and for each query the places of its terms."""

    place: dict[bytes, int]
    weights: np.ndarray
    starts: np.ndarray
    of_query: np.ndarray

    @property
    def n(self) -> int:
        return len(self.starts) - 1


def frequencies(blocks: DataFrame, sent) -> dict[int, int]:
    """Documents that hold each term of ``sent``, a set of terms with places; blocks add up their own documents first."""
    schema = pa.schema([("place", pa.int32()), ("df", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = sent.value
        found: Counter = Counter()
        for vocabulary, df in rows_of(batches, "vocabulary", "df"):
            for at, n in zip(map(place.get, vocabulary.split()), np.frombuffer(df, dtype=INT).tolist(), strict=True):
                if at is not None:
                    found[at] += n
        if found:
            yield arrow(schema, zip(*found.items(), strict=True))

    return {r.place: r.df for r in blocks.select("vocabulary", "df").mapInArrow(run, "place int, df long").groupBy("place").agg(F.sum("df").alias("df")).collect()}


def arrays(rows: list, place: dict[bytes, int], n_docs: int, df: dict[int, int]) -> Queries:
    """Terms that no document holds keep a weight of 0."""
    weights = np.array([weight(n_docs, df[i]) if i in df else 0 for i in range(len(place))], dtype=np.int64)
    of_query = [place[bytes(t)] for r in rows for t in r.terms]
    return Queries(place, weights, np.cumsum([0, *(len(r.terms) for r in rows)]), np.array(of_query, dtype=np.int64))


class Block(NamedTuple):
    """A block cut down to the terms of the queries."""

    name: str
    ids: list[int | None]
    starts: np.ndarray
    term: np.ndarray
    part: np.ndarray


def opened(row: dict, queries: Queries, index: Index) -> Block:
    place = np.array([queries.place.get(t, -1) for t in row["vocabulary"].split()], dtype=np.int64)
    lengths, counts, entries, tf = (np.frombuffer(row[c], dtype=INT) for c in ("lengths", "counts", "entries", "tf"))
    term, tf, length = place[entries], tf.astype(np.int64), np.repeat(lengths.astype(np.int64), counts)
    doc = np.repeat(np.arange(len(counts)), counts)
    hit = term >= 0
    part = impacts(tf[hit], length[hit], index.n_docs, index.n_terms)
    starts = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(np.bincount(doc[hit], minlength=len(counts)), out=starts[1:])
    return Block(row["block"], row["ids"], starts, term[hit], part)


def bounds(block: Block, queries: Queries) -> np.ndarray:
    """For each query, the sum of its terms' largest parts in the block."""
    most = np.zeros(len(queries.weights), dtype=np.int64)
    np.maximum.at(most, block.term, block.part)
    sums = np.concatenate([[0], np.cumsum((most * queries.weights)[queries.of_query])])
    return sums[queries.starts[1:]] - sums[queries.starts[:-1]]


def scores(block: Block, queries: Queries, q: int) -> np.ndarray:
    """The scores of all documents of a block for one query."""
    weights = np.zeros(len(queries.weights), dtype=np.int64)
    own = queries.of_query[queries.starts[q] : queries.starts[q + 1]]
    weights[own] = queries.weights[own]
    sums = np.concatenate([[0], np.cumsum(weights[block.term] * block.part)])
    return sums[block.starts[1:]] - sums[block.starts[:-1]]


class Best:
    """The k best documents of each query so far: highest score, then smallest id, null last."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor
        self.kept: list[list[tuple[int, bool, int]]] = [[] for _ in range(n)]

    def threshold(self, q: int) -> int:
        held = self.kept[q]
        return max(int(self.floor[q]), held[-1][0] if len(held) == self.k else 0, 1)

    def offer(self, q: int, ids: list[int | None], found: np.ndarray) -> None:
        hits = np.nonzero(found >= self.threshold(q))[0]
        if len(hits):
            mixed = self.kept[q] + [(int(found[i]), ids[i] is None, ids[i] or 0) for i in hits]
            self.kept[q] = sorted(mixed, key=lambda x: (-x[0], x[1], x[2]))[: self.k]

    def rows(self) -> Iterator[tuple[int, int | None, int]]:
        return ((q, None if null else doc_id, score) for q, held in enumerate(self.kept) for score, null, doc_id in held)


def opened_batches(batches: Iterator[pa.RecordBatch], queries: Queries, index: Index) -> Iterator[Block]:
    """Blocks one at a time: only one is out of its batch."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield opened({n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns, strict=True)}, queries, index)


def promising(blocks: DataFrame, sent, index: Index, k: int) -> DataFrame:
    """``query, block``: the blocks with the highest bounds of each query."""
    schema = pa.schema([("query", pa.int32()), ("block", pa.string()), ("bound", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = sent.value
        best: list[list[tuple[int, str]]] = [[] for _ in range(queries.n)]
        for block in opened_batches(batches, queries, index):
            found = bounds(block, queries)
            for q in np.nonzero(found)[0]:
                held = best[q]
                if len(held) < k or found[q] > held[-1][0]:
                    held.append((int(found[q]), block.name))
                    held.sort(key=lambda x: (-x[0], x[1]))
                    del held[k:]
        rows = [(q, name, bound) for q, held in enumerate(best) for bound, name in held]
        if rows:
            yield arrow(schema, zip(*rows, strict=True))

    found = blocks.mapInArrow(run, "query int, block string, bound long")
    own = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
    return found.withColumn("i", F.row_number().over(own)).where(F.col("i") <= k).select("query", "block")


def scored(blocks: DataFrame, sent, index: Index, k: int, floor: np.ndarray, only: dict[str, list[int]] | None = None) -> DataFrame:
    """``query, doc_id, score``: the k best documents of each task, none below ``floor``; with ``only``, of these queries in these blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = sent.value
        best = Best(queries.n, k, floor)

        def settle(held: list[Block]) -> None:
            table = np.array([bounds(b, queries) for b in held])
            if only is not None:
                asked = np.zeros_like(table)
                for i, b in enumerate(held):
                    asked[i, only[b.name]] = table[i, only[b.name]]
                table = asked
            for q in range(queries.n):
                for i in np.argsort(-table[:, q], kind="stable"):
                    if table[i, q] < best.threshold(q):
                        break
                    best.offer(q, held[i].ids, scores(held[i], queries, q))

        held: list[Block] = []
        for block in opened_batches(batches, queries, index):
            held.append(block)
            if len(held) == TOGETHER:
                settle(held)
                held = []
        if held:
            settle(held)
        rows = list(best.rows())
        if rows:
            yield arrow(SCORES, zip(*rows, strict=True))

    return blocks.mapInArrow(run, "query int, doc_id long, score long")


def top(found: DataFrame, k: int) -> DataFrame:
    own = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item_id, terms``: the distinct terms of each query."""
    split = F.regexp_extract_all(F.translate(text_col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), 0)
    rows = queries.select(F.col(id_col).alias("item_id"), F.explode(F.array_distinct(split).cast("array<binary>")).alias("term")).distinct()
    return rows.groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))


def search(index: Index, queries: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents with a score above 0 of each query.

    Queries are numbered and answered in groups of at most ``QUERY_BYTES`` of terms, each group in passes over the
    index; only a group comes to the driver and goes to the tasks.
    """
    spark = queries.sparkSession
    blocks = index.blocks(spark)
    asked = query_terms(queries, id_col, text_col)
    asked = asked.withColumn("size", F.aggregate("terms", F.lit(64).cast("long"), lambda s, t: s + F.octet_length(t) + 16))
    n_groups = 1 + (asked.agg(F.sum("size").alias("s")).first().s or 0) * 2 // QUERY_BYTES
    asked = asked.withColumn("group", F.pmod(F.xxhash64("item_id"), F.lit(n_groups)))
    found = [answered(index, blocks, asked.where(F.col("group") == g), k) for g in range(n_groups)]
    return reduce(DataFrame.unionByName, found)


def answered(index: Index, blocks: DataFrame, own: DataFrame, k: int) -> DataFrame:
    """The k best documents of one bounded group of queries."""
    spark = own.sparkSession
    rows = own.select("item_id", "terms").orderBy("item_id").collect()
    place = {t: i for i, t in enumerate(sorted({bytes(t) for r in rows for t in r.terms}))}
    queries = arrays(rows, place, index.n_docs, frequencies(blocks, spark.sparkContext.broadcast(place)))
    sent = spark.sparkContext.broadcast(queries)
    first: dict[str, list[int]] = {}
    for r in promising(blocks, sent, index, PROMISING).collect():
        first.setdefault(r.block, []).append(r.query)
    floor, none = np.zeros(queries.n, dtype=np.int64), np.zeros(queries.n, dtype=np.int64)
    for r in top(scored(blocks.where(F.col("block").isin(list(first))), sent, index, k, none, first), k).where(F.col("rank") == k).select("query", "score").collect():
        floor[r.query] = r.score
    found = top(scored(blocks, sent, index, k, floor), k)
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"query int, item_id {own.schema['item_id'].dataType.simpleString()}")
    return found.join(names, "query").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Index, search, and delete the index: ``item_id, rank, doc_id, score``."""
    index = build(docs)
    found = cut(search(index, queries, k))
    discard(docs.sparkSession, index.path)
    return found

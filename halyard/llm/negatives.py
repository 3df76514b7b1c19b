"""Hard-negative mining with bit-sliced integer products.

Vectors become integers, ``floor(scale * x)``. A row's components are cut into bit-planes, in two's
complement: a component is the sum of its planes, each a bit times a power of two, the highest one
negative. Products with an anchor are added plane by plane, most significant first. With r planes left, what is
still to come lies between ``(2^r - 1)`` times the anchor's negative components and as many times
its positive ones, so every product has an interval that halves with each plane. A pair is dropped once its
interval cannot meet what is asked: to be among the best positives seen so far, or to lie in a window
of some positive of its anchor. Pairs that live through all planes have their exact product.

Anchors come in blocks of bounded bytes that are sent to the tasks; rows stay where they are and are
met in blocks; a task gives at most k rows for an anchor and question, and no label or anchor is gathered.

Defined results. Rows with a null id, label or vector, or with a null or non-finite component take no
part. Rows that repeat an id are separate rows, but none is a partner of an anchor of its id; anchors that
repeat an id are separate anchors, whose rows both appear. Shorter vectors count as filled with zeros, an
empty vector has the product zero. Ties go to the smaller id. Components need not be small: planes are as
many as the largest component of a block needs, and products beyond 64 bits raise an error. An empty table, or one without anchors,
gives no rows. Only the named columns are read, so other names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm.common import arrow
from halyard.session import cut

#: Bytes of one block of anchors, and the numbers of anchors and of rows that a task multiplies at once.
ANCHOR_BYTES, ANCHORS, ROWS = 32 << 20, 512, 2048
#: Below this share of pairs, a block goes from whole matrices to the pairs that are left.
DENSE_SHARE = 0.01

SCHEMA = "vec_id long, label int, v array<long>"


def integers(embeddings: DataFrame, scale: int = 256, label: Column | None = None) -> DataFrame:
    """``vec_id, label, v``: the rows that take part, with integer components."""
    x = F.col("embedding").cast("array<double>")
    fit = ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(fit)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("int").alias("label"), F.transform(x, lambda e: F.floor(e * scale)).alias("v"))


class Vectors(NamedTuple):
    """Ids, labels and components, as arrays."""

    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray

    def part(self, start: int, n: int) -> Vectors:
        return Vectors(self.ids[start : start + n], self.labels[start : start + n], self.v[start : start + n])


def vectors(table: pa.RecordBatch | pa.Table) -> Vectors:
    lists = table.column("v")
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    v = np.zeros((len(lengths), int(lengths.max(initial=0))), dtype=np.int64)
    v[np.arange(v.shape[1]) < lengths[:, None]] = flat
    return Vectors(table.column("vec_id").to_numpy(), table.column("label").to_numpy(), v)


def common_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both without the positions where one has only the zeros it is filled with."""
    n = min(a.shape[1], b.shape[1])
    return a[:, :n], b[:, :n]


def planes(v: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(power, bits) of the bit-planes, most significant first; the first counts as negative."""
    top = int(max(v.max(initial=0), -v.min(initial=0) - 1)).bit_length()
    return [(r, (v >> r) & 1) for r in range(top, -1, -1)]


class Products:
    """The products of a block of anchors with a block of rows, as intervals that ``tighten``."""

    def __init__(self, anchors: np.ndarray, rows: np.ndarray):
        a, b = common_width(anchors, rows)
        largest = int(np.abs(a).sum(axis=1).max(initial=0)) * (2 * int(np.abs(b).max(initial=0)) + 2)
        if 100 * largest >= 1 << 63:
            raise OverflowError("products beyond 64 bits")
        #: Floats multiply fastest, and are exact below 2^53.
        self.a = a.astype(np.float64 if largest < 1 << 53 else np.int64)
        self.planes = planes(b)
        self.least, self.most = np.minimum(a, 0).sum(axis=1), np.maximum(a, 0).sum(axis=1)
        self.pairs: tuple[np.ndarray, np.ndarray] = ()
        self.sums = np.zeros((len(a), len(b)), dtype=np.int64)
        self.dense, self.alive = True, np.ones((len(a), len(b)), dtype=bool)
        self.left = len(self.planes)

    def tighten(self) -> None:
        """Add the next plane."""
        power, bits = self.planes[len(self.planes) - self.left]
        weight = -(1 << power) if self.left == len(self.planes) else 1 << power
        self.left -= 1
        if self.dense:
            self.sums += (weight * (self.a @ bits.T.astype(self.a.dtype))).astype(np.int64)
        else:
            i, j = self.pairs
            self.sums += (weight * np.einsum("ij,ij->i", self.a[i], bits[j].astype(self.a.dtype))).astype(np.int64)

    def intervals(self) -> tuple[np.ndarray, np.ndarray]:
        rest = (1 << self.left) - 1
        if self.dense:
            return self.sums + rest * self.least[:, None], self.sums + rest * self.most[:, None]
        i = self.pairs[0]
        return self.sums + rest * self.least[i], self.sums + rest * self.most[i]

    def keep(self, wanted: np.ndarray) -> None:
        """Drop pairs; once few are left, go on with these pairs alone."""
        if self.dense:
            self.alive &= wanted
            if self.alive.mean() <= DENSE_SHARE:
                self.pairs = np.nonzero(self.alive)
                self.sums, self.dense = self.sums[self.alive], False
        else:
            self.pairs = tuple(p[wanted] for p in self.pairs)
            self.sums = self.sums[wanted]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, row and exact product of the pairs that are left."""
        if self.dense:
            i, j = np.nonzero(self.alive)
            return i, j, self.sums[self.alive]
        return *self.pairs, self.sums


def firsts(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores of each group, ties to the smaller id, in order of group."""
    order = np.lexsort((ids, -score, group))
    sorted_group = group[order]
    starts = np.r_[True, sorted_group[1:] != sorted_group[:-1]]
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(starts, np.arange(len(order)), 0))
    return order[rank < k]


class Kept:
    """The k best (score, id) of each group so far, and the least score that still counts."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.group, self.score, self.ids = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.floor = np.full(n, np.iinfo(np.int64).min)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(group):
            return
        group, score, ids = (np.concatenate(x) for x in ((self.group, group), (self.score, score), (self.ids, ids)))
        best = firsts(group, score, ids, self.k)
        self.group, self.score, self.ids = group[best], score[best], ids[best]
        full = np.bincount(self.group, minlength=len(self.floor)) >= self.k
        least = np.full(len(self.floor), np.iinfo(np.int64).max)
        np.minimum.at(least, self.group, self.score)
        self.floor[full] = least[full]


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Vectors]:
    for batch in batches:
        whole = vectors(batch)
        for start in range(0, len(whole.ids), ROWS):
            yield whole.part(start, ROWS)


def positives_of(anchors: Vectors, batches: Iterator[pa.RecordBatch], k: int) -> list[Kept]:
    """The k best other rows of each anchor's label among the rows of a task, by blocks of anchors."""
    parts = [anchors.part(start, ANCHORS) for start in range(0, len(anchors.ids), ANCHORS)]
    kept = [Kept(len(some.ids), k) for some in parts]
    for rows in blocks_of(batches):
        for some, held in zip(parts, kept, strict=True):
            p = Products(some.v, rows.v)
            p.keep((some.labels[:, None] == rows.labels) & (some.ids[:, None] != rows.ids))
            while p.left:
                p.tighten()
                high = p.intervals()[1]
                p.keep(high >= (held.floor[:, None] if p.dense else held.floor[p.pairs[0]]))
            i, j, score = p.found()
            held.add(i, score, rows.ids[j])
    return kept


class Windows(NamedTuple):
    """Score windows ``[low, high]`` of anchors, sorted by ``owner``, the place of the anchor."""

    owner: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def part(self, start: int, n: int) -> Windows:
        a, b = np.searchsorted(self.owner, [start, start + n])
        return Windows(self.owner[a:b] - start, self.low[a:b], self.high[a:b])


def negatives_of(anchors: Vectors, windows: Windows, batches: Iterator[pa.RecordBatch], k: int) -> list[Kept]:
    """The k best rows of another label in each window, by blocks of anchors.

    Once a window holds k rows its lower end rises to the least of them.
    """
    parts = [(anchors.part(start, ANCHORS), windows.part(start, ANCHORS)) for start in range(0, len(anchors.ids), ANCHORS)]
    kept = [Kept(len(w.owner), k) for _, w in parts]
    for rows in blocks_of(batches):
        for (some, w), held in zip(parts, kept, strict=True):
            if len(w.owner):
                held.add(*inside(some, w, held, rows))
    return kept


def inside(some: Vectors, w: Windows, held: Kept, rows: Vectors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window, score and id of the rows that lie in windows of a block of anchors."""
    n, low = len(some.ids), np.maximum(w.low, held.floor)
    least, most = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(least, w.owner, low)
    np.maximum.at(most, w.owner, w.high)
    p = Products(some.v, rows.v)
    p.keep((some.labels[:, None] != rows.labels) & (some.ids[:, None] != rows.ids) & (least <= most)[:, None])
    while p.left:
        p.tighten()
        lower, upper = p.intervals()
        if p.dense:
            p.keep((upper >= least[:, None]) & (lower <= most[:, None]))
        else:
            i = p.pairs[0]
            p.keep((upper >= least[i]) & (lower <= most[i]))
    i, j, score = p.found()
    edges = np.searchsorted(w.owner, np.arange(n + 1))
    size = edges[i + 1] - edges[i]
    pair = np.repeat(np.arange(len(i)), size)
    window = np.repeat(edges[i] - np.cumsum(size) + size, size) + np.arange(len(pair))
    fit = (score[pair] >= low[window]) & (score[pair] <= w.high[window])
    return window[fit], score[pair[fit]], rows.ids[j[pair[fit]]]


FOUND = pa.schema([("place", pa.int64()), ("score", pa.int64()), ("partner", pa.int64())])


def numbered(kept: list[Kept]) -> Iterator[pa.RecordBatch]:
    """The groups of all blocks under numbers that run on."""
    start = 0
    for held in kept:
        yield arrow(FOUND, (held.group + start, held.score, held.ids))
        start += len(held.floor)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, least_percent: int = 80, of_percent: int = 100) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for ``rows`` (``vec_id, label, v``).

    A negative's score is between ``least_percent`` and ``of_percent`` hundredths of its positive's.
    """
    anchors = rows.where(is_anchor)
    size = anchors.agg(F.sum(F.size("v") * 8 + 64).alias("bytes")).first().bytes or 0
    n = 1 + size * 2 // ANCHOR_BYTES
    key = F.pmod(F.xxhash64("vec_id"), F.lit(n))
    found = [answered(rows, anchors.where(key == i), positives, negatives, least_percent, of_percent) for i in range(n)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def answered(rows: DataFrame, own: DataFrame, positives: int, negatives: int, least_percent: int, of_percent: int) -> DataFrame:
    """The results of one block of anchors."""
    spark = rows.sparkSession
    anchors = vectors(own.orderBy("vec_id", "label", "v").toArrow())
    sent = spark.sparkContext.broadcast(anchors)
    names = "place long, score long, partner long"
    best = top(rows.mapInArrow(lambda batches: numbered(positives_of(sent.value, batches, positives)), names), positives)
    table = best.select("place", "score", "partner").orderBy("place", F.desc("score"), "partner").toArrow()
    owner, score, partner = (table.column(c).to_numpy() for c in ("place", "score", "partner"))
    windows = spark.sparkContext.broadcast(Windows(owner, -((-least_percent * score) // 100), (of_percent * score) // 100))
    found = top(rows.mapInArrow(lambda batches: numbered(negatives_of(sent.value, windows.value, batches, negatives)), names), negatives)
    named = spark.createDataFrame(pa.table({"place": np.arange(len(owner)), "anchor_id": anchors.ids[owner], "positive_id": partner, "positive_score": score}))
    return found.withColumnsRenamed({"partner": "negative_id", "score": "negative_score"}).join(named, "place").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def top(found: DataFrame, k: int) -> DataFrame:
    own = Window.partitionBy("place").orderBy(F.desc("score"), "partner")
    return found.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


def hard_negatives(embeddings: DataFrame, every: int = 100, mislabelled: int = 7, labels: int = 10) -> DataFrame:
    """Mines with every ``every``-th row as anchor, after moving the label of every ``mislabelled``-th row to the next."""
    label = F.when(F.col("vec_id") % mislabelled == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return mine(cut(integers(embeddings, label=label)), F.col("vec_id") % every == 0)

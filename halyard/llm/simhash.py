"""Near-duplicates by SimHash, with a Gray-order hierarchical index.

Fingerprints are 64 bits, one majority vote per bit over the XXH64 values of word shingles. Two
fingerprints link if they differ in at most ``max_bits`` bits, and documents get the smallest id that
is reachable over links.

The index has three kinds of nodes. Upper nodes are masked bit patterns: 64 bits are cut into
``max_bits + 2`` blocks, and a node is a choice of two blocks with the bits that its members share
there. ``max_bits`` differences leave two blocks or more untouched, so every linked pair meets below
one of these nodes, and nodes are what Spark shuffles by. Below such a node, fingerprints are sorted
by their rank in the Gray sequence and grouped; each group holds the bits that all its members share
and that its parent has not yet accounted for. A search adds up differences on the way down and
leaves a whole group once they exceed the threshold, or once the group is already connected with the
searching fingerprint, so a dense group costs a spanning tree and not all its pairs.

Only distinct fingerprints enter the index, so exact copies are one entry however many there are.
Components come from repeated contraction of links in Spark; nothing is collected to the driver.

``near_duplicates`` is that, for bits. ``representatives`` is for similarity of texts: two sets of
shingles of similarity 0.8 differ in about 15 % of the bits, which no choice of untouched blocks of 64
bits can cover, so it takes fingerprints of 128 bits and, as upper nodes, masks of 16 bits: eight ways
of dealing 128 bits into eight masks. A pair of similarity 0.8 shares one of the 64 patterns and stays
within 26 bits with a probability of 0.92, one of 0.85 with 0.98 (``recall`` has the numbers). What the
index links is only a candidate: the shingle sets are compared, and groups come from those links alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import bounded, rows_of, signed, utf8, word_spans
from halyard.session import Rounds, cut

SEED = 42
BITS = 64
FANOUT = 16
LEAF_BUCKET = 48
PART_ENTRIES = 2 << 20
WORDS = 2  # words of the wide fingerprint
NODE_BITS, WAYS = 16, 8
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 250_000
SETTLED_EDGES = 200_000  # so many edges, some 50 MB, are connected in one task
QUERY_BLOCK = 512
SEARCH_PAIRS = 4 << 20  # a block of searches visits at most so many words of leaves at once


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """The unsigned SimHash of a text; zero if it has no words."""
    return vote(np.array(hashed(text, shingle), dtype=np.uint64))


def hashed(text: bytes | None, shingle: int) -> list[int]:
    """XXH64 of each run of so many words, or of all words if there are no more."""
    words = (text or b"").lower().split()
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    buffer, starts, ends = word_spans(words)
    digest = xxhash.xxh64_intdigest
    return [digest(buffer[s:e], SEED) for s, e in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]


def vote(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    votes = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = np.ascontiguousarray(hashes[at : at + (1 << 14)], dtype="<u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def mixed(hashes: np.ndarray) -> np.ndarray:
    """Another 64 bits from each hash, by a multiplicative mixer."""
    x = hashes + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code word in the reflected Gray sequence."""
    rank = codes.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank ^ (rank >> np.uint64(shift))
    return rank


def block_masks(max_bits: int) -> list[int]:
    """Masks of the upper nodes: two of ``max_bits + 2`` blocks of bits."""
    blocks = max_bits + 2
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    single = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(blocks)]
    return [a | b for a, b in combinations(single, 2)]


class Labels:
    """Connected components of items by smallest item, over links that come in blocks."""

    def __init__(self, n: int):
        self.of = np.arange(n, dtype=np.int64)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.of[a], self.of[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.of, np.maximum(x, y), np.minimum(x, y))
            self.flatten()

    def flatten(self) -> None:
        while True:
            up = self.of[self.of]
            if np.array_equal(up, self.of):
                return
            self.of = up


def differing(a: np.ndarray, b: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """How many bits (of ``mask``) differ; the last axis holds the words of a fingerprint."""
    x = np.bitwise_count(a ^ b if mask is None else (a ^ b) & mask)
    return x[..., 0] if x.shape[-1] == 1 else x.sum(axis=-1, dtype=np.uint16)


def worded(codes: np.ndarray) -> np.ndarray:
    """Fingerprints as rows of 64-bit words."""
    return codes[:, None] if codes.ndim == 1 else codes


class GrayTree:
    """Groups of fingerprints in Gray order; a group holds the shared bits its parent lacks."""

    def __init__(self, codes: np.ndarray):
        self.codes = worded(codes)
        low, high = self.codes, self.codes
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        shared = []
        while True:
            cuts = np.arange(0, len(low), FANOUT)
            low, high = np.bitwise_and.reduceat(low, cuts), np.bitwise_or.reduceat(high, cuts)
            shared.append((~(low ^ high), low))
            if len(low) <= FANOUT:
                break
        for k, (mask, pattern) in enumerate(shared):
            above = shared[k + 1][0][np.arange(len(mask)) // FANOUT] if k + 1 < len(shared) else np.uint64(0)
            self.levels.append((mask & ~above, pattern))
        self.leaf_mask = shared[0][0]

    def search(self, queries: np.ndarray, max_bits: int, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, item) within ``max_bits`` that are not connected yet; queries are indexes."""
        uniform = [labels]
        for _ in self.levels:
            below = uniform[-1]
            cuts = np.arange(0, len(below), FANOUT)
            least, most = np.minimum.reduceat(below, cuts), np.maximum.reduceat(below, cuts)
            uniform.append(np.where(least == most, least, -1))
        top = len(self.levels) - 1
        q = np.repeat(queries, len(self.levels[top][0]))
        node = np.tile(np.arange(len(self.levels[top][0])), len(queries))
        done = np.zeros(len(q), dtype=np.uint8)
        for k in range(top, -1, -1):
            mask, pattern = self.levels[k]
            done = done + differing(self.codes[q], pattern[node], mask[node])
            keep = (done <= max_bits) & (uniform[k + 1][node] != labels[q])
            q, node, done = q[keep], node[keep], done[keep]
            child = node[:, None] * FANOUT + np.arange(FANOUT)
            inside = child < len(uniform[k])
            q, done = np.broadcast_to(q[:, None], child.shape)[inside], np.broadcast_to(done[:, None], child.shape)[inside]
            node = child[inside]
        if not len(node):
            return q, node
        rest = ~self.leaf_mask[node // FANOUT]
        done = done + differing(self.codes[q], self.codes[node], rest)
        keep = (done <= max_bits) & (labels[q] != labels[node])
        return q[keep], node[keep]


def search_block(codes: np.ndarray) -> int:
    return max(1, min(QUERY_BLOCK, SEARCH_PAIRS // (len(codes) * worded(codes).shape[1])))


def bucket_links(codes: np.ndarray, max_bits: int) -> np.ndarray:
    """Component labels (indexes) of one large bucket; ``codes`` in Gray order."""
    codes = worded(codes)
    labels = Labels(len(codes))
    near = np.flatnonzero(differing(codes[:-1], codes[1:]) <= max_bits)
    labels.link(near, near + 1)
    tree = GrayTree(codes)
    block = search_block(codes)
    for at in range(0, len(codes), block):
        labels.link(*tree.search(np.arange(at, min(at + block, len(codes))), max_bits, labels.of))
    return labels.of


def gray_order(codes: np.ndarray, *first: np.ndarray) -> np.ndarray:
    """Indexes that sort by ``first`` and then by Gray rank, word by word."""
    codes = worded(codes)
    return np.lexsort((*(gray_rank(codes[:, w]) for w in reversed(range(codes.shape[1]))), *reversed(first)))


def bucket_bounds(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal, sorted keys start, and how long they are."""
    n = len(keys[0])
    fresh = np.zeros(n, dtype=bool)
    for k in keys:
        fresh[1:] |= k[1:] != k[:-1]
    fresh[:1] = True
    starts = np.flatnonzero(fresh)
    return starts, np.diff(np.r_[starts, n])


def connected(nodes: np.ndarray, codes: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (item, item of its component) as indexes, below the upper nodes of one partition."""
    codes = worded(codes)
    order = gray_order(codes, nodes)
    nodes, codes = nodes[order], codes[order]
    starts, sizes = bucket_bounds(nodes)
    labels = Labels(len(codes))
    small = np.flatnonzero(np.repeat(sizes <= LEAF_BUCKET, sizes))
    left = np.repeat(starts + sizes, sizes) - np.arange(len(codes))  # how many members come from here on
    for shift in range(1, LEAF_BUCKET):
        small = small[left[small] > shift]
        if not len(small):
            break
        near = small[differing(codes[small], codes[small + shift]) <= max_bits]
        labels.link(near, near + shift)
    for s, n in zip(starts[sizes > LEAF_BUCKET].tolist(), sizes[sizes > LEAF_BUCKET].tolist(), strict=True):
        labels.of[s : s + n] = bucket_links(codes[s : s + n], max_bits) + s
    member = np.flatnonzero(labels.of != np.arange(len(codes)))
    return order[member], order[labels.of[member]]


def partition_links(nodes: np.ndarray, codes: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (code, code of its component) below the upper nodes of one partition."""
    member, root = connected(nodes, codes, max_bits)
    return codes[member], codes[root]


def partition_pairs(kinds: np.ndarray, nodes: np.ndarray, codes: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (code, code) within ``max_bits`` below the upper nodes of one partition, each at the first node it has."""
    masks = np.array(block_masks(max_bits), dtype=np.uint64)
    order = gray_order(codes, kinds, nodes)
    kinds, nodes, codes = kinds[order], nodes[order], codes[order]
    starts, sizes = bucket_bounds(kinds, nodes)

    def first(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        apart, new = codes[a] ^ codes[b], np.ones(len(a), dtype=bool)
        for k in range(int(kinds[a].max(initial=0))):
            new &= (kinds[a] <= k) | ((apart & masks[k]) != 0)
        return codes[a[new]], codes[b[new]]

    small = np.flatnonzero(np.repeat(sizes <= LEAF_BUCKET, sizes))
    left = np.repeat(starts + sizes, sizes) - np.arange(len(codes))
    for shift in range(1, LEAF_BUCKET):
        small = small[left[small] > shift]
        if not len(small):
            break
        near = small[np.bitwise_count(codes[small] ^ codes[small + shift]) <= max_bits]
        yield first(near, near + shift)
    for s, n in zip(starts[sizes > LEAF_BUCKET].tolist(), sizes[sizes > LEAF_BUCKET].tolist(), strict=True):
        tree, apart = GrayTree(codes[s : s + n]), np.arange(n)
        block = search_block(codes[s : s + n])
        for at in range(0, n, block):
            q, item = tree.search(np.arange(at, min(at + block, n)), max_bits, apart)
            yield first(s + q[q < item], s + item[q < item])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: the fingerprint of each row as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from bounded(((i, signed(fingerprint(t, shingle))) for i, t in rows_of(batches, "doc_id", "text")), schema)

    return utf8(docs.withColumn(id_col, F.col(id_col).cast("long")), id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def parts_for(codes: DataFrame, masks: int) -> int:
    """Partitions of about ``PART_ENTRIES`` entries of the index, and no fewer than the session has."""
    return max(int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-codes.count() * masks // PART_ENTRIES))


def links(codes: DataFrame, max_bits: int = 4) -> DataFrame:
    """``a, b``: links that connect the distinct fingerprints in ``codes.fp`` as all pairs would."""
    masks = F.array(*(F.lit(signed(m)) for m in block_masks(max_bits)))
    placed = codes.select("fp", F.posexplode(masks).alias("kind", "mask")).select(F.xxhash64("kind", F.col("fp").bitwiseAND(F.col("mask"))).alias("node"), "fp")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [(b.column("node").to_numpy(), b.column("fp").to_numpy()) for b in batches]
        if not read:
            return
        node, fp = (np.concatenate(x) for x in zip(*read, strict=True))
        a, b = partition_links(node, fp.view(np.uint64), max_bits)
        for at in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000].view(np.int64)) for x in (a, b)], schema=schema)

    return placed.repartition(parts_for(codes, len(block_masks(max_bits))), "node").mapInArrow(run, "a long, b long").distinct()


def pairs(codes: DataFrame, max_bits: int) -> DataFrame:
    """``a, b``: every pair of the distinct fingerprints in ``codes.fp`` within ``max_bits``, once."""
    masks = F.array(*(F.lit(signed(m)) for m in block_masks(max_bits)))
    placed = codes.select("fp", F.posexplode(masks).alias("kind", "mask")).select(F.col("kind").cast("long").alias("kind"), F.xxhash64("kind", F.col("fp").bitwiseAND(F.col("mask"))).alias("node"), "fp")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [(b.column("kind").to_numpy(), b.column("node").to_numpy(), b.column("fp").to_numpy()) for b in batches]
        if not read:
            return
        kind, node, fp = (np.concatenate(x) for x in zip(*read, strict=True))
        for found in partition_pairs(kind, node, fp.view(np.uint64), max_bits):
            for at in range(0, len(found[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[at : at + 100_000]).view(np.int64)) for x in found], schema=schema)

    return placed.repartition(parts_for(codes, len(block_masks(max_bits))), "node").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root``: a common root for all nodes that edges (a, b) connect.

    Each round hooks every node to the neighbour (or itself) with the least hash of that round and
    contracts the edges, so a constant share of nodes goes in expectation, whatever the ids are. Once no
    more than ``SETTLED_EDGES`` edges are left, one task connects them.
    """
    held = Rounds(edges.sparkSession)
    edges = held.keep(edges)
    reach = None
    for turn in range(rounds):
        if edges.count() <= SETTLED_EDGES:
            rest = settled(edges)
            if reach is None:
                return rest
            return reach.join(rest.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", F.lit(turn)).alias("h"), "b")).alias("m"))
        own = F.struct(F.xxhash64("a", F.lit(turn)).alias("h"), F.col("a").alias("b"))
        hook = held.keep(best.select(F.col("a").alias("node"), F.least(F.col("m"), own)["b"].alias("up")))
        if reach is None:
            reach = hook.select("node", F.col("up").alias("root"))
        else:
            moved = hook.select(F.col("node").alias("root"), "up")
            reach = held.keep(reach.join(moved, "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        first = hook.select(F.col("node").alias("a"), F.col("up").alias("x"))
        second = hook.select(F.col("node").alias("b"), F.col("up").alias("y"))
        edges = held.keep(edges.join(first, "a").join(second, "b").where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        held.turn()
    raise RuntimeError("components did not settle")


def settled(edges: DataFrame) -> DataFrame:
    """As :func:`components`, in one task, for no more than ``SETTLED_EDGES`` edges."""
    kind = edges.schema["a"].dataType.simpleString()
    schema = pa.schema([(c, pa.int64() if kind == "bigint" else pa.binary()) for c in ("node", "root")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def find(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = y
            return x

        for a, b in rows_of(batches, "a", "b"):
            x, y = find(a), find(b)
            if x != y:
                up[max(x, y)] = min(x, y)
        yield from bounded(((x, find(x)) for x in list(up)), schema)

    return edges.select("a", "b").coalesce(1).mapInArrow(run, f"node {kind}, root {kind}")


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id``, a row for each row of ``docs``.

    A null or wordless text has fingerprint zero and links as any other. ``component_id`` is the
    smallest non-null id of the component (null if all are null). Repeated rows stay repeated; other
    columns of ``docs`` are not read. An empty table gives an empty result.
    """
    marked = cut(fingerprints(docs, shingle, id_col, text_col))
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes.select("fp"), max_bits))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def similarity(a: bytes | None, b: bytes | None, shingle: int) -> float:
    """Jaccard similarity of the shingle sets; 1 for two texts without words."""
    x, y = set(hashed(a, shingle)), set(hashed(b, shingle))
    return len(x & y) / len(x | y) if x or y else 1.0


def text_key(text: Column) -> Column:
    """Sixteen bytes that are equal for texts with the same words, whatever their case (ASCII) and spacing."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), letters.upper(), letters)
    return F.unhex(F.md5(F.trim(F.regexp_replace(plain, r"[ \t\n\x0B\f\r]+", " "))))


def key_of(text: bytes | None) -> bytes:
    """As :func:`text_key`."""
    return hashlib.md5(b" ".join((text or b"").lower().split()), usedforsecurity=False).digest()


def dealt_masks(node_bits: int = NODE_BITS, ways: int = WAYS) -> np.ndarray:
    """Masks (rows of words) of ``ways`` deals of all bits into masks of ``node_bits``, the same in every run."""
    rng = np.random.default_rng(SEED)
    out = []
    for _ in range(ways):
        bits = rng.permutation(WORDS * BITS)
        for at in range(0, len(bits) - node_bits + 1, node_bits):
            mask = np.zeros(WORDS * BITS, dtype=np.uint8)
            mask[bits[at : at + node_bits]] = 1
            out.append(np.packbits(mask, bitorder="little").view("<u8"))
    return np.array(out, dtype=np.uint64)


def recall(similar: float, max_bits: int, node_bits: int = NODE_BITS, ways: int = WAYS, trials: int = 20_000) -> float:
    """The share of pairs of this similarity (sets of one size) that the wide index links, by simulation."""
    rng = np.random.default_rng(SEED)
    off = rng.random((trials, WORDS * BITS)) < np.arccos(2 * similar / (1 + similar)) / np.pi
    masks = np.unpackbits(dealt_masks(node_bits, ways).view(np.uint8), axis=1, bitorder="little").astype(np.float32)
    return float((((off.astype(np.float32) @ masks.T) == 0).any(axis=1) & (off.sum(axis=1) <= max_bits)).mean())


def representatives(
    docs: DataFrame,
    shingle: int = 5,
    max_bits: int = 26,
    least: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    node_bits: int = NODE_BITS,
    ways: int = WAYS,
    block_docs: int = BLOCK_DOCS,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """``doc_id, key`` of the texts that stay: the smallest id of each group of near-duplicates.

    Texts with one key are copies. Other texts are in one group if a chain of pairs with a similarity of
    ``least`` or more joins them; pairs are found by the wide index (``max_bits``, ``node_bits``,
    ``ways``) and all compared by their shingle sets. A null id comes after all others. Null and
    wordless texts are copies of each other. Repeated rows count once; other columns are not read, so
    their names cannot clash; an empty table gives an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("f0", pa.int64()), ("f1", pa.int64()), ("n", pa.int64())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(i: int | None, text: bytes | None) -> tuple:
            found = np.array(hashed(text, shingle), dtype=np.uint64)
            return i, key_of(text), signed(vote(found)), signed(vote(mixed(found))), len(np.unique(found))

        yield from bounded((row(*r) for r in rows_of(batches, "doc_id", "text")), schema)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    marked = texts.mapInArrow(mark, "doc_id long, key binary, f0 long, f1 long, n long")
    nodes = cut(marked.groupBy("key").agg(F.min("doc_id").alias("least"), F.min("f0").alias("f0"), F.min("f1").alias("f1"), F.min("n").alias("n")))
    groups = components(wide_links(nodes.where("n > 0"), max_bits, node_bits, ways)).withColumnsRenamed({"node": "item"})
    members = cut(nodes.join(groups, F.xxhash64("key") == F.col("item")).select("key", "least", "f0", "f1", "n", "root"))
    asked = texts.join(members.select(F.col("least").alias("own")), F.col("doc_id").eqNullSafe(F.col("own")), "left_semi")
    edges = similar_pairs(members, shingle_sets(asked, shingle), least, block_docs, block_shingles)
    classes = components(edges).withColumnRenamed("node", "key")
    place = F.struct(F.col("least").isNull().alias("none"), "least", "key")
    ranked = nodes.select("key", "least").join(classes, "key")
    gone = ranked.join(ranked.groupBy("root").agg(F.min(place)["key"].alias("first")), "root").where("key <> first").select("key")
    return cut(nodes.join(gone, "key", "left_anti").select(F.col("least").alias("doc_id"), "key"))


def wide_links(nodes: DataFrame, max_bits: int, node_bits: int, ways: int) -> DataFrame:
    """``a, b``: links between hashes of ``key`` that connect what the wide index finds within ``max_bits``."""
    masks = dealt_masks(node_bits, ways)
    upper = F.array(*(F.struct(F.lit(k).alias("kind"), *(F.lit(signed(int(w))).alias(f"m{i}") for i, w in enumerate(row))) for k, row in enumerate(masks)))
    placed = nodes.select("f0", "f1", F.xxhash64("key").alias("item"), F.explode(upper).alias("u")).select(
        F.xxhash64("u.kind", F.col("f0").bitwiseAND(F.col("u.m0")), F.col("f1").bitwiseAND(F.col("u.m1"))).alias("node"), "f0", "f1", "item"
    )
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [[b.column(c).to_numpy() for c in ("node", "f0", "f1", "item")] for b in batches]
        if not read:
            return
        node, f0, f1, item = (np.concatenate(x) for x in zip(*read, strict=True))
        del read
        a, b = connected(node, np.stack([f0.view(np.uint64), f1.view(np.uint64)], axis=1), max_bits)
        for at in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(item[x[at : at + 100_000]]) for x in (a, b)], schema=schema)

    return placed.repartition(parts_for(nodes, len(masks)), "node").mapInArrow(run, "a long, b long").where("a <> b").distinct()


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """``key, held``: the distinct shingle hashes of each key, sorted, eight bytes each."""
    schema = pa.schema([("key", pa.binary()), ("held", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((key_of(t), np.unique(np.array(hashed(t, shingle), dtype="<u8")).tobytes()) for _, t in rows_of(batches, "doc_id", "text"))
        yield from bounded(rows, schema, weight=lambda r: len(r[1]))

    return texts.mapInArrow(run, "key binary, held binary").groupBy("key").agg(F.min("held").alias("held"))


def similar_pairs(members: DataFrame, sets: DataFrame, least: float, block_docs: int, block_shingles: int) -> DataFrame:
    """``a, b``: keys of pairs of one root with a similarity of ``least`` or more that connect as all such pairs do.

    A root's members are dealt into blocks of bounded size and every two blocks meet once, in a task of
    its own. Where there are several blocks, all members are first compared with the member nearest to
    the bitwise majority of the root; those similar to it are connected already and their blocks do not
    meet each other, so a family of copies around one text costs a pass and not all its pairs.
    """
    size = members.groupBy("root").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("docs") / block_docs, F.col("shingles") / block_shingles)).cast("long")
    held = cut(members.select("key", "f0", "f1", "n", "root").join(sets, "key").join(size.select("root", blocks.alias("blocks")), "root"))
    large = held.where("blocks > 1")
    if large.isEmpty():
        return met_blocks(held.select("root", F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(0).cast("long").alias("block"), "key", "held"), least)
    hubs = hubs_of(large)
    spread = F.pmod(F.xxhash64("key"), F.col("blocks"))
    shared = hubs.select(F.col("root").alias("hub_root"), F.col("key").alias("hub"), F.col("held").alias("hub_held"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("hub_block"))
    met = large.withColumn("block", spread).join(shared, (F.col("root") == F.col("hub_root")) & (F.col("block") == F.col("hub_block"))).where("key <> hub")
    stars = cut(compared(met, least))
    near = stars.select(F.col("a").alias("key"), F.lit(True).alias("near")).unionByName(hubs.select("key", F.lit(True).alias("near")))
    split = held.join(near.distinct(), "key", "left").withColumn("near", F.coalesce("near", F.lit(False)))
    counts = split.groupBy("root").agg(*(F.ceil(F.greatest(F.count_if(c) / block_docs, F.sum(F.when(c, F.col("n"))) / block_shingles)).cast("long").alias(name) for c, name in ((F.col("near"), "nears"), (~F.col("near"), "fars"))))
    placed = split.join(counts.select("root", F.coalesce("nears", F.lit(0)).alias("nears"), F.coalesce("fars", F.lit(0)).alias("fars")), "root")
    own = F.pmod(F.xxhash64("key"), F.when(F.col("near"), F.col("nears")).otherwise(F.col("fars")))
    far, all_far = ~F.col("near"), F.when(F.col("fars") > 0, F.sequence(F.lit(0), F.col("fars") - 1)).otherwise(F.array().cast("array<bigint>"))
    all_near = F.when(F.col("nears") > 0, F.sequence(F.lit(0), F.col("nears") - 1)).otherwise(F.array().cast("array<bigint>"))
    # far blocks meet far blocks (lower number first) and near blocks (numbered below zero)
    tasks = F.when(
        far,
        F.concat(
            F.transform(all_far, lambda j: F.struct(F.least(j, F.col("own")).alias("x"), F.greatest(j, F.col("own")).alias("y"))),
            F.transform(all_near, lambda j: F.struct((-1 - j).alias("x"), F.col("own").alias("y"))),
        ),
    ).otherwise(F.transform(all_far, lambda j: F.struct((-1 - F.col("own")).alias("x"), j.alias("y"))))
    met = placed.withColumn("own", own).select("root", "key", "held", F.when(far, F.col("own")).otherwise(-1 - F.col("own")).alias("block"), F.explode(tasks).alias("t")).select("root", "t.x", "t.y", "block", "key", "held")
    return stars.unionByName(met_blocks(met, least))


def hubs_of(large: DataFrame) -> DataFrame:
    """The rows of ``large`` that are nearest to the bitwise majority of their root, one a root."""
    fields = [("root", pa.int64()), ("n", pa.int64()), ("votes", pa.binary())]
    schema = pa.schema(fields)

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            root = b.column("root").to_numpy()
            bits = np.unpackbits(np.stack([b.column(c).to_numpy() for c in ("f0", "f1")], axis=1).astype("<i8").view(np.uint8), axis=1, bitorder="little")
            for r in np.unique(root).tolist():
                own = sums.setdefault(r, [0, np.zeros(WORDS * BITS, dtype=np.int64)])
                own[0] += int((root == r).sum())
                own[1] += bits[root == r].sum(axis=0, dtype=np.int64)
        yield from bounded(((r, n, v.tobytes()) for r, (n, v) in sums.items()), schema)

    def majority(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(v, dtype=np.int64) for v in table["votes"].to_pylist()], axis=0)
        code = np.packbits(total * 2 > sum(table["n"].to_pylist()), bitorder="little").view("<i8")
        return pa.table({"root": table["root"][:1], "c0": pa.array(code[:1]), "c1": pa.array(code[1:])})

    codes = large.select("root", "f0", "f1").mapInArrow(votes, "root long, n long, votes binary").groupBy("root").applyInArrow(majority, "root long, c0 long, c1 long")
    off = F.bit_count(F.col("f0").bitwiseXOR(F.col("c0"))) + F.bit_count(F.col("f1").bitwiseXOR(F.col("c1")))
    nearest = large.join(codes, "root").groupBy("root").agg(F.min(F.struct(off.alias("off"), "key"))["key"].alias("key"))
    return cut(large.join(nearest.select("key"), "key", "left_semi"))


def compared(met: DataFrame, least: float) -> DataFrame:
    """``a, b``: key and hub of the rows whose sets are similar."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def alike(x: bytes, y: bytes) -> bool:
            p, q = np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")
            both = len(np.intersect1d(p, q, assume_unique=True))
            return both >= least * (len(p) + len(q) - both) - 1e-9

        yield from bounded(((k, h) for k, h, x, y in rows_of(batches, "key", "hub", "held", "hub_held") if alike(x, y)), schema)

    return met.select("key", "hub", "held", "hub_held").mapInArrow(run, "a binary, b binary")


def met_blocks(met: DataFrame, least: float) -> DataFrame:
    """``a, b``: similar pairs across (or, for x = y, within) the two blocks of each task, as a spanning forest."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tasks() -> Iterator[tuple[bytes, bytes]]:
            held: list[tuple] = []
            for row in rows_of(batches, "root", "x", "y", "block", "key", "held"):
                if held and held[-1][:3] != row[:3]:
                    yield from block_links(held, least)
                    held = []
                held.append(row)
            if held:
                yield from block_links(held, least)

        yield from bounded(tasks(), schema)

    return met.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y").mapInArrow(run, "a binary, b binary")


def block_links(rows: list[tuple], least: float) -> Iterator[tuple[bytes, bytes]]:
    """Links of one task; rows are (root, x, y, block, key, set)."""
    x, y = rows[0][1:3]
    keys = [r[4] for r in rows]
    sets = [np.frombuffer(r[5], dtype="<u8") for r in rows]
    block = np.array([r[3] for r in rows])
    sizes = np.array([len(v) for v in sets])
    labels = Labels(len(rows))
    right = np.arange(len(rows)) if x == y else np.flatnonzero(block == y)
    left = right if x == y else np.flatnonzero(block == x)
    if len(left) and len(right):
        values = np.concatenate([sets[i] for i in right])
        owner = np.repeat(np.arange(len(right)), sizes[right])
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        for i in left.tolist():
            s, e = np.searchsorted(values, sets[i], "left"), np.searchsorted(values, sets[i], "right")
            some = e > s
            s, n = s[some], (e - s)[some]
            at = np.repeat(s - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else np.zeros(0, dtype=np.int64)
            both = np.bincount(owner[at], minlength=len(right))
            near = right[(both >= least * (sizes[i] + sizes[right] - both) - 1e-9) & (right != i)]
            labels.link(np.full(len(near), i), near)
    for i in np.flatnonzero(labels.of != np.arange(len(rows))).tolist():
        yield keys[i], keys[labels.of[i]]

"""Exact similarity joins on token sets, a greedy selection on their links, and a cascade of checks.

``set_pairs`` orders the tokens of every row from rare to frequent. Two sets with a Jaccard similarity of t
share a token among the first ``n - ceil(t n) + 1`` of each, so only these prefixes are indexed. Postings are
shuffled once, and pairs are formed and refused in the tasks: a pair is looked for at its first shared token, so the
places there bound the overlap, and so do lengths and the sets' sketches. What is left is verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.session import Rounds

#: Tokens whose frequency is known to the order; tokens that a task orders at once; longs of a sketch, and those of the smallest and largest that are sent.
FREQUENT, TOKENS_AT_ONCE, WORDS, LONGS = 1 << 17, 1 << 19, 6, (2, 32)
#: Postings of a token that meet in one group; pairs that a task holds at once, and pairs of sketches.
BLOCK, PAIRS, SKETCHES = 4096, 1 << 20, 1 << 16
#: Copies that go to all tasks, ids and keys that do, ids of copies in a row.
FEW, KEYS, COPIES = 1 << 17, 1 << 20, 1024


def mixed(x: np.ndarray) -> np.ndarray:
    """Other bits of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def sketches(row: np.ndarray, h: np.ndarray, n: int, words: int = WORDS) -> np.ndarray:
    """Bits by row: each says whether an odd number of tokens falls on it, so sets differ in as many tokens as bits at least."""
    bits = 64 * words
    odd = np.bincount(row * bits + (mixed(h) % np.uint64(bits)).astype(np.int64), minlength=n * bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(n, words)


def sized_sketches(row: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sketches of some 0.75 to 1.5 bits a token, end to end, with their starts and sizes; one folds to half its size by XOR."""
    longs = 1 << np.ceil(np.log2(np.maximum(n, 1) * (0.75 / 64))).clip(0).astype(np.int64)
    longs = longs.clip(*LONGS)
    start = np.cumsum(longs) - longs
    out = np.zeros(int(longs.sum()), np.int64)
    for w in np.unique(longs):
        some = np.nonzero(longs == w)[0]
        place = np.full(len(n), -1)
        place[some] = np.arange(len(some))
        own = place[row] >= 0
        out[start[some][:, None] + np.arange(w)] = sketches(place[row[own]], h[own], len(some), int(w))
    return out, start, longs


def postings(batch: pa.RecordBatch, least: float, known: np.ndarray, often: np.ndarray, block: int = BLOCK, keys: np.ndarray | None = None) -> pa.RecordBatch:
    """``s, side, part, id, n, i, bits``: the prefix of each set ``side, id, within, h``, with the places of its tokens and the sketch.

    The order is by frequency, as far as it is known, then by hash; it is the same for all rows. A token of more than ``block``
    rows is dealt to a group for each two blocks of its rows, where only rows of different ``part``, or of part 2, are paired.
    With ``keys``, sorted, only postings of side b and those whose ``s`` is among them are needed.
    """
    n = batch.column("h").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    h = batch.column("h").flatten().to_numpy(zero_copy_only=False)
    row, start = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
    at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
    count = np.where(known[at] == h, often[at], 0) if len(known) else np.zeros(len(h), np.int64)
    order = np.lexsort((h, count, row))
    place = np.arange(len(h)) - start[row]
    first = place < (n - np.ceil(n * least - 1e-9).astype(np.int64) + 1)[row]
    token, of, i, count = h[order][first], row[first], place[first], count[order][first]
    seed = batch.column("within").to_numpy(zero_copy_only=False).view(np.uint64)
    s = mixed(token.view(np.uint64) + mixed(seed)[of]).view(np.int64)
    if keys is not None:
        found = np.minimum(np.searchsorted(keys, s), max(len(keys) - 1, 0))
        needed = (keys[found] == s if len(keys) else np.zeros(len(s), bool)) | pc.equal(batch.column("side"), "b").to_numpy(zero_copy_only=False)[of]
        s, of, i, count = s[needed], of[needed], i[needed], count[needed]
    blocks = np.maximum(1, -(-count // block))
    own = (mixed(s.view(np.uint64) + mixed(of.astype(np.uint64) + np.uint64(1))) % blocks.astype(np.uint64)).astype(np.int64)
    again = np.repeat(np.arange(len(s)), blocks)
    other = np.arange(len(again)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    s, of, i, own, blocks = s[again], of[again], i[again], own[again], blocks[again]
    low, high = np.minimum(own, other), np.maximum(own, other)
    dealt = mixed(s.view(np.uint64) + (low * blocks + high + 1).astype(np.uint64)).view(np.int64)
    part = np.where(low == high, 2, (own == high).astype(np.int64))
    bits, begin, longs = sized_sketches(row, h.view(np.uint64), n)
    ends = np.r_[0, np.cumsum(longs[of])]
    flat = np.arange(ends[-1]) + np.repeat(begin[of] - ends[:-1], longs[of])
    rows = pa.array(of)
    columns = [pa.array(np.where(blocks > 1, dealt, s)), batch.column("side").take(rows), pa.array(part.astype(np.int32)), batch.column("id").take(rows), pa.array(n[of].astype(np.int32)), pa.array(i.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(bits[flat]))]
    return pa.RecordBatch.from_arrays(columns, ["s", "side", "part", "id", "n", "i", "bits"])


def apart(x: np.ndarray, y: np.ndarray, bits: np.ndarray, start: np.ndarray, longs: np.ndarray) -> np.ndarray:
    """In how many bits the sketches of rows x and y differ; the longer one is folded."""
    out = np.zeros(len(x), np.int64)
    key = longs[x] * (LONGS[1] + 1) + longs[y]
    for k in np.unique(key):
        some = np.nonzero(key == k)[0]
        wide, w = divmod(int(k), LONGS[1] + 1)
        p, q = (y[some], x[some]) if w > wide else (x[some], y[some])
        wide, w = max(wide, w), min(wide, w)
        for at in range(0, len(some), SKETCHES):
            piece = slice(at, at + SKETCHES)
            long = np.bitwise_xor.reduce(bits[start[p[piece]][:, None] + np.arange(wide)].reshape(-1, wide // w, w), axis=1)
            out[some[piece]] = np.bitwise_count(long ^ bits[start[q[piece]][:, None] + np.arange(w)]).sum(axis=1)
    return out


def pairs_of(batch: pa.RecordBatch, least: float, both: bool) -> Iterator[pa.RecordBatch]:
    """``a, b`` of the pairs within whole groups of ``s``, in order of ``s``, that lengths, places and sketches allow."""
    column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
    s, part, n, i = (column(c) for c in ("s", "part", "n", "i"))
    n, i, right = n.astype(np.int64), i.astype(np.int64), pc.equal(batch.column("side"), "b").to_numpy(zero_copy_only=False)
    longs = batch.column("bits").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    bits, start = batch.column("bits").flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum(longs) - longs
    later = np.searchsorted(s, s, side="right") - np.arange(len(s)) - 1
    ends, first = np.cumsum(later), 0
    while first < len(s):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, side="right")))
        count = later[first:last]
        x = np.repeat(np.arange(first, last), count)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(count) - count, count)
        first = last
        some = np.minimum(n[x], n[y]) >= np.maximum(n[x], n[y]) * least - 1e-9
        some &= (part[x] == 2) | (part[x] != part[y])
        if both:
            some &= right[x] != right[y]
        x, y = x[some], y[some]
        some = np.minimum(n[x] - i[x], n[y] - i[y]) >= np.ceil((n[x] + n[y]) * (least / (1 + least)) - 1e-9)
        x, y = x[some], y[some]
        some = apart(x, y, bits, start, longs) <= np.floor((n[x] + n[y]) * ((1 - least) / (1 + least)) + 1e-9)
        x, y = x[some], y[some]
        turn = right[x] & both
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(np.where(turn, y, x))), batch.column("id").take(pa.array(np.where(turn, x, y)))], ["a", "b"])


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in order of ``s`` cut where a group ends."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        s = batch.column("s").to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(s, s[-1]))
        begun = rest and rest[0].column("s")[0].as_py() == s[-1]
        if cut or not begun:
            head = [*rest, batch.slice(0, cut)]
            if sum(x.num_rows for x in head):
                yield pa.Table.from_batches(head).combine_chunks().to_batches()[0]
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch with about ``TOKENS_AT_ONCE`` tokens at once."""
    ends = np.cumsum(batch.column("h").value_lengths().to_numpy(zero_copy_only=False))
    first = 0
    while first < batch.num_rows:
        past = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, past + TOKENS_AT_ONCE, side="right")))
        yield batch.slice(first, last - first)
        first = last


def prefixes(rows: DataFrame, least: float, both: bool = False) -> DataFrame:
    """The ``postings`` of ``side, id, within, tokens``; sets stay in their row.

    With ``both`` sides, those of a that no posting of b can meet are left out, where b has few.
    """
    hashed = rows.where("size(tokens) > 0").select("side", "id", F.xxhash64("within").alias("within"), F.transform("tokens", lambda x: F.xxhash64(x)).alias("h"))
    counts = hashed.select(F.explode("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    top = counts.orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow().sort_by("h")
    order = tuple(top.column(c).to_numpy() for c in ("h", "n"))
    schema = f"s long, side string, part int, id {rows.schema['id'].dataType.simpleString()}, n int, i int, bits array<long>"

    def made(hashed: DataFrame, block: int, keys: np.ndarray | None = None) -> DataFrame:
        sent = rows.sparkSession.sparkContext.broadcast((*order, block, keys))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    yield postings(part, least, *sent.value)

        return hashed.mapInArrow(run, schema)

    if not both:
        return made(hashed, BLOCK)
    keys = made(hashed.where("side = 'b'"), 1 << 62).select("s").distinct().limit(KEYS + 1).toArrow().column("s").to_numpy()
    return made(hashed, BLOCK, np.sort(keys) if len(keys) <= KEYS else None)


def few(rows: DataFrame, most: int) -> DataFrame:
    """``rows``, a stored table, sent to all tasks if there are at most ``most``."""
    return F.broadcast(rows) if rows.count() <= most else rows


def set_pairs(left: DataFrame, right: DataFrame | None = None, least: float = 0.8, within: str | None = None) -> DataFrame:
    """``a, b, similarity`` of all pairs of token sets with a Jaccard similarity of ``least`` or more.

    ``left`` and ``right`` have ``id, tokens``, with distinct tokens; without ``right`` pairs are within
    ``left``, a < b. ``within`` is a column that both of a pair have alike and not null. Null and empty sets have no pairs. Equal
    sets are pairs like others: to keep large groups of copies from being compared, join the first of ``classes`` and have the links ``expanded``.
    """
    key = F.col(within) if within else F.lit(0)
    columns = lambda rows, side: rows.select(F.lit(side).alias("side"), "id", key.alias("within"), "tokens").where("within IS NOT NULL")
    both = right is not None
    rows = columns(left, "a").unionByName(columns(right, "b")) if both else columns(left, "a")
    keep = Rounds(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches):
            yield from pairs_of(batch, least, both)

    kind = rows.schema["id"].dataType.simpleString()
    met = prefixes(rows, least, both).repartition("s").sortWithinPartitions("s").mapInArrow(run, f"a {kind}, b {kind}")
    pairs = keep.keep((met if both else met.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct())
    ends = lambda name: few(keep.keep(pairs.select(F.col(name).alias("id")).distinct()), KEYS)
    x = rows.where("side = 'a'").join(ends("a"), "id", "left_semi").select(F.col("id").alias("a"), F.col("within").alias("wa"), F.col("tokens").alias("x"))
    y = rows.where(F.col("side") == ("b" if both else "a")).join(ends("b"), "id", "left_semi").select(F.col("id").alias("b"), F.col("within").alias("wb"), F.col("tokens").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    scored = pairs.join(x, "a").join(y, "b").where("wa = wb").select("a", "b", (shared / (F.size("x") + F.size("y") - shared)).alias("similarity"))
    return scored.where(F.col("similarity") >= least - 1e-12)


def expanded(links: DataFrame, copies: DataFrame) -> DataFrame:
    """``links`` (``a, b, similarity``) of class heads as links of all members, and those within each class, from ``head, id`` of the other members.

    Members of a class go in rows of some ``COPIES`` ids, so a pair is formed in the task that returns it, and none is shuffled.
    """
    keep = Rounds(links.sparkSession)
    sizes = copies.groupBy("head").agg(F.ceil((F.count(F.lit(1)) + 1) / COPIES).cast("int").alias("n"))
    members = copies.unionByName(copies.select("head", F.col("head").alias("id")).distinct()).join(sizes, "head")
    blocks = keep.keep(members.groupBy("head", F.pmod(F.xxhash64("id"), F.col("n")).cast("int").alias("block")).agg(F.collect_list("id").alias("ids")))
    side = lambda head, ids, block="block": blocks.select(F.col("head").alias(head), F.col("block").alias(block), F.col("ids").alias(ids))
    each = lambda x: F.when(F.col(f"ids_{x}").isNull(), F.array(x)).otherwise(F.col(f"ids_{x}"))
    far = links.join(side("a", "ids_a", "block_a"), "a", "left").join(side("b", "ids_b", "block_b"), "b", "left").select(each("a").alias("x"), each("b").alias("y"), "similarity")
    own = side("head", "x", "i").join(side("head", "y", "j"), "head").where("i <= j").select("x", "y", "i", "j")
    pair = lambda rows, *more: rows.select("y", *more, F.explode("x").alias("p")).select("p", *more, F.explode("y").alias("q"))
    inside = pair(own, "i", "j").where("i < j OR p < q").select("p", "q", F.lit(1.0).alias("similarity"))
    return pair(far, "similarity").select("p", "q", "similarity").unionByName(inside).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "similarity")


def classes(rows: DataFrame, within: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The rows with the smallest id of those of an equal token set (and equal ``within``, not null), and ``head, id`` of the others.

    Only digests of the sets are shuffled; the rows themselves are met by their few copies.
    """
    digest = F.sha2(F.array_join(F.sort_array("tokens"), "\x00").cast("binary"), 256)
    keyed = Rounds(rows.sparkSession).keep(rows.withColumn("_key", digest).dropna(subset=[*within]) if within else rows.withColumn("_key", digest))
    own = keyed.select("id", "_key", *within)
    heads = own.groupBy("_key", *within).agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    keep = Rounds(rows.sparkSession)
    copies = keep.keep(own.join(heads, ["_key", *within]).where("id <> head").select("head", "id", "_key", *within))
    others = copies.select("id", "_key", *within)
    if copies.count() <= FEW:
        return keyed.join(F.broadcast(others), ["id", "_key", *within], "left_anti").drop("_key"), copies.select("head", "id")
    return keep.keep(keyed.join(others, ["id", "_key", *within], "left_anti").drop("_key")), copies.select("head", "id")  # sets are shuffled once, not for each use


def greedy_dropped(links: DataFrame) -> DataFrame:
    """``id`` of the rows that a greedy pass in order of id drops: those with a link to an earlier row that it keeps.

    ``links`` has ``a, b`` with a < b. A row whose earlier neighbours are all decided is decided, so each
    round decides all such rows at once, wherever they are; rounds are as many as the longest chain
    of decisions that wait for each other. Only links between undecided rows go on to the next round.
    """
    spark = links.sparkSession
    rounds = Rounds(spark)
    dropped: list[DataFrame] = []
    out = Rounds(spark)
    left = rounds.keep(links.select("a", "b").distinct())
    while not left.isEmpty():
        kept = left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        gone = out.keep(kept.select(F.col("b").alias("id")).distinct())
        dropped.append(gone)
        rest = left.join(gone.withColumnRenamed("id", "b"), "b", "left_anti").join(gone.withColumnRenamed("id", "a"), "a", "left_anti")
        rounds.turn()
        left = rounds.keep(rest.select("a", "b"))
    if not dropped:
        return links.select(F.col("b").alias("id")).limit(0)
    return spark.read.parquet(*out.new)


def first_reason(rows: DataFrame, checks: Sequence[tuple[str, Column]]) -> DataFrame:
    """``rows`` with ``reason``, the name of the first check that holds, null if none does; rows with a reason keep it."""
    reason = F.col("reason") if "reason" in rows.columns else F.lit(None).cast("string")
    for name, bad in checks:
        reason = F.when(reason.isNull() & F.coalesce(bad, F.lit(False)), name).otherwise(reason)
    return rows.withColumn("reason", reason)


def profiles(rows: DataFrame, size: int) -> DataFrame:
    """``label, terms``: the ``size`` tokens that most rows of a label hold, ties by the token; labels are few."""
    from pyspark.sql import Window

    counts = rows.select("label", F.explode("tokens").alias("token")).groupBy("label", "token").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("label").orderBy(F.desc("n"), "token")
    top = counts.withColumn("i", F.row_number().over(own)).where(F.col("i") <= size)
    return top.groupBy("label").agg(F.array_sort(F.collect_list("token")).alias("terms"))


def with_rank(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` with ``rank`` and ``margin``: where the row's label stands among all profiles by shared terms, and its lead over the best other; null where ``reason`` is not."""
    labels = known.agg(F.collect_list(F.struct(F.col("label"), F.col("terms"))).alias("known"))
    scores = F.transform("known", lambda k: F.struct((-F.size(F.array_intersect(k["terms"], F.col("tokens"))) / F.size(k["terms"])).alias("s"), k["label"].alias("label")))
    ranked = rows.join(F.broadcast(labels)).withColumn("scores", F.when(F.col("reason").isNull(), F.array_sort(scores)))
    place = F.array_position(F.col("scores.label"), F.col("label"))
    own = F.try_element_at("scores", F.greatest(place, F.lit(1)).cast("int"))["s"]
    other = F.when(place == 1, F.try_element_at("scores", F.lit(2))["s"]).otherwise(F.try_element_at("scores", F.lit(1))["s"])
    return ranked.withColumns({"rank": F.when(place > 0, place.cast("int")), "margin": F.when(place > 0, F.coalesce(other - own, F.lit(1.0)))}).drop("scores", "known")


def target_rank(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``id, rank, margin`` of the rows whose label has a profile."""
    return with_rank(rows.withColumn("reason", F.lit(None).cast("string")), known).where("rank IS NOT NULL").select("id", "rank", "margin")


def cascade(
    rows: DataFrame,
    real: DataFrame,
    support: DataFrame,
    words: tuple[int, int] = (4, 500),
    worst_rank: int = 2,
    least_margin: float = -0.01,
    contamination: float = 0.6,
    duplicate: float = 0.8,
    profile: int = 50,
) -> DataFrame:
    """``id, label, reason, rank, margin, tier``: each row with the first check that it fails, null if it is kept.

    ``rows`` have ``id, label, n_words, tokens``, ``real`` has ``id, tokens``, ``support`` has ``label, n``, the real rows of
    a label. Checks in order: a label without support entry, length, the label's rank and margin among the
    profiles of all labels, similarity to a real row, and similarity to an earlier kept row of the label. Rows that
    fail a check do not take part in later ones. A null label is unknown; null tokens count as none.
    """
    rows = rows.withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
    known = rows.join(F.broadcast(support), "label", "left").withColumn("known", F.col("n").isNotNull())  # a row a label; rows are not dealt by label
    first = first_reason(known, [("unknown_label", ~F.col("known")), ("length", ~F.coalesce(F.col("n_words").between(*words), F.lit(False)))])
    keep = Rounds(rows.sparkSession)
    tokens = F.when(F.col("reason").isNull(), F.col("tokens")).alias("tokens")  # those of other rows are not looked at again
    first = keep.keep(first.select("id", "label", tokens, "n", "reason"))
    keep.turn()
    second = with_rank(first, profiles(first.where("reason IS NULL"), profile))
    second = first_reason(second, [("label_mismatch", (F.col("rank") > worst_rank) | (F.col("margin") < least_margin))])
    second = keep.keep(second.select("id", "label", tokens, "n", "reason", "rank", "margin"))
    keep.turn()  # the first table is no longer read
    open_ = second.where("reason IS NULL").select("id", "label", "tokens")
    leaked = set_pairs(open_.select("id", "tokens"), real.select("id", "tokens"), contamination).select(F.col("a").alias("id")).distinct()
    leaked = few(keep.keep(leaked), KEYS).withColumn("leaked", F.lit(True))
    third = first_reason(second.join(leaked, "id", "left"), [("contamination", F.col("leaked"))]).drop("leaked")
    firsts, copies = classes(third.where("reason IS NULL AND size(tokens) > 0").select("id", "label", "tokens"), ["label"])
    links = set_pairs(firsts, least=duplicate, within="label").select("a", "b")
    copies = copies.select("id")
    repeated = greedy_dropped(links).unionByName(copies).distinct().withColumn("repeated", F.lit(True))
    last = first_reason(third.join(repeated, "id", "left"), [("near_duplicate", F.col("repeated"))])
    tier = F.when(F.coalesce("n", F.lit(0)) == 0, "SYNTHETIC_ONLY").when(F.col("n") == 1, "SINGLE_REAL_ANCHOR").otherwise("REAL_ANCHORED")
    return last.select("id", "label", "reason", "rank", "margin", tier.alias("tier"))

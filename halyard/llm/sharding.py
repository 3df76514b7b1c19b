"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``slots`` positions. Every shard owns ``vnodes`` of them, at hashed places, and a key falls
on a slot by the hash of its id and text. A key goes to the first virtual node at or after its slot
whose shard is not full; keys are taken in the order of slot and of hash within the slot. A shard is
full at ``(1 + slack)`` times its even share. With no slack, shares differ by one row at most.

Only the number of keys in each slot is needed to say which ranks of a slot go to which shard, so the
walk runs over ``slots`` numbers, however many keys there are. The result is a table of rank ranges
with at most ``slots + shards`` rows (a proven bound), which is broadcast to the keys. All work on keys
is DataFrame operations: two passes over the input, two shuffles of distinct keys, no text in them.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 24
VNODES = 64
SLOTS = 4096
COPIES = 100_000


def ring(spark, shards: int, vnodes: int, slots: int) -> list[int]:
    """The shards of the virtual nodes, clockwise, as (slot, shard) pairs in order."""
    nodes = spark.range(shards * vnodes).select((F.col("id") % shards).cast("int").alias("shard"), F.expr(f"id div {shards}").alias("replica"))
    at = F.xxhash64(F.lit("node"), "shard", "replica")
    return [(r["slot"], r["shard"]) for r in nodes.select(F.pmod(at, F.lit(slots)).cast("int").alias("slot"), "shard", at.alias("h")).orderBy("slot", "h", "shard").collect()]


def capacities(total: int, shards: int, slack: float) -> list[int]:
    if slack <= 0:
        return [total // shards + (i < total % shards) for i in range(shards)]
    return [math.ceil((1 + slack) * total / shards)] * shards


def walk(counts: dict[int, int], nodes: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Rank ranges (slot, from, to, shard, first place in the shard), filling shards clockwise."""
    room, used, out = list(room), [0] * len(room), []
    ring_size, first = len(nodes), 0
    for slot in sorted(counts):
        left, rank = counts[slot], 0
        while first < ring_size and nodes[first][0] < slot:
            first += 1
        at = first
        while left:
            shard = nodes[at % ring_size][1]
            at += 1
            take = min(left, room[shard])
            if take:
                out.append((slot, rank, rank + take, shard, used[shard]))
                room[shard] -= take
                used[shard] += take
                rank += take
                left -= take
    return out


def keyed(docs: DataFrame, slots: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, key, slot``; a null text has no bytes, a null id is a key like any other."""
    text = F.col(text_col).cast("binary")
    key = F.xxhash64(F.lit("key"), F.col(id_col).cast("string"), text)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"), key.alias("key"))
    return rows.withColumn("slot", F.pmod("key", F.lit(slots)).cast("int"))


def assign(docs: DataFrame, shards: int = SHARDS, slack: float = 0.0, vnodes: int = VNODES, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: each row's shard and its place in it, from 0 without gaps.

    Rows equal in id and text share a key and take neighbouring places; which is which does not matter.
    Such rows are counted before they are ranked, so a row that is there a million times is one row up to
    the last step. Nulls are keys; texts of any length count by their bytes; other columns are not read;
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    keys = keyed(docs, slots, id_col, text_col)
    counts = {r["slot"]: r["count"] for r in keys.groupBy("slot").count().collect()}  # no more than `slots` rows
    ranges = walk(counts, ring(spark, shards, vnodes, slots), capacities(sum(counts.values()), shards, slack))
    kind = "array<struct<ring_slot:int,low:long,high:long,shard:int,base:long>>"
    packed = json.dumps([dict(zip(("ring_slot", "low", "high", "shard", "base"), r, strict=True)) for r in ranges])
    table = spark.range(1).select(F.inline(F.from_json(F.lit(packed), kind)))
    distinct = keys.groupBy(*keys.columns).agg(F.count(F.lit(1)).alias("copies"))
    so_far = F.sum("copies").over(Window.partitionBy("slot").orderBy("key", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = distinct.withColumn("first", so_far - F.col("copies"))
    ranked = first.where(F.col("copies") <= COPIES).withColumn("rank", F.explode(F.sequence("first", F.col("first") + F.col("copies") - 1)))
    if max(counts.values(), default=0) > COPIES:  # only then can one row have more copies than a task should write
        many = first.where(F.col("copies") > COPIES).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))).alias("part"))
        until = F.least(F.col("part") + COPIES, F.col("copies"))
        spread = many.repartition("key", "part").withColumn("rank", F.explode(F.sequence(F.col("first") + F.col("part"), F.col("first") + until - 1)))
        ranked = ranked.unionByName(spread.drop("part"))
    placed = ranked.join(F.broadcast(table), (F.col("slot") == F.col("ring_slot")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("low")).cast("long").alias("slot"))

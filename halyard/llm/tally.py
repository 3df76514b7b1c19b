"""Questions about the whole corpus, asked and answered by batch.

Documents are dealt into batches of bounded size. A batch asks about sorted, distinct keys; questions
meet by key range, and the answers return to the batch in the order in which it asked, so keys travel
once, as differences of a sorted list, and an answer is a few bits. A key that is everywhere is one
question a batch, whatever its number of occurrences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.session import stored

BATCH_BYTES = 8 << 20
ASK = "part int, batch int, keys binary, extra binary"
ASK_SCHEMA = pa.schema([("part", pa.int32()), ("batch", pa.int32()), ("keys", pa.binary()), ("extra", pa.binary())])


def batches(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", batch_bytes: int = BATCH_BYTES) -> tuple[DataFrame, int, int]:
    """``batch, text, rest``: rows dealt by a hash of id and text, ``rest`` with the other columns; the number of batches, the bytes of text.

    Rows equal in both, if together they are more than a batch, are dealt over as many batches as they
    need. Nothing but a row number tells them apart, so these rows alone are written first.
    """
    taken = F.octet_length(text_col) + 64
    size = docs.agg(F.coalesce(F.sum(taken), F.lit(0)).alias("b")).first()["b"]
    n = max(1, -(-size // batch_bytes))
    mark = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("binary"))
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), mark.alias("mark"))
    copies = docs.groupBy(mark.alias("hot")).agg(F.count(F.lit(1)).alias("c"), F.sum(taken).alias("b"))
    hot = stored(copies.where((F.col("c") > 1) & (F.col("b") > batch_bytes)).select("hot", F.ceil(F.col("b") / batch_bytes).cast("long").alias("over")), "hot")
    if hot.isEmpty():
        placed = marked.select("row", F.pmod("mark", F.lit(n)).cast("int").alias("batch"))
    else:
        repeated = marked.join(hot, F.col("mark") == F.col("hot")).select("row", "mark", F.pmod(F.monotonically_increasing_id(), F.col("over")).alias("salt"))
        single = marked.join(hot, F.col("mark") == F.col("hot"), "left_anti").select("row", "mark", F.lit(0).cast("long").alias("salt"))
        both = single.unionByName(stored(repeated, "copies"))
        placed = both.select("row", F.pmod(F.xxhash64("mark", "salt"), F.lit(n)).cast("int").alias("batch"))
    rest = F.struct(*(F.col(f"row.`{c}`") for c in docs.columns if c != text_col))
    return placed.select("batch", F.col(f"row.`{text_col}`").cast("binary").alias("text"), rest.alias("rest")), n, size


def part_bits(entries: int, per_part: int = 2_000_000) -> int:
    """So that a range of keys has about ``per_part`` of the expected questions."""
    return max(3, int(np.ceil(np.log2(max(1, entries / per_part)))))


def pack(keys: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit keys as planes of the bytes of their differences; upper planes are zeros."""
    return np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def cuts_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each of ``2 ** bits`` ranges begins in sorted keys."""
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.append(np.searchsorted(keys, edges), len(keys))


def ask(batch: int, bits: int, keys: np.ndarray, extra) -> pa.Table:
    """Questions of a batch: its sorted keys by range; ``extra(s, e)`` are the bytes that go with keys s to e."""
    cuts = cuts_of(keys, bits)
    rows = [(p, batch, pack(keys[s:e]), extra(s, e)) for p, (s, e) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if s < e]
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(ASK_SCHEMA)], schema=ASK_SCHEMA)


def answers_in_order(table: pa.Table) -> list[tuple[int, bytes]]:
    """The answers to a batch, by range."""
    return sorted(zip(table["part"].to_pylist(), table["answer"].to_pylist(), strict=True))

"""Small pieces that several operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def utf8(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the text's UTF-8 bytes, without any other column."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def word_spans(words: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by one space, and where each starts and ends in that buffer."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    return b" ".join(words), ends - lengths, ends


def arrow(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches, one at a time."""
    return chain.from_iterable(zip(*(b.column(n).to_pylist() for n in names), strict=True) for b in batches)


def bounded(rows: Iterable[tuple], schema: pa.Schema, at_most: int = 2000, weight=None, at_most_weight: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most so many rows, and so many bytes by ``weight``."""
    kept: list[tuple] = []
    total = 0
    for row in rows:
        kept.append(row)
        total += weight(row) if weight else 0
        if len(kept) >= at_most or total >= at_most_weight:
            yield arrow(schema, zip(*kept, strict=True))
            kept, total = [], 0
    if kept:
        yield arrow(schema, zip(*kept, strict=True))


def portions(rows: Iterable[tuple], at_most: int, text: int = 1) -> Iterator[list[tuple]]:
    """Lists of rows of about so many bytes of text, one row at least."""
    kept: list[tuple] = []
    total = 0
    for row in rows:
        kept.append(row)
        total += len(row[text] or b"")
        if total >= at_most:
            yield kept
            kept, total = [], 0
    if kept:
        yield kept


def signed(x: int) -> int:
    """A 64-bit unsigned integer as Spark's long."""
    return x - (1 << 64) if x >> 63 else x

"""Running sums over an ordered column, without one task that sees all of its values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Equal cells between the least and the greatest value: as many rows are put in order in one task.
CELLS = 1024


def as_number(df: DataFrame, name: str) -> Column:
    """A number in the order of the column, for dates, times and numbers."""
    kind = dict(df.dtypes)[name]
    c = F.col(name)
    return (F.unix_date(c) if kind == "date" else F.unix_micros(c.cast("timestamp_ltz")) if kind.startswith("timestamp") else c).cast("double")


def running(counts: DataFrame, order: str, sums: list[str], keys: tuple[str, ...] = (), descending: bool = False, cells: int = CELLS) -> DataFrame:
    """``counts`` with ``{s}_upto``, the sum of each column ``s`` up to and with the row, and ``{s}_all``, over all rows of the key.

    One row a key and value of ``order`` is expected. Values fall into equal cells between their ends; sums
    of cells are put in order first, values then within their cell. Null is the least value and NaN the greatest, as
    in an order of Spark; infinite values are in the outer cells. An empty frame stays empty.
    """
    x = as_number(counts, order)
    finite = F.when(F.abs(x) < float("inf"), x)
    ends = counts.agg(F.min(finite).alias("_low"), F.max(finite).alias("_high"))
    place = (x / 2 - F.col("_low") / 2) / F.nullif(F.col("_high") / 2 - F.col("_low") / 2, F.lit(0.0)) * cells
    cell = F.when(x.isNull(), -1).otherwise(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(cells - 1.0), F.coalesce(place, x)))).cast("int"))
    placed = counts.join(F.broadcast(ends)).withColumn("_cell", cell).drop("_low", "_high")
    turned = lambda c: F.desc(c) if descending else F.asc(c)
    before = Window.partitionBy(*keys).orderBy(turned("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*keys, "_cell").agg(*(F.sum(s).alias(f"_{s}") for s in sums))
    named = [F.col(k).alias(f"_{k}_key") for k in keys]
    totals = totals.select(*named, F.col("_cell").alias("_at"), *(F.coalesce(F.sum(f"_{s}").over(before), F.lit(0)).alias(f"_{s}_before") for s in sums), *(F.sum(f"_{s}").over(Window.partitionBy(*keys)).alias(f"{s}_all") for s in sums))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_{k}_key")) for k in keys), F.col("_cell") == F.col("_at"))
    inside = Window.partitionBy(*keys, "_cell").orderBy(turned(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = placed.withColumns({f"_{s}_inside": F.sum(s).over(inside) for s in sums})
    rows = own.join(totals if keys else F.broadcast(totals), same)
    return rows.select(*counts.columns, *((F.col(f"_{s}_before") + F.col(f"_{s}_inside")).alias(f"{s}_upto") for s in sums), *(f"{s}_all" for s in sums))

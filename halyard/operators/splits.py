"""Leakage-safe grouped splits, deterministic by hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halyard.functions import scalars as S
from halyard.operators import prefix


def grouped(rows: DataFrame, group: str, label: str, least_groups: int = 4, lockbox: float = 0.2, calibration: float = 0.15, repeats: int = 3, folds: int = 4, synthetic: str | None = None) -> DataFrame:
    """``group, partition`` and a fold for each repeat, one row a group; all rows of a group go together.

    Groups of each label are put in the order of their hash; the first share is the lockbox, the next is for
    calibration, the rest is development, whose folds alternate in another hash order for each repeat.
    Labels with fewer groups than ``least_groups`` stay in development. A group's label is its most frequent
    one, ties by name. Synthetic rows take no part.
    """
    real = rows.where(~F.col(synthetic)) if synthetic else rows
    counts = real.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    own = counts.groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(label)))[label].alias("label"))
    by_label = Window.partitionBy("label")
    place = F.row_number().over(by_label.orderBy(S.fingerprint(group, 16), group)) - 1
    placed = own.withColumns({"place": place, "of": F.count(F.lit(1)).over(by_label)})
    low = F.ceil(F.col("of") * lockbox)
    mid = low + F.ceil(F.col("of") * calibration)
    partition = F.when(F.col("of") < least_groups, "development").when(F.col("place") < low, "lockbox").when(F.col("place") < mid, "calibration").otherwise("development")
    out = placed.withColumn("partition", partition)
    for r in range(repeats):
        order = Window.partitionBy("label", "partition").orderBy(S.fingerprint(F.concat_ws("/", F.lit(str(r)), F.col(group).cast("string")), 16), group)
        out = out.withColumn(f"fold{r}", F.when(F.col("partition") == "development", (F.row_number().over(order) - 1) % folds))
    return out.drop("place", "of")


def overlap(assigned: DataFrame, group: str) -> DataFrame:
    """Groups that are in more than one partition; empty for a sound split."""
    return assigned.groupBy(group).agg(F.count_distinct("partition").alias("n")).where("n > 1")


def temporal(rows: DataFrame, at: str, share: float = 0.2) -> DataFrame:
    """Whether a row is among the last share by time. Counts by time come first; ties stay together in the test part."""
    counts = rows.groupBy(at).agg(F.count(F.lit(1)).alias("n"))
    upto = prefix.running(counts, at, ["n"])
    edge = upto.where(F.col("n_upto") - F.col("n") >= F.floor(F.col("n_all") * (1 - share))).agg(F.min(at).alias("edge"))
    return rows.join(F.broadcast(edge)).withColumn("is_test", F.coalesce(F.col(at) >= F.col("edge"), F.lit(False))).drop("edge")

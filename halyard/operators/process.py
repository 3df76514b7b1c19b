"""Process mining: transitions, dwell times, participation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINES = (1, 2, 3, 4)


def steps(events: DataFrame) -> DataFrame:
    """Each event with the next status of its request and when that began."""
    own = Window.partitionBy("request_id").orderBy("entered_at", "event_id")
    return events.withColumns({"next_status": F.lead("status").over(own), "left_at": F.lead("entered_at").over(own)})


def shared(counts: DataFrame, count: str = "n") -> DataFrame:
    """Counts with their share of all; the total is one row."""
    return counts.withColumn("share", F.round(F.col(count) / F.sum(count).over(Window.partitionBy()), 6))


def transitions(events: DataFrame) -> DataFrame:
    moved = steps(events).where("next_status IS NOT NULL")
    return shared(moved.groupBy("status", "next_status").agg(F.count(F.lit(1)).alias("n")))


def dwell(events: DataFrame) -> DataFrame:
    """Median seconds in each status, of stays that ended and did not end before they began."""
    seconds = F.unix_micros(F.col("left_at").cast("timestamp")) - F.unix_micros(F.col("entered_at").cast("timestamp"))
    return steps(events).where("left_at >= entered_at").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.median(seconds) / 1e6, 3).alias("median_seconds"))


def lines_of() -> Column:
    """The numbers of the lines that took part."""
    return F.filter(F.array(*(F.when(F.col(f"line{i}") > 0, F.lit(i)) for i in LINES)), lambda x: x.isNotNull())


def combinations(tickets: DataFrame) -> DataFrame:
    """Participation signatures such as ``1+3`` with counts, overdue rate and median duration."""
    named = tickets.select(F.array_join(lines_of(), "+").alias("combination"), "overdue", "duration_seconds").where("combination <> ''")
    return named.groupBy("combination").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("overdue").cast("int")), 6).alias("overdue_rate"), F.round(F.median("duration_seconds"), 1).alias("median_duration"))


def resolver_edges(tickets: DataFrame) -> DataFrame:
    """Participating line to resolving line."""
    return tickets.select(F.explode(lines_of()).alias("line"), "final_line").groupBy("line", "final_line").agg(F.count(F.lit(1)).alias("n"))


def co_participation(tickets: DataFrame) -> DataFrame:
    """Pairs of lines on one ticket. At most six pairs a ticket, made in place rather than by a join."""
    lines = F.col("lines")
    pairs = F.flatten(F.transform(lines, lambda a: F.transform(F.filter(lines, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return shared(tickets.select(lines_of().alias("lines")).select(F.inline(pairs)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")))


def nearest_rank(values: str, q: float, counts: DataFrame, keys: list[str]) -> DataFrame:
    """The value at place ``round((n - 1) * q)``, halves to even, of values with counts ``n``."""
    own = Window.partitionBy(*keys)
    upto = counts.withColumns({"upto": F.sum("n").over(own.orderBy(values)), "total": F.sum("n").over(own)})
    return upto.where(F.col("upto") > F.bround((F.col("total") - 1) * q, 0)).groupBy(*keys).agg(F.min(values).alias("value"))


def single_and_multi(tickets: DataFrame) -> DataFrame:
    """Durations of tickets with one line and with several: count, median, nearest-rank 90th percentile."""
    rows = tickets.select((F.size(lines_of()) > 1).alias("multi"), "duration_seconds").where("duration_seconds IS NOT NULL")
    ranks = nearest_rank("duration_seconds", 0.9, rows.groupBy("multi", "duration_seconds").agg(F.count(F.lit(1)).alias("n")), ["multi"])
    return rows.groupBy("multi").agg(F.count(F.lit(1)).alias("n"), F.round(F.median("duration_seconds"), 1).alias("median_duration")).join(ranks, "multi").withColumnRenamed("value", "p90")

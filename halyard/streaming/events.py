"""Structured Streaming on the event log (an extension: the batch queries define the results)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WATERMARK = "10 minutes"


def stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(folder)


def deduplicated(events: DataFrame) -> DataFrame:
    """Late rows within the watermark count once by (user_id, event_type, ts)."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", WATERMARK).dropDuplicatesWithinWatermark(["user_id", "event_type", "ts"])


def windowed(events: DataFrame, size: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts and sums by event type in tumbling or sliding windows."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", WATERMARK) if rows.isStreaming else rows
    return rows.groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", WATERMARK) if rows.isStreaming else rows
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def transitions(events: DataFrame) -> DataFrame:
    """Status changes of each user as they arrive, with the last status as state."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        out = []
        for status in rows["event_type"]:
            if last is not None:
                out.append((key[0], last, status))
            last = status
        state.update((last,))
        yield pd.DataFrame(out, columns=["user_id", "status", "next_status"])

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, status string, next_status string", "last string", "append", GroupStateTimeout.NoTimeout)


def drained(spark: SparkSession, df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what there is, into a table in memory; for reports of bounded size."""
    spark.sql(f"DROP VIEW IF EXISTS {name}")
    run = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


AUDIT = "user_id long, event_id long, kind string, before string, after string, applied boolean"


def moved(at: tuple[str, bool, bool], kind: str) -> tuple[tuple[str, bool, bool], bool]:
    """State, confirmed category and confirmed route after an event, and whether it counts; as ``records.folded``."""
    state, category, route = at
    if state != "saved" and kind == "analysis":
        return ("waiting_review", False, False), True
    if state != "saved" and kind == "error":
        return ("failed", category, route), True
    if state == "waiting_review" and kind == "category_confirmed":
        return (state, True, False), True
    if state == "waiting_review" and kind == "route_confirmed" and category:
        return (state, category, True), True
    if state == "waiting_review" and kind == "saved" and category and route:
        return ("saved", category, route), True
    return at, False


def audited(events: DataFrame) -> DataFrame:
    """An audit row for each event of ``user_id, event_id, ts, kind`` as it arrives, with the ticket's state before and after.

    The state of a ticket (three fields and a count) is all that is kept between batches. Events of a batch are taken in order of time
    and id; the last audit row of a ticket has its present state.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at = tuple(state.get) if state.exists else ("uploaded", False, False)
        out = []
        for r in pd.concat(list(parts)).sort_values(["ts", "event_id"]).itertuples():
            after, applied = moved(at, r.kind)
            out.append((key[0], r.event_id, r.kind, at[0], after[0], applied))
            at = after
        state.update(at)
        yield pd.DataFrame(out, columns=["user_id", "event_id", "kind", "before", "after", "applied"])

    return events.groupBy("user_id").applyInPandasWithState(step, AUDIT, "state string, category boolean, route boolean", "append", GroupStateTimeout.NoTimeout)

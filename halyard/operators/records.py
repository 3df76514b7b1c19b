"""Snapshots and logs of records: merges, revisions, staged states, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODES = ("snapshot", "delta", "upsert", "replace")


def merged(old: DataFrame, new: DataFrame, key: str, mode: str = "upsert") -> DataFrame:
    """``old`` after an import of ``new``, with ``change``: inserted, updated, unchanged, kept or deleted.

    A row is updated if any column differs (nulls are equal to nulls). Only ``replace`` deletes.
    """
    if mode not in MODES:
        raise ValueError(mode)
    columns = [c for c in old.columns if c != key]
    left = old.select(F.col(key), F.struct(*columns).alias("before"))
    right = new.select(F.col(key), F.struct(*columns).alias("after"))
    rows = left.join(right, key, "full_outer")
    change = (
        F.when(F.col("before").isNull(), "inserted")
        .when(F.col("after").isNull(), "deleted" if mode == "replace" else "kept")
        .when(F.col("before").eqNullSafe(F.col("after")), "unchanged")
        .otherwise("updated")
    )
    now = F.coalesce("after", "before")
    return rows.select(key, *(now[c].alias(c) for c in columns), change.alias("change"))


def appended(log: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not in the log yet, one for each key."""
    return new.dropDuplicates(keys).join(log, keys, "left_anti")


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order."""
    own = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(own)).where("_r = 1").drop("_r")


def changed_fields(before: str, after: str, fields: list[str]) -> Column:
    """The names of struct fields that differ."""
    return F.filter(F.array(*(F.when(~F.col(f"{before}.{f}").eqNullSafe(F.col(f"{after}.{f}")), F.lit(f)) for f in fields)), lambda x: x.isNotNull())


def revisions(old: DataFrame, edits: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A revision for each edit that changes something: changed fields, and both versions as JSON."""
    pair = edits.select(key, F.struct(*fields).alias("after")).join(old.select(key, F.struct(*fields).alias("before")), key)
    return pair.withColumn("changed_fields", changed_fields("before", "after", fields)).where(F.size("changed_fields") > 0).select(key, "changed_fields", F.to_json("before").alias("before"), F.to_json("after").alias("after"))


def folded(events: DataFrame, key: str, kind: str, *order: str) -> DataFrame:
    """The state of each key after its events, oldest first.

    uploaded → waiting_review by ``analysis``; failed by ``error``; category_confirmed by
    ``category_confirmed`` (which clears a confirmed route); route_confirmed by ``route_confirmed`` after a
    category; saved by ``saved`` after both. Events that a state does not allow change nothing.
    """
    log = events.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, kind))).alias("log"))
    start = F.struct(F.lit("uploaded").alias("state"), F.lit(False).alias("category"), F.lit(False).alias("route"), F.lit(0).alias("n_applied"))

    def step(s: Column, e: Column) -> Column:
        k = e[kind]
        done = s["state"] == "saved"
        is_analysis, is_error = (k == "analysis") & ~done, (k == "error") & ~done
        is_category = (k == "category_confirmed") & (s["state"] == "waiting_review")
        is_route = (k == "route_confirmed") & (s["state"] == "waiting_review") & s["category"]
        is_saved = (k == "saved") & (s["state"] == "waiting_review") & s["category"] & s["route"]
        state = F.when(is_analysis, "waiting_review").when(is_error, "failed").when(is_saved, "saved").otherwise(s["state"])
        applied = is_analysis | is_error | is_category | is_route | is_saved
        return F.struct(
            state.alias("state"),
            F.when(is_analysis, False).when(is_category, True).otherwise(s["category"]).alias("category"),
            F.when(is_analysis | is_category, False).when(is_route, True).otherwise(s["route"]).alias("route"),
            (s["n_applied"] + applied.cast("int")).alias("n_applied"),
        )

    return log.select(key, F.aggregate("log", start, step).alias("s")).select(key, "s.*")


def precedence_union(*sources: DataFrame, key: str) -> DataFrame:
    """All rows by name; for a key in several sources the last source's row stands."""
    rows = None
    for i, s in enumerate(sources):
        s = s.withColumn("_source", F.lit(i))
        rows = s if rows is None else rows.unionByName(s, allowMissingColumns=True)
    return latest(rows, [key], F.desc("_source")).drop("_source")

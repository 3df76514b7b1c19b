"""Readers and writers for logs, samples, artefacts and caches."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions import scalars as S

EVENT_COLUMNS = ("request_id", "status", "entered_at")


def need(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_event_log(spark: SparkSession, uri: str) -> DataFrame:
    """An event log, times parsed, blank rows dropped: CSV (UTF-8, with or without a mark at its start) or, where ``uri`` ends in .xlsx, a workbook or a folder of workbooks."""
    if uri.lower().endswith(".xlsx"):
        from halyard.sources.workbook import read_workbook

        return event_rows(read_workbook(spark, uri))
    return event_rows(spark.read.csv(uri, header=True, encoding="UTF-8"))


def event_rows(raw: DataFrame) -> DataFrame:
    """The rows of a log as text, typed; a missing column of the required ones raises an error."""
    named = raw.toDF(*(c.lstrip("\ufeff").strip() for c in raw.columns))
    rows = need(named, EVENT_COLUMNS)
    rows = rows.withColumns({"left_at": F.col("left_at") if "left_at" in rows.columns else F.lit(None).cast("string"), "source": F.col("source") if "source" in rows.columns else F.lit(None).cast("string")})
    parsed = rows.select(S.request_id("request_id").alias("request_id"), F.trim("status").alias("status"), S.excel_or_iso("entered_at").alias("entered_at"), S.excel_or_iso("left_at").alias("left_at"), "source")
    return parsed.where("request_id <> '' AND status <> '' AND entered_at IS NOT NULL")


#: Text fields of a record that are empty, not null, where they are missing.
FILLED = ("service", "category", "request_type", "description", "criticality", "urgency", "priority", "service_class", "timezone", "status", "final_line", "result")


def full_record(raw: DataFrame, names: dict[str, str], source_hash: str, updated_at: str, users: tuple[str, ...] = (), late: str = "overdue") -> DataFrame:
    """The 29 columns of a stored record from raw rows of text.

    ``names`` maps logical names to the columns of ``raw``; absent ones are empty, or null where the record allows it. ``users`` are
    columns that may name the user, the first filled one counts. A line took part if it has a time of reaction or of
    work above zero. ``raw_json`` has all raw columns in order of their names.
    """
    own = {c: f"`{p}`" for c, p in names.items() if p in raw.columns}
    text = lambda c: F.col(own[c]).cast("string") if c in own else F.lit(None).cast("string")
    filled = {c: F.coalesce(text(c), F.lit("")) for c in FILLED}
    named_users = [f"`{c}`" for c in users if c in raw.columns]
    lines = [S.participated(S.duration_seconds(text(f"line{i}_reaction")), S.duration_seconds(text(f"line{i}_work"))) for i in range(1, 5)]
    columns = {
        "request_id": S.request_id(text("request_id")),
        "registration_date": S.excel_or_iso(text("registration_date")),
        "user_name": S.first_filled(*named_users) if named_users else F.lit(None).cast("string"),
        "service": filled["service"],
        "component": F.nullif(text("component"), F.lit("")),
        **{c: filled[c] for c in ("category", "request_type", "description")},
        "normalized_description": S.normalised(filled["description"]),
        **{c: filled[c] for c in ("criticality", "urgency", "priority", "service_class", "timezone", "status")},
        "overdue": S.overdue(text("overdue"), late).cast("int"),
        "final_line": filled["final_line"],
        "actual_duration_seconds": S.duration_seconds(text("actual_duration")),
        "clarifications_count": F.coalesce(text("clarifications_count").try_cast("double").cast("int"), F.lit(0)),
        "clarification_seconds": S.duration_seconds(text("clarification_duration")),
        **{f"line{i}_participated": x for i, x in enumerate(lines, 1)},
        "participants_count": sum(lines[1:], lines[0]),
        "result": filled["result"],
        "raw_json": F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(raw.columns))), {"ignoreNullFields": "false"}),
        "source_hash": F.lit(source_hash),
        "updated_at": F.lit(updated_at),
    }
    return raw.select(*(x.alias(c) for c, x in columns.items()))


def unique_ids(rows: DataFrame, key: str = "request_id") -> DataFrame:
    """``rows`` as they are; ids that are blank or occur twice raise an error that names some."""
    bad = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | (F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))) == "")).orderBy(key).limit(5).collect()
    if bad:
        raise ValueError(f"ids that are blank or not unique: {', '.join(str(r[key]) for r in bad)}")
    return rows


def header_key(name: str) -> str:
    """Case, white space and the two forms of the letter io do not tell headers apart."""
    return re.sub(r"\s+", " ", name.strip().lower()).replace("ё", "е")


def by_alias(df: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Columns under logical names; the first alias that is there wins, absent ones are null."""
    found = {header_key(c): c for c in reversed(df.columns)}
    pick = {name: next((found[header_key(a)] for a in (name, *alts) if header_key(a) in found), None) for name, alts in aliases.items()}
    return df.select(*(F.col(f"`{c}`").alias(n) if c else F.lit(None).cast("string").alias(n) for n, c in pick.items()))


def by_config(df: DataFrame, columns: dict[str, str], defaults: dict[str, object]) -> DataFrame:
    """Logical columns by their configured physical names; where one is absent or null, its default."""
    def value(name: str, physical: str) -> Column:
        own = F.col(f"`{physical}`") if physical in df.columns else F.lit(None)
        return F.coalesce(own, F.lit(defaults.get(name))) if name in defaults else own

    return df.select(*(value(n, c).alias(n) for n, c in columns.items()))


def staged(df: DataFrame, batch_id: str, text: str = "description", key: str = "request_id", first_row: int = 2, least: int = 10) -> DataFrame:
    """Upload rows with a row number, a state and flags; rows without any value are dropped.

    ``row_number`` follows file order. A row with an id only has failed; a short text is low information.
    """
    values = F.array(*(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns if c != key))
    usable = F.exists(values, lambda x: x != "")
    own_id = F.trim(F.coalesce(F.col(key).cast("string"), F.lit("")))
    kept = df.where(usable | (own_id != "")).withColumn("_order", F.monotonically_increasing_id())
    counts = kept.groupBy(F.spark_partition_id().alias("_part")).agg(F.count(F.lit(1)).alias("n"), F.min("_order").alias("first"))
    from pyspark.sql import Window

    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "first", "start")
    rows = kept.withColumn("_part", F.shiftright("_order", 33).cast("int")).join(F.broadcast(starts), "_part")
    number = F.col("start") + F.col("_order") - F.col("first") + first_row
    return rows.select(F.lit(batch_id).alias("batch_id"), number.alias("row_number"), *df.columns, F.when(usable, "uploaded").otherwise("failed").alias("state"), (F.length(F.trim(F.coalesce(F.col(text).cast("string"), F.lit("")))) < least).alias("low_information"))


def read_samples(spark: SparkSession, uri: str, schema: str = "text string, label string, weight double, flags array<string>") -> DataFrame:
    """JSON lines; rows without text or label are dropped."""
    return spark.read.schema(schema).json(uri).where("trim(coalesce(text, '')) <> '' AND trim(coalesce(label, '')) <> ''")


def read_results(spark: SparkSession, uri: str, schema: str) -> DataFrame:
    """JSON artefacts of runs that are complete; files that cannot be parsed are left out."""
    return spark.read.schema(schema).json(uri, multiLine=True, mode="DROPMALFORMED").where("status = 'complete'")


def write_csv(df: DataFrame, uri: str) -> None:
    df.write.csv(uri, header=True, mode="overwrite")


def write_lines(df: DataFrame, uri: str) -> None:
    df.write.json(uri, mode="overwrite")


def hash_manifest(spark: SparkSession, uri: str) -> DataFrame:
    """``path, length, sha256`` of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(uri)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def inventory(manifest: DataFrame, root: str, parts: tuple[str, ...] = (), prefixes: tuple[str, ...] = (), suffixes: tuple[str, ...] = ()) -> DataFrame:
    """``manifest`` with ``relative``, the path below ``root``, and ``included``.

    A file is left out if a part of its relative path is one of ``parts`` or begins with one of ``prefixes``, or if its
    name ends with one of ``suffixes``. A file that is not below ``root`` has no relative path and is left out.
    """
    path, top = F.regexp_replace("path", "^file:/+", "/"), re.sub("^file:/+", "/", root).rstrip("/") + "/"
    relative = F.when(F.startswith(path, F.lit(top)), F.substring(path, F.lit(len(top) + 1), F.length(path)))
    named = lambda x: reduce(Column.__or__, [*(x == v for v in parts), *(F.startswith(x, F.lit(v)) for v in prefixes)], F.lit(False))
    ends = reduce(Column.__or__, [F.endswith("relative", F.lit(v)) for v in suffixes], F.lit(False))
    out = manifest.withColumn("relative", relative)
    return out.withColumn("included", F.coalesce(~(F.exists(F.split("relative", "/"), named) | ends), F.lit(False)))


def snapshot(files: DataFrame, path: str = "relative") -> DataFrame:
    """One row, ``files, bytes, sha256``: a hash of all paths and contents that no order of the rows changes.

    Files are hashed in 256 groups by a hash of their path first, then the groups; each line has the hash and the path.
    """
    line = F.concat("sha256", F.lit("  "), F.col(path))
    group = F.substring(F.sha2(F.col(path).cast("binary"), 256), 1, 2)
    hashed = lambda c: F.sha2(F.array_join(F.sort_array(F.collect_list(c)), "\n").cast("binary"), 256)
    groups = files.groupBy(group.alias("g")).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("b"), hashed(line).alias("h"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"), hashed(F.concat("h", F.lit("  "), "g")).alias("sha256"))


def verified(found: DataFrame, expected: DataFrame, key: str = "path") -> DataFrame:
    """``key, state`` of two manifests with ``sha256``: same, changed, missing (not found) or new (not expected)."""
    rows = found.select(key, F.col("sha256").alias("own")).join(expected.select(key, F.col("sha256").alias("want")), key, "full")
    state = F.when(F.col("own").isNull(), "missing").when(F.col("want").isNull(), "new").when(F.col("own") == F.col("want"), "same").otherwise("changed")
    return rows.select(key, state.alias("state"))


def cached_scores(rows: DataFrame, cache: DataFrame | None, compute: Callable[[DataFrame], DataFrame], text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Values of a costly function by content: those in the cache, and those that are new (to append to it).

    ``compute`` gets distinct texts with their ``key`` and returns ``key, value``.
    """
    keyed = rows.withColumn("key", S.fingerprint(text, 64))
    asked = keyed.select("key", text).dropDuplicates(["key"])
    new = compute(asked if cache is None else asked.join(cache, "key", "left_anti"))
    known = new if cache is None else cache.select("key", "value").unionByName(new)
    return keyed.join(known, "key").drop("key"), new

"""Service-level aggregates: filters, breakdowns, series, smoothed risk."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.functions import scalars as S
from halyard.session import stored
from halyard.operators import prefix

DIMENSIONS = ("service", "category", "priority", "final_line")


def filtered(tickets: DataFrame, start: date | None = None, end: date | None = None, **facets: str | None) -> DataFrame:
    """Rows from the start of ``start`` to the end of ``end`` whose facets are equal; what is None does not filter."""
    rows = tickets
    if start:
        rows = rows.where(F.col("registration_date") >= F.lit(str(start)).cast("timestamp"))
    if end:
        rows = rows.where(F.col("registration_date") < F.lit(str(end + timedelta(days=1))).cast("timestamp"))
    for name, value in facets.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows


def whole(c: Column) -> Column:
    """An interpolated percentile as a whole number; 0 where there are no values."""
    return F.coalesce(F.floor(F.round(c, 3)), F.lit(0))


def global_rate(tickets: DataFrame) -> DataFrame:
    """One row: the overdue rate of all tickets, whatever a report filters."""
    return tickets.agg(F.coalesce(F.avg(F.col("overdue").cast("int")), F.lit(0.0)).alias("global_rate"))


def measures() -> list[Column]:
    late = F.col("overdue").cast("int")
    return [
        F.count(F.lit(1)).alias("n"),
        F.sum(late).alias("n_overdue"),
        F.percentile("duration_seconds", F.lit(0.5)).alias("q50"),
        F.percentile("duration_seconds", F.lit(0.9)).alias("q90"),
        F.avg("duration_seconds").alias("mean_duration"),
        F.avg("clarifications").alias("mean_clarifications"),
    ]


def finished(agg: DataFrame, rate: DataFrame) -> DataFrame:
    """Rates and whole percentiles; ``rate`` is one row (:func:`global_rate`)."""
    return agg.join(F.broadcast(rate)).select(
        *(c for c in agg.columns if c not in ("n", "n_overdue", "q50", "q90", "mean_duration", "mean_clarifications")),
        "n",
        "n_overdue",
        F.round(F.col("n_overdue") / F.col("n"), 6).alias("raw_rate"),
        F.round(S.smoothed("n_overdue", "n", "global_rate"), 6).alias("smoothed_risk"),
        whole(F.col("q50")).alias("p50"),
        whole(F.col("q90")).alias("p90"),
        F.round("mean_duration", 3).alias("mean_duration"),
        F.round("mean_clarifications", 6).alias("mean_clarifications"),
    )


def breakdown(tickets: DataFrame, dimension: str, rate: DataFrame) -> DataFrame:
    """A dimension's values with counts, rates and percentiles; null and empty values form one group."""
    value = F.coalesce(F.nullif(F.col(dimension), F.lit("")), F.lit("not specified"))
    return finished(tickets.groupBy(value.alias("value")).agg(*measures()), rate)


def breakdowns(tickets: DataFrame, rate: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """All dimensions and the total in one pass over the tickets, by grouping sets."""
    rows = tickets.select(*(F.coalesce(F.nullif(F.col(d), F.lit("")), F.lit("not specified")).alias(d) for d in dimensions), "overdue", "duration_seconds", "clarifications")
    sets = [[F.col(d)] for d in dimensions] + [[]]
    agg = rows.groupingSets(sets, *(F.col(d) for d in dimensions)).agg(F.grouping_id().alias("g"), *measures())
    bit = {d: (1 << len(dimensions)) - 1 - (1 << (len(dimensions) - 1 - i)) for i, d in enumerate(dimensions)}
    name = F.lit("total")
    value = F.lit("all")
    for d, g in bit.items():
        name, value = F.when(F.col("g") == g, d).otherwise(name), F.when(F.col("g") == g, F.col(d)).otherwise(value)
    return finished(agg.withColumns({"dimension": name, "value": value}).drop(*dimensions, "g"), rate)


def threshold(tickets: DataFrame, q: float = 0.9, least: int = 3) -> DataFrame:
    """One row: the value at place ``ceil(q * (n - 1))`` of all clarifications, ``least`` at least.

    Counts by value come first, so what is sorted is the values that occur and not the rows.
    """
    counts = tickets.groupBy(F.col("clarifications").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    place = F.ceil(q * (F.col("n_all") - 1))
    return prefix.running(counts, "v", ["n"]).where(F.col("n_upto") > place).agg(F.greatest(F.coalesce(F.min("v"), F.lit(0)), F.lit(least)).alias("threshold"))


def monthly(tickets: DataFrame) -> DataFrame:
    return tickets.groupBy(F.date_format("registration_date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("overdue").cast("int")).alias("n_overdue"))


def gap_filled(tickets: DataFrame) -> DataFrame:
    """Monthly counts with zeros for months without tickets, from the first to the last month."""
    counts = tickets.groupBy(F.trunc("registration_date", "month").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    spine = counts.agg(F.min("month").alias("a"), F.max("month").alias("b")).select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    return spine.join(counts, "month", "left").select(F.date_format("month", "yyyy-MM").alias("month"), F.coalesce("n", F.lit(0)).alias("n"))


def segment_risk(tickets: DataFrame, levels: list[list[str]], least: int) -> DataFrame:
    """Each ticket's risk from its most specific segment with ``least`` tickets; else from all of them."""
    rows = tickets
    for i, keys in enumerate(levels):
        agg = tickets.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"n{i}"), F.sum(F.col("overdue").cast("int")).alias(f"k{i}"))
        rows = rows.join(agg, keys, "left")
    total = tickets.agg(F.count(F.lit(1)).alias("n_all"), F.sum(F.col("overdue").cast("int")).alias("k_all"))
    rows = rows.join(F.broadcast(total))
    level, n, k = F.lit("global"), F.col("n_all"), F.col("k_all")
    for i in range(len(levels) - 1, -1, -1):
        fits = F.col(f"n{i}") >= least
        level, n, k = F.when(fits, "+".join(levels[i])).otherwise(level), F.when(fits, F.col(f"n{i}")).otherwise(n), F.when(fits, F.col(f"k{i}")).otherwise(k)
    risk = S.smoothed(k, n, F.col("k_all") / F.col("n_all"))
    low, high = S.interval95(risk, n)
    grade = F.when(n >= 100, "high").when(n >= 30, "medium").otherwise("low")
    return rows.select("request_id", level.alias("level"), n.alias("support"), F.round(risk, 6).alias("risk"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), grade.alias("reliability"))


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def top(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order).limit(k)


def route_prior(tickets: DataFrame, least: int = 3) -> DataFrame:
    """``category, final_line, prior`` from history: smoothed by one a line; categories with fewer than ``least`` rows have none.

    Rows that an operator reviewed are left out. Lines are a fixed handful.
    """
    counts = tickets.where("source_hash <> 'operator-review'").groupBy("category", "final_line").agg(F.count(F.lit(1)).alias("n"))
    enough = counts.groupBy("category").agg(F.sum("n").alias("total")).where(F.col("total") >= least)
    lines = tickets.select("final_line").distinct().agg(F.sort_array(F.collect_set("final_line")).alias("lines"))
    spine = enough.join(F.broadcast(lines)).select("category", "total", F.size("lines").alias("k"), F.explode("lines").alias("final_line"))
    prior = spine.join(counts, ["category", "final_line"], "left").select("category", "final_line", ((F.coalesce("n", F.lit(0)) + 1) / (F.col("total") + F.col("k"))).alias("prior"))
    return stored(prior, "prior")  # its files tell joins that it is small, so that rows are not dealt by category


def routed(rows: DataFrame, model: DataFrame, likely: DataFrame, prior: DataFrame, share: float = 0.45) -> DataFrame:
    """``request_id, final_line, p``: the likeliest line of each row.

    ``model`` has ``request_id, final_line, p``; ``likely`` the weighted categories of each service. Their
    priors are mixed once a service; a service without any prior leaves the model alone. Ties go to the
    line that sorts first.
    """
    mixed = likely.join(prior, "category").groupBy("service", "final_line").agg((F.sum(F.col("weight") * F.col("prior")) / F.sum("weight")).alias("prior"))
    p = F.when(F.col("prior").isNull(), F.col("p")).otherwise(share * F.col("p") + (1 - share) * F.col("prior"))
    lines = rows.join(model, "request_id").join(mixed, ["service", "final_line"], "left").select("request_id", "final_line", p.alias("p"))
    ways = lines.groupBy("request_id").agg(F.sum("p").alias("total"), F.collect_list(F.struct("p", "final_line")).alias("ways"))  # one entry a line
    best = F.sort_array(F.transform("ways", lambda w: F.struct((-F.round(w["p"] / F.col("total"), 4)).alias("p"), w["final_line"].alias("final_line"))))[0]
    return ways.select("request_id", best["final_line"].alias("final_line"), (-best["p"]).alias("p"))


def category_evidence(rows: DataFrame, facets: list[str], k: int, confirmed: str = "operator-review") -> DataFrame:
    """``request_id, mode, category, weight``: the k likeliest categories of each ticket by its own facets, or its confirmed category alone.

    The share of a category is the product of its counts with each facet, each one more, over the power of its own count; counts
    are by category and facet, and shares are worked out once for each combination of facets. Rows with
    ``source_hash`` equal to ``confirmed`` have a confirmed category of weight one.
    """
    own = rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    cells = rows.select(*facets).distinct().join(own)
    w = F.lit(1.0)
    for f in facets:
        cells = cells.join(rows.groupBy(f, "category").agg(F.count(F.lit(1)).alias(f"n_{f}")), [f, "category"], "left")
        w = w * (F.coalesce(f"n_{f}", F.lit(0)) + 1)
    cells = cells.select(*facets, "category", F.round(w / F.pow("n", F.lit(len(facets) - 1)), 9).alias("w"))
    cell = Window.partitionBy(*facets)
    top = cells.select(*facets, "category", (F.col("w") / F.sum("w").over(cell)).alias("weight"), F.row_number().over(cell.orderBy(F.desc("w"), "category")).alias("i")).where(F.col("i") <= k)
    likely = stored(top.groupBy(*facets).agg(F.collect_list(F.struct("category", "weight")).alias("likely")), "likely")
    sure = F.col("source_hash") == confirmed
    found = F.when(sure, F.array(F.struct("category", F.lit(1.0).alias("weight")))).otherwise(F.col("likely"))
    joined = rows.join(likely, facets, "left").select("request_id", F.when(sure, "confirmed_category").otherwise("category_topk").alias("mode"), F.explode(found).alias("x"))
    return joined.select("request_id", "mode", "x.category", "x.weight")


def routed_by_evidence(model: DataFrame, likely: DataFrame, prior: DataFrame, share: float = 0.45, least: float = 0.55) -> DataFrame:
    """``request_id, mode, rank, final_line, p, accepted``: all lines of each row, the likeliest first.

    ``model`` has ``request_id, final_line, p``, ``likely`` the row's weighted categories. Their priors are mixed by weight; a row none of
    whose categories has a prior is left to the model. Ties go to the line that sorts first.
    """
    mixed = likely.join(prior, "category").groupBy("request_id", "final_line").agg((F.sum(F.col("weight") * F.col("prior")) / F.sum("weight")).alias("prior"))
    modes = likely.groupBy("request_id").agg(F.first("mode").alias("mode"))
    p = F.when(F.col("prior").isNull(), F.col("p")).otherwise(share * F.col("p") + (1 - share) * F.col("prior"))
    rows = model.join(modes, "request_id").join(mixed, ["request_id", "final_line"], "left").select("request_id", "mode", "final_line", p.alias("p"))
    own = Window.partitionBy("request_id")
    scored = rows.withColumn("p", F.round(F.col("p") / F.sum("p").over(own), 4))
    return scored.select("request_id", "mode", F.row_number().over(own.orderBy(F.desc("p"), "final_line")).cast("long").alias("rank"), "final_line", "p", (F.max("p").over(own) >= least).alias("accepted"))


def run_gate(log: DataFrame, run: str, candidate: str) -> DataFrame:
    """Each run's candidates by state (``completed``, ``skipped``, ``failed``, else open), and whether the run is complete.

    Complete: no candidate failed, none is both completed and skipped, and all are one of these.
    """
    is_ = lambda s: F.coalesce(F.bool_or(F.col("state") == s), F.lit(False))
    by = log.groupBy(run, candidate).agg(is_("completed").alias("c"), is_("skipped").alias("s"), is_("failed").alias("f"))
    counts = by.groupBy(run).agg(F.count(F.lit(1)).alias("candidates"), F.count_if("c").alias("completed"), F.count_if("s").alias("skipped"), F.count_if("f").alias("failed"), F.count_if(F.col("c") & F.col("s")).alias("overlapping"))
    whole = (F.col("failed") == 0) & (F.col("overlapping") == 0) & (F.col("completed") + F.col("skipped") == F.col("candidates"))
    return counts.withColumn("complete", whole)

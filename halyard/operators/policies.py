"""Small rules of the record workflow as column expressions, and the model registry as a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.functions import scalars as S


def learning_priority(category_review: Column, route_review: Column, margin: Column, low_information: Column) -> Column:
    """How much a case would teach: reviews asked for, a close call, little information."""
    score = 0.4 * category_review.cast("int") + 0.25 * route_review.cast("int") + 0.2 * (F.coalesce(margin, F.lit(1.0)) < 0.1).cast("int") + 0.15 * low_information.cast("int")
    return F.round(F.least(score, F.lit(1.0)), 3)


def capped_weight(raw: Column, tier: Column) -> Column:
    """Weights of synthetic rows, with caps for weak evidence."""
    return F.when(tier == "SYNTHETIC_ONLY", F.least(raw, F.lit(0.05))).when(tier == "SINGLE_REAL_ANCHOR", F.least(raw, F.lit(0.10))).otherwise(raw)


#: Support up to which a class gets so many synthetic rows; above, the last number.
ALLOCATION = ((1, 220), (5, 180), (10, 120), (20, 80), (50, 45))
ALLOCATION_ABOVE = 25


def allocation(support: Column) -> Column:
    out = F.lit(ALLOCATION_ABOVE)
    for limit, n in reversed(ALLOCATION):
        out = F.when(support <= limit, n).otherwise(out)
    return out


def review_reason(confidence: Column, margin: Column, threshold: float, least: float) -> Column:
    return F.when(confidence < threshold, F.concat(F.lit("confidence below "), F.format_string("%.1f%%", F.lit(100 * threshold)))).when(margin < least, "candidates are close").otherwise("unlike known cases")


def gated(label: Column, confidence: Column, threshold: float, unknown: str = "UNKNOWN") -> Column:
    """The label, or the unknown label below the threshold."""
    return F.when(confidence >= threshold, label).otherwise(unknown)


def dropped(rows: DataFrame, fields: list[str], scenario: str, rate: float, seed: int, key: str) -> DataFrame:
    """Fields set to null at a rate that only seed, scenario, row and field decide."""
    return rows.withColumns({f: F.when(S.uniform(F.lit(scenario), key, F.lit(f), seed=seed) >= rate, F.col(f)) for f in fields})


#: The optional fields of a record, and which of them each scenario without chance removes.
OPTIONAL = ("description", "user", "service", "component", "request_type", "criticality", "urgency", "priority", "service_class", "timezone")
REMOVED = {
    "full": (),
    "description_only": OPTIONAL[1:],
    "metadata_only": ("description",),
    "no_component": ("component",),
    "no_service": ("service",),
    "no_request_type": ("request_type",),
    "no_priority_criticality": ("priority", "criticality"),
}
#: The share of fields that each scenario of chance removes; the last one removes only components.
CHANCE = {"random_dropout_10": 0.1, "random_dropout_30": 0.3, "random_dropout_50": 0.5}
EMPIRICAL = ("empirical_missingness", {"component": 619 / 1931})


def scenarios(rows: DataFrame, key: str, seed: int = 31) -> DataFrame:
    """Each row under each of eleven scenarios of missing fields, in one pass; absent fields are added as null.

    Chance depends on seed, scenario, key and field alone, so a run repeats and no row affects another.
    """
    names = [*REMOVED, *CHANCE, EMPIRICAL[0]]
    whole = rows.withColumns({f: F.lit(None).cast("string") for f in OPTIONAL if f not in rows.columns})
    spread = whole.withColumn("scenario", F.explode(F.array(*map(F.lit, names))))

    def left(field: str) -> Column:
        gone = F.col("scenario").isin([name for name, fields in REMOVED.items() if field in fields])
        rate = F.lit(0.0)
        for name, share in CHANCE.items():
            rate = F.when(F.col("scenario") == name, share).otherwise(rate)
        rate = F.when(F.col("scenario") == EMPIRICAL[0], EMPIRICAL[1].get(field, 0.0)).otherwise(rate)
        return F.when(~gone & (S.uniform("scenario", key, F.lit(field), seed=seed) >= rate), F.col(field))

    return spread.withColumns({f: left(f) for f in OPTIONAL})


def with_typo(text: Column, key: str, seed: int) -> Column:
    """Two neighbouring characters exchanged at a place that key and seed decide; short texts stay."""
    at = (F.floor(S.uniform(key, seed=seed) * (F.length(text) - 3)) + 2).cast("int")
    swapped = F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + 1, F.lit(1)), F.substring(text, at, F.lit(1)), F.substring(text, at + 2, F.length(text)))
    return F.when(F.length(text) < 4, text).otherwise(swapped)


def registry_state(log: DataFrame) -> DataFrame:
    """``version, status`` after a log of ``at, action, version``.

    The first registration of a version stands. The last promotion of a registered version is the champion,
    earlier champions are archived, others are challengers.
    """
    first = log.where("action = 'register'").groupBy("version").agg(F.min("at").alias("registered"))
    promoted = log.where("action = 'promote'").join(first, "version").where("at >= registered").groupBy("version").agg(F.max("at").alias("promoted"))
    rows = first.join(promoted, "version", "left")
    last = F.max("promoted").over(Window.partitionBy())
    status = F.when(F.col("promoted").isNull(), "challenger").when(F.col("promoted") == last, "champion").otherwise("archived")
    return rows.select("version", status.alias("status"))


def in_all(models: list[DataFrame], key: str) -> DataFrame:
    """Keys that every model has, with whether all models agree on the truth; one aggregate, no chain of joins."""
    rows = None
    for i, m in enumerate(models):
        m = m.select(key, "truth", F.lit(i).alias("model"))
        rows = m if rows is None else rows.unionByName(m)
    return rows.groupBy(key).agg(F.count_distinct("model").alias("n"), F.count_distinct("truth").alias("truths")).where(F.col("n") == len(models)).select(key, (F.col("truths") == 1).alias("consistent"))

"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Cols = Column | str


def col(c: Cols) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalised(text: Cols) -> Column:
    """Lower case, runs of white space as one space, no space at the ends; null stays null."""
    return F.trim(F.regexp_replace(F.lower(col(text)), r"\s+", " "))


def group_key(text: Cols, request_id: Cols, prefix: str = "request:") -> Column:
    """The normalised text, or the prefixed id where it is empty."""
    norm = normalised(text)
    return F.when(F.coalesce(norm, F.lit("")) != "", norm).otherwise(F.concat(F.lit(prefix), col(request_id).cast("string")))


def fingerprint(value: Cols, digits: int = 16) -> Column:
    """The first hex digits of SHA-256."""
    return F.substring(F.sha2(col(value).cast("string").cast("binary"), 256), 1, digits)


def hash_bucket(value: Cols, buckets: int = 10) -> Column:
    """SHA-256's first 32 bits, modulo a number of buckets."""
    return (F.conv(fingerprint(value, 8), 16, 10).cast("long") % buckets).cast("int")


def duration_seconds(value: Cols) -> Column:
    """``H+:MM:SS`` with any number of hours; numbers below 10,000 are day fractions, larger ones seconds; else null."""
    text = F.trim(col(value).cast("string"))
    pattern = r"^(\d+):(\d{1,2}):(\d{1,2})$"
    part = lambda i: F.regexp_extract(text, pattern, i).try_cast("long")
    number = text.try_cast("double")
    days = F.when((number >= 0) & (number < 10000), F.bround(number * 86400, 0)).when(number >= 10000, F.floor(number)).cast("long")
    return F.when(text.rlike(pattern), part(1) * 3600 + part(2) * 60 + part(3)).otherwise(days)


def human_duration(seconds: Cols) -> Column:
    """``HH:MM:SS``, hours unbounded; null stays null."""
    s = col(seconds).cast("long")
    return F.when(s.isNotNull(), F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60))


def request_id(value: Cols) -> Column:
    """A number without fraction loses its point; other values are trimmed text."""
    number = col(value).try_cast("double")
    whole = number.isNotNull() & (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.when(whole, number.cast("long").cast("string")).otherwise(F.trim(col(value).cast("string")))


def excel_or_iso(value: Cols) -> Column:
    """A timestamp from ISO text or from days since 1899-12-30; else null."""
    text = F.trim(col(value).cast("string"))
    days = text.try_cast("double")
    serial = F.timestamp_micros((F.lit(-2209161600) * 1_000_000 + F.bround(days * 86400, 0) * 1_000_000).cast("long"))
    return F.when(days.isNotNull(), serial).otherwise(F.try_to_timestamp(text))


def overdue(value: Cols, literal: str = "overdue") -> Column:
    """True for true, 1 and the literal, in any case."""
    return F.coalesce(F.lower(F.trim(col(value).cast("string"))).isin("true", "1", literal), F.lit(False))


def participated(reaction: Cols, work: Cols) -> Column:
    """Whether a line has a reaction or a working time above zero."""
    return ((F.coalesce(col(reaction), F.lit(0)) > 0) | (F.coalesce(col(work), F.lit(0)) > 0)).cast("int")


def first_filled(*columns: Cols) -> Column:
    """The first column that is neither null nor blank."""
    return F.coalesce(*(F.nullif(F.trim(col(c).cast("string")), F.lit("")) for c in columns))


def or_missing(c: Cols, token: str = "__MISSING__") -> Column:
    return F.coalesce(F.nullif(F.trim(col(c).cast("string")), F.lit("")), F.lit(token))


def tagged_text(**fields: Cols) -> Column:
    """``name: value`` of the filled fields, joined by newlines."""
    return F.concat_ws("\n", *(F.when(F.coalesce(col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{k}: "), col(c).cast("string"))) for k, c in fields.items()))


def smoothed(k: Cols, n: Cols, rate: Cols, strength: int = 30) -> Column:
    """A rate of k in n, drawn to ``rate`` with the weight of ``strength`` rows."""
    return (col(k) + strength * col(rate)) / (col(n) + strength)


def interval95(rate: Cols, n: Cols) -> tuple[Column, Column]:
    """A normal interval of a rate, within 0 and 1."""
    half = 1.96 * F.sqrt(col(rate) * (1 - col(rate)) / F.greatest(col(n), F.lit(1)))
    return F.greatest(F.lit(0.0), col(rate) - half), F.least(F.lit(1.0), col(rate) + half)


def tokens(text: Cols) -> Column:
    """Words of letters and digits in lower case, decimals whole."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(r"([\p{L}\p{N}]+(?:[.,]\p{N}+)?)"), F.lit(1))


def word_ngrams(words: Cols, n: int) -> Column:
    """Runs of n words, joined by spaces.

    Shifted slices are zipped, so the words are computed a few times a row; indexing them inside a lambda
    would compute them again for every run.
    """
    w = col(words)
    count = F.greatest(F.size(w) - (n - 1), F.lit(0))
    grams = F.slice(w, 1, count)
    for k in range(1, n):
        grams = F.zip_with(grams, F.slice(w, k + 1, count), lambda a, b: F.concat(a, F.lit(" "), b))
    return grams


def char_ngrams(words: Cols, n: int) -> Column:
    """Runs of n characters of each word with a space at either side; a shorter word is one run."""
    padded = F.transform(col(words), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda w: F.when(F.length(w) <= n, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.length(w) - (n - 1)), lambda i: F.substring(w, i, n)))))


def dot(a: Cols, b: Cols) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Cols) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Cols, dims: int | None = None) -> Column:
    """The first dimensions at length 1; a zero vector stays."""
    part = F.slice(col(a), 1, dims) if dims else col(a)
    size = norm(part)
    return F.transform(part, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(0.0))


def edit_ratio(a: Cols, b: Cols) -> Column:
    """1 minus the Levenshtein distance by the longer length."""
    return 1 - F.levenshtein(col(a), col(b)) / F.greatest(F.length(col(a)), F.length(col(b)), F.lit(1))


def uniform(*parts: Cols, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the parts and the seed alone: the first 32 bits of SHA-256; null parts are empty."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(col(p).cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long") / float(1 << 32)

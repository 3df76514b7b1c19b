"""Lexical and dense retrieval as joins and aggregates.

Queries are a stated set of rows; scores come from joins on terms, so only pairs that share a term are
ever formed. Ranks order by the score rounded to nine places, then by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.functions import scalars as S
from halyard.session import stored

EVERY = 50
#: Terms whose document frequency goes to the tasks.
FREQUENT = 1 << 17


def terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, term, tf``."""
    words = docs.select(F.col(id_col).alias("doc_id"), F.explode(S.tokens(text_col)).alias("term"))
    return words.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf(tf: DataFrame, n: DataFrame) -> DataFrame:
    """Unit-length weights: ``1 + ln tf`` times ``ln((1 + n) / (1 + df)) + 1``. ``n`` is one row with the number of documents."""
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    w = tf.join(df, "term").join(F.broadcast(n)).select("doc_id", "term", ((1 + F.ln("tf")) * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    size = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
    return w.select("doc_id", "term", (F.col("w") / size).alias("w"))


class Weighted(NamedTuple):
    """Weights before they are brought to unit length: ``near`` has ``doc_id, terms, raw`` in rows of documents, ``far`` has ``doc_id, term, raw`` of rare terms."""

    near: DataFrame
    far: DataFrame


def counted(docs: DataFrame) -> DataFrame:
    """``doc_id, terms, tf``: a document's different terms stay in its row; only rows that share an id meet."""
    rows = docs.select("doc_id", S.tokens("text").alias("w")).where("size(w) > 0")
    several = stored(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "several")  # few, as its files tell
    same = rows.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.flatten(F.collect_list("w")).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("w")
            flat = words.flatten().dictionary_encode()
            row = np.repeat(np.arange(batch.num_rows), words.value_lengths().to_numpy(zero_copy_only=False))
            keys, tf = np.unique(row * len(flat.dictionary) + flat.indices.to_numpy(zero_copy_only=False), return_counts=True)
            yield lists(batch.column("doc_id"), keys // len(flat.dictionary), terms=flat.dictionary.take(pa.array(keys % len(flat.dictionary))), tf=pa.array(tf))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.join(several, "doc_id", "left_anti").unionByName(same).mapInArrow(run, f"doc_id {kind}, terms array<string>, tf array<long>")


def lists(ids: pa.Array, row: np.ndarray, **values: pa.Array) -> pa.RecordBatch:
    """Values of each row, in order of rows, as lists."""
    ends = pa.array(np.searchsorted(row, np.arange(len(ids) + 1)).astype(np.int32))
    return pa.RecordBatch.from_arrays([ids, *(pa.ListArray.from_arrays(ends, v) for v in values.values())], ["doc_id", *values])


def weighted(docs: DataFrame) -> Weighted:
    """Tf-idf of ``doc_id, text`` with what is frequent weighed inside the rows: only rare terms are shuffled to their frequency.

    The ``FREQUENT`` most frequent terms, which are most of a text, have theirs in every task.
    """
    n = docs.count()
    rows = stored(counted(docs), "counts")
    df = stored(rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "frequencies")
    top = df.orderBy(F.desc("df"), "term").limit(FREQUENT).toArrow()
    sent = docs.sparkSession.sparkContext.broadcast((top.column("term").combine_chunks(), top.column("df").to_numpy()))

    def split(frequent: bool, batch: pa.RecordBatch) -> pa.RecordBatch:
        known, often = sent.value
        terms, tf = batch.column("terms").flatten(), batch.column("tf").flatten()
        at = pc.fill_null(pc.index_in(terms, value_set=known), -1).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(batch.num_rows), batch.column("terms").value_lengths().to_numpy(zero_copy_only=False))
        some = np.nonzero((at >= 0) == frequent)[0]
        found = {"df": pa.array(often[at[some]])} if frequent else {}
        return lists(batch.column("doc_id"), row[some], terms=terms.take(pa.array(some)), tf=tf.take(pa.array(some)), **found)

    def weight(tf: Column, df: Column) -> Column:
        return (1 + F.ln(tf)) * (F.ln((1 + F.lit(n)) / (1 + df)) + 1)

    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, terms array<string>, tf array<long>"
    near = rows.mapInArrow(lambda batches: (split(True, b) for b in batches), f"{kind}, df array<long>")
    far = rows.mapInArrow(lambda batches: (split(False, b) for b in batches), kind)
    far = far.select("doc_id", F.explode(F.arrays_zip("terms", "tf")).alias("x")).select("doc_id", F.col("x.terms").alias("term"), F.col("x.tf").alias("tf"))
    return Weighted(near.select("doc_id", "terms", F.zip_with("tf", "df", weight).alias("raw")), far.join(df, "term").select("doc_id", "term", weight(F.col("tf"), F.col("df")).alias("raw")))


def lengths(w: Weighted) -> DataFrame:
    """``doc_id, n, size, top, total`` of the raw weights of each document, from one row of ``near`` and the sums of ``far``."""
    total = lambda f: F.aggregate("raw", F.lit(0.0), lambda s, x: s + f(x))
    near = w.near.select("doc_id", F.size("raw").cast("long").alias("n"), total(lambda x: x * x).alias("squares"), F.array_max("raw").alias("top"), total(lambda x: x).alias("total"))
    far = w.far.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("raw") * F.col("raw")).alias("squares"), F.max("raw").alias("top"), F.sum("raw").alias("total"))
    both = near.unionByName(far).groupBy("doc_id").agg(F.sum("n").alias("n"), F.sqrt(F.sum("squares")).alias("size"), F.max("top").alias("top"), F.sum("total").alias("total"))
    return both.where("n > 0")


def best_terms(w: Weighted, k: int, least: int) -> DataFrame:
    """``doc_id, term, rank`` of the k terms of most weight with ``least`` characters or more, ties at nine places by the term.

    A row's frequent terms are cut to what could be among its best before they leave it; the margin is wider than any tie.
    """
    long = w.near.select("doc_id", F.filter(F.arrays_zip("terms", "raw"), lambda x: F.length(x["terms"]) >= least).alias("x"))
    floor = F.coalesce(F.get(F.sort_array(F.col("x.raw"), asc=False), F.lit(k - 1)), F.lit(0.0)) * (1 - 1e-3)
    near = long.withColumn("floor", floor).select("doc_id", F.explode(F.filter("x", lambda x: x["raw"] >= F.col("floor"))).alias("x")).select("doc_id", F.col("x.terms").alias("term"), F.col("x.raw").alias("raw"))
    rows = near.unionByName(w.far.where(F.length("term") >= least)).join(lengths(w).select("doc_id", "size"), "doc_id")
    own = Window.partitionBy("doc_id").orderBy(F.desc(F.round(F.col("raw") / F.col("size"), 9)), "term")
    return rows.select("doc_id", "term", F.row_number().over(own).cast("long").alias("rank")).where(F.col("rank") <= k)


def weights_by_label(w: Weighted, labels: DataFrame, least: int) -> DataFrame:
    """``label, term, s``: sums of unit-length weights over the documents of each label (``doc_id, label``), for terms of ``least`` characters or more."""
    sizes = stored(lengths(w).join(labels, "doc_id").select("doc_id", "label", "size"), "sizes")
    near = w.near.join(sizes, "doc_id").select("label", "size", F.explode(F.arrays_zip("terms", "raw")).alias("x")).select("label", F.col("x.terms").alias("term"), (F.col("x.raw") / F.col("size")).alias("w"))
    far = w.far.join(sizes, "doc_id").select("label", "term", (F.col("raw") / F.col("size")).alias("w"))
    return near.unionByName(far).where(F.length("term") >= least).groupBy("label", "term").agg(F.sum("w").alias("s"))


def cosine(weights: DataFrame, every: int = EVERY) -> DataFrame:
    """``query_id, doc_id, score`` of pairs that share a term."""
    queries = weights.where(F.col("doc_id") % every == 0).select(F.col("doc_id").alias("query_id"), "term", F.col("w").alias("q"))
    return weights.join(queries, "term").where("doc_id <> query_id").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("w") * F.col("q")), 9).alias("score"))


def bm25_weights(tf: DataFrame, k1: float = 1.5, b: float = 0.75, floor: float = 0.25) -> DataFrame:
    """``doc_id, term, w, q``: Okapi weights of a term in a document, and its count, which is its weight in a query.

    An inverse frequency below zero becomes ``floor`` times the mean of all.
    """
    sizes = tf.groupBy("doc_id").agg(F.sum("tf").alias("dl"))
    corpus = sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    raw = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(corpus)).select("term", F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    idf = raw.join(F.broadcast(mean)).select("term", F.when(F.col("raw") < 0, floor * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return tf.join(idf, "term").join(sizes, "doc_id").join(F.broadcast(corpus)).select("doc_id", "term", part.alias("w"), F.col("tf").cast("double").alias("q"))


def bm25(tf: DataFrame, every: int = EVERY, k1: float = 1.5, b: float = 0.75, floor: float = 0.25) -> DataFrame:
    """Okapi scores of all pairs that share a term; for the best ones use ``lexical.top_k``."""
    weights = bm25_weights(tf, k1, b, floor)
    queries = weights.where(F.col("doc_id") % every == 0).select(F.col("doc_id").alias("query_id"), "term", F.col("q").alias("qtf"))
    pairs = weights.join(queries, "term").where("doc_id <> query_id").select("query_id", "doc_id", (F.col("qtf") * F.col("w")).alias("part"))
    return pairs.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))


def best(scores: DataFrame, k: int) -> DataFrame:
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(own).cast("long")).where(F.col("rank") <= k)


def distinct_groups(scores: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """The best k documents that are not in the query's own text group."""
    rows = scores.join(groups.select("doc_id", "group"), "doc_id").join(groups.select(F.col("doc_id").alias("query_id"), F.col("group").alias("own")), "query_id")
    return best(rows.where("group <> own").drop("group", "own"), k)


def fused(*rankings: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion."""
    rows = None
    for r in rankings:
        r = r.select("query_id", "doc_id", (1 / (k + F.col("rank"))).alias("s"))
        rows = r if rows is None else rows.unionByName(r)
    return rows.groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 9).alias("score"))


def minmax(scores: DataFrame) -> DataFrame:
    """Scores of each query from 0 to 1; all zero where they are equal."""
    own = Window.partitionBy("query_id")
    low, high = F.min("score").over(own), F.max("score").over(own)
    return scores.withColumns({"low": low, "high": high}).select("query_id", "doc_id", F.when(F.col("high") > F.col("low"), (F.col("score") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0).alias("score"))


def metrics(ranked: DataFrame, labels: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Hit and precision at k, mean reciprocal rank and nDCG at 10; a document is relevant if it shares the query's label."""
    rows = ranked.join(labels.select("doc_id", "label"), "doc_id").join(labels.select(F.col("doc_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    rel = (F.col("label") == F.col("own")).cast("int")
    gain = F.when(F.col("rank") <= 10, rel / F.log2(F.col("rank") + 1)).otherwise(0.0)
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(10), F.greatest(F.col("n_rel"), F.lit(1))).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    by_query = rows.groupBy("query_id").agg(
        *(F.max(F.when(F.col("rank") <= k, rel).otherwise(0)).alias(f"hit{k}") for k in ks),
        *((F.sum(F.when(F.col("rank") <= k, rel).otherwise(0)) / k).alias(f"precision{k}") for k in ks),
        F.coalesce(F.max(F.when(rel == 1, 1 / F.col("rank"))), F.lit(0.0)).alias("rr"),
        F.sum(gain).alias("dcg"),
        F.sum(F.when(F.col("rank") <= 10, rel).otherwise(0)).alias("n_rel"),
    )
    return by_query.agg(*(F.round(F.avg(c), 6).alias(c) for k in ks for c in (f"hit{k}", f"precision{k}")), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg(F.col("dcg") / ideal), 6).alias("ndcg10"))


def edit_candidates(names: DataFrame, least: float) -> DataFrame:
    """``a, b, at, start, size, i, d``: where segment ``i`` of a longer name ``b``, which begins at ``at``, stands in ``a`` at ``start``.

    A name ``b`` of n characters is within d = floor((1 - least) n) edits of its partner, so cut into d + 1
    segments it has one that is whole in ``a`` with at most i edits left of it and at most d - i right of it.
    These bounds fix the few places at which ``a`` is looked up.
    """
    known = names.select("name").where("name <> ''").distinct().withColumn("n", F.length("name"))
    start = "cast(floor(i * long / (d + 1)) as int)"
    size = f"cast(floor((i + 1) * long / (d + 1)) as int) - {start}"
    edits = F.floor(F.lit(1 - least) * F.col("long") + 1e-9).cast("int").alias("d")
    segments = known.select(F.col("name").alias("b"), F.col("n").alias("long")).select("b", "long", edits).select("*", F.expr("explode(sequence(0, d)) AS i"))
    segments = segments.select("b", "long", "d", "i", F.expr(start).alias("at"), F.expr(size).alias("size")).withColumn("part", F.expr("substring(b, at + 1, size)"))
    partners = known.select(F.col("name").alias("a"), "n", F.explode(F.sequence("n", F.floor(F.col("n") / least + 1e-9).cast("int"))).alias("long")).select("*", edits)
    partners = partners.where("long - n <= d").select("*", F.expr("explode(sequence(0, d)) AS i")).select("*", F.expr(start).alias("at"), F.expr(size).alias("size"))
    low = "greatest(-i, n - long - d + i, -at)"
    high = "least(i, n - long + d - i, n - size - at)"
    places = partners.where(f"{low} <= {high}").select("*", F.expr(f"explode(sequence({low}, {high})) AS off"))
    asked = places.select("a", "n", "long", "i", F.expr("at + off AS start"), F.expr("substring(a, at + off + 1, size)").alias("part"))
    return asked.join(segments, ["long", "i", "part"]).where("n < long OR a < b").select("a", "b", "at", "start", "size", "i", "d")


def edit_pairs(names: DataFrame, least: float = 0.6) -> DataFrame:
    """``a, b, ratio``: all pairs of the distinct values in ``names.name`` at an edit ratio of ``least`` or more, a < b.

    The parts left and right of a shared segment are measured where it is found, with their own limits, so
    what is sent on is found pairs and not candidates. Nulls and empty names have no pairs.
    """
    found = edit_candidates(names, least)
    left = "levenshtein(substring(a, 1, start), substring(b, 1, at), i) >= 0"
    right = "levenshtein(substring(a, start + size + 1), substring(b, at + size + 1), d - i) >= 0"
    met = found.where(f"{left} AND {right}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return met.withColumn("ratio", S.edit_ratio("a", "b")).where(F.col("ratio") >= least)


def vectors(embeddings: DataFrame, dims: int | None = None) -> DataFrame:
    """``vec_id, label, v`` with unit vectors."""
    return embeddings.select("vec_id", "label", S.unit("embedding", dims).alias("v"))


def nearest(v: DataFrame, every: int = EVERY) -> DataFrame:
    """``query_id, doc_id, score``: cosine of a stated query set with all rows.

    All scores of a stated query set are asked for, so each row meets each query. Which side is sent is
    left to the planner, which checks sizes.
    """
    queries = v.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    return v.join(queries, F.col("vec_id") != F.col("query_id")).select("query_id", F.col("vec_id").alias("doc_id"), F.round(S.dot("v", "q"), 9).alias("score"))


def centroids(v: DataFrame) -> DataFrame:
    """``label, c``: the unit mean vector of each label, by position, so no group of vectors is held together."""
    means = v.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    return means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m")).select("label", S.unit("m").alias("c"))

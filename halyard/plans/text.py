"""Queries on text: tokens, n-grams, weights, retrieval."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halyard.functions import scalars as S
from halyard.operators import lexical as L
from halyard.operators import retrieval as R
from halyard.plans.registry import query
from halyard.sources.domain import table

TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?:[.,]\p{N}+)?')"
TF = f"WITH words AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL)"
WEIGHTS = TF + """, df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), raw AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term)),
size AS (SELECT doc_id, sqrt(sum(w * w)) AS size FROM raw GROUP BY 1), weights AS (SELECT doc_id, term, w / size AS w FROM raw JOIN size USING (doc_id))"""
COSINE = WEIGHTS + """, cosine AS (SELECT q.doc_id AS query_id, d.doc_id, round(sum(q.w * d.w), 9) AS score FROM weights q JOIN weights d USING (term) WHERE q.doc_id % 50 = 0 AND q.doc_id <> d.doc_id GROUP BY ALL)"""
BM25 = """, sizes AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY 1), corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM sizes), rawidf AS (SELECT term, ln((n - df + 0.5) / (df + 0.5)) AS r FROM df, corpus),
idf AS (SELECT term, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM rawidf) ELSE r END AS idf FROM rawidf),
bm25 AS (SELECT q.doc_id AS query_id, d.doc_id, round(sum(q.tf * idf * d.tf * 2.5 / (d.tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf q JOIN tf d USING (term) JOIN idf USING (term) JOIN sizes ON sizes.doc_id = d.doc_id, corpus WHERE q.doc_id % 50 = 0 AND q.doc_id <> d.doc_id GROUP BY ALL)"""
RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def cosine_index(spark: SparkSession, sf_dir: str, groups: DataFrame | None = None, facets: DataFrame | None = None) -> L.Index:
    return L.cosine(L.read(docs(spark, sf_dir), groups=groups, facets=facets))


def bm25_index(spark: SparkSession, sf_dir: str) -> L.Index:
    return L.bm25(L.read(docs(spark, sf_dir)))


@query(f"SELECT doc_id, len({TOKENS}) AS n_tokens, len(list_distinct({TOKENS})) AS n_types FROM documents")
def sc10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = S.tokens("text")
    return docs(spark, sf_dir).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_types"))


NGRAMS = "SELECT doc_id, k, count(*) AS n, count(DISTINCT gram) AS n_distinct, min(gram) AS first, max(gram) AS last FROM g GROUP BY 1, 2"


def ngram_report(rows: DataFrame, grams: Callable[[int], Column], sizes: Sequence[int], total: Callable[[int], Column], own: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Counts and ends of the runs in ``doc_id, w``; ``grams(k)`` holds every different run of size k, ``total(k)`` is their number.

    A document's runs stay in its row. Only ids that several rows share meet in a shuffle of runs. ``own``, if
    given, reports on rows whose id is their own.
    """
    several = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("again"))
    same = F.col("doc_id").eqNullSafe(F.col("again"))

    def found(part: DataFrame) -> DataFrame:
        kinds = F.array(*(F.struct(F.lit(k).cast("long").alias("k"), total(k).cast("long").alias("n"), grams(k).alias("g")) for k in sizes))
        return part.select("doc_id", F.explode(kinds).alias("x")).select("doc_id", "x.*").where("n > 0")

    def in_row(part: DataFrame) -> DataFrame:
        kinds = found(part).select("doc_id", "k", "n", F.array_distinct("g").alias("g"))
        return kinds.select("doc_id", "k", "n", F.size("g").cast("long").alias("n_distinct"), F.array_min("g").alias("first"), F.array_max("g").alias("last"))

    single = (own or in_row)(rows.join(several, same, "left_anti"))
    shared = found(rows.join(several, same, "left_semi"))
    counts = shared.groupBy("doc_id", "k").agg(F.sum("n").alias("n"))
    ends = shared.select("doc_id", "k", F.explode("g").alias("g")).groupBy("doc_id", "k").agg(F.count_distinct("g").alias("n_distinct"), F.min("g").alias("first"), F.max("g").alias("last"))
    keys = counts.select(F.col("doc_id").alias("id"), F.col("k").alias("size"), "n")
    met = ends.join(keys, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("k") == F.col("size")))
    return single.unionByName(met.select("doc_id", "k", "n", "n_distinct", "first", "last"))


@query(f"WITH t AS (SELECT doc_id, {TOKENS} AS w FROM documents), g AS (SELECT doc_id, k, array_to_string(w[i : i + k - 1], ' ') AS gram FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM t, (SELECT unnest([1, 2, 3])::BIGINT AS k) WHERE len(w) >= k)) {NGRAMS}")
def sc11_word_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one to three words of each document."""
    words = docs(spark, sf_dir).select("doc_id", S.tokens("text").alias("w"))
    return ngram_report(words, lambda k: S.word_ngrams("w", k), (1, 2, 3), lambda k: F.greatest(F.size("w") - (k - 1), F.lit(0)))


CHARS = (2, 3, 4, 5, 6)


def char_report(rows: DataFrame) -> DataFrame:
    """``ngram_report`` of characters, row by row; runs of a word are cut once for as long as it is remembered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=1 << 15)
        def cut(word: str) -> list[tuple[frozenset[str], str, str]]:
            w = f" {word} "
            sets = [frozenset(w[i : i + k] for i in range(max(1, len(w) - k + 1))) for k in CHARS]
            return [(x, min(x), max(x)) for x in sets]

        for batch in batches:
            found = {c: [] for c in ("row", "k", "n", "n_distinct", "first", "last")}
            for row, words in enumerate(batch["w"].to_pylist()):
                if not words:
                    continue
                sizes = Counter(map(len, words))
                for k, parts in zip(CHARS, zip(*map(cut, set(words)))):
                    grams, low, high = zip(*parts)
                    n = sum(c * max(1, size + 3 - k) for size, c in sizes.items())
                    for c, x in zip(found, (row, k, n, len(set().union(*grams)), min(low), max(high))):
                        found[c].append(x)
            ids = batch["doc_id"].take(pa.array(found.pop("row"), pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.string() if c in ("first", "last") else pa.int64()) for c, x in found.items())], ["doc_id", *found])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "w").mapInArrow(run, f"doc_id {kind}, k long, n long, n_distinct long, first string, last string")


def char_ngram_report(rows: DataFrame) -> DataFrame:
    """The report of ``doc_id, w, d``; different runs are those of the different words ``d``."""
    total = lambda k: F.coalesce(F.aggregate("w", F.lit(0).cast("long"), lambda s, w: s + F.greatest(F.length(w) + (3 - k), F.lit(1))), F.lit(0))
    return ngram_report(rows, lambda k: S.char_ngrams("d", k), CHARS, total, char_report)


@query(f"WITH t AS (SELECT doc_id, ' ' || unnest({TOKENS}) || ' ' AS w FROM documents), g AS (SELECT doc_id, k, CASE WHEN length(w) <= k THEN w ELSE substr(w, i, k) END AS gram FROM (SELECT doc_id, w, k, unnest(range(1, greatest(2, length(w) - k + 2))) AS i FROM t, (SELECT unnest([2, 3, 4, 5, 6])::BIGINT AS k))) {NGRAMS}")
def sc11_char_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two to six characters in the words of each document."""
    return char_ngram_report(docs(spark, sf_dir).select("doc_id", S.tokens("text").alias("w")).select("doc_id", "w", F.array_distinct("w").alias("d")))


@query(WEIGHTS + " SELECT doc_id, count(*) AS n, round(max(w), 6) AS top, round(sum(w), 6) AS total FROM weights GROUP BY 1")
def sc12_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.lengths(R.weighted(docs(spark, sf_dir)))
    return found.select("doc_id", "n", *(F.round(F.col(c) / F.col("size"), 6).alias(c) for c in ("top", "total")))


@query(COSINE + f", b AS (SELECT query_id, cosine.doc_id, score + CASE WHEN q.source = d.source THEN 0.08 ELSE 0 END + CASE WHEN q.lang = d.lang THEN 0.05 ELSE 0 END AS score FROM cosine JOIN documents q ON q.doc_id = query_id JOIN documents d ON d.doc_id = cosine.doc_id) SELECT query_id, doc_id, round(score, 6) AS score, {RANK} AS rank FROM b WHERE score >= 0.2 QUALIFY rank <= 5")
def pl01_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine with a boost for equal facets, rejected below 0.2."""
    facets = docs(spark, sf_dir).select("doc_id", F.array("source", "lang").alias("facets"))
    return L.top_k(cosine_index(spark, sf_dir, facets=facets), 5, {0: 0.08, 1: 0.05}, 0.2).withColumn("score", F.round("score", 6))


@query(WEIGHTS + BM25 + f" SELECT query_id, doc_id, round(score, 3) AS score, {RANK} AS rank FROM bm25 QUALIFY rank <= 5")
def pl02_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.top_k(bm25_index(spark, sf_dir), 5).withColumn("score", F.round("score", 3))


@query(COSINE + f", g AS (SELECT doc_id, sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS g FROM documents), f AS (SELECT c.* FROM cosine c JOIN g a ON a.doc_id = c.doc_id JOIN g b ON b.doc_id = c.query_id WHERE a.g <> b.g) SELECT query_id, doc_id, {RANK} AS rank FROM f QUALIFY rank <= 5")
def wn12_other_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = docs(spark, sf_dir).select("doc_id", S.fingerprint(S.normalised("text"), 64).alias("group"))
    groups = keys.join(keys.groupBy("group").agg(F.min("doc_id").alias("own")), "group").select("doc_id", "own")
    return L.top_k(cosine_index(spark, sf_dir, groups), 5).drop("score")


@query(COSINE + BM25 + f", a AS (SELECT query_id, doc_id, {RANK} AS rank FROM cosine QUALIFY rank <= 20), b AS (SELECT query_id, doc_id, {RANK} AS rank FROM bm25 QUALIFY rank <= 20), f AS (SELECT query_id, doc_id, round(sum(1 / (60 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL) SELECT query_id, doc_id, round(score, 6) AS score, {RANK} AS rank FROM f QUALIFY rank <= 5")
def wn13_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = L.read(docs(spark, sf_dir))
    return R.best(R.fused(L.top_k(L.cosine(texts), 20), L.top_k(L.bm25(texts), 20)), 5).withColumn("score", F.round("score", 6))


@query(COSINE + " SELECT query_id, doc_id, round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w), 6) AS score FROM cosine WINDOW w AS (PARTITION BY query_id)")
def wn14_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.minmax(cosine_index(spark, sf_dir)).withColumn("score", F.round("score", 6))


METRICS = """, rr AS (SELECT r.query_id, r.rank, CAST(d.label = q.label AS INT) AS rel FROM ranked r JOIN l d ON d.id = r.doc_id JOIN l q ON q.id = r.query_id),
m AS (SELECT query_id, max(CASE WHEN rank <= 1 THEN rel ELSE 0 END) AS hit1, max(CASE WHEN rank <= 3 THEN rel ELSE 0 END) AS hit3, max(CASE WHEN rank <= 5 THEN rel ELSE 0 END) AS hit5, sum(CASE WHEN rank <= 1 THEN rel ELSE 0 END) / 1 AS precision1,
 sum(CASE WHEN rank <= 3 THEN rel ELSE 0 END) / 3 AS precision3, sum(CASE WHEN rank <= 5 THEN rel ELSE 0 END) / 5 AS precision5, coalesce(max(CASE WHEN rel = 1 THEN 1 / rank END), 0) AS rr, sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN rank <= 10 THEN rel ELSE 0 END) AS n_rel FROM rr GROUP BY 1),
i AS (SELECT k, sum(1 / log2(k + 1)) OVER (ORDER BY k) AS ideal FROM (SELECT unnest(range(1, 11)) AS k))
SELECT round(avg(hit1), 6) AS hit1, round(avg(hit3), 6) AS hit3, round(avg(hit5), 6) AS hit5, round(avg(precision1), 6) AS precision1, round(avg(precision3), 6) AS precision3, round(avg(precision5), 6) AS precision5, round(avg(rr), 6) AS mrr, round(avg(dcg / ideal), 6) AS ndcg10 FROM m JOIN i ON i.k = least(10, greatest(1, n_rel))"""


@query(COSINE + f", ranked AS (SELECT query_id, doc_id, {RANK} AS rank FROM cosine QUALIFY rank <= 10), l AS (SELECT doc_id AS id, source AS label FROM documents)" + METRICS)
def ag31_retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.metrics(L.top_k(cosine_index(spark, sf_dir), 10), docs(spark, sf_dir).select("doc_id", F.col("source").alias("label")))


@query(WEIGHTS + ", m AS (SELECT lang, term, round(sum(w) / any_value(n), 9) AS w FROM weights JOIN documents USING (doc_id) JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY 1) USING (lang) WHERE length(term) > 3 GROUP BY lang, term) SELECT lang, term, round(w, 6) AS w, row_number() OVER (PARTITION BY lang ORDER BY w DESC, term) AS rank FROM m QUALIFY rank <= 18")
def ag37_distinctive_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = docs(spark, sf_dir).select("doc_id", "lang")
    sizes = labels.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    sums = R.weights_by_label(R.weighted(docs(spark, sf_dir)), labels.withColumnRenamed("lang", "label"), 4).withColumnRenamed("label", "lang")
    means = sums.join(sizes, "lang").select("lang", "term", F.round(F.col("s") / F.col("n"), 9).alias("w"))
    own = Window.partitionBy("lang").orderBy(F.desc("w"), "term")
    return means.withColumn("rank", F.row_number().over(own).cast("long")).where("rank <= 18").withColumn("w", F.round("w", 6))


@query(WEIGHTS + " SELECT doc_id, term, rank FROM (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY round(w, 9) DESC, term) AS rank FROM weights WHERE length(term) > 2) WHERE rank <= 3")
def pl21_explanation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.best_terms(R.weighted(docs(spark, sf_dir)), 3, 3)


@query("WITH n AS (SELECT DISTINCT p_name AS a FROM part) SELECT x.a, y.a AS b, round(1 - levenshtein(x.a, y.a) / greatest(length(x.a), length(y.a)), 6) AS ratio FROM n x JOIN n y ON x.a < y.a WHERE 1 - levenshtein(x.a, y.a) / greatest(length(x.a), length(y.a)) >= 0.6")
def jn14_edit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of names at an edit ratio of 0.6 or more."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"))
    return R.edit_pairs(names, 0.6).withColumn("ratio", F.round("ratio", 6))


@query("SELECT page_id, regexp_matches(html, '(?i)password|secret|token') AS leak, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages")
def sc25_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.col("html").rlike("(?i)password|secret|token").alias("leak"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))

"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm import bpe, chat, decontaminate, language, media, negatives, ngram, quality, search, sharding, simhash, substring, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), keep_ids=False).drop("ids")


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(table(spark, sf_dir, "documents"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.when(F.col("error").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unread member: "), "error")).cast("boolean"))
    return media.round_trip(table(spark, sf_dir, "documents")).where(whole)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"), shards=24, slack=0.0)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.scores(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.when(F.col("kind") == "record", F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("gap in "), "path", F.lit(": "), "reason")).cast("boolean"))
    found = warc.round_trip(table(spark, sf_dir, "pages")).where(whole)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(~language.held_out()))
    return language.predict(docs, model, also=language.held_out().alias("held_out"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.turns(table(spark, sf_dir, "conversations"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance", "reference")


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_simhash, op2_bpe, op3_substring, op4_media, op5_sharding, op6_ngram, op7_decontaminate, op8_warc, op9_language, op10_chat, op11_quality, op12_search, op13_negatives)}

SQL: dict[str, str] = {}

SQL["op7_decontaminate"] = r"""
WITH words AS (
  SELECT 'd' AS kind, CAST(doc_id AS VARCHAR) AS id, doc_id AS doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
  UNION ALL
  SELECT 'b', CAST(item_id AS VARCHAR), NULL,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
  FROM benchmark WHERE item_id IS NOT NULL
), item_windows AS (
  SELECT DISTINCT id AS item, k, array_to_string(w[i + 1 : i + k], ' ') AS win
  FROM (SELECT id, w, least(10, len(w)) AS k, unnest(range(len(w) - least(10, len(w)) + 1)) AS i FROM words WHERE kind = 'b' AND len(w) > 0)
), lengths AS (SELECT DISTINCT k FROM item_windows),
doc_windows AS (
  SELECT doc_id, k, i, array_to_string(w[i + 1 : i + k], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(len(w) - k + 1)) AS i FROM words CROSS JOIN lengths WHERE kind = 'd' AND len(w) >= k)
), hits AS (SELECT d.doc_id, d.k, d.i, b.item FROM doc_windows d JOIN item_windows b ON d.k = b.k AND d.win = b.win),
hit_words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id) WHERE w.kind = 'd'
"""

SQL["op3_substring"] = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 35], ' ') AS win FROM (SELECT doc_id, w, unnest(range(len(w) - 34)) AS i FROM words WHERE len(w) >= 35)),
repeated AS (SELECT win FROM windows GROUP BY win HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 35)) AS j FROM windows SEMI JOIN repeated USING (win))),
tokens AS (SELECT doc_id, j, w[j + 1] AS word FROM (SELECT doc_id, w, unnest(range(len(w))) AS j FROM words)),
kept AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY j) AS kept FROM tokens t ANTI JOIN gone g ON t.doc_id = g.doc_id AND t.j = g.j GROUP BY t.doc_id),
counts AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words w LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

SQL["op8_warc"] = """
WITH payloads AS (SELECT page_id, sha256(coalesce(html, '')) AS digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
firsts AS (SELECT digest, min(page_id) AS first FROM payloads WHERE n >= 100 GROUP BY digest HAVING count(*) > 1)
SELECT page_id, n AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM payloads p LEFT JOIN firsts f ON p.digest = f.digest
"""

SQL["op12_search"] = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
total AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM docs WHERE len(w) > 0),
entries AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM docs) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM entries, total GROUP BY term, n_docs),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scores AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
           FROM asked JOIN entries USING (term) JOIN weights USING (term), total GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= 10
"""

SQL["op13_negatives"] = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_sum([a.q[i] * r.q[i] FOR i IN range(1, len(a.q) + 1)]) AS BIGINT) AS score
          FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score QUALIFY rank <= 5
"""

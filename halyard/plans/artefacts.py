"""Queries on files: workbooks, artefacts of runs, sinks and manifests, each written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.plans.registry import query
from halyard.session import shared_path
from halyard.sources import files as X
from halyard.sources import workbook as W
from halyard.sources.domain import table


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def src01_workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as workbooks, a file a task."""
    path = shared_path(spark, "books")
    W.write_workbooks(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), path)
    rows = W.read_workbook(spark, path, ("c_custkey", "c_name"))
    return rows.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"), "c_mktsegment")


@query("""WITH c AS (SELECT 'c_custkey' AS name, 'number' AS kind FROM customer UNION ALL SELECT 'c_name', 'inline' FROM customer
UNION ALL SELECT 'balance', CASE WHEN c_acctbal >= 0 THEN 'number' ELSE 'empty' END FROM customer UNION ALL SELECT 'building', 'boolean' FROM customer) SELECT name, kind, count(*) AS n FROM c GROUP BY ALL""")
def src02_cell_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the cells of each column are stored."""
    path = shared_path(spark, "books")
    balance = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance")
    W.write_workbooks(table(spark, sf_dir, "customer").select("c_custkey", "c_name", balance, (F.col("c_mktsegment") == "BUILDING").alias("building")), path)
    return W.cell_kinds(spark, path)


@query("SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region")
def src03_first_workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the workbooks of a folder, that whose name sorts first."""
    path = shared_path(spark, "books")
    W.write_workbooks(table(spark, sf_dir, "nation").select("n_nationkey", "n_name").coalesce(1), path, "late")
    W.write_workbooks(table(spark, sf_dir, "region").select("r_regionkey", "r_name").coalesce(1), path, "early")
    return W.read_workbook(spark, W.first_book(path)).select(F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name")


@query("SELECT CAST(n_nationkey AS BIGINT) AS run, n_name AS model FROM nation WHERE n_regionkey <> 2")
def src11_complete_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artefacts of runs, a file each: failed runs and files that are no JSON are left out."""
    path = shared_path(spark, "results")
    nation = table(spark, sf_dir, "nation")
    status = F.when(F.col("n_regionkey") == 2, "failed").otherwise("complete").alias("status")
    nation.select(F.col("n_nationkey").cast("long").alias("run"), F.col("n_name").alias("model"), status).write.option("maxRecordsPerFile", 1).json(f"{path}/whole")
    nation.select(F.concat(F.lit("{oops "), "n_name").alias("value")).write.option("maxRecordsPerFile", 1).text(f"{path}/broken")
    return X.read_results(spark, f"{path}/*", "run long, model string, status string").drop("status")


@query("SELECT CAST(n_nationkey AS BIGINT) AS run, n_name AS model, [CAST(n_regionkey AS BIGINT)] AS parts FROM nation")
def snk02_json_artefact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records as JSON; files appear only when the job commits."""
    path = shared_path(spark, "artefact")
    X.write_lines(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("run"), F.col("n_name").alias("model"), F.array(F.col("n_regionkey").cast("long")).alias("parts")), path)
    return spark.read.schema("run long, model string, parts array<long>").json(path)


@query("SELECT event_id, event_type, props, CAST(NULL AS VARCHAR) AS verdict FROM events")
def snk03_review_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV sheet for reviewers, with quotes and commas in its cells and an empty column for the verdict."""
    path = shared_path(spark, "review")
    X.write_csv(table(spark, sf_dir, "events").select("event_id", "event_type", "props", F.lit(None).cast("string").alias("verdict")), path)
    return spark.read.schema("event_id long, event_type string, props string, verdict string").csv(path, header=True)


@query("SELECT doc_id, text, lang FROM documents")
def snk04_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as JSON lines."""
    path = shared_path(spark, "lines")
    X.write_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path)
    return spark.read.schema("doc_id long, text string, lang string").json(path)


@query("SELECT CAST(n_nationkey AS BIGINT) AS run, CASE WHEN n_regionkey = 0 THEN 'missing' WHEN n_regionkey = 1 THEN 'changed' WHEN n_regionkey = 2 THEN 'new' ELSE 'same' END AS state FROM nation")
def snk07_verified_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files against the hashes that a manifest gives them."""
    path = shared_path(spark, "payload")
    nation = table(spark, sf_dir, "nation")
    text = F.concat("n_name", F.when(F.col("n_regionkey") == 1, "!").otherwise(""))
    nation.where("n_regionkey <> 0").select(F.col("n_nationkey").alias("run"), text.alias("value")).write.partitionBy("run").text(path)
    found = X.hash_manifest(spark, path).select(F.regexp_extract("path", "run=([0-9]+)", 1).cast("long").alias("run"), "sha256")
    expected = nation.where("n_regionkey <> 2").select(F.col("n_nationkey").cast("long").alias("run"), F.sha2(F.concat("n_name", F.lit("\n")).cast("binary"), 256).alias("sha256"))
    return X.verified(found, expected, "run")


@query("SELECT CAST(octet_length(encode(n_name)) + 1 AS BIGINT) AS length, sha256(n_name || chr(10)) AS sha256 FROM nation")
def ex20_file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and hash of each file of a package."""
    path = shared_path(spark, "package")
    table(spark, sf_dir, "nation").select("n_name").write.option("maxRecordsPerFile", 1).text(path)
    return X.hash_manifest(spark, path).where("length > 0").select("length", "sha256")


@query("SELECT s_suppkey AS request_id, s_name AS description, s_acctbal AS amount, 'none' AS service FROM supplier")
def prj2_configured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logical columns by a configuration, with a default for one that is absent."""
    return X.by_config(table(spark, sf_dir, "supplier"), {"request_id": "s_suppkey", "description": "s_name", "amount": "s_acctbal", "service": "s_service"}, {"service": "none"})


@query("SELECT s_suppkey AS request_id, s_name AS description, CAST(NULL AS VARCHAR) AS service FROM supplier")
def prj3_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns by alias, whatever the case, the spaces and the two forms of one letter."""
    headed = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias(" Supplier  KEY "), F.col("s_name").alias("Ещё ИМЯ"), F.col("s_name").alias("third"))
    return X.by_alias(headed, {"request_id": ("number", "supplier key"), "description": ("еще имя", "third"), "service": ("svc",)})


PACKAGE = """WITH f AS (SELECT 'source=' || source || '/shard=' || (doc_id // 1000) AS relative, source <> 'src7' AS included, string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) || chr(10) AS body FROM documents GROUP BY source, doc_id // 1000),
h AS (SELECT relative, included, CAST(octet_length(encode(body)) AS BIGINT) AS length, sha256(body) AS sha256 FROM f),
g AS (SELECT substr(sha256(relative), 1, 2) AS g, count(*) AS n, sum(length) AS b, sha256(string_agg(sha256 || '  ' || relative, chr(10) ORDER BY sha256 || '  ' || relative)) AS h FROM h WHERE included GROUP BY 1)"""


def package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package of the documents' texts in folders of source and shard, one file each, as an inventory."""
    path = shared_path(spark, "package")
    texts = table(spark, sf_dir, "documents").select("source", F.floor(F.col("doc_id") / 1000).alias("shard"), F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text")).alias("d"))
    bodies = texts.groupBy("source", "shard").agg(F.array_join(F.transform(F.sort_array(F.collect_list("d")), lambda d: d["text"]), "\n").alias("value"))
    bodies.write.partitionBy("source", "shard").text(path)
    files = X.inventory(X.hash_manifest(spark, path), path, parts=("source=src7",), prefixes=(".", "_"), suffixes=(".crc",))
    return files.where("length > 0 AND relative LIKE 'source=%'").withColumn("relative", F.regexp_extract("relative", "^(.*)/[^/]*$", 1))


@query(PACKAGE + " SELECT relative, included, length, sha256 FROM h")
def ex20_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, length, hash and inclusion of each file of a package."""
    return package(spark, sf_dir).select("relative", "included", "length", "sha256")


@query(PACKAGE + " SELECT CAST(sum(n) AS BIGINT) AS files, CAST(sum(b) AS BIGINT) AS bytes, sha256(string_agg(h || '  ' || g, chr(10) ORDER BY h || '  ' || g)) AS sha256 FROM g")
def ex20_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hash of all included files."""
    return X.snapshot(package(spark, sf_dir).where("included"))

"""Sealed protocols, model bundles with versions, and run states: small files on the shared file system with atomic steps."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.session import stored

#: A SHA-256 is added up as eight numbers of 32 bits, so any order of rows, and any split over tasks, gives the same sums.
PARTS = 8


class SealBroken(RuntimeError):
    """What is there differs from what was sealed."""


def row_hash(*columns: str) -> Column:
    """SHA-256 of a row as JSON, nulls as null."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary"), 256)


def digest(hashes: str = "h") -> Column:
    """An aggregate: the 256-bit digest of a multiset of hashes. A change of any row changes it; no group is held together."""
    sums = [F.sum(F.conv(F.substring(hashes, 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")) for i in range(PARTS)]
    return F.sha2(F.concat_ws(",", F.count(hashes).cast("string"), *(s.cast("string") for s in sums)).cast("binary"), 256)


def place(spark: SparkSession, uri: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, uri: str) -> str | None:
    """A small file's text, null if there is none."""
    path, fs = place(spark, uri)
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def create_text(spark: SparkSession, uri: str, text: str) -> bool:
    """Put a whole file under its name only if nothing is there: written aside, then renamed without overwriting."""
    jvm = spark.sparkContext._jvm
    path, _ = place(spark, uri)
    aside = write_aside(spark, uri, text)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(aside, path, options)
        return True
    except Exception as error:
        if "FileAlreadyExists" not in str(error):
            raise
        context.delete(aside, False)
        return False


def write_aside(spark: SparkSession, uri: str, text: str):
    path, fs = place(spark, f"{uri}.{uuid.uuid4().hex}")
    stream = fs.create(path, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    return path


def swap_text(spark: SparkSession, uri: str, text: str) -> None:
    """Replace a small file in one step: readers see the old text or the new one."""
    jvm = spark.sparkContext._jvm
    path, _ = place(spark, uri)
    aside = write_aside(spark, uri, text)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(aside, path, options)


def seal(spark: SparkSession, uri: str, payload: dict) -> str:
    """``created``, or ``verified`` if an equal seal is there already; a different one raises ``SealBroken`` and stays."""
    text = json.dumps(payload, sort_keys=True, ensure_ascii=False)
    if create_text(spark, uri, text):
        return "created"
    if read_text(spark, uri) != text:
        raise SealBroken(f"a different seal is at {uri}")
    return "verified"


def folder_hash(spark: SparkSession, uri: str) -> str:
    """The digest of all files below a folder, by their paths in it and contents."""
    root, fs = place(spark, uri)
    base = fs.makeQualified(root).toUri().getPath().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(uri)
    name = F.expr(f"substring(path, instr(path, '{base}') + {len(base)})")
    hashed = files.select(F.sha2(F.concat(name, F.lit("\n"), F.sha2("content", 256)).cast("binary"), 256).alias("h"))
    return hashed.agg(digest().alias("d")).first().d


def save_bundle(spark: SparkSession, root: str, write: Callable[[str], None], metadata: dict) -> str:
    """Write a new version below ``root`` by ``write(folder)``, with its metadata and hash beside it, and point to it; the version's name.

    The version that was current stays, as the previous one.
    """
    name = f"v-{uuid.uuid4().hex}"
    write(f"{root}/{name}/model")
    side = metadata | {"model_sha256": folder_hash(spark, f"{root}/{name}/model")}
    create_text(spark, f"{root}/{name}/metadata.json", json.dumps(side, sort_keys=True))
    current = pointer(spark, root).get("current")
    swap_text(spark, f"{root}/CURRENT", json.dumps({"current": name, "previous": current}))
    return name


def pointer(spark: SparkSession, root: str) -> dict:
    return json.loads(read_text(spark, f"{root}/CURRENT") or "{}")


def bundle(spark: SparkSession, root: str) -> tuple[str, dict]:
    """The folder of the current version and its metadata; a damaged version raises ``SealBroken``."""
    name = pointer(spark, root)["current"]
    metadata = json.loads(read_text(spark, f"{root}/{name}/metadata.json") or "{}")
    if metadata.get("model_sha256") != folder_hash(spark, f"{root}/{name}/model"):
        raise SealBroken(f"version {name} below {root} differs from its hash")
    return f"{root}/{name}/model", metadata


def roll_back(spark: SparkSession, root: str) -> str:
    """Point to the previous version again; its name."""
    at = pointer(spark, root)
    if not at.get("previous"):
        raise LookupError("there is no previous version")
    swap_text(spark, f"{root}/CURRENT", json.dumps({"current": at["previous"], "previous": at["current"]}))
    return at["previous"]


class Runs:
    """The results of candidate runs below a folder: what is there is not run again."""

    SCHEMA = "stage string, run_id string, candidate string, metric double"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def table(self) -> DataFrame:
        """``stage, run_id, candidate, metric``; a run that two drivers have appended counts once."""
        _, fs = place(self.spark, self.root)
        if not fs.exists(place(self.spark, self.root)[0]):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.root).dropDuplicates(["stage", "run_id"])

    def stage(self, name: str, candidates: DataFrame, evaluate: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Run the candidates that have no result yet, append theirs, and return the stage's results.

        ``candidates`` are rows of parameters; their ``run_id`` is a hash of stage and parameters. ``evaluate`` gets
        ``run_id`` and the parameters and returns ``run_id, metric``.
        """
        columns = candidates.columns
        packed = F.to_json(F.struct(*columns))
        named = candidates.withColumn("candidate", packed).withColumn("run_id", F.substring(F.sha2(F.concat(F.lit(f"{name}|"), "candidate").cast("binary"), 256), 1, 16))
        known = self.table().where(F.col("stage") == name).select("run_id")
        open_ = stored(named.dropDuplicates(["run_id"]).join(known, "run_id", "left_anti"), "open")
        if not open_.isEmpty():
            found = evaluate(open_.select("run_id", *columns)).select("run_id", "metric").join(open_.select("run_id", "candidate"), "run_id")
            found.select(F.lit(name).alias("stage"), "run_id", "candidate", F.col("metric").cast("double").alias("metric")).write.mode("append").parquet(self.root)
        return self.table().where(F.col("stage") == name).join(named.select("run_id").distinct(), "run_id", "left_semi")

    def best(self, name: str, k: int = 1) -> DataFrame:
        """The k best results of a stage, ties by ``run_id``: what the next stage starts from."""
        return self.table().where(F.col("stage") == name).orderBy(F.desc("metric"), "run_id").limit(k)

"""Session construction and the shared folder in which lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "halyard", cpus: str | None = None, partitions: int = 8) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cpus or os.environ.get('BENCH_CPUS', '8')}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that setting is absent (tests, a laptop) is a folder of this machine used.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    global _LOCAL
    if _LOCAL is None:
        _LOCAL = tempfile.mkdtemp(prefix="halyard-")
    return f"file://{_LOCAL}"


_LOCAL: str | None = None


def shared_path(spark: SparkSession, kind: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, so that later plans start from stored rows."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, kind: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    path = shared_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared folder that no later plan reads."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


class Rounds:
    """Tables of an iteration as Parquet: sizes are those of the files, and old rounds are deleted.

    A checkpoint would carry the estimated size of its plan, which joins of joins multiply in each round.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.old, self.new = spark, [], []

    def keep(self, df: DataFrame) -> DataFrame:
        path = shared_path(self.spark, "round")
        df.write.parquet(path)
        self.new.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def turn(self) -> None:
        """Delete what was written before the last turn."""
        for path in self.old:
            discard(self.spark, path)
        self.old, self.new = self.new, []

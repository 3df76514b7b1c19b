"""Running sums in cells against a plain window."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from halyard.operators import prefix


def plain(df, order, keys, descending):
    own = Window.partitionBy(*keys).orderBy(F.desc(order) if descending else F.asc(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({"n_upto": F.sum("n").over(own), "n_all": F.sum("n").over(Window.partitionBy(*keys))})


def rows_of(df):
    return sorted(map(str, df.select("g", "v", "n", "n_upto", "n_all").collect()))


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("keys", [(), ("g",)])
@pytest.mark.parametrize("kind", ["double", "date", "equal"])
def test_running_sums_equal_a_window(spark, kind, keys, descending):
    rng = random.Random(len(keys) + 2 * descending)
    odd = [None, float("nan"), float("inf"), float("-inf"), -1e308, 1e308, 0.0]
    values = {
        "double": odd + [rng.gauss(0, 10.0 ** rng.randint(-3, 6)) for _ in range(300)],
        "date": [None] + [dt.date(2020, 1, 1) + dt.timedelta(days=3 * i) for i in range(300)],
        "equal": [2500.0],
    }[kind]
    groups = ["a", None, "b"] if keys else ["a"]
    data = [(g, v, rng.randint(0, 9)) for v in values for g in groups if rng.random() < 0.9]
    df = spark.createDataFrame(data or [("a", values[0], 1)], f"g string, v {'date' if kind == 'date' else 'double'}, n long")
    for cells in (7, 1024):
        assert rows_of(prefix.running(df, "v", ["n"], keys, descending, cells)) == rows_of(plain(df, "v", keys, descending))
    assert prefix.running(df.limit(0), "v", ["n"], keys, descending).count() == 0


def test_no_task_holds_all_values(spark):
    df = spark.range(5000).select((F.col("id") / 5000).alias("v"), F.lit(1).cast("long").alias("n"))
    widest = prefix.running(df, "v", ["n"], cells=16).withColumn("cell", F.floor(F.col("v") * 16)).groupBy("cell").count()
    assert widest.agg(F.max("count")).first()[0] < 400
    plan = prefix.running(df, "v", ["n"])._jdf.queryExecution().optimizedPlan().toString()
    orders = [line for line in plan.splitlines() if "Window" in line and "windowspecdefinition(v" in line]
    assert not orders

from halyard.sources.domain import table
from halyard.streaming import events as E

SF = "/root/testdata/sf0.001"


def source(spark, tmp_path):
    rows = table(spark, SF, "events")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    return rows, E.stream(spark, f"{tmp_path}/in", rows.schema)


def test_windows_equal_the_batch(spark, tmp_path):
    rows, s = source(spark, tmp_path)
    spark.conf.set("spark.sql.streaming.checkpointLocation", f"{tmp_path}/state")
    got = {tuple(r) for r in E.drained(spark, E.windowed(s), "tumbling").collect()}
    assert got == {tuple(r) for r in E.windowed(rows).collect()}


def test_transitions_equal_the_batch(spark, tmp_path):
    from halyard.operators import process as P
    from halyard.sources.domain import status_events

    rows = table(spark, SF, "events")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.checkpointLocation", f"{tmp_path}/state")
    s = E.stream(spark, f"{tmp_path}/in", rows.schema)
    n = E.drained(spark, E.transitions(s), "moves", "append").count()
    assert n == P.steps(status_events(spark, SF)).where("next_status is not null").count()


def test_audits_equal_the_batch_fold(spark, tmp_path):
    from pyspark.sql import functions as F

    from halyard.operators import records as R

    kinds = {"view": "analysis", "error": "error", "click": "category_confirmed", "purchase": "route_confirmed", "signup": "saved"}
    rows = table(spark, SF, "events").replace(kinds, subset=["event_type"]).withColumnRenamed("event_type", "kind").select("user_id", "event_id", "ts", "kind")
    folded = {r.user_id: (r.state, r.n_applied) for r in R.folded(rows, "user_id", "kind", "ts", "event_id").collect()}
    spark.conf.set("spark.sql.streaming.checkpointLocation", f"{tmp_path}/state")
    rows.orderBy("ts", "event_id").coalesce(1).write.parquet(f"{tmp_path}/in")
    audits = E.drained(spark, E.audited(E.stream(spark, f"{tmp_path}/in", rows.schema)), "audits", "append").join(rows.select("event_id", "ts"), "event_id")
    last = audits.groupBy("user_id").agg(F.max_by("after", F.struct("ts", "event_id")).alias("state"), F.count_if("applied").alias("n"))
    assert audits.count() == rows.count()
    assert {r.user_id: (r.state, r.n) for r in last.collect()} == folded

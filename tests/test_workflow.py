"""Records, routing, gates and bootstraps on small frames."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.operators import analytics as A
from halyard.operators import decision as D
from halyard.sources import files as X
from halyard.sources import workbook as W


def test_full_record(spark):
    rows = [("12.0", "45000.5", " ", "Ann", " A  b\nC ", "TRUE", "1:00:05", "3.0", "0:00:00", "0:00:01", None), ("A-1", "2024-02-03 04:05:06", None, " ", None, "no", "soon", None, None, None, "x")]
    raw = spark.createDataFrame(rows, "Number string, Day string, User string, Person string, Text string, Late string, Took string, Asked string, `L1 r` string, `L1 w` string, Extra string")
    names = {"request_id": "Number", "registration_date": "Day", "description": "Text", "overdue": "Late", "actual_duration": "Took", "clarifications_count": "Asked", "line1_reaction": "L1 r", "line1_work": "L1 w", "service": "absent"}
    one, two = X.full_record(raw, names, "h", "now", ("User", "Person", "Nobody")).orderBy("request_id").collect()
    assert len(one.asDict()) == 29
    assert (one.request_id, str(one.registration_date), one.user_name, one.description, one.normalized_description, one.overdue, one.actual_duration_seconds, one.clarifications_count) == ("12", "2023-03-15 12:00:00", "Ann", " A  b\nC ", "a b c", 1, 3605, 3)
    assert (one.line1_participated, one.line2_participated, one.participants_count, one.service, one.component) == (1, 0, 1, "", None)
    assert (two.user_name, two.description, two.normalized_description, two.overdue, two.actual_duration_seconds, two.clarifications_count, two.clarification_seconds, two.participants_count) == (None, "", "", 0, None, 0, None, 0)
    assert json.loads(two.raw_json)["Extra"] == "x" and json.loads(two.raw_json)["User"] is None and list(json.loads(two.raw_json)) == sorted(raw.columns)


def test_ids_are_unique(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "request_id string")
    assert X.unique_ids(rows).count() == 2
    for bad in (rows.unionByName(rows.where("request_id = 'a'")), rows.unionByName(spark.createDataFrame([(" ",)], "request_id string"))):
        with pytest.raises(ValueError, match="not unique"):
            X.unique_ids(bad)


def test_event_log_from_a_workbook(spark, tmp_path):
    folder = f"{tmp_path}/log.xlsx"
    rows = spark.createDataFrame([(1.0, "open", "2024-01-01 10:00:00"), (2.0, " ", "2024-01-01 10:00:00"), (3.0, "done", "never")], "request_id double, status string, entered_at string")
    W.write_workbooks(rows, f"file://{folder}")
    got = X.read_event_log(spark, f"file://{folder}").collect()
    assert [(r.request_id, r.status, str(r.entered_at), r.left_at, r.source) for r in got] == [("1", "open", "2024-01-01 10:00:00", None, None)]
    W.write_workbooks(rows.drop("status"), f"file://{tmp_path}/bad.xlsx")
    with pytest.raises(ValueError, match="missing columns: status"):
        X.read_event_log(spark, f"file://{tmp_path}/bad.xlsx")


def test_routing_by_evidence_and_by_confirmed_category(spark):
    history = [(f"A{i}", "A", "2" if i < 18 else "1") for i in range(20)] + [(f"B{i}", "B", "1" if i < 18 else "2") for i in range(20)] + [("C", "C", "3")]
    tickets = spark.createDataFrame([(*r, "historical") for r in history], "request_id string, category string, final_line string, source_hash string")
    prior = A.route_prior(tickets)
    model = spark.createDataFrame([(i, line, p) for i in "xyz" for line, p in (("1", 0.45), ("2", 0.40), ("3", 0.15))], "request_id string, final_line string, p double")
    likely = spark.createDataFrame([("x", "category_topk", "A", 0.8), ("x", "category_topk", "B", 0.2), ("y", "confirmed_category", "B", 1.0), ("z", "category_topk", "C", 1.0)], "request_id string, mode string, category string, weight double")
    got = A.routed_by_evidence(model, likely, prior).orderBy("request_id", "rank").collect()
    best = {r.request_id: (r.mode, r.final_line, r.p) for r in got if r["rank"] == 1}
    a, b = np.array([3, 19, 1]) / 23, np.array([19, 3, 1]) / 23
    x, y = (0.45 * np.array([0.45, 0.40, 0.15]) + 0.55 * q for q in (0.8 * a + 0.2 * b, b))
    assert best == {"x": ("category_topk", "2", round(x[1], 4)), "y": ("confirmed_category", "1", round(y[0], 4)), "z": ("category_topk", "1", 0.45)}
    assert len(got) == 9


def test_evidence_of_a_ticket(spark):
    rows = spark.createDataFrame([(1, "s", "p", "A", "import"), (2, "s", "p", "A", "import"), (3, "s", "q", "B", "import"), (4, "t", "q", "C", "operator-review")], "request_id long, service string, priority string, category string, source_hash string")
    got = A.category_evidence(rows, ["service", "priority"], 2).collect()
    of = lambda i: sorted((r.mode, r.category, round(r.weight, 6)) for r in got if r.request_id == i)
    w = {"A": 3 * 3 / 2, "B": 2 * 1 / 1, "C": 1 * 1 / 1}
    assert of(1) == [("category_topk", "A", round(w["A"] / sum(w.values()), 6)), ("category_topk", "B", round(w["B"] / sum(w.values()), 6))]
    assert of(4) == [("confirmed_category", "C", 1.0)]


def test_clustered_bootstrap(spark):
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(0, 12)), *rng.choice(list("xyz"), 3, p=[0.6, 0.3, 0.1])) for _ in range(200)]
    got = {r.metric: r for r in D.clustered_bootstrap(spark.createDataFrame([tuple(map(str, r)) for r in rows], "cluster string, truth string, predicted string, other string"), 20, 5).collect()}
    accuracy, f1 = [], []
    for replicate in range(1, 21):
        w = {}
        for c in range(12):
            u = int(hashlib.sha256(f"5|{c}|{replicate}".encode()).hexdigest()[:8], 16) / 2**32
            w[c] = next((k for k, cut in enumerate(D.POISSON_CUTS) if u < cut), len(D.POISSON_CUTS))
        total = sum(w[c] for c, *_ in rows)
        scores = []
        for guess in (2, 3):
            parts = []
            for label in "xyz":
                tp = sum(w[r[0]] for r in rows if r[1] == label == r[guess])
                both = sum(w[r[0]] for r in rows if r[1] == label) + sum(w[r[0]] for r in rows if r[guess] == label)
                parts += [2 * tp / both] if both else []
            scores.append(np.mean(parts))
        f1.append(scores[1] - scores[0])
        accuracy.append(sum(w[r[0]] * ((r[3] == r[1]) - (r[2] == r[1])) for r in rows) / total)
    for name, values in (("accuracy", accuracy), ("macro_f1", f1)):
        want = [np.mean(values), *np.quantile(values, [0.025, 0.975]), np.mean(np.array(values) > 0)]
        assert np.allclose([got[name]["mean"], got[name].low, got[name].high, got[name].better], want, atol=2e-6)


def test_gate_and_front(spark):
    log = spark.createDataFrame([("a", 1, "completed"), ("a", 2, "skipped"), ("b", 1, "completed"), ("b", 1, "skipped"), ("c", 1, "completed"), ("c", 2, "failed"), ("d", 1, "completed"), ("d", 2, None)], "run string, candidate long, state string")
    assert {r.run: r.complete for r in A.run_gate(log, "run", "candidate").collect()} == {"a": True, "b": False, "c": False, "d": False}
    runs = spark.createDataFrame([(1, 0.5, 0.5, 0.5), (2, 0.6, 0.5, 0.5), (3, 0.6, 0.4, 0.9), (4, 0.5, 0.5, 0.5)], "id long, a double, b double, c double")
    got = {r.id: (r.better, r.front) for r in D.front(runs, ["a", "b", "c"], F.col("id") == 1).collect()}
    assert got == {1: (False, False), 2: (True, True), 3: (False, True), 4: (False, False)}


def test_evidence_does_not_deal_rows_by_facets(spark):
    rows = spark.range(0, 2000, 1, 4).selectExpr("id AS request_id", "concat('s', id % 5) AS service", "concat('p', id % 3) AS priority", "concat('c', id % 7) AS category", "concat('l', id % 2) AS final_line", "'import' AS source_hash")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        likely = A.category_evidence(rows, ["service", "priority"], 2)
        plan = likely.join(A.route_prior(rows), "category")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning(service" not in plan and "hashpartitioning(category" not in plan

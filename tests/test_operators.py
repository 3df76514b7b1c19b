"""Operators on small frames with literal expected values."""

from datetime import date, datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from halyard.functions import scalars as S
from halyard.operators import analytics as A
from halyard.operators import decision as D
from halyard.operators import process as P
from halyard.operators import records as R
from halyard.operators import retrieval as T
from halyard.operators import splits as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "seconds"), [("00:00:00", 0), ("24:00:00", 86400), ("217:23:03", 782583), (None, None), ("soon", None), ("0.25", 21600), ("12000", 12000)])
def test_durations(spark, text, seconds):
    assert one(spark, S.duration_seconds(F.lit(text))) == seconds


def test_scalars(spark):
    assert one(spark, S.normalised(F.lit("  A \t b\nC "))) == "a b c"
    assert one(spark, S.group_key(F.lit(" "), F.lit(7))) == "request:7"
    assert one(spark, S.human_duration(F.lit(782583))) == "217:23:03"
    assert one(spark, S.request_id(F.lit("12.0"))) == "12" and one(spark, S.request_id(F.lit(" A-1 "))) == "A-1"
    assert one(spark, S.excel_or_iso(F.lit("2024-02-03 04:05:06"))) == datetime(2024, 2, 3, 4, 5, 6)
    assert one(spark, S.excel_or_iso(F.lit("45000.5"))) == datetime(2023, 3, 15, 12)
    assert one(spark, S.first_filled(F.lit(" "), F.lit(None), F.lit("x"))) == "x"
    assert one(spark, S.word_ngrams(F.array(*map(F.lit, "abcd")), 3)) == ["a b c", "b c d"]
    assert one(spark, S.word_ngrams(F.array(F.lit("a")), 2)) == []
    assert one(spark, S.char_ngrams(F.array(F.lit("ab"), F.lit("x")), 3)) == [" ab", "ab ", " x "]
    assert one(spark, S.overdue(F.lit(" OVERDUE "))) and not one(spark, S.overdue(F.lit(None)))
    assert abs(one(spark, S.norm(F.array(F.lit(3.0), F.lit(4.0)))) - 5) < 1e-12
    assert 0 <= one(spark, S.uniform(F.lit("a"), seed=3)) < 1


def ticket_frame(spark, rows):
    return spark.createDataFrame([Row(request_id=i, registration_date=d, service="s", category=c, priority="p", final_line="F", overdue=o, duration_seconds=x, clarifications=k, line1=1, line2=m, line3=0, line4=0) for i, (d, c, o, x, k, m) in enumerate(rows)])


def test_date_bounds_include_the_whole_last_day(spark):
    days = [datetime(2024, 1, 9, 23, 59, 59), datetime(2024, 1, 10), datetime(2024, 1, 10, 12), datetime(2024, 1, 10, 23, 59, 59), datetime(2024, 1, 11)]
    rows = ticket_frame(spark, [(d, "c", False, 1, 1, 0) for d in days])
    assert A.filtered(rows, date(2024, 1, 10), date(2024, 1, 10)).count() == 3


def test_smoothing_threshold_and_percentiles(spark):
    d = datetime(2024, 1, 1)
    rows = ticket_frame(spark, [(d, "tiny", True, None, 1, 0)] + [(d, "big", i < 5, x, 8, 1) for i, x in enumerate([1, 2, 3, 10] * 25)])
    got = {r["value"]: r for r in A.breakdown(rows, "category", A.global_rate(rows)).collect()}
    assert got["tiny"]["smoothed_risk"] < 0.2 and got["tiny"]["p50"] == 0
    assert (got["big"]["p50"], got["big"]["p90"]) == (2, 10)
    assert A.threshold(rows).first()["threshold"] == 8 and A.threshold(rows.limit(0)).first()["threshold"] == 3
    risk = {r["request_id"]: r for r in A.segment_risk(rows, [["category"]], 30).collect()}
    assert risk[0]["level"] == "global" and risk[0]["support"] == 101 and risk[1]["level"] == "category"
    both = A.breakdowns(rows, A.global_rate(rows))
    assert both.where("dimension = 'category'").count() == 2 and both.where("dimension = 'total'").first()["n"] == 101


def test_transitions_and_dwell(spark):
    t = lambda h: datetime(2024, 1, 1, h)
    log = spark.createDataFrame([(1, "A", t(10), 1), (1, "B", t(11), 2), (1, "C", t(13), 3)], "request_id long, status string, entered_at timestamp, event_id long")
    assert {(r[0], r[1]): (r["n"], r["share"]) for r in P.transitions(log).collect()} == {("A", "B"): (1, 0.5), ("B", "C"): (1, 0.5)}
    assert {r["status"]: r["median_seconds"] for r in P.dwell(log).collect()} == {"A": 3600, "B": 7200}
    assert P.transitions(log.limit(0)).count() == 0


def test_nearest_rank_rounds_halves_to_even(spark):
    counts = spark.createDataFrame([("k", v, 1) for v in (1, 2, 3, 10)], "key string, v long, n long")
    assert P.nearest_rank("v", 0.9, counts, ["key"]).first()["value"] == 10
    assert P.nearest_rank("v", 0.5, counts, ["key"]).first()["value"] == 3


def test_merge_modes(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k long, v string")
    new = spark.createDataFrame([(1, "b"), (2, None), (4, "d")], "k long, v string")
    change = lambda m: {r["k"]: r["change"] for r in R.merged(old, new, "k", m).collect()}
    assert change("upsert") == {1: "updated", 2: "unchanged", 3: "kept", 4: "inserted"}
    assert change("replace")[3] == "deleted"
    with pytest.raises(ValueError):
        R.merged(old, new, "k", "other")
    assert R.revisions(old, new, "k", ["v"]).collect()[0]["changed_fields"] == ["v"]
    assert R.appended(old, new.unionAll(new), ["k"]).count() == 1


def test_staged_states(spark):
    log = spark.createDataFrame([(1, i, k) for i, k in enumerate(["saved", "analysis", "route_confirmed", "category_confirmed", "route_confirmed", "saved", "analysis"])] + [(2, 0, "error")], "id long, at long, kind string")
    got = {r["id"]: (r["state"], r["n_applied"]) for r in R.folded(log, "id", "kind", "at").collect()}
    assert got == {1: ("saved", 4), 2: ("failed", 1)}


def test_fusion_minmax_and_metrics(spark):
    rank = lambda ids: spark.createDataFrame([(0, d, i + 1) for i, d in enumerate(ids)], "query_id long, doc_id long, rank long")
    fused = T.best(T.fused(rank([3, 1, 2]), rank([1, 2, 4]), k=10), 9)
    assert [r["doc_id"] for r in fused.orderBy("rank").collect()] == [1, 2, 3, 4]
    s = spark.createDataFrame([(0, 1, 4.0), (0, 2, 2.0), (0, 3, 0.0), (1, 1, 5.0), (1, 2, 5.0)], "query_id long, doc_id long, score double")
    assert [r["score"] for r in T.minmax(s).orderBy("query_id", "doc_id").collect()] == [1, 0.5, 0, 0, 0]
    groups = spark.createDataFrame([(0, "g"), (1, "g"), (2, "h"), (3, "k")], "doc_id long, group string")
    near = spark.createDataFrame([(0, 1, 0.99), (0, 2, 0.8), (0, 3, 0.7)], "query_id long, doc_id long, score double")
    assert [r["doc_id"] for r in T.distinct_groups(near, groups, 3).orderBy("rank").collect()] == [2, 3]


def long_form(spark, rows):
    return spark.createDataFrame([(i, label, p, truth) for i, (probs, truth) in enumerate(rows) for label, p in probs.items()], "row_id long, label string, p double, truth string")


def test_decisions(spark):
    p = long_form(spark, [({"A": 0.9, "B": 0.1}, "A"), ({"A": 0.8, "B": 0.2}, "A"), ({"A": 0.3, "B": 0.7}, "A"), ({"A": 0.4, "B": 0.6}, "B")])
    d = D.decided(p)
    got = {r["coverage"]: (r["accepted"], r["errors"], r["accuracy"]) for r in D.risk_coverage(d, [0.5, 1.0]).collect()}
    assert got == {0.5: (2, 0, 1.0), 1.0: (4, 1, 0.75)}
    assert {r["predicted"]: r["threshold"] for r in D.class_thresholds(d, 0.9, 2).collect()} == {"A": 0.8}
    assert {r["label"]: r["f1"] for r in D.report(d).collect()}["B"] == pytest.approx(2 / 3)
    blend = D.blended([(p, 3.0), (p, 1.0)])
    assert blend.where("row_id = 0 and label = 'A'").first()["p"] == pytest.approx(0.9)
    a = spark.createDataFrame([("A",)] * 8 + [("B",)] * 2, "l string")
    b = spark.createDataFrame([("A",)] * 2 + [("B",)] * 8, "l string")
    assert D.divergence(a, b, "l").first()["js"] > 0.1 and D.divergence(a, a, "l").first()["js"] == 0


@pytest.mark.parametrize(("n", "band"), [(3, "1-5"), (6, "6-20"), (25, "21-50"), (55, ">50")])
def test_bands(spark, n, band):
    assert one(spark, D.support_band(F.lit(n))) == band


def test_grouped_split_is_disjoint_and_stable(spark):
    rows = spark.createDataFrame([(f"{label}{g}", label, False) for label, k in {"a": 12, "b": 9, "c": 2}.items() for g in range(k) for _ in range(2)] + [("s1", "a", True)], "g string, label string, synthetic boolean")
    first, again = (X.grouped(r, "g", "label", synthetic="synthetic").orderBy("g").collect() for r in (rows, rows.repartition(3)))
    assert first == again and len(first) == 23
    assert X.overlap(X.grouped(rows, "g", "label"), "g").count() == 0
    assert {r["partition"] for r in first if r["label"] == "c"} == {"development"}
    assert {r["fold0"] for r in first if r["label"] == "a" and r["partition"] == "development"} == {0, 1, 2, 3}


def test_added_column_has_every_ticket(spark):
    import __spark_entry__ as entry
    from halyard.sources.domain import tickets

    rows = entry.queries()["dml10_added_column_all"](spark, "/root/testdata/sf0.001")
    assert rows.count() == tickets(spark, "/root/testdata/sf0.001").count() and {r["added"] for r in rows.select("added").distinct().collect()} == {"none", "new"}


def test_queue_has_every_event_in_order(spark):
    import __spark_entry__ as entry

    got = [(r["rank"], r["event_id"]) for r in entry.queries()["st3_queue_all"](spark, "/root/testdata/sf0.001").collect()]
    assert got == sorted(got) and {r for r, _ in got} == {0, 1, 2} and len(got) == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_edit_pairs_are_all_pairs(spark):
    import random

    from halyard.operators import retrieval as R

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(4)
    names = {"".join(rng.choice("abé") for _ in range(rng.randint(0, 12))) for _ in range(150)}
    df = spark.createDataFrame([(n,) for n in [*names, "ab", "ab"]] + [(None,)], "name string")
    for least in (0.6, 0.8, 1.0):
        want = {(a, b) for a in names for b in names if a < b and a and 1 - distance(a, b) / max(len(a), len(b)) >= least}
        assert {(r["a"], r["b"]) for r in R.edit_pairs(df, least).collect()} == want
    assert R.edit_pairs(df.limit(0)).count() == 0


def test_edit_pairs_meet_few_others(spark):
    import random

    from halyard.operators import retrieval as R

    words = "anvil blue bolt cold gear gizmo hot large new old plate red ring rod small widget".split()
    rng = random.Random(1)
    names = sorted({" ".join(rng.sample(words, 3)) for _ in range(200)})
    df = spark.createDataFrame([(n,) for n in names], "name string")
    met = R.edit_candidates(df, 0.6)
    found = R.edit_pairs(df, 0.6)
    assert met.count() < 0.7 * len(names) * (len(names) - 1) / 2 and found.count() < 0.05 * met.count() + len(names) * 4
    assert found.where("ratio < 0.6 OR a >= b").count() == 0


def test_missing_field_scenarios(spark):
    from halyard.operators import policies as P

    rows = spark.range(3000).selectExpr("id", *(f"'{f}' AS `{f}`" for f in P.OPTIONAL if f != "timezone"))
    found = {(r["scenario"], r["id"]): r for r in P.scenarios(rows, "id").collect()}
    assert len(found) == 11 * 3000 and found == {(r["scenario"], r["id"]): r for r in P.scenarios(rows.repartition(5), "id").collect()}
    for name, fields in P.REMOVED.items():
        assert all((r[f] is None) == (f in fields or f == "timezone") for (s, i), r in found.items() if s == name for f in P.OPTIONAL)
    for name, share in [*P.CHANCE.items(), ("empirical_missingness", 619 / 1931)]:
        own = [r for (s, _), r in found.items() if s == name]
        assert abs(sum(r["component"] is None for r in own) / 3000 - share) < 0.04
        assert name != "empirical_missingness" or all(r["user"] for r in own)
    assert P.scenarios(rows.limit(0), "id").count() == 0


def test_route_of_a_row(spark):
    from halyard.operators import analytics as A

    history = [("A", "two")] * 18 + [("A", "one")] * 2 + [("B", "one")] * 18 + [("B", "two")] * 2 + [("C", "three")] * 2
    tickets = spark.createDataFrame([(c, line, "import") for c, line in history] + [("A", "one", "operator-review")] * 50, "category string, final_line string, source_hash string")
    prior = A.route_prior(tickets)
    assert {r["category"] for r in prior.collect()} == {"A", "B"}
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "none")], "request_id long, service string")
    model = spark.createDataFrame([(i, line, p) for i in (1, 2, 3) for line, p in (("one", 0.45), ("two", 0.40), ("three", 0.15))], "request_id long, final_line string, p double")
    likely = spark.createDataFrame([("a", "A", 0.8), ("a", "B", 0.2), ("b", "B", 1.0), ("none", "C", 1.0)], "service string, category string, weight double")
    got = {r["request_id"]: (r["final_line"], r["p"]) for r in A.routed(rows, model, likely, prior).collect()}
    two = 0.45 * 0.40 + 0.55 * (0.8 * 19 / 23 + 0.2 * 3 / 23)
    assert got == {1: ("two", round(two, 4)), 2: ("one", round(0.45 * 0.45 + 0.55 * 19 / 23, 4)), 3: ("one", 0.45)}


def test_ngram_reports_stay_in_their_rows(spark):
    from halyard.plans import registry, text as X

    assert "sc11_char_ngrams" in registry.QUERIES
    rows = [(1, ["ab", "a", "ab"]), (2, ["ab", "c"]), (2, ["de"]), (3, []), (4, None), (None, ["x", "yz"]), (None, ["x"])]
    frame = spark.createDataFrame(rows, "doc_id long, w array<string>").select("*", F.array_distinct("w").alias("d"))
    cut = {
        "words": lambda w, k: [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)],
        "chars": lambda w, k: [f" {x} "[i : i + k] for x in w for i in range(max(1, len(x) + 3 - k))],
    }
    words = X.ngram_report(frame, lambda k: S.word_ngrams("w", k), (1, 2, 3), lambda k: F.greatest(F.size("w") - (k - 1), F.lit(0)))
    for kind, sizes, got in (("words", (1, 2, 3), words), ("chars", X.CHARS, X.char_ngram_report(frame))):
        grams = {}
        for doc, w in rows:
            for k in sizes:
                grams.setdefault((doc, k), []).extend(cut[kind](w or [], k))
        want = {(*key, len(g), len(set(g)), min(g), max(g)) for key, g in grams.items() if g}
        assert set(map(tuple, got.collect())) == want
        plan = got.where("doc_id = 1")._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftAnti" in plan and "LeftSemi" in plan  # only ids of several rows go the way of shuffled runs


def test_weight_grid_is_spread_after_labels_meet(spark):
    from halyard.plans import registry

    plan = registry.QUERIES["pl10_weight_grid"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode") < plan.index("collect_list")  # the plan's root is its first line


def test_weights_in_rows_equal_the_joined_ones(spark, monkeypatch):
    from halyard.operators import retrieval as R

    monkeypatch.setattr(R, "FREQUENT", 3)  # so that some terms are near and some far
    docs = spark.createDataFrame([(1, "common word one common", "a"), (2, "common word two", "a"), (2, "two more of it", "b"), (3, "common stock", None), (4, "", "a"), (5, None, "a"), (6, "lone", "b")], "doc_id long, text string, lang string")
    old = {(r.doc_id, r.term): r.w for r in R.tfidf(R.terms(docs), docs.agg(F.count(F.lit(1)).alias("n"))).collect()}
    w = R.weighted(docs)
    assert {len(r.terms) for r in w.near.collect()} > {0} and w.far.count() > 0
    sums = {r.doc_id: r for r in R.lengths(w).collect()}
    assert sums.keys() == {i for i, _ in old}
    for i, r in sums.items():
        own = [x for (d, _), x in old.items() if d == i]
        assert r.n == len(own) and abs(r.top / r.size - max(own)) < 1e-12 and abs(r.total / r.size - sum(own)) < 1e-12
    best = {(r.doc_id, r["rank"]): r.term for r in R.best_terms(w, 2, 3).collect()}
    want = {(i, k + 1): t for i in sums for k, t in enumerate(sorted((t for d, t in old if d == i and len(t) > 2), key=lambda t: (-round(old[i, t], 9), t))[:2])}
    assert best == want
    got = {(r.label, r.term): r.s for r in R.weights_by_label(w, docs.select("doc_id", F.col("lang").alias("label")), 4).collect()}
    want = {}
    for r in docs.collect():
        for (i, t), x in old.items():
            if i == r.doc_id and len(t) > 3:
                want[r.lang, t] = want.get((r.lang, t), 0) + x
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_draw_is_hashed_once(spark):
    rows = spark.range(5).withColumn("gain", F.lit(1))
    means = D.drawn(rows, "id", 3, 17).groupBy("replicate").agg((F.sum(F.col("w") * F.col("gain")) / F.sum("w")).alias("m"))
    assert plan_of(means).count("sha2(") == 1
    want = {(i, k): D.drawn(spark.createDataFrame([(i,)], "id long"), "id", 3, 17).where(F.col("replicate") == k).first().w for i in (0, 4) for k in (1, 3)}
    got = {(r.id, r.replicate): r.w for r in D.drawn(rows, "id", 3, 17).collect()}
    assert len(got) == 15 and all(got[k] == v for k, v in want.items())


def test_label_weights_do_not_deal_rows_by_label(spark):
    from halyard.operators import learning as L

    rows = spark.range(40).select(F.col("id").alias("vec_id"), (F.col("id") % 3).cast("double").alias("label"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = L.balanced(rows, "label")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert L.classifier("svc", 4, 3).getParallelism() > 1

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from curadrift.operators import agreement as A, entities as E, quality as Q, reports as R
from curadrift.sources import sinks
from curadrift.session import fresh_path

SCHEMA = "id long, task_id long, annotator_id long, label string, lead_time double, created_at timestamp_ntz"


def notes(spark, rows):
    full = [(i, t, a, label, 1.0, datetime(2024, 1, 1) + timedelta(minutes=i)) for i, (t, a, label) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def tasks(spark, n):
    return spark.createDataFrame([(i, datetime(2024, 1, 1)) for i in range(n)], "id long, created_at timestamp_ntz")


def test_consistency(spark):
    agree, _ = Q.assess_consistency(tasks(spark, 1), notes(spark, [(0, 1, "a"), (0, 2, "a")]))
    assert agree.first()["score"] == 1.0
    score, issues = Q.assess_consistency(tasks(spark, 1), notes(spark, [(0, 1, "a"), (0, 2, "b"), (0, 3, "c")]))
    assert score.first()["score"] == 0.0 and issues.first()["severity"] == "high"


def test_coverage_formula(spark):
    full = Q.completeness_counts(tasks(spark, 2), notes(spark, [(0, 1, "a"), (1, 1, "a")])).first()
    assert full["score"] > 0.8
    third = Q.completeness_counts(tasks(spark, 3), notes(spark, [(0, 1, "a")])).first()
    assert third["score"] == pytest.approx(0.7 / 3 + 0.3)


def test_known_kappa(spark):
    # 20 both yes, 5 / 10 split, 15 both no: po 0.7, pe 0.5, kappa 0.4
    rows, t = [], 0
    for n, l1, l2 in [(20, "yes", "yes"), (5, "yes", "no"), (10, "no", "yes"), (15, "no", "no")]:
        for _ in range(n):
            rows += [(t, 1, l1), (t, 2, l2)]
            t += 1
    pair = A.pair_agreement(A.pair_label_counts(notes(spark, rows))).first()
    assert pair["kappa"] == pytest.approx(0.4) and pair["rate"] == pytest.approx(0.7) and pair["shared"] == 50


def test_kappa_of_one_label_is_undefined(spark):
    df = notes(spark, [(0, 1, "a"), (0, 2, "a"), (1, 1, "a"), (1, 2, "a")])
    pairs = A.pair_agreement(A.pair_label_counts(df))
    assert pairs.first()["kappa"] is None
    assert A.mean_kappa(pairs).first()["kappa"] == 1.0
    assert A.mean_kappa(A.pair_agreement(A.pair_label_counts(notes(spark, [(0, 1, "a")])))).first()["kappa"] == 1.0


def test_last_label_wins(spark):
    df = notes(spark, [(0, 1, "a"), (0, 1, "b"), (0, 2, "b")])
    assert A.pair_agreement(A.pair_label_counts(df)).first()["rate"] == 1.0


@pytest.mark.parametrize("limit", [1, 10, 1000])
def test_crowded_tasks_count_the_same(spark, limit):
    rows = [(0, a, "xyz"[a % 3]) for a in range(60)] + [(1 + a % 7, a % 5, "xy"[a % 2]) for a in range(40)] + [(99, a, "xy"[a % 2]) for a in range(30)]
    df = notes(spark, rows)
    got = {(r["a1"], r["a2"], r["l1"], r["l2"]): r["n"] for r in A.pair_label_counts(df, join_annotators=limit).collect()}
    last = {}
    for t, a, label in rows:
        last[(t, a)] = label
    want = {}
    for (t, a), la in last.items():
        for (u, b), lb in last.items():
            if t == u and a < b:
                want[(a, b, la, lb)] = want.get((a, b, la, lb), 0) + 1
    assert got == want


def test_crowded_tasks_in_several_blocks(spark):
    rows = [(t, a, "xyz"[(a + t) % 3]) for t in range(4) for a in range(30)]
    labels = A.last_labels(notes(spark, rows))
    blocked = A._pairs_by_blocks(labels, block_annotators=8, chunk_tasks=2)
    joined = A._pairs_by_join(labels)
    key = ["a1", "a2", "l1", "l2", "n"]
    assert sorted(blocked.select(key).collect()) == sorted(joined.select(key).collect())


def test_share_gap_of_a_label_never_used(spark):
    df = notes(spark, [(i, 1, "a") for i in range(6)] + [(i, 2, "b") for i in range(4)])
    got = {r["annotator_id"]: r["max_difference"] for r in Q.label_share_gaps(df).collect()}
    assert got == {1: pytest.approx(0.4), 2: pytest.approx(0.6)}


def test_speed_anomaly_needs_spread(spark):
    df = notes(spark, [(i, 1, "a") for i in range(30)])
    assert Q.speed_anomalies(df).count() == 0
    slow = df.withColumn("lead_time", F.when(F.col("id") == 3, 100.0).otherwise(F.col("lead_time")))
    row = Q.speed_anomalies(slow).first()
    assert row["id"] == 3 and row["severity"] == "high"


def test_bias(spark):
    df = notes(spark, [(i, 1, "a") for i in range(22)] + [(100, 2, "b")])
    score, issues = Q.assess_bias(tasks(spark, 1), df)
    assert issues.count() == 2 and score.first()["score"] == pytest.approx(1 - 2 / 3)


def test_failing_assessor_scores_zero(spark):
    Q.register_assessor("broken", lambda t, a: (t.select("nothing"), a))
    try:
        scores, issues = Q.run_assessment(tasks(spark, 2), notes(spark, [(0, 1, "a")]), ["completeness", "broken"])
        got = {r["assessor"]: (r["score"], r["error"] is None) for r in scores.collect()}
        assert got["broken"] == (0.0, False) and got["completeness"][1]
        assert Q.report_header(scores, issues).first()["failed"] == 1
    finally:
        del Q.ASSESSORS["broken"]


def test_accuracy(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "predicted string, truth string")
    row = Q.accuracy_macro(df).first()
    assert row["exact_match"] == 0.5 and row["labels"] == 3
    assert row["precision"] == pytest.approx((0.5 + 1 + 0) / 3) and row["recall"] == pytest.approx((1 + 1 / 3 + 0) / 3)


def test_toggle_and_newest(spark):
    ids = spark.createDataFrame([(1,), (2,)], "id int")
    toggled = spark.createDataFrame([(2,), (3,), (4,), (4,)], "id int")
    assert sorted(r["id"] for r in E.toggle_selection(ids, toggled).collect()) == [1, 3]
    rows = spark.createDataFrame([("a", 1, "old"), ("a", 5, "new"), ("b", 2, "b"), ("c", 3, "c")], "id string, seq int, body string")
    assert [(r["id"], r["body"]) for r in E.keep_newest(rows, "id", "seq", 2).collect()] == [("c", "c"), ("b", "b")]
    merged = {r["id"]: r["body"] for r in E.merge_samples(rows.limit(1), rows, "id").collect()}
    assert merged["a"] == "new"


def test_partial_update_keeps_old_values(spark):
    schema = "log_id string, decision string, note string, seq int"
    known = spark.createDataFrame([("l", None, "kept", 1)], schema)
    out = E.merge_partial(known, spark.createDataFrame([("l", "accepted", None, 2)], schema), "log_id").first()
    assert (out["decision"], out["note"], out["first_seq"]) == ("accepted", "kept", 1)


def test_marking_twice_changes_nothing(spark):
    samples = spark.createDataFrame([(1, None), (2, ["x"])], "sample_id int, tags array<string>")
    hit = spark.createDataFrame([(1,), (1,)], "sample_id int")
    once = E.mark_needs_review(samples, hit)
    assert once.filter("marked").count() == 1
    again = E.mark_needs_review(once.drop("marked"), hit)
    assert again.filter("marked").count() == 0 and again.filter("sample_id = 1").first()["tags"] == ["needs_review"]


def test_ids_go_on_after_the_last_report(spark):
    path = fresh_path(spark, "test-reports")
    head = spark.createDataFrame([("p", 0.5), ("q", 0.7)], "project string, overall_score double")
    found = spark.createDataFrame([("p", 1), ("p", 2), ("q", 3)], "project string, place int")
    sinks.append_report(path, head, found, ["place"])
    headers, issues = sinks.append_report(path, head, found, ["place"])
    assert sorted(r["report_id"] for r in headers.collect()) == [1, 2, 3, 4]
    assert sorted(r["issue_id"] for r in issues.collect()) == [1, 2, 3, 4, 5, 6]
    assert headers.inputFiles()[0].count("project=") == 1


def test_comparison_needs_two_reports(spark):
    t = datetime(2024, 1, 10)
    rows = [("p", "r1", t, 0.5, 4), ("p", "r2", t + timedelta(days=1), 0.4, 6), ("q", "r3", t, 0.5, 1), ("p", "r0", t - timedelta(days=90), 0.9, 0)]
    df = spark.createDataFrame(rows, "project string, report_id string, created_at timestamp_ntz, overall_score double, issue_count int")
    out = R.comparison_report(df, F.lit("2024-01-20").cast("timestamp_ntz")).collect()
    assert len(out) == 1 and out[0]["trend"] == "declining" and out[0]["issue_change"] == 2 and out[0]["report_count"] == 2


def test_results_from_cells_equal_those_from_rows(spark):
    rows = [(i, i * 7 % 11, i * 5 % 4, [None, "a", "b", "c"][i * 3 % 4], float(i % 9) * (100 if i == 50 else 1), i * 13 % 29) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, task_id long, annotator_id long, label string, lead_time double, at long").withColumn(
        "created_at", F.timestamp_seconds("at"))
    cells, every = Q.count_cells(df), spark.range(13)
    both = lambda f: (sorted(map(str, f(None).collect())), sorted(map(str, f(cells).collect())))
    for f in (
        lambda c: Q.task_label_sets(df, c), lambda c: Q.majority_vote(df, c), lambda c: Q.coverage_metrics(every, df, 5, c), lambda c: Q.label_share_gaps(df, c),
        lambda c: A.pair_label_counts(df, cells=c), lambda c: Q.bias_parts(df, c)[1], lambda c: Q.speed_anomalies(df, cells=c).select("id", F.round("z_score", 9)),
        lambda c: Q.timeliness(every.withColumn("created_at", F.timestamp_seconds("id")), df, cells=c),
    ):
        rowwise, cellwise = both(f)
        assert rowwise and rowwise == cellwise


def test_an_assessor_that_fails_late_is_alone_with_it(spark):
    Q.register_assessor("late", lambda t, a: (t.select(F.lit("late").alias("assessor"), F.raise_error(F.lit("too late")).cast("double").alias("score")), a))
    try:
        scores, issues = Q.run_assessment(tasks(spark, 2), notes(spark, [(0, 1, "a")]), ["completeness", "late"])
        assert {r.assessor: r.error is None for r in scores.collect()} == {"completeness": True, "late": False}
        assert issues.count() == 0
    finally:
        del Q.ASSESSORS["late"]

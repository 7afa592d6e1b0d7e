"""Cases outside the query fixtures: each was wrong once."""

import math

import check
import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from curadrift.functions import numbers as N, probabilities as PR, vectors as V
from curadrift.operators import anomaly as A, distribution as D, graph as G, preferences as P, quality as Q, selection as S, trajectories as J, versions as Z
from curadrift.session import fresh_path
from curadrift.streaming import operators as SO


def test_share_gap_counts_labels_never_used(spark):
    rows = [(1, "a")] * 72 + [(1, "b")] * 14 + [(1, "c")] * 14 + [(2, "a")] * 10 + [(2, "c")] * 10 + [(2, "b")] * 10 + [(3, "b")] * 20
    df = spark.createDataFrame(rows, "annotator_id long, label string")
    total = len(rows)
    overall = {x: sum(r[1] == x for r in rows) / total for x in "abc"}
    want = {}
    for who in (1, 2, 3):
        own = [r[1] for r in rows if r[0] == who]
        want[who] = max(abs(own.count(x) / len(own) - overall[x]) for x in "abc")
    got = {r.annotator_id: r.max_difference for r in Q.label_share_gaps(df).collect()}
    assert got == pytest.approx(want)


def test_share_gap_of_a_light_label_decides(spark):
    # annotator 9 uses five labels as all do, but not the sixth, whose share is 0.28
    rows = [(1, "f")] * 28 + [(1, x) for x in "abcde" for _ in range(10)] + [(9, x) for x in "abcde" for _ in range(4)]
    df = spark.createDataFrame(rows, "annotator_id long, label string")
    got = {r.annotator_id: r.max_difference for r in Q.label_share_gaps(df).collect()}
    assert got[9] == pytest.approx(28 / len(rows))


@pytest.mark.parametrize("size", [3, 128, 129])
def test_vectors_of_another_length_give_null(spark, size):
    rows = [(1, [1.0] * size), (2, [1.0] * (size + 1)), (3, [1.0] * (size - 1)), (4, None)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    got = df.select("id", V.distance_to(F.col("v"), [0.0] * size).alias("d"), V.dot_with(F.col("v"), [2.0] * size).alias("p")).orderBy("id").collect()
    assert got[0].d == pytest.approx(math.sqrt(size)) and got[0].p == pytest.approx(2 * size)
    assert all(r.d is None and r.p is None for r in got[1:])


def test_consensus_of_all_members(spark):
    df = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0], [0.5, 0.5]],)], "m array<array<double>>")
    assert df.select(PR.consensus(F.col("m")).alias("c")).first().c == pytest.approx([0.5, 0.5])


@pytest.mark.parametrize("z", [1.0, 1.5, 2.0, 7.5, 50.0, 300_000.5])
def test_log_gamma(spark, z):
    got = spark.range(1).select(N.log_gamma(F.lit(z)).alias("g")).first().g
    assert got == pytest.approx(math.lgamma(z), rel=1e-12, abs=1e-11)


def test_duplicates_and_a_far_row(spark):
    rows = [(i, [1.0, 1.0]) for i in range(20)] + [(20, [50.0, 50.0])]
    got = {r.id: r for r in A.lof_detector(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 5).collect()}
    assert got[20].is_anomaly and got[20].score == float("inf")
    assert not any(got[i].is_anomaly for i in range(20)) and got[3].score == 1.0


def test_every_tree_draws_from_the_whole_table(spark):
    rows = [(i, [float(i % 17), float(i % 5)]) for i in range(300)] + [(300, [900.0, -900.0])]
    out = A.isolation_forest(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", trees=30)
    best = out.orderBy(F.desc("score")).first()
    assert best.id == 300 and out.count() == 301


def test_a_tree_gets_its_rows_from_any_table(spark):
    for rows in (1, 255, 256, 257, 10**6, 200 * 10**6, 257 * 10**6, 10**12):
        share = (A._last_hash(rows, 256) + (1 << 63) + 1) / 2**64
        assert abs(share * rows - min(rows, 256)) < 1e-3
    assert A._last_hash(0, 256) < -(1 << 63) + 1 and A._last_hash(5, 256) == (1 << 63) - 1
    frame = spark.createDataFrame([(i, [float(i)]) for i in range(50)], "id long, v array<double>")
    assert A.isolation_forest(frame, "id", "v", trees=2, sample=0).collect() == []


def test_failures_leave_the_others_alone(spark):
    def late(df):
        bad = F.pandas_udf(lambda s: 1 / 0, "boolean")
        return df.select("id", bad("id").alias("is_anomaly"))

    df = spark.createDataFrame([(1, 1.0), (2, 2.0)], "id long, x double")
    fine = lambda d: A.statistical_detector(d, "id", ["x"])
    votes, failures = A.anomaly_consensus(df, {"late": late, "fine": fine, "missing": lambda d: d.select("nothing")})
    assert votes.count() == 2 and set(failures) == {"late", "missing"} and "ZeroDivisionError" in failures["late"]
    votes, failures = A.anomaly_consensus(df, {"late": late})
    assert votes.collect() == [] and A.consensus_summary(votes).first().total == 0


RING = [(i, 0, [math.cos(i * math.pi / 20), math.sin(i * math.pi / 20)]) for i in range(40)] + [(40, 0, [0.0, 0.0])]


def embeddings(spark, folder, rows):
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_a_row_without_a_vector_leaves_the_votes_of_all_detectors(spark, tmp_path):
    # only the local outlier factor finds the row in the middle
    sf = embeddings(spark, tmp_path, [*RING, (41, 0, None)])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet/*.parquet'")
    problem, _ = check.compare(queries()["anomaly_summary"](spark, sf), con, oracle_sql()["anomaly_summary"])
    assert problem is None, problem
    got = {r.id: (r.votes, r.detectors) for r in queries()["anomaly_consensus"](spark, sf).collect()}
    assert got == {**{i: (0, 2) for i in range(40)}, 40: (1, 2), 41: (0, 1)}


@pytest.mark.parametrize("name", ["anomaly_summary", "anomaly_consensus"])
def test_no_summary_without_the_votes_of_a_detector_that_failed(spark, tmp_path, monkeypatch, name):
    sf = embeddings(spark, tmp_path, [*RING, (41, 0, [0.0, 0.0, 1.0])])
    with pytest.raises(RuntimeError, match="detector lof failed"):
        queries()[name](spark, sf)
    monkeypatch.setattr(A, "checkpointed", lambda df: 1 / 0)
    with pytest.raises(RuntimeError, match="(?s)detector statistical failed: division by zero.*detector lof failed"):
        queries()[name](spark, sf)


def test_an_assessment_in_which_all_fail(spark, monkeypatch):
    def fails(tasks, annotations):
        raise KeyError("no such column")

    monkeypatch.setattr(Q, "ASSESSORS", {"one": fails, "two": fails})
    empty = spark.range(0)
    scores, issues = Q.run_assessment(empty, empty)
    assert sorted(r.assessor for r in scores.collect()) == ["one", "two"]
    head = Q.report_header(scores, issues).first()
    assert head.overall_score == 0 and head.failed == 2 and head.issue_count == 0


def test_an_emptied_node_hides_what_lies_below(spark):
    schema = "sample_id long, path array<int>, text string, n_children int"
    ai = [(1, [], "r", 2), (1, [0], "a", 1), (1, [0, 0], "b", 0), (1, [1], "c", 0), (2, [], "r", 1), (2, [0], "x", 0)]
    human = [(1, [], "r", 2), (1, [0], "", 1), (1, [0, 0], "changed", 0), (1, [1], "later", 0), (2, [], "", 1), (2, [0], "y", 0)]
    got = {r.sample_id: r for r in P.tree_divergence(spark.createDataFrame(ai, schema), spark.createDataFrame(human, schema)).collect()}
    assert (got[1].kind, got[1].path, got[1].text) == ("text", [1], "later") and got[2].kind == "same"


def test_nan_has_no_part_in_a_distribution(spark):
    rows = [("f", float(i), i % 2 == 0) for i in range(40)]
    schema = "feature string, value double, is_ref boolean"
    clean, dirty = spark.createDataFrame(rows, schema), spark.createDataFrame([*rows, ("f", float("nan"), True), ("f", None, False)], schema)
    for measure in (D.ecdf_distances, D.binned_distances):
        assert measure(clean, ["feature"]).collect() == measure(dirty, ["feature"]).collect()


def test_radius_zero_and_pairs_once(spark):
    rows = [(i, [float(i % 3), 0.0]) for i in range(9)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    assert G.radius_join(df, "id", "v", 0.0, closed=True).count() == 9 and G.radius_join(df, "id", "v", 0.0).count() == 0
    got = sorted((r.src, r.dst) for r in G.radius_join(df, "id", "v", 1.0, closed=True, block_rows=2).collect())
    want = sorted((i, j) for i in range(9) for j in range(i + 1, 9) if abs(i % 3 - j % 3) <= 1)
    assert got == want


def test_many_obstacles_and_anchors(spark):
    states = spark.createDataFrame([(i, [float(i), 0.0, 0.0]) for i in range(50)], "id long, state array<double>")
    blocks = spark.range(3000).select(F.array((F.col("id") * 2).cast("double"), F.lit(0.0), F.lit(0.0)).alias("position"), F.lit(None).cast("double").alias("radius"))
    assert sorted(r.id for r in J.obstacle_clearance(states, blocks).collect()) == list(range(0, 50, 2))
    assert J.obstacle_clearance(states, blocks.limit(0)).collect() == []
    anchors = spark.range(1500).select(F.col("id").alias("anchor"), F.array(F.col("id").cast("double"), F.lit(0.0), F.lit(0.0)).alias("v"))
    out = S.anchor_distances(states, "id", "state", anchors, ["euclidean"], block_anchors=400)
    assert out.count() == 50 * 1500 and out.where("abs(euclidean - abs(id - anchor)) > 1e-9").count() == 0


def test_unknown_start_and_empty_baseline_say_so(spark):
    df = spark.createDataFrame([(1, [0.0])], "id long, v array<double>")
    with pytest.raises(ValueError, match="no row"):
        S.farthest_first(df, "id", "v", 2, 7)
    with pytest.raises(ValueError, match="no values"):
        SO.histogram_baseline(spark.createDataFrame([], "x double"), "x", 5)


def test_latest_state_does_not_depend_on_the_cut(spark):
    rows = [("report", str(i % 150), i, f"b{i}") for i in range(400)] + [("snapshot", "s", 400 + i, str(i)) for i in range(3)]
    rows += [("report", str(i), 500 + i, "again") for i in range(10)]
    found = []
    for cuts in ([0, len(rows)], [0, 100, 160, 300, len(rows)]):
        state = SO.BatchState(spark, fresh_path(spark, "cut"), SO.LATEST_SCHEMA)
        step = SO.latest_state_step(state)
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            step(spark.createDataFrame(rows[a:b], SO.LATEST_SCHEMA), n)
        found.append(sorted(map(tuple, state.current().collect())))
    assert found[0] == found[1] and sum(r[0] == "report" for r in found[0]) == 100 and ("report", "3", 503, "again") in found[0]


def test_every_column_and_microsecond_counts_in_a_hash(spark):
    rows = "SELECT 1 AS id, TIMESTAMP_NTZ '2024-01-01 00:00:00.000001' AS at, 1.5D AS x"
    other = [rows.replace(".000001", ".000002"), rows.replace("1.5D", "1.25D")]
    digests = [Z.table_hash(spark.sql(q)).first().data_hash for q in (rows, *other)]
    assert len(set(digests)) == 3


@pytest.mark.parametrize("before", [False, True])
def test_page_hinkley_settles_in_few_rounds(spark, before, monkeypatch):
    import numpy as np

    from curadrift.operators import sequential as SQ

    rng = np.random.default_rng(3)
    x = rng.normal(-1, 1, 3200)
    x[1000:1100] += 3.0
    x[2200:2260] += 4.0
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(x)], "k string, i long, x double")
    m, low, n, want = 0.0, float("inf"), 0, []
    for i, v in enumerate(x):
        m += v - 0.005
        low, n = min(low, m), n + 1
        if m - low > 50:
            want.append((i, n))
            m, low = 0.0, float("inf")
    scan, rounds = SQ.page_hinkley_scan(), []
    kept = SQ.checkpointed
    monkeypatch.setattr(SQ, "checkpointed", lambda d: (rounds.append(d.columns), kept(d))[1])
    if before:
        alarms, states = SQ.scan_ordered(df.where("i < 1040"), "k", ["i"], "x", scan, rows_per_part=400)
        rest, states = SQ.scan_ordered(df.where("i >= 1040"), "k", ["i"], "x", scan, kept(states), rows_per_part=400)
        alarms = alarms.unionByName(rest)
        assert states.first().state[-1] == 3200
    else:
        alarms, _ = SQ.scan_ordered(df, "k", ["i"], "x", scan, rows_per_part=50)
        assert sum("next" in c for c in rounds) < 5
    got = sorted((r.i, r.window_size) for r in alarms.collect())
    assert len(want) >= 2 and got == want


def test_greedy_passes_write_no_vectors(spark, monkeypatch):
    kept, written = S.checkpointed, []
    monkeypatch.setattr(S, "checkpointed", lambda d: (written.append(d.columns), kept(d))[1])
    rows = [(i, [float(i * 37 % 101), float(i * 53 % 97)], float(i % 7)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, v array<double>, u double")
    few = [tuple(r) for r in S.farthest_first(df, "id", "v", 12, 5, candidates=3).collect()]
    many = [tuple(r) for r in S.farthest_first(df, "id", "v", 12, 5).collect()]
    assert few == many and len({r[1] for r in few}) == 12
    few = [tuple(r) for r in S.uncertain_and_diverse(df, "id", "v", "u", 8, candidates=2).collect()]
    many = [tuple(r) for r in S.uncertain_and_diverse(df, "id", "v", "u", 8).collect()]
    assert [r[:2] for r in few] == [r[:2] for r in many]
    assert not any("v" in columns for columns in written)

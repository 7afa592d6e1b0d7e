"""Order-dependent helpers against plain loops, with a hot group spread over several parts."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from curadrift.operators import quality as Q, sequential as S
from curadrift.operators.agreement import intra_annotator_consistency
from curadrift.operators.ordered import PART, indexed, neighbours, ranged, running


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    key = np.where(rng.random(900) < 0.6, "hot", rng.choice(["a", "b", "c"], 900))
    pdf = pd.DataFrame({"k": key, "t": rng.permutation(900), "x": np.round(rng.normal(1, 2, 900), 3)})
    return pdf, spark.createDataFrame(pdf)


def test_hot_group_is_spread(skewed):
    parts = ranged(skewed[1], ["k"], ["t"])
    assert parts.filter("k = 'hot'").select(PART).distinct().count() > 1


def test_running_values(skewed):
    pdf, df = skewed
    out = running(
        ranged(df, ["k"], ["t"]), ["k"], ["t"], sums={"total": F.col("x")}, mins={"low": F.col("x")}, next_of="t"
    ).toPandas().sort_values(["k", "t"])
    want = pdf.sort_values(["k", "t"])
    by = want.groupby("k")
    np.testing.assert_allclose(out["total"], by["x"].cumsum(), atol=1e-9)
    np.testing.assert_allclose(out["low"], by["x"].cummin())
    np.testing.assert_allclose(out["total_total"], by["x"].transform("sum"))
    np.testing.assert_allclose(out["next_t"].astype(float).fillna(-1), by["t"].shift(-1).fillna(-1))


@pytest.mark.parametrize("bucket_rows", [2, 7, 1000])
def test_neighbours(skewed, bucket_rows):
    pdf, df = skewed
    out = neighbours(indexed(df, ["k"], ["t"]), ["k"], {"back": ("x", 2), "ahead": ("x", -1)}, bucket_rows).toPandas()
    out = out.sort_values(["k", "t"])
    want = pdf.sort_values(["k", "t"])
    assert out["idx"].tolist() == (want.groupby("k").cumcount() + 1).tolist()
    np.testing.assert_allclose(out["back"].astype(float).fillna(-9), want.groupby("k")["x"].shift(2).fillna(-9))
    np.testing.assert_allclose(out["ahead"].astype(float).fillna(-9), want.groupby("k")["x"].shift(-1).fillna(-9))


def loop(pdf, scan):
    out = []
    for k, group in pdf.sort_values(["k", "t"]).groupby("k"):
        alarms, _ = scan(group["x"].to_numpy(), np.array([]))
        out += [(k, int(group["t"].iloc[a[0]]), round(a[1], 6), a[3]) for a in alarms]
    return sorted(out)


@pytest.mark.parametrize("scan", [S.page_hinkley_scan(threshold=20.0), S.adwin_scan()], ids=["page_hinkley", "adwin"])
def test_resetting_detectors(skewed, scan):
    pdf, df = skewed
    shifted = df.withColumn("x", F.col("x") + F.when(F.col("t") > 450, 4).otherwise(0))
    pdf = pdf.assign(x=pdf["x"] + np.where(pdf["t"] > 450, 4, 0))
    got = S.sequential_alarms(shifted, "k", ["t"], "x", scan).collect()
    want = loop(pdf, scan)
    assert len(want) > 3
    assert sorted((r["k"], r["t"], round(r["statistic"], 6), r["window_size"]) for r in got) == want


def test_states_carry_over(skewed):
    """Two halves read one after the other give the alarms of one reading."""
    pdf, df = skewed
    scan = S.adwin_scan()
    first, state = S.scan_ordered(df.filter("t < 400"), "k", ["t"], "x", scan)
    second, _ = S.scan_ordered(df.filter("t >= 400"), "k", ["t"], "x", scan, state)
    got = sorted((r["k"], r["t"], round(r["statistic"], 6), r["window_size"]) for r in first.collect() + second.collect())
    assert got == loop(pdf, scan)


def test_page_hinkley_first_alarm(skewed):
    pdf, df = skewed
    got = {r["k"]: r["position"] for r in S.page_hinkley_first(df, "k", ["t"], "x", threshold=15.0).collect()}
    want = {}
    for k, group in pdf.sort_values("t").groupby("k"):
        alarms, _ = S.page_hinkley_scan(threshold=15.0)(group["x"].to_numpy(), np.array([]))
        if alarms:
            want[k] = alarms[0][0] + 1
    assert got == want


def test_ddm(spark):
    rng = np.random.default_rng(5)
    errors = np.concatenate([rng.random(300) < 0.1, rng.random(200) < 0.6]).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "t": range(500), "e": errors}))
    got = [r["position"] for r in S.ddm(df, "k", ["t"], "e").orderBy("position").collect()]
    want, low, best = [], np.inf, None
    for n in range(1, 501):
        p = errors[:n].mean()
        s = np.sqrt(p * (1 - p) / n)
        if n >= 30:
            if p + s < low:
                low, best = p + s, (p, s)
            if p + s > best[0] + 3 * best[1]:
                want.append(n)
    assert got == want and want


def test_statistics_of_a_hot_group(skewed):
    pdf, df = skewed
    got = Q.compute_statistics(df, "x", ["k"]).toPandas().set_index("k")
    want = pdf.groupby("k")["x"]
    np.testing.assert_allclose(got["median"], want.median().loc[got.index], atol=1e-9)
    np.testing.assert_allclose(got["std"], want.std(ddof=0).loc[got.index], atol=1e-9)
    np.testing.assert_allclose(got["mean"], want.mean().loc[got.index], atol=1e-9)


def test_statistics_of_nothing(spark):
    row = Q.compute_statistics(spark.createDataFrame([], "x double"), "x").first()
    assert row.asDict() == {"mean": 0.0, "std": 0.0, "min": 0.0, "max": 0.0, "median": 0.0, "count": 0}


def test_consistency_counts_changes(spark):
    rows = [(1, i, 1, "a" if i < 3 else "b", None, i) for i in range(5)] + [(9, 1, 2, "a", None, 0)]
    df = spark.createDataFrame(rows, "id int, task_id int, annotator_id int, label string, lead_time double, created_at int")
    got = {r["annotator_id"]: r["consistency"] for r in intra_annotator_consistency(df).collect()}
    assert got == {1: 0.75, 2: 1.0}


def plain_adwin(values, entry, delta=S.ADWIN_DELTA):
    """Every cut tested for every value."""
    window, alarms = list(entry), []
    for i, x in enumerate(values):
        window.append(float(x))
        n = len(window)
        for c in range(max(n // 2, 5), min(n - 2, n - 5) + 1) if n >= 10 else ():
            gap = abs(sum(window[:c]) / c - sum(window[c:]) / (n - c))
            if gap >= math.sqrt(2 * (1 / c + 1 / (n - c)) * math.log(2 / delta)):
                window = window[c:]
                alarms.append((i, gap, len(window)))
                break
    return alarms, window


@pytest.mark.parametrize("spread", [0.05, 0.6, 1.5, 6.0])
@pytest.mark.parametrize("carried", [0, 7, 300])
def test_adwin_by_bounds_equals_every_cut(spread, carried):
    rng = np.random.default_rng(int(spread * 100) + carried)
    level = np.repeat(rng.normal(0, 1, 6), [300, 40, 200, 11, 400, 150])
    values = level + rng.normal(0, spread, len(level))
    entry = rng.normal(0, spread, carried).tolist()
    alarms, window = S.adwin_scan()(values, entry)
    want, left = plain_adwin(values, entry)
    assert [(a[0], a[3]) for a in alarms] == [(a[0], a[2]) for a in want] and window == left
    assert all(abs(a[1] - b[1]) < 1e-9 for a, b in zip(alarms, want))


def test_adwin_tests_few_windows_of_a_steady_stream():
    values = np.random.default_rng(2).normal(0, 0.5, 60_000)
    bounds = S.CutBounds(values, S.ADWIN_DELTA)
    open_ = sum(int(bounds.possible(0, a, min(a + 1024, 60_001)).sum()) for a in range(10, 60_001, 1024))
    assert open_ < 60 * 8

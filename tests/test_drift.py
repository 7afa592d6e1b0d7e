import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from curadrift.functions.numbers import chi2_sf, kolmogorov_p
from curadrift.operators import distribution as D


def two_sides(spark, ref, cur, feature="f"):
    pdf = pd.DataFrame({"feature": feature, "value": np.concatenate([ref, cur]), "is_ref": [True] * len(ref) + [False] * len(cur)})
    return spark.createDataFrame(pdf)


@pytest.fixture(scope="module")
def normals(spark):
    rng = np.random.default_rng(11)
    return rng.normal(0, 1, 1000), rng.normal(0, 1, 1000), rng.normal(3, 1, 1000)


def test_same_distribution_has_no_drift(spark, normals):
    a, b, _ = normals
    row = D.ecdf_distances(two_sides(spark, a, b), ["feature"]).first()
    assert row["p_value"] > 0.05
    assert D.feature_drift(two_sides(spark, a, b)).first()["has_drift"] is False


def test_shift_is_found(spark, normals):
    a, _, c = normals
    df = two_sides(spark, a, c)
    assert D.feature_drift(df).first()["has_drift"] is True
    assert D.feature_drift(df, "wasserstein", 0.1).first()["has_drift"] is True
    w = D.ecdf_distances(df, []).first()["wasserstein"]
    assert abs(w - 3) < 0.2


def test_identical_sides_give_zero(spark, normals):
    a, _, _ = normals
    df = two_sides(spark, a, a)
    e = D.ecdf_distances(df, ["feature"]).first()
    assert e["ks"] == 0 and e["wasserstein"] == 0 and e["energy"] == 0 and e["p_value"] == 1
    b = D.binned_distances(df, ["feature"]).first()
    assert b["psi"] == 0 and b["chi2"] == 0 and abs(b["js"]) < 1e-15 and b["chi2_p"] == 1


def test_distances_against_brute_force(spark):
    rng = np.random.default_rng(2)
    a, b = np.round(rng.normal(0, 1, 220), 1), np.round(rng.normal(0.4, 2, 180), 1)
    row = D.ecdf_distances(two_sides(spark, a, b), []).first()
    grid = np.unique(np.concatenate([a, b]))
    f, g = [(a <= x).mean() for x in grid], [(b <= x).mean() for x in grid]
    gap = np.abs(np.array(f) - np.array(g))
    assert row["ks"] == pytest.approx(gap.max())
    assert row["wasserstein"] == pytest.approx((gap[:-1] * np.diff(grid)).sum())
    def mean(x, y):
        return np.abs(x[:, None] - y[None, :]).mean()
    assert row["energy"] == pytest.approx(2 * mean(a, b) - mean(a, a) - mean(b, b))


def test_constant_column(spark):
    df = two_sides(spark, [5.0] * 30, [5.0] * 20)
    h = D.histograms(df, ["feature"]).first()
    assert h["p_ref"][-1] == pytest.approx(31 / 40) and h["p_ref"][0] == pytest.approx(1 / 40)
    assert D.ecdf_distances(df, ["feature"]).first()["ks"] == 0


def test_empty_side(spark):
    df = two_sides(spark, [1.0, 2.0], [])
    row = D.ecdf_distances(df, ["feature"]).first()
    assert (row["ks"], row["wasserstein"], row["p_value"]) == (0.0, 0.0, 1.0)
    assert D.feature_drift(df).count() == 0
    assert D.binned_distances(df, ["feature"]).first()["psi"] == 0


@pytest.mark.parametrize("ref,cur,drift", [((50, 50), (48, 52), False), ((80, 20), (20, 80), True)])
def test_label_drift(spark, ref, cur, drift):
    labels = ["A"] * ref[0] + ["B"] * ref[1] + ["A"] * cur[0] + ["B"] * cur[1]
    df = spark.createDataFrame(pd.DataFrame({"label": labels, "is_ref": [True] * sum(ref) + [False] * sum(cur)}))
    row = D.label_drift(df).first()
    assert row["has_drift"] is drift
    if drift:
        assert row["statistic"] == pytest.approx(225.0) and row["drift_score"] > 0.5


def test_unseen_label(spark):
    df = spark.createDataFrame([("a", True), ("a", False), ("b", False)], "label string, is_ref boolean")
    row = D.label_drift(df).first()
    assert row["statistic"] == float("inf") and row["p_value"] == 0 and row["has_drift"]


def test_feature_shift_of_both_features(spark):
    rows = [(i, n, float(k * i + (0 if ref else 10 * k)), ref) for ref in (True, False) for i in range(100) for n, k in (("one", 1), ("two", 2))]
    df = spark.createDataFrame(rows, "id int, feature string, value double, is_ref boolean")
    scores = {r["feature"]: r["drift_score"] for r in D.feature_drift(df).collect()}
    assert set(scores) == {"one", "two"} and min(scores.values()) > 0


def test_p_values(spark):
    row = spark.range(1).select(
        chi2_sf(F.lit(3.841458820694124), F.lit(1)).alias("a"), chi2_sf(F.lit(18.307038053275146), F.lit(10)).alias("b"),
        chi2_sf(F.lit(float("inf")), F.lit(4)).alias("c"), chi2_sf(F.lit(0.0), F.lit(4)).alias("d"), chi2_sf(F.lit(900.0), F.lit(3)).alias("e"),
        chi2_sf(F.lit(500000.0), F.lit(500000)).alias("h"), chi2_sf(F.lit(503000.0), F.lit(500000)).alias("i"), chi2_sf(F.lit(900000.0), F.lit(500000)).alias("j"),
        kolmogorov_p(F.lit(0.0), F.lit(10), F.lit(10)).alias("f"), kolmogorov_p(F.lit(0.5), F.lit(50), F.lit(50)).alias("g"),
    ).first()
    assert row["a"] == pytest.approx(0.05, abs=1e-9) and row["b"] == pytest.approx(0.05, abs=1e-9)
    assert row["h"] == pytest.approx(0.5, abs=1e-3) and row["i"] == pytest.approx(0.00135, abs=1e-4) and row["j"] == 0
    assert (row["c"], row["d"], row["e"], row["f"]) == (0.0, 1.0, 0.0, 1.0)
    assert row["g"] == pytest.approx(2 * np.exp(-2 * 6.25), rel=1e-3)


def test_exact_ks_tail_against_every_order():
    for n in range(1, 9):
        for m in range(1, 9):
            first = np.array(list(itertools.combinations(range(n + m), n)))
            taken = np.zeros((len(first), n + m), int)
            np.put_along_axis(taken, first, 1, axis=1)
            i = taken.cumsum(axis=1)
            far = np.abs(i * m - (np.arange(1, n + m + 1) - i) * n).max(axis=1)
            for steps in np.unique(far):
                assert D.exact_ks_tail(n, m, int(steps)) == pytest.approx((far >= steps).mean(), rel=1e-12)
    assert D.exact_ks_tail(5, 7, 0) == 1
    assert D.exact_ks_tail(300, 300, 90000) == pytest.approx(2 / math.comb(600, 300), rel=1e-9)


def test_exact_p_for_small_samples_only(spark):
    rows = [("small", float(i), i < 4) for i in range(8)] + [("large", float(i), i % 2 == 0) for i in range(60)] + [("lone", 1.0, True)]
    ecdf = D.ecdf_distances(spark.createDataFrame(rows, "feature string, value double, is_ref boolean"), ["feature"])
    limit = {r.feature: r.p_value for r in ecdf.collect()}
    got = {r.feature: r.p_value for r in D.with_exact_p(ecdf, largest=20).collect()}
    assert got["small"] == pytest.approx(2 / math.comb(8, 4)) and got["small"] != limit["small"]
    assert got["large"] == limit["large"] and got["lone"] == 1.0


def test_fourier_features_approach_the_exact_value(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(0 if i % 2 else 1, 1, 4).tolist(), i % 2 == 0) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, embedding array<double>, is_ref boolean")
    exact = D.mmd_rbf(df, "id", 4).first()["mmd"]
    near = D.mmd_rbf_features(df, 4, n_features=2048).first()["mmd"]
    assert near == pytest.approx(exact, rel=0.15)


def test_alert_rows(spark):
    rows = [("x", "psi", True, "high", 0.9), ("y", "psi", True, "medium", 0.5), ("z", "psi", False, "critical", 1.0), ("w", "ks_test", True, "critical", 1.0)]
    df = spark.createDataFrame(rows, "feature string, method string, drift_detected boolean, severity string, score double")
    alerts = D.drift_alerts(df, ["feature"]).orderBy("feature").collect()
    assert [(a["alert_id"], a["feature"]) for a in alerts] == [("drift_1", "w"), ("drift_2", "x")]
    assert alerts[1]["message"] == "Drift detected using psi: score=0.900"

"""Queries for distribution drift."""

from pyspark.sql import functions as F

from curadrift.functions.numbers import r6
from curadrift.operators import distribution as D
from curadrift.plans.ctes import sql
from curadrift.plans.registry import query
from curadrift.sources.tables import (
    event_labels, event_values, ntz, numeric_features, samples, table,
)

KS_P = (
    "CASE WHEN lam < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * k * k * lam * lam))))) END"
)


def ecdf_steps(source: str) -> dict[str, str]:
    """ECDF of ``source(feature, value, is_ref)`` by window sums, as independent as SQL allows."""
    return {
        "vc": f"SELECT feature, value, count(*) FILTER (WHERE is_ref) AS cr, count(*) FILTER (WHERE NOT is_ref) AS cc FROM {source} GROUP BY 1, 2",
        "cum": "SELECT feature, value, sum(cr) OVER w / sum(cr) OVER g AS f, sum(cc) OVER w / sum(cc) OVER g AS c, sum(cr) OVER g AS nr, sum(cc) OVER g AS nc, lead(value) OVER w AS nv "
               "FROM vc WINDOW w AS (PARTITION BY feature ORDER BY value), g AS (PARTITION BY feature)",
        "ecdf": "SELECT feature, CAST(max(nr) AS BIGINT) AS n_ref, CAST(max(nc) AS BIGINT) AS n_cur, max(abs(f - c)) AS ks, sum(abs(f - c) * (nv - value)) AS w, 2 * sum((f - c) * (f - c) * (nv - value)) AS en FROM cum GROUP BY feature",
        "ks": "SELECT *, ks * sqrt(CAST(n_ref AS DOUBLE) * n_cur / (n_ref + n_cur)) AS lam FROM ecdf",
        "ksp": f"SELECT *, {KS_P} AS p FROM ks",
    }


# Lattice paths of all orders, one diagonal a round; a path that reaches the distance leaves, and ``gone`` is the share that left.
LATTICE = {
    "users": "SELECT user_id AS feature, value, ts < TIMESTAMP '2024-01-16' AS is_ref FROM events WHERE value IS NOT NULL",
    "sizes": "SELECT DISTINCT n_ref AS n, n_cur AS m, CAST(round(ks * n_ref * n_cur) AS BIGINT) AS h FROM ecdf WHERE n_ref > 0 AND n_cur > 0",
    "paths": "SELECT n, m, h, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS j, CAST(1 AS DOUBLE) AS w FROM sizes UNION ALL "
             "SELECT n, m, h, a, b, sum(v) FROM (SELECT n, m, h, i + s AS a, j + 1 - s AS b, w * CASE WHEN s = 1 THEN n - i ELSE m - j END / (n + m - i - j) AS v "
             "FROM paths, (VALUES (0), (1)) d(s) WHERE abs(i * m - j * n) < h AND i + j < n + m) WHERE a <= n AND b <= m GROUP BY 1, 2, 3, 4, 5",
    "tails": "SELECT n, m, h, CASE WHEN h = 0 THEN 1.0 ELSE coalesce(sum(w) FILTER (WHERE abs(i * m - j * n) >= h), 0) END AS gone FROM paths GROUP BY 1, 2, 3",
}


def hist_steps(source: str, bins: int = 10) -> dict[str, str]:
    return {
        "rg": f"SELECT feature, min(value) AS lo, (max(value) - min(value)) / {bins} AS w FROM {source} GROUP BY 1",
        "bn": f"SELECT feature, is_ref, CAST(least(floor((value - lo) / w), {bins - 1}) AS INTEGER) AS bin FROM {source} JOIN rg USING (feature)",
        "bc": f"SELECT f.feature, b.bin, count(bn.bin) FILTER (WHERE is_ref) AS cr, count(bn.bin) FILTER (WHERE NOT is_ref) AS cc FROM rg f CROSS JOIN range({bins}) b(bin) LEFT JOIN bn ON bn.feature = f.feature AND bn.bin = b.bin GROUP BY 1, 2",
        "sh": "SELECT feature, bin, (cr + 1.0::DOUBLE) / (sum(cr + 1) OVER (PARTITION BY feature)) AS r, (cc + 1.0::DOUBLE) / (sum(cc + 1) OVER (PARTITION BY feature)) AS c, sum(cc + 1) OVER (PARTITION BY feature) AS tc FROM bc",
        "hd": "SELECT feature, sum((c - r) * ln(c / r)) AS psi, 0.5 * sum(r * ln(2 * r / (r + c)) + c * ln(2 * c / (r + c))) AS js, sum((c - r) * (c - r) / r) AS chi2, max(tc) AS tc FROM sh GROUP BY feature",
    }


def gamma_tail(stat: str, dof: str) -> str:
    """Upper chi-square tail by the lower incomplete gamma series over lgamma."""
    a, x = f"({dof} / 2.0)", f"({stat} / 2.0)"
    return (f"CASE WHEN {stat} <= 0 THEN 1.0 WHEN {stat} = 'inf'::DOUBLE THEN 0.0 WHEN {x} > 2 * {a} + 150 THEN 0.0 ELSE greatest(0.0, least(1.0, 1 - list_sum(list_transform(range(0, 1200), "
            f"lambda j: exp(-{x} + ({a} + j) * ln({x}) - lgamma({a} + j + 1)))))) END")


@query("ks_test", sql("SELECT feature, n_ref, n_cur, round(ks, 6) AS statistic, round(p, 6) + 0.0 AS p_value, p < 0.05 AS drift FROM ksp", "numeric", **ecdf_steps("numeric")))
def ks_test(spark, sf):
    out = D.ecdf_distances(numeric_features(spark, sf), ["feature"])
    return out.select("feature", "n_ref", "n_cur", r6(F.col("ks")).alias("statistic"), r6(F.col("p_value")).alias("p_value"), (F.col("p_value") < 0.05).alias("drift"))


@query("wasserstein_1d", sql("SELECT feature, round(w, 6) AS distance FROM ecdf", "numeric", **{k: v for k, v in ecdf_steps("numeric").items() if k in ("vc", "cum", "ecdf")}))
def wasserstein_1d(spark, sf):
    return D.ecdf_distances(numeric_features(spark, sf), ["feature"]).select("feature", r6(F.col("wasserstein")).alias("distance"))


@query("energy_distance", sql("SELECT feature, round(greatest(en, 0), 6) AS distance FROM ecdf", "numeric", **{k: v for k, v in ecdf_steps("numeric").items() if k in ("vc", "cum", "ecdf")}))
def energy_distance(spark, sf):
    return D.ecdf_distances(numeric_features(spark, sf), ["feature"]).select("feature", r6(F.col("energy")).alias("distance"))


def emb_sides(spark, sf):
    return samples(spark, sf).withColumn("is_ref", F.col("image_id") % 2 == 0)


PAIR = "SELECT a.image_id % 2 = 0 AS ra, b.image_id % 2 = 0 AS rb, list_distance(a.embedding, b.embedding) AS d FROM samples a, samples b"


@query("energy_distance_nd", sql(
    "SELECT round(greatest(2 * avg(d) FILTER (WHERE ra AND NOT rb) - avg(d) FILTER (WHERE ra AND rb) - avg(d) FILTER (WHERE NOT ra AND NOT rb), 0), 6) AS energy FROM pr", "samples", pr=PAIR))
def energy_distance_nd(spark, sf):
    return D.energy_distance_nd(emb_sides(spark, sf), "image_id").select(r6(F.col("energy")).alias("energy"))


@query("mmd_linear", sql("SELECT round(sum((mr - mc) * (mr - mc)), 6) AS mmd FROM (SELECT pos, avg(x) FILTER (WHERE image_id % 2 = 0) AS mr, avg(x) FILTER (WHERE image_id % 2 = 1) AS mc FROM flat GROUP BY pos)", "flat"))
def mmd_linear(spark, sf):
    return D.mmd_linear(emb_sides(spark, sf)).select(r6(F.col("mmd")).alias("mmd"))


@query("mmd_rbf", sql(
    "SELECT round(greatest(avg(k) FILTER (WHERE ra AND rb) + avg(k) FILTER (WHERE NOT ra AND NOT rb) - 2 * avg(k) FILTER (WHERE ra AND NOT rb), 0), 6) AS mmd FROM (SELECT *, exp(-d * d / 64) AS k FROM pr)", "samples", pr=PAIR))
def mmd_rbf(spark, sf):
    return D.mmd_rbf(emb_sides(spark, sf), "image_id", 64).select(r6(F.col("mmd")).alias("mmd"))


@query("mmd_rbf_features")
def mmd_rbf_features(spark, sf):
    return D.mmd_rbf_features(emb_sides(spark, sf), 64).select(r6(F.col("mmd")).alias("mmd"))


@query("equal_width_hist", sql("SELECT feature, bin, round(r, 6) AS p_ref, round(c, 6) AS p_cur FROM sh", "numeric", **hist_steps("numeric")))
def equal_width_hist(spark, sf):
    h = D.histograms(numeric_features(spark, sf), ["feature"])
    return h.select("feature", F.posexplode(F.arrays_zip("p_ref", "p_cur")).alias("bin", "p")).select(
        "feature", "bin", r6(F.col("p.p_ref")).alias("p_ref"), r6(F.col("p.p_cur")).alias("p_cur")
    )


@query("psi", sql("SELECT feature, round(psi, 6) AS psi, psi > 0.2 AS drift FROM hd", "numeric", **hist_steps("numeric")))
def psi(spark, sf):
    return D.binned_distances(numeric_features(spark, sf), ["feature"]).select("feature", r6(F.col("psi")).alias("psi"), (F.col("psi") > 0.2).alias("drift"))


@query("js_divergence", sql("SELECT feature, round(js, 6) AS js FROM hd", "numeric", **hist_steps("numeric")))
def js_divergence(spark, sf):
    return D.binned_distances(numeric_features(spark, sf), ["feature"]).select("feature", r6(F.col("js")).alias("js"))


@query("chi_square_binned", sql(f"SELECT feature, round(chi2, 6) AS statistic, round({gamma_tail('chi2', '9')}, 6) AS p_value FROM hd", "numeric", **hist_steps("numeric")))
def chi_square_binned(spark, sf):
    return D.binned_distances(numeric_features(spark, sf), ["feature"]).select("feature", r6(F.col("chi2")).alias("statistic"), r6(F.col("chi2_p")).alias("p_value"))


@query("chi_square_binned_counts", sql(f"SELECT feature, round(chi2 * tc, 6) AS statistic, round({gamma_tail('(chi2 * tc)', '9')}, 6) AS p_value FROM hd", "numeric", **hist_steps("numeric")))
def chi_square_binned_counts(spark, sf):
    return D.binned_distances(numeric_features(spark, sf), ["feature"], scale="count").select("feature", r6(F.col("chi2")).alias("statistic"), r6(F.col("chi2_p")).alias("p_value"))


LABELS = {
    "lc": "SELECT label, count(*) FILTER (WHERE is_ref) AS n_ref, count(*) FILTER (WHERE NOT is_ref) AS n_cur FROM ev_labels GROUP BY 1",
    "le": "SELECT *, n_ref * (sum(n_cur) OVER ()) / (sum(n_ref) OVER ()) AS e FROM lc",
    "ls": "SELECT sum((n_cur - e) * (n_cur - e) / e) AS s, count(*) AS k, CAST(sum(n_ref) AS BIGINT) AS n_ref, CAST(sum(n_cur) AS BIGINT) AS n_cur FROM le",
    "lp": f"SELECT *, {gamma_tail('s', '(k - 1)')} AS p FROM ls",
}


@query("baseline_vs_current", sql("SELECT label, n_ref, n_cur FROM lc", "ev_labels", lc=LABELS["lc"]))
def baseline_vs_current(spark, sf):
    return D.align_counts(event_labels(spark, sf))


@query("label_union", "SELECT DISTINCT label FROM (SELECT event_type AS label FROM events UNION SELECT o_orderpriority FROM orders)")
def label_union(spark, sf):
    left = event_labels(spark, sf).select("label")
    return left.union(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("label"))).distinct()


@query("label_drift_chi2", sql("SELECT n_ref, n_cur, k AS labels, round(s, 6) AS statistic, round(p, 6) AS p_value, round(1 - p, 6) AS drift_score, p < 0.05 AS has_drift FROM lp", "ev_labels", **LABELS))
def label_drift_chi2(spark, sf):
    out = D.label_drift(event_labels(spark, sf))
    return out.select("n_ref", "n_cur", "labels", *[r6(F.col(c)).alias(c) for c in ["statistic", "p_value", "drift_score"]], "has_drift")


@query("feature_drift", sql("SELECT feature, n_ref, n_cur, round(ks, 6) AS statistic, round(p, 6) + 0.0 AS p_value, round(1 - p, 6) AS drift_score, p < 0.05 AS has_drift FROM ksp", "numeric", **ecdf_steps("numeric")))
def feature_drift(spark, sf):
    out = D.feature_drift(numeric_features(spark, sf))
    return out.select("feature", "n_ref", "n_cur", *[r6(F.col(c)).alias(c) for c in ["statistic", "p_value", "drift_score"]], "has_drift")


@query("feature_drift_wasserstein", sql(
    "SELECT feature, round(w, 6) AS statistic, round(least(1, w / greatest(rng, 1e-10)), 6) AS drift_score, w / greatest(rng, 1e-10) > 0.05 AS has_drift FROM ecdf JOIN (SELECT feature, max(value) - min(value) AS rng FROM numeric WHERE is_ref GROUP BY 1) USING (feature)",
    "numeric", **{k: v for k, v in ecdf_steps("numeric").items() if k in ("vc", "cum", "ecdf")}))
def feature_drift_wasserstein(spark, sf):
    out = D.feature_drift(numeric_features(spark, sf), "wasserstein")
    return out.select("feature", r6(F.col("statistic")).alias("statistic"), r6(F.col("drift_score")).alias("drift_score"), "has_drift")


@query("feature_drift_chi_square", sql(
    f"SELECT feature, n_ref, n_cur, round(s, 4) AS statistic, round({gamma_tail('s', '(k - 1)')}, 6) AS p_value FROM cs",
    "numeric",
    cats="SELECT feature, value, count(*) FILTER (WHERE is_ref) AS cr, count(*) FILTER (WHERE NOT is_ref) AS cc FROM numeric GROUP BY 1, 2",
    ce="SELECT *, cr * (sum(cc) OVER (PARTITION BY feature)) / (sum(cr) OVER (PARTITION BY feature)) AS e FROM cats",
    cs="SELECT feature, CAST(sum(cr) AS BIGINT) AS n_ref, CAST(sum(cc) AS BIGINT) AS n_cur, sum(CASE WHEN e > 0 THEN (cc - e) * (cc - e) / e WHEN cc > 0 THEN 'inf'::DOUBLE ELSE 0 END) AS s, count(*) AS k FROM ce GROUP BY 1"))
def feature_drift_chi_square(spark, sf):
    out = D.feature_drift(numeric_features(spark, sf), "chi_square")
    return out.select("feature", "n_ref", "n_cur", F.round("statistic", 4).alias("statistic"), r6(F.col("p_value")).alias("p_value"))


@query("overall_feature_drift", sql(
    "SELECT round(avg(1 - p), 6) AS feature_score, count(*) AS features, count(*) FILTER (WHERE p < 0.05) AS drifted, CASE WHEN avg(1 - p) < 0.1 THEN 'none' WHEN avg(1 - p) < 0.3 THEN 'low' WHEN avg(1 - p) < 0.5 THEN 'medium' WHEN avg(1 - p) < 0.7 THEN 'high' ELSE 'critical' END AS feature_level FROM ksp",
    "numeric", **ecdf_steps("numeric")))
def overall_feature_drift(spark, sf):
    out = D.overall_feature_drift(D.feature_drift(numeric_features(spark, sf)))
    return out.withColumn("feature_score", r6(F.col("feature_score")))


@query("ks_test_exact", sql(
    "SELECT feature AS user_id, n_ref, n_cur, round(coalesce(ks, 0), 6) + 0.0 AS statistic, round(coalesce(least(gone, 1.0), 1.0), 6) + 0.0 AS p_value FROM ecdf LEFT JOIN tails ON n = n_ref AND m = n_cur AND h = CAST(round(ks * n_ref * n_cur) AS BIGINT)",
    users=LATTICE["users"], **{k: v for k, v in ecdf_steps("users").items() if k in ("vc", "cum", "ecdf")}, **{k: LATTICE[k] for k in ("sizes", "paths", "tails")}))
def ks_test_exact(spark, sf):
    events = table(spark, sf, "events").select(F.col("user_id").alias("feature"), "value", (F.col("ts") < ntz("2024-01-16")).alias("is_ref"))
    out = D.with_exact_p(D.ecdf_distances(events, ["feature"]))
    return out.select(F.col("feature").alias("user_id"), "n_ref", "n_cur", r6(F.col("ks")).alias("statistic"), r6(F.col("p_value")).alias("p_value"))


DETECT = (
    "SELECT 'ks_test' AS method, ks AS statistic, p AS p_value, p < 0.05 AS drift_detected, CASE WHEN p > 0.1 THEN 'none' WHEN p > 0.05 THEN 'low' WHEN p > 0.01 THEN 'medium' WHEN p > 0.001 THEN 'high' ELSE 'critical' END AS severity, ks AS score, n_cur AS window_size FROM ksp UNION ALL "
    "SELECT 'wasserstein', w, NULL, w > 0.1, CASE WHEN w < 0.05 THEN 'none' WHEN w < 0.1 THEN 'low' WHEN w < 0.2 THEN 'medium' WHEN w < 0.5 THEN 'high' ELSE 'critical' END, least(w / 0.1, 1.0), n_cur FROM ksp UNION ALL "
    "SELECT 'psi', psi, NULL, psi > 0.2, CASE WHEN psi < 0.1 THEN 'none' WHEN psi < 0.2 THEN 'low' WHEN psi < 0.3 THEN 'medium' WHEN psi < 0.5 THEN 'high' ELSE 'critical' END, least(psi / 0.2, 1.0), n_cur FROM hd, ksp"
)


@query("detect_drift", sql(
    "SELECT method, round(statistic, 6) AS statistic, round(p_value, 6) + 0.0 AS p_value, drift_detected, severity, round(score, 6) AS score, window_size FROM det",
    "ev", **ecdf_steps("ev"), **hist_steps("ev"), det=DETECT))
def detect_drift(spark, sf):
    out = D.detect_drift(event_values(spark, sf))
    return out.select("method", r6(F.col("statistic")).alias("statistic"), r6(F.col("p_value")).alias("p_value"), "drift_detected", "severity", r6(F.col("score")).alias("score"), "window_size")


RUN = "SELECT fs, ls, (fs + ls) / 2 AS os, nf FROM (SELECT avg(1 - p) AS fs, count(*) AS nf FROM ksp), (SELECT 1 - p AS ls FROM lp)"
LEVEL = "CASE WHEN os > 0.7 THEN 'critical' WHEN os > 0.5 THEN 'high' WHEN os > 0.3 THEN 'medium' WHEN os > 0.1 THEN 'low' ELSE 'none' END"


@query("run_detection", sql(
    f"SELECT round(fs, 6) AS feature_score, round(ls, 6) AS label_score, round(os, 6) AS overall_score, {LEVEL} AS drift_level, nf AS features, CASE WHEN os > 0.5 THEN CASE WHEN fs > ls THEN 'feature' ELSE 'label' END END AS alert_type FROM run",
    "numeric", "ev_labels", **ecdf_steps("numeric"), **LABELS, run=RUN))
def run_detection(spark, sf):
    out = D.run_detection(numeric_features(spark, sf), event_labels(spark, sf))
    return out.select(*[r6(F.col(c)).alias(c) for c in ["feature_score", "label_score", "overall_score"]], "drift_level", "features", "alert_type")


@query("baseline_snapshot", sql(
    "SELECT 'feature' AS kind, feature AS name, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max, count(*) AS n FROM numeric WHERE is_ref GROUP BY feature "
    "UNION ALL SELECT 'label', label, NULL, NULL, NULL, NULL, count(*) FROM ev_labels WHERE is_ref GROUP BY label", "numeric", "ev_labels"))
def baseline_snapshot(spark, sf):
    out = D.baseline_snapshot(numeric_features(spark, sf).filter("is_ref"), event_labels(spark, sf).filter("is_ref"))
    return out.withColumns({"mean": r6(F.col("mean")), "std": r6(F.col("std"))})


@query("baseline_window", (
    "WITH w AS (SELECT event_id // 5 AS task_id, min(ts) AS t FROM events GROUP BY 1), s AS (SELECT task_id, t < TIMESTAMP '2024-01-13' AS is_ref FROM w WHERE t BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-12 23:59:59' OR t BETWEEN TIMESTAMP '2024-01-20' AND TIMESTAMP '2024-01-30 23:59:59') "
    "SELECT is_ref, event_type AS label, count(*) AS n, count(DISTINCT task_id) AS tasks FROM events JOIN s ON s.task_id = event_id // 5 WHERE user_id % 20 <> 0 GROUP BY 1, 2"))
def baseline_window(spark, sf):
    from curadrift.sources.tables import annotations
    notes = annotations(spark, sf).withColumn("was_cancelled", F.col("annotator_id").isNull())
    users = table(spark, sf, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 20 == 0).alias("was_cancelled"))
    notes = notes.drop("was_cancelled").join(users, "id")
    task_times = notes.groupBy("task_id").agg(F.min("created_at").alias("at"))
    sides = D.window_sides(
        task_times, "at", ntz("2024-01-03"), ntz("2024-01-12 23:59:59"), ntz("2024-01-20"), ntz("2024-01-30 23:59:59")
    )
    joined = notes.filter("NOT was_cancelled").join(sides.select("task_id", "is_ref"), "task_id")
    return joined.groupBy("is_ref", "label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("task_id").alias("tasks"))


def weekly_psi(spark, sf):
    """Drift of each event type between the two halves, as detection rows."""
    ev = table(spark, sf, "events").select(
        F.col("event_type").alias("feature"), "value", (F.col("ts") < ntz("2024-01-16 00:00:00")).alias("is_ref")
    )
    from curadrift.functions import rules as R
    out = D.ecdf_distances(ev, ["feature"])
    w = F.col("wasserstein")
    return out.select(
        "feature", F.lit("wasserstein").alias("method"), (w > 0.1).alias("drift_detected"),
        R.severity_from_distance(w).alias("severity"), F.least(w / 0.1, F.lit(1.0)).alias("score"),
    )


TYPED = "SELECT event_type AS feature, value, ts < TIMESTAMP '2024-01-16' AS is_ref FROM events"
ALERTS = {
    **{k: v for k, v in ecdf_steps("tv").items() if k in ("vc", "cum", "ecdf")},
    "al": "SELECT 'drift_' || row_number() OVER (ORDER BY feature) AS alert_id, feature, CASE WHEN w < 0.5 THEN 'high' ELSE 'critical' END AS severity, 'Drift detected using wasserstein: score=' || format('{:.3f}', least(w / 0.1, 1.0)) AS message FROM ecdf WHERE w >= 0.2",
}


@query("drift_alerts", sql("SELECT alert_id, feature, severity, message, 'active' AS status, false AS acknowledged FROM al", tv=TYPED, **ALERTS))
def drift_alerts(spark, sf):
    return D.drift_alerts(weekly_psi(spark, sf), ["feature"]).drop("acknowledged_at", "resolved_at")


@query("drift_alert_updates", sql(
    "SELECT alert_id, feature, CASE WHEN feature < 'd' THEN 'resolved' WHEN feature < 'q' THEN 'acknowledged' ELSE 'active' END AS status, feature < 'q' AS acknowledged, "
    "CASE WHEN feature < 'q' THEN TIMESTAMP '2024-02-01' END AS acknowledged_at, CASE WHEN feature < 'd' THEN TIMESTAMP '2024-02-02' END AS resolved_at FROM al WHERE severity IN ('high', 'critical')", tv=TYPED, **ALERTS))
def drift_alert_updates(spark, sf):
    alerts = D.drift_alerts(weekly_psi(spark, sf), ["feature"])
    acks = alerts.filter("feature < 'q'").select("alert_id", F.lit("acknowledge").alias("action"), ntz("2024-02-01").alias("at"))
    resolved = alerts.filter("feature < 'd'").select("alert_id", F.lit("resolve").alias("action"), ntz("2024-02-02").alias("at"))
    updated = D.apply_alert_updates(alerts, acks.unionByName(resolved))
    hot = D.filter_alerts(updated, severity="high").unionByName(D.filter_alerts(updated, severity="critical"))
    return hot.select("alert_id", "feature", "status", "acknowledged", "acknowledged_at", "resolved_at")

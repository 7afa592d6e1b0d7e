"""Distribution drift of numeric features and labels between a reference and a current side.

Inputs are long tables: group columns (for example ``feature``), ``value`` and the flag ``is_ref``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from curadrift.functions import rules as R, vectors as V
from curadrift.functions.numbers import chi2_sf, kolmogorov_p
from curadrift.operators.blocks import pair_sums
from curadrift.operators.ordered import ranged, running
from curadrift.session import small_side

BINS = 10


def is_number(column: str) -> Column:
    """Neither NULL nor NaN: a NaN has no place in an order."""
    return F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))


def ecdf_distances(df: DataFrame, groups: list[str]) -> DataFrame:
    """Per group n_ref, n_cur, ks, p_value, wasserstein, energy and the reference range.

    Rows collapse to one per distinct value before anything is ordered, so a value holding a third
    of the data is one row; running counts then come from range-partitioned parts.
    """
    counts = df.filter(is_number("value")).groupBy(*groups, "value").agg(
        F.count_if("is_ref").alias("c_ref"), F.count_if(~F.col("is_ref")).alias("c_cur")
    )
    cumulated = running(
        ranged(counts, groups, ["value"]), groups, ["value"],
        sums={"ref": F.col("c_ref"), "cur": F.col("c_cur")}, next_of="value",
    )
    gap = F.try_divide("ref", "total_ref") - F.try_divide("cur", "total_cur")
    width = F.coalesce(F.col("next_value") - F.col("value"), F.lit(0.0))
    per_group = cumulated.withColumn("gap", gap).withColumn("width", width).groupBy(*groups).agg(
        F.max("total_ref").alias("n_ref"), F.max("total_cur").alias("n_cur"),
        F.min(F.when(F.col("c_ref") > 0, F.col("value"))).alias("ref_min"),
        F.max(F.when(F.col("c_ref") > 0, F.col("value"))).alias("ref_max"),
        F.coalesce(F.max(F.abs("gap")), F.lit(0.0)).alias("ks"),
        F.coalesce(F.sum(F.abs("gap") * F.col("width")), F.lit(0.0)).alias("wasserstein"),
        F.coalesce(2 * F.sum(F.col("gap") * F.col("gap") * F.col("width")), F.lit(0.0)).alias("energy"),
    )
    both = (F.col("n_ref") > 0) & (F.col("n_cur") > 0)
    p = F.when(both, kolmogorov_p(F.col("ks"), F.col("n_ref"), F.greatest("n_cur", F.lit(1)))).otherwise(1.0)
    return per_group.withColumn("p_value", p)


# Samples above this size keep the limit law; the exact tail takes n * m steps.
EXACT_ROWS = 10_000


def exact_ks_tail(n: int, m: int, steps: int) -> float:
    """P(D >= steps / (n * m)) of the two-sample statistic over all orders of n and m distinct values.

    Orders are lattice paths from (0, 0) to (n, m). All paths advance together by one diagonal; what reaches the distance leaves and is summed,
    so small tails keep their digits.
    """
    if steps <= 0:
        return 1.0
    n, m = min(n, m), max(n, m)
    i, inside, tail = np.arange(n + 1), np.zeros(n + 1), 0.0
    inside[0] = 1.0
    for taken in range(n + m):
        left = n + m - taken
        ahead = inside * (m - (taken - i)) / left
        ahead[1:] += inside[:-1] * (n - i[:-1]) / left
        out = np.abs(i * m - (taken + 1 - i) * n) >= steps
        tail += ahead[out].sum()
        inside = np.where(out, 0.0, ahead)
    return min(1.0, float(tail))


def with_exact_p(ecdf: DataFrame, largest: int = EXACT_ROWS) -> DataFrame:
    """``ecdf_distances`` with the exact ``p_value`` where neither sample has more than ``largest`` rows; ties count as in the statistic.

    Groups with an empty sample keep 1. Each distinct (n, m, distance) of an Arrow batch is counted once.
    """
    @F.pandas_udf("double")
    def tails(n: pd.Series, m: pd.Series, steps: pd.Series) -> pd.Series:
        asked = list(zip(n, m, steps))
        known = {key: exact_ks_tail(*map(int, key)) if key[2] >= 0 else float("nan") for key in set(asked)}
        return pd.Series([known[key] for key in asked], dtype="float64")

    n, m = F.col("n_ref").cast("long"), F.col("n_cur").cast("long")
    small = (n > 0) & (m > 0) & (n <= largest) & (m <= largest)
    steps = F.when(small, F.round(F.col("ks") * n * m).cast("long")).otherwise(-1)
    exact = tails(F.coalesce(n, F.lit(0)), F.coalesce(m, F.lit(0)), F.coalesce(steps, F.lit(-1)))
    return ecdf.withColumn("exact", exact).withColumn("p_value", F.when(small, F.col("exact")).otherwise(F.col("p_value"))).drop("exact")


def histograms(df: DataFrame, groups: list[str], bins: int = BINS) -> DataFrame:
    """Per group ``p_ref`` and ``p_cur``: shares per equal-width bin of the joint range, +1 smoothed."""
    kept = df.filter(is_number("value"))
    edges = kept.groupBy(*groups).agg(
        F.min("value").alias("low"), ((F.max("value") - F.min("value")) / bins).alias("width")
    )
    if groups:
        placed = kept.join(small_side(edges), groups)
    else:
        placed = kept.withColumn("edge", edges.select(F.struct("low", "width")).scalar()).select("*", "edge.*")
    bin_no = F.when(F.col("width") == 0, bins - 1).otherwise(
        F.least(F.floor((F.col("value") - F.col("low")) / F.nullif("width", F.lit(0.0))), F.lit(bins - 1))
    )
    counts = placed.groupBy(*groups, bin_no.cast("int").alias("bin")).agg(
        F.count_if("is_ref").alias("c_ref"), F.count_if(~F.col("is_ref")).alias("c_cur")
    )
    # at most ``bins`` rows per group from here on
    maps = counts.groupBy(*groups).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "c_ref"))).alias("m_ref"),
        F.map_from_entries(F.collect_list(F.struct("bin", "c_cur"))).alias("m_cur"),
        F.sum("c_ref").alias("n_ref"), F.sum("c_cur").alias("n_cur"),
    )

    def shares(counted: str, size: str):
        all_bins = F.sequence(F.lit(0), F.lit(bins - 1))
        return F.transform(
            all_bins, lambda b: (F.coalesce(F.try_element_at(F.col(counted), b), F.lit(0)) + 1.0) / (F.col(size) + bins)
        )

    return maps.select(*groups, "n_ref", "n_cur", shares("m_ref", "n_ref").alias("p_ref"), shares("m_cur", "n_cur").alias("p_cur"))


def binned_distances(df: DataFrame, groups: list[str], bins: int = BINS, scale: str = "proportion") -> DataFrame:
    """Per group psi, js (nats), chi2 and its p-value over smoothed bins.

    ``scale='proportion'`` compares shares, ``'count'`` multiplies by the current row count.
    """
    h = histograms(df, groups, bins)
    ref, cur = F.col("p_ref"), F.col("p_cur")
    psi = V.total(F.zip_with(ref, cur, lambda r, c: (c - r) * F.log(c / r)))
    js = 0.5 * V.total(F.zip_with(ref, cur, lambda r, c: r * F.log(2 * r / (r + c)) + c * F.log(2 * c / (r + c))))
    chi2 = V.total(F.zip_with(ref, cur, lambda r, c: (c - r) * (c - r) / r))
    if scale == "count":
        chi2 = chi2 * (F.col("n_cur") + bins)
    empty = (F.col("n_ref") == 0) | (F.col("n_cur") == 0)

    def unless_empty(c, value):
        return F.when(empty, value).otherwise(c)

    out = h.select(
        *groups, "n_ref", "n_cur", unless_empty(psi, 0.0).alias("psi"), unless_empty(js, 0.0).alias("js"),
        unless_empty(chi2, 0.0).alias("chi2"),
    )
    return out.withColumn("chi2_p", chi2_sf(F.col("chi2"), F.lit(bins - 1)))


def align_counts(df: DataFrame, key: str = "label") -> DataFrame:
    """Count of each key on either side, 0 where it is missing (a full outer join by one aggregate)."""
    return df.groupBy(key).agg(
        F.count_if("is_ref").alias("n_ref"), F.count_if(~F.col("is_ref")).alias("n_cur")
    )


def label_drift(df: DataFrame, threshold: float = 0.05) -> DataFrame:
    """One row: chi-square goodness of fit of current label counts against the scaled reference."""
    counts = align_counts(df)
    totals = counts.agg(F.sum("n_ref").alias("t_ref"), F.sum("n_cur").alias("t_cur"), F.count(F.lit(1)).alias("labels"))
    scaled = counts.withColumn("t", totals.select(F.struct("*")).scalar()).select("*", "t.*")
    expected = F.col("n_ref") * F.try_divide("t_cur", "t_ref")
    # an unseen label with observations has no finite statistic
    unseen = (F.col("n_ref") == 0) & (F.col("n_cur") > 0)
    part = F.when(unseen, F.lit(float("inf"))).otherwise(
        F.coalesce(F.try_divide((F.col("n_cur") - expected) * (F.col("n_cur") - expected), expected), F.lit(0.0))
    )
    one = scaled.agg(
        F.sum(part).alias("statistic"), F.count(F.lit(1)).alias("labels"),
        F.max("t_ref").alias("n_ref"), F.max("t_cur").alias("n_cur"),
    )
    comparable = (F.col("n_ref") > 0) & (F.col("n_cur") > 0)
    p = F.when(comparable, chi2_sf(F.col("statistic"), F.col("labels") - 1))
    return one.select(
        "n_ref", "n_cur", "labels", F.when(comparable, F.col("statistic")).otherwise(0.0).alias("statistic"),
        F.coalesce(p, F.lit(1.0)).alias("p_value"),
        F.when(comparable, R.score_from_p(p)).otherwise(0.0).alias("drift_score"),
        F.coalesce(p < threshold, F.lit(False)).alias("has_drift"),
    )


def feature_drift(df: DataFrame, method: str = "ks_test", threshold: float = 0.05) -> DataFrame:
    """Per feature statistic, p-value, score and flag; features missing on one side are left out."""
    if method == "chi_square":
        return category_drift(df, threshold)
    both = ecdf_distances(df, ["feature"]).filter((F.col("n_ref") > 0) & (F.col("n_cur") > 0))
    if method == "ks_test":
        score, p, statistic = R.score_from_p(F.col("p_value")), F.col("p_value"), F.col("ks")
        flag = p < threshold
    elif method == "wasserstein":
        span = F.greatest(F.col("ref_max") - F.col("ref_min"), F.lit(1e-10))
        normalized = F.col("wasserstein") / span
        score, p, statistic = F.least(F.lit(1.0), normalized), F.lit(None).cast("double"), F.col("wasserstein")
        flag = normalized > threshold
    else:
        raise ValueError(f"unknown method {method}")
    return both.select(
        "feature", "n_ref", "n_cur", statistic.alias("statistic"), p.alias("p_value"),
        score.alias("drift_score"), flag.alias("has_drift"),
    )


def category_drift(df: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Chi-square per feature with each distinct value as a category."""
    counts = df.groupBy("feature", "value").agg(
        F.count_if("is_ref").alias("c_ref"), F.count_if(~F.col("is_ref")).alias("c_cur")
    )
    totals = small_side(counts.groupBy("feature").agg(F.sum("c_ref").alias("n_ref"), F.sum("c_cur").alias("n_cur")))
    expected = F.col("c_ref") * F.try_divide("n_cur", "n_ref")
    part = F.when((F.col("c_ref") == 0) & (F.col("c_cur") > 0), F.lit(float("inf"))).otherwise(
        F.coalesce(F.try_divide((F.col("c_cur") - expected) * (F.col("c_cur") - expected), expected), F.lit(0.0))
    )
    per = counts.join(totals, "feature").groupBy("feature").agg(
        F.max("n_ref").alias("n_ref"), F.max("n_cur").alias("n_cur"), F.sum(part).alias("statistic"),
        F.count(F.lit(1)).alias("categories"),
    ).filter((F.col("n_ref") > 0) & (F.col("n_cur") > 0))
    p = chi2_sf(F.col("statistic"), F.col("categories") - 1)
    return per.withColumn("p_value", p).select(
        "feature", "n_ref", "n_cur", "statistic", "p_value", R.score_from_p(F.col("p_value")).alias("drift_score"),
        (F.col("p_value") < threshold).alias("has_drift"),
    )


def overall_feature_drift(per_feature: DataFrame) -> DataFrame:
    """One row: mean score and its level; no feature gives 0 and none."""
    return per_feature.agg(
        F.coalesce(F.avg("drift_score"), F.lit(0.0)).alias("feature_score"), F.count(F.lit(1)).alias("features"),
        F.count_if("has_drift").alias("drifted"),
    ).withColumn("feature_level", R.feature_drift_level(F.col("feature_score")))


def detect_drift(df: DataFrame, significance: float = 0.05, threshold: float = 0.1, bins: int = BINS) -> DataFrame:
    """Rows ks_test, wasserstein and psi for one series: statistic, p, flag, severity, score."""
    ecdf = ecdf_distances(df, []).select("ks", "p_value", "wasserstein", "n_cur")
    binned = binned_distances(df, [], bins).select("psi")
    one = ecdf.withColumn("psi", binned.scalar())
    none = F.lit(None).cast("double")

    def row(name, statistic, p, flag, severity, score):
        return F.struct(
            F.lit(name).alias("method"), statistic.alias("statistic"), p.alias("p_value"), flag.alias("drift_detected"),
            severity.alias("severity"), score.alias("score"), F.col("n_cur").alias("window_size"),
        )

    ks, p, w, psi = (F.col(c) for c in ["ks", "p_value", "wasserstein", "psi"])
    rows = F.array(
        row("ks_test", ks, p, p < significance, R.severity_from_p(p), ks),
        row("wasserstein", w, none, w > threshold, R.severity_from_distance(w), F.least(w / threshold, F.lit(1.0))),
        row("psi", psi, none, psi > 0.2, R.severity_from_psi(psi), F.least(psi / 0.2, F.lit(1.0))),
    )
    return one.select(F.explode(rows).alias("r")).select("r.*")


def drift_alerts(results: DataFrame, key: list[str]) -> DataFrame:
    """Alert rows for detected drift of severity high or critical; ids follow the key order."""
    from curadrift.operators.ordered import indexed

    hot = results.filter("drift_detected").filter(F.col("severity").isin("high", "critical"))
    numbered = indexed(hot, [], key)
    return numbered.select(
        F.format_string("drift_%d", "idx").alias("alert_id"), *key, "severity",
        F.concat(F.lit("Drift detected using "), F.col("method"), F.lit(": score="), F.format_string("%.3f", F.col("score"))).alias("message"),
        F.lit("active").alias("status"), F.lit(False).alias("acknowledged"),
        F.lit(None).cast("timestamp_ntz").alias("acknowledged_at"), F.lit(None).cast("timestamp_ntz").alias("resolved_at"),
    )


def filter_alerts(alerts: DataFrame, severity: str | None = None, status: str | None = None, acknowledged: bool | None = None) -> DataFrame:
    if severity is not None:
        alerts = alerts.filter(F.col("severity") == severity)
    if status is not None:
        alerts = alerts.filter(F.col("status") == status)
    if acknowledged is not None:
        alerts = alerts.filter(F.col("acknowledged") == F.lit(acknowledged))
    return alerts


def apply_alert_updates(alerts: DataFrame, updates: DataFrame) -> DataFrame:
    """updates: alert_id, action (acknowledge / resolve), at; the latest of each action wins."""
    latest = updates.groupBy("alert_id").agg(
        F.max(F.when(F.col("action") == "acknowledge", F.col("at"))).alias("ack_at"),
        F.max(F.when(F.col("action") == "resolve", F.col("at"))).alias("res_at"),
    )
    joined = alerts.join(latest, "alert_id", "left")
    return joined.withColumns({
        "acknowledged": F.col("acknowledged") | F.col("ack_at").isNotNull(),
        "acknowledged_at": F.coalesce("ack_at", "acknowledged_at"),
        "resolved_at": F.coalesce("res_at", "resolved_at"),
        "status": F.when(F.col("res_at").isNotNull(), "resolved")
        .when(F.col("ack_at").isNotNull(), "acknowledged").otherwise(F.col("status")),
    }).drop("ack_at", "res_at")


def baseline_snapshot(features: DataFrame, labels: DataFrame) -> DataFrame:
    """kind, name and mean / std / min / max / n: one row per feature and one per label."""
    none = F.lit(None).cast("double")
    f = features.groupBy(F.lit("feature").alias("kind"), F.col("feature").alias("name")).agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"), F.count("value").alias("n"),
    )
    counted = labels.groupBy(F.lit("label").alias("kind"), F.col("label").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return f.unionByName(counted.select("kind", "name", none.alias("mean"), none.alias("std"), none.alias("min"), none.alias("max"), "n"))


def run_detection(features: DataFrame, labels: DataFrame, method: str = "ks_test") -> DataFrame:
    """One report row: feature score, label score, their mean, level, and the alert type if any."""
    f = overall_feature_drift(feature_drift(features, method))
    label = label_drift(labels).select("drift_score").scalar()
    report = f.withColumn("label_score", label).withColumn("overall_score", (F.col("feature_score") + F.col("label_score")) / 2)
    report = report.withColumn("drift_level", R.overall_drift_level(F.col("overall_score")))
    alert = F.when(
        F.col("drift_level").isin("high", "critical"),
        F.when(F.col("feature_score") > F.col("label_score"), "feature").otherwise("label"),
    )
    return report.select("feature_score", "label_score", "overall_score", "drift_level", "features", alert.alias("alert_type"))


def window_sides(
    df: DataFrame, at: str, ref_start, ref_end, cur_start, cur_end
) -> DataFrame:
    """Keep rows of the reference or current window and flag the side."""
    t = F.col(at)
    ref = t.between(ref_start, ref_end)
    cur = t.between(cur_start, cur_end)
    return df.filter(ref | cur).withColumn("is_ref", ref)


def mmd_linear(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Squared distance of the side means, at least 0; one pass, two vectors meet."""
    means = df.groupBy("is_ref").agg(V.vector_mean(F.col(vector)).alias("mu"))
    both = means.agg(F.max_by("mu", "is_ref").alias("a"), F.min_by("mu", "is_ref").alias("b"), F.count(F.lit(1)).alias("sides"))
    return both.select(F.when(F.col("sides") < 2, 0.0).otherwise(V.sq_distance(F.col("a"), F.col("b"))).alias("mmd"))


def _sides(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame, int, int]:
    rows = df.select(F.col(key).alias("id"), F.col(vector).alias("v"), "is_ref")
    sizes = {r["is_ref"]: r["n"] for r in rows.groupBy("is_ref").agg(F.count(F.lit(1)).alias("n")).collect()}
    return rows.filter("is_ref").drop("is_ref"), rows.filter("NOT is_ref").drop("is_ref"), sizes.get(True, 0), sizes.get(False, 0)


def _three_means(df: DataFrame, key: str, vector: str, function: str, scale: float) -> DataFrame:
    """One row rr, cc, rc: mean kernel value within and across the sides (NULL on an empty side)."""
    ref, cur, n, m = _sides(df, key, vector)
    within_ref = pair_sums(ref, ref, n, n, function, scale)
    within_cur = pair_sums(cur, cur, m, m, function, scale)
    across = pair_sums(ref, cur, n, m, function, scale)
    return across.select(
        (F.col("s") / F.nullif(F.lit(n * m), F.lit(0))).alias("rc"),
        (within_ref.scalar() / F.nullif(F.lit(n * n), F.lit(0))).alias("rr"),
        (within_cur.scalar() / F.nullif(F.lit(m * m), F.lit(0))).alias("cc"),
    )


def mmd_rbf(df: DataFrame, key: str, dim: int, vector: str = "embedding") -> DataFrame:
    """mean K_rr + mean K_cc - 2 mean K_rc with K = exp(-|x-y|^2 / dim); exact, quadratic work in blocks."""
    m = _three_means(df, key, vector, "rbf", float(dim))
    return m.select(F.coalesce(F.greatest(F.col("rr") + F.col("cc") - 2 * F.col("rc"), F.lit(0.0)), F.lit(0.0)).alias("mmd"))


def mmd_rbf_features(df: DataFrame, dim: int, n_features: int = 256, seed: int = 7, vector: str = "embedding") -> DataFrame:
    """Approximate ``mmd_rbf`` in linear work: random Fourier features, then the distance of side means."""
    rng = np.random.default_rng(seed)
    weights = rng.normal(scale=np.sqrt(2.0 / dim), size=(n_features, dim))
    shift = rng.uniform(0, 2 * np.pi, n_features)

    def project(batches):
        import pandas as pd

        for frame in batches:
            if len(frame):
                z = np.sqrt(2.0 / n_features) * np.cos(np.stack(frame[vector].to_numpy()) @ weights.T + shift)
                yield pd.DataFrame({"is_ref": frame["is_ref"], "z": list(z)})

    return mmd_linear(df.select("is_ref", vector).mapInPandas(project, "is_ref boolean, z array<double>"), "z")


def energy_distance_nd(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """2 E|X-Y| - E|X-X'| - E|Y-Y'|, at least 0; exact, quadratic work in blocks."""
    m = _three_means(df, key, vector, "distance", 1.0)
    return m.select(F.coalesce(F.greatest(2 * F.col("rc") - F.col("rr") - F.col("cc"), F.lit(0.0)), F.lit(0.0)).alias("energy"))

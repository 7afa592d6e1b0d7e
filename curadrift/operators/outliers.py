"""Embedding slices: contract, centroid, outliers, paired measures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from curadrift.functions import vectors as V
from curadrift.functions.numbers import r6
from curadrift.session import checkpointed


def split_by_contract(df: DataFrame, dim: int, vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Rows with a full vector, and the quarantined rest with the reason."""
    ok = (F.size(vector) == dim) & ~F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x))
    good = F.coalesce(ok, F.lit(False))
    reason = (
        F.when(F.col(vector).isNull(), "no vector")
        .when(F.size(vector) != dim, F.concat(F.lit("length "), F.size(vector).cast("string")))
        .otherwise("value missing")
    )
    return df.filter(good), df.filter(~good).withColumn("reason", reason)


def slice_check(df: DataFrame, declared_count: int) -> DataFrame:
    """One row: is the slice non-empty and as long as declared?"""
    return df.agg(F.count(F.lit(1)).alias("n")).select(
        "n", F.lit(declared_count).alias("declared"),
        ((F.col("n") > 0) & (F.col("n") == declared_count)).alias("valid"),
    )


def centroid(df: DataFrame, vector: str = "embedding", by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(V.vector_mean(F.col(vector)).alias("centroid"))


def centroid_distances(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Add ``distance`` to the centroid of all rows: two scans, one vector (the centroid) in between."""
    centre = centroid(df, vector).first()["centroid"] or []
    return df.withColumn("distance", V.distance_to(F.col(vector), centre))


def distance_summary(distances: DataFrame, sigma: float = 2.0) -> DataFrame:
    return distances.agg(
        F.avg("distance").alias("mean_distance"),
        (F.avg("distance") + sigma * F.stddev_pop("distance")).alias("threshold"),
        F.count(F.lit(1)).alias("n"),
    )


def centroid_distance_outliers(
    df: DataFrame, sigma: float = 2.0, min_drift: int = 2, max_drift: int | None = 3
) -> DataFrame:
    """Rows farther than mean + sigma*std, at least ``min_drift`` and at most ``max_drift`` of them.

    ``max_drift=None`` keeps every row above the threshold.
    """
    # the vectors are read twice (mean, distances); all that follows works on one number per row
    distances = checkpointed(centroid_distances(df).select("image_id", "label", "distance"))
    summary = distance_summary(distances, sigma)
    limits = distances.withColumn("limits", summary.select(F.struct("mean_distance", "threshold")).scalar())
    if max_drift is None:
        top = distances.orderBy(F.desc("distance"), "image_id").limit(min_drift).select("image_id").withColumn("forced", F.lit(True))
        chosen = limits.join(F.broadcast(top), "image_id", "left").filter(
            (F.col("distance") > F.col("limits.threshold")) | F.col("forced")
        )
    else:
        far = limits.orderBy(F.desc("distance"), "image_id").limit(max_drift)
        ranked = far.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("distance"), "image_id")))
        chosen = ranked.filter((F.col("distance") > F.col("limits.threshold")) | (F.col("rn") <= min_drift))
    above = F.col("distance") > F.col("limits.threshold")
    return chosen.select(
        "image_id", "label",
        F.round("distance", 6).alias("drift_score"),
        F.col("limits.mean_distance").alias("mean_distance"),
        F.col("limits.threshold").alias("threshold"),
        above.alias("above_threshold"),
        F.concat(
            F.lit("distance "), F.format_string("%.4f", F.col("distance")),
            F.when(above, " is above the threshold").otherwise(
                F.concat(F.lit(" is among the largest (mean "), F.format_string("%.4f", F.col("limits.mean_distance")), F.lit(")"))
            ),
            F.lit(", label '"), F.col("label"), F.lit("'"),
        ).alias("reason"),
    )


def top_outliers(df: DataFrame, n: int) -> DataFrame:
    return centroid_distances(df).select("image_id", "label", "distance").orderBy(F.desc("distance"), "image_id").limit(n)


def covariance_matrix(df: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """(i, j, cov) with N-1 in the denominator.

    Each task sums the outer products of its centred rows in NumPy and emits one D x D block,
    so the shuffle carries D*D numbers per task however many rows there are.
    """
    centred = df.withColumn("centroid", centroid(df, vector).scalar()).select(
        V.minus(F.col(vector), F.col("centroid")).alias("v")
    )

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram, rows = np.zeros((dim, dim)), 0
        for batch in batches:
            if len(batch):
                x = np.stack(batch["v"].to_numpy())
                gram += x.T @ x
                rows += len(batch)
        i, j = np.indices((dim, dim))
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "s": gram.ravel(), "n": rows})

    partial = centred.mapInPandas(block, "i int, j int, s double, n long")
    return partial.groupBy("i", "j").agg((F.sum("s") / F.nullif(F.sum("n") - 1, F.lit(0))).alias("cov"))


def frechet_distance_approx(df: DataFrame, is_real: str, vector: str = "embedding") -> DataFrame:
    """|mu_r - mu_f|^2 + tr S_r + tr S_f - 2 sqrt(max(tr S_r * tr S_f, 0)); one pass, one row."""
    side = df.groupBy(is_real).agg(
        V.vector_mean(F.col(vector)).alias("mu"), V.total(V.vector_variance(F.col(vector))).alias("trace")
    )
    both = side.agg(
        F.max_by("mu", is_real).alias("mu_real"), F.min_by("mu", is_real).alias("mu_fake"),
        F.max_by("trace", is_real).alias("trace_real"), F.min_by("trace", is_real).alias("trace_fake"),
    )
    mean_part = V.sq_distance(F.col("mu_real"), F.col("mu_fake"))
    cross = F.sqrt(F.greatest(F.col("trace_real") * F.col("trace_fake"), F.lit(0.0)))
    return both.select(
        mean_part.alias("mean_part"), "trace_real", "trace_fake",
        (mean_part + F.col("trace_real") + F.col("trace_fake") - 2 * cross).alias("frechet"),
    )


def cosine_alignment(left: DataFrame, right: DataFrame, on: str, vector: str = "embedding") -> DataFrame:
    """Row-wise cosine of two vector sets joined on their key; NULL for a zero vector."""
    joined = left.select(on, F.col(vector).alias("a")).join(right.select(on, F.col(vector).alias("b")), on)
    return joined.select(on, V.cosine_similarity(F.col("a"), F.col("b")).alias("alignment"))


def pipeline_report(df: DataFrame, sigma: float = 2.0, min_drift: int = 2, max_drift: int = 3) -> DataFrame:
    """One report row: ids, mean distance, threshold, number of drift rows (bounded by ``max_drift``)."""
    found = centroid_distance_outliers(df, sigma, min_drift, max_drift)
    return found.agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("drift_score"), "image_id"))),
                                 lambda s: s["image_id"].cast("string")), ",").alias("drift_ids"),
        F.count(F.lit(1)).alias("drift_count"),
        r6(F.max("mean_distance")).alias("mean_distance"),
        r6(F.max("threshold")).alias("threshold"),
    )

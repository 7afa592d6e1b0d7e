"""Anomaly detectors and their consensus. A detector is df -> (id, is_anomaly)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from curadrift.operators.blocks import nearest
from curadrift.session import checkpointed


def statistical_detector(df: DataFrame, key: str, features: list[str], threshold: float = 3.0) -> DataFrame:
    """Largest |z| over the features, and whether it passes the threshold; one pass for all statistics."""
    stats = df.agg(F.struct(*[F.struct(F.avg(f).alias("m"), F.stddev_pop(f).alias("s")).alias(f) for f in features]))
    scored = df.withColumn("st", stats.scalar())
    z = [F.coalesce(F.try_divide(F.abs(F.col(f) - F.col(f"st.{f}.m")), F.col(f"st.{f}.s")), F.lit(0.0)) for f in features]
    worst = F.greatest(*z) if len(z) > 1 else z[0]
    return scored.select(F.col(key).alias("id"), worst.alias("score"), (worst > threshold).alias("is_anomaly"))


def lof_detector(df: DataFrame, key: str, vector: str, k: int, threshold: float = 1.5) -> DataFrame:
    """Local outlier factor over exactly k neighbours each."""
    n = df.count()
    near = checkpointed(nearest(df, key, vector, k, n))
    reach_limit = near.groupBy(F.col("id").alias("other")).agg(F.max("distance").alias("k_distance"))
    reach = near.join(reach_limit, "other").select("id", "other", F.greatest("distance", "k_distance").alias("reach"))
    # rows among their own duplicates have infinite density
    infinite = F.lit(float("inf"))
    density = reach.groupBy("id").agg(F.coalesce(1 / F.nullif(F.avg("reach"), F.lit(0.0)), infinite).alias("lrd"))
    around = near.select("id", "other").join(density.select(F.col("id").alias("other"), F.col("lrd").alias("other_lrd")), "other")
    mean = around.groupBy("id").agg(F.avg("other_lrd").alias("mean_lrd"))
    lof = F.when(F.col("lrd") == infinite, 1.0).when(F.col("mean_lrd") == infinite, infinite).otherwise(F.col("mean_lrd") / F.col("lrd"))
    return mean.join(density, "id").select("id", lof.alias("score"), (lof > threshold).alias("is_anomaly"))


def _average_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows, the forest's unit of depth."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _last_hash(rows: int, sample: int) -> int:
    """The largest 64-bit hash that draws a row, so that about ``sample`` of ``rows`` are drawn, all if there are fewer."""
    return (1 << 64) * min(sample, rows) // max(1, rows) - (1 << 63) - 1


def isolation_forest(
    df: DataFrame, key: str, vector: str, trees: int = 50, sample: int = 256, seed: int = 9, threshold: float = 0.6
) -> DataFrame:
    """Isolation forest: each tree grows on a hash sample of the whole table of its own; all rows are scored.

    A tree gets about ``sample`` rows (all, if there are fewer), so the samples and the grown forest are bounded by
    arguments, not by the table, and every tree is a group of its own. Without a row in any tree there is no result.
    """
    out = f"id {df.schema[key].dataType.simpleString()}, score double, is_anomaly boolean"
    rows = df.select(F.col(key).alias("id"), F.col(vector).alias("v"))
    last = max(_last_hash(rows.count(), sample), -(1 << 63))
    drawn = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.xxhash64("id", F.lit(seed), t) <= F.lit(last)) if sample > 0 else F.array().cast("array<int>")
    dealt = rows.withColumn("tree", F.explode(F.transform(drawn, lambda t: t.cast("long"))))

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        tree, x = int(frame["tree"].iloc[0]), np.stack(frame["v"].to_numpy())
        rng = np.random.default_rng(seed * 1000 + tree)
        limit = int(np.ceil(np.log2(max(len(x), 2))))
        nodes: list[list[float]] = []

        def add(part: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, -1, -1, depth + _average_path(len(part))])
            spans = np.ptp(part, axis=0) if len(part) else np.zeros(x.shape[1])
            if depth < limit and len(part) > 1 and spans.max() > 0:
                axis = int(rng.choice(np.flatnonzero(spans > 0)))
                cut = float(rng.uniform(part[:, axis].min(), part[:, axis].max()))
                below = part[:, axis] < cut
                nodes[at][0], nodes[at][1] = axis, cut
                nodes[at][2], nodes[at][3] = add(part[below], depth + 1), add(part[~below], depth + 1)
            return at

        add(x, 0)
        return pd.DataFrame({"tree": [tree], "size": [len(x)], "nodes": [json.dumps(nodes)]})

    grown = dealt.groupBy("tree").applyInPandas(grow, "tree long, size long, nodes string").collect()
    forest = [np.array(json.loads(r["nodes"])) for r in grown]
    if not grown:
        return df.sparkSession.createDataFrame([], out)
    unit = _average_path(float(np.mean([r["size"] for r in grown])))
    shared = df.sparkSession.sparkContext.broadcast(forest)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            x, depth = np.stack(frame["v"].to_numpy()), np.zeros(len(frame))
            for tree in shared.value:
                at = np.zeros(len(x), int)
                for _ in range(64):
                    axis = tree[at, 0].astype(int)
                    inner = axis >= 0
                    if not inner.any():
                        break
                    go_left = x[np.arange(len(x)), np.maximum(axis, 0)] < tree[at, 1]
                    at = np.where(inner, np.where(go_left, tree[at, 2], tree[at, 3]).astype(int), at)
                depth += tree[at, 4]
            value = 2.0 ** (-(depth / max(len(shared.value), 1)) / max(unit, 1e-12))
            yield pd.DataFrame({"id": frame["id"], "score": value, "is_anomaly": value > threshold})

    return rows.mapInPandas(score, out)


Detector = Callable[[DataFrame], DataFrame]


def anomaly_consensus(df: DataFrame, detectors: dict[str, Detector]) -> tuple[DataFrame, dict[str, str]]:
    """(id, votes, detectors, is_anomaly) with any vote enough, and the errors of detectors that failed, in planning or while
    they ran; each is stored by itself. Without any detector left there are no rows."""
    votes, failures = None, {}
    for name, detector in detectors.items():
        try:
            part = checkpointed(detector(df).select("id", F.lit(name).alias("detector"), "is_anomaly"))
        except Exception as failure:  # a detector is a user's function and may raise anything
            failures[name] = str(failure)
            continue
        votes = part if votes is None else votes.unionByName(part)
    if votes is None:
        votes = df.sparkSession.createDataFrame([], "id bigint, detector string, is_anomaly boolean")
    per_id = votes.groupBy("id").agg(
        F.count_if("is_anomaly").alias("votes"), F.count(F.lit(1)).alias("detectors"), F.bool_or("is_anomaly").alias("is_anomaly")
    )
    return per_id, failures


def consensus_summary(per_id: DataFrame) -> DataFrame:
    return per_id.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("is_anomaly").alias("anomalies"),
        F.coalesce(F.avg(F.col("is_anomaly").cast("double")), F.lit(0.0)).alias("anomaly_rate"),
    )

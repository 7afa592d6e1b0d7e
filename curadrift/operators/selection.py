"""Active learning: score tables, ranking, and batch selection.

Score tables are (task_id, score). Iterative pickers keep their state as a table, look at a bounded
list of the best candidates on the driver, and pass over the data once per list, not once per pick.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from curadrift.functions import probabilities as P, vectors as V
from curadrift.functions.numbers import drawn
from curadrift.operators.blocks import block_count, block_pairs, distance_sums, no_rows
from curadrift.operators.ordered import indexed, ranged, running
from curadrift.session import checkpointed, small_side

# Candidates one pass brings to the driver.
CANDIDATES = 4096


# ---- normalising and ranking -------------------------------------------------------------

def min_max_normalize(df: DataFrame, score: str = "score", by: list[str] | None = None) -> DataFrame:
    """(s - min) / (max - min), 0.5 where all are equal; globally or per group."""
    limits = df.groupBy(*(by or [])).agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    if by:
        joined = df.join(small_side(limits), by)
    else:
        joined = df.withColumn("limits", limits.select(F.struct("lo", "hi")).scalar()).select("*", "limits.lo", "limits.hi").drop("limits")
    value = F.when(F.col("hi") == F.col("lo"), 0.5).otherwise((F.col(score) - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return joined.withColumn(score, value).drop("lo", "hi")


def max_normalize(df: DataFrame, column: str) -> DataFrame:
    """Divide by the largest value if that is positive."""
    top = df.agg(F.max(column))
    return df.withColumn("top", top.scalar()).withColumn(
        column, F.when(F.col("top") > 0, F.col(column) / F.col("top")).otherwise(F.col(column))
    ).drop("top")


def top_k(df: DataFrame, k: int, key: str = "task_id", score: str = "score") -> DataFrame:
    """The k best rows with their rank; ties go to the smaller key."""
    best = df.orderBy(F.desc(score), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)))


def rank_scores(df: DataFrame, k: int, key: str = "task_id", score: str = "score") -> DataFrame:
    """Every row with its 1-based rank by falling score, and whether it is among the first k."""
    ordered = indexed(df.withColumn("falling", -F.col(score)), [], ["falling", key]).drop("falling")
    return ordered.withColumnRenamed("idx", "rank").withColumn("is_selected", F.col("rank") <= k)


# ---- uncertainty and committee -----------------------------------------------------------

UNCERTAINTY: dict[str, Callable[[Column], Column]] = {
    "least_confidence": P.least_confidence,
    "variation_ratio": P.least_confidence,
    "margin": P.margin,
    "entropy": P.entropy,
}


def task_uncertainty(tasks: DataFrame, predictions: DataFrame, method: str = "entropy", normalize: bool = True) -> DataFrame:
    """Mean uncertainty over a task's predictions (renormalised); 1 for a task without any."""
    measure = UNCERTAINTY[method]
    per = predictions.select("task_id", measure(P.renormalize(F.col("probs"))).alias("u")).groupBy("task_id").agg(F.avg("u").alias("u"))
    scored = tasks.select("task_id").join(per, "task_id", "left").select("task_id", F.coalesce("u", F.lit(1.0)).alias("score"))
    return min_max_normalize(scored) if normalize else scored


DISAGREEMENT: dict[str, Callable[[Column], Column]] = {
    "vote_entropy": P.vote_entropy_normalized,
    "kl_divergence": P.kl_to_consensus,
    "consensus_entropy": lambda m: P.entropy(P.consensus(m)),
}


def committee_scores(committee: DataFrame, method: str = "vote_entropy", size: int = 5) -> DataFrame:
    """Normalised disagreement of each task's first ``size`` members."""
    members = F.slice("members", 1, size)
    return min_max_normalize(committee.select("task_id", DISAGREEMENT[method](members).alias("score")))


def expected_model_change(predictions: DataFrame) -> DataFrame:
    return min_max_normalize(predictions.select("task_id", P.raw_entropy(F.col("probs")).alias("score")))


def random_scores(tasks: DataFrame, seed: int) -> DataFrame:
    """Uniform [0, 1) score from a hash of the task and the seed."""
    return tasks.select("task_id", (drawn(F.col("task_id"), F.lit(seed)) / float(1 << 52)).alias("score"))


# ---- diversity ---------------------------------------------------------------------------

def diversity_cosine(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean cosine distance to all rows in linear work: 1 - x^ . mean(x^)."""
    unit = df.select(key, V.l2_normalize(F.col(vector)).alias("u"))
    mean = unit.agg(V.vector_mean(F.col("u")).alias("m")).first()["m"] or []
    length = V.norm(F.col(vector))
    along = V.dot_with(F.col(vector), mean) / F.when(length == 0, 1.0).otherwise(length)
    return df.select(key, (1 - along).alias("score"))


def diversity_manhattan(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean Manhattan distance to all rows from running sums per dimension, no pairs."""
    cells = df.select(F.col(key), F.posexplode(vector).alias("dim", "x"))
    counts = cells.groupBy("dim", "x").agg(F.count(F.lit(1)).alias("c"))
    seen = running(ranged(counts, ["dim"], ["x"]), ["dim"], ["x"], sums={"n": F.col("c"), "s": F.col("c") * F.col("x")})
    below = F.col("x") * F.col("n") - F.col("s")
    above = (F.col("total_s") - F.col("s")) - F.col("x") * (F.col("total_n") - F.col("n"))
    mean_gap = seen.select("dim", "x", ((below + above) / F.col("total_n")).alias("gap"))
    return checkpointed(cells.join(mean_gap, ["dim", "x"]).groupBy(key).agg(F.sum("gap").alias("score")))


def diversity_euclidean(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean Euclidean distance to all rows, itself included; exact, quadratic work in blocks."""
    n = df.count()
    return checkpointed(distance_sums(df, key, vector, n).select(key, (F.col("total") / F.lit(max(n, 1))).alias("score")))


DIVERSITY = {"cosine": diversity_cosine, "manhattan": diversity_manhattan, "euclidean": diversity_euclidean}


def diversity_scores(df: DataFrame, key: str, vector: str, metric: str = "cosine") -> DataFrame:
    scored = DIVERSITY[metric](df, key, vector)
    return min_max_normalize(scored.select(F.col(key).alias("task_id"), "score"))


def _to_anchors(x: np.ndarray, anchors: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all rows to all anchors."""
    if metric == "cosine":
        def unit(n: np.ndarray) -> np.ndarray:
            return np.where(n == 0, 1.0, n)

        return 1 - (x @ anchors.T) / (unit(np.linalg.norm(x, axis=1))[:, None] * unit(np.linalg.norm(anchors, axis=1))[None, :])
    if metric == "euclidean":
        return np.stack([np.sqrt(((x - a) ** 2).sum(1)) for a in anchors], axis=1)
    return np.stack([np.abs(x - a).sum(1) for a in anchors], axis=1)


def anchor_distances(
    df: DataFrame, key: str, vector: str, anchors: DataFrame, metrics: list[str], block_anchors: int = 1024, block_rows: int = 512
) -> DataFrame:
    """(key, anchor, one column per metric) for every row and every anchor (anchor, v).

    The result has rows x anchors rows, whatever their number: reduce it before keeping it. Rows and anchors are dealt into
    blocks, and a task works on one block of each as two matrices.
    """
    rows = df.select(F.col(key).alias("id"), F.col(vector).alias("v"))
    held = checkpointed(anchors.select(F.col("anchor").alias("id"), "v"))

    def measure(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return no_rows(key, "anchor", *metrics)
        a, b = np.stack(x["v"].to_numpy()), np.stack(y["v"].to_numpy())
        columns = {m: _to_anchors(a, b, m).ravel() for m in metrics}
        return pd.DataFrame({key: np.repeat(x["id"].to_numpy(), len(y)), "anchor": np.tile(y["id"].to_numpy(), len(x)), **columns})

    key_type, anchor_type = df.schema[key].dataType.simpleString(), anchors.schema["anchor"].dataType.simpleString()
    return block_pairs(
        rows, held, block_count(df.count(), block_rows), block_count(held.count(), block_anchors), measure,
        f"{key} {key_type}, anchor {anchor_type}, " + ", ".join(f"{m} double" for m in metrics))


# ---- combined ----------------------------------------------------------------------------

def hybrid_scores(parts: dict[str, DataFrame], weights: dict[str, float], strict: bool = True) -> DataFrame:
    """Weighted sum of score tables. ``strict``: weights must sum to 1 (+-0.01), result normalised;
    otherwise weights are divided by their sum and the sum stays as it is."""
    mass = sum(weights.values())
    if strict and abs(mass - 1.0) > 0.01:
        raise ValueError("weights must sum to 1")
    scale = 1.0 if strict else 1.0 / mass
    tagged = None
    for name, df in parts.items():
        part = df.select("task_id", (F.col("score") * (weights[name] * scale)).alias("score"))
        tagged = part if tagged is None else tagged.unionByName(part)
    summed = tagged.groupBy("task_id").agg(F.sum("score").alias("score"))
    return min_max_normalize(summed) if strict else summed


def exploration_weight(iteration: int, initial: float = 0.7, final: float = 0.2, decay: float = 0.1) -> float:
    return max(initial * math.exp(-decay * iteration), final)


def adaptive_select(uncertainty: DataFrame, diversity: DataFrame, iteration: int, k: int) -> DataFrame:
    """Top k of (1 - w) * u / max u + w * d / max d with a weight that falls with the iteration."""
    w = exploration_weight(iteration)
    u = max_normalize(uncertainty, "score").withColumnRenamed("score", "u")
    d = max_normalize(diversity, "score").withColumnRenamed("score", "d")
    return top_k(u.join(d, "task_id").select("task_id", ((1 - w) * F.col("u") + w * F.col("d")).alias("score")), k)


# ---- greedy batches ----------------------------------------------------------------------

def _rows(spark: SparkSession, picked: list[tuple], key_type: str) -> DataFrame:
    return spark.createDataFrame(picked, f"rank int, task_id {key_type}, score double")


def _distances_to(batch: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(((batch - point) ** 2).sum(axis=1))


def farthest_first(df: DataFrame, key: str, vector: str, k: int, start, candidates: int = CANDIDATES) -> DataFrame:
    """Greedy farthest-first picks from ``start``: rank, task_id, score (distance to the picks before).

    Distances to the picked set only fall. So among the candidates with the largest distances a pick
    is certain as long as it beats the largest distance left outside the list; only then does the
    next pass over the data refresh the list. Results equal one-pick-per-pass greedy. A pass measures
    the rows against all picks so far and writes nothing.
    """
    spark, key_type = df.sparkSession, df.schema[key].dataType.simpleString()
    state = df.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.lit(float("inf")).alias("gap"))
    first = state.filter(F.col("id") == F.lit(start)).first()
    if first is None:
        raise ValueError(f"no row with id {start!r} to start from")
    picked, chosen = [(1, first["id"], float("inf"))], [np.array(first["v"])]
    schema = f"id {key_type}, v array<double>, gap double"
    while len(picked) < k:
        points, done = list(chosen), [p[1] for p in picked]

        def update(frames: Iterator[pd.DataFrame], points=points, done=tuple(done)) -> Iterator[pd.DataFrame]:
            for frame in frames:
                frame = frame[~frame["id"].isin(done)]
                if len(frame):
                    x = np.stack(frame["v"].to_numpy())
                    gap = frame["gap"].to_numpy()
                    for point in points:
                        gap = np.minimum(gap, _distances_to(x, point))
                    yield frame.assign(gap=gap)

        top = state.mapInPandas(update, schema).orderBy(F.desc("gap"), "id").limit(candidates).toPandas()
        if top.empty:
            break
        bound = top["gap"].iloc[-1] if len(top) == candidates else -math.inf
        x, gap, ids = np.stack(top["v"].to_numpy()), top["gap"].to_numpy().copy(), top["id"].to_numpy()
        open_, fresh = np.ones(len(top), bool), []
        while len(picked) < k and open_.any():
            best_gap = gap[open_].max()
            if fresh and best_gap <= bound:
                break
            at = min(np.flatnonzero(open_ & (gap == best_gap)), key=lambda i: ids[i])
            picked.append((len(picked) + 1, ids[at].item(), float(best_gap)))
            open_[at] = False
            fresh.append(x[at])
            gap = np.minimum(gap, _distances_to(x, x[at]))
        chosen += fresh
    return _rows(spark, picked, key_type)


def uncertain_and_diverse(
    df: DataFrame, key: str, vector: str, uncertainty: str, k: int, weight: float = 0.3, candidates: int = CANDIDATES
) -> DataFrame:
    """Greedy picks by (1-w)*u + w*d, where each pick multiplies the others' d by 1 - 0.5/(1 + distance).

    d starts as mean Euclidean distance over its maximum. Scores only fall, so the same candidate
    bound as in ``farthest_first`` makes several picks per pass exact.
    """
    spark, key_type = df.sparkSession, df.schema[key].dataType.simpleString()
    # kept without vectors: every pass joins it to the rows and applies all picks so far
    spread = checkpointed(max_normalize(diversity_euclidean(df, key, vector), "score").withColumnRenamed("score", "d"))
    state = df.join(spread, key).select(
        F.col(key).alias("id"), F.col(vector).alias("v"), F.col(uncertainty).cast("double").alias("u"), "d"
    )
    schema = f"id {key_type}, v array<double>, u double, d double"
    picked, chosen = [], []
    while len(picked) < k:
        points, done = list(chosen), tuple(p[1] for p in picked)

        def update(frames: Iterator[pd.DataFrame], points=points, done=done) -> Iterator[pd.DataFrame]:
            for frame in frames:
                frame = frame[~frame["id"].isin(done)]
                if len(frame):
                    x, d = np.stack(frame["v"].to_numpy()), frame["d"].to_numpy()
                    for point in points:
                        d = d * (1 - 0.5 / (1 + _distances_to(x, point)))
                    yield frame.assign(d=d)

        passed = state.mapInPandas(update, schema) if points else state
        score = (1 - weight) * F.col("u") + weight * F.col("d")
        top = passed.withColumn("s", score).orderBy(F.desc("s"), "id").limit(candidates).toPandas()
        if top.empty:
            break
        bound = top["s"].iloc[-1] if len(top) == candidates else -math.inf
        x, u, d, ids = np.stack(top["v"].to_numpy()), top["u"].to_numpy(), top["d"].to_numpy().copy(), top["id"].to_numpy()
        open_, fresh = np.ones(len(top), bool), []
        while len(picked) < k and open_.any():
            s = (1 - weight) * u + weight * d
            best = s[open_].max()
            if fresh and best <= bound:
                break
            at = min(np.flatnonzero(open_ & (s == best)), key=lambda i: ids[i])
            picked.append((len(picked) + 1, ids[at].item(), float(best)))
            open_[at] = False
            fresh.append(x[at])
            d = d * (1 - 0.5 / (1 + _distances_to(x, x[at])))
        chosen += fresh
    return _rows(spark, picked, key_type)


def kmeans_representatives(df: DataFrame, key: str, vector: str, k: int, seed: int = 42, reduce_to: int | None = 10) -> DataFrame:
    """The row nearest to each of k cluster centres, optionally after PCA: cluster, task_id, score (distance)."""
    features = df.select(F.col(key).alias("task_id"), array_to_vector(F.col(vector)).alias("f"))
    if reduce_to:
        features = PCA(k=reduce_to, inputCol="f", outputCol="g").fit(features).transform(features).select("task_id", F.col("g").alias("f"))
    model = KMeans(k=k, seed=seed, featuresCol="f", predictionCol="cluster").fit(features)
    centres = F.array(*[F.lit([float(x) for x in c]) for c in model.clusterCenters()])
    placed = model.transform(features).select(
        "cluster", "task_id", V.distance(vector_to_array("f"), F.get(centres, F.col("cluster"))).alias("distance")
    )
    return placed.groupBy("cluster").agg(
        F.min_by("task_id", F.struct("distance", "task_id")).alias("task_id"), F.min("distance").alias("score")
    )


def _nearest_centre(frame: pd.DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, number of the nearest centre (the first of equals) and squared distance to it."""
    x = np.stack(frame["v"].to_numpy())
    cluster, best = np.zeros(len(x), int), np.full(len(x), np.inf)
    for i, c in enumerate(centres):
        d = ((x - c) ** 2).sum(axis=1)
        nearer = d < best
        cluster[nearer], best[nearer] = i, d[nearer]
    return x, cluster, best


def kmeans_rounds(df: DataFrame, key: str, vector: str, k: int, rounds: int = 5, seed: int = 42) -> DataFrame:
    """(cluster, task_id, score): the row nearest to each centre after ``rounds`` rounds of Lloyd's method, which any engine can repeat.

    The first centres are the k rows with the smallest ``drawn`` hash. A centre without rows stays where it is and has no result. Vectors that
    are null, hold null or NaN, or differ in length from the first centre take no part; the smaller id wins ties. A round is one pass that emits
    one sum per batch and cluster; the driver holds k centres.
    """
    id_type = df.schema[key].dataType.simpleString()
    clean = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    rows = df.filter(clean).select(F.col(key).alias("task_id"), F.col(vector).cast("array<double>").alias("v"))
    drawn_rows = rows.orderBy(drawn(F.col("task_id"), F.lit(seed)), "task_id")
    first = drawn_rows.limit(1).collect()
    if not first or k < 1:
        return df.sparkSession.createDataFrame([], f"cluster int, task_id {id_type}, score double")
    rows = rows.filter(F.size("v") == len(first[0]["v"]))
    centres = np.array([r["v"] for r in drawn_rows.filter(F.size("v") == len(first[0]["v"])).limit(k).collect()])

    def sums(frames: Iterator[pd.DataFrame], at: np.ndarray) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x, cluster, _ = _nearest_centre(frame, at)
                met = np.unique(cluster)
                yield pd.DataFrame({"cluster": met, "n": [int((cluster == c).sum()) for c in met], "total": [x[cluster == c].sum(axis=0) for c in met]})

    def nearest_rows(frames: Iterator[pd.DataFrame], at: np.ndarray) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                _, cluster, best = _nearest_centre(frame, at)
                near = pd.DataFrame({"cluster": cluster, "task_id": frame["task_id"], "score": np.sqrt(best)})
                yield near.sort_values(["score", "task_id"]).drop_duplicates("cluster")

    for _ in range(rounds):
        partial = rows.mapInPandas(lambda frames, at=centres: sums(frames, at), "cluster int, n long, total array<double>")
        moved = partial.groupBy("cluster").agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total")).collect()
        centres = centres.copy()
        for r in moved:
            centres[r["cluster"]] = np.array(r["total"]) / r["n"]
    near = rows.mapInPandas(lambda frames, at=centres: nearest_rows(frames, at), f"cluster int, task_id {id_type}, score double")
    return near.groupBy("cluster").agg(F.min(F.struct("score", "task_id")).alias("b")).select("cluster", "b.task_id", "b.score")


# ---- model-based -------------------------------------------------------------------------

def _bootstrap(df: DataFrame, seed: int) -> DataFrame:
    return df.sample(withReplacement=True, fraction=1.0, seed=seed)


def _class_probabilities(model_df: DataFrame, column: str, name: str) -> DataFrame:
    return model_df.select("task_id", vector_to_array(column).alias(name))


def ensemble_uncertainty(
    train: DataFrame, pool: DataFrame, classes: int, dim: int, models: int = 3, seed: int = 5
) -> DataFrame:
    """Forest / boosted trees / perceptron on bootstraps in turn; score = mean over classes of the
    std over models of the class probability. Inputs: (task_id, features ARRAY, label DOUBLE)."""
    as_vector = array_to_vector(F.col("features"))
    train_v = train.withColumn("f", as_vector).select("f", "label").cache()
    outputs = pool.withColumn("f", as_vector).select("task_id", "f")
    names = []
    for m in range(models):
        sample, name = _bootstrap(train_v, seed + m), f"p{m}"
        names.append(name)
        raw, prob = f"raw{m}", f"prob{m}"
        common = dict(featuresCol="f", labelCol="label", rawPredictionCol=raw, probabilityCol=prob, predictionCol=f"pred{m}", seed=seed + m)
        if m % 3 == 0:
            fitted = RandomForestClassifier(numTrees=20, **common).fit(sample)
            outputs = fitted.transform(outputs).withColumn(name, vector_to_array(prob))
        elif m % 3 == 1 and classes == 2:
            common.pop("rawPredictionCol"), common.pop("probabilityCol")
            booster = GBTClassifier(maxIter=10, **common)
            booster = booster.setRawPredictionCol(raw).setProbabilityCol(prob)
            outputs = booster.fit(sample).transform(outputs).withColumn(name, vector_to_array(prob))
        elif m % 3 == 1:
            each = []
            for c in range(classes):
                one = GBTClassifier(featuresCol="f", labelCol="y", maxIter=5, seed=seed + m, predictionCol=f"pred{m}_{c}")
                one = one.setRawPredictionCol(f"raw{m}_{c}").setProbabilityCol(f"prob{m}_{c}")
                outputs = one.fit(sample.withColumn("y", (F.col("label") == c).cast("double"))).transform(outputs)
                each.append(vector_to_array(f"prob{m}_{c}")[1])
            outputs = outputs.withColumn(name, P.renormalize(F.array(*each)))
        else:
            fitted = MultilayerPerceptronClassifier(layers=[dim, 16, classes], maxIter=50, **common).fit(sample)
            outputs = fitted.transform(outputs).withColumn(name, vector_to_array(prob))
    train_v.unpersist()  # all models are fitted
    per_model = F.array(*[F.col(n) for n in names])
    mean = P.consensus(per_model)
    square = P.consensus(F.transform(per_model, lambda p: F.transform(p, lambda x: x * x)))
    std = F.zip_with(square, mean, lambda s, m: F.sqrt(F.greatest(s - m * m, F.lit(0.0))))
    return outputs.select("task_id", (V.total(std) / classes).alias("score"))


def calibrated_uncertainty(train: DataFrame, pool: DataFrame, classes: int, folds: int = 3, seed: int = 5) -> DataFrame:
    """Forest per fold with a logistic calibration per class fitted on the held-out fold;
    score = 1 - largest mean calibrated probability."""
    with_f = train.withColumn("f", array_to_vector(F.col("features"))).withColumn(
        "fold", F.pmod(F.xxhash64("task_id", F.lit(seed)), F.lit(folds))
    ).select("task_id", "f", "label", "fold").cache()
    pooled = pool.withColumn("f", array_to_vector(F.col("features"))).select("task_id", "f")
    votes = []
    for fold in range(folds):
        forest = RandomForestClassifier(
            featuresCol="f", labelCol="label", numTrees=20, seed=seed, rawPredictionCol=f"raw{fold}", probabilityCol=f"prob{fold}", predictionCol=f"pred{fold}"
        ).fit(with_f.filter(F.col("fold") != fold))
        held = forest.transform(with_f.filter(F.col("fold") == fold)).withColumn("p", vector_to_array(f"prob{fold}"))
        pooled = forest.transform(pooled).withColumn("p", vector_to_array(f"prob{fold}"))
        calibrated = []
        for c in range(classes):
            fit = LogisticRegression(featuresCol="x", labelCol="y").fit(
                held.select(array_to_vector(F.array(F.col("p")[c])).alias("x"), (F.col("label") == c).cast("double").alias("y"))
            )
            line = F.col("p")[c] * float(fit.coefficients[0]) + float(fit.intercept)
            calibrated.append(1 / (1 + F.exp(-line)))
        pooled = pooled.withColumn(f"c{fold}", P.renormalize(F.array(*calibrated))).drop("p")
        votes.append(f"c{fold}")
    with_f.unpersist()  # all models are fitted
    mean = P.consensus(F.array(*[F.col(v) for v in votes]))
    return pooled.select("task_id", P.least_confidence(mean).alias("score"))


# ---- selection rounds --------------------------------------------------------------------

def candidate_tasks(tasks: DataFrame, open_selected: DataFrame | None = None) -> DataFrame:
    """Tasks not labelled and not selected in an open round."""
    left = tasks.filter(~F.col("is_labeled"))
    return left if open_selected is None else left.join(open_selected.select("task_id"), "task_id", "left_anti")


STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    "uncertainty": lambda tasks, predictions, **kw: task_uncertainty(tasks, predictions, kw.get("method", "entropy")),
    "random": lambda tasks, predictions, **kw: random_scores(tasks, kw.get("seed", 0)),
    "expected_model_change": lambda tasks, predictions, **kw: expected_model_change(predictions.join(tasks.select("task_id"), "task_id", "left_semi")),
}


def register_strategy(name: str, strategy: Callable[..., DataFrame]) -> None:
    STRATEGIES[name] = strategy


def select_tasks(
    tasks: DataFrame, predictions: DataFrame, batch_size: int, strategy: str = "uncertainty",
    open_selected: DataFrame | None = None, enabled: bool = True, **options,
) -> DataFrame:
    """Selected tasks: task_id, score, rank; nothing when the configuration is disabled."""
    candidates = candidate_tasks(tasks, open_selected)
    if not enabled:
        candidates = candidates.limit(0)
    return top_k(STRATEGIES[strategy](candidates, predictions, **options), batch_size)


def round_record(selected: DataFrame, candidates: DataFrame, rounds: DataFrame, strategy: str) -> DataFrame:
    """One row for the rounds table: number = rounds so far + 1, selected count, mean score."""
    number = rounds.agg(F.count(F.lit(1)).alias("n"))
    total = candidates.agg(F.count(F.lit(1)).alias("n"))
    head = selected.agg(F.count(F.lit(1)).alias("selected"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("avg_score"))
    return head.select(
        (number.scalar() + 1).alias("round_number"), F.lit(strategy).alias("strategy"),
        total.scalar().alias("total_candidates"), "selected", "avg_score",
    )


def selection_spread(selected: DataFrame, df: DataFrame, key: str, vector: str) -> DataFrame:
    """One row: mean pairwise Euclidean distance of the selected rows (a bounded batch)."""
    chosen = df.join(F.broadcast(selected.select(F.col("task_id").alias(key))), key, "left_semi")
    n = chosen.count()
    sums = distance_sums(chosen, key, vector, n)
    return sums.agg(F.coalesce(F.sum("total") / max(n * (n - 1), 1), F.lit(0.0)).alias("diversity_score"))


def round_completion(selected: DataFrame, annotations: DataFrame) -> DataFrame:
    """Per round: selected and finished tasks; complete when each has an annotation that was not cancelled."""
    done = annotations.filter(~F.col("was_cancelled")).select("task_id").distinct().withColumn("done", F.lit(True))
    return selected.join(done, "task_id", "left").groupBy("round_id").agg(
        F.count(F.lit(1)).alias("selected"), F.count("done").alias("finished")
    ).withColumn("is_completed", F.col("selected") == F.col("finished"))


def selection_status(rounds: DataFrame) -> DataFrame:
    """One row: number of rounds, latest round, tasks pending in open rounds."""
    return rounds.agg(
        F.count(F.lit(1)).alias("total_rounds"), F.max("round_id").alias("latest_round"),
        F.coalesce(F.sum(F.when(~F.col("is_completed"), F.col("selected"))), F.lit(0)).alias("pending_tasks"),
    )


def latest_predictions(predictions: DataFrame, model_version: str) -> DataFrame:
    """Predictions of one model version with their place, newest first."""
    kept = predictions.filter(F.col("model_version") == model_version)
    numbered = indexed(kept.withColumn("age", -F.timestamp_diff("MICROSECOND", F.lit("2000-01-01").cast("timestamp_ntz"), F.col("created_at"))),
                       ["task_id"], ["age", "id"])
    return numbered.drop("age").withColumnRenamed("idx", "place")

"""Annotator agreement.

Everything rests on one table, (a1, a2, l1, l2, n): how often annotator a1 gave l1 where a2 gave l2
on a shared task. Its size follows the number of annotators and labels, not the number of rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from curadrift.functions.numbers import share
from curadrift.operators.blocks import block_count, block_pairs, no_rows
from curadrift.operators.ordered import indexed, neighbours

# A task with more annotators than this is counted in blocks instead of by a self-join.
JOIN_ANNOTATORS = 256


def last_labels(annotations: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Latest label per task and annotator, from stored ``count_cells`` where there are any."""
    source, latest = (annotations, F.struct("created_at", "id")) if cells is None else (cells, F.col("latest"))
    return source.groupBy("task_id", "annotator_id").agg(F.max_by(F.coalesce("label", F.lit("none")), latest).alias("label"))


def _pairs_by_join(labels: DataFrame) -> DataFrame:
    """Self-join on the task for tasks of bounded size; pairs are counted before any shuffle."""
    a = labels.select("task_id", F.col("annotator_id").alias("a1"), F.col("label").alias("l1"))
    b = labels.select("task_id", F.col("annotator_id").alias("a2"), F.col("label").alias("l2"))
    joined = a.join(b, "task_id").filter("a1 < a2")
    return joined.groupBy("a1", "a2", "l1", "l2").agg(F.count(F.lit(1)).alias("n"))


def _pairs_by_blocks(labels: DataFrame, block_annotators: int = 2048, chunk_tasks: int = 512) -> DataFrame:
    """Crowded tasks: annotators x tasks as 0/1 blocks per label, multiplied in NumPy.

    A task of the job sees one chunk of tasks and two annotator blocks and emits counts per
    annotator pair, so no task's annotators are ever listed pair by pair.
    """
    def kernel(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(x) and len(y):
            tasks = np.unique(np.concatenate([x["task_id"], y["task_id"]]))
            xa, ya = np.unique(x["annotator_id"]), np.unique(y["annotator_id"])

            def grid(frame: pd.DataFrame, who: np.ndarray) -> np.ndarray:
                cells = np.zeros((len(tasks), len(who)))
                cells[np.searchsorted(tasks, frame["task_id"]), np.searchsorted(who, frame["annotator_id"])] = 1
                return cells

            right = {label: grid(frame, ya) for label, frame in y.groupby("label")}
            for l1, frame in x.groupby("label"):
                left = grid(frame, xa)
                for l2, cells in right.items():
                    counts = (left.T @ cells).astype("int64")
                    counts[xa[:, None] >= ya[None, :]] = 0
                    i, j = np.nonzero(counts)
                    if len(i):
                        names = [np.full(len(i), name, dtype=object) for name in (l1, l2)]
                        out.append((xa[i], ya[j], *names, counts[i, j]))
        if not out:
            return no_rows("a1", "a2", "l1", "l2", "n")
        return pd.DataFrame(dict(zip(["a1", "a2", "l1", "l2", "n"], map(np.concatenate, zip(*out)))))

    size = labels.agg(F.approx_count_distinct("task_id").alias("tasks"), F.approx_count_distinct("annotator_id").alias("who")).first()
    annotator_blocks = block_count(size["who"], block_annotators)
    task_chunks = block_count(size["tasks"], chunk_tasks)
    chunked = labels.withColumn("chunk", F.pmod(F.xxhash64("task_id"), F.lit(task_chunks)))
    who = labels.schema["annotator_id"].dataType.simpleString()
    counts = block_pairs(
        chunked, chunked, annotator_blocks, annotator_blocks, kernel,
        f"a1 {who}, a2 {who}, l1 string, l2 string, n long", key="annotator_id", also=["chunk"],
    )
    return counts.groupBy("a1", "a2", "l1", "l2").agg(F.sum("n").alias("n"))


def pair_label_counts(annotations: DataFrame, join_annotators: int = JOIN_ANNOTATORS, cells: DataFrame | None = None) -> DataFrame:
    """(a1, a2, l1, l2, n) with a1 < a2 over all shared tasks."""
    labels = last_labels(annotations, cells)
    crowded = labels.groupBy("task_id").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > join_annotators).select("task_id")
    if crowded.isEmpty():
        return _pairs_by_join(labels)
    usual = _pairs_by_join(labels.join(crowded, "task_id", "left_anti"))
    rest = _pairs_by_blocks(labels.join(crowded, "task_id", "left_semi"))
    return usual.unionByName(rest).groupBy("a1", "a2", "l1", "l2").agg(F.sum("n").alias("n"))


def pair_agreement(counts: DataFrame) -> DataFrame:
    """Per pair: shared tasks, agreed tasks, rate and Cohen's kappa (NULL when chance agreement is 1)."""
    sides = F.array(
        F.struct(F.col("l1").alias("label"), F.col("n").alias("m1"), F.lit(0).cast("bigint").alias("m2"),
                 F.when(F.col("l1") == F.col("l2"), F.col("n")).otherwise(0).alias("same")),
        F.struct(F.col("l2").alias("label"), F.lit(0).cast("bigint").alias("m1"), F.col("n").alias("m2"),
                 F.lit(0).cast("bigint").alias("same")),
    )
    # one shuffle by pair serves both aggregations; a pair has at most labels^2 rows
    marginal = (
        counts.repartition("a1", "a2").select("a1", "a2", F.explode(sides).alias("s"))
        .groupBy("a1", "a2", "s.label")
        .agg(F.sum("s.m1").alias("m1"), F.sum("s.m2").alias("m2"), F.sum("s.same").alias("same"))
    )
    per_pair = marginal.groupBy("a1", "a2").agg(
        F.sum("m1").alias("shared"), F.sum("same").alias("agreed"), F.sum(F.col("m1") * F.col("m2")).alias("products")
    )
    rate = F.col("agreed") / F.col("shared")
    chance = F.col("products") / (F.col("shared").cast("double") * F.col("shared"))
    # equal whole numbers mean chance agreement is exactly 1
    certain = F.col("products") == F.col("shared") * F.col("shared")
    return per_pair.select(
        "a1", "a2", "shared", "agreed", rate.alias("rate"),
        F.when(~certain, (rate - chance) / (1 - chance)).alias("kappa"),
    )


def mean_kappa(pairs: DataFrame) -> DataFrame:
    """One row: mean kappa over pairs sharing a task, 1 without any pair."""
    return pairs.agg(
        F.coalesce(F.avg("kappa"), F.lit(1.0)).alias("kappa"), F.count(F.lit(1)).alias("pairs"),
        F.count("kappa").alias("defined"),
    )


def percent_agreement(annotations: DataFrame) -> DataFrame:
    """One row: share of tasks with two or more annotators on which all labels are equal."""
    per_task = last_labels(annotations).groupBy("task_id").agg(
        F.count(F.lit(1)).alias("k"), (F.min("label") == F.max("label")).alias("same")
    )
    return per_task.filter("k > 1").agg(
        F.count(F.lit(1)).alias("tasks"), F.coalesce(share(F.col("same")), F.lit(1.0)).alias("percent_agreement")
    )


def agreement_matrix(annotations: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a1, a2, rate) in both directions plus the diagonal at 1.

    Pairs without a shared task have no row; their rate is 0 by definition.
    """
    both = pairs.select("a1", "a2", "rate").unionByName(
        pairs.select(F.col("a2").alias("a1"), F.col("a1").alias("a2"), "rate")
    )
    who = annotations.select(F.col("annotator_id").alias("a1")).distinct()
    return both.unionByName(who.select("a1", F.col("a1").alias("a2"), F.lit(1.0).alias("rate")))


def intra_annotator_consistency(annotations: DataFrame) -> DataFrame:
    """Per annotator 1 - label changes / (n - 1) in time order, 1 below two annotations."""
    ordered = indexed(annotations.select("annotator_id", "label", "created_at", "id"), ["annotator_id"], ["created_at", "id"])
    steps = neighbours(ordered, ["annotator_id"], {"before": ("label", 1)})
    return steps.groupBy("annotator_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("before") != F.col("label")).alias("changes")
    ).withColumn("consistency", F.when(F.col("n") < 2, 1.0).otherwise(1 - F.try_divide("changes", F.col("n") - 1)))


def per_annotator_agreement(pairs: DataFrame) -> DataFrame:
    """Mean rate of each annotator with the others."""
    both = pairs.select(F.col("a1").alias("annotator_id"), "rate").unionByName(
        pairs.select(F.col("a2").alias("annotator_id"), "rate")
    )
    return both.groupBy("annotator_id").agg(F.avg("rate").alias("agreement"))

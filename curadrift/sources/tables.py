"""Logical inputs (samples, annotations, predictions, ...) read from the raw tables."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from curadrift.functions.probabilities import softmax
from curadrift.functions.vectors import doubles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def hours_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(3.6e9)


def samples(spark, sf_dir) -> DataFrame:
    """image_id, label, embedding; one row per embedding."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_id"),
        F.col("label").cast("string").alias("label"),
        doubles(F.col("embedding")).alias("embedding"),
    )


def points(spark, sf_dir) -> DataFrame:
    """Two-dimensional points: the first two embedding components."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding")[0].cast("double").alias("x"),
        F.col("embedding")[1].cast("double").alias("y"),
        F.col("label").cast("string").alias("label"),
    )


def predictions(spark, sf_dir) -> DataFrame:
    """task_id, probs (3 classes)."""
    v = doubles(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("task_id"), softmax(F.slice(v, 1, 3)).alias("probs")
    )


def committee(spark, sf_dir, members: int = 5) -> DataFrame:
    """task_id, members: one three-class distribution per committee member."""
    v = doubles(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("task_id"),
        F.array(*[softmax(F.slice(v, 3 * m + 1, 3)) for m in range(members)]).alias("members"),
    )


def annotations(spark, sf_dir) -> DataFrame:
    """id, task_id, annotator_id, label, lead_time, created_at; one row per event."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.floor(F.col("event_id") / 5).alias("task_id"),
        (F.col("user_id") % 12).alias("annotator_id"),
        F.col("event_type").alias("label"),
        F.col("value").alias("lead_time"),
        F.col("ts").alias("created_at"),
    )


def annotation_json(spark, sf_dir) -> DataFrame:
    """Annotations whose label sits in JSON, in the four shapes readers meet."""
    kind = F.col("id") % 4
    name = F.col("label")
    result = (
        F.when(kind == 0, F.format_string('[{"value":{"choices":["%s"]}}]', name))
        .when(kind == 1, F.format_string('[{"value":{"choices":{"%s":0.7,"other":0.3}}}]', name))
        .when(kind == 2, F.format_string('[{"value":{}},{"value":{"labels":["%s","second"]}}]', name))
        .otherwise('[{"value":{"score":0.25}}]')
    )
    return annotations(spark, sf_dir).withColumn("result", result)


def tasks(spark, sf_dir) -> DataFrame:
    """id, created_at for ids 0 .. events/4 - 1; four in five carry annotations."""
    first = annotations(spark, sf_dir).groupBy("task_id").agg(F.min("created_at").alias("first_at"))
    events = table(spark, sf_dir, "events")
    wanted = events.agg(F.floor(F.count(F.lit(1)) / 4).alias("n"))
    # event ids are dense from 0, so the ids below n are the task ids
    ids = events.select(F.col("event_id").alias("id")).withColumn("n", wanted.scalar()).filter("id < n").drop("n")
    return (
        ids.join(first, ids["id"] == first["task_id"], "left")
        .select(
            "id",
            F.coalesce(
                F.timestamp_add("HOUR", (-(F.col("id") % 48)).cast("int"), F.col("first_at")), ntz("2024-01-01 00:00:00")
            ).alias("created_at"),
        )
    )


def numeric_features(spark, sf_dir) -> DataFrame:
    """feature, value, is_ref from three line item columns split at 1998-06-01."""
    names = ["l_quantity", "l_extendedprice", "l_discount"]
    return (
        table(spark, sf_dir, "lineitem")
        .select(*names, (F.col("l_shipdate") < ntz("1998-06-01 00:00:00")).alias("is_ref"))
        .unpivot(["is_ref"], names, "feature", "value")
    )


def event_values(spark, sf_dir) -> DataFrame:
    """One numeric series, reference before 2024-01-16."""
    return table(spark, sf_dir, "events").select(
        "value", (F.col("ts") < ntz("2024-01-16 00:00:00")).alias("is_ref")
    )


def event_labels(spark, sf_dir) -> DataFrame:
    """label, is_ref from event types, reference before 2024-01-16."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("label"), (F.col("ts") < ntz("2024-01-16 00:00:00")).alias("is_ref")
    )


def preference_pairs(spark, sf_dir) -> DataFrame:
    """User turn, next assistant turn as chosen, the following conversation's turn as rejected."""
    turns = table(spark, sf_dir, "conversations")
    user = turns.filter("role = 'user'").select(
        "conv_id", F.col("turn"), F.col("text").alias("prompt")
    )
    answer = turns.filter("role = 'assistant'").select(
        F.col("conv_id"), (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    other = answer.select((F.col("conv_id") - 1).alias("conv_id"), "turn", F.col("answer").alias("rejected"))
    return (
        user.join(answer, ["conv_id", "turn"], "left")
        .join(other, ["conv_id", "turn"], "left")
        .select(
            "conv_id", "turn", "prompt", F.col("answer").alias("chosen"), "rejected",
            (0.5 + (F.col("conv_id") % 50) / 100).alias("confidence"),
            (F.col("turn") + 1).alias("turn_length"),
        )
    )


def trajectories(spark, sf_dir) -> DataFrame:
    """traj_id, state (3 numbers) from events; a trajectory runs in (ts, event_id) order."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("traj_id"), "ts", "event_id",
        F.array(
            F.col("value") / 100,
            F.hour("ts") / F.lit(24.0),
            F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(0.0)) / 100,
        ).alias("state"),
    )


def weekly_reports(spark, sf_dir) -> DataFrame:
    """Report headers per event type and week: report_id, project_id, report_type, created_at, score, issues."""
    week = F.floor(F.timestamp_diff("DAY", ntz("2024-01-01 00:00:00"), F.col("ts")) / 7)
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("project"), week.alias("week"))
        .agg(
            F.round(F.avg("value") / 500, 6).alias("overall_score"),
            F.count_if(F.col("value") > 200).alias("issue_count"),
            F.max("ts").alias("created_at"),
        )
        .select(
            F.concat_ws("-", "project", F.col("week").cast("string")).alias("report_id"),
            "project", "week", "overall_score", "issue_count", "created_at",
            F.when(F.col("week") % 2 == 0, "scheduled").otherwise("manual").alias("report_type"),
        )
    )

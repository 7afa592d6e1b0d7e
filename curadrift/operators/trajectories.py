"""Kinematic limits and obstacle clearance of ordered state sequences."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, functions as F

from curadrift.functions import vectors as V
from curadrift.operators.ordered import indexed, neighbours
from curadrift.session import checkpointed

# Limits.
MAX_SPEED, MAX_ACCELERATION, MIN_CLEARANCE, DEFAULT_RADIUS = 1.0, 2.0, 0.05, 0.1
GRID_AXES = 3


def obstacle_clearance(df: DataFrame, obstacles: DataFrame) -> DataFrame:
    """Rows whose ``state`` is closer than radius + clearance to any obstacle (``position``, ``radius``).

    Obstacles stay a table: each stands in its grid cell and the adjacent ones (over up to three axes), cells are as wide as
    the largest reach, and a state meets the obstacles of its own cell only.
    """
    placed = obstacles.select(F.col("position").alias("at"), (F.coalesce("radius", F.lit(DEFAULT_RADIUS)) + MIN_CLEARANCE).alias("reach"))
    bound = placed.agg(F.max("reach").alias("reach"), F.min(F.size("at")).alias("axes")).first()
    if not bound["axes"] or bound["axes"] < 1 or bound["reach"] <= 0:
        return df.filter(F.lit(False))

    def cell(point: Column, shift: tuple[int, ...]) -> Column:
        return F.array(*[F.floor(F.get(point, F.lit(i)) / bound["reach"]) + s for i, s in enumerate(shift)])

    axes = min(GRID_AXES, bound["axes"])
    around = F.array(*[cell(F.col("at"), shift) for shift in itertools.product((-1, 0, 1), repeat=axes)])
    near = placed.select("at", "reach", F.explode(around).alias("cell"))
    meets = (cell(df["state"], (0,) * axes) == near["cell"]) & (V.distance(df["state"], near["at"]) < near["reach"])
    return df.join(near, meets, "left_semi")


def kinematics(df: DataFrame, group: str, order: list[str], obstacles: DataFrame | None = None) -> DataFrame:
    """Every state with step, speed, acceleration and the violations it causes."""
    steps = neighbours(
        indexed(df.select(group, *order, "state"), [group], order), [group], {"back1": ("state", 1), "back2": ("state", 2)}
    )
    speed = V.norm(V.minus(F.col("state"), F.col("back1")))
    bend = F.zip_with(V.minus(F.col("state"), F.col("back1")), V.minus(F.col("back1"), F.col("back2")), lambda a, b: a - b)
    measured = steps.select(
        group, (F.col("idx") - 1).alias("step"), "state", speed.alias("speed"), V.norm(bend).alias("acceleration")
    )
    collides = F.lit(False)
    if obstacles is not None:
        measured = checkpointed(measured)
        hit = obstacle_clearance(measured, obstacles).select(group, "step").withColumn("hit", F.lit(True))
        measured = measured.join(hit, [group, "step"], "left")
        collides = F.coalesce("hit", F.lit(False))
    rules = [
        (collides, "collision"),
        (F.col("speed") > MAX_SPEED, "velocity"),
        (F.col("acceleration") > MAX_ACCELERATION, "acceleration"),
    ]
    return measured.withColumn("violations", F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules]))).drop("hit")


def safety_report(measured: DataFrame, group: str) -> DataFrame:
    """Per trajectory the three verdicts, their conjunction and the number of violations."""
    def none_of(kind: str) -> Column:
        return ~F.bool_or(F.array_contains("violations", kind))

    return measured.groupBy(group).agg(
        none_of("collision").alias("collision_free"), none_of("velocity").alias("velocity_ok"),
        none_of("acceleration").alias("acceleration_ok"), F.sum(F.size("violations")).alias("violations"),
    ).withColumn("safe", F.col("collision_free") & F.col("velocity_ok") & F.col("acceleration_ok"))

"""Running values and neighbours in a global order, without one task per group.

A window over a group sends the whole group to one task. These helpers range-partition the rows by
group *and* order, so a group of any size spreads over many tasks, and stitch the parts together
with one small table of per-part totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from curadrift.session import checkpointed

PART = "part_no"
# Rows per task when neighbours are looked up.
BUCKET_ROWS = 1 << 17


def ranged(df: DataFrame, groups: list[str], order: list[str], rows_per_part: int | None = None) -> DataFrame:
    """Range-partition by group and order; the part number is fixed by a checkpoint. With ``rows_per_part`` there are at least
    so many parts that none holds many more rows."""
    keys = [*groups, *order]
    if rows_per_part:
        usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        keys = [max(usual, -(-df.count() // rows_per_part)), *keys]
    spread = df.repartitionByRange(*keys).withColumn(PART, F.spark_partition_id())
    return checkpointed(spread)


def running(
    parts: DataFrame,
    groups: list[str],
    order: list[str],
    sums: dict[str, Column] | None = None,
    mins: dict[str, Column] | None = None,
    next_of: str | None = None,
) -> DataFrame:
    """Inclusive running sums and minima per group over the output of ``ranged``.

    ``next_of`` also adds ``next_<column>``, that column on the group's following row, and each
    sum comes with ``total_<name>``, its value over the whole group.
    """
    sums, mins = sums or {}, mins or {}
    local = Window.partitionBy(PART, *groups).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = [F.sum(c).alias(f"sum_{n}") for n, c in sums.items()]
    totals += [F.min(c).alias(f"min_{n}") for n, c in mins.items()]
    if next_of:
        totals.append(F.min(next_of).alias("first_here"))
    before = Window.partitionBy(*groups).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    following = Window.partitionBy(*groups).orderBy(PART)
    whole = Window.partitionBy(*groups)
    per_part = parts.groupBy(PART, *groups).agg(*totals).select(
        PART, *groups,
        *[F.coalesce(F.sum(f"sum_{n}").over(before), F.lit(0)).alias(f"base_{n}") for n in sums],
        *[F.sum(f"sum_{n}").over(whole).alias(f"total_{n}") for n in sums],
        *[F.min(f"min_{n}").over(before).alias(f"base_{n}") for n in mins],
        *([F.lead("first_here").over(following).alias("first_after")] if next_of else []),
    )
    here = parts.select(
        "*",
        *[F.sum(c).over(upto).alias(f"local_{n}") for n, c in sums.items()],
        *[F.min(c).over(upto).alias(f"local_{n}") for n, c in mins.items()],
        *([F.lead(next_of).over(local).alias("next_here")] if next_of else []),
    )
    joined = here.join(per_part, [PART, *groups])
    out = [F.col(c) for c in parts.columns]
    out += [(F.col(f"base_{n}") + F.col(f"local_{n}")).alias(n) for n in sums]
    out += [F.least(f"base_{n}", f"local_{n}").alias(n) for n in mins]
    out += [F.col(f"total_{n}") for n in sums]
    if next_of:
        out.append(F.coalesce("next_here", "first_after").alias(f"next_{next_of}"))
    return joined.select(*out)


def indexed(df: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """Add ``idx``, the 1-based dense position in the group's order (``order`` must be unique)."""
    return running(ranged(df, groups, order), groups, order, sums={"idx": F.lit(1).cast("bigint")}).drop(PART, "total_idx")


def neighbours(
    df: DataFrame, groups: list[str], shifts: dict[str, tuple[str, int]], bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Lag (positive) and lead (negative) columns over ``idx``.

    Rows go to buckets of consecutive positions; rows near an edge are copied to the bucket next
    door, so every bucket answers for its own rows and none holds more than ``bucket_rows`` + edge.
    """
    back = max([k for _, k in shifts.values() if k > 0], default=0)
    ahead = max([-k for _, k in shifts.values() if k < 0], default=0)
    position = F.col("idx") - 1
    bucket = F.floor(position / bucket_rows)
    homes = [bucket]
    if back:
        homes.append(F.when(position % bucket_rows >= bucket_rows - back, bucket + 1))
    if ahead:
        homes.append(F.when((position % bucket_rows < ahead) & (bucket > 0), bucket - 1))
    copies = df.withColumn("home", bucket).withColumn("bucket", F.explode(F.array_compact(F.array(*homes))))
    row = Window.partitionBy(*groups, "bucket").orderBy("idx")
    return (
        copies.select("*", *[F.lag(c, k).over(row).alias(n) for n, (c, k) in shifts.items()])
        .filter(F.col("home") == F.col("bucket"))
        .drop("home", "bucket")
    )

"""Dataset versions: content hash, version rows, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from curadrift.session import checkpointed


def row_json(df: DataFrame) -> Column:
    """Canonical JSON of a row: columns in name order."""
    stamps = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    return F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false", **stamps})


def row_hashes(df: DataFrame) -> DataFrame:
    """Each row's 16-digit hash."""
    return df.withColumn("data_hash", F.substring(F.sha2(row_json(df), 256), 1, 16))


def table_hash(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """16-digit hash of a table (or of each group) that does not depend on row order.

    Row digests are added up as whole numbers in four segments, which partial sums combine inside
    the tasks; the sums and the row count are hashed at the end. No list of hashes is ever gathered.
    """
    digest = F.sha2(row_json(df), 256)
    segments = [
        F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).alias(f"s{i}") for i in range(4)
    ]
    sums = df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("rows"), *segments)
    text = F.concat_ws("-", F.col("rows").cast("string"), *[F.coalesce(F.col(f"s{i}"), F.lit(0).cast("decimal(20,0)")).cast("string") for i in range(4)])
    return sums.select(*(by or []), "rows", F.substring(F.sha2(text, 256), 1, 16).alias("data_hash"))


def create_version(versions: DataFrame, hashed: DataFrame, description: str, created_at: Column) -> DataFrame:
    """The version row to append: next number, parent = newest version."""
    state = versions.agg(
        (F.coalesce(F.max("number"), F.lit(0)) + 1).alias("number"), F.max_by("version_id", "number").alias("parent_id")
    )
    return state.select(
        F.concat(F.lit("v"), F.col("number").cast("string")).alias("version_id"), "number", "parent_id",
        hashed.select("data_hash").scalar().alias("data_hash"), F.lit(description).alias("description"), created_at.alias("created_at"),
    )


def list_versions(versions: DataFrame) -> DataFrame:
    return versions.orderBy(F.desc("created_at"), F.desc("number"))


def version_history(versions: DataFrame, version_id: str) -> DataFrame:
    """The version and its ancestors with ``steps_back``; parent pointers double, so a chain of n versions
    takes log2(n) joins."""
    jumps = checkpointed(versions.select("version_id", F.col("parent_id").alias("up")))
    found = versions.filter(F.col("version_id") == version_id).select("version_id", F.lit(0).cast("bigint").alias("steps_back"))
    stride = 1
    while True:
        reached = found.join(jumps, "version_id").filter("up IS NOT NULL").select(
            F.col("up").alias("version_id"), (F.col("steps_back") + stride).alias("steps_back")
        )
        found = checkpointed(found.unionByName(reached))
        up = jumps.select(F.col("version_id").alias("up"), F.col("up").alias("further"))
        jumps = checkpointed(jumps.join(up, "up").filter("further IS NOT NULL").select("version_id", F.col("further").alias("up")))
        stride *= 2
        if jumps.isEmpty():
            return found.join(versions, "version_id")

"""Session set-up and the two materialisation helpers every operator shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# Bytes a broadcast side may hold; beyond it the join is left to Spark's shuffle joins.
BROADCAST_BYTES = 16 << 20


def build_session(app: str = "curadrift", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; ``conf`` entries use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir`` or what the context already uses.

    Only a local master, where driver and executors share one disk, may fall back to a fresh
    temporary folder; a cluster without the setting is refused.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if configured:
            context.setCheckpointDir(configured)
        elif context.master.startswith("local"):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="curadrift-"))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return configured or context.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts the lineage and survives executor loss."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, byte_limit: int = BROADCAST_BYTES) -> DataFrame:
    """Materialise a reduced table and hint a broadcast only if its measured bytes (as text) allow it."""
    kept = checkpointed(df)
    size = kept.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(kept) if size <= byte_limit else kept


def stored(df: DataFrame, *columns: str) -> DataFrame:
    """The columns (all, if none is named) as Parquet in the shared folder, read again: cuts the lineage like a checkpoint, but packed and read
    by column. A table that is stored already is taken as it is."""
    if getattr(df, "_stored", False):
        return df
    df = df.select(*columns) if columns else df
    path = fresh_path(df.sparkSession, "table")
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._stored = True
    return kept

"""Running a stream to the end of what is there, and the sinks that make a batch safe to repeat."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from curadrift.session import fresh_path

Processor = Callable[[DataFrame, int], None]


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process all available input into a Parquet table and return it."""
    spark, root = stream.sparkSession, fresh_path(stream.sparkSession, name)
    run = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", os.path.join(root, "out"))
        .option("checkpointLocation", os.path.join(root, "checkpoint")).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(os.path.join(root, "out"))


def drain_windows(counts: DataFrame, name: str) -> DataFrame:
    """Process all available input of counters per event-time window, a window column and then counts, and return every window.

    ``closed`` tells the windows that the watermark has passed, which the sink holds, from those still open when the input ended:
    these are read from the stream's own state, a counter each, by Spark's state source.
    """
    spark, root = counts.sparkSession, fresh_path(counts.sparkSession, name)
    out, checkpoint = os.path.join(root, "out"), os.path.join(root, "checkpoint")
    run = counts.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    window, *counters = counts.schema.fields
    kept = spark.read.format("statestore").load(checkpoint)
    # casts between structs go by position: the state names its counters alike
    key = F.col("key").cast(f"struct<w:{window.dataType.simpleString()}>")["w"].alias(window.name)
    value = F.col("value").cast(f"struct<{','.join(f'{c.name}:bigint' for c in counters)}>")
    open_ones = kept.select(key, *[value[c.name].alias(c.name) for c in counters], F.lit(False).alias("closed"))
    return spark.read.schema(counts.schema).parquet(out).withColumn("closed", F.lit(True)).unionByName(open_ones)


def drain_batches(stream: DataFrame, each: Processor, checkpoint: str) -> None:
    """Run ``each(batch, batch_id)`` on every micro-batch; offsets are committed after it returns."""
    run = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()


def batch_folder(path: str, batch_id: int) -> str:
    return os.path.join(path, f"batch_id={batch_id}")


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of this run on whatever file system it lies; nothing happens if it is not there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def write_batch(batch: DataFrame, path: str, batch_id: int) -> None:
    """One folder per batch id, overwritten when the batch is repeated."""
    batch.write.mode("overwrite").parquet(batch_folder(path, batch_id))


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All batch folders of ``write_batch``; an empty table when there is none."""
    try:
        return spark.read.schema(f"{schema}, batch_id bigint").parquet(path)
    except Exception as missing:
        if "PATH_NOT_FOUND" in str(missing):
            return spark.createDataFrame([], f"{schema}, batch_id bigint")
        raise


DEAD_LETTER_SCHEMA = "failed_at timestamp, reason string, payload_size int"


def dead_letters(batch: DataFrame, payload: str, reason: str) -> DataFrame:
    """What is kept of a failed message: time, reason, payload size."""
    return batch.select(
        F.current_timestamp().alias("failed_at"), F.lit(reason).alias("reason"), F.length(payload).alias("payload_size")
    )


def with_dead_letters(process: Processor, path: str, payload: str) -> Processor:
    """Run ``process``; if it raises, the batch goes to the dead-letter table and the stream goes on."""
    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            process(batch, batch_id)
        except Exception as failure:
            write_batch(dead_letters(batch, payload, str(failure)), path, batch_id)
        finally:
            batch.unpersist()

    return each

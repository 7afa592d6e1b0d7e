"""Stream inputs: growing tables and Kafka topics."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def instant(at: Column) -> Column:
    """A zone-free timestamp as the same instant in UTC, whatever the session zone; watermarks need it."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), at))


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 64) -> DataFrame:
    """A table read as a stream of its files."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    schema = spark.read.parquet(path).schema
    # a glob, so that a single file and a folder of files both work
    pattern = os.path.join(sf_dir, f"{name[:-1]}[{name[-1]}].parquet")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern)


def kafka_stream(
    spark: SparkSession, servers: str, topic: str, group: str, starting: str = "earliest", max_offsets: int = 1_000_000
) -> DataFrame:
    """Topic as (key, value, topic, partition, offset, timestamp); needs the Kafka package on the class path."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("kafka.group.id", group)
        .option("startingOffsets", starting)
        .option("maxOffsetsPerTrigger", max_offsets)
        .option("failOnDataLoss", "true")
        .load()
    )

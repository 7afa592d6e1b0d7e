"""Helpers the training-data operators share: stored tables, streamed groups, blocks of bounded size."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from curadrift.session import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``run(spark, sf_dir)``, with DuckDB SQL where the result has one."""
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors, keeps column pruning."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    held.stored_at = path
    return held


def release(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing reads any more: what was made of them has been stored itself."""
    for held in tables:
        spark = held.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(held.stored_at)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def text_key(text: Column) -> Column:
    """32 hex digits that stand for a text; null counts as empty."""
    return F.md5(F.coalesce(text, F.lit("")))


def parts_for(rows: float, per_part: int, least: int = 1) -> int:
    return max(least, math.ceil(rows / per_part))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_units(df: DataFrame, keys: list[str], work: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str,
             order: list[str] | None = None) -> DataFrame:
    """``work`` on the rows of each key, streamed from sorted partitions: many small groups cost no call each of the
    JVM, and a task holds one group and one Arrow batch at a time. The caller bounds the size of a group."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            codes = batch[keys].apply(lambda c: c.astype("object")) if len(keys) > 1 else batch[keys]
            changed = np.zeros(len(batch), dtype=bool)
            for k in keys:
                values = codes[k].to_numpy()
                changed[1:] |= values[1:] != values[:-1]
            cuts = np.flatnonzero(changed)
            if held and all(held[-1][k].iat[-1] == batch[k].iat[0] for k in keys):
                first = cuts[0] if len(cuts) else len(batch)
                held.append(batch.iloc[:first])
                if not len(cuts):
                    continue
                begin = first
            else:
                begin = 0
            out = []
            if held:
                out.append(work(pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]))
                held = []
            edges = [begin, *[c for c in cuts if c > begin]]
            for a, b in zip(edges, edges[1:], strict=False):
                out.append(work(batch.iloc[a:b]))
            held = [batch.iloc[edges[-1]:]]
            out = [o for o in out if o is not None and len(o)]
            if out:
                yield pd.concat(out, ignore_index=True)
        if held:
            last = work(pd.concat(held, ignore_index=True) if len(held) > 1 else held[0])
            if last is not None and len(last):
                yield last

    return df.repartition(*keys).sortWithinPartitions(*keys, *(order or [])).mapInPandas(run, schema)


def block_pairs(df: DataFrame, key: str, count: str, member: str, size: int) -> DataFrame:
    """Deal the members of each key into blocks of about ``size`` and give every pair of blocks a unit of its own:
    adds ``bi``, ``bj`` (the unit within the key) and ``own`` (the block of the row). Small groups are one unit."""
    blocks = F.ceil(F.col(count) / F.lit(size)).cast("int")
    own = F.pmod(F.xxhash64(F.col(member), F.lit(17)), F.greatest(blocks, F.lit(1))).cast("int")
    return (
        df.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest(blocks, F.lit(1)) - 1)))
        .withColumn("bi", F.least("own", "other")).withColumn("bj", F.greatest("own", "other"))
        .drop("other")
    )


def components(edges: DataFrame, name: str = "components", rounds: int = 50) -> DataFrame:
    """Smallest node of each connected component, from links ``a`` and ``b`` (strings): ``node``, ``root``.

    Each round gives every node the least of itself and its neighbours, then replaces both ends of every link by what they
    were given: a star is settled in one round and later rounds see only links between what is left. Every round is
    stored; the driver sees only whether a link is left.
    """
    def ordered(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    links, given = stored(ordered(edges), f"{name}-links"), None
    for turn in range(rounds):
        ends = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        step = stored(ends.groupBy(F.col("e.a").alias("node")).agg(F.least(F.min("e.b"), F.first("e.a")).alias("root")), f"{name}-step-{turn}")
        if given is None:
            before, given = None, step
        else:
            onward = step.select(F.col("node").alias("root"), F.col("root").alias("onward"))
            before, given = given, stored(given.join(onward, "root", "left").select("node", F.coalesce("onward", "root").alias("root")), f"{name}-{turn}")
        moved = links.join(step.select(F.col("node").alias("a"), F.col("root").alias("to_a")), "a").join(
            step.select(F.col("node").alias("b"), F.col("root").alias("to_b")), "b")
        used, links = links, stored(ordered(moved.select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))), f"{name}-links-{turn}")
        release(used, *([before, step] if before is not None else []))
        if not links.limit(1).count():
            release(links)
            return given
    raise RuntimeError("components did not settle")


class Numbered(dict):
    """Numbers for things in the order they are first looked up."""

    def __missing__(self, thing):
        number = self[thing] = len(self)
        return number

    def line(self, things: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, things), dtype=np.int64, count=len(things))

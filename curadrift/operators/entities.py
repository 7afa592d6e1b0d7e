"""Keyed entity tables: upserts, ordered lookups, cascades, paging, small per-group lists."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window, functions as F

from curadrift.operators.ordered import PART
from curadrift.session import fresh_path, small_side


def top_n_per_group(df: DataFrame, groups: list[str], order: list[Column], n: int) -> DataFrame:
    """First n rows per group.

    Spark limits each group to n rows inside every task before the shuffle (window group limit),
    so a group of any size reaches the final task as n rows per input task.
    """
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return df.withColumn("rn", rank).filter(F.col("rn") <= n).drop("rn")


def smallest_n(df: DataFrame, groups: list[str], column: str, n: int) -> DataFrame:
    """groups + ``smallest``: the n smallest values per group, as a sorted array."""
    kept = top_n_per_group(df.select(*groups, column), groups, [F.col(column).asc()], n)
    return kept.groupBy(*groups).agg(F.array_sort(F.collect_list(column)).alias("smallest"))


def latest_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the one with the largest ``order``; an aggregate, so no group is sorted."""
    row = F.struct(*[F.col(c) for c in df.columns if c != key])
    return df.groupBy(key).agg(F.max_by(row, F.col(order)).alias("row")).select(key, "row.*")


def merge_samples(known: DataFrame, incoming: DataFrame, key: str = "sample_id", seq: str = "seq") -> DataFrame:
    """Upsert by key: the row with the highest sequence number wins, so folding many batches is one call."""
    return latest_by_key(known.unionByName(incoming, allowMissingColumns=True), key, seq)


def report_order(reports: DataFrame, key: str = "report_id", seq: str = "seq") -> DataFrame:
    """Report ids without duplicates and their latest sequence number, to be shown newest first."""
    return reports.groupBy(key).agg(F.max(seq).alias("latest_seq"))


def merge_partial(known: DataFrame, incoming: DataFrame, key: str, seq: str = "seq", removed: DataFrame | None = None) -> DataFrame:
    """Upsert where a NULL in the newer row keeps the older value; ``first_seq`` keeps the place in the
    order. Keys in ``removed`` are dropped."""
    both = known.unionByName(incoming, allowMissingColumns=True)
    fields = [c for c in both.columns if c not in (key, seq)]
    merged = both.groupBy(key).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in fields], F.min(seq).alias("first_seq")
    )
    return merged if removed is None else merged.join(removed.select(key), key, "left_anti")


def keep_newest(df: DataFrame, key: str, seq: str, n: int) -> DataFrame:
    """First arrival per key, newest first, at most n (the feature's own cap)."""
    row = F.struct(*[F.col(c) for c in df.columns if c != key])
    first = df.groupBy(key).agg(F.min_by(row, F.col(seq)).alias("row")).select(key, "row.*")
    return first.orderBy(F.desc(seq), key).limit(n)


def toggle_selection(current: DataFrame, toggled: DataFrame, key: str = "id") -> DataFrame:
    """Ids selected after toggling: an id is in when it was selected or toggled an odd number of times."""
    both = current.select(key).unionByName(toggled.select(key))
    return both.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1").select(key)


def apply_decisions(logs: DataFrame, decisions: DataFrame, key: str = "log_id") -> DataFrame:
    """Latest decision and reason per log; logs without one keep theirs."""
    last = decisions.groupBy(key).agg(F.max_by(F.struct("decision", "reason"), "seq").alias("d"))
    return logs.join(last, key, "left").withColumns({
        "user_decision": F.coalesce("d.decision", "user_decision"),
        "rejection_reason": F.when(F.col("d").isNotNull(), F.col("d.reason")).otherwise(F.col("rejection_reason")),
    }).drop("d")


def enrich_points(samples: DataFrame, points: DataFrame, key: str = "sample_id") -> DataFrame:
    """Label and label id of the 2-D points laid over known samples."""
    p = points.select(key, F.col("label").alias("p_label"), F.col("label_id").alias("p_label_id"))
    return samples.join(p, key, "left").withColumns({
        "label": F.coalesce("p_label", "label"), "label_id": F.coalesce("p_label_id", "label_id")
    }).drop("p_label", "p_label_id")


def report_samples(reports: DataFrame, samples: DataFrame) -> DataFrame:
    """Known samples of each report with their place in its id list; unknown ids are dropped."""
    listed = reports.select("report_id", F.posexplode("sample_ids").alias("pos", "sample_id"))
    return listed.join(samples.drop("report_id"), "sample_id")


def remove_reports(reports: DataFrame, samples: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports without the given ones, and samples without theirs."""
    ids = gone.select("report_id")
    return reports.join(ids, "report_id", "left_anti"), samples.join(ids, "report_id", "left_anti")


def review_logs_for(logs: DataFrame, reports: DataFrame) -> DataFrame:
    return logs.join(reports.select("report_id"), "report_id", "left_semi")


def mark_needs_review(samples: DataFrame, drifted: DataFrame, key: str = "sample_id", tag: str = "needs_review") -> DataFrame:
    """Add the tag once to each drifted sample; ``marked`` tells the rows that changed."""
    hit = drifted.select(key).distinct().withColumn("hit", F.lit(True))
    joined = samples.join(hit, key, "left")
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    marked = F.coalesce("hit", F.lit(False)) & ~F.array_contains(tags, tag)
    return joined.withColumn("marked", marked).withColumn("tags", F.when(F.col("marked"), F.array_append(tags, tag)).otherwise(tags)).drop("hit")


def dataset_stats(samples: DataFrame) -> DataFrame:
    """One row: totals, drift count, mean and largest isolation (at least 0)."""
    return samples.agg(
        F.count(F.lit(1)).alias("total_samples"), F.count_if("is_drift").alias("drift_count"),
        F.coalesce(F.avg("isolation_score"), F.lit(0.0)).alias("mean_isolation"),
        F.greatest(F.coalesce(F.max("isolation_score"), F.lit(0.0)), F.lit(0.0)).alias("max_isolation"),
    )


def entity_counts(**tables: DataFrame) -> DataFrame:
    """(entity, n) for each table given by name."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("entity"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def sort_by(df: DataFrame, by: Column, key: str, descending: bool = False) -> DataFrame:
    return df.orderBy(by.desc() if descending else by.asc(), key)


# Rows of one part of a rank index.
PART_ROWS = 1 << 20


class RankIndex:
    """A table written in parts of consecutive places, with the first place of every part: a page reads only the parts that hold it."""

    def __init__(self, df: DataFrame, by: Column, key: str, descending: bool = False, part_rows: int = PART_ROWS):
        self.order, self.columns = [by.desc() if descending else by.asc(), F.col(key)], df.columns
        spark, root = df.sparkSession, fresh_path(df.sparkSession, "rank-index")
        parts = max(1, -(-df.count() // part_rows))
        spread = df.repartitionByRange(parts, *self.order).withColumn(PART, F.spark_partition_id())
        spread.write.partitionBy(PART).parquet(os.path.join(root, "rows"))
        self.rows = spark.read.schema(spread.schema).parquet(os.path.join(root, "rows"))
        # one row a part
        before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
        sizes = self.rows.groupBy(PART).agg(F.count(F.lit(1)).alias("n"))
        sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).write.parquet(os.path.join(root, "parts"))
        self.parts = spark.read.parquet(os.path.join(root, "parts"))

    def parts_of(self, first: int, last: int) -> dict[int, int]:
        """Part -> first place, of the parts that hold places [first, last)."""
        held = self.parts.filter((F.col("base") < last) & (F.col("base") + F.col("n") > first) & F.lit(first < last))
        return {r[PART]: r["base"] for r in held.collect()}

    def page(self, start: int, end: int, overscan: int = 0) -> DataFrame:
        """Rows [start - overscan, end + overscan) with ``place`` (from 0), in order; the page bounds the list of parts."""
        first, last = max(0, start - overscan), end + overscan
        held = self.parts_of(first, last)
        base = F.create_map(*[F.lit(v) for pair in held.items() for v in pair]) if held else F.lit(None).cast("map<int,bigint>")
        rank = F.row_number().over(Window.partitionBy(PART).orderBy(*self.order))
        rows = self.rows.filter(F.col(PART).isin(list(held))).withColumn("place", base[F.col(PART)] + rank - 1)
        return rows.filter((F.col("place") >= first) & (F.col("place") < last)).orderBy("place").select(*self.columns, "place")


def page_window(df: DataFrame, by: Column, key: str, start: int, end: int, overscan: int = 0, descending: bool = False) -> DataFrame:
    """Rows [start - overscan, end + overscan) of the sorted table; keep a ``RankIndex`` to read several pages."""
    return RankIndex(df, by, key, descending).page(start, end, overscan).drop("place")

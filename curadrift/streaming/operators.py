"""Streaming operators; each keeps bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from curadrift.functions import vectors as V
from curadrift.operators.entities import enrich_points, latest_by_key
from curadrift.operators.projections import flatten_json
from curadrift.operators.sequential import Scan, scan_ordered
from curadrift.session import checkpointed
from curadrift.streaming.runs import batch_folder, read_batches, remove_folder, write_batch

# How many reports and review logs the latest state keeps.
REPORT_CAP, LOG_CAP = 100, 50


def dedup(stream: DataFrame, key: str, at: str, delay: str = "1 day") -> DataFrame:
    """First message per id; ids are forgotten after the delay, so the state does not grow for ever."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def parse_messages(stream: DataFrame, json: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(flat messages, error rows) of JSON text; works on streams and tables alike."""
    return flatten_json(stream, json, schema)


def event_reports(messages: DataFrame) -> DataFrame:
    """Messages with an array payload become mini reports named after their sequence number."""
    n = F.size("payload").cast("bigint")
    return messages.filter(F.col("payload").isNotNull()).select(
        F.concat(F.lit("event-"), F.col("seq").cast("string")).alias("report_id"), "seq", n.alias("total_samples"),
        F.lit(0.0).alias("mean_distance"), F.lit(0.0).alias("threshold"), n.alias("drift_count"),
    )


def after_sequence(messages: DataFrame, seen: DataFrame) -> DataFrame:
    """Messages newer than the largest sequence number already seen."""
    last = seen.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("last"))
    return messages.withColumn("last", last.scalar()).filter(F.col("seq") > F.col("last")).drop("last")


def enrich(stream: DataFrame, known: DataFrame, key: str = "sample_id") -> DataFrame:
    """Stream-static left join with the known 2-D points."""
    return enrich_points(stream, known, key)


# ---- windows -----------------------------------------------------------------------------

def histogram_baseline(df: DataFrame, value: str, bins: int) -> dict:
    """Edges and smoothed shares of the baseline: a handful of numbers for the monitor."""
    edge = df.agg(F.min(value).alias("low"), F.max(value).alias("high")).first()
    if edge["low"] is None:
        raise ValueError("the baseline has no values")
    width = (edge["high"] - edge["low"]) / bins
    counts = df.groupBy(_bin(value, edge["low"], width, bins).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
    by_bin = {r["b"]: r["n"] for r in counts}
    total = sum(by_bin.values()) + bins
    return {"low": edge["low"], "width": width, "shares": [(by_bin.get(i, 0) + 1.0) / total for i in range(bins)]}


def _bin(value: str, low: float, width: float, bins: int):
    if width == 0:
        return F.lit(bins - 1)
    # values outside the baseline range count in the outer bins
    return F.greatest(F.lit(0), F.least(F.floor((F.col(value) - low) / width).cast("int"), F.lit(bins - 1)))


def bin_counts(stream: DataFrame, at: str, value: str, baseline: dict, window: str = "24 hours", delay: str = "1 hour") -> DataFrame:
    """(w, n, b0, b1, ...): rows of every window and of every bin of the baseline; the state per window is one counter per bin."""
    bins = len(baseline["shares"])
    binned = stream.withColumn("bin", _bin(value, baseline["low"], baseline["width"], bins))
    return binned.withWatermark(at, delay).groupBy(F.window(at, window).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("bin") == i).alias(f"b{i}") for i in range(bins)]
    )


def drift_of_counts(counted: DataFrame, baseline: dict) -> DataFrame:
    """PSI, JS and chi-square of every window of ``bin_counts`` against the baseline bins; further columns are kept."""
    bins = len(baseline["shares"])
    ref = F.array(*[F.lit(s) for s in baseline["shares"]])
    cur = F.array(*[(F.col(f"b{i}") + 1.0) / (F.col("n") + bins) for i in range(bins)])
    psi = V.total(F.zip_with(ref, cur, lambda r, c: (c - r) * F.log(c / r)))
    js = 0.5 * V.total(F.zip_with(ref, cur, lambda r, c: r * F.log(2 * r / (r + c)) + c * F.log(2 * c / (r + c))))
    chi2 = V.total(F.zip_with(ref, cur, lambda r, c: (c - r) * (c - r) / r))
    more = [c for c in counted.columns if c not in {"w", "n", *[f"b{i}" for i in range(bins)]}]
    return counted.select(
        F.unix_micros("w.start").alias("window_start"), "n", psi.alias("psi"), js.alias("js"), chi2.alias("chi2"), (psi > 0.2).alias("drift"), *more,
    )


def windowed_drift(stream: DataFrame, at: str, value: str, baseline: dict, window: str = "24 hours", delay: str = "1 hour") -> DataFrame:
    """Drift of every closed window, as a stream."""
    return drift_of_counts(bin_counts(stream, at, value, baseline, window, delay), baseline)


def window_counts(stream: DataFrame, at: str, window: str = "1 hour", slide: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """(w, n): rows of every sliding window."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, window, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"))


def active(counted: DataFrame, minimum: int = 10) -> DataFrame:
    """Windows of ``window_counts`` with at least ``minimum`` rows: the moments to start an assessment or training. An open window may qualify already."""
    return counted.filter(F.col("n") >= minimum).select(F.unix_micros("w.end").alias("window_end"), *[c for c in counted.columns if c != "w"])


def activity_windows(stream: DataFrame, at: str, window: str = "1 hour", slide: str = "5 minutes", minimum: int = 10, delay: str = "10 minutes") -> DataFrame:
    """Closed sliding windows with at least ``minimum`` rows, as a stream."""
    return active(window_counts(stream, at, window, slide, delay), minimum)


# ---- batch by batch ----------------------------------------------------------------------

class BatchState:
    """A table replaced by every micro-batch: one folder per batch id, the one before it is the state.

    Repeating a batch reads the same predecessor and writes the same folder again, so only the last two
    folders are needed and older ones are removed.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, initial: DataFrame | None = None):
        self.spark, self.path, self.schema, self.initial = spark, path, schema, initial

    def before(self, batch_id: int) -> DataFrame:
        """The state a batch starts from."""
        if batch_id > 0:
            return self.spark.read.schema(self.schema).parquet(batch_folder(self.path, batch_id - 1))
        return self.spark.createDataFrame([], self.schema) if self.initial is None else self.initial

    def current(self) -> DataFrame:
        """The state after the last batch."""
        known = read_batches(self.spark, self.path, self.schema)
        last = known.select(F.max("batch_id")).first()[0]
        return self.before(0 if last is None else last + 1)

    def replace(self, df: DataFrame, batch_id: int) -> None:
        write_batch(df, self.path, batch_id)
        remove_folder(self.spark, batch_folder(self.path, batch_id - 2))


LATEST_SCHEMA = "kind string, id string, seq bigint, body string"


def latest_state_step(state: BatchState):
    """Per batch: newest reports and review logs without repeats, newest snapshot and heartbeat.

    An id counts by its last arrival, so what is kept does not depend on how the stream is cut into batches."""
    def each(batch: DataFrame, batch_id: int) -> None:
        both = checkpointed(state.before(batch_id).unionByName(batch.select("kind", "id", "seq", "body")))

        def kept(kind: str, n: int) -> DataFrame:
            last = latest_by_key(both.filter(F.col("kind") == kind), "id", "seq")
            return last.orderBy(F.desc("seq"), "id").limit(n).select("kind", "id", "seq", "body")

        row = F.struct("id", "seq", "body")
        newest = both.filter(F.col("kind").isin("snapshot", "heartbeat")).groupBy("kind").agg(F.max_by(row, "seq").alias("r"))
        result = kept("report", REPORT_CAP).unionByName(kept("review_log", LOG_CAP)).unionByName(newest.select("kind", "r.*"))
        state.replace(result, batch_id)

    return each


def sequential_step(state: BatchState, alarms_at: str, key: str, order: list[str], value: str, scan: Scan):
    """Per batch: run a detector on from the stored states, spread over parts of the order; alarms and new
    states are written under the batch id."""
    def each(batch: DataFrame, batch_id: int) -> None:
        before = checkpointed(state.before(batch_id))
        alarms, states = scan_ordered(batch, key, order, value, scan, before)
        write_batch(alarms, alarms_at, batch_id)
        untouched = before.join(states, key, "left_anti")
        state.replace(states.unionByName(untouched), batch_id)

    return each


ROUND_SCHEMA = "round_id bigint, task_id bigint, size bigint"


def open_rounds(selected: DataFrame) -> DataFrame:
    """The tracker's first state: every selected task with the size of its round."""
    sizes = selected.groupBy("round_id").agg(F.count(F.lit(1)).alias("size"))
    return selected.join(sizes, "round_id").select("round_id", "task_id", "size")


def round_tracker_step(state: BatchState, done_at: str):
    """Per batch: strike finished tasks off the open rounds and emit the rounds that became empty.

    The state holds only the tasks still open, so it shrinks as rounds complete and no batch reads
    earlier annotations again.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        before = checkpointed(state.before(batch_id))
        finished = batch.filter(~F.col("was_cancelled")).select("task_id").distinct()
        after = checkpointed(before.join(finished, "task_id", "left_anti").select("round_id", "task_id", "size"))
        complete = before.join(after.select("round_id").distinct(), "round_id", "left_anti").groupBy("round_id").agg(
            F.max("size").alias("selected")
        )
        write_batch(complete, done_at, batch_id)
        state.replace(after, batch_id)

    return each

"""Streams over several micro-batches give what one batch gives."""

import json
import os
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from curadrift.operators import sequential as Q
from curadrift.streaming import operators as S, runs as R
from curadrift.streaming.sources import kafka_stream

SCHEMA = "id long, k string, x double, at timestamp"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(21)
    at = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(240) * 15, unit="min")
    return pd.DataFrame({"id": range(240), "k": rng.choice(["a", "b"], 240), "x": np.round(rng.normal(1, 3, 240), 3), "at": at})


def put(folder, pdf, name):
    """One JSON file; names and times rise, so files are read in order."""
    text = "\n".join(json.dumps({**r, "at": r["at"].isoformat()}) for r in pdf.to_dict("records"))
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.write(text)
    stamp = time.time() - 1000 + int(name.split(".")[0])
    os.utime(path, (stamp, stamp))


@pytest.fixture()
def stream(spark, rows, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(4):
        put(folder, rows.iloc[60 * i : 60 * (i + 1)], f"{i}.json")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder)), folder


def test_repeats_across_batches_are_dropped(spark, rows, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder, rows.iloc[:100], "0.json")
    put(folder, rows.iloc[80:240], "1.json")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))
    assert sorted(r["id"] for r in R.drain(S.dedup(stream, "id", "at"), "t").collect()) == list(range(240))


@pytest.mark.parametrize("scan", [Q.page_hinkley_scan(threshold=20.0), Q.adwin_scan()], ids=["page_hinkley", "adwin"])
def test_detector_state_survives_batches(spark, rows, stream, tmp_path, scan):
    source, _ = stream
    state = S.BatchState(spark, str(tmp_path / "state"), "k string, state array<double>")
    R.drain_batches(source, S.sequential_step(state, str(tmp_path / "alarms"), "k", ["id"], "x", scan), str(tmp_path / "cp"))
    got = R.read_batches(spark, str(tmp_path / "alarms"), "k string, id long, statistic double, score double, window_size int")
    batch = Q.sequential_alarms(spark.createDataFrame(rows), "k", ["id"], "x", scan)
    want = sorted((r["k"], r["id"], round(r["statistic"], 6)) for r in batch.collect())
    assert want and sorted((r["k"], r["id"], round(r["statistic"], 6)) for r in got.collect()) == want
    assert got.select("batch_id").distinct().count() == 4


def test_windows_equal_the_batch(spark, rows, stream):
    source, _ = stream
    table = spark.createDataFrame(rows)
    baseline = S.histogram_baseline(table, "x", 5)
    got = R.drain(S.windowed_drift(source, "at", "x", baseline, "12 hours", "30 minutes"), "t").toPandas()
    closed = rows[rows["at"].dt.floor("12h") + pd.Timedelta(hours=12) <= rows["at"].max() - pd.Timedelta(minutes=30)]
    assert got["n"].sum() == len(closed) and len(got) == closed["at"].dt.floor("12h").nunique()
    assert (got["psi"] >= 0).all()


def test_failed_batch_goes_to_the_dead_letters(spark, stream, tmp_path):
    source, _ = stream
    good, dead = str(tmp_path / "good"), str(tmp_path / "dead")

    def process(batch, batch_id):
        if batch_id == 1:
            raise RuntimeError("no thanks")
        R.write_batch(batch.select("id"), good, batch_id)

    R.drain_batches(source, R.with_dead_letters(process, dead, "k"), str(tmp_path / "cp"))
    assert R.read_batches(spark, good, "id long").count() == 180
    lost = R.read_batches(spark, dead, R.DEAD_LETTER_SCHEMA).collect()
    assert len(lost) == 60 and lost[0]["reason"] == "no thanks" and lost[0]["payload_size"] == 1


def test_restart_reads_only_what_is_new(spark, rows, stream, tmp_path):
    source, folder = stream
    good, checkpoint = str(tmp_path / "good"), str(tmp_path / "cp")

    def process(batch, batch_id):
        R.write_batch(batch.select("id"), good, batch_id)

    R.drain_batches(source, process, checkpoint)
    put(folder, rows.assign(id=rows["id"] + 1000).iloc[:30], "9.json")
    R.drain_batches(source, process, checkpoint)
    ids = [r["id"] for r in R.read_batches(spark, good, "id long").collect()]
    assert len(ids) == 270 and len(set(ids)) == 270


def test_latest_state_over_batches(spark, stream, tmp_path):
    source, _ = stream
    messages = source.select(
        F.when(F.col("id") % 3 == 0, "report").when(F.col("id") % 3 == 1, "review_log").otherwise("heartbeat").alias("kind"),
        (F.col("id") % 180).cast("string").alias("id"), F.col("id").alias("seq"), F.col("k").alias("body"),
    )
    state = S.BatchState(spark, str(tmp_path / "state"), S.LATEST_SCHEMA)
    R.drain_batches(messages, S.latest_state_step(state), str(tmp_path / "cp"))
    out = state.current().toPandas()
    assert (out["kind"] == "heartbeat").sum() == 1 and out.loc[out["kind"] == "heartbeat", "seq"].item() == 239
    assert (out["kind"] == "review_log").sum() == 50
    # ids 0 to 59 come twice; the last arrival counts, however the batches are cut
    reports = out[out["kind"] == "report"]
    assert reports["id"].is_unique and reports["seq"].max() == 237 and len(reports) == 60


def test_rounds_are_announced_once(spark, stream, tmp_path):
    source, _ = stream
    selected = spark.createDataFrame([(i, i // 40) for i in range(280)], "task_id long, round_id long")
    notes = source.select(F.col("id").alias("task_id"), F.lit(False).alias("was_cancelled"))
    done = str(tmp_path / "done")
    state = S.BatchState(spark, str(tmp_path / "open"), S.ROUND_SCHEMA, initial=S.open_rounds(selected))
    R.drain_batches(notes, S.round_tracker_step(state, done), str(tmp_path / "cp"))
    out = {r["round_id"]: r["batch_id"] for r in R.read_batches(spark, done, "round_id long, selected long").collect()}
    assert out == {0: 0, 1: 1, 2: 1, 3: 2, 4: 3, 5: 3}
    assert {r["round_id"] for r in state.current().collect()} == {6}
    # only the last two states are kept
    assert sorted(f for f in os.listdir(tmp_path / "open") if f.startswith("batch_id")) == ["batch_id=2", "batch_id=3"]


def test_replay_after_a_sequence_number(spark):
    messages = spark.createDataFrame([(i,) for i in range(10)], "seq long")
    assert S.after_sequence(messages, messages.filter("seq < 7")).count() == 3
    assert S.after_sequence(messages, messages.limit(0)).count() == 10


def test_kafka_source_needs_its_package(spark):
    with pytest.raises(Exception, match="kafka"):
        kafka_stream(spark, "localhost:1", "t", "g")

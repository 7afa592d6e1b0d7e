"""Numbered messages: resumed streams read every message once; pages and windows at the ends."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from curadrift.operators import entities as E
from curadrift.sources import messages as M
from curadrift.streaming import operators as S, runs as R


def publish(spark, folder, numbers, file_rows=7):
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    M.append_messages(df, F.col("n"), F.concat(F.lit("message\n"), F.col("n").cast("string")), folder, file_rows)


def run(spark, folder, root, seen, after=-1):
    def each(batch, batch_id):
        seen.append(sorted((r["seq"], r["body"]) for r in batch.collect()))

    R.drain_batches(M.message_stream(spark, folder, after), each, os.path.join(root, "checkpoint"))


def test_stop_and_resume(spark, tmp_path):
    folder, root, seen = str(tmp_path / "in"), str(tmp_path), []
    publish(spark, folder, range(40))
    run(spark, folder, root, seen)
    run(spark, folder, root, seen)  # nothing new
    publish(spark, folder, [60, 45, 45, 50])  # gaps, an equal number, out of order
    publish(spark, folder, [61])
    run(spark, folder, root, seen, after=1000)  # the checkpoint counts, not the option
    told = [(i, f"message\n{i}") for i in [*range(40), 45, 45, 50, 60, 61]]
    assert [b for b in seen if b] == [told[:40], told[40:]]
    assert len(M._files(folder)) > 5 and M.last_sequence(folder) == 61


def test_replay_from_a_number(spark, tmp_path):
    folder, seen = str(tmp_path / "in"), []
    publish(spark, folder, range(30))
    run(spark, folder, str(tmp_path / "one"), seen, after=17)
    run(spark, folder, str(tmp_path / "two"), seen, after=17)
    assert [[n for n, _ in b] for b in seen] == [list(range(18, 30))] * 2


def test_failed_batch_is_read_again(spark, tmp_path):
    folder, root, seen = str(tmp_path / "in"), str(tmp_path), []
    publish(spark, folder, range(20))

    def broken(batch, batch_id):
        raise ValueError("no")

    with pytest.raises(Exception, match="no"):
        R.drain_batches(M.message_stream(spark, folder), broken, os.path.join(root, "checkpoint"))
    publish(spark, folder, range(20, 25))
    run(spark, folder, root, seen)
    run(spark, folder, root, seen)
    # the planned batch comes again as it was, later messages in one of their own
    assert [[n for n, _ in b] for b in seen] == [list(range(20)), list(range(20, 25))]


def test_only_rising_numbers_are_published(spark, tmp_path):
    folder = str(tmp_path / "in")
    publish(spark, folder, [5, 6])
    publish(spark, folder, [])
    for bad in [[6], [3, 9]]:
        with pytest.raises(ValueError, match="last number in the folder 6"):
            publish(spark, folder, bad)
    none = spark.createDataFrame([(None,), (9,)], "n long")
    with pytest.raises(ValueError, match="1 messages without a number"):
        M.append_messages(none, F.col("n"), F.lit("x"), folder)
    assert M.last_sequence(folder) == 6 and M.last_sequence(str(tmp_path / "absent")) == -1


def test_absent_folder_then_messages(spark, tmp_path):
    folder, root, seen = str(tmp_path / "in"), str(tmp_path), []
    run(spark, folder, root, seen)
    publish(spark, folder, range(3))
    run(spark, folder, root, seen)
    assert [n for b in seen for n, _ in b] == [0, 1, 2]


def test_pages_read_only_their_parts(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": rng.permutation(5000), "x": rng.integers(0, 50, 5000).astype(float)})
    index = E.RankIndex(spark.createDataFrame(pdf), F.col("x"), "id", descending=True, part_rows=700)
    want = pdf.sort_values(["x", "id"], ascending=[False, True])["id"].tolist()
    most = index.parts.agg(F.max("n")).first()[0]
    assert most < 5000 and index.parts.count() > 4
    for start, end, overscan in [(0, 10, 5), (2480, 2530, 10), (4990, 5000, 5), (6000, 6010, 0), (30, 30, 0), (0, 5000, 0)]:
        page = index.page(start, end, overscan)
        first = max(0, start - overscan)
        got = page.collect()
        assert [r["id"] for r in got] == want[first : end + overscan]
        assert [r["place"] for r in got] == list(range(first, first + len(got)))
        if end - start < 100:
            assert len(index.parts_of(first, end + overscan)) <= 2
            assert "PartitionFilters: []" not in page._jdf.queryExecution().toString()


def test_null_and_equal_order(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0), (3, 3.0), (4, None), (5, 1.0)], "id int, x double")
    assert [r["id"] for r in E.page_window(df, F.col("x"), "id", 0, 9).collect()] == [1, 4, 5, 2, 3]
    assert [r["id"] for r in E.page_window(df, F.col("x"), "id", 0, 9, descending=True).collect()] == [2, 3, 5, 1, 4]
    assert E.page_window(df.filter("id > 9"), F.col("x"), "id", 0, 9).collect() == []


def test_open_windows_over_several_batches(spark, tmp_path):
    at = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(60) * 10, unit="min")
    for i in range(3):
        rows = spark.createDataFrame(pd.DataFrame({"at": at[20 * i : 20 * i + 20]})).coalesce(1)
        rows.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = R.drain_windows(S.window_counts(stream, "at", "1 hour", "30 minutes", "10 minutes"), "windows").collect()
    want = {}
    for t in at:
        for back in (0, 30):
            start = t.floor("30min") - pd.Timedelta(minutes=back)
            want[start] = want.get(start, 0) + 1
    passed = at[-1] - pd.Timedelta(minutes=10)
    assert {(r["w"]["start"], r["n"], r["closed"]) for r in got} == {(s.to_pydatetime(), n, s + pd.Timedelta(hours=1) <= passed) for s, n in want.items()}
    assert len(got) == len(want) and sum(not r["closed"] for r in got) == 2

"""Registered queries against their SQL: a spread of them by default, all with CHECK_ALL=1."""

import os

import check
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from bench import HEADLINE

NAMES = list(queries()) if os.environ.get("CHECK_ALL") else [n for n in HEADLINE if n in oracle_sql()]


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    assert set(HEADLINE) <= set(queries())


def test_no_query_makes_up_its_rows():
    assert "synthetic_slice" not in queries()


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["image_id", "label", "drift_score", "mean_distance", "threshold", "above_threshold"]
    assert df.count() == 3


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, small_sf, name):
    df = queries()[name](spark, small_sf)
    if name in oracle_sql():
        problem, _ = check.compare(df, check.connect(small_sf), oracle_sql()[name])
        assert problem is None, problem
    else:
        df.collect()


def test_workers_need_no_copy_of_the_package(spark, small_sf, tmp_path):
    """Started from a folder where workers cannot import the package, Python-backed queries still run."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {root!r}); from __spark_entry__ import queries; from pyspark.sql import SparkSession; "
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate(); "
        "print('rows', queries()['radius_join'](s, '/root/testdata/sf0.001').count())"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    wanted = queries()["radius_join"](spark, small_sf).count()
    assert f"rows {wanted}" in out.stdout, out.stderr[-2000:]

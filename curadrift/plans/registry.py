"""Where the plan modules put their queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

RUNNERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``run(spark, sf_dir)`` under ``name``, with DuckDB SQL where the result has one."""
    def keep(run):
        if name in RUNNERS:
            raise ValueError(f"query {name} registered twice")
        RUNNERS[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep

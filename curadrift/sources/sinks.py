"""Writing reports, issues and versions, and reading them back."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from curadrift.operators.reports import with_ids


def existing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at a path, or an empty one before the first write."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as missing:
        if "PATH_NOT_FOUND" in str(missing):
            return spark.createDataFrame([], schema)
        raise


def append_report(path: str, header: DataFrame, issues: DataFrame, issue_order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Append one header row and its issues, with ids after the ones already there; both partitioned by
    project. Issues are written first: a header without its issues is never seen."""
    spark = header.sparkSession
    headers_at, issues_at = os.path.join(path, "reports"), os.path.join(path, "issues")
    old_headers = existing(spark, headers_at, "report_id bigint, project string")
    old_issues = existing(spark, issues_at, "issue_id bigint, project string")
    head = with_ids(header, ["project"], old_headers, "report_id")
    rows = with_ids(issues, issue_order, old_issues, "issue_id")
    ids = head.select("project", "report_id")
    rows.join(ids, "project").write.mode("append").partitionBy("project").parquet(issues_at)
    head.write.mode("append").partitionBy("project").parquet(headers_at)
    return spark.read.parquet(headers_at), spark.read.parquet(issues_at)


def append_version(path: str, row: DataFrame) -> DataFrame:
    row.write.mode("append").parquet(path)
    return row.sparkSession.read.parquet(path)

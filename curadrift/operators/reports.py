"""Report headers, issues and alerts over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from curadrift.functions.rules import severity_rank
from curadrift.operators.entities import top_n_per_group
from curadrift.operators.ordered import indexed


def with_ids(df: DataFrame, order: list[str], existing: DataFrame | None = None, id_column: str = "id") -> DataFrame:
    """Consecutive ids in the given order, starting after the largest existing one."""
    numbered = indexed(df, [], order)
    if existing is None:
        return numbered.withColumnRenamed("idx", id_column)
    offset = existing.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("m"))
    return numbered.withColumn(id_column, F.col("idx") + offset.scalar()).drop("idx")


def report_max_severity(samples: DataFrame) -> DataFrame:
    """Per report its worst sample severity (at least low), sample count and time."""
    rank = F.greatest(severity_rank(F.col("severity")), F.lit(2))
    worst = samples.groupBy("report_id").agg(
        F.max(rank).alias("rank"), F.count(F.lit(1)).alias("samples"), F.max("seen_at").alias("seen_at")
    )
    names = F.array(F.lit("none"), F.lit("low"), F.lit("medium"), F.lit("high"), F.lit("critical"))
    return worst.select("report_id", F.element_at(names, F.col("rank")).alias("severity"), "samples", "seen_at")


def unresolved_issues(issues: DataFrame) -> DataFrame:
    """Unresolved, worst severity first, then newest."""
    return issues.filter(~F.col("is_resolved")).orderBy(severity_rank(F.col("severity")).desc(), F.desc("created_at"), "id")


def critical_issues(issues: DataFrame) -> DataFrame:
    return issues.filter((F.col("severity") == "critical") & ~F.col("is_resolved"))


def issues_for(issues: DataFrame, task_id: int | None = None, annotator_id: int | None = None) -> DataFrame:
    if task_id is not None:
        issues = issues.filter(F.col("task_id") == task_id)
    if annotator_id is not None:
        issues = issues.filter(F.col("annotator_id") == annotator_id)
    return issues


def issue_statistics(issues: DataFrame) -> DataFrame:
    return issues.groupBy("issue_type", "severity").agg(F.count(F.lit(1)).alias("n"))


def resolve_issues(issues: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Stamp the first resolution (id, user, at, note) on its issue."""
    first = resolutions.groupBy("id").agg(F.min_by(F.struct("user", "at"), "at").alias("r"))
    return issues.join(first, "id", "left").withColumns({
        "is_resolved": F.col("is_resolved") | F.col("r").isNotNull(),
        "resolved_by": F.col("r.user"), "resolved_at": F.col("r.at"),
    }).drop("r")


def list_reports(reports: DataFrame, project: str | None = None, report_type: str | None = None) -> DataFrame:
    if project is not None:
        reports = reports.filter(F.col("project") == project)
    if report_type is not None:
        reports = reports.filter(F.col("report_type") == report_type)
    return reports.orderBy(F.desc("created_at"), "report_id")


def latest_report(reports: DataFrame) -> DataFrame:
    """Newest report per project."""
    row = F.struct(*[c for c in reports.columns if c != "project"])
    return reports.groupBy("project").agg(F.max_by(row, F.struct("created_at", "report_id")).alias("r")).select("project", "r.*")


def score_trend(reports: DataFrame, n: int = 10) -> DataFrame:
    """Per project the last n scores, newest first, as an array."""
    last = top_n_per_group(reports, ["project"], [F.col("created_at").desc(), F.col("report_id").desc()], n)
    listed = F.sort_array(F.collect_list(F.struct("created_at", "report_id", "overall_score")), asc=False)
    return last.groupBy("project").agg(F.transform(listed, lambda s: s["overall_score"]).alias("scores"))


def top_issues(issues: DataFrame, n: int = 10) -> DataFrame:
    """The n worst issues of each project."""
    return top_n_per_group(issues, ["project"], [severity_rank(F.col("severity")).desc(), F.col("id").asc()], n)


def dashboard_leaders(annotators: DataFrame, labels: DataFrame, n: int = 10) -> DataFrame:
    """The dashboard's two lists: (list, rank, name, value) of the ``n`` best annotators (``annotator_id``, ``quality_score``) and the ``n`` most
    used labels (``label``, ``usage``), ties by name."""
    def first(df: DataFrame, name: str, value: str, listed: str) -> DataFrame:
        rows = df.select(F.lit(listed).alias("list"), F.col(name).alias("key"), F.col(name).cast("string").alias("name"), F.col(value).cast("double").alias("value"))
        top = rows.orderBy(F.desc("value"), "key").limit(n)
        return top.withColumn("rank", F.row_number().over(Window.partitionBy("list").orderBy(F.desc("value"), "key"))).drop("key")

    return first(annotators, "annotator_id", "quality_score", "annotators").unionByName(first(labels, "label", "usage", "labels"))


def quality_dashboard(reports: DataFrame, issues: DataFrame, n: int = 10) -> DataFrame:
    """Per project the latest report, its issue counts by severity and resolution, and the score trend."""
    head = latest_report(reports).select("project", "report_id", "overall_score", "created_at")
    names = ["critical", "high", "medium", "low"]
    counted = issues.groupBy("report_id").agg(
        F.count(F.lit(1)).alias("total_issues"), *[F.count_if(F.col("severity") == s).alias(f"{s}_issues") for s in names],
        F.count_if("is_resolved").alias("resolved_issues"),
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in ["total_issues", *[f"{s}_issues" for s in names], "resolved_issues"]}
    return head.join(counted, "report_id", "left").withColumns(zero).join(score_trend(reports, n), "project")


def comparison_report(reports: DataFrame, now, days: int = 30) -> DataFrame:
    """Per project first against last report of the period; projects with fewer than two are left out."""
    age = F.timestamp_diff("SECOND", F.col("created_at"), now)
    recent = reports.filter((age <= days * 86400) & (age >= 0))
    picked = F.struct("overall_score", "issue_count")
    order = F.struct("created_at", "report_id")
    ends = recent.groupBy("project").agg(
        F.count(F.lit(1)).alias("report_count"), F.min_by(picked, order).alias("a"), F.max_by(picked, order).alias("z")
    ).filter("report_count > 1")
    change = F.col("z.overall_score") - F.col("a.overall_score")
    return ends.select(
        "project", "report_count", change.alias("score_change"), (F.col("z.issue_count") - F.col("a.issue_count")).alias("issue_change"),
        F.col("z.overall_score").alias("current_score"), F.col("a.overall_score").alias("previous_score"),
        F.when(change > 0, "improving").when(change < 0, "declining").otherwise("stable").alias("trend"),
    )

"""Queries for entity tables, reports and issues."""

from pyspark.sql import functions as F

from curadrift.functions.numbers import r6
from curadrift.functions.rules import severity_from_distance
from curadrift.operators import entities as E, reports as R
from curadrift.plans.ctes import sql
from curadrift.plans.registry import query
from curadrift.session import fresh_path
from curadrift.sources import sinks
from curadrift.sources.tables import ntz, points, table, weekly_reports

SEV = "CASE WHEN value / 500 < 0.05 THEN 'none' WHEN value / 500 < 0.1 THEN 'low' WHEN value / 500 < 0.2 THEN 'medium' WHEN value / 500 < 0.5 THEN 'high' ELSE 'critical' END"
ENT = f"SELECT event_id AS sample_id, user_id AS report_id, event_type AS label, user_id % 7 AS label_id, value > 100 AS is_drift, value AS isolation_score, {SEV} AS severity, ts AS seen_at, event_id AS seq FROM events"
RANK = "list_position(['none', 'low', 'medium', 'high', 'critical'], severity)"


def entities(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").alias("sample_id"), F.col("user_id").alias("report_id"), F.col("event_type").alias("label"),
        (F.col("user_id") % 7).alias("label_id"), (F.col("value") > 100).alias("is_drift"), F.col("value").alias("isolation_score"),
        severity_from_distance(F.col("value") / 500).alias("severity"), F.col("ts").alias("seen_at"), F.col("event_id").alias("seq"),
    )


def reports_of(ents):
    return ents.groupBy("report_id").agg(F.max("seen_at").alias("seen_at"), F.max("seq").alias("seq"))


@query("dataset_stats", sql("SELECT count(*) AS total_samples, count(*) FILTER (WHERE is_drift) AS drift_count, round(avg(isolation_score), 6) AS mean_isolation, greatest(max(isolation_score), 0) AS max_isolation FROM ent", ent=ENT))
def dataset_stats(spark, sf):
    return E.dataset_stats(entities(spark, sf)).withColumn("mean_isolation", r6(F.col("mean_isolation")))


@query("dataset_label_counts", sql("SELECT label_id, count(*) AS n FROM ent GROUP BY 1", ent=ENT))
def dataset_label_counts(spark, sf):
    return entities(spark, sf).groupBy("label_id").agg(F.count(F.lit(1)).alias("n"))


@query("entity_counts", "SELECT 'samples' AS entity, count(*) AS n FROM events UNION ALL SELECT 'reports', count(DISTINCT user_id) FROM events UNION ALL SELECT 'review_logs', count(*) FROM labels")
def entity_counts(spark, sf):
    ents = entities(spark, sf)
    return E.entity_counts(samples=ents, reports=reports_of(ents), review_logs=table(spark, sf, "labels"))


@query("report_max_severity", sql("SELECT report_id, ['none', 'low', 'medium', 'high', 'critical'][greatest(max(" + RANK + "), 2)] AS severity, count(*) AS samples, max(seen_at) AS seen_at FROM ent GROUP BY 1", ent=ENT))
def report_max_severity(spark, sf):
    return R.report_max_severity(entities(spark, sf))


@query("enrich_points", sql("SELECT sample_id, coalesce(CAST(m.label AS VARCHAR), e.label) AS label, coalesce(m.label, e.label_id) AS label_id FROM ent e LEFT JOIN embeddings m ON m.vec_id = e.sample_id", ent=ENT))
def enrich_points(spark, sf):
    p = points(spark, sf).select(F.col("id").alias("sample_id"), "label", F.col("label").cast("bigint").alias("label_id"))
    return E.enrich_points(entities(spark, sf).select("sample_id", "label", "label_id"), p)


def listed_reports(spark, sf):
    """A report per event naming three samples, one of them unknown."""
    e = F.col("event_id")
    return table(spark, sf, "events").select(e.alias("report_id"), F.array(e + 1, e, e + 1000000000).alias("sample_ids"))


@query("report_samples", "SELECT a.event_id AS report_id, 0 AS pos, b.event_id AS sample_id, b.event_type AS label FROM events a JOIN events b ON b.event_id = a.event_id + 1 UNION ALL SELECT event_id, 1, event_id, event_type FROM events")
def report_samples(spark, sf):
    return E.report_samples(listed_reports(spark, sf), entities(spark, sf).select("sample_id", "report_id", "label"))


def quiet_reports(ents):
    return ents.groupBy("report_id").agg(F.avg("isolation_score").alias("m")).filter("m < 70")


@query("remove_report", sql("SELECT report_id, count(*) AS samples FROM ent WHERE report_id NOT IN (SELECT report_id FROM ent GROUP BY 1 HAVING avg(isolation_score) < 70) GROUP BY 1", ent=ENT))
def remove_report(spark, sf):
    ents = entities(spark, sf)
    reports, samples = E.remove_reports(reports_of(ents), ents, quiet_reports(ents))
    return reports.join(samples.groupBy("report_id").agg(F.count(F.lit(1)).alias("samples")), "report_id").select("report_id", "samples")


@query("review_logs_for_report", sql("SELECT seq AS log_id, report_id FROM ent WHERE report_id IN (SELECT report_id FROM ent GROUP BY 1 HAVING avg(isolation_score) < 70)", ent=ENT))
def review_logs_for_report(spark, sf):
    ents = entities(spark, sf)
    return E.review_logs_for(ents.select(F.col("seq").alias("log_id"), "report_id"), quiet_reports(ents))


@query("mark_needs_review", sql("SELECT sample_id, label || CASE WHEN is_drift OR label_id = 3 THEN ',needs_review' ELSE '' END AS tags, is_drift AND label_id <> 3 AS marked FROM ent", ent=ENT))
def mark_needs_review(spark, sf):
    ents = entities(spark, sf)
    tags = F.when(F.col("label_id") == 3, F.array("label", F.lit("needs_review"))).otherwise(F.array("label"))
    out = E.mark_needs_review(ents.select("sample_id", tags.alias("tags")), ents.filter("is_drift"))
    return out.withColumn("tags", F.array_join("tags", ","))


@query("mark_needs_review_count", sql("SELECT count(*) FILTER (WHERE is_drift AND label_id <> 3) AS marked, count(*) FILTER (WHERE is_drift) AS drifted FROM ent", ent=ENT))
def mark_needs_review_count(spark, sf):
    ents = entities(spark, sf)
    tags = F.when(F.col("label_id") == 3, F.array("label", F.lit("needs_review"))).otherwise(F.array("label"))
    out = E.mark_needs_review(ents.select("sample_id", "is_drift", tags.alias("tags")), ents.filter("is_drift"))
    return out.agg(F.count_if("marked").alias("marked"), F.count_if("is_drift").alias("drifted"))


@query("merge_samples", "SELECT user_id AS sample_id, max(event_id) AS seq, arg_max(event_type, event_id) AS label, arg_max(value, event_id) AS isolation_score FROM events GROUP BY 1")
def merge_samples(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("sample_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("label"), F.col("value").alias("isolation_score"), "ts"
    )
    half = ntz("2024-01-16 00:00:00")
    return E.merge_samples(rows.filter(F.col("ts") < half).drop("ts"), rows.filter(F.col("ts") >= half).drop("ts"))


@query("report_order", "SELECT user_id AS report_id, max(event_id) AS latest_seq FROM events GROUP BY 1")
def report_order(spark, sf):
    return E.report_order(entities(spark, sf))


@query("merge_review_log", (
    "SELECT user_id AS log_id, arg_max(value, event_id) FILTER (WHERE event_type <> 'error') AS time_ms, arg_max(event_type, event_id) FILTER (WHERE value > 100) AS status, min(event_id) AS first_seq FROM events "
    "WHERE user_id NOT IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) > 75) GROUP BY 1"))
def merge_review_log(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("log_id"), F.when(F.col("event_type") != "error", F.col("value")).alias("time_ms"),
        F.when(F.col("value") > 100, F.col("event_type")).alias("status"), F.col("event_id").alias("seq"), "ts",
    )
    half = ntz("2024-01-16 00:00:00")
    gone = rows.groupBy("log_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 75")
    return E.merge_partial(rows.filter(F.col("ts") < half).drop("ts"), rows.filter(F.col("ts") >= half).drop("ts"), "log_id", removed=gone)


@query("toggle_selection", "SELECT id FROM (SELECT DISTINCT user_id AS id FROM events WHERE event_type = 'click' UNION ALL SELECT user_id FROM events WHERE event_type = 'error') GROUP BY 1 HAVING count(*) % 2 = 1")
def toggle_selection(spark, sf):
    events = table(spark, sf, "events").withColumnRenamed("user_id", "id")
    return E.toggle_selection(events.filter("event_type = 'click'").select("id").distinct(), events.filter("event_type = 'error'"))


@query("user_decision_update", (
    "SELECT e.event_id AS log_id, coalesce(d.decision, CASE WHEN e.value > 300 THEN 'rejected' END) AS user_decision, CASE WHEN d.k IS NOT NULL THEN d.reason WHEN e.value > 300 THEN 'too far' END AS rejection_reason FROM events e LEFT JOIN "
    "(SELECT user_id AS k, CASE WHEN arg_max(value, event_id) > 80 THEN 'rejected' ELSE 'accepted' END AS decision, CASE WHEN arg_max(value, event_id) > 80 THEN arg_max(event_type, event_id) END AS reason FROM events GROUP BY 1) d ON d.k = e.event_id"))
def user_decision_update(spark, sf):
    events = table(spark, sf, "events")
    far = F.col("value") > 300
    logs = events.select(
        F.col("event_id").alias("log_id"), F.when(far, "rejected").alias("user_decision"), F.when(far, "too far").alias("rejection_reason")
    )
    no = F.col("value") > 80
    decisions = events.select(
        F.col("user_id").alias("log_id"), F.when(no, "rejected").otherwise("accepted").alias("decision"),
        F.when(no, F.col("event_type")).alias("reason"), F.col("event_id").alias("seq"),
    )
    return E.apply_decisions(logs, decisions)


@query("keep_newest_reports", "SELECT user_id AS report_id, min(event_id) AS seq, arg_min(value, event_id) AS isolation_score FROM events GROUP BY 1 ORDER BY min(event_id) DESC LIMIT 100")
def keep_newest_reports(spark, sf):
    return E.keep_newest(entities(spark, sf).select("report_id", "seq", "isolation_score"), "report_id", "seq", 100)


@query("sort_by_column", "SELECT event_id AS sample_id, value AS isolation_score, row_number() OVER (ORDER BY value DESC, event_id) AS place FROM events")
def sort_by_column(spark, sf):
    from curadrift.operators.ordered import indexed
    # the sorted table itself has no row numbers; they are added here so that the order can be checked
    ents = entities(spark, sf).select("sample_id", "isolation_score", (-F.col("isolation_score")).alias("falling"))
    return indexed(ents, [], ["falling", "sample_id"]).drop("falling").withColumnRenamed("idx", "place")


@query("page_window", "SELECT event_id AS sample_id, value AS isolation_score FROM events ORDER BY value DESC, event_id LIMIT 60 OFFSET 95")
def page_window(spark, sf):
    return E.page_window(entities(spark, sf).select("sample_id", "isolation_score"), F.col("isolation_score"), "sample_id", 100, 150, overscan=5, descending=True)


@query("page_window_deep", (
    "SELECT sample_id, isolation_score, place FROM (SELECT event_id AS sample_id, value AS isolation_score, row_number() OVER (ORDER BY value DESC, event_id) - 1 AS place, count(*) OVER () AS n FROM events) "
    "WHERE place >= n // 2 AND place < n // 2 + 50 OR place >= n - 20"))
def page_window_deep(spark, sf):
    """A page in the middle and the last one, from one index."""
    rows = entities(spark, sf).select("sample_id", "isolation_score")
    n, index = rows.count(), E.RankIndex(rows, F.col("isolation_score"), "sample_id", descending=True)
    return index.page(n // 2, n // 2 + 50).unionByName(index.page(n - 20, n))


# ---- reports and issues ------------------------------------------------------------------

ISS = (
    f"SELECT event_id AS id, event_type || '-' || CAST(datediff('minute', TIMESTAMP '2024-01-01', ts) // 10080 AS VARCHAR) AS report_id, event_type AS project, event_id // 5 AS task_id, user_id % 12 AS annotator_id, "
    f"CASE WHEN value > 250 THEN 'speed_anomaly' ELSE 'outlier' END AS issue_type, {SEV} AS severity, ts AS created_at, user_id % 3 = 0 AS is_resolved FROM events WHERE value > 100"
)


def issues(spark, sf):
    week = F.floor(F.timestamp_diff("DAY", ntz("2024-01-01 00:00:00"), F.col("ts")) / 7)
    return table(spark, sf, "events").filter("value > 100").select(
        F.col("event_id").alias("id"), F.concat_ws("-", "event_type", week.cast("string")).alias("report_id"), F.col("event_type").alias("project"),
        F.floor(F.col("event_id") / 5).alias("task_id"), (F.col("user_id") % 12).alias("annotator_id"),
        F.when(F.col("value") > 250, "speed_anomaly").otherwise("outlier").alias("issue_type"),
        severity_from_distance(F.col("value") / 500).alias("severity"), F.col("ts").alias("created_at"), (F.col("user_id") % 3 == 0).alias("is_resolved"),
    )


@query("unresolved_issues", sql("SELECT id, severity, created_at FROM iss WHERE NOT is_resolved ORDER BY " + RANK + " DESC, created_at DESC, id", iss=ISS))
def unresolved_issues(spark, sf):
    return R.unresolved_issues(issues(spark, sf)).select("id", "severity", "created_at")


@query("critical_issues", sql("SELECT id, project, task_id FROM iss WHERE severity = 'critical' AND NOT is_resolved", iss=ISS))
def critical_issues(spark, sf):
    return R.critical_issues(issues(spark, sf)).select("id", "project", "task_id")


@query("issues_for_annotator", sql("SELECT id, severity FROM iss WHERE annotator_id = 4", iss=ISS))
def issues_for_annotator(spark, sf):
    return R.issues_for(issues(spark, sf), annotator_id=4).select("id", "severity")


@query("issue_statistics", sql("SELECT issue_type, severity, count(*) AS n FROM iss GROUP BY 1, 2", iss=ISS))
def issue_statistics(spark, sf):
    return R.issue_statistics(issues(spark, sf))


@query("resolve_issues", sql("SELECT id, is_resolved OR l.doc_id IS NOT NULL AS is_resolved, CASE WHEN l.doc_id IS NOT NULL THEN 'user-' || quality END AS resolved_by, CASE WHEN l.doc_id IS NOT NULL THEN TIMESTAMP '2024-02-01' END AS resolved_at FROM iss LEFT JOIN labels l ON l.doc_id = id", iss=ISS))
def resolve_issues(spark, sf):
    resolutions = table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("user-"), F.col("quality").cast("string")).alias("user"), ntz("2024-02-01").alias("at")
    )
    return R.resolve_issues(issues(spark, sf), resolutions).select("id", "is_resolved", "resolved_by", "resolved_at")


@query("report_listing", sql("SELECT report_id, created_at, overall_score FROM weekly WHERE report_type = 'scheduled'", "weekly"))
def report_listing(spark, sf):
    return R.list_reports(weekly_reports(spark, sf), report_type="scheduled").select("report_id", "created_at", "overall_score")


@query("latest_report", sql("SELECT project, arg_max(report_id, created_at) AS report_id, max(created_at) AS created_at FROM weekly GROUP BY 1", "weekly"))
def latest_report(spark, sf):
    return R.latest_report(weekly_reports(spark, sf)).select("project", "report_id", "created_at")


def joined_scores():
    return F.array_join(F.transform("scores", lambda s: F.format_string("%.4f", s)), ";").alias("scores")


TREND = "SELECT project, string_agg(format('{:.4f}', overall_score), ';' ORDER BY created_at DESC) AS scores FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY created_at DESC) AS rn FROM weekly) WHERE rn <= 10 GROUP BY 1"


@query("score_trend", sql(TREND, "weekly"))
def score_trend(spark, sf):
    return R.score_trend(weekly_reports(spark, sf)).select("project", joined_scores())


@query("quality_dashboard", sql(
    "SELECT h.project, h.report_id, h.overall_score, h.created_at, count(i.id) AS total_issues, count(*) FILTER (WHERE severity = 'critical') AS critical_issues, count(*) FILTER (WHERE severity = 'high') AS high_issues, "
    "count(*) FILTER (WHERE severity = 'medium') AS medium_issues, count(*) FILTER (WHERE severity = 'low') AS low_issues, count(*) FILTER (WHERE is_resolved) AS resolved_issues, any_value(t.scores) AS scores FROM h LEFT JOIN iss i ON i.report_id = h.report_id JOIN tr t ON t.project = h.project GROUP BY ALL",
    "weekly", iss=ISS, h="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY created_at DESC) AS rn FROM weekly) WHERE rn = 1", tr=TREND))
def quality_dashboard(spark, sf):
    out = R.quality_dashboard(weekly_reports(spark, sf), issues(spark, sf))
    return out.select(*[c for c in out.columns if c != "scores"], joined_scores())


@query("top_issues", sql("SELECT project, id, severity FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY " + RANK + " DESC, id) AS rn FROM iss) WHERE rn <= 10", iss=ISS))
def top_issues(spark, sf):
    return R.top_issues(issues(spark, sf)).select("project", "id", "severity")


@query("comparison_report", sql(
    "SELECT project, count(*) AS report_count, round(arg_max(overall_score, created_at) - arg_min(overall_score, created_at), 6) + 0.0 AS score_change, arg_max(issue_count, created_at) - arg_min(issue_count, created_at) AS issue_change, "
    "arg_max(overall_score, created_at) AS current_score, arg_min(overall_score, created_at) AS previous_score, CASE WHEN arg_max(overall_score, created_at) > arg_min(overall_score, created_at) THEN 'improving' WHEN arg_max(overall_score, created_at) < arg_min(overall_score, created_at) THEN 'declining' ELSE 'stable' END AS trend "
    "FROM weekly WHERE created_at BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-02-01' GROUP BY 1 HAVING count(*) > 1", "weekly"))
def comparison_report(spark, sf):
    out = R.comparison_report(weekly_reports(spark, sf), ntz("2024-02-01 00:00:00"))
    return out.withColumn("score_change", r6(F.col("score_change")))


@query("report_sinks", sql(
    "SELECT i.project, r.report_id, row_number() OVER (ORDER BY i.id) AS issue_id, i.id, i.severity FROM iss i JOIN (SELECT project, row_number() OVER (ORDER BY project) AS report_id FROM (SELECT DISTINCT project FROM weekly)) r USING (project)", "weekly", iss=ISS))
def report_sinks(spark, sf):
    path = fresh_path(spark, "report-sink")
    headers = R.latest_report(weekly_reports(spark, sf)).select("project", "overall_score", "created_at")
    found = issues(spark, sf).select("project", "id", "severity")
    _, written = sinks.append_report(path, headers, found, ["id"])
    return written.select("project", "report_id", "issue_id", "id", "severity")

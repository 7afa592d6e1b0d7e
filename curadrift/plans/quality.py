"""Queries for annotation quality."""

from pyspark.sql import functions as F

from curadrift.functions.numbers import r6
from curadrift.operators import agreement as A, quality as Q
from curadrift.plans.ctes import sql
from curadrift.plans.registry import query
from curadrift.sources.tables import annotations, tasks

# The SQL side computes kappa from pair rows; the Spark side never builds them.
PAIR_SQL = {
    "pr": "SELECT a1, a2, count(*) AS shared, count(*) FILTER (WHERE l1 = l2) AS agreed FROM pairs GROUP BY 1, 2",
    "m1": "SELECT a1, a2, l1 AS l, count(*) AS n FROM pairs GROUP BY 1, 2, 3",
    "m2": "SELECT a1, a2, l2 AS l, count(*) AS n FROM pairs GROUP BY 1, 2, 3",
    "pe": "SELECT m1.a1, m1.a2, sum(m1.n * m2.n) AS x FROM m1 JOIN m2 ON m1.a1 = m2.a1 AND m1.a2 = m2.a2 AND m1.l = m2.l GROUP BY 1, 2",
    "kp": "SELECT pr.*, agreed / shared AS rate, CASE WHEN coalesce(x, 0) <> shared * shared THEN (agreed / shared - coalesce(x, 0) / (shared * shared)) / (1 - coalesce(x, 0) / (shared * shared)) END AS kappa FROM pr LEFT JOIN pe USING (a1, a2)",
}
ISSUE_SEVERITY = "count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low"


def rounded(df, *names):
    return df.withColumns({n: r6(F.col(n)) for n in names})


def tallied(issues):
    return issues.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ["high", "medium", "low"]])


@query("last_labels", sql("SELECT * FROM last_labels", "last_labels"))
def last_labels(spark, sf):
    return A.last_labels(annotations(spark, sf))


@query("annotator_pairs", sql("SELECT a1, a2, l1, l2, count(*) AS n FROM pairs GROUP BY ALL", "pairs"))
def annotator_pairs(spark, sf):
    return A.pair_label_counts(annotations(spark, sf))


@query("annotator_pairs_blocks", sql("SELECT a1, a2, l1, l2, count(*) AS n FROM pairs GROUP BY ALL", "pairs"))
def annotator_pairs_blocks(spark, sf):
    return A.pair_label_counts(annotations(spark, sf), join_annotators=3)


@query("cohen_kappa_pairs", sql("SELECT a1, a2, shared, agreed, round(rate, 6) AS rate, round(kappa, 6) + 0.0 AS kappa FROM kp", "pairs", **PAIR_SQL))
def cohen_kappa_pairs(spark, sf):
    return rounded(A.pair_agreement(A.pair_label_counts(annotations(spark, sf))), "rate", "kappa")


@query("mean_kappa", sql("SELECT round(avg(kappa), 6) + 0.0 AS kappa, count(*) AS pairs, count(kappa) AS defined FROM kp", "pairs", **PAIR_SQL))
def mean_kappa(spark, sf):
    return rounded(A.mean_kappa(A.pair_agreement(A.pair_label_counts(annotations(spark, sf)))), "kappa")


@query("percent_agreement", sql(
    "SELECT count(*) AS tasks, round(avg(CASE WHEN d = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS percent_agreement FROM (SELECT task_id, count(*) AS k, count(DISTINCT label) AS d FROM last_labels GROUP BY 1) WHERE k > 1", "last_labels"))
def percent_agreement(spark, sf):
    return rounded(A.percent_agreement(annotations(spark, sf)), "percent_agreement")


@query("agreement_matrix", sql(
    "SELECT a1, a2, round(rate, 6) AS rate FROM (SELECT a1, a2, rate FROM kp UNION ALL SELECT a2, a1, rate FROM kp UNION ALL SELECT DISTINCT annotator_id, annotator_id, 1.0::DOUBLE FROM annotations)", "pairs", **PAIR_SQL))
def agreement_matrix(spark, sf):
    notes = annotations(spark, sf)
    return rounded(A.agreement_matrix(notes, A.pair_agreement(A.pair_label_counts(notes))), "rate")


INTRA = "SELECT annotator_id, count(*) AS n, count(*) FILTER (WHERE p <> label) AS changes FROM (SELECT *, lag(label) OVER (PARTITION BY annotator_id ORDER BY created_at, id) AS p FROM annotations) GROUP BY 1"


@query("intra_annotator_consistency", sql("SELECT annotator_id, n, changes, round(CASE WHEN n < 2 THEN 1.0 ELSE 1 - changes / (n - 1) END, 6) AS consistency FROM intra", "annotations", intra=INTRA))
def intra_annotator_consistency(spark, sf):
    return rounded(A.intra_annotator_consistency(annotations(spark, sf)), "consistency")


K = "SELECT avg(kappa) AS k FROM kp"


@query("consistency_dimension", sql(
    "SELECT 'consistency' AS dimension, round(greatest(0, least(1, k)), 6) + 0.0 AS score, CASE WHEN k < 0.7 THEN 1 ELSE 0 END AS n_issues, CASE WHEN k < 0.7 THEN 'Review annotation guidelines for clarity; Consider additional annotator training' ELSE '' END AS recommendations FROM km",
    "pairs", **PAIR_SQL, km=K))
def consistency_dimension(spark, sf):
    return listed(Q.consistency_dimension(annotations(spark, sf)))


def listed(dimensions):
    return dimensions.select(
        "dimension", r6(F.col("score")).alias("score"), F.size("issues").alias("n_issues"),
        F.array_join("recommendations", "; ").alias("recommendations"),
    )


TASK_LABELS = "SELECT task_id, count(*) AS n, count(DISTINCT label) AS d, array_to_string(list_sort(list_distinct(list(label))), ', ') AS ll FROM annotations GROUP BY 1"


@query("task_consistency", sql(
    "SELECT task_id, CASE WHEN d > 2 THEN 'high' ELSE 'medium' END AS severity, d AS labels, n AS annotations, ll AS label_list FROM tl WHERE n > 1 AND d > 1", "annotations", tl=TASK_LABELS))
def task_consistency(spark, sf):
    bad = Q.task_label_sets(annotations(spark, sf)).filter("annotations > 1 AND labels > 1")
    return bad.withColumn("severity", F.when(F.col("labels") > 2, "high").otherwise("medium"))


@query("consistency_assessor", sql(
    "SELECT 'consistency' AS assessor, round(1 - count(*) FILTER (WHERE d > 1) / count(*), 6) AS score, count(*) FILTER (WHERE d > 2) AS high, count(*) FILTER (WHERE d = 2) AS medium, 0 AS low FROM tl", "annotations", tl=TASK_LABELS))
def consistency_assessor(spark, sf):
    return one_line(Q.assess_consistency(tasks(spark, sf), annotations(spark, sf)))


def one_line(result):
    score, issues = result
    return score.withColumn("score", r6(F.col("score"))).withColumn("c", tallied(issues).select(F.struct("*")).scalar()).select("assessor", "score", "c.*")


@query("pairwise_agreement", sql(
    "SELECT 'agreement' AS assessor, round(avg(rate), 6) AS score, count(*) FILTER (WHERE rate < 0.3) AS high, count(*) FILTER (WHERE rate >= 0.3 AND rate < 0.5) AS medium, 0 AS low FROM kp", "pairs", **PAIR_SQL))
def pairwise_agreement(spark, sf):
    return one_line(Q.assess_agreement(tasks(spark, sf), annotations(spark, sf)))


TC = "SELECT t.id AS task_id, count(a.id) AS n FROM tasks t LEFT JOIN annotations a ON a.task_id = t.id GROUP BY 1"


@query("coverage_metrics", sql(
    "SELECT count(*) AS tasks, count(*) FILTER (WHERE n > 0) AS annotated, round(count(*) FILTER (WHERE n > 0) / count(*), 6) AS task_coverage, round(avg(least(n / 5, 1)), 6) AS avg_annotation_coverage, round(count(*) FILTER (WHERE n >= 5) / count(*), 6) AS full_coverage_rate FROM tc",
    "tasks", tc=TC))
def coverage_metrics(spark, sf):
    return rounded(Q.coverage_metrics(tasks(spark, sf), annotations(spark, sf), 5), "task_coverage", "avg_annotation_coverage", "full_coverage_rate")


@query("completeness_dimension", sql(
    "SELECT 'completeness' AS dimension, round((c + v) / 2, 6) AS score, CASE WHEN c < 0.95 THEN 1 ELSE 0 END + CASE WHEN f < 0.8 THEN 1 ELSE 0 END AS n_issues, "
    "array_to_string(list_filter([CASE WHEN c < 0.95 THEN 'Prioritize annotation of remaining tasks' END, CASE WHEN f < 0.8 THEN 'Increase annotations per task for better quality' END], lambda x: x IS NOT NULL), '; ') AS recommendations "
    "FROM (SELECT count(*) FILTER (WHERE n > 0) / count(*) AS c, avg(least(n / 6, 1)) AS v, count(*) FILTER (WHERE n >= 6) / count(*) AS f FROM tc)", "tasks", tc=TC))
def completeness_dimension(spark, sf):
    return listed(Q.completeness_dimension(tasks(spark, sf), annotations(spark, sf), 6))


@query("completeness_assessor", sql(
    "SELECT tasks, annotated, annotations, insufficient, round(annotated / tasks, 6) AS coverage, round(annotations / annotated, 6) AS density, round(0.7 * annotated / tasks + 0.3 * least(1, annotations / annotated / 6), 6) AS score "
    "FROM (SELECT count(*) AS tasks, count(*) FILTER (WHERE n > 0) AS annotated, CAST(sum(n) AS BIGINT) AS annotations, count(*) FILTER (WHERE n > 0 AND n < 6) AS insufficient FROM tc)", "tasks", tc=TC))
def completeness_assessor(spark, sf):
    return rounded(Q.completeness_counts(tasks(spark, sf), annotations(spark, sf), 6), "coverage", "density", "score")


@query("majority_vote", sql("SELECT task_id, label AS majority, votes FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY n DESC, label) AS rn, CAST(sum(n) OVER (PARTITION BY task_id) AS BIGINT) AS votes FROM (SELECT task_id, label, count(*) AS n FROM annotations GROUP BY 1, 2)) WHERE rn = 1", "annotations"))
def majority_vote(spark, sf):
    return Q.majority_vote(annotations(spark, sf))


TRUTH = "SELECT task_id, arg_min(label, (-n, label)) AS truth FROM (SELECT task_id, label, count(*) AS n FROM annotations WHERE annotator_id < 4 GROUP BY 1, 2) GROUP BY 1"
MACRO = {
    "pt": "SELECT a.label AS predicted, t.truth FROM annotations a JOIN tr t USING (task_id) WHERE annotator_id >= 4",
    "ll": "SELECT predicted AS l FROM pt UNION SELECT truth FROM pt",
    "lm": "SELECT l, (SELECT count(*) FROM pt WHERE predicted = l AND truth = l) AS tp, (SELECT count(*) FROM pt WHERE predicted = l) AS said, (SELECT count(*) FROM pt WHERE truth = l) AS was FROM ll",
    "lf": "SELECT l, CASE WHEN said > 0 THEN tp / said ELSE 0 END AS p, CASE WHEN was > 0 THEN tp / was ELSE 0 END AS r FROM lm",
}


def truth_labels(notes):
    return Q.majority_vote(notes.filter("annotator_id < 4")).select("task_id", F.col("majority").alias("truth"))


@query("accuracy_macro", sql(
    "SELECT round((SELECT avg(CASE WHEN predicted = truth THEN 1.0::DOUBLE ELSE 0 END) FROM pt), 6) AS exact_match, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS f1, count(*) AS labels FROM lf",
    "annotations", tr=TRUTH, **MACRO))
def accuracy_macro(spark, sf):
    notes = annotations(spark, sf)
    pairs = notes.filter("annotator_id >= 4").join(truth_labels(notes), "task_id").select(F.col("label").alias("predicted"), "truth")
    return rounded(Q.accuracy_macro(pairs), "exact_match", "precision", "recall", "f1")


DELAY = "SELECT datediff('microsecond', t.created_at, f.first_at) / 3.6e9 AS d FROM tasks t JOIN first_at f ON f.task_id = t.id"


@query("timeliness", sql("SELECT round(avg(d), 6) AS avg_delay_hours, round(max(d), 6) AS max_delay_hours, round(avg(CASE WHEN d <= 24 THEN 1.0::DOUBLE ELSE 0 END), 6) AS on_time_rate, count(*) AS num_tasks FROM dl", "tasks", dl=DELAY))
def timeliness(spark, sf):
    return rounded(Q.timeliness(tasks(spark, sf), annotations(spark, sf)), "avg_delay_hours", "max_delay_hours", "on_time_rate")


SPEED = "SELECT id, task_id, annotator_id, lead_time, abs(lead_time - m) / s AS z FROM annotations, (SELECT avg(lead_time) AS m, stddev_pop(lead_time) AS s FROM annotations WHERE lead_time > 0) WHERE lead_time > 0 AND abs(lead_time - m) / s > 3"


@query("speed_anomalies", sql("SELECT id, task_id, annotator_id, lead_time, round(z, 6) AS z_score, CASE WHEN z > 5 THEN 'high' ELSE 'medium' END AS severity FROM sp", "annotations", sp=SPEED))
def speed_anomalies(spark, sf):
    return Q.speed_anomalies(annotations(spark, sf)).select("id", "task_id", "annotator_id", "lead_time", r6(F.col("z_score")).alias("z_score"), "severity")


GAPS = {
    "ov": "SELECT label, count(*) / (SELECT count(*) FROM annotations) AS o FROM annotations GROUP BY 1",
    "an": "SELECT annotator_id, count(*) AS size FROM annotations GROUP BY 1",
    "ow": "SELECT annotator_id, label, count(*) AS n FROM annotations GROUP BY 1, 2",
    "gp": "SELECT an.annotator_id, size, max(abs(o - coalesce(n, 0) / size)) AS g FROM an CROSS JOIN ov LEFT JOIN ow ON ow.annotator_id = an.annotator_id AND ow.label = ov.label GROUP BY 1, 2",
}


@query("label_share_gaps", sql("SELECT annotator_id, size, round(g, 6) AS max_difference FROM gp", "annotations", **GAPS))
def label_share_gaps(spark, sf):
    return rounded(Q.label_share_gaps(annotations(spark, sf)), "max_difference")


@query("outlier_assessor", sql(
    "SELECT 'outlier' AS assessor, round(greatest(0, 1 - ((SELECT count(*) FROM sp) + (SELECT count(*) FROM gp WHERE g > 0.3)) / (SELECT count(*) FROM annotations)), 6) AS score, (SELECT count(*) FROM sp WHERE z > 5) AS high, "
    "(SELECT count(*) FROM sp WHERE z <= 5) + (SELECT count(*) FROM gp WHERE g > 0.3) AS medium, 0 AS low", "annotations", sp=SPEED, **GAPS))
def outlier_assessor(spark, sf):
    return one_line(Q.assess_outlier(tasks(spark, sf), annotations(spark, sf)))


BIAS = {
    "bl": "SELECT max(n) / min(n) AS ratio FROM (SELECT count(*) AS n FROM annotations GROUP BY label)",
    "ba": "SELECT annotator_id, sum(n) AS size, max(n) / sum(n) AS top FROM (SELECT annotator_id, label, count(*) AS n FROM annotations GROUP BY 1, 2) GROUP BY 1",
    "bs": "SELECT (SELECT count(*) FROM ba) AS people, (SELECT count(*) FROM ba WHERE top > 0.9 AND size > 10) AS biased, (SELECT CASE WHEN ratio > 10 THEN 1 ELSE 0 END FROM bl) AS skewed, (SELECT ratio FROM bl) AS ratio",
}


@query("bias_assessor", sql(
    "SELECT 'bias' AS assessor, round(greatest(0, 1 - (biased + skewed) / (people + 1)), 6) AS score, CASE WHEN ratio > 50 THEN 1 ELSE 0 END AS high, biased + CASE WHEN ratio > 10 AND ratio <= 50 THEN 1 ELSE 0 END AS medium, 0 AS low FROM bs", "annotations", **BIAS))
def bias_assessor(spark, sf):
    return one_line(Q.assess_bias(tasks(spark, sf), annotations(spark, sf)))


@query("bias_annotators", sql("SELECT annotator_id, CAST(size AS BIGINT) AS size, round(top, 6) AS top_share FROM ba", "annotations", **BIAS))
def bias_annotators(spark, sf):
    return Q.bias_parts(annotations(spark, sf))[1].select("annotator_id", "size", r6(F.col("top_share")).alias("top_share"))


RUN_SQL = {
    "tl": TASK_LABELS, **PAIR_SQL, "tc": TC, "sp": SPEED, **GAPS, **BIAS,
    "cm": "SELECT count(*) FILTER (WHERE n > 0) / count(*) AS c, sum(n) / count(*) FILTER (WHERE n > 0) AS d FROM tc",
    "scores": "SELECT 'consistency' AS assessor, 1 - count(*) FILTER (WHERE d > 1) / count(*) AS score FROM tl UNION ALL SELECT 'agreement', avg(rate) FROM kp UNION ALL SELECT 'completeness', 0.7 * c + 0.3 * least(1, d) FROM cm "
              "UNION ALL SELECT 'outlier', greatest(0, 1 - ((SELECT count(*) FROM sp) + (SELECT count(*) FROM gp WHERE g > 0.3)) / (SELECT count(*) FROM annotations)) UNION ALL SELECT 'bias', greatest(0, 1 - (biased + skewed) / (people + 1)) FROM bs",
    "issues": "SELECT CASE WHEN d > 2 THEN 'high' ELSE 'medium' END AS severity FROM tl WHERE d > 1 UNION ALL SELECT CASE WHEN rate < 0.3 THEN 'high' ELSE 'medium' END FROM kp WHERE rate < 0.5 "
              "UNION ALL SELECT CASE WHEN c < 0.2 THEN 'high' ELSE 'medium' END FROM cm WHERE c < 0.5 UNION ALL SELECT CASE WHEN z > 5 THEN 'high' ELSE 'medium' END FROM sp UNION ALL SELECT 'medium' FROM gp WHERE g > 0.3 "
              "UNION ALL SELECT CASE WHEN ratio > 50 THEN 'high' ELSE 'medium' END FROM bl WHERE ratio > 10 UNION ALL SELECT 'medium' FROM ba WHERE top > 0.9 AND size > 10",
}


@query("run_assessment", sql(
    "SELECT round((SELECT avg(score) FROM scores), 6) AS overall_score, (SELECT count(*) FROM scores) AS assessors, (SELECT count(*) FROM scores WHERE score IS NULL) AS failed, count(*) AS issue_count, count(*) FILTER (WHERE severity = 'critical') AS critical_count, "
    "count(*) FILTER (WHERE severity = 'high') AS high_count, count(*) FILTER (WHERE severity = 'medium') AS medium_count, count(*) FILTER (WHERE severity = 'low') AS low_count FROM issues",
    "pairs", "tasks", **RUN_SQL))
def run_assessment(spark, sf):
    return rounded(Q.report_header(*Q.run_assessment(tasks(spark, sf), annotations(spark, sf))), "overall_score")


@query("run_assessment_scores", sql("SELECT assessor, round(score, 6) AS score, NULL AS error FROM scores UNION ALL SELECT 'missing', 0.0, '''missing'''", "pairs", "tasks", **RUN_SQL))
def run_assessment_scores(spark, sf):
    names = [*Q.ASSESSORS, "missing"]
    return rounded(Q.run_assessment(tasks(spark, sf), annotations(spark, sf), names)[0], "score")


PROJECT = {
    **PAIR_SQL, "km": K, "tc": TC, "dl": DELAY, "tr": TRUTH,
    "mv": "SELECT task_id, arg_min(label, (-n, label)) AS predicted FROM (SELECT task_id, label, count(*) AS n FROM annotations GROUP BY 1, 2) GROUP BY 1",
    "pt": "SELECT predicted, truth FROM mv JOIN tr USING (task_id)", "ll": MACRO["ll"], "lm": MACRO["lm"], "lf": MACRO["lf"],
    # the measures, then per dimension its score, issue texts and recommendations
    "ms": "SELECT (SELECT k FROM km) AS k, (SELECT count(*) FILTER (WHERE n > 0) / count(*) FROM tc) AS c, (SELECT avg(least(n / 5, 1)) FROM tc) AS v, (SELECT count(*) FILTER (WHERE n >= 5) / count(*) FROM tc) AS f, "
          "(SELECT avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) FROM lf) AS f1, (SELECT avg(CASE WHEN d <= 24 THEN 1.0::DOUBLE ELSE 0 END) FROM dl) AS ot",
    "dims": "SELECT 'consistency' AS dimension, greatest(0, least(1, k)) AS score, CASE WHEN k < 0.7 THEN [format('Low inter-annotator agreement (kappa={:.2f})', k)] ELSE [] END AS issues, "
            "CASE WHEN k < 0.7 THEN ['Review annotation guidelines for clarity', 'Consider additional annotator training'] ELSE [] END AS recs FROM ms UNION ALL "
            "SELECT 'completeness', (c + v) / 2, list_concat(CASE WHEN c < 0.95 THEN [format('Low task coverage ({:.1f}%)', 100 * c)] ELSE [] END, CASE WHEN f < 0.8 THEN [format('Only {:.1f}% of tasks are fully annotated', 100 * f)] ELSE [] END), "
            "list_concat(CASE WHEN c < 0.95 THEN ['Prioritize annotation of remaining tasks'] ELSE [] END, CASE WHEN f < 0.8 THEN ['Increase annotations per task for better quality'] ELSE [] END) FROM ms UNION ALL "
            "SELECT 'accuracy', f1, CASE WHEN f1 < 0.7 THEN [format('Low f1 score ({:.2f})', f1)] ELSE [] END, CASE WHEN f1 < 0.7 THEN ['Review annotation guidelines', 'Consider additional annotator training'] ELSE [] END FROM ms UNION ALL "
            "SELECT 'timeliness', ot, CASE WHEN ot < 0.8 THEN [format('Low on-time rate ({:.1f}%)', 100 * ot)] ELSE [] END, CASE WHEN ot < 0.8 THEN ['Set up annotation deadlines and reminders'] ELSE [] END FROM ms",
}


def project_dimensions(spark, sf):
    notes = annotations(spark, sf)
    return Q.assess_project(tasks(spark, sf), notes, 5, truth_labels(notes))


@query("assess_project", sql("SELECT dimension, round(score, 6) + 0.0 AS score, array_to_string(issues, '; ') AS issues, array_to_string(recs, '; ') AS recommendations FROM dims", "pairs", "tasks", **PROJECT))
def assess_project(spark, sf):
    return project_dimensions(spark, sf).select(
        "dimension", r6(F.col("score")).alias("score"), F.array_join("issues", "; ").alias("issues"), F.array_join("recommendations", "; ").alias("recommendations"))


@query("assess_project_summary", sql(
    "SELECT round(avg(score), 6) AS overall_score, CAST(sum(len(issues)) AS BIGINT) AS issues, array_to_string(list_sort(list_distinct(flatten(list(recs)))), '; ') AS recommendations FROM dims", "pairs", "tasks", **PROJECT))
def assess_project_summary(spark, sf):
    return rounded(Q.project_summary(project_dimensions(spark, sf)), "overall_score")


@query("annotator_scores", sql("SELECT annotator_id, count(*) AS annotation_count FROM annotations GROUP BY 1", "annotations"))
def annotator_scores(spark, sf):
    return Q.annotator_scores(annotations(spark, sf))


@query("task_scores", sql("SELECT task_id, count(*) AS annotation_count, count(DISTINCT annotator_id) AS annotator_count, round(least(count(*) / 6, 1), 6) AS completeness FROM annotations GROUP BY 1", "annotations"))
def task_scores(spark, sf):
    return rounded(Q.task_scores(annotations(spark, sf), 6), "completeness")


PROFILE = {
    **PAIR_SQL, "intra": INTRA, "sp": SPEED,
    "ag": "SELECT annotator_id, avg(rate) AS agreement FROM (SELECT a1 AS annotator_id, rate FROM kp UNION ALL SELECT a2, rate FROM kp) GROUP BY 1",
    "pf": "SELECT a.annotator_id, count(*) AS total_annotations, avg(lead_time) AS avg_time, min(created_at) AS first_at, max(created_at) AS last_at, any_value(g.agreement) AS agreement, any_value(CASE WHEN i.n < 2 THEN 1.0 ELSE 1 - i.changes / (i.n - 1) END) AS consistency, "
          "(SELECT count(*) FROM sp WHERE sp.annotator_id = a.annotator_id) AS issue_count, (SELECT count(*) FROM sp WHERE sp.annotator_id = a.annotator_id AND z > 5) AS serious_issues FROM annotations a LEFT JOIN ag g ON g.annotator_id = a.annotator_id JOIN intra i ON i.annotator_id = a.annotator_id GROUP BY a.annotator_id",
}


def profiles(spark, sf):
    notes = annotations(spark, sf)
    return Q.annotator_profiles(notes, Q.speed_anomalies(notes))


@query("annotator_profile", sql(
    "SELECT annotator_id, total_annotations, round(avg_time, 6) AS avg_time, first_at, last_at, round(agreement, 6) AS agreement, round(consistency, 6) AS consistency, issue_count, serious_issues, round((agreement + consistency) / 2, 6) AS quality_score FROM pf", "pairs", **PROFILE))
def annotator_profile(spark, sf):
    return rounded(profiles(spark, sf), "avg_time", "agreement", "consistency", "quality_score")


@query("top_annotators", sql("SELECT annotator_id, round((agreement + consistency) / 2, 6) AS quality_score FROM pf ORDER BY (agreement + consistency) DESC, annotator_id LIMIT 5", "pairs", **PROFILE))
def top_annotators(spark, sf):
    top = profiles(spark, sf).orderBy(F.desc("quality_score"), "annotator_id").limit(5)
    return top.select("annotator_id", r6(F.col("quality_score")).alias("quality_score"))


@query("low_quality_annotators", sql("SELECT annotator_id, round((agreement + consistency) / 2, 6) AS quality_score FROM pf WHERE (agreement + consistency) / 2 < 0.5", "pairs", **PROFILE))
def low_quality_annotators(spark, sf):
    return profiles(spark, sf).filter("quality_score < 0.5").select("annotator_id", r6(F.col("quality_score")).alias("quality_score"))


LABEL_SQL = {
    "us": "SELECT label, count(*) AS usage, count(DISTINCT annotator_id) AS annotators FROM annotations GROUP BY 1",
    "la": "SELECT label, avg(CASE WHEN l1 = l2 THEN 1.0::DOUBLE ELSE 0 END) AS agreement FROM (SELECT unnest(list_distinct([l1, l2])) AS label, l1, l2 FROM pairs) GROUP BY 1",
    "tk": "SELECT task_id, count(DISTINCT label) AS k FROM annotations GROUP BY 1",
    "lk": "SELECT label, avg(CASE WHEN k = 1 THEN 1.0::DOUBLE ELSE 0 END) AS consistency FROM (SELECT DISTINCT task_id, label FROM annotations) JOIN tk USING (task_id) GROUP BY 1",
    "ls": "SELECT label, usage, annotators, usage / (SELECT count(*) FROM annotations) AS share, agreement, consistency FROM us LEFT JOIN la USING (label) LEFT JOIN lk USING (label)",
}


@query("label_stats", sql("SELECT label, usage, annotators, round(share, 6) AS share, round(agreement, 6) AS agreement, round(consistency, 6) AS consistency FROM ls", "pairs", **LABEL_SQL))
def label_stats(spark, sf):
    return rounded(Q.label_stats(annotations(spark, sf)), "share", "agreement", "consistency")


@query("dashboard_leaders", sql(
    "SELECT 'annotators' AS list, CAST(row_number() OVER (ORDER BY agreement + consistency DESC, annotator_id) AS INTEGER) AS rank, CAST(annotator_id AS VARCHAR) AS name, round((agreement + consistency) / 2, 6) AS value FROM pf QUALIFY rank <= 10 "
    "UNION ALL SELECT 'labels', CAST(row_number() OVER (ORDER BY usage DESC, label) AS INTEGER), label, CAST(usage AS DOUBLE) FROM ls QUALIFY row_number() OVER (ORDER BY usage DESC, label) <= 10",
    "pairs", **PROFILE, **LABEL_SQL))
def dashboard_leaders(spark, sf):
    from curadrift.operators.reports import dashboard_leaders as leaders
    return rounded(leaders(profiles(spark, sf), Q.label_stats(annotations(spark, sf))), "value")


@query("low_agreement_labels", sql("SELECT label, usage, usage <= 5 AS rarely_used, round(agreement, 6) AS agreement FROM ls WHERE agreement < 0.5 OR usage <= 5", "pairs", **LABEL_SQL))
def low_agreement_labels(spark, sf):
    stats = Q.label_stats(annotations(spark, sf)).filter("agreement < 0.5 OR usage <= 5")
    return stats.select("label", "usage", (F.col("usage") <= 5).alias("rarely_used"), r6(F.col("agreement")).alias("agreement"))


@query("compute_statistics", (
    "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max, round(median(value), 6) AS median, count(value) AS count FROM events GROUP BY 1"))
def compute_statistics(spark, sf):
    from curadrift.sources.tables import table
    return rounded(Q.compute_statistics(table(spark, sf, "events"), "value", ["event_type"]), "mean", "std", "median")


@query("label_distribution", sql("SELECT label, count(*) AS n FROM (SELECT CASE id % 4 WHEN 3 THEN 'unknown' ELSE label END AS label FROM annotations) WHERE label <> 'unknown' GROUP BY 1", "annotations"))
def label_distribution(spark, sf):
    from curadrift.operators.projections import parse_annotations, with_label
    from curadrift.sources.tables import annotation_json
    return Q.label_distribution(with_label(parse_annotations(annotation_json(spark, sf))))

"""Annotation quality: coverage, accuracy, timeliness, outliers, bias, assessors and reports.

An assessor is a function (tasks, annotations) -> (score, issues): ``score`` is one row
(assessor, score, annotations), ``issues`` a table with the columns of ``ISSUE_COLUMNS``.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.util import inheritable_thread_target

from curadrift.functions.numbers import clip, ratio, share
from curadrift.operators import agreement as A
from curadrift.operators.ordered import indexed, ranged, running
from curadrift.session import checkpointed, shared_dir

ISSUE_COLUMNS = ["assessor", "issue_type", "severity", "title", "task_id", "annotation_id", "annotator_id"]


def issues_of(df: DataFrame, assessor: str, issue_type: str, severity: Column, title: Column, **keys: Column) -> DataFrame:
    none = F.lit(None).cast("bigint")
    return df.select(
        F.lit(assessor).alias("assessor"), F.lit(issue_type).alias("issue_type"), severity.alias("severity"), title.alias("title"),
        *[keys.get(k, none).cast("bigint").alias(k) for k in ["task_id", "annotation_id", "annotator_id"]],
    )


def percent(c: Column, digits: int = 1) -> Column:
    return F.concat(F.format_string(f"%.{digits}f", 100 * c), F.lit("%"))


# ---- counts shared by several results -----------------------------------------------------

def count_cells(annotations: DataFrame) -> DataFrame:
    """One row per task, annotator and label: all that coverage, agreement, label and speed measures need of the annotations.

    n rows, the ``latest`` (created_at, id) and ``first_at``; of the positive lead times their number, mean and sum of squared deviations.
    """
    lead = F.when(F.col("lead_time") > 0, F.col("lead_time"))
    return annotations.groupBy("task_id", "annotator_id", "label").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("created_at", "id")).alias("latest"), F.min("created_at").alias("first_at"),
        F.count(lead).alias("timed"), F.avg(lead).alias("mean"), (F.var_pop(lead) * F.count(lead)).alias("squares"),
    )


def counted(annotations: DataFrame, cells: DataFrame | None, *by: str) -> DataFrame:
    """(by, n): rows per group, from the stored cells where there are any."""
    if cells is None:
        return annotations.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return cells.groupBy(*by).agg(F.sum("n").alias("n"))


# ---- descriptive -------------------------------------------------------------------------

def compute_statistics(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """mean, std, min, max, exact median and count; zeros for no rows.

    Equal values collapse to one counted row and the median is read off running counts over
    range-partitioned parts, so no group's values are held in one task.
    """
    by = by or []
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    seen = running(ranged(counts, by, ["v"]), by, ["v"], sums={"n": F.col("c"), "s": F.col("c") * F.col("v")})
    mean = F.col("total_s") / F.col("total_n")
    low_rank, high_rank = F.floor((F.col("total_n") + 1) / 2), F.floor(F.col("total_n") / 2) + 1
    median = (F.min(F.when(F.col("n") >= low_rank, F.col("v"))) + F.min(F.when(F.col("n") >= high_rank, F.col("v")))) / 2

    def or_zero(c: Column) -> Column:
        return F.coalesce(c.cast("double"), F.lit(0.0))

    return seen.groupBy(*by).agg(
        or_zero(F.max(mean)).alias("mean"),
        or_zero(F.sqrt(F.sum(F.col("c") * (F.col("v") - mean) * (F.col("v") - mean)) / F.max("total_n"))).alias("std"),
        or_zero(F.min("v")).alias("min"), or_zero(F.max("v")).alias("max"), or_zero(median).alias("median"),
        F.coalesce(F.max("total_n"), F.lit(0)).alias("count"),
    )


def label_distribution(df: DataFrame) -> DataFrame:
    return df.filter(F.col("label") != "unknown").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def lead_time_stats(cells: DataFrame) -> DataFrame:
    """One row: mean, population std and number of the positive lead times, from the moments of the cells."""
    timed = cells.filter("timed > 0")
    middle = timed.agg((F.sum(F.col("timed") * F.col("mean")) / F.sum("timed")).alias("mean"))
    off = timed.withColumn("all", middle.scalar())
    squares = F.sum(F.col("squares") + F.col("timed") * (F.col("mean") - F.col("all")) * (F.col("mean") - F.col("all")))
    return off.agg(F.max("all").alias("mean"), F.sqrt(squares / F.sum("timed")).alias("std"), F.sum("timed").alias("n"))


def speed_anomalies(annotations: DataFrame, threshold: float = 3.0, cells: DataFrame | None = None) -> DataFrame:
    """Rows with positive lead time more than ``threshold`` stds off the mean (3 rows and std > 0 needed)."""
    timed = annotations.filter(F.col("lead_time") > 0)
    stats = timed.agg(F.avg("lead_time").alias("mean"), F.stddev_pop("lead_time").alias("std"), F.count(F.lit(1)).alias("n"))
    if cells is not None:
        stats = lead_time_stats(cells)
    scored = timed.withColumn("st", stats.select(F.struct("*")).scalar()).select("*", "st.mean", "st.std", "st.n")
    z = F.try_divide(F.abs(F.col("lead_time") - F.col("mean")), F.col("std"))
    return (
        scored.withColumn("z_score", z)
        .filter((F.col("n") >= 3) & (F.col("std") > 0) & (F.col("z_score") > threshold))
        .withColumn("severity", F.when(F.col("z_score") > 5, "high").otherwise("medium"))
        .drop("st", "n")
    )


# ---- task level --------------------------------------------------------------------------

def majority_vote(annotations: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Most common label per task, the smaller label on a tie."""
    counts = counted(annotations, cells, "task_id", "label")
    return counts.groupBy("task_id").agg(
        F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("majority"), F.sum("n").alias("votes")
    )


def task_counts(tasks: DataFrame, annotations: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Every task with its annotation count, 0 when there is none."""
    per_task = counted(annotations, cells, "task_id")
    return tasks.select(F.col("id").alias("task_id")).join(per_task, "task_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def coverage_metrics(tasks: DataFrame, annotations: DataFrame, required: int, cells: DataFrame | None = None) -> DataFrame:
    """One row: task coverage, mean min(count / required, 1), share of fully annotated tasks."""
    n = F.col("n")
    return task_counts(tasks, annotations, cells).agg(
        F.count(F.lit(1)).alias("tasks"), F.count_if(n > 0).alias("annotated"),
        F.coalesce(share(n > 0), F.lit(0.0)).alias("task_coverage"),
        F.coalesce(F.avg(F.least(n / F.lit(required), F.lit(1.0))), F.lit(0.0)).alias("avg_annotation_coverage"),
        F.coalesce(share(n >= required), F.lit(0.0)).alias("full_coverage_rate"),
    )


def timeliness(tasks: DataFrame, annotations: DataFrame, max_delay_hours: float = 24.0, cells: DataFrame | None = None) -> DataFrame:
    """One row: mean and largest delay to the first annotation in hours, share on time, task count."""
    times = annotations.select("task_id", F.col("created_at").alias("first_at")) if cells is None else cells
    first = times.groupBy("task_id").agg(F.min("first_at").alias("first_at"))
    delay = F.timestamp_diff("MICROSECOND", F.col("created_at"), F.col("first_at")) / F.lit(3.6e9)
    return tasks.join(first, tasks["id"] == first["task_id"]).select(delay.alias("d")).agg(
        F.coalesce(F.avg("d"), F.lit(0.0)).alias("avg_delay_hours"), F.coalesce(F.max("d"), F.lit(0.0)).alias("max_delay_hours"),
        F.coalesce(share(F.col("d") <= max_delay_hours), F.lit(0.0)).alias("on_time_rate"), F.count(F.lit(1)).alias("num_tasks"),
    )


def accuracy_macro(pairs: DataFrame) -> DataFrame:
    """One row from (predicted, truth): exact match and macro precision, recall, F1 over both label sets."""
    confusion = pairs.groupBy("predicted", "truth").agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("predicted") == F.col("truth"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("predicted").alias("label"), F.col("n").alias("said"), zero.alias("was"), hit.alias("tp")),
        F.struct(F.col("truth").alias("label"), zero.alias("said"), F.col("n").alias("was"), zero.alias("tp")),
    )
    per_label = confusion.select(F.explode(sides).alias("s")).groupBy("s.label").agg(
        F.sum("s.said").alias("said"), F.sum("s.was").alias("was"), F.sum("s.tp").alias("tp")
    )
    precision, recall = ratio(F.col("tp"), F.col("said"), 0.0), ratio(F.col("tp"), F.col("was"), 0.0)
    scored = per_label.withColumn("p", precision).withColumn("r", recall)
    f1 = F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0))
    return scored.agg(
        F.coalesce(F.try_divide(F.sum("tp"), F.sum("was")), F.lit(0.0)).alias("exact_match"), F.avg("p").alias("precision"),
        F.avg("r").alias("recall"), F.avg(f1).alias("f1"), F.count(F.lit(1)).alias("labels"),
    )


def annotator_scores(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("annotator_id").agg(F.count(F.lit(1)).alias("annotation_count"))


def task_scores(annotations: DataFrame, required: int) -> DataFrame:
    # counted per annotator first, so a crowded task is summed from few rows
    per = annotations.groupBy("task_id", "annotator_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("task_id").agg(F.sum("n").alias("annotation_count"), F.count(F.lit(1)).alias("annotator_count")).withColumn(
        "completeness", F.least(F.col("annotation_count") / F.lit(max(required, 1)), F.lit(1.0))
    )


# ---- assessors ---------------------------------------------------------------------------

def _score(df: DataFrame, assessor: str, score: Column) -> DataFrame:
    return df.select(F.lit(assessor).alias("assessor"), score.cast("double").alias("score"))


def task_label_sets(annotations: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Per task its annotation count, number of distinct labels, and those labels in order."""
    per = counted(annotations, cells, "task_id", "label")
    return per.groupBy("task_id").agg(
        F.sum("n").alias("annotations"), F.count(F.lit(1)).alias("labels"),
        F.array_join(F.array_sort(F.collect_list("label")), ", ").alias("label_list"),
    )


def assess_consistency(tasks: DataFrame, annotations: DataFrame, cells: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    per_task = task_label_sets(annotations, cells)
    bad = per_task.filter("annotations > 1 AND labels > 1")
    issues = issues_of(
        bad, "consistency", "inconsistency", F.when(F.col("labels") > 2, "high").otherwise("medium"),
        F.concat(F.lit("Inconsistent annotations for task "), F.col("task_id").cast("string")), task_id=F.col("task_id"),
    )
    rate = F.coalesce(1 - share(F.col("labels") > 1), F.lit(1.0))
    return _score(per_task.agg(rate.alias("s")), "consistency", F.col("s")), issues


def assess_agreement(tasks: DataFrame, annotations: DataFrame, cells: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    # one row per annotator pair, read by both results
    pairs = checkpointed(A.pair_agreement(A.pair_label_counts(annotations, cells=cells)))
    issues = issues_of(
        pairs.filter("rate < 0.5"), "agreement", "low_agreement", F.when(F.col("rate") < 0.3, "high").otherwise("medium"),
        F.concat(F.lit("Low agreement between annotators "), F.col("a1").cast("string"), F.lit(" and "), F.col("a2").cast("string")),
        annotator_id=F.col("a1"),
    )
    return _score(pairs.agg(F.coalesce(F.avg("rate"), F.lit(1.0)).alias("s")), "agreement", F.col("s")), issues


def completeness_counts(tasks: DataFrame, annotations: DataFrame, overlap: int = 1, cells: DataFrame | None = None) -> DataFrame:
    totals = task_counts(tasks, annotations, cells).agg(
        F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("n") > 0).alias("annotated"),
        F.sum("n").alias("annotations"), F.count_if((F.col("n") > 0) & (F.col("n") < overlap)).alias("insufficient"),
    )
    coverage = ratio(F.col("annotated"), F.col("tasks"), 0.0)
    density = ratio(F.col("annotations"), F.col("annotated"), 0.0)
    return totals.withColumn("coverage", coverage).withColumn("density", density).withColumn(
        "score", F.when(F.col("tasks") == 0, 1.0).otherwise(0.7 * F.col("coverage") + 0.3 * F.least(F.lit(1.0), F.col("density") / overlap))
    )


def assess_completeness(tasks: DataFrame, annotations: DataFrame, overlap: int = 1, cells: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    counts = completeness_counts(tasks, annotations, overlap, cells)
    low = issues_of(
        counts.filter("tasks > 0 AND coverage < 0.5"), "completeness", "missing",
        F.when(F.col("coverage") < 0.2, "high").otherwise("medium"), F.lit("Low annotation coverage"),
    )
    thin_rate = F.try_divide("insufficient", "annotated")
    thin = issues_of(
        counts.filter("insufficient > 0"), "completeness", "missing", F.when(thin_rate > 0.3, "medium").otherwise("low"),
        F.concat(F.col("insufficient").cast("string"), F.lit(" tasks have insufficient annotations")),
    )
    return _score(counts, "completeness", F.col("score")), low.unionByName(thin)


def label_share_gaps(annotations: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Per annotator the largest difference between own and overall label share, over all labels.

    Labels the annotator never used differ by their overall share, so only the largest such share matters: with labels
    ranked by share once, it is that of the first rank missing among the annotator's own.
    """
    own = counted(annotations, cells, "annotator_id", "label")
    overall = own.groupBy("label").agg(F.sum("n").alias("t")).withColumn("one", F.lit(1))
    total = overall.agg(F.sum("t").alias("total"))
    shares = overall.withColumn("total", total.scalar()).select("one", "label", (F.col("t") / F.col("total")).alias("overall"), (-F.col("t")).alias("less"))
    ranked = checkpointed(indexed(shares, ["one"], ["less", "label"]).select("label", "overall", F.col("idx").alias("place")))
    sizes = own.groupBy("annotator_id").agg(F.sum("n").alias("size"))
    seen = own.join(sizes, "annotator_id").join(ranked, "label").select(
        "annotator_id", "place", "size", F.abs(F.col("n") / F.col("size") - F.col("overall")).alias("gap")
    )
    nth = F.row_number().over(Window.partitionBy("annotator_id").orderBy("place"))
    per = seen.withColumn("nth", nth).groupBy("annotator_id").agg(
        F.max("gap").alias("seen_gap"), F.max("size").alias("size"), F.count_if(F.col("nth") == F.col("place")).alias("unbroken")
    )
    absent = ranked.select((F.col("place") - 1).alias("unbroken"), F.col("overall").alias("absent"))
    return per.join(absent, "unbroken", "left").select(
        "annotator_id", "size", F.greatest("seen_gap", F.coalesce("absent", F.lit(0.0))).alias("max_difference"))


def assess_outlier(tasks: DataFrame, annotations: DataFrame, cells: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    slow = speed_anomalies(annotations, cells=cells)
    odd = label_share_gaps(annotations, cells).filter("max_difference > 0.3")
    # few rows, read by both results
    issues = checkpointed(issues_of(
        slow, "outlier", "speed_anomaly", F.col("severity"), F.lit("Speed anomaly detected"),
        task_id=F.col("task_id"), annotation_id=F.col("id"), annotator_id=F.col("annotator_id"),
    ).unionByName(issues_of(
        odd, "outlier", "outlier", F.lit("medium"),
        F.concat(F.lit("Label distribution anomaly for annotator "), F.col("annotator_id").cast("string")), annotator_id=F.col("annotator_id"),
    )))
    found = issues.agg(F.count(F.lit(1)).alias("found"))
    total = counted(annotations, cells).withColumn("n", F.coalesce("n", F.lit(0))).withColumn("found", found.scalar())
    return _score(total, "outlier", F.greatest(F.lit(0.0), 1 - ratio(F.col("found"), F.col("n"), 0.0))), issues


def bias_parts(annotations: DataFrame, cells: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One-row label imbalance, and annotators whose top label exceeds 90 % of more than 10 rows."""
    own = counted(annotations, cells, "annotator_id", "label")
    per_label = own.groupBy("label").agg(F.sum("n").alias("t"))
    imbalance = per_label.agg(
        F.coalesce(F.try_divide(F.max("t").cast("double"), F.min("t")), F.lit(1.0)).alias("imbalance_ratio"),
        F.min_by("label", F.struct(-F.col("t"), F.col("label"))).alias("dominant"), F.count(F.lit(1)).alias("labels"),
    )
    per_annotator = own.groupBy("annotator_id").agg(
        F.sum("n").alias("size"), F.max("n").alias("top"), F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("preferred")
    ).withColumn("top_share", F.col("top") / F.col("size"))
    return imbalance, per_annotator


def assess_bias(tasks: DataFrame, annotations: DataFrame, cells: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    imbalance, per_annotator = bias_parts(annotations, cells)
    biased = F.col("top_share") > 0.9
    skewed = imbalance.filter("imbalance_ratio > 10")
    issues = issues_of(
        skewed, "bias", "bias", F.when(F.col("imbalance_ratio") > 50, "high").otherwise("medium"), F.lit("Severe label imbalance detected")
    ).unionByName(issues_of(
        per_annotator.filter(biased & (F.col("size") > 10)), "bias", "bias", F.lit("medium"),
        F.concat(F.lit("Annotator "), F.col("annotator_id").cast("string"), F.lit(" shows label bias")), annotator_id=F.col("annotator_id"),
    ))
    counts = per_annotator.agg(
        F.count(F.lit(1)).alias("annotators"), F.count_if(biased & (F.col("size") > 10)).alias("biased")
    ).withColumn("skewed", imbalance.select((F.col("imbalance_ratio") > 10).cast("int")).scalar())
    score = F.when(F.col("annotators") == 0, 1.0).otherwise(
        F.greatest(F.lit(0.0), 1 - (F.col("biased") + F.col("skewed")) / (F.col("annotators") + 1))
    )
    return _score(counts, "bias", score), issues


Assessor = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]
ASSESSORS: dict[str, Assessor] = {
    "consistency": assess_consistency, "agreement": assess_agreement, "completeness": assess_completeness,
    "outlier": assess_outlier, "bias": assess_bias,
}


# those that read the annotations by their cells
COUNTED = {assess_consistency, assess_agreement, assess_completeness, assess_outlier, assess_bias}


def register_assessor(name: str, assessor: Assessor) -> None:
    ASSESSORS[name] = assessor


SCORES = "assessor string, score double, error string"
ISSUE_ROW = ", ".join(f"{c}: {'bigint' if c.endswith('_id') else 'string'}" for c in ISSUE_COLUMNS)


def run_assessment(tasks: DataFrame, annotations: DataFrame, names: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(scores, issues) of the named assessors. Each is run and stored by itself: one that fails, in planning or while it
    runs, scores 0 with its error and leaves the others alone.

    The assessors of this module share one stored table of ``count_cells``. Assessors run side by side, so their jobs share the cluster.
    """
    spark = tasks.sparkSession
    names = list(names or ASSESSORS)
    shared, broken = None, None
    if any(ASSESSORS.get(name) in COUNTED for name in names):
        try:
            shared = checkpointed(count_cells(annotations))
        except Exception as failure:
            broken = failure

    def stored(name: str) -> DataFrame:
        try:
            assessor = ASSESSORS[name]
            if assessor in COUNTED and broken is not None:
                raise broken
            score, found = assessor(tasks, annotations, cells=shared) if assessor in COUNTED else assessor(tasks, annotations)
            issue, scored = f"struct<{ISSUE_ROW}>", F.col("score").cast("double").alias("score")
            return checkpointed(score.select("assessor", scored, F.lit(None).cast("string").alias("error"), F.lit(None).cast(issue).alias("issue")).unionByName(
                found.select("assessor", F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("error"), F.struct(*ISSUE_COLUMNS).cast(issue).alias("issue"))))
        except Exception as failure:  # an assessor is a user's function and may raise anything
            return spark.createDataFrame([(name, 0.0, str(failure), None)], f"{SCORES}, issue struct<{ISSUE_ROW}>")

    shared_dir(spark)  # once, before the threads ask for it
    with ThreadPoolExecutor(max_workers=8) as pool:
        tables = list(pool.map(inheritable_thread_target(spark)(stored), names))
    rows = reduce(DataFrame.unionByName, tables, spark.createDataFrame([], f"{SCORES}, issue struct<{ISSUE_ROW}>"))
    return rows.filter("issue IS NULL").select("assessor", "score", "error"), rows.filter("issue IS NOT NULL").select("issue.*")


def report_header(scores: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: overall score, assessor count, issue counts by severity."""
    counts = issues.agg(
        F.count(F.lit(1)).alias("issue_count"),
        *[F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in ["critical", "high", "medium", "low"]],
    )
    head = scores.agg(F.avg("score").alias("overall_score"), F.count(F.lit(1)).alias("assessors"), F.count("error").alias("failed"))
    return head.withColumn("c", counts.select(F.struct("*")).scalar()).select("overall_score", "assessors", "failed", "c.*")


# ---- project report ----------------------------------------------------------------------

def consistency_dimension(annotations: DataFrame, threshold: float = 0.7, cells: DataFrame | None = None) -> DataFrame:
    kappa = A.mean_kappa(A.pair_agreement(A.pair_label_counts(annotations, cells=cells)))
    low = F.col("kappa") < threshold
    return dimension(
        kappa, "consistency", F.col("kappa"),
        [(low, F.concat(F.lit("Low inter-annotator agreement (kappa="), F.format_string("%.2f", F.col("kappa")), F.lit(")")))],
        [(low, "Review annotation guidelines for clarity"), (low, "Consider additional annotator training")],
    )


def completeness_dimension(
    tasks: DataFrame, annotations: DataFrame, required: int, wanted: float = 0.95, cells: DataFrame | None = None
) -> DataFrame:
    m = coverage_metrics(tasks, annotations, required, cells)
    low, thin = F.col("task_coverage") < wanted, F.col("full_coverage_rate") < 0.8
    return dimension(
        m, "completeness", (F.col("task_coverage") + F.col("avg_annotation_coverage")) / 2,
        [(low, F.concat(F.lit("Low task coverage ("), percent(F.col("task_coverage")), F.lit(")"))),
         (thin, F.concat(F.lit("Only "), percent(F.col("full_coverage_rate")), F.lit(" of tasks are fully annotated")))],
        [(low, "Prioritize annotation of remaining tasks"), (thin, "Increase annotations per task for better quality")],
    )


def accuracy_dimension(pairs: DataFrame, metric: str = "f1") -> DataFrame:
    m = accuracy_macro(pairs)
    low = F.col(metric) < 0.7
    return dimension(
        m, "accuracy", F.col(metric),
        [(low, F.concat(F.lit(f"Low {metric} score ("), F.format_string("%.2f", F.col(metric)), F.lit(")")))],
        [(low, "Review annotation guidelines"), (low, "Consider additional annotator training")],
    )


def timeliness_dimension(
    tasks: DataFrame, annotations: DataFrame, max_delay_hours: float = 24.0, cells: DataFrame | None = None
) -> DataFrame:
    m = timeliness(tasks, annotations, max_delay_hours, cells)
    low = F.col("on_time_rate") < 0.8
    return dimension(
        m, "timeliness", F.col("on_time_rate"),
        [(low, F.concat(F.lit("Low on-time rate ("), percent(F.col("on_time_rate")), F.lit(")")))],
        [(low, "Set up annotation deadlines and reminders")],
    )


def dimension(df: DataFrame, name: str, score: Column, issues: list, recommendations: list) -> DataFrame:
    """One row: dimension, clipped score, issue texts, recommendation texts."""
    def texts(items):
        return F.array_compact(F.array(*[F.when(c, t if isinstance(t, Column) else F.lit(t)) for c, t in items]))

    return df.select(
        F.lit(name).alias("dimension"), clip(score, 0.0, 1.0).alias("score"),
        texts(issues).alias("issues"), texts(recommendations).alias("recommendations"),
    )


def assess_project(
    tasks: DataFrame, annotations: DataFrame, required: int, truth: DataFrame | None = None, with_times: bool = True
) -> DataFrame:
    """The dimension rows; ``truth`` is (task_id, truth) and is met with the majority vote. The annotations are read once."""
    cells = checkpointed(count_cells(annotations))
    rows = consistency_dimension(annotations, cells=cells).unionByName(completeness_dimension(tasks, annotations, required, cells=cells))
    if truth is not None:
        voted = majority_vote(annotations, cells).join(truth, "task_id").select(F.col("majority").alias("predicted"), "truth")
        rows = rows.unionByName(accuracy_dimension(voted))
    if with_times:
        rows = rows.unionByName(timeliness_dimension(tasks, annotations, cells=cells))
    return rows


def project_summary(dimensions: DataFrame) -> DataFrame:
    """One row: overall score, number of issues, distinct recommendations in order."""
    return dimensions.agg(
        F.avg("score").alias("overall_score"), F.sum(F.size("issues")).cast("bigint").alias("issues"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("recommendations")))), "; ").alias("recommendations"),
    )


# ---- profiles ----------------------------------------------------------------------------

def annotator_profiles(annotations: DataFrame, issues: DataFrame) -> DataFrame:
    """Per annotator totals, agreement, time, consistency, issue counts and quality (mean of agreement and consistency)."""
    base = annotations.groupBy("annotator_id").agg(
        F.count(F.lit(1)).alias("total_annotations"), F.avg("lead_time").alias("avg_time"),
        F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"),
    )
    pairs = A.pair_agreement(A.pair_label_counts(annotations))
    counted = issues.filter("annotator_id IS NOT NULL").groupBy("annotator_id").agg(
        F.count(F.lit(1)).alias("issue_count"), F.count_if(F.col("severity").isin("high", "critical")).alias("serious_issues")
    )
    return (
        base.join(A.per_annotator_agreement(pairs), "annotator_id", "left")
        .join(A.intra_annotator_consistency(annotations).select("annotator_id", "consistency"), "annotator_id", "left")
        .join(counted, "annotator_id", "left")
        .withColumns({
            "issue_count": F.coalesce("issue_count", F.lit(0)), "serious_issues": F.coalesce("serious_issues", F.lit(0)),
            "agreement": F.coalesce("agreement", F.lit(1.0)),
        })
        .withColumn("quality_score", (F.col("agreement") + F.col("consistency")) / 2)
    )


def label_stats(annotations: DataFrame) -> DataFrame:
    """Per label usage, share, annotators, agreement (pairs that both say it / pairs where one does),
    consistency (tasks where it stands alone / tasks where it occurs)."""
    own = annotations.groupBy("label", "annotator_id").agg(F.count(F.lit(1)).alias("n"))
    usage = own.groupBy("label").agg(F.sum("n").alias("usage"), F.count(F.lit(1)).alias("annotators"))
    total = annotations.agg(F.count(F.lit(1)).alias("t"))
    counts = A.pair_label_counts(annotations)
    same = F.when(F.col("l1") == F.col("l2"), F.col("n")).otherwise(0)
    sides = F.array_distinct(F.array("l1", "l2"))
    agree = counts.select(F.explode(sides).alias("label"), "n", same.alias("same")).groupBy("label").agg(
        F.try_divide(F.sum("same").cast("double"), F.sum("n")).alias("agreement")
    )
    on_task = annotations.groupBy("task_id", "label").agg(F.count(F.lit(1)).alias("n"))
    kinds = on_task.groupBy("task_id").agg(F.count(F.lit(1)).alias("kinds"))
    alone = on_task.join(kinds, "task_id").groupBy("label").agg(share(F.col("kinds") == 1).alias("consistency"))
    return (
        usage.withColumn("t", total.scalar()).withColumn("share", F.col("usage") / F.col("t")).drop("t")
        .join(agree, "label", "left").join(alone, "label", "left")
    )

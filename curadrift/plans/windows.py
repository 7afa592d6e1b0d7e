"""Queries for ordered data: detectors and trajectories."""

from pyspark.sql import functions as F

from curadrift.functions.numbers import r6
from curadrift.operators import sequential as Q, trajectories as J
from curadrift.plans.ctes import sql
from curadrift.plans.registry import query
from curadrift.sources.tables import table, trajectories

ORDER = ["ts", "event_id"]
SERIES = "SELECT event_type AS k, ts, event_id, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events"


def series(spark, sf):
    return table(spark, sf, "events").select(F.col("event_type").alias("k"), "ts", "event_id", "value")


@query("page_hinkley", sql(
    "SELECT k, min(n) AS position, round(arg_min(m - low, n), 6) AS statistic FROM (SELECT *, min(m) OVER (PARTITION BY k ORDER BY n) AS low FROM (SELECT *, sum(x - 100.005) OVER (PARTITION BY k ORDER BY n) AS m FROM s)) WHERE m - low > 500 GROUP BY k", s=SERIES))
def page_hinkley(spark, sf):
    shifted = series(spark, sf).withColumn("x", F.col("value") - 100.0)
    out = Q.page_hinkley_first(shifted, "k", ORDER, "x", threshold=500.0)
    return out.withColumn("statistic", r6(F.col("statistic")))


@query("page_hinkley_resets", sql(
    "SELECT k, event_id, round(g, 6) AS statistic, n AS window_size FROM ph WHERE alarm",
    s=SERIES,
    ph="SELECT k, event_id, n, x - 0.005 AS m, x - 0.005 AS low, CAST(0 AS DOUBLE) AS g, false AS alarm FROM s WHERE n = 1 UNION ALL "
       "SELECT s.k, s.event_id, s.n, CASE WHEN a THEN 0 ELSE m2 END, CASE WHEN a THEN 'inf'::DOUBLE ELSE least(low, m2) END, m2 - least(low, m2), a FROM "
       "(SELECT s.k, s.event_id, s.n, ph.m + s.x - 0.005 AS m2, ph.low, ph.m + s.x - 0.005 - least(ph.low, ph.m + s.x - 0.005) > 50 AS a FROM ph JOIN s ON s.k = ph.k AND s.n = ph.n + 1) s"))
def page_hinkley_resets(spark, sf):
    out = Q.sequential_alarms(series(spark, sf), "k", ORDER, "value", Q.page_hinkley_scan())
    return out.select("k", "event_id", r6(F.col("statistic")).alias("statistic"), F.col("window_size").cast("bigint").alias("window_size"))


DDM = {
    "s": "SELECT user_id AS k, CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0 END AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events",
    "r": "SELECT k, n, p, sqrt(p * (1 - p) / n) AS s FROM (SELECT k, n, sum(x) OVER (PARTITION BY k ORDER BY n) / n AS p FROM s)",
    "b": "SELECT *, min(CASE WHEN n >= 30 THEN row(p + s, n, p, s) END) OVER (PARTITION BY k ORDER BY n) AS best FROM r",
}


@query("ddm", sql("SELECT k, n AS position, round(p, 6) AS p, round(s, 6) AS s, round(best[3], 6) AS p_min, round(best[4], 6) AS s_min FROM b WHERE n >= 30 AND p + s > best[3] + 3 * best[4]", **DDM))
def ddm(spark, sf):
    errors = table(spark, sf, "events").select(F.col("user_id").alias("k"), *ORDER, (F.col("event_type") == "error").cast("double").alias("error"))
    out = Q.ddm(errors, "k", ORDER, "error")
    return out.select("k", "position", *[r6(F.col(c)).alias(c) for c in ["p", "s", "p_min", "s_min"]])


ADWIN_SQL = sql(
    # the window is a list; one recursion step per position
    "SELECT k, event_id, round(gap, 6) AS statistic, len(w) AS window_size FROM ad WHERE alarm",
    s="SELECT k, event_id, x / 21 AS x, n FROM (" + SERIES + ")",
    ad="SELECT k, event_id, n, [x] AS w, CAST(0 AS DOUBLE) AS gap, false AS alarm FROM s WHERE n = 1 UNION ALL SELECT k, event_id, n, CASE WHEN cut IS NULL THEN w ELSE w[cut + 1:] END, "
       "CASE WHEN cut IS NULL THEN 0 ELSE abs(list_sum(w[1:cut]) / cut - list_sum(w[cut + 1:]) / (len(w) - cut)) END, cut IS NOT NULL FROM "
       "(SELECT k, event_id, n, w, CASE WHEN len(w) >= 10 THEN list_filter(range(greatest(len(w) // 2, 5), least(len(w) - 2, len(w) - 5) + 1), "
       "lambda c: abs(list_sum(w[1:c]) / c - list_sum(w[c + 1:]) / (len(w) - c)) >= sqrt(2 * (1.0 / c + 1.0 / (len(w) - c)) * ln(1000)))[1] END AS cut FROM "
       "(SELECT s.k, s.event_id, s.n, list_append(ad.w, s.x) AS w FROM ad JOIN s ON s.k = ad.k AND s.n = ad.n + 1))")


@query("adwin", ADWIN_SQL)
def adwin(spark, sf):
    scaled = series(spark, sf).withColumn("x", F.col("value") / 21)
    out = Q.sequential_alarms(scaled, "k", ORDER, "x", Q.adwin_scan())
    return out.select("k", "event_id", r6(F.col("statistic")).alias("statistic"), F.col("window_size").cast("bigint").alias("window_size"))


KIN = {
    "lg": "SELECT *, lag(s1) OVER w AS a1, lag(s2) OVER w AS a2, lag(s3) OVER w AS a3, lag(s1, 2) OVER w AS b1, lag(s2, 2) OVER w AS b2, lag(s3, 2) OVER w AS b3 FROM traj WINDOW w AS (PARTITION BY traj_id ORDER BY step)",
    "kn": "SELECT traj_id, step - 1 AS step, sqrt((s1 - a1) ** 2 + (s2 - a2) ** 2 + (s3 - a3) ** 2) AS speed, sqrt((s1 - 2 * a1 + b1) ** 2 + (s2 - 2 * a2 + b2) ** 2 + (s3 - 2 * a3 + b3) ** 2) AS acceleration, s1, s2, s3 FROM lg",
    "ob": "SELECT avg(s1) AS o1, avg(s2) AS o2, avg(s3) AS o3 FROM traj GROUP BY traj_id % 5",
    "hit": "SELECT traj_id, step, bool_or(sqrt((s1 - o1) ** 2 + (s2 - o2) ** 2 + (s3 - o3) ** 2) < 0.25) AS c FROM kn, ob GROUP BY 1, 2",
}


def obstacles(spark, sf):
    """Five obstacles at the mean states of five trajectory families."""
    return trajectories(spark, sf).groupBy(F.col("traj_id") % 5).agg(
        F.array(*[F.avg(F.col("state")[i]) for i in range(3)]).alias("position"), F.lit(0.2).alias("radius")
    )


def measured(spark, sf):
    return J.kinematics(trajectories(spark, sf), "traj_id", ORDER, obstacles(spark, sf))


@query("kinematic_limits", sql(
    "SELECT traj_id, step, round(speed, 6) AS speed, round(acceleration, 6) AS acceleration, array_to_string(list_filter([CASE WHEN c THEN 'collision' END, CASE WHEN speed > 1 THEN 'velocity' END, CASE WHEN acceleration > 2 THEN 'acceleration' END], lambda v: v IS NOT NULL), ',') AS violations FROM kn JOIN hit USING (traj_id, step)",
    "traj", **KIN))
def kinematic_limits(spark, sf):
    return measured(spark, sf).select(
        "traj_id", "step", r6(F.col("speed")).alias("speed"), r6(F.col("acceleration")).alias("acceleration"), F.array_join("violations", ",").alias("violations")
    )


@query("safety_report", sql(
    "SELECT traj_id, NOT bool_or(c) AS collision_free, NOT bool_or(coalesce(speed > 1, false)) AS velocity_ok, NOT bool_or(coalesce(acceleration > 2, false)) AS acceleration_ok, count(*) FILTER (WHERE c) + count(*) FILTER (WHERE speed > 1) + count(*) FILTER (WHERE acceleration > 2) AS violations, "
    "NOT bool_or(c OR coalesce(speed > 1, false) OR coalesce(acceleration > 2, false)) AS safe FROM kn JOIN hit USING (traj_id, step) GROUP BY 1", "traj", **KIN))
def safety_report(spark, sf):
    return J.safety_report(measured(spark, sf), "traj_id")


@query("obstacle_clearance", sql("SELECT traj_id, step FROM hit WHERE c", "traj", **KIN))
def obstacle_clearance(spark, sf):
    from curadrift.operators.ordered import indexed
    numbered = indexed(trajectories(spark, sf), ["traj_id"], ORDER)
    return J.obstacle_clearance(numbered, obstacles(spark, sf)).select("traj_id", (F.col("idx") - 1).alias("step"))

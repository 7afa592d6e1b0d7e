"""Queries that run a stream over a table to its end and return the result table."""

import os

from pyspark.sql import functions as F

from curadrift.functions.numbers import r6
from curadrift.operators.sequential import adwin_scan, page_hinkley_scan
from curadrift.plans.ctes import sql
from curadrift.plans.registry import query
from curadrift.plans.rows import NESTED
from curadrift.plans.windows import ADWIN_SQL, ORDER, SERIES
from curadrift.session import fresh_path
from curadrift.sources.messages import append_messages, message_stream as numbered_stream
from curadrift.sources.tables import ntz, points, table, tasks
from curadrift.streaming import operators as S, runs as R
from curadrift.streaming.sources import instant, table_stream


def events(spark, sf):
    return table_stream(spark, sf, "events").withColumn("at", instant(F.col("ts")))


def repeated(stream):
    """Every tenth message arrives twice."""
    return stream.withColumn("again", F.explode(F.when(F.col("event_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("again")


@query("stream_dedup", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1")
def stream_dedup(spark, sf):
    unique = S.dedup(repeated(events(spark, sf)), "event_id", "at", "40 days")
    out = R.drain(unique.select("event_id", "event_type", "value"), "dedup")
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))


@query("batch_consume", "SELECT event_id, value FROM events")
def batch_consume(spark, sf):
    root = fresh_path(spark, "consume")
    good, dead = os.path.join(root, "good"), os.path.join(root, "dead")

    def process(batch, batch_id):
        R.write_batch(batch.select("event_id", "value"), good, batch_id)

    R.drain_batches(events(spark, sf), R.with_dead_letters(process, dead, "props"), os.path.join(root, "checkpoint"))
    return R.read_batches(spark, good, "event_id bigint, value double").drop("batch_id")


@query("dead_letter_sink", "SELECT 'processor refused the batch' AS reason, length(props) AS payload_size, count(*) AS n FROM events GROUP BY 2")
def dead_letter_sink(spark, sf):
    root = fresh_path(spark, "dead")
    dead = os.path.join(root, "dead")

    def process(batch, batch_id):
        raise ValueError("processor refused the batch")

    R.drain_batches(events(spark, sf), R.with_dead_letters(process, dead, "props"), os.path.join(root, "checkpoint"))
    return R.read_batches(spark, dead, R.DEAD_LETTER_SCHEMA).groupBy("reason", "payload_size").agg(F.count(F.lit(1)).alias("n"))


def message_stream(spark, sf):
    e = events(spark, sf)
    kind = F.when(F.col("event_id") % 11 == 5, "").otherwise(F.col("event_type"))
    body = '{"type":"%s","payload":{"k":%s,"user":{"id":%d,"tags":["a","%s"]}}}'
    return e.select("event_id", F.format_string(body, kind, F.coalesce(F.get_json_object("props", "$.k"), F.lit("null")), "user_id", "event_type").alias("message"))


@query("stream_parse_messages", "SELECT event_id, event_type AS type, user_id AS payload_user_id FROM events WHERE event_id % 11 <> 5")
def stream_parse_messages(spark, sf):
    good, _ = S.parse_messages(message_stream(spark, sf), "message", NESTED)
    return R.drain(good.select("event_id", "type", "payload_user_id"), "parse")


@query("stream_parse_errors", "SELECT event_id, 'message has no type' AS error FROM events WHERE event_id % 11 = 5")
def stream_parse_errors(spark, sf):
    _, bad = S.parse_messages(message_stream(spark, sf), "message", NESTED)
    return R.drain(bad.select("event_id", "error"), "parse-errors")


@query("event_to_report", "SELECT 'event-' || event_id AS report_id, event_id AS seq, user_id % 5 AS total_samples, 0.0::DOUBLE AS mean_distance, 0.0::DOUBLE AS threshold, user_id % 5 AS drift_count FROM events WHERE event_type <> 'error'")
def event_to_report(spark, sf):
    payload = F.when(F.col("event_type") != "error", F.array_repeat(F.col("value"), (F.col("user_id") % 5).cast("int")))
    messages = events(spark, sf).select(F.col("event_id").alias("seq"), payload.alias("payload"))
    return R.drain(S.event_reports(messages), "event-reports")


KINDS = "CASE event_id % 4 WHEN 0 THEN 'report' WHEN 1 THEN 'review_log' WHEN 2 THEN 'snapshot' ELSE 'heartbeat' END"


@query("latest_state", (
    f"SELECT kind, id, seq, body FROM (SELECT kind, id, max(seq) AS seq, arg_max(body, seq) AS body, row_number() OVER (PARTITION BY kind ORDER BY max(seq) DESC) AS rn FROM (SELECT {KINDS} AS kind, CAST(user_id AS VARCHAR) AS id, event_id AS seq, event_type AS body FROM events) WHERE kind IN ('report', 'review_log') GROUP BY 1, 2) "
    f"WHERE rn <= CASE WHEN kind = 'report' THEN 100 ELSE 50 END UNION ALL SELECT kind, arg_max(id, seq), max(seq), arg_max(body, seq) FROM (SELECT {KINDS} AS kind, CAST(user_id AS VARCHAR) AS id, event_id AS seq, event_type AS body FROM events) WHERE kind IN ('snapshot', 'heartbeat') GROUP BY 1"))
def latest_state(spark, sf):
    root = fresh_path(spark, "latest")
    kinds = F.array(*[F.lit(k) for k in ["report", "review_log", "snapshot", "heartbeat"]])
    messages = events(spark, sf).select(
        F.get(kinds, (F.col("event_id") % 4).cast("int")).alias("kind"), F.col("user_id").cast("string").alias("id"),
        F.col("event_id").alias("seq"), F.col("event_type").alias("body"),
    )
    state = S.BatchState(spark, os.path.join(root, "state"), S.LATEST_SCHEMA)
    R.drain_batches(messages, S.latest_state_step(state), os.path.join(root, "checkpoint"))
    return state.current()


@query("resume_after_seq", "SELECT event_id AS seq, event_type FROM events WHERE event_id > (SELECT max(event_id) FROM events WHERE ts < TIMESTAMP '2024-01-02')")
def resume_after_seq(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("seq"), "event_type", "ts")
    return S.after_sequence(rows.drop("ts"), rows.filter(F.col("ts") < ntz("2024-01-02")))


@query("resumable_source", (
    "SELECT event_id AS seq, event_type, user_id, CASE WHEN event_id <= m // 3 THEN 0 WHEN event_id <= m // 2 THEN 1 ELSE 2 END AS run "
    "FROM events, (SELECT max(event_id) AS m FROM events) WHERE event_id > m // 10"))
def resumable_source(spark, sf):
    """Messages arrive in three lots; a stream that starts anew after each, from one checkpoint, reads every message once."""
    root = fresh_path(spark, "resumable")
    folder, out = os.path.join(root, "messages"), os.path.join(root, "out")
    rows = table(spark, sf, "events").select("event_id", "event_type", "user_id")
    m = rows.agg(F.max("event_id")).first()[0] or 0
    at = F.col("event_id")
    for lot in [at <= m // 3, (at > m // 3) & (at <= m // 2), at > m // 2]:
        append_messages(rows.filter(lot), at, F.to_json(F.struct("event_type", "user_id")), folder)
        stream = numbered_stream(spark, folder, after=m // 10)
        R.drain_batches(stream, lambda batch, batch_id: R.write_batch(batch, out, batch_id), os.path.join(root, "checkpoint"))
    body = F.from_json("body", "event_type string, user_id bigint").alias("m")
    read = R.read_batches(spark, out, "seq bigint, body string").select("seq", body, F.col("batch_id").alias("run"))
    return read.select("seq", "m.*", "run")


def run_detector(spark, sf, name, scan, scale):
    root = fresh_path(spark, name)
    series = events(spark, sf).select(F.col("event_type").alias("k"), *ORDER, (F.col("value") / scale).alias("x"))
    state = S.BatchState(spark, os.path.join(root, "state"), "k string, state array<double>")
    alarms = os.path.join(root, "alarms")
    R.drain_batches(series, S.sequential_step(state, alarms, "k", ORDER, "x", scan), os.path.join(root, "checkpoint"))
    schema = "k string, ts timestamp_ntz, event_id bigint, statistic double, score double, window_size int"
    return R.read_batches(spark, alarms, schema).select("k", "event_id", r6(F.col("statistic")).alias("statistic"), F.col("window_size").cast("bigint").alias("window_size"))


@query("sequential_drift_stream", sql(
    "SELECT k, event_id, round(g, 6) AS statistic, n AS window_size FROM ph WHERE alarm",
    s=SERIES,
    ph="SELECT k, event_id, n, x / 10 - 0.005 AS m, x / 10 - 0.005 AS low, CAST(0 AS DOUBLE) AS g, false AS alarm FROM s WHERE n = 1 UNION ALL "
       "SELECT s.k, s.event_id, s.n, CASE WHEN a THEN 0 ELSE m2 END, CASE WHEN a THEN 'inf'::DOUBLE ELSE least(low, m2) END, m2 - least(low, m2), a FROM "
       "(SELECT s.k, s.event_id, s.n, ph.m + s.x / 10 - 0.005 AS m2, ph.low, ph.m + s.x / 10 - 0.005 - least(ph.low, ph.m + s.x / 10 - 0.005) > 50 AS a FROM ph JOIN s ON s.k = ph.k AND s.n = ph.n + 1) s"))
def sequential_drift_stream(spark, sf):
    return run_detector(spark, sf, "page-hinkley", page_hinkley_scan(), 10)


@query("sequential_drift_stream_adwin", ADWIN_SQL)
def sequential_drift_stream_adwin(spark, sf):
    return run_detector(spark, sf, "adwin", adwin_scan(), 21)


MONITOR = {
    "base": "SELECT min(value) AS lo, (max(value) - min(value)) / 10 AS w FROM events WHERE ts < TIMESTAMP '2024-01-08'",
    "bn": "SELECT ts, greatest(0, least(CAST(floor((value - lo) / w) AS INTEGER), 9)) AS b FROM events, base",
    "rb": "SELECT b.i AS b, (count(bn.b) + 1.0::DOUBLE) / ((SELECT count(*) FROM bn WHERE ts < TIMESTAMP '2024-01-08') + 10) AS r FROM range(10) b(i) LEFT JOIN bn ON bn.b = b.i AND ts < TIMESTAMP '2024-01-08' GROUP BY 1",
    "days": "SELECT d, n FROM (SELECT date_trunc('day', ts) AS d, count(*) AS n FROM events GROUP BY 1)",
    "db": "SELECT d, n, rb.b, r, (count(bn.b) + 1.0::DOUBLE) / (n + 10) AS c FROM days CROSS JOIN rb LEFT JOIN bn ON bn.b = rb.b AND date_trunc('day', ts) = d GROUP BY d, n, rb.b, r",
}


@query("windowed_drift_monitor", sql(
    "SELECT epoch_us(d) AS window_start, n, round(sum((c - r) * ln(c / r)), 6) AS psi, round(0.5 * sum(r * ln(2 * r / (r + c)) + c * ln(2 * c / (r + c))), 6) AS js, round(sum((c - r) * (c - r) / r), 6) AS chi2, sum((c - r) * ln(c / r)) > 0.2 AS drift, d + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR AS closed FROM db GROUP BY d, n", **MONITOR))
def windowed_drift_monitor(spark, sf):
    baseline = S.histogram_baseline(table(spark, sf, "events").filter(F.col("ts") < ntz("2024-01-08")), "value", 10)
    out = S.drift_of_counts(R.drain_windows(S.bin_counts(events(spark, sf), "at", "value", baseline), "monitor"), baseline)
    return out.withColumns({c: r6(F.col(c)) for c in ["psi", "js", "chi2"]})


@query("activity_trigger", (
    "WITH w AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01') - to_minutes(5 * i) AS s FROM events, range(12) r(i)) "
    "SELECT epoch_us(s + INTERVAL 1 HOUR) AS window_end, count(*) AS n, s + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE AS closed FROM w GROUP BY s HAVING count(*) >= 20"))
def activity_trigger(spark, sf):
    return S.active(R.drain_windows(S.window_counts(events(spark, sf), "at"), "activity"), 20)


@query("round_tracker", sql(
    "SELECT id // 10 AS round_id, count(*) AS selected FROM tasks LEFT JOIN (SELECT DISTINCT task_id FROM annotations WHERE annotator_id <> 0) a ON a.task_id = id GROUP BY 1 HAVING count(*) = count(a.task_id)", "tasks", "annotations"))
def round_tracker(spark, sf):
    root = fresh_path(spark, "rounds")
    selected = tasks(spark, sf).select(F.col("id").alias("task_id"), F.floor(F.col("id") / 10).alias("round_id"))
    stream = events(spark, sf).select(F.floor(F.col("event_id") / 5).alias("task_id"), (F.col("user_id") % 12 == 0).alias("was_cancelled"))
    done = os.path.join(root, "done")
    state = S.BatchState(spark, os.path.join(root, "open"), S.ROUND_SCHEMA, initial=S.open_rounds(selected))
    R.drain_batches(stream, S.round_tracker_step(state, done), os.path.join(root, "checkpoint"))
    return R.read_batches(spark, done, "round_id bigint, selected bigint").drop("batch_id")


@query("stream_static_enrich", "SELECT e.event_id AS sample_id, coalesce(CAST(m.label AS VARCHAR), '') AS label, coalesce(m.label, 0) AS label_id FROM events e LEFT JOIN embeddings m ON m.vec_id = e.event_id")
def stream_static_enrich(spark, sf):
    known = points(spark, sf).select(F.col("id").alias("sample_id"), "label", F.col("label").cast("bigint").alias("label_id"))
    stream = events(spark, sf).select(F.col("event_id").alias("sample_id"), F.lit("").alias("label"), F.lit(0).cast("bigint").alias("label_id"))
    return R.drain(S.enrich(stream, known), "enrich")

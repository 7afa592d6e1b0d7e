"""Queries for the row-wise rules."""

from pyspark.sql import functions as F

from curadrift.functions import labels as L, rules as R, vectors as V
from curadrift.functions.numbers import r6
from curadrift.operators import projections as P
from curadrift.operators.entities import smallest_n
from curadrift.plans.ctes import sql
from curadrift.plans.registry import query
from curadrift.sources.tables import annotation_json, preference_pairs, samples, table, trajectories

LABEL_SQL = "CASE id % 4 WHEN 3 THEN 'unknown' ELSE label END"


@query("extract_label", sql(f"SELECT id, {LABEL_SQL} AS label FROM annotations", "annotations"))
def extract_label(spark, sf):
    return P.with_label(P.parse_annotations(annotation_json(spark, sf))).select("id", "label")


@query("parse_annotations", sql(
    "SELECT id, CASE id % 4 WHEN 2 THEN 2 ELSE 1 END AS n_items, CASE WHEN id % 4 = 0 THEN label END AS first_choice, "
    "CASE WHEN id % 4 = 1 THEN 0.7 END::DOUBLE AS label_prob, CASE WHEN id % 4 = 2 THEN label || ',second' END AS labels, "
    "CASE WHEN id % 4 = 3 THEN 0.25 END::DOUBLE AS score FROM annotations", "annotations"))
def parse_annotations(spark, sf):
    parsed = P.parse_annotations(annotation_json(spark, sf))
    first, last = F.col("items")[0], F.element_at("items", -1)
    return parsed.select(
        "id", F.size("items").alias("n_items"), F.get(first["choices_list"], F.lit(0)).alias("first_choice"),
        F.try_element_at(first["choices_prob"], F.col("label")).alias("label_prob"),
        F.array_join(last["labels"], ",").alias("labels"), first["score"].alias("score"),
    )


@query("extract_labels_all", sql(
    "SELECT label, count(*) AS n FROM (SELECT label FROM annotations WHERE id % 4 <> 3 UNION ALL SELECT 'other' FROM annotations WHERE id % 4 = 1 "
    "UNION ALL SELECT 'second' FROM annotations WHERE id % 4 = 2) GROUP BY label", "annotations"))
def extract_labels_all(spark, sf):
    return P.label_counts_all(P.parse_annotations(annotation_json(spark, sf)))


@query("extract_probabilities", sql(
    "SELECT id, CASE id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 WHEN 3 THEN 0.75 END::DOUBLE AS top, CASE id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 3 THEN 2 END AS classes FROM annotations", "annotations"))
def extract_probabilities(spark, sf):
    parsed = P.parse_annotations(annotation_json(spark, sf))
    p = L.extract_probabilities(F.col("items")[0])
    return parsed.select("id", F.array_max(p).alias("top"), F.when(p.isNotNull(), F.size(p)).alias("classes"))


MD5_BUCKET = "CAST(CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT) % 1000 AS DOUBLE)"


@query("extract_features_long", sql(
    "SELECT o_orderkey, 'o_totalprice' AS feature, o_totalprice AS value FROM orders UNION ALL SELECT o_orderkey, 'o_custkey', CAST(o_custkey AS DOUBLE) FROM orders "
    f"UNION ALL SELECT o_orderkey, 'o_orderpriority', {MD5_BUCKET.format('o_orderpriority')} FROM orders"))
def extract_features_long(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey", "o_orderpriority", "o_orderdate")
    return P.features_long(orders, "o_orderkey")


@query("extract_features_vector", sql(
    f"SELECT o_orderkey, v[1] AS f0, v[2] AS f1, v[3] AS f2 FROM (SELECT o_orderkey, CASE WHEN o_custkey % 9 = 0 THEN [{MD5_BUCKET.format('o_orderpriority')} / 1000, o_totalprice, 0.0] "
    f"ELSE [CAST(o_custkey AS DOUBLE), {MD5_BUCKET.format('o_orderpriority')} / 1000, o_totalprice] END AS v FROM orders)"))
def extract_features_vector(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_totalprice", F.when(F.col("o_custkey") % 9 != 0, F.col("o_custkey")).alias("o_custkey"), "o_orderpriority"
    )
    out = P.features_vector(orders, "o_orderkey")
    return out.select("o_orderkey", *[F.col("features")[i].alias(f"f{i}") for i in range(3)])


NESTED = "type STRING, payload STRUCT<k: BIGINT, user: STRUCT<id: BIGINT, tags: ARRAY<STRING>>>"


def nested_messages(spark, sf):
    """Events wrapped as nested JSON; every eleventh has no type."""
    kind = F.when(F.col("event_id") % 11 == 5, "").otherwise(F.col("event_type"))
    return table(spark, sf, "events").select(
        "event_id",
        F.format_string(
            '{"type":"%s","payload":{"k":%s,"user":{"id":%d,"tags":["a","%s"]}}}',
            kind, F.coalesce(F.get_json_object("props", "$.k"), F.lit("null")), "user_id", "event_type",
        ).alias("message"),
    )


@query("flatten_json", (
    "SELECT event_id, event_type AS type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS payload_k, user_id AS payload_user_id, 'a,' || event_type AS payload_user_tags "
    "FROM events WHERE event_id % 11 <> 5"))
def flatten_json(spark, sf):
    good, _ = P.flatten_json(nested_messages(spark, sf), "message", NESTED)
    return good.withColumn("payload_user_tags", F.array_join("payload_user_tags", ","))


@query("flatten_json_errors", "SELECT event_id, 'message has no type' AS error FROM events WHERE event_id % 11 = 5")
def flatten_json_errors(spark, sf):
    return P.flatten_json(nested_messages(spark, sf), "message", NESTED)[1].select("event_id", "error")


def tagged_text(spark, sf):
    """Documents whose whole text gets a tag before each sentence, one sentence per line."""
    tags = ["[ERROR] ", "[INFO] ", ">>> ", "# ", "#x ", "[WARN] ", "--- ", ""]
    tag = F.array(*[F.lit(t) for t in tags])[(F.col("doc_id") % 8).cast("int")]
    return table(spark, sf, "documents").select(
        "doc_id", F.concat(tag, F.replace("text", F.lit(". "), F.concat(F.lit(".\n"), tag))).alias("text")
    )


TAGGED = (
    "SELECT doc_id, tag || replace(text, '. ', '.' || chr(10) || tag) AS text FROM (SELECT *, ['[ERROR] ', '[INFO] ', '>>> ', '# ', '#x ', '[WARN] ', '--- ', ''][doc_id % 8 + 1] AS tag FROM documents)"
)
LINES = "SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM tagged)"
LINE_TYPE = (
    "CASE WHEN starts_with(text, '>>> ') OR starts_with(text, '$ ') THEN 'code' WHEN starts_with(text, '[ERROR]') OR starts_with(text, 'Error:') OR contains(text, 'Traceback') THEN 'error' "
    "WHEN starts_with(text, '[WARN]') THEN 'stderr' WHEN starts_with(text, '[INFO]') OR starts_with(text, '[OK]') THEN 'info' WHEN starts_with(text, '---') OR starts_with(text, '===') THEN 'separator' "
    "WHEN starts_with(text, '#') AND length(text) > 1 AND substr(text, 2, 1) <> ' ' THEN 'system' ELSE 'stdout' END"
)


@query("parse_log_lines", sql(
    f"SELECT doc_id, line_no, md5(text) AS line_md5, {LINE_TYPE} AS type, {LINE_TYPE} = 'code' AS section_start, CASE WHEN {LINE_TYPE} = 'code' THEN substr(text, 1, 60) END AS section_title FROM lines",
    tagged=TAGGED, lines=LINES))
def parse_log_lines(spark, sf):
    return P.parse_log_lines(tagged_text(spark, sf), "doc_id", "text").withColumn("line_md5", F.md5("text")).drop("text")


@query("text_search", sql("SELECT doc_id, line_no FROM lines WHERE contains(lower(text), 'data')", tagged=TAGGED, lines=LINES))
def text_search(spark, sf):
    lines = P.parse_log_lines(tagged_text(spark, sf), "doc_id", "text")
    return P.text_search(lines, "text", "DATA").select("doc_id", "line_no")


def _scored(spark, sf):
    return table(spark, sf, "events").select("event_id", (F.col("value") / 500).alias("s"))


def _cases(name, edges, op):
    names = ["none", "low", "medium", "high", "critical"]
    return "CASE " + " ".join(f"WHEN s {op} {e} THEN '{n}'" for e, n in zip(edges, names)) + f" ELSE 'critical' END AS {name}"


@query("severity_rules", (
    "SELECT event_id, " + _cases("by_p", [0.1, 0.05, 0.01, 0.001], ">") + ", " + _cases("by_distance", [0.05, 0.1, 0.2, 0.5], "<") + ", "
    + _cases("by_psi", [0.1, 0.2, 0.3, 0.5], "<") + " FROM (SELECT event_id, value / 500 AS s FROM events)"))
def severity_rules(spark, sf):
    s = F.col("s")
    return _scored(spark, sf).select(
        "event_id", R.severity_from_p(s).alias("by_p"), R.severity_from_distance(s).alias("by_distance"),
        R.severity_from_psi(s).alias("by_psi"),
    )


@query("drift_levels", (
    "SELECT event_id, " + _cases("feature_level", [0.1, 0.3, 0.5, 0.7], "<") + ", CASE WHEN s > 0.7 THEN 'critical' WHEN s > 0.5 THEN 'high' WHEN s > 0.3 THEN 'medium' WHEN s > 0.1 THEN 'low' ELSE 'none' END AS overall_level, "
    "CASE WHEN event_id % 10 = 0 THEN 0.5 ELSE round(greatest(0, 1 - s), 6) END AS score FROM (SELECT event_id, value / 500 AS s FROM events)"))
def drift_levels(spark, sf):
    s = F.col("s")
    return _scored(spark, sf).select(
        "event_id", R.feature_drift_level(s).alias("feature_level"), R.overall_drift_level(s).alias("overall_level"),
        F.round(R.score_from_p(F.when(F.col("event_id") % 10 != 0, s)), 6).alias("score"),
    )


@query("drift_explanation", (
    "SELECT u AS user_id, CASE WHEN n = 0 THEN 'No drift detected. System is operating normally.' ELSE format('The data points {} drifted because they are significantly far from the cluster centroid (Score: {:.2f}).', ids, score) END AS by_distance, "
    "CASE WHEN n = 0 THEN 'No drift detected. System is operating normally.' ELSE 'We detected anomalous behavior in ' || ids || ' due to unexpected feature distributions (Severity: ' || CASE WHEN score > 0.8 THEN 'High' WHEN score > 0.5 THEN 'Medium' ELSE 'Low' END || ').' END AS by_feature "
    "FROM (SELECT u, n, score, array_to_string(l[1:3], ', ') || CASE WHEN n > 3 THEN ' and ' || (n - 3) || ' others' ELSE '' END AS ids FROM "
    "(SELECT user_id AS u, coalesce(list(CAST(event_id AS VARCHAR) ORDER BY event_id) FILTER (WHERE value > 200), []) AS l, count(*) FILTER (WHERE value > 200) AS n, round(max(value) / 500, 2) AS score FROM events GROUP BY user_id))"))
def drift_explanation(spark, sf):
    # the three smallest ids come from ordered minima, so no group is collected
    flagged = F.when(F.col("value") > 200, F.col("event_id"))
    events = table(spark, sf, "events").withColumn("flagged", flagged)
    ids = smallest_n(events.filter("flagged IS NOT NULL"), ["user_id"], "flagged", 3)
    heads = events.groupBy("user_id").agg(F.count("flagged").alias("n"), F.round(F.max("value") / 500, 2).alias("score"))
    joined = heads.join(ids, "user_id", "left").withColumn(
        "ids", F.coalesce(F.transform("smallest", lambda x: x.cast("string")), F.array().cast("array<string>"))
    )
    def text(template):
        return R.drift_explanation(F.col("ids"), F.col("n"), F.col("score"), template)
    return joined.select("user_id", text(0).alias("by_distance"), text(1).alias("by_feature"))


def _entities(spark, sf):
    scored = table(spark, sf, "events").select(
        F.col("event_id").alias("image_id"), F.col("event_type").alias("label"),
        R.severity_from_distance(F.col("value") / 500).alias("severity"), (F.col("value") > 100).alias("is_drift"),
    )
    return scored


ENT = "SELECT event_id AS image_id, event_type AS label, " + _cases("severity", [0.05, 0.1, 0.2, 0.5], "<") + ", value > 100 AS is_drift FROM (SELECT *, value / 500 AS s FROM events)"


@query("dataset_filter", sql("SELECT image_id, label, severity FROM ent WHERE label IN ('click', 'error', 'purchase') AND severity IN ('high', 'critical') AND is_drift AND (contains(CAST(image_id AS VARCHAR), 'r') OR contains(lower(label), 'r'))", ent=ENT))
def dataset_filter(spark, sf):
    return P.dataset_filter(
        _entities(spark, sf), ["click", "error", "purchase"], ["high", "critical"], True, "R"
    ).select("image_id", "label", "severity")


@query("filter_by_severity", sql("SELECT image_id, severity FROM ent WHERE severity IN ('low', 'medium')", ent=ENT))
def filter_by_severity(spark, sf):
    return P.filter_by_severity(_entities(spark, sf), ["low", "medium"]).select("image_id", "severity")


PROBLEMS = (
    "list_filter([CASE WHEN prompt IS NULL OR length(trim(prompt)) < 5 THEN 'prompt too short' END, CASE WHEN length(prompt) > 8192 THEN 'prompt too long' END, "
    "CASE WHEN chosen IS NULL OR trim(chosen) = '' THEN 'chosen is blank' END, CASE WHEN rejected IS NULL OR trim(rejected) = '' THEN 'rejected is blank' END, "
    "CASE WHEN confidence IS NULL OR confidence NOT BETWEEN 0.1 AND 1 THEN 'confidence out of range' END, CASE WHEN turn_length <= 0 THEN 'turn_length not positive' END], lambda r: r IS NOT NULL)"
)


@query("validate_preference", sql("SELECT conv_id, turn, confidence, turn_length, md5(chosen) AS chosen_md5, md5(rejected) AS rejected_md5 FROM pref WHERE len(" + PROBLEMS + ") = 0", "pref"))
def validate_preference(spark, sf):
    good, _ = P.validate_preference(preference_pairs(spark, sf))
    return good.select("conv_id", "turn", "confidence", "turn_length", F.md5("chosen").alias("chosen_md5"), F.md5("rejected").alias("rejected_md5"))


@query("validate_preference_quarantine", sql("SELECT conv_id, turn, array_to_string(r, ',') AS reasons FROM (SELECT *, " + PROBLEMS + " AS r FROM pref) WHERE len(r) > 0", "pref"))
def validate_preference_quarantine(spark, sf):
    _, bad = P.validate_preference(preference_pairs(spark, sf))
    return bad.select("conv_id", "turn", F.array_join("reasons", ",").alias("reasons"))


NEXT = "SELECT *, lead(s1) OVER w AS n1, lead(s2) OVER w AS n2, lead(s3) OVER w AS n3 FROM traj WINDOW w AS (PARTITION BY traj_id ORDER BY step)"


@query("actions_from_trajectory", sql(
    "SELECT traj_id, step AS idx, round(n1 - s1, 6) + 0.0 AS m1, round(n2 - s2, 6) + 0.0 AS m2, round(n3 - s3, 6) + 0.0 AS m3, round((step - 1) * 0.1, 6) AS at_time FROM nx WHERE n1 IS NOT NULL", "traj", nx=NEXT))
def actions_from_trajectory(spark, sf):
    out = P.actions_from_trajectory(trajectories(spark, sf), order=["ts", "event_id"])
    return out.select("traj_id", "idx", *[r6(F.col("move")[i]).alias(f"m{i + 1}") for i in range(3)], r6(F.col("at")).alias("at_time"))


@query("actions_velocity", sql(
    "SELECT traj_id, step AS idx, round((n1 - s1) / 0.1, 4) + 0.0 AS v1, round((n2 - s2) / 0.1, 4) + 0.0 AS v2, round((n3 - s3) / 0.1, 4) + 0.0 AS v3 FROM nx WHERE n1 IS NOT NULL", "traj", nx=NEXT))
def actions_velocity(spark, sf):
    out = P.actions_from_trajectory(trajectories(spark, sf), order=["ts", "event_id"], control="velocity")
    return out.select("traj_id", "idx", *[(F.round(F.col("move")[i], 4) + 0.0).alias(f"v{i + 1}") for i in range(3)])


@query("batch_inference", sql(
    "SELECT image_id, 'DONE' AS status, round(sqrt(list_sum(list_transform(embedding, lambda x: (2 * x) ** 2))), 6) AS length FROM samples", "samples"))
def batch_inference(spark, sf):
    out = P.batch_inference(samples(spark, sf), "image_id", "embedding", lambda m: m * 2.0)
    return out.select("image_id", "status", r6(V.norm(F.col("output"))).alias("length"))

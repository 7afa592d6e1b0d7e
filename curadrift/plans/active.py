"""Queries for active learning."""

from pyspark.sql import functions as F

from curadrift.functions import probabilities as P
from curadrift.functions.numbers import r6
from curadrift.operators import outliers as O, selection as S
from curadrift.plans.ctes import sql
from curadrift.plans.registry import query
from curadrift.sources.tables import annotations, committee, points, predictions, samples, table, tasks

ENTROPY = "list_sum(list_transform({0}, lambda x: -greatest(x, 1e-10) * ln(greatest(x, 1e-10))))"


def e(p: str) -> str:
    return ENTROPY.format(p)


def norm_sql(source: str, score: str = "s") -> str:
    return f"CASE WHEN max({score}) OVER () = min({score}) OVER () THEN 0.5 ELSE ({score} - min({score}) OVER ()) / (max({score}) OVER () - min({score}) OVER ()) END"


def scored(df):
    return df.select("task_id", r6(F.col("score")).alias("score"))


@query("uncertainty_measures", sql(
    f"SELECT task_id, round(1 - list_max(probs), 6) AS least_confidence, round(1 - (list_reverse_sort(probs)[1] - list_reverse_sort(probs)[2]), 6) AS margin, round({e('probs')} / ln(3), 6) AS entropy, round({e('probs')}, 6) AS raw_entropy FROM predictions", "predictions"))
def uncertainty_measures(spark, sf):
    p = F.col("probs")
    return predictions(spark, sf).select(
        "task_id", r6(P.least_confidence(p)).alias("least_confidence"), r6(P.margin(p)).alias("margin"),
        r6(P.entropy(p)).alias("entropy"), r6(P.raw_entropy(p)).alias("raw_entropy"),
    )


MULTI = (
    "SELECT task_id, list_transform(probs, lambda x: x / list_sum(probs)) AS probs FROM predictions WHERE task_id % 5 <> 4 "
    "UNION ALL SELECT task_id - 1, list_transform(probs, lambda x: x / list_sum(probs)) FROM predictions WHERE task_id % 5 = 4"
)


def multi_predictions(spark, sf):
    """Every fifth row predicts for the task before it: some tasks have two predictions, some none."""
    fifth = F.col("task_id") % 5 == 4
    return predictions(spark, sf).withColumn("task_id", F.when(fifth, F.col("task_id") - 1).otherwise(F.col("task_id")))


UNCERTAIN = {
    "mp": MULTI,
    "mu": f"SELECT task_id, avg({e('probs')} / ln(3)) AS u FROM mp GROUP BY 1",
    "us": "SELECT p.task_id, coalesce(u, 1.0) AS s FROM predictions p LEFT JOIN mu USING (task_id)",
}


@query("task_uncertainty", sql(f"SELECT task_id, round({norm_sql('us')}, 6) AS score FROM us", "predictions", **UNCERTAIN))
def task_uncertainty(spark, sf):
    return scored(S.task_uncertainty(predictions(spark, sf), multi_predictions(spark, sf)))


@query("task_uncertainty_margin", sql(
    f"SELECT task_id, round({norm_sql('us')}, 6) AS score FROM us", "predictions", mp=MULTI,
    mu="SELECT task_id, avg(1 - (list_reverse_sort(probs)[1] - list_reverse_sort(probs)[2])) AS u FROM mp GROUP BY 1", us=UNCERTAIN["us"]))
def task_uncertainty_margin(spark, sf):
    return scored(S.task_uncertainty(predictions(spark, sf), multi_predictions(spark, sf), "margin"))


COMMITTEE = {
    "cons": "SELECT task_id, [avg(p[1]), avg(p[2]), avg(p[3])] AS c FROM members GROUP BY 1",
    "votes": "SELECT task_id, vote, count(*) / 5 AS f FROM (SELECT task_id, list_position(p, list_max(p)) AS vote FROM members) GROUP BY 1, 2",
    "ve": "SELECT task_id, sum(-f * ln(f)) + (3 - count(*)) * (-1e-10 * ln(1e-10)) AS v, CASE WHEN count(*) > 1 THEN sum(-f * ln(f)) / ln(count(*)) ELSE 0.0 END AS vn FROM votes GROUP BY 1",
    "kl": "SELECT task_id, avg(p[1] * ln(p[1] / c[1]) + p[2] * ln(p[2] / c[2]) + p[3] * ln(p[3] / c[3])) AS k FROM members JOIN cons USING (task_id) GROUP BY 1",
}


@query("committee_measures", sql(
    f"SELECT task_id, round(v, 6) AS vote_entropy, round(vn, 6) + 0.0 AS vote_entropy_normalized, round(k, 6) AS kl_divergence, round({e('c')}, 6) AS consensus_entropy, round({e('c')} / ln(3), 6) AS consensus_entropy_normalized FROM ve JOIN kl USING (task_id) JOIN cons USING (task_id)",
    "members", **COMMITTEE))
def committee_measures(spark, sf):
    m = F.col("members")
    c = P.consensus(m)
    return committee(spark, sf).select(
        "task_id", r6(P.vote_entropy(m)).alias("vote_entropy"), r6(P.vote_entropy_normalized(m)).alias("vote_entropy_normalized"),
        r6(P.kl_to_consensus(m)).alias("kl_divergence"), r6(P.raw_entropy(c)).alias("consensus_entropy"),
        r6(P.entropy(c)).alias("consensus_entropy_normalized"),
    )


@query("committee_select", sql(
    "SELECT task_id, round(s, 6) AS score, rank FROM (SELECT task_id, s, row_number() OVER (ORDER BY s DESC, task_id) AS rank FROM (SELECT task_id, " + norm_sql("kl", "k") + " AS s FROM kl)) WHERE rank <= 20",
    "members", **COMMITTEE))
def committee_select(spark, sf):
    best = S.top_k(S.committee_scores(committee(spark, sf), "kl_divergence"), 20)
    return best.select("task_id", r6(F.col("score")).alias("score"), "rank")


@query("committee_scores", sql(f"SELECT task_id, round({norm_sql('ve', 'vn')}, 6) + 0.0 AS score FROM ve", "members", **COMMITTEE))
def committee_scores(spark, sf):
    return scored(S.committee_scores(committee(spark, sf), "vote_entropy"))


ANCHORS = {
    "anchors": "SELECT label AS anchor, list(m ORDER BY pos) AS v FROM (SELECT label, pos, avg(x) AS m FROM flat GROUP BY 1, 2) GROUP BY 1",
}


@query("pairwise_distance", sql(
    "SELECT image_id, anchor, round(1 - list_cosine_similarity(embedding, v), 6) AS cosine, round(list_distance(embedding, v), 6) AS euclidean, "
    "round(list_sum(list_transform(list_zip(embedding, v), lambda z: abs(z[1] - z[2]))), 6) AS manhattan FROM samples, anchors", "flat", **ANCHORS))
def pairwise_distance(spark, sf):
    df = samples(spark, sf)
    anchors = O.centroid(df, by=["label"]).select(F.col("label").alias("anchor"), F.col("centroid").alias("v"))
    metrics = ["cosine", "euclidean", "manhattan"]
    out = S.anchor_distances(df, "image_id", "embedding", anchors, metrics)
    return out.select("image_id", "anchor", *[r6(F.col(m)).alias(m) for m in metrics])


PAIRS_D = "SELECT a.image_id, avg({0}) AS s FROM samples a, samples b GROUP BY 1"


@query("diversity_cosine", sql(f"SELECT image_id AS task_id, round({norm_sql('dv')}, 6) AS score FROM dv", "samples", dv=PAIRS_D.format("1 - list_cosine_similarity(a.embedding, b.embedding)")))
def diversity_cosine(spark, sf):
    return scored(S.diversity_scores(samples(spark, sf), "image_id", "embedding", "cosine"))


@query("diversity_euclidean", sql(f"SELECT image_id AS task_id, round({norm_sql('dv')}, 6) AS score FROM dv", "samples", dv=PAIRS_D.format("list_distance(a.embedding, b.embedding)")))
def diversity_euclidean(spark, sf):
    return scored(S.diversity_scores(samples(spark, sf), "image_id", "embedding", "euclidean"))


@query("diversity_manhattan", sql("SELECT image_id AS task_id, round(avg(s), 6) AS score FROM (SELECT a.image_id, b.image_id AS o, sum(abs(a.x - b.x)) AS s FROM flat a JOIN flat b USING (pos) GROUP BY 1, 2) GROUP BY 1", "flat"))
def diversity_manhattan(spark, sf):
    out = S.diversity_manhattan(samples(spark, sf), "image_id", "embedding")
    return out.select(F.col("image_id").alias("task_id"), r6(F.col("score")).alias("score"))


@query("min_max_normalize", (
    "SELECT event_id, round(CASE WHEN max(value) OVER w = min(value) OVER w THEN 0.5 ELSE (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) END, 6) AS score FROM events WINDOW w AS (PARTITION BY event_type)"))
def min_max_normalize(spark, sf):
    df = table(spark, sf, "events").select("event_id", "event_type", F.col("value").alias("score"))
    return S.min_max_normalize(df, by=["event_type"]).select("event_id", r6(F.col("score")).alias("score"))


@query("rank_scores", "SELECT event_id AS task_id, row_number() OVER (ORDER BY value DESC, event_id) AS rank, row_number() OVER (ORDER BY value DESC, event_id) <= 100 AS is_selected FROM events")
def rank_scores(spark, sf):
    df = table(spark, sf, "events").select(F.col("event_id").alias("task_id"), F.col("value").alias("score"))
    return S.rank_scores(df, 100).drop("score")


@query("top_k_select", "SELECT event_id AS task_id, value AS score, row_number() OVER (ORDER BY value DESC, event_id) AS rank FROM events ORDER BY value DESC, event_id LIMIT 25")
def top_k_select(spark, sf):
    return S.top_k(table(spark, sf, "events").select(F.col("event_id").alias("task_id"), F.col("value").alias("score")), 25)


@query("farthest_first", sql(
    # one row per pick: the row whose smallest distance to the picks so far is largest
    "SELECT rank, id AS task_id, round(gap, 6) AS score FROM ff WHERE rank > 1",
    "samples",
    pd="SELECT a.image_id AS i, b.image_id AS j, list_distance(a.embedding, b.embedding) AS d FROM samples a, samples b",
    ff="SELECT 1 AS rank, CAST(0 AS BIGINT) AS id, CAST(NULL AS DOUBLE) AS gap, [CAST(0 AS BIGINT)] AS picks UNION ALL "
       "SELECT * FROM (SELECT rank + 1, i, g, list_append(picks, i) FROM (SELECT rank, picks, i, min(d) AS g FROM ff, pd WHERE list_contains(picks, j) AND NOT list_contains(picks, i) GROUP BY rank, picks, i) WHERE rank < 12 ORDER BY g DESC, i LIMIT 1)"))
def farthest_first(spark, sf):
    out = S.farthest_first(samples(spark, sf), "image_id", "embedding", 12, start=0)
    return out.filter("rank > 1").select("rank", "task_id", r6(F.col("score")).alias("score"))


@query("kmeans_representatives")
def kmeans_representatives(spark, sf):
    return S.kmeans_representatives(samples(spark, sf), "image_id", "embedding", 10)


LLOYD = {"s0": "SELECT * FROM (SELECT row_number() OVER (ORDER BY CAST('0x' || substr(md5(image_id || '|42'), 1, 13) AS BIGINT), image_id) - 1 AS c, embedding AS v FROM samples) WHERE c < 10"}
for turn in range(5):
    LLOYD |= {
        f"a{turn}": f"SELECT image_id, any_value(embedding) AS e, arg_min(c, (list_distance(embedding, v), c)) AS c FROM samples, s{turn} GROUP BY 1",
        f"m{turn}": f"SELECT c, list(m ORDER BY pos) AS v FROM (SELECT c, pos, avg(x) AS m FROM (SELECT c, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM a{turn}) GROUP BY 1, 2) GROUP BY 1",
        f"s{turn + 1}": f"SELECT s.c, coalesce(m.v, s.v) AS v FROM s{turn} s LEFT JOIN m{turn} m ON m.c = s.c",
    }
LLOYD["near"] = "SELECT image_id, arg_min(c, (list_distance(embedding, v), c)) AS c, min(list_distance(embedding, v)) AS d FROM samples, s5 GROUP BY 1"


@query("kmeans_rounds", sql("SELECT CAST(c AS INTEGER) AS cluster, arg_min(image_id, (d, image_id)) AS task_id, round(min(d), 6) AS score FROM near GROUP BY 1", "samples", **LLOYD))
def kmeans_rounds(spark, sf):
    return S.kmeans_rounds(samples(spark, sf), "image_id", "embedding", 10).withColumn("score", r6(F.col("score")))


HYBRID = {
    **COMMITTEE, "h_u": f"SELECT task_id, {norm_sql('x')} AS s FROM (SELECT task_id, {e('probs')} / ln(3) AS s FROM predictions)",
    "h_d": f"SELECT image_id AS task_id, {norm_sql('dv')} AS s FROM (" + PAIRS_D.format("1 - list_cosine_similarity(a.embedding, b.embedding)") + ")",
    "h_c": f"SELECT task_id, {norm_sql('ve', 'vn')} AS s FROM ve",
    "hy": "SELECT task_id, 0.4 * h_u.s + 0.3 * h_d.s + 0.3 * h_c.s AS s FROM h_u JOIN h_d USING (task_id) JOIN h_c USING (task_id)",
}


def hybrid_parts(spark, sf):
    return {
        "uncertainty": S.task_uncertainty(predictions(spark, sf), predictions(spark, sf)),
        "diversity": S.diversity_scores(samples(spark, sf), "image_id", "embedding", "cosine"),
        "committee": S.committee_scores(committee(spark, sf)),
    }


@query("hybrid_score", sql(f"SELECT task_id, round({norm_sql('hy')}, 6) AS score FROM hy", "predictions", "members", "samples", **HYBRID))
def hybrid_score(spark, sf):
    return scored(S.hybrid_scores(hybrid_parts(spark, sf), {"uncertainty": 0.4, "diversity": 0.3, "committee": 0.3}))


@query("hybrid_score_list", sql("SELECT task_id, round((2 * h_u.s + h_d.s + h_c.s) / 4, 6) AS score FROM h_u JOIN h_d USING (task_id) JOIN h_c USING (task_id)", "predictions", "members", "samples", **{k: v for k, v in HYBRID.items() if k != "hy"}))
def hybrid_score_list(spark, sf):
    return scored(S.hybrid_scores(hybrid_parts(spark, sf), {"uncertainty": 2.0, "diversity": 1.0, "committee": 1.0}, strict=False))


@query("expected_model_change", sql(f"SELECT task_id, round({norm_sql('x')}, 6) AS score FROM (SELECT task_id, {e('probs')} AS s FROM predictions)", "predictions"))
def expected_model_change(spark, sf):
    return scored(S.expected_model_change(predictions(spark, sf)))


@query("random_select", sql(
    "SELECT task_id, score, row_number() OVER (ORDER BY score DESC, task_id) AS rank FROM "
    "(SELECT task_id, CAST('0x' || substr(md5(task_id || '|3'), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS score FROM predictions) QUALIFY rank <= 50", "predictions"))
def random_select(spark, sf):
    return S.top_k(S.random_scores(predictions(spark, sf), seed=3), 50)


def emb_uncertainty(spark, sf):
    return samples(spark, sf).join(
        predictions(spark, sf).select(F.col("task_id").alias("image_id"), P.least_confidence(F.col("probs")).alias("u")), "image_id"
    )


@query("batch_uncertainty_diverse", sql(
    "SELECT rank, id AS task_id, round(s, 6) AS score FROM bu WHERE rank > 0",
    "samples", "predictions",
    pd="SELECT a.image_id AS i, b.image_id AS j, list_distance(a.embedding, b.embedding) AS d FROM samples a, samples b",
    d0="SELECT i, m / max(m) OVER () AS d FROM (SELECT i, avg(d) AS m FROM pd GROUP BY 1)",
    u0="SELECT task_id AS i, 1 - list_max(probs) AS u FROM predictions",
    bu="SELECT 0 AS rank, CAST(-1 AS BIGINT) AS id, CAST(0 AS DOUBLE) AS s, CAST([] AS BIGINT[]) AS picks UNION ALL "
       "SELECT * FROM (SELECT rank + 1, i, 0.7 * u + 0.3 * d * f AS s, list_append(picks, i) FROM (SELECT bu.rank, bu.picks, d0.i, any_value(u0.u) AS u, any_value(d0.d) AS d, "
       "coalesce(product(1 - 0.5 / (1 + pd.d)), 1) AS f FROM bu CROSS JOIN d0 JOIN u0 ON u0.i = d0.i LEFT JOIN pd ON pd.i = d0.i AND list_contains(bu.picks, pd.j) "
       "WHERE bu.rank < 10 AND NOT list_contains(bu.picks, d0.i) GROUP BY bu.rank, bu.picks, d0.i) ORDER BY s DESC, i LIMIT 1)"))
def batch_uncertainty_diverse(spark, sf):
    out = S.uncertain_and_diverse(emb_uncertainty(spark, sf), "image_id", "embedding", "u", 10)
    return out.select("rank", "task_id", r6(F.col("score")).alias("score"))


@query("adaptive_select", sql(
    "SELECT task_id, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (ORDER BY s DESC, task_id) AS rank FROM (SELECT task_id, (1 - 0.7 * exp(-0.3)) * u / max(u) OVER () + 0.7 * exp(-0.3) * d / max(d) OVER () AS s FROM au JOIN ad USING (task_id))) WHERE rank <= 15",
    "predictions", "samples", au=f"SELECT task_id, {e('probs')} AS u FROM predictions", ad="SELECT image_id AS task_id, s AS d FROM (" + PAIRS_D.format("list_distance(a.embedding, b.embedding)") + ")"))
def adaptive_select(spark, sf):
    u = predictions(spark, sf).select("task_id", P.raw_entropy(F.col("probs")).alias("score"))
    d = S.diversity_euclidean(samples(spark, sf), "image_id", "embedding").select(F.col("image_id").alias("task_id"), "score")
    return S.adaptive_select(u, d, iteration=3, k=15).select("task_id", r6(F.col("score")).alias("score"), "rank")


def two_class(spark, sf):
    return samples(spark, sf).select(
        F.col("image_id").alias("task_id"), F.col("embedding").alias("features"), (F.col("label").cast("int") % 2).cast("double").alias("label")
    )


@query("ensemble_uncertainty")
def ensemble_uncertainty(spark, sf):
    df = two_class(spark, sf)
    return S.ensemble_uncertainty(df, df, classes=2, dim=64)


@query("calibrated_uncertainty")
def calibrated_uncertainty(spark, sf):
    df = two_class(spark, sf)
    return S.calibrated_uncertainty(df, df, classes=2)


def open_tasks(spark, sf):
    return predictions(spark, sf).select("task_id", "probs", (F.col("task_id") % 3 == 0).alias("is_labeled"))


CAND = "SELECT task_id, probs FROM predictions WHERE task_id % 3 <> 0 AND task_id % 10 <> 1"


@query("candidate_tasks", sql("SELECT task_id FROM cand", "predictions", cand=CAND))
def candidate_tasks(spark, sf):
    taken = open_tasks(spark, sf).filter("task_id % 10 = 1")
    return S.candidate_tasks(open_tasks(spark, sf), taken).select("task_id")


SELECTED = f"SELECT task_id, s, row_number() OVER (ORDER BY s DESC, task_id) AS rank FROM (SELECT task_id, {norm_sql('x')} AS s FROM (SELECT task_id, {e('probs')} / ln(3) AS s FROM cand))"


def selected_tasks(spark, sf):
    taken = open_tasks(spark, sf).filter("task_id % 10 = 1")
    return S.select_tasks(open_tasks(spark, sf), predictions(spark, sf), 30, open_selected=taken)


@query("select_tasks", sql("SELECT task_id, round(s, 6) AS score, rank FROM sel WHERE rank <= 30", "predictions", cand=CAND, sel=SELECTED))
def select_tasks(spark, sf):
    return selected_tasks(spark, sf).select("task_id", r6(F.col("score")).alias("score"), "rank")


def all_rounds(spark, sf):
    """Past rounds: ten tasks per round number in task order; which ones finished comes from the annotations."""
    selected = tasks(spark, sf).select(F.col("id").alias("task_id"), F.floor(F.col("id") / 10).alias("round_id"))
    notes = annotations(spark, sf).withColumn("was_cancelled", F.col("annotator_id") == 0)
    return S.round_completion(selected, notes)


ROUNDS = "SELECT t.id // 10 AS round_id, count(*) AS selected, count(a.task_id) AS finished FROM tasks t LEFT JOIN (SELECT DISTINCT task_id FROM annotations WHERE annotator_id <> 0) a ON a.task_id = t.id GROUP BY 1"


@query("round_completion", sql("SELECT *, selected = finished AS is_completed FROM rounds", "tasks", "annotations", rounds=ROUNDS))
def round_completion(spark, sf):
    return all_rounds(spark, sf)


@query("selection_status", sql("SELECT count(*) AS total_rounds, max(round_id) AS latest_round, CAST(coalesce(sum(selected) FILTER (WHERE selected <> finished), 0) AS BIGINT) AS pending_tasks FROM rounds", "tasks", "annotations", rounds=ROUNDS))
def selection_status(spark, sf):
    return S.selection_status(all_rounds(spark, sf))


@query("selection_round", sql(
    "SELECT (SELECT count(*) + 1 FROM rounds) AS round_number, 'uncertainty' AS strategy, (SELECT count(*) FROM cand) AS total_candidates, count(*) AS selected, round(avg(s), 6) AS avg_score FROM sel WHERE rank <= 30",
    "predictions", "tasks", "annotations", rounds=ROUNDS, cand=CAND, sel=SELECTED))
def selection_round(spark, sf):
    taken = open_tasks(spark, sf).filter("task_id % 10 = 1")
    candidates = S.candidate_tasks(open_tasks(spark, sf), taken)
    out = S.round_record(selected_tasks(spark, sf), candidates, all_rounds(spark, sf), "uncertainty")
    return out.withColumn("avg_score", r6(F.col("avg_score")))


@query("selection_spread", sql(
    "SELECT round(sum(list_distance(a.embedding, b.embedding)) / (30 * 29), 6) AS diversity_score FROM samples a, samples b WHERE a.image_id IN (SELECT task_id FROM sel WHERE rank <= 30) AND b.image_id IN (SELECT task_id FROM sel WHERE rank <= 30)",
    "predictions", "samples", cand=CAND, sel=SELECTED))
def selection_spread(spark, sf):
    return S.selection_spread(selected_tasks(spark, sf), samples(spark, sf), "image_id", "embedding").select(r6(F.col("diversity_score")).alias("diversity_score"))


@query("latest_predictions", (
    "SELECT event_id AS id, user_id AS task_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS place FROM events WHERE event_type = 'click'"))
def latest_predictions(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("task_id"), F.col("event_type").alias("model_version"), F.col("ts").alias("created_at")
    )
    return S.latest_predictions(rows, "click").select("id", "task_id", "place")

"""Queries over embedding slices."""

from pyspark.sql import functions as F

from curadrift.functions import vectors as V
from curadrift.functions.numbers import r6
from curadrift.operators import outliers as O
from curadrift.plans.ctes import sql
from curadrift.plans.registry import query
from curadrift.sources import samples as S
from curadrift.sources.tables import samples, table

DIM = 64
STATS = "SELECT avg(distance) AS m, avg(distance) + 2 * stddev_pop(distance) AS t FROM dist"


@query("load_samples", sql(
    "SELECT doc_id AS image_id, CASE WHEN lang = '' THEN 'unknown' ELSE coalesce(lang, 'unknown') END AS label, source AS meta_source, "
    "CAST(n_chars AS VARCHAR) AS meta_n_chars FROM documents"))
def load_samples(spark, sf):
    raw = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.array(F.nullif("lang", F.lit(""))).alias("tags"), "source",
        F.col("n_chars").cast("string").alias("n_chars"),
    )
    loaded = S.load_samples(raw, metadata=["source", "n_chars"])
    return loaded.select(
        "image_id", "label", F.col("metadata")["source"].alias("meta_source"),
        F.col("metadata")["n_chars"].alias("meta_n_chars"),
    )


@query("load_samples_subset", sql(
    "SELECT image_id, label FROM samples ORDER BY CAST('0x' || substr(md5(image_id || '|7'), 1, 13) AS BIGINT), image_id LIMIT 100", "samples"))
def load_samples_subset(spark, sf):
    return S.random_subset(samples(spark, sf), "image_id", 100, seed=7).select("image_id", "label")


@query("sample_contract", sql(
    "SELECT label, count(*) FILTER (WHERE len(embedding) = 64) AS accepted, "
    "count(*) FILTER (WHERE len(embedding) <> 64) AS rejected, "
    "string_agg(DISTINCT CASE WHEN len(embedding) <> 64 THEN 'length ' || len(embedding) END) AS reasons "
    "FROM (SELECT label, CASE WHEN image_id % 7 = 3 THEN embedding[1:60] ELSE embedding END AS embedding FROM samples) GROUP BY label", "samples"))
def sample_contract(spark, sf):
    broken = samples(spark, sf).withColumn(
        "embedding", F.when(F.col("image_id") % 7 == 3, F.slice("embedding", 1, 60)).otherwise(F.col("embedding"))
    )
    good, bad = O.split_by_contract(broken, DIM)
    both = good.select("label", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("label", "reason"))
    return both.groupBy("label").agg(
        F.count_if(F.col("reason").isNull()).alias("accepted"), F.count("reason").alias("rejected"),
        F.max("reason").alias("reasons"),
    )


@query("slice_check", sql(
    "SELECT part, count(*) AS n, declared, count(*) = declared AND count(*) > 0 AS valid FROM (SELECT 'whole' AS part, max(vec_id) - min(vec_id) + 1 AS declared FROM embeddings UNION ALL SELECT 'labelled', max(vec_id) + 1 FROM embeddings) d "
    "JOIN samples ON part = 'whole' OR CAST(label AS INTEGER) > 0 GROUP BY part, declared", "samples"))
def slice_check(spark, sf):
    """A whole slice against the span of its ids, and one without the label 0 that declares as much."""
    df = samples(spark, sf)
    span = table(spark, sf, "embeddings").agg(F.min("vec_id").alias("low"), F.max("vec_id").alias("high")).first()
    whole = O.slice_check(df, span["high"] - span["low"] + 1).withColumn("part", F.lit("whole"))
    return whole.unionByName(O.slice_check(df.filter("CAST(label AS INT) > 0"), span["high"] + 1).withColumn("part", F.lit("labelled")))


@query("l2_normalize", sql(
    "SELECT image_id, pos - 1 AS pos, round(x / n, 6) + 0.0 AS x FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY image_id)) AS n "
    "FROM (SELECT image_id, pos, x * 3 AS x FROM flat))", "flat"))
def l2_normalize(spark, sf):
    scaled = samples(spark, sf).select("image_id", V.scaled(F.col("embedding"), F.lit(3)).alias("v"))
    unit = scaled.select("image_id", F.posexplode(V.l2_normalize(F.col("v"))).alias("pos", "x"))
    return unit.select("image_id", "pos", r6(F.col("x")).alias("x"))


@query("centroid", sql("SELECT pos - 1 AS pos, round(avg(x), 6) + 0.0 AS x FROM flat GROUP BY pos", "flat"))
def centroid(spark, sf):
    return O.centroid(samples(spark, sf)).select(F.posexplode("centroid").alias("pos", "x")).select("pos", r6(F.col("x")).alias("x"))


@query("centroid_distance_outliers", sql(
    "SELECT image_id, label, round(distance, 6) AS drift_score, round(m, 6) AS mean_distance, round(t, 6) AS threshold, distance > t AS above_threshold "
    "FROM (SELECT *, row_number() OVER (ORDER BY distance DESC, image_id) AS rn FROM dist, st) WHERE rn <= 3 AND (distance > t OR rn <= 2)",
    "dist", st=STATS))
def centroid_distance_outliers(spark, sf):
    found = O.centroid_distance_outliers(samples(spark, sf))
    return found.select(
        "image_id", "label", "drift_score", r6(F.col("mean_distance")).alias("mean_distance"),
        r6(F.col("threshold")).alias("threshold"), "above_threshold",
    )


@query("centroid_distance_outliers_all", sql(
    "SELECT image_id, label, round(distance, 6) AS drift_score FROM (SELECT *, row_number() OVER (ORDER BY distance DESC, image_id) AS rn FROM dist, st) "
    "WHERE distance > t OR rn <= 2", "dist", st=STATS))
def centroid_distance_outliers_all(spark, sf):
    return O.centroid_distance_outliers(samples(spark, sf), max_drift=None).select("image_id", "label", "drift_score")


@query("centroid_distances", sql("SELECT image_id, label, round(distance, 6) AS distance FROM dist", "dist"))
def centroid_distances(spark, sf):
    return O.centroid_distances(samples(spark, sf)).select("image_id", "label", r6(F.col("distance")).alias("distance"))


@query("top_outliers", sql("SELECT image_id, label, round(distance, 6) AS distance FROM dist ORDER BY dist.distance DESC, image_id LIMIT 10", "dist"))
def top_outliers(spark, sf):
    return O.top_outliers(samples(spark, sf), 10).select("image_id", "label", r6(F.col("distance")).alias("distance"))


@query("pipeline_report", sql(
    "SELECT string_agg(CAST(image_id AS VARCHAR), ',' ORDER BY distance DESC, image_id) AS drift_ids, count(*) AS drift_count, round(max(m), 6) AS mean_distance, round(max(t), 6) AS threshold "
    "FROM (SELECT *, row_number() OVER (ORDER BY distance DESC, image_id) AS rn FROM dist, st) WHERE rn <= 3 AND (distance > t OR rn <= 2)",
    "dist", st=STATS))
def pipeline_report(spark, sf):
    return O.pipeline_report(samples(spark, sf))


@query("covariance_matrix", sql(
    "SELECT a.pos - 1 AS i, b.pos - 1 AS j, round(covar_samp(a.x, b.x), 6) + 0.0 AS cov FROM flat a JOIN flat b USING (image_id) GROUP BY 1, 2", "flat"))
def covariance_matrix(spark, sf):
    return O.covariance_matrix(samples(spark, sf), DIM).select("i", "j", r6(F.col("cov")).alias("cov"))


@query("frechet_distance_approx", sql(
    "SELECT round(d, 6) AS mean_part, round(tr, 6) AS trace_real, round(tf, 6) AS trace_fake, round(d + tr + tf - 2 * sqrt(tr * tf), 6) AS frechet FROM "
    "(SELECT sum((mr - mf) * (mr - mf)) AS d, sum(vr) AS tr, sum(vf) AS tf FROM (SELECT pos, avg(x) FILTER (WHERE image_id % 2 = 0) AS mr, "
    "avg(x) FILTER (WHERE image_id % 2 = 1) AS mf, var_samp(x) FILTER (WHERE image_id % 2 = 0) AS vr, var_samp(x) FILTER (WHERE image_id % 2 = 1) AS vf FROM flat GROUP BY pos))", "flat"))
def frechet_distance_approx(spark, sf):
    out = O.frechet_distance_approx(samples(spark, sf).withColumn("real", F.col("image_id") % 2 == 0), "real")
    return out.select(*[r6(F.col(c)).alias(c) for c in out.columns])


@query("cosine_alignment", sql(
    "SELECT a.image_id, round(list_cosine_similarity(a.embedding, b.embedding), 6) + 0.0 AS alignment FROM samples a JOIN samples b ON b.image_id = a.image_id + 1", "samples"))
def cosine_alignment(spark, sf):
    left = samples(spark, sf)
    right = left.withColumn("image_id", F.col("image_id") - 1)
    return O.cosine_alignment(left, right, "image_id").select("image_id", r6(F.col("alignment")).alias("alignment"))

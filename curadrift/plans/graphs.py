"""Queries for graphs, points and anomalies."""

from pyspark.sql import functions as F

from curadrift.functions.numbers import r6
from curadrift.operators import anomaly as N, graph as G, spatial as X
from curadrift.plans.ctes import sql
from curadrift.plans.registry import query
from curadrift.session import stored
from curadrift.sources.tables import points, samples, table

RADIUS = 1.15
EDGES = f"SELECT a.image_id AS src, b.image_id AS dst, list_distance(a.embedding, b.embedding) AS weight FROM samples a JOIN samples b ON a.image_id < b.image_id WHERE list_distance(a.embedding, b.embedding) < {RADIUS}"
LINKS = "SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges"


def edges(spark, sf):
    return G.radius_join(samples(spark, sf), "image_id", "embedding", RADIUS)


@query("radius_join", sql("SELECT src, dst, round(weight, 6) AS weight FROM edges", "samples", edges=EDGES))
def radius_join(spark, sf):
    return edges(spark, sf).withColumn("weight", r6(F.col("weight")))


@query("radius_join_lsh")
def radius_join_lsh(spark, sf):
    return G.radius_join_lsh(samples(spark, sf), "image_id", "embedding", RADIUS, bucket=1.0)


@query("build_graph", sql("SELECT image_id, count(l.src) AS neighbours FROM samples LEFT JOIN links l ON l.src = image_id GROUP BY 1", "samples", edges=EDGES, links=LINKS))
def build_graph(spark, sf):
    return G.neighbour_counts(samples(spark, sf), "image_id", edges(spark, sf))


@query("graph_problems", sql(
    "SELECT image_id, 'wrong dimension' AS problem FROM samples WHERE image_id % 50 = 7 UNION ALL SELECT image_id, 'duplicate id' FROM samples WHERE image_id % 40 = 9", "samples"))
def graph_problems(spark, sf):
    df = samples(spark, sf)
    doubled = df.unionByName(df.filter("image_id % 40 = 9"))
    short = doubled.withColumn("embedding", F.when(F.col("image_id") % 50 == 7, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")))
    return G.graph_problems(short, "image_id", "embedding", 64)


BFS = {
    "edges": EDGES, "links": LINKS,
    "seeds": "SELECT image_id AS id FROM dist ORDER BY distance, image_id LIMIT 5",
    "walk": "SELECT id, 0 AS hop FROM seeds UNION SELECT l.dst, w.hop + 1 FROM walk w JOIN links l ON l.src = w.id WHERE w.hop < 4",
    "iso": "SELECT image_id AS id, CAST(coalesce(min(hop), 5) AS DOUBLE) AS isolation FROM samples LEFT JOIN walk ON walk.id = image_id GROUP BY 1",
}


@query("bfs_isolation", sql("SELECT * FROM iso", "samples", "dist", **BFS))
def bfs_isolation(spark, sf):
    return G.bfs_isolation(samples(spark, sf), "image_id", "embedding", edges(spark, sf), k=5, max_hops=4)


@query("export_isolation", sql("SELECT CAST(id AS VARCHAR) AS id, isolation AS score FROM iso", "samples", "dist", **BFS))
def export_isolation(spark, sf):
    out = G.bfs_isolation(samples(spark, sf), "image_id", "embedding", edges(spark, sf), k=5, max_hops=4)
    return out.select(F.col("id").cast("string").alias("id"), F.col("isolation").alias("score"))


@query("top_isolated", sql("SELECT id, isolation FROM iso ORDER BY isolation DESC, id LIMIT 20", "samples", "dist", **BFS))
def top_isolated(spark, sf):
    out = G.bfs_isolation(samples(spark, sf), "image_id", "embedding", edges(spark, sf), k=5, max_hops=4)
    return out.orderBy(F.desc("isolation"), "id").limit(20)


@query("graph_drift_detect", sql(
    "SELECT row_number() OVER (ORDER BY isolation DESC, distance DESC, id) AS rank, id, isolation, round(distance, 6) AS distance, round((SELECT avg(distance) + 2 * stddev_pop(distance) FROM dist), 6) AS threshold "
    "FROM iso JOIN dist ON image_id = id ORDER BY isolation DESC, dist.distance DESC, id LIMIT 10", "samples", "dist", **BFS))
def graph_drift_detect(spark, sf):
    out = G.graph_drift_detect(samples(spark, sf), "image_id", "embedding", RADIUS, k=5, max_hops=4, max_outliers=10)
    return out.select("rank", "id", "isolation", r6(F.col("distance")).alias("distance"), r6(F.col("threshold")).alias("threshold"))


LEVELS = {
    "edges": EDGES, "links": LINKS, "src0": "SELECT min(src) AS id FROM edges",
    "walk": "SELECT id, 0 AS hop FROM src0 UNION SELECT l.dst, w.hop + 1 FROM walk w JOIN links l ON l.src = w.id WHERE w.hop < 40",
}


def first_source(linked):
    """The smallest id that has an edge."""
    return linked.agg(F.min("src").alias("image_id"))


@query("bfs_levels", sql("SELECT image_id AS id, min(hop) AS hop FROM samples LEFT JOIN walk ON walk.id = image_id GROUP BY 1", "samples", **LEVELS))
def bfs_levels(spark, sf):
    linked = stored(edges(spark, sf), "src", "dst")
    return G.bfs_levels(samples(spark, sf), "image_id", linked, first_source(linked))


@query("bfs_levels_limited", sql("SELECT image_id AS id, min(hop) AS hop FROM samples LEFT JOIN walk ON walk.id = image_id AND hop <= 2 GROUP BY 1", "samples", **LEVELS))
def bfs_levels_limited(spark, sf):
    linked = stored(edges(spark, sf), "src", "dst")
    return G.bfs_levels(samples(spark, sf), "image_id", linked, first_source(linked), max_depth=2)


# hop-bounded relaxation: the best distance after each number of edges
PATHS = {
    "edges": EDGES, "links": LINKS, "src0": LEVELS["src0"],
    "steps": "SELECT id, CAST(0 AS DOUBLE) AS d, 0 AS n FROM src0 UNION ALL SELECT dst, d, n FROM (SELECT l.dst, s.n + 1 AS n, min(s.d + l.weight) AS d FROM steps s JOIN links l ON l.src = s.id WHERE s.n < 25 GROUP BY 1, 2)",
    "best": "SELECT id, min(d) AS d FROM steps GROUP BY 1",
}


@query("shortest_paths", sql("SELECT image_id AS id, round(d, 6) AS distance FROM samples LEFT JOIN best ON best.id = image_id", "samples", **PATHS))
def shortest_paths(spark, sf):
    linked = stored(edges(spark, sf))
    out = G.shortest_paths(samples(spark, sf), "image_id", linked, first_source(linked))
    return out.select("id", r6(F.col("distance")).alias("distance"))


@query("dijkstra_budget", sql(
    "SELECT image_id AS id, round(coalesce(f.d, o.d), 6) AS distance, CASE WHEN f.id IS NULL OR f.d > 0 THEN o.pred END AS pred, f.id IS NOT NULL AS settled FROM samples LEFT JOIN fs f ON f.id = image_id "
    "LEFT JOIN (SELECT dst, min(fs.d + weight) AS d, arg_min(src, (fs.d + weight, src)) AS pred FROM fs JOIN links ON src = fs.id GROUP BY 1) o ON o.dst = image_id",
    "samples", **PATHS, fs="SELECT id, d FROM best ORDER BY d, id LIMIT 15"))
def dijkstra_budget(spark, sf):
    linked = stored(edges(spark, sf))
    out = G.dijkstra_budget(samples(spark, sf), "image_id", linked, first_source(linked), settled=15)
    return out.select("id", r6(F.col("distance")).alias("distance"), "pred", "settled")


COMPONENTS = {
    "edges": EDGES, "links": LINKS,
    "reach": "SELECT image_id AS id, image_id AS other FROM samples UNION SELECT r.id, l.dst FROM reach r JOIN links l ON l.src = r.other",
    "comp": "SELECT id, min(other) AS component FROM reach GROUP BY 1",
}


@query("connected_components", sql("SELECT * FROM comp", "samples", **COMPONENTS))
def connected_components(spark, sf):
    return G.connected_components(samples(spark, sf), "image_id", edges(spark, sf))


DB = {
    **{**COMPONENTS, "edges": EDGES.replace(f"< {RADIUS}", f"<= {RADIUS}")},
    "mem": "SELECT c.id, c.component, s.embedding FROM comp c JOIN samples s ON s.image_id = c.id WHERE c.id IN (SELECT src FROM links)",
    "mflat": "SELECT component, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM mem",
    "mm": "SELECT component, list(m ORDER BY pos) AS mean FROM (SELECT component, pos, avg(x) AS m FROM mflat GROUP BY 1, 2) GROUP BY 1",
    "rep": "SELECT mem.component, arg_min(id, (list_distance(embedding, mean), id)) AS id, 0 AS noise FROM mem JOIN mm USING (component) GROUP BY 1",
}


@query("dbscan_representatives", sql(
    "SELECT component, id, noise FROM (SELECT * FROM rep UNION ALL SELECT image_id, image_id, 1 FROM samples WHERE image_id NOT IN (SELECT src FROM links)) ORDER BY noise, component LIMIT 40", "samples", **DB))
def dbscan_representatives(spark, sf):
    return G.dbscan_representatives(samples(spark, sf), "image_id", "embedding", RADIUS, 40)


@query("knn", sql("SELECT id, label, round(sqrt((x - 0.05) ** 2 + (y + 0.02) ** 2), 6) AS distance FROM points ORDER BY (x - 0.05) ** 2 + (y + 0.02) ** 2, id LIMIT 8", "points"))
def knn(spark, sf):
    return X.knn(points(spark, sf), ["x", "y"], [0.05, -0.02], 8).select("id", "label", r6(F.col("distance")).alias("distance"))


LABEL_POINTS = "SELECT CAST(label AS INTEGER) AS query_id, avg(x) AS qx, avg(y) AS qy FROM points GROUP BY 1"


def label_points(spark, sf):
    return points(spark, sf).groupBy(F.col("label").cast("int").alias("query_id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


@query("knn_join", sql(
    "SELECT query_id, id, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rn FROM (SELECT query_id, id, sqrt((x - qx) ** 2 + (y - qy) ** 2) AS d FROM points, lp)) WHERE rn <= 5", "points", lp=LABEL_POINTS))
def knn_join(spark, sf):
    return X.knn_join(points(spark, sf), ["x", "y"], label_points(spark, sf), 5).withColumn("distance", r6(F.col("distance")))


@query("radius_query", sql("SELECT id, round(sqrt(x * x + y * y), 6) AS distance FROM points WHERE x * x + y * y <= 0.01", "points"))
def radius_query(spark, sf):
    return X.radius_query(points(spark, sf), ["x", "y"], [0.0, 0.0], 0.1).select("id", r6(F.col("distance")).alias("distance"))


@query("radius_query_many", sql("SELECT query_id, id, round(sqrt((x - qx) ** 2 + (y - qy) ** 2), 6) AS distance FROM points, lp WHERE (x - qx) ** 2 + (y - qy) ** 2 <= 0.0064", "points", lp=LABEL_POINTS))
def radius_query_many(spark, sf):
    return X.radius_join_cells(points(spark, sf), ["x", "y"], label_points(spark, sf), 0.08).withColumn("distance", r6(F.col("distance")))


@query("box_query", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 90000 AND o_custkey BETWEEN 10 AND 500")
def box_query(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    return X.box_query(orders, {"o_totalprice": (1000.0, 90000.0), "o_custkey": (10, 500)}).drop("o_custkey")


Z = (
    "SELECT l_orderkey * 10 + l_linenumber AS id, greatest(abs(l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), abs(l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER (), "
    "abs(l_discount - avg(l_discount) OVER ()) / stddev_pop(l_discount) OVER ()) AS z FROM lineitem"
)


def line_features(spark, sf):
    return table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_quantity", "l_extendedprice", "l_discount")


@query("statistical_detector", sql("SELECT id, round(z, 6) AS score, z > 1.7 AS is_anomaly FROM z", z=Z))
def statistical_detector(spark, sf):
    out = N.statistical_detector(line_features(spark, sf), "id", ["l_quantity", "l_extendedprice", "l_discount"], 1.7)
    return out.withColumn("score", r6(F.col("score")))


LOF = {
    "nn": "SELECT i AS id, j AS other, d FROM (SELECT a.image_id AS i, b.image_id AS j, list_distance(a.embedding, b.embedding) AS d, row_number() OVER (PARTITION BY a.image_id ORDER BY list_distance(a.embedding, b.embedding), b.image_id) AS rn FROM samples a JOIN samples b ON a.image_id <> b.image_id) WHERE rn <= 10",
    "kd": "SELECT id AS other, max(d) AS k FROM nn GROUP BY 1",
    "lrd": "SELECT id, 1 / avg(greatest(d, k)) AS l FROM nn JOIN kd USING (other) GROUP BY 1",
    "lof": "SELECT nn.id, avg(o.l) / any_value(m.l) AS f FROM nn JOIN lrd o ON o.id = nn.other JOIN lrd m ON m.id = nn.id GROUP BY 1",
}


@query("lof_detector", sql("SELECT id, round(f, 6) AS score, f > 1.03 AS is_anomaly FROM lof", "samples", **LOF))
def lof_detector(spark, sf):
    return N.lof_detector(samples(spark, sf), "image_id", "embedding", 10, 1.03).withColumn("score", r6(F.col("score")))


@query("isolation_forest")
def isolation_forest(spark, sf):
    return N.isolation_forest(samples(spark, sf), "image_id", "embedding")


def consensus(spark, sf):
    """The votes of both detectors. Only the third is meant to fail: votes without those of a detector that should have given some are no result.
    A row without a vector has no neighbours, so the local outlier factor has no vote on it."""
    df = samples(spark, sf).withColumn("first", F.col("embedding")[0]).withColumn("second", F.col("embedding")[1])
    per_id, failures = N.anomaly_consensus(df, {
        "statistical": lambda d: N.statistical_detector(d, "image_id", ["first", "second"], 2.0),
        "lof": lambda d: N.lof_detector(d.filter("embedding IS NOT NULL"), "image_id", "embedding", 10, 1.03),
        "broken": lambda d: d.select("no_such_column"),
    })
    failures.pop("broken", None)
    if failures:
        raise RuntimeError("; ".join(f"detector {name} failed: {failure}" for name, failure in failures.items()))
    return per_id


CONSENSUS = {
    **LOF,
    "zz": "SELECT image_id AS id, greatest(abs(a - avg(a) OVER ()) / stddev_pop(a) OVER (), abs(b - avg(b) OVER ()) / stddev_pop(b) OVER ()) > 2 AS odd FROM (SELECT image_id, embedding[1] AS a, embedding[2] AS b FROM samples)",
    "cs": "SELECT id, CAST(odd AS INTEGER) + CAST(f > 1.03 AS INTEGER) AS votes FROM zz JOIN lof USING (id)",
}


@query("anomaly_consensus", sql("SELECT id, votes, 2 AS detectors, votes > 0 AS is_anomaly FROM cs", "samples", **CONSENSUS))
def anomaly_consensus(spark, sf):
    return consensus(spark, sf)


@query("anomaly_summary", sql("SELECT count(*) AS total, count(*) FILTER (WHERE votes > 0) AS anomalies, round(count(*) FILTER (WHERE votes > 0) / count(*), 6) AS anomaly_rate FROM cs", "samples", **CONSENSUS))
def anomaly_summary(spark, sf):
    return N.consensus_summary(consensus(spark, sf)).withColumn("anomaly_rate", r6(F.col("anomaly_rate")))

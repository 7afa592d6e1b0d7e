"""Embeddings, graphs, points, selection: fixtures with known answers and brute force."""

import hashlib
import heapq
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from curadrift.operators import anomaly as N, blocks as B, graph as G, outliers as O, projections as P, selection as S, spatial as X
from curadrift.session import stored


def frame(spark, vectors, key="image_id", label="x"):
    return spark.createDataFrame([(i, label, [float(a) for a in v]) for i, v in enumerate(vectors)], f"{key} int, label string, embedding array<double>")


def test_clusters_have_outliers(spark):
    rng = np.random.default_rng(123)
    df = frame(spark, np.vstack([rng.normal(0, 1, (8, 128)), rng.normal(10, 1, (2, 128))]))
    found = O.centroid_distance_outliers(df).collect()
    assert 2 <= len(found) <= 3
    assert {r["image_id"] for r in found} >= {8, 9}
    assert all(r["threshold"] > r["mean_distance"] and r["drift_score"] > 0 for r in found)


def test_constant_embeddings(spark):
    found = O.centroid_distance_outliers(frame(spark, np.zeros((10, 128)))).collect()
    assert len(found) == 2 and all(r["mean_distance"] == 0 and r["threshold"] == 0 for r in found)


def test_contract(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None), (4, [1.0, None])], "id int, embedding array<double>")
    good, bad = O.split_by_contract(df, 2)
    assert [r["id"] for r in good.collect()] == [1]
    assert {r["id"]: r["reason"] for r in bad.collect()} == {2: "length 1", 3: "no vector", 4: "value missing"}
    assert O.slice_check(df, 4).first()["valid"] and not O.slice_check(df, 5).first()["valid"]
    assert not O.slice_check(df.limit(0), 0).first()["valid"]


@pytest.mark.parametrize("spread,radius", [(1.0, 1.2), (20.0, 1.5)])
def test_radius_join_equals_brute_force(spark, spread, radius):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, spread, (6, 3))
    x = centres[rng.integers(0, 6, 150)] + rng.normal(0, 0.6, (150, 3))
    got = {(r["src"], r["dst"]): r["weight"] for r in G.radius_join(frame(spark, x), "image_id", "embedding", radius, block_rows=16).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = {(i, j): d[i, j] for i in range(150) for j in range(i + 1, 150) if d[i, j] < radius}
    assert got.keys() == want.keys() and len(want) > 20
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_strict_and_closed_radius(spark):
    df = frame(spark, [[0, 0], [3, 4], [0, 5.0000001]])
    assert G.radius_join(df, "image_id", "embedding", 5.0).count() == 1
    assert {(r["src"], r["dst"]) for r in G.radius_join(df, "image_id", "embedding", 5.0, closed=True).collect()} == {(0, 1), (1, 2)}


def test_isolated_node(spark):
    df = frame(spark, [[0] * 4, [0.1] * 4, [0.2, 0, 0, 0], [100] * 4])
    edges = G.radius_join(df, "image_id", "embedding", 5.0)
    scores = {r["id"]: r["isolation"] for r in G.bfs_isolation(df, "image_id", "embedding", edges, 2, 5).collect()}
    assert scores[3] == 6 and max(scores[i] for i in range(3)) <= 1
    top = G.graph_drift_detect(df, "image_id", "embedding", 5.0, 2, 5, 2).orderBy("rank").collect()
    assert top[0]["id"] == 3


def test_chain(spark):
    df = frame(spark, [[0, 0], [1, 0], [2, 0], [100, 0]])
    edges = G.radius_join(df, "image_id", "embedding", 3.0)
    scores = {r["id"]: r["isolation"] for r in G.bfs_isolation(df, "image_id", "embedding", edges, 1, 5).collect()}
    assert max(scores, key=scores.get) == 3


def graph(spark, n, edges):
    nodes = spark.createDataFrame([(i,) for i in range(n)], "id int")
    return nodes, spark.createDataFrame(edges, "src int, dst int, weight double")


def test_path_graph(spark):
    nodes, edges = graph(spark, 5, [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0)])
    start = nodes.filter("id = 0")
    assert {r["id"]: r["hop"] for r in G.bfs_levels(nodes, "id", edges, start).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4}
    assert {r["id"]: r["hop"] for r in G.bfs_levels(nodes, "id", edges, start, 2).collect()} == {0: 0, 1: 1, 2: 2, 3: None, 4: None}


def test_two_parts(spark):
    nodes, edges = graph(spark, 4, [(0, 1, 1.0), (2, 3, 1.0)])
    assert sum(r["hop"] is None for r in G.bfs_levels(nodes, "id", edges, nodes.filter("id = 0")).collect()) == 2
    assert {r["id"]: r["component"] for r in G.connected_components(nodes, "id", edges).collect()} == {0: 0, 1: 0, 2: 2, 3: 2}


def test_long_chain_components(spark):
    n = 60
    order = np.random.default_rng(1).permutation(n).tolist()
    nodes, edges = graph(spark, n, [(order[i], order[i + 1], 1.0) for i in range(n - 1)])
    assert {r["component"] for r in G.connected_components(nodes, "id", edges).collect()} == {0}


@pytest.mark.parametrize("crowd", [G.CROWD, 3], ids=["joins", "hubs"])
def test_components_against_union_find(spark, crowd):
    rng = np.random.default_rng(7)
    n, pairs = 400, []
    pairs += [(399, int(v)) for v in rng.choice(150, 90, replace=False)]                       # a hub with the largest id
    pairs += [(150, v) for v in range(151, 230)] + [(229, 230), (231, 230), (240, 239), (239, 238)]  # a hub with the smallest id
    pairs += [(int(a), int(b)) for a, b in rng.integers(240, 390, (90, 2))] + [(5, 5), (240, 239)]
    nodes, edges = graph(spark, n, [(a, b, 1.0) for a, b in pairs])
    name = list(range(n))

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for a, b in pairs:
        low, high = sorted((root(a), root(b)))
        name[high] = low
    got = {r["id"]: r["component"] for r in G.connected_components(nodes, "id", edges, crowd).collect()}
    assert got == {i: root(i) for i in range(n)}


def test_no_edges(spark):
    nodes, edges = graph(spark, 3, [(0, 1, 1.0)])
    assert {tuple(r) for r in G.connected_components(nodes, "id", edges.filter("src > 5")).collect()} == {(0, 0), (1, 1), (2, 2)}


def test_weighted_triangle(spark):
    nodes, edges = graph(spark, 4, [(0, 1, 1.0), (1, 2, 2.0), (0, 2, 4.0)])
    got = {r["id"]: (r["distance"], r["pred"]) for r in G.shortest_paths(nodes, "id", edges, nodes.filter("id = 0")).collect()}
    assert got == {0: (0.0, None), 1: (1.0, 0), 2: (3.0, 1), 3: (None, None)}
    one = {r["id"]: r["distance"] for r in G.dijkstra_budget(nodes, "id", edges, nodes.filter("id = 0"), 1).collect()}
    assert one == {0: 0.0, 1: 1.0, 2: 4.0, 3: None}


@pytest.mark.parametrize("width", [None, 0.05, 100.0])
def test_a_budget_settles_what_a_heap_settles(spark, width):
    rng = np.random.default_rng(5)
    pairs = {tuple(sorted(p)) for p in rng.integers(0, 60, (120, 2)).tolist() if p[0] != p[1]}
    weighted = [(a, b, float(w)) for (a, b), w in zip(sorted(pairs), rng.choice([0.1, 0.2, 0.3, 1.0, 5.0], len(pairs)))]
    nodes, edges = graph(spark, 60, weighted)
    around = {}
    for a, b, w in weighted:
        around.setdefault(a, []).append((b, w))
        around.setdefault(b, []).append((a, w))
    best, order, heap = {weighted[0][0]: 0.0}, [], [(0.0, weighted[0][0])]
    while heap and len(order) < 20:
        d, at = heapq.heappop(heap)
        if at in order:
            continue
        order.append(at)
        for to, w in around.get(at, []):
            if d + w < best.get(to, math.inf):
                best[to] = d + w
                heapq.heappush(heap, (d + w, to))
    start = nodes.filter(f"id = {weighted[0][0]}")
    got = {r["id"]: r for r in G.dijkstra_budget(nodes, "id", edges, start, 20, width).collect()}
    assert {i: r["distance"] for i, r in got.items() if r["distance"] is not None} == best
    assert {i for i, r in got.items() if r["settled"]} == set(order)
    links = {(a, b): w for a, b, w in weighted} | {(b, a): w for a, b, w in weighted}
    for i, r in got.items():
        if r["pred"] is None:
            assert i not in best or best[i] == 0
        else:
            assert best[r["pred"]] + links[r["pred"], i] == r["distance"] and got[r["pred"]]["settled"]


def test_a_budget_opens_no_bucket_beyond_it(spark):
    nodes, edges = graph(spark, 30, [(i, i + 1, 1.0) for i in range(29)])
    met, last = G.nearest_first(nodes, "id", edges, nodes.filter("id = 0"), settled=5, width=1.0)
    assert last == 4 and met.count() == 6


def test_graph_problems(spark):
    df = spark.createDataFrame([(1, [1.0]), (1, [1.0]), (2, [1.0, 2.0])], "id int, v array<double>")
    assert {(r["id"], r["problem"]) for r in G.graph_problems(df, "id", "v", 1).collect()} == {(1, "duplicate id"), (2, "wrong dimension")}


def test_points(spark):
    rng = np.random.default_rng(8)
    pts = pd.DataFrame({"id": range(300), "x": rng.random(300), "y": rng.random(300)})
    df = spark.createDataFrame(pts)
    d = np.hypot(pts["x"] - 0.5, pts["y"] - 0.5)
    assert [r["id"] for r in X.knn(df, ["x", "y"], [0.5, 0.5], 5).collect()] == d.nsmallest(5).index.tolist()
    assert {r["id"] for r in X.radius_query(df, ["x", "y"], [0.5, 0.5], 0.2).collect()} == set(np.flatnonzero(d <= 0.2))
    queries = spark.createDataFrame([(1, 0.2, 0.3), (2, 0.9, 0.9)], "query_id int, x double, y double")
    many = {(r["query_id"], r["id"]) for r in X.radius_join_cells(df, ["x", "y"], queries, 0.1).collect()}
    want = {(q, i) for q, a, b in [(1, 0.2, 0.3), (2, 0.9, 0.9)] for i in range(300) if (pts["x"][i] - a) ** 2 + (pts["y"][i] - b) ** 2 <= 0.01}
    assert many == want
    near = X.knn_join(df, ["x", "y"], queries, 3).collect()
    assert len(near) == 6


def test_blocks_cover_every_pair(spark, monkeypatch):
    monkeypatch.setattr(B, "block_count", lambda rows, block_rows=0: 3)
    x = np.random.default_rng(6).normal(0, 1, (40, 3))
    df = frame(spark, x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    sums = {r["image_id"]: r["total"] for r in B.distance_sums(df, "image_id", "embedding", 40).collect()}
    assert all(sums[i] == pytest.approx(d[i].sum()) for i in range(40))
    near = B.nearest(df, "image_id", "embedding", 4, 40).toPandas()
    np.fill_diagonal(d, np.inf)
    for i, group in near.groupby("id"):
        assert set(group["other"]) == set(np.argsort(d[i])[:4])


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "manhattan"])
def test_diversity_equals_pairwise_mean(spark, metric):
    x = np.random.default_rng(9).normal(0, 1, (60, 5))
    x[7] = 0
    got = {r["image_id"]: r["score"] for r in S.DIVERSITY[metric](frame(spark, x), "image_id", "embedding").collect()}
    unit = x / np.where(np.linalg.norm(x, axis=1, keepdims=True) == 0, 1, np.linalg.norm(x, axis=1, keepdims=True))
    pair = {
        "cosine": 1 - unit @ unit.T, "euclidean": np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), "manhattan": np.abs(x[:, None] - x[None]).sum(-1),
    }[metric]
    assert all(got[i] == pytest.approx(pair[i].mean(), abs=1e-9) for i in range(60))


@pytest.mark.parametrize("candidates", [1, 5, 1000])
def test_farthest_first_equals_greedy(spark, candidates):
    x = np.random.default_rng(10).normal(0, 1, (80, 3))
    got = [r["task_id"] for r in S.farthest_first(frame(spark, x), "image_id", "embedding", 9, 4, candidates).orderBy("rank").collect()]
    want = [4]
    while len(want) < 9:
        gap = np.sqrt(((x[:, None] - x[want][None]) ** 2).sum(-1)).min(1)
        gap[want] = -1
        want.append(int(np.argmax(gap)))
    assert got == want


@pytest.mark.parametrize("candidates", [1, 6, 1000])
def test_uncertain_and_diverse_equals_greedy(spark, candidates):
    rng = np.random.default_rng(12)
    x, u = rng.normal(0, 1, (50, 3)), rng.random(50)
    df = frame(spark, x).join(spark.createDataFrame(pd.DataFrame({"image_id": range(50), "u": u})), "image_id")
    got = [r["task_id"] for r in S.uncertain_and_diverse(df, "image_id", "embedding", "u", 8, candidates=candidates).orderBy("rank").collect()]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    div, want = d.mean(1) / d.mean(1).max(), []
    while len(want) < 8:
        s = 0.7 * u + 0.3 * div
        s[want] = -1
        want.append(int(np.argmax(s)))
        div = div * (1 - 0.5 / (1 + d[:, want[-1]]))
    assert got == want


def test_square_gives_two_corners(spark):
    df = frame(spark, [[0, 0], [0, 1], [1, 0], [1, 1]])
    assert [r["task_id"] for r in S.farthest_first(df, "image_id", "embedding", 2, 0).orderBy("rank").collect()] == [0, 3]


def test_batch_larger_than_the_pool(spark):
    assert S.farthest_first(frame(spark, [[0.0], [1.0]]), "image_id", "embedding", 5, 0).count() == 2


def test_dbscan_and_kmeans(spark):
    rng = np.random.default_rng(13)
    x = np.vstack([rng.normal(0, 0.05, (10, 2)), rng.normal(5, 0.05, (10, 2)), [[50, 50]]])
    df = frame(spark, x)
    picked = G.dbscan_representatives(df, "image_id", "embedding", 0.5, 3).collect()
    assert [r["noise"] for r in picked] == [0, 0, 1] and picked[2]["id"] == 20
    reps = S.kmeans_representatives(df, "image_id", "embedding", 3, reduce_to=None).collect()
    assert len({r["task_id"] for r in reps}) == 3 and any(r["task_id"] == 20 for r in reps)


def test_kmeans_rounds_are_those_of_one_reader(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(0, 1, (80, 3)), 3)
    x[40:45] = x[3]
    df = frame(spark, x)
    bad = spark.createDataFrame([(200, "x", None), (201, "x", [1.0, None, 2.0]), (202, "x", [float("nan")] * 3), (203, "x", [1.0])], df.schema)
    draw = sorted(range(80), key=lambda i: (int(hashlib.md5(f"{i}|7".encode()).hexdigest()[:13], 16), i))
    centres = x[draw[:6]].copy()
    for _ in range(4):
        own = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([x[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(6)])
    d = np.sqrt(((x[:, None] - centres[None]) ** 2).sum(axis=2))
    own = d.argmin(axis=1)
    want = {c: min((round(d[i, c], 9), i) for i in range(80) if own[i] == c) for c in set(own.tolist())}
    short = bad.filter("image_id < 203")
    for table in (df.unionByName(short), df.unionByName(short).repartition(7)):
        got = {r["cluster"]: (round(r["score"], 9), r["task_id"]) for r in S.kmeans_rounds(table, "image_id", "embedding", 6, rounds=4, seed=7).collect()}
        assert got == want
    assert S.kmeans_rounds(bad.filter("image_id = 200"), "image_id", "embedding", 3).collect() == []
    assert len(S.kmeans_rounds(bad.filter("image_id = 203"), "image_id", "embedding", 3).collect()) == 1


def test_far_row_is_an_anomaly(spark):
    rng = np.random.default_rng(14)
    df = frame(spark, np.vstack([rng.normal(0, 1, (200, 3)), [[30, 30, 30]]]))
    wide = df.withColumn("first", F.col("embedding")[0])
    per_id, failed = N.anomaly_consensus(wide, {
        "statistical": lambda d: N.statistical_detector(d, "image_id", ["first"]),
        "lof": lambda d: N.lof_detector(d, "image_id", "embedding", 10, 3.0),
        "forest": lambda d: N.isolation_forest(d, "image_id", "embedding", trees=20, sample=64),
        "none": lambda d: d.select("missing"),
    })
    far = per_id.filter("id = 200").first()
    assert far["is_anomaly"] and far["votes"] == 3 and list(failed) == ["none"]
    assert N.consensus_summary(per_id).first()["anomaly_rate"] < 0.1


def test_forest_is_the_same_on_every_run(spark):
    df = frame(spark, np.random.default_rng(1).normal(0, 1, (100, 3)))
    a = N.isolation_forest(df, "image_id", "embedding", trees=5, sample=32).orderBy("id").collect()
    b = N.isolation_forest(df.repartition(7), "image_id", "embedding", trees=5, sample=32).orderBy("id").collect()
    assert [r["score"] for r in a] == [r["score"] for r in b]


def test_lsh_finds_only_true_pairs(spark):
    x = np.random.default_rng(15).normal(0, 1, (120, 3))
    exact = {(r["src"], r["dst"]) for r in G.radius_join(frame(spark, x), "image_id", "embedding", 0.6).collect()}
    near = {(r["src"], r["dst"]) for r in G.radius_join_lsh(frame(spark, x), "image_id", "embedding", 0.6, bucket=1.0).collect()}
    assert near <= exact and len(near) >= 0.8 * len(exact)


def test_failed_batches_are_kept(spark):
    df = frame(spark, [[float(i), 1.0] for i in range(20)]).coalesce(1)

    def fn(matrix):
        if matrix[0, 0] >= 10:
            raise ValueError("bad batch")
        return matrix + 1

    out = P.batch_inference(df, "image_id", "embedding", fn, batch_size=5).collect()
    assert sum(r["status"] == "DONE" for r in out) == 10
    assert {r["error"] for r in out if r["status"] == "FAILED"} == {"bad batch"}


def test_models_rank_the_unsure_rows(spark):
    rng = np.random.default_rng(16)
    x = rng.normal(0, 1, (150, 2))
    rows = [(i, [float(a), float(b)], float(a > 0)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "task_id int, features array<double>, label double")
    scores = {r["task_id"]: r["score"] for r in S.calibrated_uncertainty(df, df, 2).collect()}
    near = [scores[i] for i in range(150) if abs(x[i, 0]) < 0.1]
    far = [scores[i] for i in range(150) if abs(x[i, 0]) > 1]
    assert np.mean(near) > np.mean(far)


def test_copies_of_a_row_do_not_grow_with_the_table():
    # each side of a pair of blocks is copied once for every block of the other side
    assert [B.block_count(rows) for rows in (1, 4096, 4097, 60_000, 600_000, 2_000_000)] == [1, 1, 2, 15, 16, 16]
    assert B.block_count(4_000_000) == 31 and B.block_count(1000, 10) == 100


@pytest.mark.parametrize("tile", [7, 64, 1 << 20])
def test_streamed_neighbours_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(B, "TILE", tile)
    rng = np.random.default_rng(4)
    x = np.r_[rng.normal(size=(60, 3)), np.zeros((40, 3)), np.round(rng.normal(size=(40, 3)))]
    ids = rng.permutation(len(x)) * 3
    found = B._Nearest(ids, x, 5 + B.SPARE)
    order = np.argsort(ids)
    for begin in range(0, len(x), 23):
        part = order[begin:begin + 23]
        found.meet(ids[part], x[part], B._sames(pd.Series(ids), pd.Series(ids[part])))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    for i in range(len(x)):
        want = sorted(zip(d[i], ids))[:5]
        got = sorted(zip(found.exact[i], found.other[i]))[:5]
        assert [o for _, o in got] == [o for _, o in want] and np.allclose([g for g, _ in got], [w for w, _ in want])


def test_one_side_of_a_pair_streams(spark, monkeypatch):
    rows = spark.range(500).select("id", F.array(F.col("id").cast("double")).alias("v"), F.lit(0).alias("bi"))

    def kernel(x, others):
        yield pd.DataFrame({"held": [len(x)], "batches": [sum(1 for _ in others)]})

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got = B.streamed_pairs(rows.limit(120), rows, ["bi"], 2, kernel, "held long, batches long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r.held for r in got] == [120] and got[0].batches >= 10


@pytest.mark.parametrize("bucket", [0.05, 2.0])
def test_lsh_gives_the_pairs_of_the_library_join(spark, bucket):
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    df = frame(spark, np.random.default_rng(8).normal(size=(150, 4)))
    rows = df.select(F.col("image_id").alias("id"), array_to_vector("embedding").alias("f"))
    model = BucketedRandomProjectionLSH(inputCol="f", outputCol="h", bucketLength=bucket, numHashTables=3, seed=3).fit(rows)
    found = model.approxSimilarityJoin(rows, rows, 1.0, "weight").filter("datasetA.id < datasetB.id").select("datasetA.id", "datasetB.id").collect()
    got = [(r.src, r.dst) for r in G.radius_join_lsh(df, "image_id", "embedding", 1.0, bucket, tables=3).collect()]
    assert len(got) == len(set(got)) and set(got) == {tuple(r) for r in found} and got


def test_lsh_meets_wide_buckets_once(spark):
    """Wide buckets hold all rows in every table; the plan must not join them table by table."""
    df = frame(spark, np.random.default_rng(8).normal(size=(300, 4)))
    plan = G.radius_join_lsh(df, "image_id", "embedding", 1.0, 50.0)._jdf.queryExecution().toString()
    assert "posexplode" not in plan.lower() and "datasetA" not in plan


def test_edges_are_stored_once(spark, monkeypatch):
    """A traversal keeps every edge once and in one direction, and takes a stored table as it is."""
    df = frame(spark, [[0.0], [1.0], [2.0], [5.0]])
    edges = G.radius_join(df, "image_id", "embedding", 1.5)
    written = []
    monkeypatch.setattr(G, "stored", lambda d, *c: written.append(stored(d, *c)) or written[-1])
    kept = stored(edges)
    seeds = df.filter("image_id = 0")
    assert {r.id: r.hop for r in G.bfs_levels(df, "image_id", kept, seeds).collect()} == {0: 0, 1: 1, 2: 2, 3: None}
    assert {r.id: r.distance for r in G.shortest_paths(df, "image_id", kept, seeds).collect()} == {0: 0, 1: 1, 2: 2, 3: None}
    assert written and all(w is kept for w in written)
    G.bfs_levels(df, "image_id", edges, seeds)
    assert written[-1].columns == ["src", "dst"] and written[-1].count() == 2


def test_tasks_thin_their_edges(monkeypatch):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 300, (2, 5000))
    a, b = a + 300 * rng.integers(0, 3, 5000), b
    b = b + a // 300 * 300
    frames = [pd.DataFrame({"a": np.maximum(a, b)[i:i + 100], "b": np.minimum(a, b)[i:i + 100]}) for i in range(0, 5000, 100)]
    for held in (1 << 20, 2500, 50):
        monkeypatch.setattr(G, "HELD_LINKS", held)
        out = pd.concat(G._thinned(iter(frames)))
        assert held < 1000 or len(out) < 900
        full, thin = G._stars(a, b), G._stars(out["a"].to_numpy(), out["b"].to_numpy())
        assert [f.tolist() for f in full] == [t.tolist() for t in thin]
    assert len(G._stars(np.array([5, 5]), np.array([5, 5]))[0]) == 0

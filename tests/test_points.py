"""Point and vector joins against plain loops, with crowded cells, and how much of them never meets."""

import numpy as np
import pandas as pd
import pytest

from curadrift.operators import graph as G, selection as A, spatial as X


def cloud(rng, n):
    centres = rng.normal(0, 5, (6, 2))
    xy = centres[rng.integers(0, 6, n)] + rng.normal(0, 0.3, (n, 2))
    xy[: n // 3] = xy[0]  # a third of all points in one place
    return pd.DataFrame({"id": np.arange(n), "x": xy[:, 0], "y": xy[:, 1]})


@pytest.mark.parametrize("cell", [16, 4096])
def test_knn_join_in_two_rounds(spark, cell):
    rng = np.random.default_rng(cell)
    points = cloud(rng, 900)
    queries = pd.DataFrame({"query_id": np.arange(40), "x": rng.normal(0, 6, 40), "y": rng.normal(0, 6, 40)})
    queries.loc[:3, ["x", "y"]] = points.loc[0, ["x", "y"]].to_numpy()
    frame = spark.createDataFrame(queries).unionByName(spark.createDataFrame([(99, None, 1.0)], "query_id long, x double, y double"))
    got = X.knn_join(spark.createDataFrame(points), ["x", "y"], frame, 7, cell).toPandas()
    for q in queries.itertuples():
        d = np.sqrt((points.x - q.x) ** 2 + (points.y - q.y) ** 2)
        want = points.id.to_numpy()[np.lexsort((points.id, d))[:7]]
        mine = got[got.query_id == q.query_id].sort_values(["distance", "id"])
        assert mine.id.tolist() == want.tolist()
    assert 99 not in set(got.query_id)


def test_knn_join_with_fewer_points_than_asked_for(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0)], "id long, x double, y double")
    queries = spark.createDataFrame([(5, 0.9, 0.0)], "query_id long, x double, y double")
    assert [(r.id) for r in X.knn_join(points, ["x", "y"], queries, 4, 1).orderBy("distance").collect()] == [2, 1]
    assert X.knn_join(points.filter("id < 0"), ["x", "y"], queries, 4).collect() == []


def test_a_query_touches_few_cells_of_a_million_points():
    rng = np.random.default_rng(5)
    xy = rng.normal(0, 1, (1_000_000, 2))
    cells = X.Cells(xy[: X.TREE_SAMPLE], len(xy) // X.CELL_POINTS)
    of, k = cells.of(xy), 10
    sizes = np.bincount(of, minlength=len(cells.low))
    shares = []
    for q in rng.normal(0, 1, (30, 2)):
        home = of == cells.of(q[None, :])[0]
        reach = np.sqrt(np.sort(((xy[home] - q) ** 2).sum(1))[k - 1])
        shares.append(sizes[cells.touched(q, reach)].sum() / len(xy))
    assert max(shares) < 0.05


@pytest.mark.parametrize("radius", [0.0, 0.4])
def test_radius_join_of_cells(spark, radius):
    points = cloud(np.random.default_rng(1), 300)
    queries = points.iloc[::7].rename(columns={"id": "query_id"})
    got = X.radius_join_cells(spark.createDataFrame(points), ["x", "y"], spark.createDataFrame(queries), radius, 20).toPandas()
    d = np.sqrt((queries.x.to_numpy()[:, None] - points.x.to_numpy()) ** 2 + (queries.y.to_numpy()[:, None] - points.y.to_numpy()) ** 2)
    i, j = np.nonzero(d <= radius)
    assert sorted(zip(got.query_id, got.id)) == sorted(zip(queries.query_id.to_numpy()[i], points.id.to_numpy()[j]))


def test_thousand_anchors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (6000, 64))
    rows = spark.createDataFrame(pd.DataFrame({"id": np.arange(6000), "v": list(x)}))
    anchors = rows.filter("id < 1000").selectExpr("id AS anchor", "v")
    out = A.anchor_distances(rows, "id", "v", anchors, ["euclidean", "cosine"], block_anchors=256)
    got = out.groupBy().agg({"euclidean": "sum", "*": "count"}).first()
    want = sum(np.sqrt(((x - a) ** 2).sum(1)).sum() for a in x[:1000])
    assert got["count(1)"] == 6_000_000 and abs(got["sum(euclidean)"] - want) < 1e-6 * want


def clustered(n, dims=64, centres=50):
    rng = np.random.default_rng(7)
    return rng.normal(0, 1, (centres, dims))[rng.integers(0, centres, n)] + rng.normal(0, 0.05, (n, dims))


@pytest.mark.parametrize(("radius", "closed", "block"), [(0.55, False, 4096), (0.7, True, 16), (0.0, True, 16)])
def test_radius_join_of_vectors(spark, radius, closed, block):
    x = np.r_[clustered(350, 16, 9), clustered(20, 16, 1)]
    x[50:90] = x[50]
    frame = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "v": list(x)})).repartition(3)
    got = {(r.src, r.dst) for r in G.radius_join(frame, "id", "v", radius, closed, block).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    i, j = np.nonzero(d <= radius if closed else d < radius)
    assert got == {(a, b) for a, b in zip(i.tolist(), j.tolist()) if a < b}


def test_most_pairs_of_clustered_vectors_never_meet(spark):
    n = 100_000
    frame = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "v": list(clustered(n))})).repartition(8)
    home, around = G.radius_sides(frame, "id", "v", 0.9)
    left = home.groupBy("cell", "band").count().withColumnRenamed("count", "a")
    right = around.groupBy("cell", "band").count().withColumnRenamed("count", "b")
    met = left.join(right, ["cell", "band"]).selectExpr("sum(a * b) AS met").first()["met"]
    assert met < 0.1 * n * n / 2

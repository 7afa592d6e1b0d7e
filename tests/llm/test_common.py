import random

import pytest

from curadrift.llm import common as C


def brute(edges):
    root = {}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for node in sorted(near):
        if node not in root:
            todo = [node]
            while todo:
                x = todo.pop()
                if x not in root:
                    root[x] = node
                    todo += near[x]
    return root


@pytest.mark.parametrize("seed", range(3))
def test_components_against_a_search(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(60):03}", f"n{rng.randrange(60):03}") for _ in range(35)]
    edges += [(f"p{i:03}", f"p{i + 1:03}") for i in range(40)] + [("s000", f"s{i:03}") for i in range(1, 30)]
    edges = [(a, b) for a, b in edges if a != b]
    got = {r.node: r.root for r in C.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == brute(edges)


def test_no_links(spark):
    assert C.components(spark.createDataFrame([], "a string, b string")).collect() == []


def test_units_are_whole_whatever_the_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.range(1000).selectExpr("id", "cast(sqrt(id) as int) as k", "cast(id % 3 as string) as m")
        got = C.by_units(df, ["k", "m"], lambda u: u.groupby(["k", "m"], as_index=False).agg(n=("id", "size"), s=("id", "sum")), "k int, m string, n long, s long")
        want = df.groupBy("k", "m").agg({"id": "count"}).count()
        rows = got.collect()
        assert len(rows) == want and sum(r.n for r in rows) == 1000 and sum(r.s for r in rows) == 499500
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

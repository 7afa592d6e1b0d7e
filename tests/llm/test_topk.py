import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curadrift.llm import topk as T

SCHEMA = "vec_id long, embedding array<float>, score long, rank int, uid long, q long, band int, dim string"


def brute(rows, k, every):
    kept = []
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, np.floor(256 * np.asarray(v, dtype=np.float32).astype(np.float64)).astype(np.int64)))
    out = []
    for n, (i, q) in enumerate(kept):
        if i % every == 0:
            scored = sorted((-int(q @ v), j) for m, (j, v) in enumerate(kept) if m != n and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4, 5, "x") for i, v in rows], SCHEMA)


def fixture(seed, n=300, dim=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    rows = [(i, (centres[i % 6] + 0.3 * rng.normal(size=dim)).astype(float).tolist()) for i in range(n)]
    some = rows[10][1]
    rows += [(1000 + i, some) for i in range(25)]                        # ties in every score
    rows += [rows[50], rows[50], (50, rows[51][1])]                      # repeated rows, one id twice
    rows += [(2000, None), (2050, []), (2100, [None] + some[1:]), (2150, [float("nan")] + some[1:]), (2200, [float("inf")] + some[1:]), (None, some)]
    rows += [(2250, some[:5]), (2300, some[:5]), (2350, [0.0] * dim), (2400, [-x for x in some]), (2450, [9.5])]
    random.Random(seed).shuffle(rows)
    return rows


def found(df, k=5, every=50):
    return sorted(tuple(r) for r in T.top_k(T.quantised(df), k, every).collect())


@pytest.mark.parametrize(("seed", "k", "block", "queries"), [(1, 5, T.BLOCK_ROWS, T.BLOCK_QUERIES), (2, 5, 37, 3), (3, 1, 64, 2), (4, 600, 50, 5)])
def test_against_brute_force(spark, monkeypatch, seed, k, block, queries):
    monkeypatch.setattr(T, "BLOCK_ROWS", block)
    monkeypatch.setattr(T, "BLOCK_QUERIES", queries)
    rows = fixture(seed)
    assert found(frame(spark, rows), k) == brute(rows, k, 50)


def test_one_component_and_one_row(spark):
    rows = [(i, [float(i % 7) - 3]) for i in range(120)]
    assert found(frame(spark, rows)) == brute(rows, 5, 50)
    assert found(frame(spark, [(50, [1.0, 2.0])])) == []


def test_empty_table(spark):
    assert found(frame(spark, []).where(F.lit(False))) == []


def test_bounds_hold():
    rng = np.random.default_rng(9)
    q, x = rng.integers(-900, 900, (40, 50)), rng.integers(-900, 900, (60, 50))
    for segments in T.LEVELS:
        bound = T._stats(q.astype(float), segments) @ T._stats(x.astype(float), segments).T
        assert (bound + 1e-6 >= q @ x.T).all()
    assert (T._exact(q, x) == q @ x.T).all()
    wide = q.astype(np.int64) * (1 << 21)
    assert (T._exact(wide, x) == wide @ x.T).all()

"""Exact top-k by inner product: segment means and deviations bound every pair, coarse to fine, before exact scores.

For a segment of m components, ``q.x <= m * (mean_q * mean_x + dev_q * dev_x)`` (Cauchy-Schwarz on the centred parts). As
``|q - x|^2 = |q|^2 + |x|^2 - 2 q.x``, the sum over segments is a lower bound of the distance and an upper bound of the
score. Pairs whose bound falls below the k-th best score known are dropped, the rest go to a finer level and at last to
integer arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from curadrift.llm.common import parts_for, query, stored, table

BLOCK_ROWS = 4096
BLOCK_QUERIES = 1024
LEVELS = (1, 4, 16)
EXACT_FLOAT = 2.0 ** 52


def quantised(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id``, ``v``: floor(scale * x) as longs. Rows with a null id, a null vector, no components, or null or
    non-finite components take no part; products beyond the range of long are clamped to it by the cast."""
    x = F.col("embedding")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return (
        embeddings.select("vec_id", "embedding")
        .where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & fine)
        .select("vec_id", F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double"))).alias("v"))
    )


def _pack(size: int, tag: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby(batch["v"].map(len), sort=True):
                for a in range(0, len(part), size):
                    cut = part.iloc[a:a + size]
                    matrix = np.array(cut["v"].to_list(), dtype=np.int64)
                    yield pd.DataFrame({
                        tag: [int(cut["uid"].iat[0])], "dim": [int(dim)],
                        f"{tag}_uids": [cut["uid"].to_numpy(np.int64).tobytes()],
                        f"{tag}_ids": [cut["vec_id"].to_numpy(np.int64).tobytes()], f"{tag}_matrix": [matrix.tobytes()],
                    })

    return run


def _stats(m: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(length) * mean and sqrt(length) * deviation of each segment, side by side: a product of two such rows is the bound."""
    parts = np.array_split(m, min(segments, m.shape[1]), axis=1)
    mean = np.stack([p.mean(axis=1) for p in parts], axis=1)
    dev = np.stack([p.std(axis=1) for p in parts], axis=1)
    root = np.sqrt([p.shape[1] for p in parts])
    return np.concatenate([mean * root, dev * root], axis=1)


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer scores of all pairs; floating point only where every partial sum is an exact integer."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < EXACT_FLOAT:
        return np.rint(q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def block_top(q: np.ndarray, q_uid: np.ndarray, x: np.ndarray, x_uid: np.ndarray, x_id: np.ndarray, k: int):
    """Per query row: indexes and scores of its k best rows of the block, own row left out, ties to the smaller id."""
    qf, xf = q.astype(np.float64), x.astype(np.float64)
    slack = 1e-9 * np.linalg.norm(qf, axis=1).max(initial=0) * np.linalg.norm(xf, axis=1).max(initial=0) + 1.0
    own = q_uid[:, None] == x_uid[None, :]
    bound = np.where(own, -np.inf, _stats(qf, LEVELS[0]) @ _stats(xf, LEVELS[0]).T)
    width = min(x.shape[0], 4 * k + 1)
    first = np.argpartition(-bound, width - 1, axis=1)[:, :width]
    tried = np.einsum("qd,qwd->qw", q, x[first])
    tried = np.where(np.take_along_axis(own, first, axis=1), np.iinfo(np.int64).min, tried)
    kept = min(k, width)
    floor_score = np.sort(tried, axis=1)[:, width - kept] if width > k else np.full(len(q), np.iinfo(np.int64).min)
    live = ~own & (bound >= floor_score[:, None].astype(np.float64) - slack)
    for segments in LEVELS[1:]:
        if segments >= x.shape[1]:
            break
        finer = _stats(qf, segments) @ _stats(xf, segments).T
        live &= finer >= floor_score[:, None].astype(np.float64) - slack
    rows = np.flatnonzero(live.any(axis=1))
    cols = np.flatnonzero(live.any(axis=0))
    scores = np.empty((len(rows), len(cols)), dtype=np.int64)
    if live.sum() * 8 > scores.size:
        scores = _exact(q[rows], x[cols])
    else:
        scores.fill(np.iinfo(np.int64).min)
        r, c = np.nonzero(live[np.ix_(rows, cols)])
        for a in range(0, len(r), 65536):
            i, j = r[a:a + 65536], c[a:a + 65536]
            scores[i, j] = np.einsum("nd,nd->n", q[rows[i]], x[cols[j]])
    allowed = live[np.ix_(rows, cols)]
    for n, row in enumerate(rows):
        here = np.flatnonzero(allowed[n])
        best = here[np.lexsort((x_id[cols[here]], -scores[n, here]))[:k]]
        yield row, cols[best], scores[n, best]


def top_k(vectors: DataFrame, k: int, every: int) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: for each row whose ``vec_id`` is divisible by ``every``, its k highest
    integer inner products over all other rows of the same length (a repeated row is another row).

    Rows and queries are packed into blocks of bounded size; the pairs of blocks form a grid
    that is dealt to tasks, which hold one Arrow batch of pairs at a time and gives k rows a query. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    held = stored(vectors.select("vec_id", "v").withColumn("uid", F.monotonically_increasing_id()), "topk-vectors")
    rows = held.mapInPandas(_pack(BLOCK_ROWS, "x"), "x long, dim int, x_uids binary, x_ids binary, x_matrix binary")
    asked = held.where(F.pmod("vec_id", F.lit(every)) == 0)
    columns = parts_for(held.count(), every * BLOCK_QUERIES)
    bands = parts_for(4 * spark.sparkContext.defaultParallelism, columns)
    queries = asked.repartition(columns).mapInPandas(
        _pack(BLOCK_QUERIES, "q"), "q long, dim int, q_uids binary, q_ids binary, q_matrix binary")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                q_ids, x_ids = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.x_ids, np.int64)
                q_uid, x_uid = np.frombuffer(r.q_uids, np.int64), np.frombuffer(r.x_uids, np.int64)
                q = np.frombuffer(r.q_matrix, np.int64).reshape(-1, r.dim)
                x = np.frombuffer(r.x_matrix, np.int64).reshape(-1, r.dim)
                found = list(block_top(q, q_uid, x, x_uid, x_ids, k))
                if found:
                    yield pd.DataFrame({
                        "query_uid": np.repeat(q_uid[[f[0] for f in found]], [len(f[1]) for f in found]),
                        "query_id": np.repeat(q_ids[[f[0] for f in found]], [len(f[1]) for f in found]),
                        "vec_id": np.concatenate([x_ids[f[1]] for f in found]), "score": np.concatenate([f[2] for f in found]),
                    })

    # a grid of cells: row blocks are dealt to bands, query blocks to columns, and each pair of blocks meets in one cell
    bands_of_rows = rows.withColumn("band", F.pmod(F.xxhash64("x"), F.lit(bands)).cast("int")).withColumn(
        "column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    columns_of_queries = queries.withColumn("column", F.pmod(F.xxhash64("q"), F.lit(columns)).cast("int")).withColumn(
        "band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))))
    found = bands_of_rows.join(columns_of_queries, ["dim", "band", "column"]).mapInPandas(
        work, "query_uid long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT q.uid, q.vec_id AS query_id, x.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(x.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v x ON len(q.v) = len(x.v) AND q.uid <> x.uid WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op7_exact_topk", SQL)
def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(quantised(table(spark, sf_dir, "embeddings")), 5, 50)

"""All-pairs work cut into block pairs.

Where every pair of rows matters and no identity removes them, rows are dealt into blocks of a
bounded size and each pair of blocks becomes one task that works on two NumPy matrices. A task
emits only what the operator keeps (sums, matches, nearest neighbours), never the pairs.

``streamed_pairs`` holds one block of a pair and reads the other in batches, tile by tile, so blocks may grow with the table: a row
is copied a bounded number of times up to ``BLOCKS * MOST_ROWS`` rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# Blocks hold BLOCK_ROWS rows until there are BLOCKS of them, then they grow up to MOST_ROWS rows.
BLOCK_ROWS, BLOCKS, MOST_ROWS = 4096, 16, 1 << 17
# Distances a task looks at together.
TILE = 1 << 20


def block_count(rows: int, block_rows: int | None = None) -> int:
    """Blocks of ``block_rows`` rows; without it, blocks that grow with the table."""
    if block_rows is None:
        return max(1, min(math.ceil(rows / BLOCK_ROWS), max(BLOCKS, math.ceil(rows / MOST_ROWS))))
    return max(1, math.ceil(rows / block_rows))


def block_counts(rows: Column, block_rows: int) -> Column:
    """``block_count`` of a column of row counts, for blocks that hold ``block_rows`` rows before they grow."""
    most = max(block_rows, MOST_ROWS)
    return F.least(F.ceil(rows / block_rows), F.greatest(F.lit(BLOCKS).cast("bigint"), F.ceil(rows / most)))


def no_rows(*names: str) -> pd.DataFrame:
    """An empty frame whose columns convert to any type."""
    return pd.DataFrame({n: pd.Series([], dtype=object) for n in names})


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64, copy=False) if len(column) else np.zeros((0, 1))


def tiles(a: np.ndarray, b: np.ndarray, tile: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, squared Euclidean distances of some rows of ``a`` to all of ``b``), about ``tile`` distances at a time."""
    left, right, back = (a * a).sum(1), (b * b).sum(1), np.ascontiguousarray((-2.0 * b).T)
    # below this a distance may be what cancellation leaves of equal rows
    doubtful = 1e-12 * (left.max(initial=0.0) + right.max(initial=0.0))
    step = max(1, (tile or TILE) // max(1, len(b)))
    for begin in range(0, len(a), step):
        out = a[begin:begin + step] @ back
        out += left[begin:begin + step, None]
        out += right
        low = out < doubtful
        if low.any():
            i, j = np.nonzero(low)
            out[i, j] = np.where(out[i, j] < 1e-12 * (left[begin + i] + right[j]), 0.0, out[i, j])
        yield begin, out


def sq_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of all row pairs of two blocks."""
    for _, out in tiles(a, b, max(1, len(a) * len(b))):
        return out
    return np.zeros((0, len(b)))


def block_pairs(
    left: DataFrame,
    right: DataFrame,
    left_blocks: int,
    right_blocks: int,
    kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    key: str = "id",
    also: list[str] | None = None,
) -> DataFrame:
    """Run ``kernel(left_block, right_block)`` for each block pair, within equal ``also`` columns.

    Rows are dealt by a hash of ``key``; each left row is copied once per right block and the
    other way round, so a task holds two blocks whatever the table size.
    """
    def dealt(df: DataFrame, own: int, other: int, mine: str, theirs: str) -> DataFrame:
        block = F.pmod(F.xxhash64(key), F.lit(own)).cast("int")
        partners = F.sequence(F.lit(0), F.lit(other - 1))
        # fresh column identities, so that a table may be paired with itself
        renamed = df.select(*[F.col(c).alias(c) for c in df.columns])
        return renamed.withColumn(mine, block).withColumn(theirs, F.explode(partners))

    a = dealt(left, left_blocks, right_blocks, "bi", "bj").groupBy("bi", "bj", *(also or []))
    b = dealt(right, right_blocks, left_blocks, "bj", "bi").groupBy("bi", "bj", *(also or []))

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return kernel(x, y)

    return a.cogroup(b).applyInPandas(run, schema)


# Given a block of the left rows and the right rows in batches, the frames to emit.
Kernel = Callable[[pd.DataFrame, Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def streamed_pairs(left: DataFrame, right: DataFrame, keys: list[str], tasks: int, kernel: Kernel, schema: str) -> DataFrame:
    """Run ``kernel`` for each value of ``keys`` that both sides have, a column ``id`` being the order of the rows of a side.

    A task holds the left rows of one value; the right ones pass by in Arrow batches, and what the kernel yields leaves at once.
    """
    both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)), allowMissingColumns=True)
    dealt = both.repartition(tasks, *keys).sortWithinPartitions(*keys, "side", "id")
    at = [*keys, "side"]

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, int, pd.DataFrame]]:
        for frame in frames:
            if not len(frame):
                continue
            marks = frame[at].to_numpy()
            starts = np.r_[0, np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1, len(frame)]
            for begin, end in itertools.pairwise(starts.tolist()):
                yield tuple(marks[begin, :-1]), int(marks[begin, -1]), frame.iloc[begin:end]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, group in itertools.groupby(pieces(frames), key=lambda p: p[0]):
            held = []
            for _, side, part in group:
                if side == 0:
                    held.append(part)
                    continue
                if held:
                    block = pd.concat(held, ignore_index=True)
                    held = []
                    yield from kernel(block, itertools.chain([part], (p for _, _, p in group)))
                break

    return dealt.mapInPandas(run, schema)


def _block_grid(left: DataFrame, right: DataFrame, left_blocks: int, right_blocks: int, kernel: Kernel, schema: str) -> DataFrame:
    """``streamed_pairs`` of all blocks of the left rows with all of the right ones."""
    def dealt(df: DataFrame, own: int, other: int, mine: str, theirs: str) -> DataFrame:
        block = F.pmod(F.xxhash64("id"), F.lit(own)).cast("int")
        return df.select("id", "v", block.alias(mine), F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias(theirs))

    a, b = dealt(left, left_blocks, right_blocks, "bi", "bj"), dealt(right, right_blocks, left_blocks, "bj", "bi")
    return streamed_pairs(a, b, ["bi", "bj"], 2 * left_blocks * right_blocks, kernel, schema)


def pair_sums(
    left: DataFrame, right: DataFrame, n_left: int, n_right: int, function: str, scale: float = 1.0
) -> DataFrame:
    """One row: sum over all (left, right) pairs of exp(-d^2 / scale) or of the distance d."""
    def kernel(x: pd.DataFrame, others: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, total = _matrix(x["v"]), 0.0
        for y in others:
            for _, d2 in tiles(a, _matrix(y["v"])):
                total += float((np.exp(-d2 / scale) if function == "rbf" else np.sqrt(d2)).sum())
        yield pd.DataFrame({"s": [total]})

    sums = _block_grid(left, right, block_count(n_left), block_count(n_right), kernel, "s double")
    return sums.agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"))


def _sames(ids: pd.Series, others: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Positions of equal ids, ordered by the first."""
    pairs = pd.DataFrame({"id": ids.to_numpy(), "i": np.arange(len(ids))}).merge(pd.DataFrame({"id": others.to_numpy(), "j": np.arange(len(others))}), on="id")
    pairs = pairs.sort_values("i")
    return pairs["i"].to_numpy(np.int64), pairs["j"].to_numpy(np.int64)


def distance_sums(df: DataFrame, key: str, vector: str, n: int) -> DataFrame:
    """key, total: each row's summed Euclidean distance to all rows (blocks emit row sums)."""
    rows = df.select(F.col(key).alias("id"), F.col(vector).alias("v"))
    blocks = block_count(n)

    def kernel(x: pd.DataFrame, others: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, totals = _matrix(x["v"]), np.zeros(len(x))
        for y in others:
            i, j = _sames(x["id"], y["id"])
            for begin, d2 in tiles(a, _matrix(y["v"])):
                here = slice(*np.searchsorted(i, [begin, begin + len(d2)]))
                d2[i[here] - begin, j[here]] = 0.0
                totals[begin:begin + len(d2)] += np.sqrt(d2).sum(1)
        yield pd.DataFrame({"id": x["id"], "s": totals})

    id_type = df.schema[key].dataType.simpleString()
    partial = _block_grid(rows, rows, blocks, blocks, kernel, f"id {id_type}, s double")
    return partial.groupBy(F.col("id").alias(key)).agg(F.sum("s").alias("total"))


# Neighbours kept beyond k by the fast form of the distance, and the columns of a batch that set a row's first limit.
SPARE, FIRST = 8, 1024


class _Nearest:
    """The ``keep`` nearest by the fast form to each row of a block, of others that pass by in ascending id; ties to the earlier."""

    def __init__(self, ids: np.ndarray, a: np.ndarray, keep: int):
        self.ids, self.a, self.keep = ids, a, keep
        self.fast = np.full((len(a), keep), np.inf)
        self.exact = np.full((len(a), keep), np.inf)
        self.other = np.zeros((len(a), keep), dtype=ids.dtype)

    def meet(self, ids: np.ndarray, b: np.ndarray, sames: tuple[np.ndarray, np.ndarray]) -> None:
        for begin, d2 in tiles(self.a, b):
            rows = slice(begin, begin + len(d2))
            here = slice(*np.searchsorted(sames[0], [begin, begin + len(d2)]))
            d2[sames[0][here] - begin, sames[1][here]] = np.inf
            limit = self.fast[rows, -1]
            if len(b) > self.keep and np.isinf(limit).any():
                limit = np.partition(d2[:, :max(FIRST, self.keep)], self.keep - 1, axis=1)[:, self.keep - 1]
                near = (d2 <= limit[:, None]) & np.isfinite(d2)
            else:
                near = d2 < limit[:, None]
            if near.sum() > len(d2) * FIRST // 4:
                # many at one distance, such as copies: the first of them by id
                order = np.argsort(d2, axis=1, kind="stable")[:, :self.keep]
                near = np.zeros(d2.shape, dtype=bool)
                np.put_along_axis(near, order, True, axis=1)
                near &= np.isfinite(d2)
            i, j = np.nonzero(near)
            if len(i):
                self._take(rows, i, j, d2[i, j], ids, b)

    def _take(self, rows: slice, i: np.ndarray, j: np.ndarray, fast: np.ndarray, ids: np.ndarray, b: np.ndarray) -> None:
        count, keep = rows.stop - rows.start, self.keep
        row = np.r_[np.repeat(np.arange(count), keep), i]
        all_fast = np.r_[self.fast[rows].ravel(), fast]
        # those of before stand first, so they win ties
        order = np.lexsort((all_fast, row))
        first = np.searchsorted(row[order], np.arange(count))
        rank = np.arange(len(order)) - first[row[order]]
        chosen = order[rank < keep]
        exact, other = np.r_[self.exact[rows].ravel(), np.zeros(len(i))], np.r_[self.other[rows].ravel(), ids[j]]
        new = chosen[chosen >= count * keep] - count * keep
        exact[count * keep + new] = np.sqrt(((self.a[rows.start + i[new]] - b[j[new]]) ** 2).sum(axis=1))
        self.fast[rows] = all_fast[chosen].reshape(count, keep)
        self.exact[rows], self.other[rows] = exact[chosen].reshape(count, keep), other[chosen].reshape(count, keep)


def nearest(df: DataFrame, key: str, vector: str, k: int, n: int) -> DataFrame:
    """id, other, distance: the k nearest other rows of each row (ties to the smaller id).

    Each block pair emits k candidates per row; the k best of those are kept.
    """
    from curadrift.operators.entities import top_n_per_group

    rows = df.select(F.col(key).alias("id"), F.col(vector).alias("v"))
    blocks = block_count(n)

    def kernel(x: pd.DataFrame, others: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a few more by the fast form, then the exact distance decides
        found = _Nearest(x["id"].to_numpy(), _matrix(x["v"]), k + SPARE)
        for y in others:
            found.meet(y["id"].to_numpy(), _matrix(y["v"]), _sames(x["id"], y["id"]))
        best = np.lexsort((found.other, found.exact), axis=1)[:, :k]
        frame = pd.DataFrame({
            "id": np.repeat(x["id"].to_numpy(), k),
            "other": np.take_along_axis(found.other, best, axis=1).ravel(),
            "distance": np.take_along_axis(found.exact, best, axis=1).ravel(),
        })
        yield frame[np.isfinite(frame["distance"])]

    id_type = df.schema[key].dataType.simpleString()
    found = _block_grid(rows, rows, blocks, blocks, kernel, f"id {id_type}, other {id_type}, distance double")
    return top_n_per_group(found, ["id"], [F.col("distance").asc(), F.col("other").asc()], k)

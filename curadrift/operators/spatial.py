"""Point queries: nearest, within a radius, within a box."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from curadrift.operators.blocks import block_count, no_rows
from curadrift.operators.entities import top_n_per_group
from curadrift.session import checkpointed, small_side


def _sq(axes: list[str], at: list[Column]) -> Column:
    out = F.lit(0.0)
    for axis, value in zip(axes, at):
        out = out + (F.col(axis) - value) * (F.col(axis) - value)
    return out


def knn(points: DataFrame, axes: list[str], at: list[float], k: int) -> DataFrame:
    """k nearest points to one query point, ascending; ties to the smaller id."""
    near = points.withColumn("distance", F.sqrt(_sq(axes, [F.lit(float(a)) for a in at])))
    return near.orderBy("distance", "id").limit(k)


class Cells:
    """Cells of a k-d tree over a bounded sample: a row goes left where its value on the node's axis is below the node's cut."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.axis, self.cut, self.below, self.above, self.leaf = [], [], [], [], []
        self.low, self.high = [], []
        dims = sample.shape[1]
        self._grow(sample, leaves, np.full(dims, -np.inf), np.full(dims, np.inf))
        self.axis, self.cut, self.below, self.above, self.leaf = map(np.array, (self.axis, self.cut, self.below, self.above, self.leaf))
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _grow(self, rows: np.ndarray, leaves: int, low: np.ndarray, high: np.ndarray) -> int:
        at = len(self.axis)
        for column, blank in ((self.axis, -1), (self.cut, 0.0), (self.below, at), (self.above, at), (self.leaf, -1)):
            column.append(blank)
        spans = np.ptp(rows, axis=0) if len(rows) > 1 else np.zeros(len(low))
        axis = int(spans.argmax())
        cut = float(np.median(rows[:, axis])) if spans[axis] > 0 else 0.0
        left = rows[:, axis] < cut if spans[axis] > 0 else np.zeros(len(rows), dtype=bool)
        if leaves < 2 or not left.any():
            self.leaf[at] = len(self.low)
            self.low.append(low)
            self.high.append(high)
            return at
        ends, begins = high.copy(), low.copy()
        ends[axis] = begins[axis] = cut
        self.axis[at], self.cut[at] = axis, cut
        self.below[at] = self._grow(rows[left], leaves // 2, low, ends)
        self.above[at] = self._grow(rows[~left], leaves - leaves // 2, begins, high)
        return at

    def of(self, rows: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        at = np.zeros(len(rows), dtype=np.int64)
        while True:
            inner = self.axis[at] >= 0
            if not inner.any():
                return self.leaf[at]
            left = rows[np.arange(len(rows)), np.maximum(self.axis[at], 0)] < self.cut[at]
            at = np.where(inner, np.where(left, self.below[at], self.above[at]), at)

    def touched(self, row: np.ndarray, reach: float) -> np.ndarray:
        """Cells with a point that may lie within ``reach`` of a row."""
        gap = np.maximum(np.maximum(self.low - row, row - self.high), 0.0)
        return np.flatnonzero((gap * gap).sum(axis=1) <= reach * reach * (1 + 1e-9) + 1e-18)


# A cell holds about so many points; the tree grows on so many sampled ones and has so many cells at most.
CELL_POINTS, TREE_SAMPLE, MOST_CELLS = 4096, 1 << 14, 1 << 13


def _in_cell(width: int, k: int):
    """The k nearest points of a cell for its queries, block by block."""
    def run(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return no_rows("query_id", "id", "distance")
        p = p.sort_values("id", ignore_index=True)
        b, found = np.stack(p["v"].to_numpy()), []
        for begin in range(0, len(q), width):
            part = q.iloc[begin:begin + width]
            a = np.stack(part["v"].to_numpy())
            d = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(-1))
            order = np.argsort(d, axis=1, kind="stable")[:, :k]
            found.append(pd.DataFrame({
                "query_id": np.repeat(part["id"].to_numpy(), order.shape[1]), "id": p["id"].to_numpy()[order].ravel(),
                "distance": np.take_along_axis(d, order, axis=1).ravel()}))
        return pd.concat(found, ignore_index=True)

    return run


def knn_join(points: DataFrame, axes: list[str], queries: DataFrame, k: int, cell_points: int = CELL_POINTS) -> DataFrame:
    """(query_id, id, distance): k nearest points per query, ties to the smaller id; exact, in two rounds.

    Points lie in the cells of a k-d tree that is grown on a bounded sample. A query first meets its own cell; its k-th distance
    there then tells which other cells may hold a nearer point, and it meets only those. A crowded cell (equal points, say) is
    dealt into blocks. NULL coordinates have no part.
    """
    def rows(df: DataFrame, key: str) -> DataFrame:
        return df.select(F.col(key).alias("id"), F.array(*[F.col(a).cast("double") for a in axes]).alias("v")).filter(
            ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))

    held, asked = rows(points, "id"), rows(queries, "query_id")
    sample = held.orderBy(F.xxhash64("id"), "id").limit(TREE_SAMPLE).select("v").toPandas()
    if not len(sample):
        return queries.sparkSession.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {points.schema['id'].dataType.simpleString()}, distance double")
    cells = Cells(np.stack(sample["v"].to_numpy()), min(MOST_CELLS, block_count(held.count(), cell_points)))

    def placed(df: DataFrame) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    yield frame.assign(cell=cells.of(np.stack(frame["v"].to_numpy())))

        return checkpointed(df.mapInPandas(run, f"id {df.schema['id'].dataType.simpleString()}, v array<double>, cell long"))

    held, asked = placed(held), placed(asked)
    crowded = small_side(held.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / cell_points).cast("int").alias("blocks")).filter("blocks > 1"))
    dealt = held.join(crowded, "cell", "left").withColumn("block", F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1)).cast("long"))).drop("blocks")
    q_type, p_type = asked.schema["id"].dataType.simpleString(), held.schema["id"].dataType.simpleString()

    def met(wanted: DataFrame) -> DataFrame:
        everywhere = wanted.join(crowded, "cell", "left").withColumn(
            "block", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)).cast("long") - 1))).select("id", "v", "cell", "block")
        found = everywhere.groupBy("cell", "block").cogroup(dealt.select(*[F.col(c).alias(c) for c in dealt.columns]).groupBy("cell", "block")).applyInPandas(
            _in_cell(256, k), f"query_id {q_type}, id {p_type}, distance double")
        return top_n_per_group(found, ["query_id"], [F.col("distance").asc(), F.col("id").asc()], k)

    first = checkpointed(met(asked))
    reach = first.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("reach"))

    def beyond(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for begin in range(0, len(frame), 256):
                part = frame.iloc[begin:begin + 256]
                there = [np.setdiff1d(cells.touched(np.asarray(v), np.inf if pd.isna(r) else r), [c]) for v, r, c in zip(part["v"], part["reach"], part["cell"], strict=True)]
                sizes = [len(t) for t in there]
                if sum(sizes):
                    yield pd.DataFrame({"id": np.repeat(part["id"].to_numpy(), sizes), "v": np.repeat(part["v"].to_numpy(), sizes), "cell": np.concatenate(there)})

    more = asked.join(reach, "id", "left").select("id", "v", "cell", "reach").mapInPandas(beyond, f"id {q_type}, v array<double>, cell long")
    return top_n_per_group(first.unionByName(met(more)), ["query_id"], [F.col("distance").asc(), F.col("id").asc()], k)


def box_query(points: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Closed axis-aligned box; the bounds reach the file scan as filters."""
    for axis, (low, high) in bounds.items():
        points = points.filter(F.col(axis).between(low, high))
    return points


def radius_query(points: DataFrame, axes: list[str], at: list[float], radius: float) -> DataFrame:
    """Points with distance <= radius: box first, then the distance."""
    boxed = box_query(points, {axis: (a - radius, a + radius) for axis, a in zip(axes, at)})
    d2 = _sq(axes, [F.lit(float(a)) for a in at])
    return boxed.filter(d2 <= radius * radius).withColumn("distance", F.sqrt(d2))


def radius_join_cells(points: DataFrame, axes: list[str], queries: DataFrame, radius: float, cell_rows: int = CELL_POINTS) -> DataFrame:
    """(query_id, id, distance) within the radius of each query point: equal grid cells of that size meet, each query standing in
    its own and the adjacent cells. Both sides of a crowded cell are dealt into blocks, and every two blocks meet once."""
    width = radius if radius > 0 else 1.0  # any width not below the radius will do
    cell = [F.floor(F.col(a) / width) for a in axes]
    p = points.select("id", *axes, F.array(*cell).alias("cell"))
    offsets = [F.array(*[c + o for c, o in zip(cell, combo)]) for combo in itertools.product((-1, 0, 1), repeat=len(axes))]
    q = queries.select("query_id", *[F.col(a).alias(f"q_{a}") for a in axes], F.explode(F.array(*offsets)).alias("cell"))

    def crowded(df: DataFrame, name: str) -> DataFrame:
        return small_side(df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / cell_rows).alias(name)).filter(F.col(name) > 1))

    many_p, many_q = crowded(p, "p_blocks"), crowded(q, "q_blocks")

    def dealt(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        both = df.join(many_p, "cell", "left").join(many_q, "cell", "left").fillna(1, ["p_blocks", "q_blocks"])
        return both.withColumn(own[0], F.pmod(F.xxhash64(key), F.col(own))).withColumn(
            other[0], F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).drop("p_blocks", "q_blocks")

    met = dealt(p, "id", "p_blocks", "q_blocks").join(dealt(q, "query_id", "q_blocks", "p_blocks"), ["cell", "p", "q"])
    d2 = _sq(axes, [F.col(f"q_{a}") for a in axes])
    return met.filter(d2 <= radius * radius).select("query_id", "id", F.sqrt(d2).alias("distance"))

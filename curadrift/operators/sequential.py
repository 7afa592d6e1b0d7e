"""Detectors that read one value after another, run in parallel over parts of the order.

Page-Hinkley up to the first alarm and DDM are running sums and minima. With resets (Page-Hinkley,
ADWIN) the state entering a part depends on the part before it: every part is first run from a fresh
state, then only the parts whose entry state turned out different are run again, until none changes.
The state of one stream part enters the next exactly as if one reader had seen all values.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from curadrift.operators.blocks import no_rows
from curadrift.operators.ordered import PART, ranged, running
from curadrift.session import checkpointed

# Detector parameters.
PH_DELTA, PH_THRESHOLD = 0.005, 50.0
DDM_MIN_ROWS, DDM_DRIFT = 30, 3.0
ADWIN_DELTA, ADWIN_MIN_ROWS, ADWIN_MIN_SIDE = 0.002, 10, 5

# Rows a part holds in one worker, at most about.
ROWS_PER_PART = 1 << 20

# (values, entry state) -> (alarms as (position, statistic, score, window), exit state)
Scan = Callable[[np.ndarray, np.ndarray], tuple[list[tuple[int, float, float, int]], list[float]]]


def page_hinkley_first(df: DataFrame, key: str, order: list[str], value: str, delta: float = PH_DELTA, threshold: float = PH_THRESHOLD) -> DataFrame:
    """Per key the position and statistic of the first alarm (no row without an alarm)."""
    parts = ranged(df.select(key, *order, F.col(value).alias("x")), [key], order)
    summed = running(parts, [key], order, sums={"n": F.lit(1).cast("bigint"), "m": F.col("x") - delta})
    with_low = running(summed, [key], order, mins={"low": F.col("m")})
    gap = F.col("m") - F.col("low")
    return with_low.filter(gap > threshold).groupBy(key).agg(
        F.min("n").alias("position"), F.min_by(gap, F.col("n")).alias("statistic")
    )


def ddm(df: DataFrame, key: str, order: list[str], error: str, min_rows: int = DDM_MIN_ROWS, level: float = DDM_DRIFT) -> DataFrame:
    """Rows in drift: key, position, p, s, the best p and s so far, score."""
    parts = ranged(df.select(key, *order, F.col(error).cast("double").alias("x")), [key], order)
    counted = running(parts, [key], order, sums={"n": F.lit(1).cast("bigint"), "errors": F.col("x")})
    p = F.col("errors") / F.col("n")
    rates = counted.withColumn("p", p).withColumn("s", F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n")))
    state = F.struct((F.col("p") + F.col("s")).alias("ps"), F.col("n"), F.col("p"), F.col("s"))
    best = running(rates, [key], order, mins={"best": F.when(F.col("n") >= min_rows, state)})
    limit = F.col("best.p") + level * F.col("best.s")
    return best.filter((F.col("n") >= min_rows) & (F.col("p") + F.col("s") > limit)).select(
        key, F.col("n").alias("position"), "p", "s", F.col("best.p").alias("p_min"), F.col("best.s").alias("s_min"),
        F.try_divide(F.col("p") + F.col("s"), limit).alias("score"),
    )


def page_hinkley_scan(delta: float = PH_DELTA, threshold: float = PH_THRESHOLD) -> Scan:
    """State: whether nothing was read since the start or an alarm, and the sum's height above its minimum.

    The height returns to 0 whenever a new minimum is reached, so runs from different states soon agree; rows are counted
    outside (``counts_rows``), as their number would keep the states apart for ever.
    """
    def scan(values, entry):
        fresh, height = (bool(entry[0]), entry[1]) if len(entry) else (True, 0.0)
        alarms = []
        for i, x in enumerate(values):
            height = 0.0 if fresh else max(0.0, height + x - delta)
            fresh = False
            if height > threshold:
                alarms.append((i, height, height / threshold, i + 1))
                fresh, height = True, 0.0
        return alarms, [float(fresh), height]

    scan.counts_rows = True
    return scan


# Cuts so close to the newest value are tested one by one; blocks of cuts hold 2**LEAST_LEVEL at least.
NEAR_CUTS, LEAST_LEVEL, MOST_AT_ONCE = 64, 5, 1024


class CutBounds:
    """Sums of a series in blocks of 2, 4, 8 ... values, with a bound that tells where no cut is possible.

    With the sum ``s`` of the first values, a cut at ``m`` of the window from ``a`` to ``e`` needs ``|D(m)| >= sqrt(2 ln(2/delta) r c / n)``,
    where ``D(m)`` is how far ``s`` leaves the straight line from ``a`` to ``e`` at ``m``, and c, r, n are the rows left, right and in all.
    Inside a block ``D`` stays within the larger ``D`` of its ends plus the block's own largest distance from the line between them.
    """

    def __init__(self, values: np.ndarray, delta: float):
        self.sums = np.r_[0.0, np.cumsum(values)]
        self.weight = 2 * np.log(2 / delta)
        self.bulge: list[np.ndarray] = []
        for level in range(LEAST_LEVEL, max(LEAST_LEVEL, len(values).bit_length()) + 1):
            size, count = 1 << level, len(values) >> level
            path = np.lib.stride_tricks.as_strided(self.sums, (count, size + 1), (size * 8, 8))
            line = path[:, :1] + (path[:, -1:] - path[:, :1]) * (np.arange(size + 1) / size)
            self.bulge.append(np.abs(path - line).max(axis=1) if count else np.zeros(0))

    def _blocks(self, low: int, high: int, newest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begins, ends and bulges of blocks that cover the cuts from ``low`` to ``high``, the larger the farther from ``newest``."""
        begins, ends, bulges = [], [], []
        at = min(-(-high >> LEAST_LEVEL) << LEAST_LEVEL, (len(self.sums) - 1) >> LEAST_LEVEL << LEAST_LEVEL)
        while at > low:
            level = LEAST_LEVEL
            while level + 1 - LEAST_LEVEL < len(self.bulge) and (2 << level) * 8 <= newest - at and at % (2 << level) == 0:
                level += 1
            begins.append(at - (1 << level))
            ends.append(at)
            bulges.append(self.bulge[level - LEAST_LEVEL][begins[-1] >> level])
            at -= 1 << level
        return np.array(begins, dtype=np.int64), np.array(ends, dtype=np.int64), np.array(bulges)

    def possible(self, start: int, first: int, last: int) -> np.ndarray:
        """The window ends from ``first`` to ``last`` (exclusive) at which a cut is not ruled out."""
        ends = np.arange(first, last)
        n = ends - start
        mean = (self.sums[ends] - self.sums[start]) / n
        least = start + np.maximum(n // 2, ADWIN_MIN_SIDE)

        def away(m: np.ndarray) -> np.ndarray:
            return np.abs(self.sums[m] - self.sums[start] - (m - start) * mean[:, None])

        # a little slack, for sums that were rounded in another order
        m = np.maximum(ends[:, None] - np.arange(ADWIN_MIN_SIDE, NEAR_CUTS), start)
        need = np.sqrt(self.weight * (ends[:, None] - m) * (m - start) / n[:, None]) * (1 - 1e-7) - 1e-9
        out = ((away(m) >= need) & (m >= least[:, None])).any(axis=1)
        # the last values may fill no block: cuts among them are left open where they are not near ones
        low, high = int(least.min()), last - NEAR_CUTS
        if high < low:
            return out
        a, b, bulge = self._blocks(low, high, first)
        if len(b) and b[0] < high:
            a, b, bulge = np.r_[b[0], a], np.r_[min(len(self.sums) - 1, b[0] + (1 << LEAST_LEVEL)), b], np.r_[np.inf, bulge]
        elif not len(b):
            return np.ones(len(ends), dtype=bool)
        most = np.maximum(away(np.maximum(a, start)[None, :]), away(b[None, :])) + bulge
        c = np.maximum(np.maximum(a, start) - start, (least - start)[:, None])
        r = np.maximum(ends[:, None] - b, ADWIN_MIN_SIDE)
        need = np.sqrt(self.weight * r * c / n[:, None]) * (1 - 1e-7) - 1e-9
        open_ = (most >= need) & (b > least[:, None]) & (a <= ends[:, None] - NEAR_CUTS)
        return out | open_.any(axis=1)


def adwin_scan(delta: float = ADWIN_DELTA) -> Scan:
    """State: the values of the current window. A cut is looked for in its newer half, and only where block bounds do not rule it
    out; the first cut of a window that passes the test is taken, as if every cut had been tested for every value."""
    def scan(values, entry):
        series = np.r_[np.asarray(entry, dtype=float), np.asarray(values, dtype=float)]
        bounds, offset = CutBounds(series, delta), len(entry)
        start, at, step, alarms = 0, offset + 1, 32, []
        while at <= len(series):
            at = max(at, start + ADWIN_MIN_ROWS)
            stop = min(at + step, len(series) + 1)
            if at >= stop:
                break
            step = min(2 * step, MOST_AT_ONCE)
            for end in (at + np.flatnonzero(bounds.possible(start, at, stop))).tolist():
                n = end - start
                cuts = np.arange(max(n // 2, ADWIN_MIN_SIDE), min(n - 2, n - ADWIN_MIN_SIDE) + 1)
                sums = np.cumsum(series[start:end])
                left = sums[cuts - 1] / cuts
                right = (sums[-1] - sums[cuts - 1]) / (n - cuts)
                limit = np.sqrt(2 * (1 / cuts + 1 / (n - cuts)) * np.log(2 / delta))
                hit = np.flatnonzero(np.abs(left - right) >= limit)
                if len(hit):
                    first = hit[0]
                    gap = abs(left[first] - right[first])
                    start += int(cuts[first])
                    alarms.append((end - 1 - offset, float(gap), float(gap / limit[first]), end - start))
                    stop, step = end + 1, 32
                    break
            at = stop
        return alarms, series[start:].tolist()

    return scan


def sequential_alarms(df: DataFrame, key: str, order: list[str], value: str, scan: Scan) -> DataFrame:
    """Every alarm of a resetting detector: key, order columns, statistic, score, window_size."""
    return scan_ordered(df, key, order, value, scan)[0]


def scan_ordered(
    df: DataFrame, key: str, order: list[str], value: str, scan: Scan, before: DataFrame | None = None,
    rows_per_part: int = ROWS_PER_PART,
) -> tuple[DataFrame, DataFrame]:
    """(alarms, states): ``before`` gives (key, state) from rows read earlier, ``states`` the ones after.

    For a scan that ``counts_rows`` the last number of a state is the rows read so far, and the windows of its alarms, which
    count from the start of a part, are moved on by the rows before it.
    """
    counting = getattr(scan, "counts_rows", False)
    rows = ranged(df.select(key, *order, F.col(value).cast("double").alias("x")), [key], order, rows_per_part)
    key_type = rows.schema[key].dataType.simpleString()
    order_types = ", ".join(f"{o} {rows.schema[o].dataType.simpleString()}" for o in order)
    parts = rows.groupBy(key, PART).agg(F.count(F.lit(1)).alias("rows_here"))
    by_order = Window.partitionBy(key).orderBy(PART)
    blank = F.array().cast("array<double>")
    parts = parts.withColumn("before", blank) if before is None else parts.join(
        before.select(key, F.col("state").alias("before")), key, "left"
    ).withColumn("before", F.coalesce("before", blank))
    if counting:
        read = F.coalesce(F.element_at(F.nullif(F.col("before"), blank), F.lit(-1)), F.lit(0.0))
        ahead = by_order.rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("base", read + F.coalesce(F.sum("rows_here").over(ahead), F.lit(0))).withColumn(
            "before", F.slice("before", F.lit(1), F.greatest(F.size("before") - 1, F.lit(0))))
        bases = checkpointed(parts.select(key, PART, "base", "rows_here"))
    first = F.row_number().over(by_order) == 1
    entries = checkpointed(parts.withColumn("entry", F.when(first, F.col("before")).otherwise(blank)))
    todo, exits = entries, None

    def sorted_values(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.sort_values(order, ignore_index=True)

    def run(values: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if not len(values) or not len(state):
            return no_rows(key, PART, "exit")
        _, after = scan(sorted_values(values)["x"].to_numpy(), np.asarray(state["entry"].iloc[0], dtype=float))
        return pd.DataFrame({key: [values[key].iloc[0]], PART: [values[PART].iloc[0]], "exit": [list(map(float, after))]})

    def report(values: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        names = [key, PART, *order, "statistic", "score", "window_size"]
        if not len(values) or not len(state):
            return no_rows(*names)
        values = sorted_values(values)
        alarms, _ = scan(values["x"].to_numpy(), np.asarray(state["entry"].iloc[0], dtype=float))
        at = [a[0] for a in alarms]
        if not alarms:
            return no_rows(*names)
        out = values.iloc[at][[key, PART, *order]].reset_index(drop=True)
        return out.assign(statistic=[a[1] for a in alarms], score=[a[2] for a in alarms], window_size=[a[3] for a in alarms])

    def states_for(df: DataFrame):
        # fresh column identities: the states stem from the rows they are grouped with
        return df.select(F.col(key).alias(key), F.col(PART).alias(PART), F.col("entry").alias("entry")).groupBy(key, PART)

    while True:
        # only parts with a new entry state are read again
        again = rows if exits is None else rows.join(todo.select(key, PART), [key, PART], "left_semi")
        fresh = again.groupBy(key, PART).cogroup(states_for(todo)).applyInPandas(
            run, f"{key} {key_type}, {PART} int, exit array<double>"
        )
        fresh = checkpointed(fresh)
        exits = fresh if exits is None else checkpointed(exits.join(fresh, [key, PART], "left_anti").unionByName(fresh))
        # one row per key and part
        chained = entries.join(exits, [key, PART]).withColumn("next", F.coalesce(F.lag("exit").over(by_order), F.col("before")))
        compared = checkpointed(chained.select(key, PART, "before", "entry", "next"))
        todo = compared.filter(F.col("entry") != F.col("next")).select(key, PART, F.col("next").alias("entry"))
        if todo.isEmpty():
            break
        entries = compared.select(key, PART, "before", F.col("next").alias("entry"))
    if counting:
        exits = exits.join(bases, [key, PART]).withColumn("exit", F.array_append("exit", F.col("base") + F.col("rows_here")))
    states = exits.groupBy(key).agg(F.max_by("exit", PART).alias("state"))
    alarms = rows.groupBy(key, PART).cogroup(states_for(entries)).applyInPandas(
        report, f"{key} {key_type}, {PART} int, {order_types}, statistic double, score double, window_size int"
    )
    if counting:
        alarms = alarms.join(bases.select(key, PART, "base"), [key, PART]).withColumn(
            "window_size", (F.col("window_size") + F.col("base")).cast("int")).drop("base")
    return alarms.drop(PART), states

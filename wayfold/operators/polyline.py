"""Ordered folds over polylines that built-in functions can't express, one line or group at a time."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINTS = "array<struct<x:double,y:double>>"


def _array(points) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in points], dtype=float).reshape(-1, 2)


def _points(a: np.ndarray) -> list[dict[str, float]]:
    return [{"x": float(x), "y": float(y)} for x, y in a]


def simplify_line(p: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker with distances to the segment between the ends; both ends stay. An explicit stack bounds the depth."""
    n = len(p)
    if n <= 2:
        return p
    keep = np.zeros(n, dtype=bool)
    keep[[0, -1]] = True
    stack = [(0, n - 1)]
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        a, d = p[i], p[j] - p[i]
        q = p[i + 1 : j] - a
        size = float(d @ d)
        t = np.clip(q @ d / size, 0, 1) if size else np.zeros(len(q))
        off = np.hypot(*(q - t[:, None] * d).T)
        k = int(np.argmax(off))
        if off[k] > tolerance:
            keep[i + 1 + k] = True
            stack += [(i, i + 1 + k), (i + 1 + k, j)]
    return p[keep]


def simplify(points: Column | str, tolerance: float) -> Column:
    @F.pandas_udf(POINTS)
    def run(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: None if x is None else _points(simplify_line(_array(x), tolerance)))

    return run(points)


def chain_lines(lines: list[np.ndarray], gap: float = 0.5) -> np.ndarray | None:
    """Lines joined end to end in order, whatever way each runs; None where one doesn't fit.

    A line goes on at the tail if either of its ends is there, else at the head."""
    pieces = deque(lines[:1])
    for line in lines[1:]:
        at = np.array([pieces[-1][-1], pieces[0][0]])[:, None, :] - line[[0, -1]][None, :, :]
        tail, head = np.hypot(at[..., 0], at[..., 1]) < gap  # each for the line's first and last point
        if tail.any():
            pieces.append((line if tail[0] else line[::-1])[1:])
        elif head.any():
            pieces.appendleft((line if head[1] else line[::-1])[:-1])
        else:
            return None
    return np.vstack(pieces) if pieces else None


def rings_of(lines: list[np.ndarray]) -> list[np.ndarray]:
    """Closed rings of four points or more from unordered lines whose ends are equal.

    An index from end points to the lines that have them there is walked from the
    first line not yet used; of several lines at a point the first is taken."""
    at: dict[tuple, list[int]] = {}
    for i, line in enumerate(lines):
        for end in (0, -1):
            at.setdefault(tuple(line[end]), []).append(i)
    free = dict.fromkeys(range(len(lines)))
    out = []
    while free:
        walk = [lines[next(iter(free))]]
        del free[next(iter(free))]
        start, here = tuple(walk[0][0]), tuple(walk[0][-1])
        while here != start:
            nxt = next((i for i in at[here] if i in free), None)
            if nxt is None:
                break
            del free[nxt]
            line = lines[nxt] if tuple(lines[nxt][0]) == here else lines[nxt][::-1]
            walk.append(line[1:])
            here = tuple(line[-1])
        ring = np.vstack(walk)
        if here == start and len(ring) >= 4:
            out.append(ring)
    return out


def joined_items(items: list[np.ndarray], gap: float = 1e-6) -> list[np.ndarray]:
    """Drawing items in order as polylines: an item that begins where the last ended goes on with it."""
    out: list[np.ndarray] = []
    for item in items:
        if out and np.hypot(*(out[-1][-1] - item[0])) < gap:
            out[-1] = np.vstack([out[-1], item[1:]])
        else:
            out.append(item)
    return out


def _fold(df: DataFrame, key: str, fold) -> DataFrame:
    """fold(lines in order) gives lines; df has key, ord and points. A key's lines are those of one feature."""
    kind = df.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(parts)).sort_values("ord", kind="stable")
        out = fold([_array(x) for x in pdf["points"]])
        yield pd.DataFrame({key: [pdf[key].iloc[0]] * len(out), "n": range(len(out)), "points": [_points(x) for x in out]})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        return next(run(iter([pdf])))

    return df.select(key, "ord", "points").groupBy(key).applyInPandas(whole, f"{key} {kind}, n int, points {POINTS}")


def chain(df: DataFrame, key: str) -> DataFrame:
    """(key, n, points): one line a key; none where its lines don't chain."""
    return _fold(df, key, lambda lines: [x for x in [chain_lines(lines)] if x is not None])


def assemble_rings(df: DataFrame, key: str) -> DataFrame:
    return _fold(df, key, rings_of)


def join_items(df: DataFrame, key: str) -> DataFrame:
    return _fold(df, key, joined_items)


def stair_steps(shafts: DataFrame, steps: int = 14, run_max: float = 9.0, wide_max: float = 4.5) -> DataFrame:
    """(id, step, x0, y0, x1, y1, h): a flight along the long axis of each shaft (id, cx, cy, x0, y0, x1, y1, rise), clamped about its centre."""
    along = (F.col("x1") - F.col("x0")) >= (F.col("y1") - F.col("y0"))
    cap_x, cap_y = F.when(along, run_max / 2).otherwise(wide_max / 2), F.when(along, wide_max / 2).otherwise(run_max / 2)
    c = shafts.withColumns({
        "x0": F.greatest("x0", F.col("cx") - cap_x), "x1": F.least("x1", F.col("cx") + cap_x),
        "y0": F.greatest("y0", F.col("cy") - cap_y), "y1": F.least("y1", F.col("cy") + cap_y), "along": along,
    }).where("x1 > x0 AND y1 > y0").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    at = lambda lo, hi, k: F.col(lo) + (F.col(hi) - F.col(lo)) * (F.col("step") + k) / steps
    return c.select(
        "id", "step",
        F.when(F.col("along"), at("x0", "x1", 0)).otherwise(F.col("x0")).alias("x0"), F.when(F.col("along"), F.col("y0")).otherwise(at("y0", "y1", 0)).alias("y0"),
        F.when(F.col("along"), at("x0", "x1", 1)).otherwise(F.col("x1")).alias("x1"), F.when(F.col("along"), F.col("y1")).otherwise(at("y0", "y1", 1)).alias("y1"),
        F.greatest(F.lit(0.15), F.col("rise") * (F.col("step") + 1) / steps).alias("h"),
    )

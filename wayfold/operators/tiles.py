"""Raster operators over tiles: a floor is rows (key, r, c) of set cells, cut into square tiles, and never one mask.

A tile sees a margin of its neighbours, as wide as the operator reaches; what it says
of its own cells is then exact. What reaches further than a margin goes over seams:
tiles label their own parts, cells beside each other on two sides of a seam join
parts, and connected components of parts give the labels of the floor. Distances
take two passes, along columns and along rows. Results equal those of the whole-mask
kernels in raster for every tile size; everything outside the given cells is unset.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph, raster

SIZE = 256
#: Rounds of thinning that a margin of twice as many cells allows at once.
THIN = 8
_AHEAD = {False: ((0, 1), (1, 0)), True: ((0, 1), (1, -1), (1, 0), (1, 1))}


def _tile(x: Column | str, size: int) -> Column:
    return F.floor(F.col(x) / size) if isinstance(x, str) else F.floor(x / size)


def tiled(cells: DataFrame, key: str, size: int, halo: int = 0) -> DataFrame:
    """(key, tr, tc, r, c): each cell in its own tile and in those whose margin it lies in."""
    spread = lambda x: F.explode(F.sequence(_tile(F.col(x) - halo, size), _tile(F.col(x) + halo, size)))
    rows = cells.select(key, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"))
    return rows.withColumn("tr", spread("r")).withColumn("tc", spread("c"))


def _window(pdf: pd.DataFrame, size: int, halo: int) -> tuple[np.ndarray, int, int]:
    """A tile with its margin as a mask, and the place of its first cell."""
    r0, c0 = int(pdf["tr"].iloc[0]) * size - halo, int(pdf["tc"].iloc[0]) * size - halo
    m = np.zeros((size + 2 * halo, size + 2 * halo), dtype=bool)
    m[pdf["r"].to_numpy() - r0, pdf["c"].to_numpy() - c0] = True
    return m, r0, c0


def _rows(key: str, value: object, **columns: np.ndarray) -> pd.DataFrame:
    n = len(next(iter(columns.values())))
    return pd.DataFrame({key: pd.Series([value] * n, dtype=object), **columns})


def per_tile(cells: DataFrame, key: str, size: int, halo: int, make: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The cells that make(mask) sets in each tile, given the tile with its margin."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m, r0, c0 = _window(pdf, size, halo)
        r, c = np.nonzero(make(m)[halo : halo + size, halo : halo + size])
        return _rows(key, pdf[key].iloc[0], r=r + r0 + halo, c=c + c0 + halo)

    kind = cells.schema[key].dataType.simpleString()
    return tiled(cells, key, size, halo).groupBy(key, "tr", "tc").applyInPandas(run, f"{key} {kind}, r long, c long")


def dilate(cells: DataFrame, key: str, radius: int, size: int = SIZE) -> DataFrame:
    return per_tile(cells, key, size, radius, lambda m: raster.dilate(m, radius))


def closing(cells: DataFrame, key: str, radius: int, size: int = SIZE) -> DataFrame:
    return per_tile(cells, key, size, 2 * radius, lambda m: raster.erode(raster.dilate(m, radius), radius))


def edge(cells: DataFrame, key: str, size: int = SIZE) -> DataFrame:
    return per_tile(cells, key, size, 1, raster.edge)


def combine(a: DataFrame, b: DataFrame, key: str, how: str) -> DataFrame:
    """Cells of two masks: 'and', 'or', or 'not' (of a, not of b)."""
    a, b = a.select(key, "r", "c"), b.select(key, "r", "c")
    return a.unionByName(b).distinct() if how == "or" else a.join(b, [key, "r", "c"], "left_semi" if how == "and" else "left_anti")


def _parts(m: np.ndarray, eight: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Set cells and, for each, the first cell of its part in reading order."""
    labels, _ = raster.label(m, raster.EIGHT if eight else raster.FOUR)
    r, c = np.nonzero(m)
    own = labels[r, c]
    _, first = np.unique(own, return_index=True)  # cells are in reading order
    return r, c, r[first][own - 1], c[first][own - 1]


def _over_seams(borders: DataFrame, key: str, size: int, eight: bool) -> DataFrame:
    """(key, r0, c0, root): parts that cells beside each other on a seam join, with the least part (r, c) of each component.

    borders: cells (key, r, c, r0, c0) along tile sides, with their part."""
    steps = F.explode(F.array(*(F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in _AHEAD[eight])))
    part = F.struct(key, "r0", "c0")
    here = borders.withColumn("s", steps).select(key, (F.col("r") + F.col("s.dr")).alias("r"), (F.col("c") + F.col("s.dc")).alias("c"), part.alias("a"), F.col("r").alias("_r"), F.col("c").alias("_c"))
    here = here.where((_tile("r", size) != _tile("_r", size)) | (_tile("c", size) != _tile("_c", size)))
    pairs = here.join(borders.select(key, "r", "c", part.alias("b")), [key, "r", "c"]).select("a", "b").distinct()
    arcs = graph.kept(graph.both_ways(pairs))
    roots = graph.components(arcs.select(F.col("a").alias("id")).distinct(), arcs)
    return roots.select(f"id.{key}", "id.r0", "id.c0", F.struct(F.col("label.r0").alias("r"), F.col("label.c0").alias("c")).alias("root"))


def _on_side(size: int) -> Column:
    return F.pmod("r", F.lit(size)).isin(0, size - 1) | F.pmod("c", F.lit(size)).isin(0, size - 1)


def _rooted(cells: DataFrame, key: str, size: int, eight: bool) -> DataFrame:
    """(key, r, c, root): each cell with the first cell, in reading order, of its component."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m, r0, c0 = _window(pdf, size, 0)
        r, c, pr, pc = _parts(m, eight)
        return _rows(key, pdf[key].iloc[0], r=r + r0, c=c + c0, r0=pr + r0, c0=pc + c0)

    kind = cells.schema[key].dataType.simpleString()
    own = graph.kept(tiled(cells, key, size).groupBy(key, "tr", "tc").applyInPandas(run, f"{key} {kind}, r long, c long, r0 long, c0 long"))
    roots = _over_seams(own.where(_on_side(size)), key, size, eight)
    whole = own.join(roots, [key, "r0", "c0"], "left")
    return whole.select(key, "r", "c", F.coalesce("root", F.struct(F.col("r0").alias("r"), F.col("c0").alias("c"))).alias("root"))


def label(cells: DataFrame, key: str, eight: bool = False, size: int = SIZE) -> DataFrame:
    """(key, r, c, label): components numbered from 1 in reading order."""
    found = graph.kept(_rooted(cells, key, size, eight))
    number = found.select(key, "root").distinct().withColumn("label", F.row_number().over(Window.partitionBy(key).orderBy("root")).cast("long"))
    return found.join(number, [key, "root"]).select(key, "r", "c", "label")


def keep_large(cells: DataFrame, key: str, fraction: float, eight: bool = False, size: int = SIZE) -> DataFrame:
    """Cells of components with at least a fraction of the cells of their floor's largest."""
    labels = label(cells, key, eight, size)
    return graph.keep_fraction(labels, fraction, (key,)).select(key, "r", "c")


def fill_holes(cells: DataFrame, key: str, size: int = SIZE) -> DataFrame:
    """Adds the unset cells that can't be reached from beyond the floor's frame."""
    kind = cells.schema[key].dataType.simpleString()
    frame = cells.groupBy(key).agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    frame = graph.kept(frame.select(key, *(F.col(x).cast("long").alias(x) for x in ("r0", "r1", "c0", "c1"))))
    every = frame.withColumn("tr", F.explode(F.sequence(_tile("r0", size), _tile("r1", size)))).withColumn("tc", F.explode(F.sequence(_tile("c0", size), _tile("c1", size))))
    own = graph.kept(tiled(cells, key, size))
    by = [key, "tr", "tc"]

    def unset(tile: pd.DataFrame, box: pd.DataFrame) -> tuple[np.ndarray, int, int, tuple[int, int, int, int]]:
        """Unset cells of a tile within its frame, in place of the tile's mask."""
        b = box.iloc[0]
        top, left = int(b["tr"]) * size, int(b["tc"]) * size
        m = np.zeros((size, size), dtype=bool)
        m[max(0, b["r0"] - top) : b["r1"] + 1 - top, max(0, b["c0"] - left) : b["c1"] + 1 - left] = True
        if len(tile):
            m[tile["r"].to_numpy() - top, tile["c"].to_numpy() - left] = False
        return m, top, left, (b["r0"], b["r1"], b["c0"], b["c1"])

    def sides(tile: pd.DataFrame, box: pd.DataFrame) -> pd.DataFrame:
        """Cells along the tile's sides with their part and whether it touches the frame; parts that touch neither give one row, their first cell."""
        m, top, left, (r0, r1, c0, c1) = unset(tile, box)
        r, c, pr, pc = _parts(m)
        out = _rows(key, box[key].iloc[0], r=r + top, c=c + left, r0=pr + top, c0=pc + left)
        at_frame = (out["r"] == r0) | (out["r"] == r1) | (out["c"] == c0) | (out["c"] == c1)
        out["outside"] = at_frame.groupby([out["r0"], out["c0"]]).transform("any") if len(out) else at_frame
        keep = np.isin(r, (0, size - 1)) | np.isin(c, (0, size - 1)) | ((r == pr) & (c == pc))
        return out[keep]

    parts = graph.kept(own.groupBy(*by).cogroup(every.groupBy(*by)).applyInPandas(sides, f"{key} {kind}, r long, c long, r0 long, c0 long, outside boolean"))
    roots = _over_seams(parts.where(_on_side(size)), key, size, False)
    whole = parts.select(key, "r0", "c0", "outside").distinct().join(roots, [key, "r0", "c0"], "left").withColumn("root", F.coalesce("root", F.struct(F.col("r0").alias("r"), F.col("c0").alias("c"))))
    shut = whole.groupBy(key, "root").agg(F.bool_or("outside").alias("out")).where("NOT out").select(key, "root")
    holes = whole.join(shut, [key, "root"]).select(key, "r0", "c0", _tile("r0", size).alias("tr"), _tile("c0", size).alias("tc"))

    def filled(tile: pd.DataFrame, box: pd.DataFrame) -> pd.DataFrame:
        if box.empty:
            return _rows(key, None, r=np.zeros(0, dtype=np.int64), c=np.zeros(0, dtype=np.int64))
        m, top, left, _ = unset(tile, box)
        r, c, pr, pc = _parts(m)
        wanted = set(zip(box["hr"], box["hc"], strict=True))
        inside = np.array([(y + top, x + left) in wanted for y, x in zip(pr, pc, strict=True)], dtype=bool)
        return _rows(key, box[key].iloc[0], r=r[inside] + top, c=c[inside] + left)

    boxes = holes.withColumnsRenamed({"r0": "hr", "c0": "hc"}).join(frame, key)
    more = own.groupBy(*by).cogroup(boxes.groupBy(*by)).applyInPandas(filled, f"{key} {kind}, r long, c long")
    return own.select(key, "r", "c").unionByName(more)


def filled_mass(cells: DataFrame, key: str, radius: int, fraction: float = 0.06, size: int = SIZE) -> DataFrame:
    """Closing, filling and keeping of large components."""
    return keep_large(fill_holes(graph.kept(closing(cells, key, radius, size)), key, size), key, fraction, size=size)


def _along(rows: DataFrame, key: str, line: str, at: str) -> DataFrame:
    """Adds run: the first place of the stretch without a gap that a cell is in, along its line."""
    w = Window.partitionBy(key, line).orderBy(at)
    island = rows.withColumn("_i", F.col(at) - F.row_number().over(w))
    return island.withColumn("run", F.min(at).over(Window.partitionBy(key, line, "_i")))


def _row_distance(c: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Squared distances in one stretch of a row, from the cells' distances along their columns; unset cells stand at both ends."""
    n = len(c)
    g2 = np.concatenate([[0], g.astype(np.int64) ** 2, [0]])
    best, step = g2[1:-1].copy(), 1
    while step <= n and step * step < best.max():
        left, right = g2[: n + 2 - step] + step * step, g2[step:] + step * step
        best[step - 1 :] = np.minimum(best[step - 1 :], left[: n + 1 - step])
        best[: n + 1 - step] = np.minimum(best[: n + 1 - step], right[1 : n + 2 - step] if step < n + 1 else right[:0])
        step += 1
    return best


def distance(cells: DataFrame, key: str) -> DataFrame:
    """(key, r, c, d): Euclidean distance to the nearest unset cell, first along columns, then along rows."""
    rows = cells.select(key, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"))
    down = _along(rows, key, "c", "r")
    end = F.max("r").over(Window.partitionBy(key, "c", "run"))
    g = F.least(F.col("r") - F.col("run"), end - F.col("r")) + 1
    stretch = _along(down.select(key, "r", "c", g.alias("g")), key, "r", "c")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("c")
        cuts = np.flatnonzero(np.diff(pdf["run"].to_numpy())) + 1
        d2 = [_row_distance(c, g) for c, g in zip(np.split(pdf["c"].to_numpy(), cuts), np.split(pdf["g"].to_numpy(), cuts), strict=True)]
        return _rows(key, pdf[key].iloc[0], r=pdf["r"].to_numpy(), c=pdf["c"].to_numpy(), d=np.sqrt(np.concatenate(d2)))

    kind = cells.schema[key].dataType.simpleString()
    return stretch.groupBy(key, "r").applyInPandas(run, f"{key} {kind}, r long, c long, d double")


def skeleton(cells: DataFrame, key: str, size: int = SIZE, rounds: int = THIN) -> DataFrame:
    """Zhang-Suen thinning: each pass over the tiles does some rounds of it, until one changes nothing."""
    left = graph.kept(cells.select(key, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")).distinct())
    n = left.count()
    while True:
        left = graph.kept(per_tile(left, key, size, 2 * rounds, lambda m: raster.thin(m, rounds)))
        after = left.count()
        if after == n:
            return left
        n = after


def _loops(start: tuple[int, int, int], ahead: dict[tuple[int, int, int], int]) -> list[list[tuple[int, int]]]:
    """The corners of a border walked from one side to the next; where it touches itself, the loop since then is cut off as a ring of its own."""
    out, path, at = [], [], {}
    x, y, d = start
    while True:
        if (x, y) in at:
            first = at[x, y]
            loop = path[first:]
            for p in loop:
                del at[p]
            del path[first:]
            out.append(loop)
            if not path and (x, y, d) == start:
                return out
        at[x, y] = len(path)
        path.append((x, y))
        turn = ahead[x, y, d]
        x, y, d = x + (1, 0, -1, 0)[d], y + (0, 1, 0, -1)[d], turn


def _corners(loop: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Without the points between two sides of one direction."""
    n = len(loop)
    return [p for i, p in enumerate(loop) if not (loop[i - 1][0] == p[0] == loop[(i + 1) % n][0] or loop[i - 1][1] == p[1] == loop[(i + 1) % n][1])]


def outlines(cells: DataFrame, key: str, size: int = SIZE) -> DataFrame:
    """(key, label, hole, area, pts): the rings about each component, outer ones and holes, as corners (x, y) of cells.

    Sides of cells with nothing beyond them are rows; each is followed by the one that
    begins where it ends, at a corner where two parts touch by the one of the same
    cell. Connected sides are a ring, and its cells' component says which outer ring a
    hole belongs to. Rings that touch themselves are split, so all are valid; the
    areas of a component's rings, holes subtracted, add up to its cells."""
    labels = graph.kept(label(cells, key, size=size))
    beyond = ((-1, 0, 0, 0, 0), (0, 1, 1, 0, 1), (1, 0, 1, 1, 2), (0, -1, 0, 1, 3))  # neighbour, where the side begins, its direction: right, down, left, up
    side = F.explode(F.array(*(F.struct((F.col("r") + dr).alias("nr"), (F.col("c") + dc).alias("nc"), (F.col("c") + dx).alias("x"), (F.col("r") + dy).alias("y"), F.lit(d).alias("d")) for dr, dc, dx, dy, d in beyond)))
    taken = labels.select(key, F.col("r").alias("nr"), F.col("c").alias("nc"))
    sides = labels.select(key, "label", side.alias("s")).select(key, "label", "s.*").join(taken, [key, "nr", "nc"], "left_anti").select(key, "label", "x", "y", "d")
    sides = graph.kept(sides)
    step = lambda *by: F.element_at(F.array(*(F.lit(v) for v in by)), F.col("d") + 1)
    ends = sides.withColumns({"ex": F.col("x") + step(1, 0, -1, 0), "ey": F.col("y") + step(0, 1, 0, -1)})
    after = sides.select(key, F.col("x").alias("ex"), F.col("y").alias("ey"), F.col("d").alias("turn"))
    order = F.pmod(F.col("turn") - F.col("d") - 1, F.lit(4))  # about the same cell first
    linked = graph.kept(ends.join(after, [key, "ex", "ey"]).groupBy(key, "label", "x", "y", "d", "ex", "ey").agg(F.min_by("turn", order).alias("turn")))
    name = lambda x, y, d: F.struct(F.col(key).alias("k"), F.col(x).alias("x"), F.col(y).alias("y"), F.col(d).alias("d"))
    arcs = graph.both_ways(linked.select(name("x", "y", "d").alias("a"), name("ex", "ey", "turn").alias("b")))
    rings = linked.withColumn("id", name("x", "y", "d")).join(graph.components(linked.select(name("x", "y", "d").alias("id")), arcs).withColumnRenamed("label", "ring"), "id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ahead = {(x, y, d): t for x, y, d, t in zip(*(pdf[c].tolist() for c in ("x", "y", "d", "turn")), strict=True)}
        rows = []
        for loop in _loops(min(ahead), ahead):
            area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(loop, loop[1:] + loop[:1], strict=True)) / 2
            rows.append((pdf[key].iloc[0], int(pdf["label"].iloc[0]), area < 0, abs(area), [{"x": float(x), "y": float(y)} for x, y in _corners(loop)]))
        columns = zip(*rows, strict=True)
        return pd.DataFrame({n: pd.Series(list(v), dtype=object) for n, v in zip((key, "label", "hole", "area", "pts"), columns, strict=True)})

    kind = cells.schema[key].dataType.simpleString()
    return rings.select(key, "label", "x", "y", "d", "turn", "ring").groupBy(key, "ring").applyInPandas(run, f"{key} {kind}, label long, hole boolean, area double, pts array<struct<x:double,y:double>>")

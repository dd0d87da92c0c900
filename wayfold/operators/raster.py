"""Raster kernels in NumPy and the grouped operators built on them.

Masks are boolean arrays (rows by y, columns by x). Grouped operators get one
group's cells or lines as an Arrow table; groups are floors or buildings, so a
group is small whatever the number of groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

FOUR = ((0, 1), (1, 0), (0, -1), (-1, 0))
EIGHT = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))


def shift(m: np.ndarray, dr: int, dc: int) -> np.ndarray:
    """m moved by (dr, dc); what comes in is empty."""
    out = np.zeros_like(m)
    r0, r1, c0, c1 = max(0, dr), m.shape[0] + min(0, dr), max(0, dc), m.shape[1] + min(0, dc)
    if r1 > r0 and c1 > c0:
        out[r0:r1, c0:c1] = m[r0 - dr : r1 - dr, c0 - dc : c1 - dc]
    return out


def disk(radius: int) -> list[tuple[int, int]]:
    return [(r, c) for r in range(-radius, radius + 1) for c in range(-radius, radius + 1) if r * r + c * c <= radius * radius]


def dilate(m: np.ndarray, radius: int) -> np.ndarray:
    return np.logical_or.reduce([shift(m, r, c) for r, c in disk(radius)])


def erode(m: np.ndarray, radius: int) -> np.ndarray:
    """Cells whose whole disk is set; beyond the border counts as set."""
    return ~dilate(~m, radius)


def closing(m: np.ndarray, radius: int) -> np.ndarray:
    padded = np.pad(m, radius)
    return erode(dilate(padded, radius), radius)[radius : radius + m.shape[0], radius : radius + m.shape[1]]


def opening(m: np.ndarray, radius: int) -> np.ndarray:
    return dilate(erode(m, radius), radius) & m


def edge(m: np.ndarray) -> np.ndarray:
    """Set cells beside an unset one or the border."""
    return m & ~np.logical_and.reduce([shift(m, r, c) for r, c in FOUR])


def label(m: np.ndarray, neighbours: tuple[tuple[int, int], ...] = FOUR) -> tuple[np.ndarray, int]:
    """Connected components numbered from 1 in reading order, 0 outside."""
    ids = np.where(m, np.arange(1, m.size + 1).reshape(m.shape), 0)
    big = m.size + 1
    while True:
        low = np.where(m, ids, big)
        for r, c in neighbours:
            near = shift(ids, r, c)
            low = np.minimum(low, np.where((near > 0) & m, near, big))
        low = np.where(m, low, 0)
        # jump to the label of the label
        flat = low.ravel()
        while True:
            far = np.where(flat > 0, flat[np.maximum(flat - 1, 0)], 0)
            if (far == flat).all():
                break
            flat = far
        low = flat.reshape(m.shape)
        if (low == ids).all():
            break
        ids = low
    roots = np.unique(ids[ids > 0])
    return np.where(m, np.searchsorted(roots, ids) + 1, 0), len(roots)


def fill_holes(m: np.ndarray) -> np.ndarray:
    """Sets what can't be reached from beyond the border."""
    out = np.pad(~m, 1, constant_values=True)
    labels, _ = label(out)
    return (labels != labels[0, 0])[1:-1, 1:-1]


def keep_large(m: np.ndarray, fraction: float, neighbours: tuple[tuple[int, int], ...] = FOUR) -> np.ndarray:
    """Components with at least a fraction of the largest one's cells."""
    labels, n = label(m, neighbours)
    if not n:
        return m.copy()
    sizes = np.bincount(labels.ravel())
    sizes[0] = 0
    return (sizes >= fraction * sizes.max())[labels] & m


def filled_mass(m: np.ndarray, close: int, fraction: float = 0.06) -> np.ndarray:
    return keep_large(fill_holes(closing(m, close)), fraction)


def distance(m: np.ndarray) -> np.ndarray:
    """Euclidean distance of set cells to the nearest unset one; infinite where none is unset."""
    big = 1e12
    g = np.where(m, big, 0.0)
    for axis in (0, 1):
        n = g.shape[axis]
        lines = g if axis else g.T
        out = np.empty_like(lines)
        i = np.arange(n)
        for k, f in enumerate(lines):
            # lower envelope of parabolas
            v, z, top = np.zeros(n, dtype=np.int64), np.empty(n + 1), 0
            z[0], z[1] = -np.inf, np.inf
            for q in range(1, n):
                s = ((f[q] + q * q) - (f[v[top]] + v[top] * v[top])) / (2.0 * (q - v[top]))
                while s <= z[top]:
                    top -= 1
                    s = ((f[q] + q * q) - (f[v[top]] + v[top] * v[top])) / (2.0 * (q - v[top]))
                top += 1
                v[top], z[top], z[top + 1] = q, s, np.inf
            at = v[np.searchsorted(z[1 : top + 1], i, side="left")]
            out[k] = (i - at) ** 2 + f[at]
        g = out if axis else out.T
    return np.where(g >= big / 2, np.inf, np.sqrt(np.minimum(g, big)))


def skeleton(m: np.ndarray) -> np.ndarray:
    """Zhang-Suen thinning."""
    return thin(m, m.size)


def thin(m: np.ndarray, rounds: int) -> np.ndarray:
    """Some rounds of it, or as many as change anything."""
    m = np.pad(m, 1)
    for _ in range(rounds):
        changed = False
        for step in (0, 1):
            p = [shift(m, -r, -c) for r, c in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]
            count = sum(x.astype(np.int8) for x in p)
            turns = sum((~p[i] & p[(i + 1) % 8]).astype(np.int8) for i in range(8))
            if step == 0:
                free = ~(p[0] & p[2] & p[4]) & ~(p[2] & p[4] & p[6])
            else:
                free = ~(p[0] & p[2] & p[6]) & ~(p[0] & p[4] & p[6])
            gone = m & (count >= 2) & (count <= 6) & (turns == 1) & free
            if gone.any():
                m = m & ~gone
                changed = True
        if not changed:
            break
    return m[1:-1, 1:-1]


def draw(shape: tuple[int, int], lines: list[np.ndarray], origin: tuple[float, float] = (0.0, 0.0), res: float = 1.0) -> np.ndarray:
    """Polylines as cells, by Bresenham's rule."""
    out = np.zeros(shape, dtype=bool)
    for line in lines:
        px = ((np.asarray(line, dtype=float) - origin) / res).astype(int)
        for (x0, y0), (x1, y1) in zip(px, px[1:], strict=False):
            dx, dy = abs(x1 - x0), -abs(y1 - y0)
            sx, sy, err = (1 if x0 < x1 else -1), (1 if y0 < y1 else -1), dx + dy
            while True:
                if 0 <= y0 < shape[0] and 0 <= x0 < shape[1]:
                    out[y0, x0] = True
                if x0 == x1 and y0 == y1:
                    break
                e = 2 * err
                if e >= dy:
                    err += dy
                    x0 += sx
                if e <= dx:
                    err += dx
                    y0 += sy
    return out


def polygon_mask(shape: tuple[int, int], rings: list[np.ndarray], origin: tuple[float, float] = (0.0, 0.0), res: float = 1.0) -> np.ndarray:
    """Cells whose centre is in any ring (even-odd)."""
    ys, xs = np.mgrid[0 : shape[0], 0 : shape[1]]
    px, py = origin[0] + (xs + 0.5) * res, origin[1] + (ys + 0.5) * res
    out = np.zeros(shape, dtype=bool)
    for ring in rings:
        inside = np.zeros(shape, dtype=bool)
        ring = np.asarray(ring, dtype=float)
        for (ax, ay), (bx, by) in zip(ring, np.roll(ring, -1, axis=0), strict=True):
            if ay == by:
                continue
            cross = (ay > py) != (by > py)
            inside ^= cross & (px < (bx - ax) * (py - ay) / (by - ay) + ax)
        out |= inside
    return out


def correlate(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, float]:
    """(quarter turns, dr, dc, score): the turn and shift of b that overlaps a most; score over the geometric mean of sizes."""
    best = (0, 0, 0, -1.0)
    norm = np.sqrt(float(a.sum()) * float(b.sum())) or 1.0
    for turn in range(4):
        t = np.rot90(b, turn)
        shape = (a.shape[0] + t.shape[0], a.shape[1] + t.shape[1])
        c = np.fft.irfft2(np.fft.rfft2(a.astype(float), shape) * np.conj(np.fft.rfft2(t.astype(float), shape)), shape)
        r, k = np.unravel_index(int(np.argmax(np.round(c, 6))), shape)
        score = float(c[r, k]) / norm
        if score > best[3] + 1e-9:
            best = (turn, int(r - shape[0] * (r >= a.shape[0])), int(k - shape[1] * (k >= a.shape[1])), score)
    return best


def outline(m: np.ndarray) -> list[tuple[int, int]]:
    """The outer border of the component with most cells, as corners (x, y) of cells, turning left; empty for an empty mask."""
    labels, n = label(m)
    if not n:
        return []
    m = np.pad(labels == np.argmax(np.bincount(labels.ravel())[1:]) + 1, 1)
    r, c = map(int, np.argwhere(m)[0])
    start, at, step, out = (r, c), (r, c), (0, 1), []
    filled = lambda p, s: m[_beside(p, s)]
    while True:
        if not out or out[-1][1] != step:
            out.append((at, step))
        at = (at[0] + step[0], at[1] + step[1])
        left, right = (-step[1], step[0]), (step[1], -step[0])
        for turn in (left, step, right):
            if filled(at, turn) and not m[_other(at, turn)]:
                step = turn
                break
        if at == start and step == (0, 1):
            return [(p[1] - 1, p[0] - 1) for p, _ in out]


def _beside(corner: tuple[int, int], step: tuple[int, int]) -> tuple[int, int]:
    """The cell to the right of a walk along a cell border (y grows downwards)."""
    r, c = corner
    return {(0, 1): (r, c), (1, 0): (r, c - 1), (0, -1): (r - 1, c - 1), (-1, 0): (r - 1, c)}[step]


def _other(corner: tuple[int, int], step: tuple[int, int]) -> tuple[int, int]:
    r, c = corner
    return {(0, 1): (r - 1, c), (1, 0): (r, c), (0, -1): (r, c - 1), (-1, 0): (r - 1, c - 1)}[step]


def trace(skel: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int, list[tuple[int, int]]]]]:
    """Nodes (r, c) and chains (a, b, cells) of a skeleton.

    Cells without exactly two neighbours are nodes; nodes that touch form one, at
    its first cell. A loop without a node is cut at its first cell."""
    cells = {(int(r), int(c)) for r, c in np.argwhere(skel)}
    near = {p: [q for d in EIGHT if (q := (p[0] + d[0], p[1] + d[1])) in cells] for p in cells}
    ends = {p for p in cells if len(near[p]) != 2}
    cluster: dict[tuple[int, int], int] = {}
    nodes: list[tuple[int, int]] = []
    for p in sorted(ends):
        if p in cluster:
            continue
        stack = [p]
        cluster[p] = len(nodes)
        while stack:
            x = stack.pop()
            for q in near[x]:
                if q in ends and q not in cluster:
                    cluster[q] = len(nodes)
                    stack.append(q)
        nodes.append(p)
    chains, used = [], set()

    def follow(a: tuple[int, int], first: tuple[int, int]) -> list[tuple[int, int]]:
        path = [a, first]
        while path[-1] not in cluster:
            used.add(path[-1])
            onward = [q for q in near[path[-1]] if q != path[-2] and (q not in used or q in cluster)]
            if not onward:
                break
            path.append(next((q for q in onward if q in cluster), onward[0]))
        return path

    for p in sorted(ends):
        for q in near[p]:
            if q not in cluster and q not in used:
                path = follow(p, q)
                if path[-1] in cluster:
                    chains.append((cluster[p], cluster[path[-1]], path))
    for p in sorted(cells - used - ends):
        if p not in used:
            cluster[p] = len(nodes)
            nodes.append(p)
            path = follow(p, near[p][0])
            chains.append((cluster[p], cluster[p], path))
    return nodes, chains


def to_mask(pdf: pd.DataFrame) -> tuple[np.ndarray, int, int]:
    """Cells (r, c) of a group as a mask with a margin of one, and its origin."""
    r0, c0 = int(pdf["r"].min()) - 1, int(pdf["c"].min()) - 1
    m = np.zeros((int(pdf["r"].max()) - r0 + 2, int(pdf["c"].max()) - c0 + 2), dtype=bool)
    m[pdf["r"].to_numpy(int) - r0, pdf["c"].to_numpy(int) - c0] = True
    return m, r0, c0


def _per_group(cells: DataFrame, key: str, columns: str, make) -> DataFrame:
    """make(mask) gives arrays (r, c, *values) for each group of cells (key, r, c)."""
    names = [x.split()[0] for x in columns.split(", ") if x]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m, r0, c0 = to_mask(pdf)
        r, c, *values = make(m)
        return pd.DataFrame({key: pdf[key].iloc[0], "r": r + r0, "c": c + c0, **dict(zip(names, values, strict=True))})

    kind = cells.schema[key].dataType.simpleString()
    return cells.select(key, "r", "c").groupBy(key).applyInPandas(run, f"{key} {kind}, r long, c long" + (f", {columns}" if columns else ""))


def label_cells(cells: DataFrame, key: str, eight: bool = False) -> DataFrame:
    def make(m: np.ndarray):
        labels, _ = label(m, EIGHT if eight else FOUR)
        r, c = np.nonzero(m)
        return r, c, labels[r, c]

    return _per_group(cells, key, "label long", make)


def distance_cells(cells: DataFrame, key: str) -> DataFrame:
    def make(m: np.ndarray):
        d = distance(m)
        r, c = np.nonzero(m)
        return r, c, d[r, c]

    return _per_group(cells, key, "d double", make)


def skeleton_cells(cells: DataFrame, key: str) -> DataFrame:
    return _per_group(cells, key, "", lambda m: np.nonzero(skeleton(m)))


def close_cells(cells: DataFrame, key: str, radius: int, fill: bool = True, fraction: float = 0.0) -> DataFrame:
    def make(m: np.ndarray):
        out = closing(np.pad(m, radius), radius)
        out = fill_holes(out) if fill else out
        out = keep_large(out, fraction) if fraction else out
        r, c = np.nonzero(out)
        return r - radius, c - radius

    return _per_group(cells, key, "", make)

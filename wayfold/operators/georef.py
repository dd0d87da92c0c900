"""Registration of plans: dominant angles, overlap scores, a grid fit with refinement, floor shifts and acceptance."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import rules as R
from ..functions import scalars as S
from . import raster

# Fixed values of the fit.
GRID, SAMPLE, RIVAL_DEGREES = 0.5, 1200, 20.0


def dominant_angle(lines: DataFrame, key: str, points: str = "pts") -> DataFrame:
    """(key, angle): the length-weighted circular mean of segment directions modulo 90 degrees."""
    s = lines.select(key, F.explode(S.segments(points)).alias("s"))
    dx, dy = F.col("s.b.x") - F.col("s.a.x"), F.col("s.b.y") - F.col("s.a.y")
    t, n = F.atan2(dy, dx), F.hypot(dx, dy)
    return s.groupBy(key).agg((F.degrees(F.atan2(F.sum(n * F.sin(4 * t)), F.sum(n * F.cos(4 * t)))) / 4).alias("angle"))


def longest(rows: DataFrame, keys: list[str], order: list[Column | str], fraction: float = 0.25, least: int = 20) -> DataFrame:
    """The first fraction of each group's rows in order, but at least so many."""
    w = Window.partitionBy(*keys)
    return rows.withColumns({"_n": F.row_number().over(w.orderBy(*order)), "_c": F.count("*").over(w)}).where(F.col("_n") <= F.greatest(F.lit(least), F.floor(F.col("_c") * fraction))).drop("_n", "_c")


def iou(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(both_n, any_n, iou) of two sets of cells (cx, cy); 0 where both are empty."""
    on = [*keys, "cx", "cy"]
    x = a.select(*on).distinct().withColumn("ia", F.lit(1))
    y = b.select(*on).distinct().withColumn("ib", F.lit(1))
    j = x.join(y, on, "full")
    g = j.groupBy(*keys) if keys else j.groupBy()
    out = g.agg(F.count(F.when(F.col("ia").isNotNull() & F.col("ib").isNotNull(), 1)).alias("both_n"), F.count("*").alias("any_n"))
    return out.withColumn("iou", F.when(F.col("any_n") == 0, 0.0).otherwise(F.col("both_n") / F.col("any_n")))


def residual(points: DataFrame, boundary: DataFrame, keys: tuple[str, ...] = (), most: int = SAMPLE, cap: float = 8.0) -> DataFrame:
    """(keys, residual): the mean distance of a deterministic sample of points to boundary points, a sampling operator by design.

    Points look into the cells about them; those with nothing within the cap look again with one four times as wide."""
    from .graph import kept
    from .spatial import nearest_capped

    order = (F.xxhash64("x", "y"), "x", "y")
    if keys:
        few = points.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= most).drop("_n")
        few = few.join(boundary.select(*keys).distinct(), list(keys), "left_semi")
    else:
        few = points.orderBy(*order).limit(0 if boundary.isEmpty() else most)
    own = lambda df: df.select(*keys, F.struct("x", "y").alias("id"), "x", "y").distinct()
    left, right, found = kept(own(few)), kept(own(boundary)), None
    while True:
        near = kept(nearest_capped(left, right, cap, keys, strict=False))
        found = near if found is None else found.unionByName(near)
        left = kept(left.join(near.select(*keys, "id"), [*keys, "id"], "left_anti"))
        if left.isEmpty():
            break
        cap *= 4
    return (found.groupBy(*keys) if keys else found.groupBy()).agg(F.avg("d").alias("residual"))


def margin(candidates: DataFrame, key: str) -> DataFrame:
    """(key, best, margin): the best score less that of the best rival, one turned over 20 degrees away or mirrored otherwise; 1 without a rival."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "degrees")
    top = candidates.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(key, F.col("score").alias("best"), F.col("degrees").alias("d0"), F.col("mirror").alias("m0"))
    turn = F.abs(F.pmod(F.col("degrees") - F.col("d0") + 180, F.lit(360.0)) - 180)
    rival = F.max(F.when((turn > RIVAL_DEGREES) | (F.col("mirror") != F.col("m0")), F.col("score")))
    return candidates.join(top, key).groupBy(key, "best").agg(rival.alias("r")).select(key, "best", F.coalesce(F.col("best") - F.col("r"), F.lit(1.0)).alias("margin"))


def _place(p: np.ndarray, v: np.ndarray) -> np.ndarray:
    s, deg, tx, ty = v
    r = np.radians(deg)
    return s * (p @ np.array([[np.cos(r), np.sin(r)], [-np.sin(r), np.cos(r)]])) + (tx, ty)


def _overlap(p: np.ndarray, v: np.ndarray, target: np.ndarray, origin: np.ndarray, area: float) -> float:
    """Intersection over union of plan cells placed by v with a target mask."""
    q = np.floor((_place(p, v) - origin) / GRID).astype(int)
    ok = (q >= 0).all(axis=1) & (q[:, 0] < target.shape[1]) & (q[:, 1] < target.shape[0])
    inside = np.zeros(len(q), dtype=bool)
    inside[ok] = target[q[ok, 1], q[ok, 0]]
    cell = area * v[0] ** 2 / GRID**2
    both = inside.sum() * cell
    union = len(q) * cell + target.sum() - both
    return float(both / union) if union else 0.0


def nelder_mead(f, x: np.ndarray, step: np.ndarray, rounds: int = 900) -> tuple[np.ndarray, float]:
    """Minimises f from x by a simplex with the usual coefficients."""
    pts = np.vstack([x, x + np.diag(step)])
    vals = np.array([f(p) for p in pts])
    for _ in range(rounds):
        order = np.argsort(vals, kind="stable")
        pts, vals = pts[order], vals[order]
        if vals[-1] - vals[0] < 1e-9:
            break
        mid = pts[:-1].mean(axis=0)
        up = mid + (mid - pts[-1])
        fu = f(up)
        if fu < vals[0]:
            far = mid + 2 * (mid - pts[-1])
            ff = f(far)
            pts[-1], vals[-1] = (far, ff) if ff < fu else (up, fu)
        elif fu < vals[-2]:
            pts[-1], vals[-1] = up, fu
        else:
            near = mid + 0.5 * ((up if fu < vals[-1] else pts[-1]) - mid)
            fn = f(near)
            if fn < min(fu, vals[-1]):
                pts[-1], vals[-1] = near, fn
            else:
                pts[1:] = pts[0] + 0.5 * (pts[1:] - pts[0])
                vals[1:] = [f(p) for p in pts[1:]]
    best = int(np.argmin(vals))
    return pts[best], float(vals[best])


def grid_angle(lines: list[np.ndarray]) -> float:
    """The length-weighted circular mean of segment directions modulo 90 degrees."""
    d = np.vstack([np.diff(x, axis=0) for x in lines])
    quad = (np.hypot(*d.T) * np.exp(4j * np.arctan2(d[:, 1], d[:, 0]))).sum()
    return float(np.degrees(np.angle(quad)) / 4)


def _seeds(plan: np.ndarray, cell: float, rings: list[np.ndarray], area: float, plan_angle: float) -> list[list[tuple[float, float]]]:
    """(degrees, scale) to try for each of the four ways that the grids of plan and footprint can lie on each other."""
    every = np.vstack(rings)
    own = grid_angle([np.vstack([r, r[:1]]) for r in rings])
    out = []
    for quarter in range(4):
        turn = own - plan_angle + 90 * quarter
        ratio = np.ptp(every, axis=0) / np.maximum(np.ptp(_place(plan, np.array([1.0, turn, 0, 0])), axis=0), 1e-6)
        bases = {round(float(b), 6) for b in (np.sqrt(area / (len(plan) * cell**2)), *ratio, np.sqrt(ratio.prod()))}
        out.append([(turn + by, base * k) for by in (-2.0, 0.0, 2.0) for base in sorted(bases) for k in (0.9, 1.0, 1.1)])
    return out


def fit_one(plan: np.ndarray, cell: float, rings: list[np.ndarray], plan_angle: float) -> list[dict]:
    """Candidates (scale, degrees, tx, ty, score) of a plan's cells on a footprint, best first: each of the four rotations' best, refined."""
    origin = np.vstack(rings).min(axis=0) - 8
    size = np.ceil((np.vstack(rings).max(axis=0) + 8 - origin) / GRID).astype(int)
    target = raster.polygon_mask((int(size[1]), int(size[0])), rings, tuple(origin), GRID)
    if not target.any() or not len(plan):
        return []
    ys, xs = np.nonzero(target)
    aim = origin + (np.array([xs.mean(), ys.mean()]) + 0.5) * GRID
    score = lambda v: _overlap(plan, v, target, origin, cell**2)

    def put(degrees: float, scale: float) -> np.ndarray:
        return np.array([scale, degrees, *(aim - _place(plan, np.array([scale, degrees, 0, 0])).mean(axis=0))])

    out = []
    for tries in _seeds(plan, cell, rings, target.sum() * GRID**2, plan_angle):
        start = max((put(*t) for t in tries), key=score)
        end, loss = nelder_mead(lambda x: -score(x), start, np.array([0.02 * start[0], 2.0, 1.5, 1.5]))
        v = end if -loss > score(start) else start
        out.append({"scale": float(v[0]), "degrees": float(v[1]), "tx": float(v[2]), "ty": float(v[3]), "score": score(v)})
    return sorted(out, key=lambda x: -x["score"])


def fit(plans: DataFrame, footprints: DataFrame, cell: float, angles: DataFrame) -> DataFrame:
    """(code, scale, degrees, tx, ty, score) of the four candidates of each building.

    plans: code, x, y (cells of the filled plan). footprints: code, rings. angles: code, angle (the plan's dominant one)."""

    schema = "code string, scale double, degrees double, tx double, ty double, score double"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        one = right.to_pylist()[0]
        rings = [np.array([(p["x"], p["y"]) for p in r]) for r in one["rings"]]
        cells = np.column_stack([left.column("x").to_numpy(), left.column("y").to_numpy()]).astype(float)
        return pa.Table.from_pylist([{"code": one["code"], **g} for g in fit_one(cells, cell, rings, one["angle"])], schema=arrow)

    side = footprints.join(angles, "code")
    return plans.groupBy("code").cogroup(side.groupBy("code")).applyInArrow(run, schema)


def accept(fits: DataFrame, residuals: DataFrame) -> DataFrame:
    """(code, best, margin, residual, method) from candidate fits (code, degrees, score) and residuals (code, residual)."""
    m = margin(fits.withColumn("mirror", F.lit(False)) if "mirror" not in fits.columns else fits, "code")
    return m.join(residuals, "code", "left").withColumn("method", R.georef_method("best", "margin", "residual"))


def register(plans: DataFrame, footprints: DataFrame, cell: float, angles: DataFrame, step: float = 0.5) -> DataFrame:
    """(code, scale, degrees, tx, ty, best, margin, residual, method): the best fit of each plan on its footprint and whether it is taken over.

    plans: code, r, c (cells of the filled plan, their centres half a cell in). The
    residual is that of the plan's edge cells, placed, to the footprint's rings, a point every step."""
    from . import graph, tiles

    at = lambda x: ((F.col(x) + 0.5) * cell).alias("y" if x == "r" else "x")
    fits = graph.kept(fit(plans.select("code", at("c"), at("r")), footprints, cell, angles))
    w = Window.partitionBy("code").orderBy(F.desc("score"), "degrees")
    best = graph.kept(fits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "score"))
    edge = tiles.edge(plans, "code").select("code", at("c"), at("r")).join(best, "code")
    placed = S.affine(F.struct("x", "y"), F.col("scale"), F.col("degrees"), F.lit(False), F.col("tx"), F.col("ty"))
    points = edge.select("code", placed.alias("p")).select("code", "p.x", "p.y")
    closed = footprints.select("code", F.explode("rings").alias("ring")).select("code", F.explode(S.segments(F.concat("ring", F.slice("ring", 1, 1)))).alias("s"))
    n = F.greatest(F.lit(1), F.ceil(S.distance(F.col("s.a"), F.col("s.b")) / step).cast("int"))
    along = closed.withColumn("_n", n).withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumn("_t", F.col("_t") / F.col("_n"))
    mix = lambda k: (F.col(f"s.a.{k}") + (F.col(f"s.b.{k}") - F.col(f"s.a.{k}")) * F.col("_t")).alias(k)
    return best.join(accept(fits, residual(points, along.select("code", mix("x"), mix("y")), ("code",))), "code")


def reference_floor(walls: DataFrame, key: str = "code") -> DataFrame:
    """(key, file): the ground floor where its walls reach 70 % of the longest, else the floor with the longest walls."""
    top = Window.partitionBy(key)
    ok = (F.col("level") == 0) & (F.col("length") >= 0.7 * F.max("length").over(top))
    w = Window.partitionBy(key).orderBy(F.desc("_ok"), F.desc("length"), "file")
    return walls.withColumn("_ok", ok.cast("int")).withColumn("_n", F.row_number().over(w)).where("_n = 1").select(key, "file")


def floor_shift(cells: DataFrame, key: str) -> DataFrame:
    """(key, floor, turns, dr, dc, score): each floor's shift onto the floor with most cells, by correlation in four turns.

    A building's floors are few; cells: key, floor, r, c."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["r"].min()), int(pdf["c"].min())
        shape = (int(pdf["r"].max()) - r0 + 1, int(pdf["c"].max()) - c0 + 1)
        masks = {}
        for floor, g in pdf.groupby("floor"):
            m = np.zeros(shape, dtype=bool)
            m[g["r"].to_numpy(int) - r0, g["c"].to_numpy(int) - c0] = True
            masks[floor] = m
        base = max(sorted(masks), key=lambda f: masks[f].sum())
        rows = [(pdf[key].iloc[0], f, *raster.correlate(masks[base], m)) for f, m in sorted(masks.items())]
        return pd.DataFrame(rows, columns=[key, "floor", "turns", "dr", "dc", "score"]).round({"score": 6})

    kind, floor = (cells.schema[x].dataType.simpleString() for x in (key, "floor"))
    return cells.select(key, "floor", "r", "c").groupBy(key).applyInPandas(run, f"{key} {kind}, floor {floor}, turns int, dr int, dc int, score double")


def trusted_shifts(shifts: DataFrame, shares: DataFrame) -> DataFrame:
    """Shifts (code, floor, score, ...) with the share of their wall points in the footprint; untrusted ones are kept but not to be applied."""
    return shifts.join(shares, ["code", "floor"], "left").withColumn("trusted", R.shift_trusted("score", F.coalesce("share", F.lit(0.0))))


def footprint_share(points: DataFrame, footprints: DataFrame, buffer: float = 6.0, every: int = 5) -> DataFrame:
    """(code, floor, share) of every fifth wall point that lies in the footprint grown by buffer, a sampling operator by design."""
    w = Window.partitionBy("code", "floor").orderBy("ord")
    some = points.withColumn("_n", F.row_number().over(w)).where((F.col("_n") - 1) % every == 0)
    return some.join(footprints, "code").groupBy("code", "floor").agg(F.avg(S.within(F.struct("x", "y"), F.col("rings"), buffer).cast("double")).alias("share"))


def others(footprints: DataFrame, points: DataFrame) -> DataFrame:
    """Points (code, x, y) that fall in another building's footprint, by cells of the footprints' bounds."""
    from .spatial import polygons_at_points

    rings = footprints.select(F.col("code").alias("pid"), F.explode("rings").alias("ring"))
    return polygons_at_points(points, rings, 50.0).where("pid <> code").drop("ring").distinct()

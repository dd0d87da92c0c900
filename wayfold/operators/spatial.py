"""Spatial joins over grids: every join here is an equi-join on cells, never a nested loop.

Point tables have columns id, x, y (metres). Ties go to the smaller id or ordinal.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import scalars as S


def cell(x: Column | str, size: float) -> Column:
    return F.floor(S.c(x) / F.lit(float(size))).cast("long")


def spread(df: DataFrame, size: float, x: str = "x", y: str = "y", reach: int = 1) -> DataFrame:
    """Each row in its own cell (cx, cy) and those around it."""
    steps = [F.lit(i).cast("long") for i in range(-reach, reach + 1)]
    return df.withColumn("cx", F.explode(F.transform(F.array(*steps), lambda d: cell(x, size) + d))).withColumn("cy", F.explode(F.transform(F.array(*steps), lambda d: cell(y, size) + d)))


#: Right rows that a cell may hold before it is cut in four, and how often at most.
LEAF, CUTS = 64, 30


def nearest_capped(left: DataFrame, right: DataFrame, cap: float, keys: tuple[str, ...] = (), strict: bool = True) -> DataFrame:
    """(id, near_id, d) of the nearest right row under cap (d < cap, or <= when not strict), within equal keys.

    Cells are as wide as the cap, so a row meets the 3 x 3 cells about it only. Cells
    with more than LEAF right rows are cut in four, round by round; a left row goes
    on into those parts only that may hold its nearest row, so it meets some cells of
    LEAF rows, however dense the right side is. Cell joins are never broadcast: the
    sides are rows times cells, which the planner's sizes don't know."""
    from .graph import kept

    at = [*keys, "cx", "cy"]
    who = [*keys, "id", "x1", "y1"]
    # of right rows at one place the least id decides
    points = right.select(*keys, F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("id").alias("near_id")).groupBy(*keys, "x2", "y2").agg(F.min("near_id").alias("near_id"))
    points = kept(points.where(F.col("x2").isNotNull() & F.col("y2").isNotNull()))
    ask = spread(left.select(*keys, "id", F.col("x").alias("x1"), F.col("y").alias("y1")).distinct(), cap, "x1", "y1").withColumn("bound", F.lit(float(cap)))
    width, out = float(cap), None
    for cut in range(CUTS + 1):
        dealt = points.withColumn("cx", cell("x2", width)).withColumn("cy", cell("y2", width))
        cells = kept(dealt.groupBy(*at).agg(F.count("*").alias("n")))
        whole = cut == CUTS or cells.where(F.col("n") > LEAF).isEmpty()
        if whole and cut == 0:
            met = ask
        else:  # the part of a row's way to a cell that is sure, and the part that is needed at least
            x0, y0 = F.col("cx") * F.lit(width), F.col("cy") * F.lit(width)
            out_of = lambda v, lo: F.greatest(lo - F.col(v), F.col(v) - lo - width, F.lit(0.0))
            far_of = lambda v, lo: F.greatest(F.abs(F.col(v) - lo), F.abs(F.col(v) - lo - width))
            seen = ask.join(cells.hint("merge"), at).withColumn("_least", F.hypot(out_of("x1", x0), out_of("y1", y0)))
            seen = seen.withColumn("bound", F.least("bound", F.min(F.hypot(far_of("x1", x0), far_of("y1", y0))).over(Window.partitionBy(*who))))
            slack = F.lit(1e-9) * (F.abs("x1") + F.abs("y1") + F.abs(x0) + F.abs(y0) + width)
            met = kept(seen.where(F.col("_least") <= F.col("bound") + slack).drop("_least"))
        done = met if whole else met.where(F.col("n") <= LEAF)
        d = F.hypot(F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2"))
        joined = done.drop("n", "bound").join(dealt.hint("merge"), at).withColumn("d", d)
        near = joined.where(F.col("d") < cap if strict else F.col("d") <= cap).groupBy(*keys, "id").agg(F.min(F.struct("d", "near_id")).alias("m"))
        out = near if out is None else out.unionByName(near)
        if whole:
            break
        dense = met.where(F.col("n") > LEAF).drop("n")
        points = kept(dealt.join(cells.where(F.col("n") > LEAF).drop("n").hint("merge"), at, "left_semi").drop("cx", "cy"))
        four = F.explode(F.array(*(F.struct((F.col("cx") * 2 + i).alias("cx"), (F.col("cy") * 2 + j).alias("cy")) for i in (0, 1) for j in (0, 1))))
        ask, width = dense.withColumn("_f", four).withColumns({"cx": F.col("_f.cx"), "cy": F.col("_f.cy")}).drop("_f"), width / 2
    best = out if cut == 0 else out.groupBy(*keys, "id").agg(F.min("m").alias("m"))
    return best.select(*keys, "id", F.col("m.near_id").alias("near_id"), F.col("m.d").alias("d"))


def snap(doors: DataFrame, vertices: DataFrame, nodes: DataFrame, cap: float = 60.0, fallback: float = 40.0) -> DataFrame:
    """Doors to nodes: from the centroid under cap, else from the nearest footprint vertex under fallback.

    doors: id, x, y; vertices: id (of the door), x, y."""
    first = nearest_capped(doors, nodes, cap)
    rest = vertices.join(first, "id", "left_anti").withColumn("ord", F.monotonically_increasing_id())
    by_vertex = nearest_capped(rest.select(F.struct("id", "ord").alias("id"), "x", "y"), nodes, fallback)
    second = by_vertex.groupBy(F.col("id.id").alias("id")).agg(F.min(F.struct("d", "near_id")).alias("m")).select("id", "m.near_id", "m.d")
    return first.withColumn("stage", F.lit("centroid")).unionByName(second.withColumn("stage", F.lit("vertex")))


def knn(queries: DataFrame, points: DataFrame, k: int, vector: str = "v", digits: int = 6, block: int = 5_000) -> DataFrame:
    """(query_id, id, d2, rank): a stated set of queries against all rows, by squared distance.

    Queries go out in blocks of about so many; a task holds k rows a query and
    block, so the shuffle carries k per task and query, never the pairs."""
    spark = queries.sparkSession
    blocks = max(1, -(-queries.count() // block))
    dealt = queries.select(F.col("id").alias("query_id"), F.col(vector).alias("q"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("_block"))
    kind = points.schema["id"].dataType.simpleString()

    def near(n: int) -> DataFrame:
        rows = dealt.where(F.col("_block") == n).collect()  # one block
        if not rows:
            return spark.createDataFrame([], f"query_id {kind}, id {kind}, d2 double")
        sent = spark.sparkContext.broadcast(([r.query_id for r in rows], np.array([r.q for r in rows], dtype=float)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            best = [[] for _ in ids]
            for b in batches:
                if not b.num_rows:
                    continue
                own, v = b.column(0).to_pylist(), np.array(b.column(1).to_pylist(), dtype=float)
                for i, one in enumerate(q):
                    d2 = np.round(((v - one) ** 2).sum(axis=1), digits)
                    few = np.flatnonzero(d2 <= np.partition(d2, min(k, len(d2) - 1))[min(k, len(d2) - 1)])
                    best[i] = sorted([*best[i], *((float(d2[x]), own[x]) for x in few if own[x] != ids[i])])[:k]
            out = [(i, x, d) for i, rows in zip(ids, best, strict=True) for d, x in rows]
            yield pa.RecordBatch.from_pylist([{"query_id": i, "id": x, "d2": d} for i, x, d in out], schema=arrow)

        arrow = to_arrow_schema(StructType.fromDDL(f"query_id {kind}, id {kind}, d2 double"))
        return points.select("id", vector).where(F.col(vector).isNotNull()).mapInArrow(run, f"query_id {kind}, id {kind}, d2 double")

    w = Window.partitionBy("query_id").orderBy("d2", "id")
    return reduce(DataFrame.unionByName, (near(n) for n in range(blocks))).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def polygons_at_points(points: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """Points joined with the polygons (pid, ring) that contain them, by the cells of the polygons' bounds."""
    b = S.bounds("ring")
    boxed = polygons.withColumn("b", b)
    span = lambda lo, hi: F.explode(F.sequence(cell(F.col(lo), size), cell(F.col(hi), size)))
    dealt = boxed.withColumn("cx", span("b.x0", "b.x1")).withColumn("cy", span("b.y0", "b.y1")).drop("b")
    joined = points.withColumn("cx", cell("x", size)).withColumn("cy", cell("y", size)).join(dealt, ["cx", "cy"])
    return joined.where(S.inside(F.struct("x", "y"), F.col("ring"))).drop("cx", "cy")


def _meets(x0: Column, y0: Column, x1: Column, y1: Column):
    """Whether a segment meets the closed cell: their bounds overlap and the corners aren't all strictly on one side of its line."""

    def touches(s: Column) -> Column:
        a, b = s["a"], s["b"]
        corners = [(b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"]) for x in (x0, x1) for y in (y0, y1)]
        apart = (F.least(*corners) > 0) | (F.greatest(*corners) < 0)
        return (F.least(a["x"], b["x"]) <= x1) & (F.greatest(a["x"], b["x"]) >= x0) & (F.least(a["y"], b["y"]) <= y1) & (F.greatest(a["y"], b["y"]) >= y0) & ~apart

    return touches


def cover(polygons: DataFrame, size: float, depth: int = 3) -> DataFrame:
    """(level, cx, cy, full, pid, ring, ...): cells of each polygon, made once for all points that will be asked for.

    Cells that no edge touches are wholly inside (full) or are left out; those that
    one touches are cut in four, depth times, and only what is a border cell then
    needs a test of its points. Cells of a level are size / 2^level wide."""
    from .graph import kept

    span = lambda lo, hi: F.explode(F.sequence(cell(F.col(lo), size), cell(F.col(hi), size)))
    left = polygons.withColumn("_b", S.bounds("ring")).withColumn("cx", span("_b.x0", "_b.x1")).withColumn("cy", span("_b.y0", "_b.y1")).drop("_b")
    out = None
    for level in range(depth + 1):
        w = size / 2**level
        x0, y0 = F.col("cx") * F.lit(w), F.col("cy") * F.lit(w)
        cut = F.exists(S.segments(F.concat("ring", F.slice("ring", 1, 1))), _meets(x0, y0, x0 + w, y0 + w))
        here = kept(left.withColumn("_cut", cut).withColumn("full", ~F.col("_cut") & S.inside(F.struct((x0 + w / 2).alias("x"), (y0 + w / 2).alias("y")), F.col("ring"))))
        done = here.where("full" if level < depth else "full OR _cut").drop("_cut").withColumn("level", F.lit(level))
        out = done if out is None else out.unionByName(done)
        four = F.explode(F.array(*(F.struct((F.col("cx") * 2 + i).alias("cx"), (F.col("cy") * 2 + j).alias("cy")) for i in (0, 1) for j in (0, 1))))
        left = here.where("_cut").withColumn("_f", four).withColumns({"cx": F.col("_f.cx"), "cy": F.col("_f.cy")}).drop("_f", "_cut", "full")
    return out


def polygons_by_cover(points: DataFrame, index: DataFrame, size: float, depth: int = 3) -> DataFrame:
    """The rows of polygons_at_points by a cover of the same size and depth, with tested: whether the point's own test decided."""
    each = points.withColumn("level", F.explode(F.array(*(F.lit(i) for i in range(depth + 1)))))
    width = F.lit(float(size)) / F.pow(F.lit(2.0), F.col("level"))
    at = each.withColumn("cx", F.floor(F.col("x") / width)).withColumn("cy", F.floor(F.col("y") / width))
    joined = at.join(index, ["level", "cx", "cy"])
    return joined.where(F.col("full") | S.inside(F.struct("x", "y"), F.col("ring"))).withColumn("tested", ~F.col("full")).drop("level", "cx", "cy", "full")


def label_rooms(labels: DataFrame, rooms: DataFrame, size: float) -> DataFrame:
    """(pid, text, conf): of the labels (text, conf, ord, x, y) inside a room the surest, the first of equals."""
    found = polygons_at_points(labels, rooms, size)
    best = F.max_by(F.struct("text", "conf"), F.struct("conf", -F.col("ord")))
    return found.groupBy("pid").agg(best.alias("m")).select("pid", "m.text", "m.conf")


def nearest_boundary(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """(id, qx, qy, d): each point's nearest point on the boundary of the polygons with its key pid."""
    seg = polygons.select("pid", F.posexplode(S.segments(F.concat("ring", F.slice("ring", 1, 1)))).alias("ord", "s"))
    q = S.nearest_on_segment(F.struct("x", "y"), F.col("s.a"), F.col("s.b"))
    found = points.join(seg, "pid").withColumn("q", q).withColumn("d", S.distance(F.struct("x", "y"), F.col("q")))
    return found.groupBy("id").agg(F.min_by(F.struct("q", "d"), F.struct("d", "ord")).alias("m")).select("id", F.col("m.q.x").alias("qx"), F.col("m.q.y").alias("qy"), F.col("m.d").alias("d"))


def nearest_pair(outlines: DataFrame) -> DataFrame:
    """(id, p, q, d): the nearest points of outlines a and b of a row, vertices of either against edges of the other."""

    def one(df: DataFrame, vertex: str, edge: str, swap: bool) -> DataFrame:
        v = df.select("id", F.posexplode(vertex).alias("vi", "p"), F.col(edge).alias("ring"))
        s = v.select("id", "vi", "p", F.posexplode(S.segments(F.concat("ring", F.slice("ring", 1, 1)))).alias("si", "s"))
        q = S.nearest_on_segment(F.col("p"), F.col("s.a"), F.col("s.b"))
        out = s.withColumn("q", q).withColumn("d", S.distance(F.col("p"), F.col("q")))
        ends = (F.col("q"), F.col("p")) if swap else (F.col("p"), F.col("q"))
        return out.select("id", ends[0].alias("p"), ends[1].alias("q"), "d", F.lit(int(swap)).alias("side"), "vi", "si")

    both = one(outlines, "a", "b", False).unionByName(one(outlines, "b", "a", True))
    return both.groupBy("id").agg(F.min_by(F.struct("p", "q", "d"), F.struct("d", "side", "vi", "si")).alias("m")).select("id", "m.p", "m.q", "m.d")


def _touched(df: DataFrame, name: str, width: float, pad: Column) -> DataFrame:
    """Each edge (<name>_s) in the cells within pad of it, column by column of its cells."""
    a, b = F.col(f"{name}_s.a"), F.col(f"{name}_s.b")
    low, high = (lambda c: F.least(a[c], b[c])), (lambda c: F.greatest(a[c], b[c]))
    pad = pad + F.lit(1e-9) * (F.abs(a["x"]) + F.abs(a["y"]) + F.abs(b["x"]) + F.abs(b["y"]) + width)  # for rounding
    rows = df.withColumn("_pad", pad).withColumn("cx", F.explode(F.sequence(cell(low("x") - F.col("_pad"), width), cell(high("x") + F.col("_pad"), width))))
    x0 = F.greatest(F.col("cx") * F.lit(width) - F.col("_pad"), low("x"))
    x1 = F.least((F.col("cx") + 1) * F.lit(width) + F.col("_pad"), high("x"))
    slope = (b["y"] - a["y"]) / F.nullif(b["x"] - a["x"], F.lit(0.0))
    at = lambda x: F.least(F.greatest(a["y"] + slope * (x - a["x"]), low("y")), high("y"))
    y0, y1 = F.coalesce(F.least(at(x0), at(x1)), low("y")), F.coalesce(F.greatest(at(x0), at(x1)), high("y"))
    return rows.withColumns({"_y0": F.when(slope.isNull(), low("y")).otherwise(y0), "_y1": F.when(slope.isNull(), high("y")).otherwise(y1)}).withColumn("cy", F.explode(F.sequence(cell(F.col("_y0") - F.col("_pad"), width), cell(F.col("_y1") + F.col("_pad"), width)))).drop("_pad", "_y0", "_y1")


def nearest_outlines(left: DataFrame, right: DataFrame, size: float = 100.0) -> DataFrame:
    """(id, near_id, p, q, d): for each outline of left (id, ring) the nearest one of right and the nearest points, vertices of either against edges of the other.

    Cells are as wide as size at most, narrower the more outlines of left there are on
    the ground that right covers. Vertices in one cell bound an outline's distance;
    then its vertices look for edges, and its edges for vertices, in the cells within
    that bound, so crossing edges that are near no vertex never meet. Outlines with
    nothing in a cell's width look again in cells four times as wide, until none is
    left. Equal distances take the smaller near_id, then left's vertices."""
    from .graph import kept

    def edges(df: DataFrame, name: str) -> DataFrame:
        closed = F.concat("ring", F.slice("ring", 1, 1))
        return df.select(F.col("id").alias(name), F.posexplode(S.segments(closed)).alias(f"{name}_e", f"{name}_s"))

    if right.isEmpty():
        return left.sparkSession.createDataFrame([], f"id {left.schema['id'].dataType.simpleString()}, near_id {right.schema['id'].dataType.simpleString()}, p struct<x:double,y:double>, q struct<x:double,y:double>, d double")
    todo, other, found = kept(edges(left, "l")), kept(edges(right, "r")), None
    vertex_cell = lambda df, name, width: df.withColumn("cx", cell(f"{name}_s.a.x", width)).withColumn("cy", cell(f"{name}_s.a.y", width))
    ground = vertex_cell(other, "r", float(size)).select("cx", "cy").distinct().count() * float(size) ** 2
    width = min(float(size), (ground / max(1, todo.count())) ** 0.5)

    def one(vertex: str, edge: str, side: int) -> Column:
        v = F.col(f"{vertex}_s.a")
        q = S.nearest_on_segment(v, F.col(f"{edge}_s.a"), F.col(f"{edge}_s.b"))
        p_, q_ = (v, q) if side == 0 else (q, v)
        return F.struct(S.distance(v, q).alias("d"), F.col("r").alias("near_id"), F.lit(side).alias("side"), F.col(f"{vertex}_e").alias("ve"), F.col(f"{edge}_e").alias("ee"), p_.alias("p"), q_.alias("q"))

    while True:
        own, dealt = vertex_cell(todo, "l", width), vertex_cell(other, "r", width)
        met = own.select("cx", "cy", "l", F.col("l_s.a").alias("v")).join(dealt.select("cx", "cy", F.col("r_s.a").alias("w")).hint("merge"), ["cx", "cy"])
        bounds = met.groupBy("l").agg((F.min(S.distance("v", "w")) * (1 + 1e-9)).alias("bound"))  # and some rounding
        ask = kept(todo.join(bounds, "l", "left").withColumn("bound", F.least("bound", F.lit(width))))
        pad = F.col("bound") + F.lit(1e-9) * (F.abs("l_s.a.x") + F.abs("l_s.a.y") + width)
        about = lambda c: F.explode(F.sequence(cell(F.col(f"l_s.a.{c}") - pad, width), cell(F.col(f"l_s.a.{c}") + pad, width)))
        by_vertex = ask.withColumn("cx", about("x")).withColumn("cy", about("y")).join(_touched(other, "r", width, F.lit(0.0)).hint("merge"), ["cx", "cy"]).select("l", "bound", one("l", "r", 0).alias("m"))
        by_edge = _touched(ask, "l", width, F.col("bound")).join(dealt.hint("merge"), ["cx", "cy"]).select("l", "bound", one("r", "l", 1).alias("m"))
        near = by_vertex.unionByName(by_edge).where(F.col("m.d") <= F.col("bound")).groupBy(F.col("l").alias("id")).agg(F.min("m").alias("m"))
        near = kept(near.select("id", "m.near_id", "m.p", "m.q", "m.d"))
        found = near if found is None else found.unionByName(near)
        todo = kept(todo.join(near.select(F.col("id").alias("l")), "l", "left_anti"))
        if todo.isEmpty():
            return found
        width *= 4


def enter(paths: DataFrame, depth: float = 12.0, at_start: bool = False) -> DataFrame:
    """Paths (id, path, rings, centroid) made to end, or to start, depth metres inside their building."""
    p = F.get("path", F.lit(0)) if at_start else F.element_at("path", -1)
    edges = F.flatten(F.transform("rings", lambda r: S.segments(F.concat(r, F.slice(r, 1, 1)))))
    best = F.aggregate(
        F.transform(edges, lambda s: S.nearest_on_segment(p, s["a"], s["b"])),
        S.nearest_on_segment(p, F.get(edges, F.lit(0))["a"], F.get(edges, F.lit(0))["b"]),
        lambda best, q: F.when(S.distance(p, q) < S.distance(p, best), q).otherwise(best),
    )
    step = paths.withColumn("_q", best).withColumn("_in", S.add(F.col("_q"), S.scaled(S.unit(S.subtract(F.col("_q"), p)), depth)))
    deep = F.when(S.inside_any(F.col("_in"), "rings"), F.col("_in")).otherwise(S.add(F.col("_q"), S.scaled(S.unit(S.subtract(F.col("centroid"), F.col("_q"))), depth)))
    longer = F.concat(F.array(deep, F.col("_q")), "path") if at_start else F.concat("path", F.array(F.col("_q"), deep))
    return step.withColumn("path", F.when(S.inside_any(p, "rings"), F.col("path")).otherwise(longer)).drop("_q", "_in")


def level_nearest(rows: DataFrame, levels: DataFrame, keys: tuple[str, ...] = (), usable: int = 30) -> DataFrame:
    """Rows (id, z) with the nearest level (level, elev, nodes, ord); levels of few nodes count only where there are no others.

    A building's levels are few: they become one array, so rows are neither multiplied nor grouped again."""
    by = keys or ("_all",)
    if not keys:
        levels, rows = levels.withColumn("_all", F.lit(0)), rows.withColumn("_all", F.lit(0))
    arrays = levels.groupBy(*by).agg(F.collect_list(F.struct("ord", "level", "elev", "nodes")).alias("_levels"))
    large = F.filter("_levels", lambda v: v["nodes"] >= usable)
    found = rows.join(F.broadcast(arrays) if not keys else arrays, list(by)).withColumn("_ok", F.when(F.size(large) > 0, large).otherwise(F.col("_levels")))
    best = F.array_min(F.transform("_ok", lambda v: F.struct(F.abs(v["elev"] - F.col("z")).alias("d"), v["ord"].alias("ord"), v["level"].alias("level"), v["elev"].alias("elev"))))
    return found.withColumn("_m", best).select(*keys, "id", "_m.level", "_m.elev")


def last_before(events: DataFrame, wanted: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """As-of join: each wanted row (key, at, ...) with the latest event's value at or before it.

    One window over the union of both, so no range join is needed."""
    left = wanted.withColumns({"_v": F.lit(None).cast(events.schema[value].dataType), "_w": F.lit(1)})
    right = events.select(key, at, F.col(value).alias("_v"), F.lit(0).alias("_w"))
    w = Window.partitionBy(key).orderBy(at, "_w").rowsBetween(Window.unboundedPreceding, 0)
    return left.unionByName(right, allowMissingColumns=True).withColumn(f"last_{value}", F.last("_v", ignorenulls=True).over(w)).where("_w = 1").drop("_v", "_w")


def portal_audit(portals: DataFrame, levels: DataFrame, nodes: DataFrame, tiers: DataFrame, limit: float = 45.0) -> DataFrame:
    """(code, id, d, severity): portals (code, id, z, x, y) too far from any node of the level nearest to them; a warning on tier C.

    Levels: code, level, elev, nodes, ord. Nodes: code, level, id, x, y."""
    level = level_nearest(portals, levels, ("code",))
    here = portals.join(level, ["code", "id"])
    near = nearest_capped(here.select("code", "level", "id", "x", "y"), nodes, limit, ("code", "level"), strict=False)
    far = here.join(near.select("code", "id", "d"), ["code", "id"], "left").join(tiers, "code", "left")
    return far.where(F.col("d").isNull()).select("code", "id", "d", F.when(F.coalesce("tier", F.lit("C")) == "C", "warn").otherwise("fail").alias("severity"))

"""Floors: walk graphs and rooms from walls, shafts over levels, compact rows, roll-ups and upserts."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import rules as R
from ..functions import scalars as S
from . import polyline, raster

# Metres per cell and limits of walk graphs and shafts.
PX, CLEAR, CORRIDOR, SPUR, ROOM_M2 = 0.10, 0.25, 1.0, 2.0, 3.0
WALL_R, ENVELOPE_R, KEPT, BEYOND = 1, 8, 0.05, 8.0
SHAFT_MIN, SHAFT_MAX, SHAFT_SIDE, SHAFT_SPLIT, SHAFT_GAP = 1.5, 40.0, 9.0, 3, 4


def skeleton_graph(free: np.ndarray, res: float, spur: float) -> tuple[list[dict], list[dict]]:
    """Nodes (i, r, c, clear, kind) and edges (a, b, m, clear, cells) of the middle lines of a free area's largest part."""
    labels, n = raster.label(free)
    if not n:
        return [], []
    main = labels == np.argmax(np.bincount(labels.ravel())[1:]) + 1
    depth = np.minimum(raster.distance(np.pad(main, 1))[1:-1, 1:-1], 1e6) * res
    nodes, chains = raster.trace(raster.skeleton(main))
    length = lambda p: float(np.hypot(*np.diff(np.array(p, dtype=float), axis=0).T).sum()) if len(p) > 1 else 0.0
    while True:
        degree = np.bincount([x for a, b, _ in chains for x in (a, b)], minlength=len(nodes)) if chains else np.zeros(len(nodes), dtype=int)
        left = [(a, b, p) for a, b, p in chains if not ((degree[a] == 1) != (degree[b] == 1) and length(p) * res < spur)]
        if len(left) == len(chains) or not left:
            break
        chains = left
    used = sorted({x for a, b, _ in chains for x in (a, b)}) or list(range(min(1, len(nodes))))
    new = {x: i for i, x in enumerate(used)}
    kind = lambda v: "corridor" if v >= CORRIDOR else "passage"
    out = [{"i": new[x], "r": nodes[x][0], "c": nodes[x][1], "clear": float(depth[nodes[x]]), "kind": kind(depth[nodes[x]])} for x in used]
    edges = [{"a": new[a], "b": new[b], "m": length(p) * res, "clear": float(np.median([depth[q] for q in p])), "cells": p} for a, b, p in chains if length(p) * res >= 0.2]
    return out, edges


def walk_graph_cells(cells: DataFrame, key: str, res: float = PX, spur: float = SPUR) -> DataFrame:
    """(key, a, b, m, clear): edges of the middle lines of each group's cells."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m, _, _ = raster.to_mask(pdf)
        _, edges = skeleton_graph(m, res, spur)
        rows = [(pdf[key].iloc[0], e["a"], e["b"], round(e["m"], 6), round(e["clear"], 6)) for e in edges]
        return pd.DataFrame(rows, columns=[key, "a", "b", "m", "clear"])

    kind = cells.schema[key].dataType.simpleString()
    return cells.select(key, "r", "c").groupBy(key).applyInPandas(run, f"{key} {kind}, a int, b int, m double, clear double")


def _frame(lines: list[np.ndarray], res: float, margin: int = 8) -> tuple[tuple[int, int], np.ndarray]:
    every = np.vstack(lines)
    origin = every.min(axis=0) - margin * res
    size = np.ceil((every.max(axis=0) - origin) / res).astype(int) + margin
    return (int(size[1]), int(size[0])), origin


def floor_masks(walls: list[np.ndarray], doors: list[np.ndarray], rings: list[np.ndarray], drawn: list[np.ndarray] = (), res: float = PX) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(free, rooms, origin): walkable cells with doors open, and closed rooms with doors shut.

    Both lie in the envelope of all that is drawn (walls, doors and the rest), closed
    and filled, within the footprint grown by BEYOND metres."""
    shape, origin = _frame(list(walls), res)
    image = lambda lines: raster.draw(shape, lines, tuple(origin), res) if lines else np.zeros(shape, dtype=bool)
    wall, door = image(list(walls)), image(list(doors))
    mass = raster.fill_holes(raster.closing(wall | door | image(list(drawn)), ENVELOPE_R))
    if rings:
        pad = int(np.ceil(BEYOND / res)) + 1  # a footprint may lie beyond the frame
        print_ = raster.polygon_mask((shape[0] + 2 * pad, shape[1] + 2 * pad), rings, tuple(origin - pad * res), res)
        mass &= (raster.distance(~print_) * res <= BEYOND)[pad:-pad, pad:-pad]
    mass = raster.keep_large(mass, KEPT)
    solid = raster.dilate(wall, WALL_R) & ~raster.dilate(door, WALL_R + 1)
    deep = raster.distance(np.pad(mass & ~solid, 1))[1:-1, 1:-1] * res
    return deep >= CLEAR, mass & ~raster.dilate(wall | door, WALL_R), origin


def rooms_of(inner: np.ndarray, origin: np.ndarray, res: float = PX) -> list[dict]:
    """Closed areas but the largest and those under 3 square metres: id, area, centroid, outline."""
    labels, n = raster.label(inner)
    sizes = np.bincount(labels.ravel(), minlength=n + 1)[1:]
    out = []
    for i in range(n):
        if i == np.argmax(sizes) or sizes[i] * res * res < ROOM_M2:
            continue
        here = labels == i + 1
        ys, xs = np.nonzero(here)
        line = polyline.simplify_line(np.array(raster.outline(here), dtype=float) * res + origin, 0.35)
        out.append({"id": len(out), "area": float(sizes[i] * res * res), "x": float((xs.mean() + 0.5) * res + origin[0]), "y": float((ys.mean() + 0.5) * res + origin[1]), "poly": polyline._points(line), "mask": here})
    return out


def level_graphs(plans: DataFrame, res: float = PX) -> DataFrame:
    """(code, level, status, nodes, edges, rooms) of each floor (code, level, walls, doors, rings, and drawn where there are lines of other kinds).

    A floor that fails keeps a row with the error as its status."""

    def one(walls, doors, rings, drawn):
        walls, doors, rings, drawn = ([polyline._array(x) for x in (v if v is not None else [])] for v in (walls, doors, rings, drawn))
        free, inner, origin = floor_masks(walls, doors, rings, drawn, res)
        nodes, edges = skeleton_graph(free, res, SPUR)
        at = lambda r, c: {"x": float((c + 0.5) * res + origin[0]), "y": float((r + 0.5) * res + origin[1])}
        rooms = []
        for room in rooms_of(inner, origin, res):
            mine = [n["i"] for n in nodes if room["mask"][n["r"], n["c"]]]
            near = mine[:1] or [min(nodes, key=lambda n: np.hypot(at(n["r"], n["c"])["x"] - room["x"], at(n["r"], n["c"])["y"] - room["y"]))["i"]] if nodes else []
            rooms.append({k: room[k] for k in ("id", "area", "x", "y", "poly")} | {"node": near[0] if near else None})
        lines = [polyline.simplify_line(np.array([list(at(r, c).values()) for r, c in e["cells"]]), 0.35) for e in edges]
        return [{"i": n["i"], **at(n["r"], n["c"]), "clear": n["clear"], "kind": n["kind"]} for n in nodes], [{"a": e["a"], "b": e["b"], "m": e["m"], "clear": e["clear"], "path": polyline._points(p)} for e, p in zip(edges, lines, strict=True)], rooms

    P = polyline.POINTS
    schema = f"code string, level double, status string, nodes array<struct<i:int,x:double,y:double,clear:double,kind:string>>, edges array<struct<a:int,b:int,m:double,clear:double,path:{P}>>, rooms array<struct<id:int,area:double,x:double,y:double,poly:{P},node:int>>"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(table: pa.Table) -> pa.Table:
        rows = []
        for p in table.to_pylist():
            row = {"code": p["code"], "level": p["level"], "status": "ok", "nodes": [], "edges": [], "rooms": []}
            try:
                row |= dict(zip(("nodes", "edges", "rooms"), one(p["walls"], p["doors"], p["rings"], p.get("drawn")), strict=True))
            except (ValueError, IndexError) as e:
                row["status"] = f"{type(e).__name__}: {e}"
            rows.append(row)
        return pa.Table.from_pylist(rows, schema=arrow)

    return plans.select("code", "level", "walls", "doors", "rings", *(["drawn"] if "drawn" in plans.columns else [])).groupBy("code", "level").applyInArrow(run, schema)


def shafts_of(mask: np.ndarray, res: float) -> list[np.ndarray]:
    """Masks of shafts: strokes of all levels closed and split where too large; what stays too large or is too small goes."""
    out = []
    joined = raster.fill_holes(raster.closing(np.pad(mask, SHAFT_GAP), SHAFT_GAP))[SHAFT_GAP:-SHAFT_GAP, SHAFT_GAP:-SHAFT_GAP]

    def big(m: np.ndarray) -> bool:
        ys, xs = np.nonzero(m)
        return m.sum() * res * res > SHAFT_MAX or max(np.ptp(ys), np.ptp(xs)) * res > SHAFT_SIDE

    labels, n = raster.label(joined)
    for i in range(1, n + 1):
        part = labels == i
        pieces = [part]
        if big(part):
            split, k = raster.label(raster.opening(part, SHAFT_SPLIT))
            pieces = [split == j for j in range(1, k + 1)]
        out += [p for p in pieces if not big(p) and p.sum() * res * res >= SHAFT_MIN]
    return out


def shafts(strokes: DataFrame, res: float = PX) -> DataFrame:
    """(code, kind, id, area, x, y, levels): shafts of each building from strokes (code, kind, level, r, c); a level belongs where 0.6 square metres of its strokes lie within."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m, r0, c0 = raster.to_mask(pdf)
        rows = []
        for i, s in enumerate(shafts_of(m, res)):
            ys, xs = np.nonzero(s)
            here = s[pdf["r"].to_numpy(int) - r0, pdf["c"].to_numpy(int) - c0]
            levels = pdf[here].groupby("level").size()
            rows.append((pdf["code"].iloc[0], pdf["kind"].iloc[0], i, float(s.sum() * res * res), float((xs.mean() + c0) * res), float((ys.mean() + r0) * res), sorted(float(v) for v, k in levels.items() if k * res * res >= 0.6)))
        return pd.DataFrame(rows, columns=["code", "kind", "id", "area", "x", "y", "levels"])

    return strokes.groupBy("code", "kind").applyInPandas(run, "code string, kind string, id int, area double, x double, y double, levels array<double>")


def vertical_edges(stops: DataFrame) -> DataFrame:
    """Edges between neighbouring levels of a shaft (code, kind, shaft, level, node, elev, diagonal); a shaft of one level gives none."""
    w = Window.partitionBy("code", "kind", "shaft").orderBy("level")
    nxt = stops.withColumns({"b_level": F.lead("level").over(w), "b_node": F.lead("node").over(w), "rise": F.lead("elev").over(w) - F.col("elev")})
    return nxt.where("b_level IS NOT NULL").select("code", "kind", "shaft", F.col("level").alias("a_level"), F.col("node").alias("a_node"), "b_level", "b_node", "rise", R.vertical_metres("kind", "diagonal", "rise").alias("m"))


def single_level_shafts(stops: DataFrame) -> DataFrame:
    return stops.groupBy("code", "kind", "shaft").agg(F.countDistinct("level").alias("n")).where("n < 2")


def usable_walls(walls: DataFrame, footprints: DataFrame, buffer: float = 8.0, tolerance: float = 0.3, least: float = 0.45) -> DataFrame:
    """Walls (code, id, pts) with a vertex in the footprint grown by buffer, simplified; those shorter than least go."""
    near = walls.join(footprints, "code").where(F.exists("pts", lambda p: S.within(p, F.col("rings"), buffer))).drop("rings")
    return near.withColumn("pts", polyline.simplify("pts", tolerance)).where(S.length("pts") >= least)


def compact(levels: DataFrame) -> DataFrame:
    """Rows of (code, level) with flat decimetre arrays about the origin (ox, oy) and kinds as one letter each."""
    local = lambda pts: F.transform(pts, lambda p: F.struct((p["x"] - F.col("ox")).alias("x"), (p["y"] - F.col("oy")).alias("y")))
    return levels.select("code", "level", "ox", "oy", S.quantise(local(F.col("nodes"))).alias("nodes"), F.array_join(F.transform("nodes", lambda n: F.substring(n["kind"], 1, 1)), "").alias("kinds"), F.transform("walls", lambda w: S.quantise(local(w))).alias("walls"))


def expand(rows: DataFrame) -> DataFrame:
    """The reverse of compact: (code, level, i, x, y, kind), a row a node."""
    pts = rows.select("code", "level", "ox", "oy", F.arrays_zip(S.dequantise("nodes").alias("p"), S.decode_kinds("kinds").alias("kind")).alias("n")).select("code", "level", "ox", "oy", F.posexplode("n").alias("i", "n"))
    return pts.select("code", "level", "i", (F.col("ox") + F.col("n.p.x")).alias("x"), (F.col("oy") + F.col("n.p.y")).alias("y"), "n.kind")


def index(levels: DataFrame, rooms: DataFrame, methods: DataFrame) -> DataFrame:
    """(code, levels, elev, labels, rooms, georef): one row a building; levels in order, rooms with a number counted."""
    a = levels.groupBy("code").agg(F.sort_array(F.collect_list(F.struct("level", "elev", "label"))).alias("l"))
    b = rooms.groupBy("code").agg(F.count("number").alias("rooms"))
    pick = lambda k: F.transform("l", lambda x: x[k]).alias("levels" if k == "level" else "labels" if k == "label" else k)
    return a.join(b, "code", "left").join(methods, "code", "left").select("code", pick("level"), pick("elev"), pick("label"), F.coalesce("rooms", F.lit(0)).alias("rooms"), F.col("method").alias("georef"))


def find_room(rooms: DataFrame, code: str, number: str) -> DataFrame:
    """The first room (by level, then order) of a building with a number, compared without spaces and in upper case, that has a node."""
    wanted = "".join(number.split()).upper()
    hit = rooms.where((F.col("code") == code) & F.col("node").isNotNull() & (F.upper(F.regexp_replace("number", r"\s", "")) == wanted))
    return hit.orderBy("level", "ord").limit(1)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new over old by key: new's values where it has any, old's otherwise; rows of either stay."""
    columns = [c for c in old.columns if c != key]
    extra = [c for c in new.columns if c != key and c not in columns]
    n = new.select(key, *(F.col(c).alias(f"_new_{c}") for c in new.columns if c != key))
    both = old.join(n, key, "full")
    return both.select(key, *(F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in new.columns else F.col(c) for c in columns), *(F.col(f"_new_{c}").alias(c) for c in extra))


def upsert_coded(old: DataFrame, new: DataFrame) -> DataFrame:
    """upsert by code; rows whose code is not a valid one are not taken over."""
    return upsert(old, new.where(valid_code("code")), "code")


def valid_code(code) -> F.Column:
    return S.c(code).rlike("^[A-Za-z0-9_ -]{1,40}$")


def room_coverage(rooms: DataFrame) -> DataFrame:
    """(code, named, total), with a row of null code for all."""
    return rooms.rollup("code").agg(F.count("number").alias("named"), F.count("*").alias("total"))

"""Routes: arcs of a campus graph, solved, turned into segments, steps, totals and camera frames.

Everything after solving is for many routes at once: rows carry the keys of their
route (req, as solve() and journeys give it), windows and groups are by them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import scalars as S
from . import graph

#: Columns of a segment, in order.
KEYS = ("req",)
SEGMENT = ["kind", "link", "building", "level", "to_level", "vertical", "from", "to", "coords", "m"]


def open_links(links: DataFrame) -> DataFrame:
    return links.where(F.coalesce("status", F.lit("open")) != "closed")


def portals(links: DataFrame) -> DataFrame:
    """Portal vertices (id, building, link, lon, lat, z) of the open links, one at each end."""
    ends = open_links(links).select(F.col("id").alias("link"), "z_m", F.explode(F.array(
        F.struct(F.col("from").alias("building"), F.get("geom", F.lit(0)).alias("p")),
        F.struct(F.col("to").alias("building"), F.element_at("geom", -1).alias("p")),
    )).alias("e"))
    return ends.select(F.concat_ws(":", F.lit("P"), "link", "e.building").alias("id"), "e.building", "link", "e.p.lon", "e.p.lat", F.col("z_m").cast("double").alias("z"))


def link_arcs(links: DataFrame) -> DataFrame:
    one = open_links(links).select(F.concat_ws(":", F.lit("P"), "id", "from").alias("a"), F.concat_ws(":", F.lit("P"), "id", "to").alias("b"), F.col("length_m").cast("double").alias("m"), F.lit("indoor").alias("kind"), F.col("id").alias("link"))
    return graph.both_ways(one).withColumn("w", F.col("m"))


def alive_edges(edges: DataFrame, nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without portals of closed or missing links, and the edges with both ends among them."""
    ok = open_links(links).select(F.col("id").alias("_link"))
    n = nodes.withColumn("_link", S.portal_link("id"))
    left = n.where("_link IS NULL").drop("_link").unionByName(n.join(F.broadcast(ok) if ok.limit(100_001).count() <= 100_000 else ok, "_link", "left_semi").drop("_link"))
    ids = left.select("id")
    return left, edges.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")


def linked_buildings(links: DataFrame) -> DataFrame:
    """(building): each building that a link ends at."""
    return links.select(F.explode(F.array("from", "to")).alias("building")).distinct()


def buildings(points: DataFrame) -> DataFrame:
    """Building vertices (id, building, lon, lat) at the mean of their portals."""
    mean = points.groupBy("building").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    return mean.select(F.concat_ws(":", F.lit("B"), "building").alias("id"), "building", "lon", "lat")


def portal_arcs(links: DataFrame, with_buildings: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, building, lon, lat) and arcs (a, b, w, m, kind, link, building) from the links alone."""
    p = portals(links).select("id", "building", "lon", "lat")
    nodes = p.unionByName(buildings(p)) if with_buildings else p
    inside = graph.clique(nodes.withColumn("ord", F.col("id"))).select("a", "b", "w", "m", F.lit("intra").alias("kind"), F.lit(None).cast("string").alias("link"), "building")
    across = link_arcs(links).select("a", "b", "w", "m", "kind", "link", F.lit(None).cast("string").alias("building"))
    return nodes, across.unionByName(inside)


def indoor_arcs(walks: DataFrame, verticals: DataFrame, levels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Arcs of buildings' floors: corridors both ways with their lines, stairs and elevators with their weights.

    walks: code, level, a, b, m, path. verticals: code, kind, a_level, a_node, b_level, b_node, m. levels: code, level, elev. nodes: code, level, i, lon, lat.
    Verticals with a missing end are skipped."""
    lift = lambda path, z: F.transform(path, lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"), z.alias("z")))
    w = walks.join(levels, ["code", "level"]).select(
        S.indoor_node("code", "level", "a").alias("a"), S.indoor_node("code", "level", "b").alias("b"), "m", F.col("m").alias("w"),
        F.lit("walk").alias("kind"), F.lit(None).cast("string").alias("vertical"), F.col("code").alias("building"), "level", F.col("level").alias("to_level"), lift(F.col("path"), F.col("elev")).alias("coords"),
    )
    end = lambda s: nodes.join(levels, ["code", "level"]).select("code", F.col("level").alias(f"{s}_level"), F.col("i").alias(f"{s}_node"), F.struct("lon", "lat", F.col("elev").alias("z")).alias(f"{s}_p"))
    v = verticals.join(end("a"), ["code", "a_level", "a_node"]).join(end("b"), ["code", "b_level", "b_node"]).select(
        S.indoor_node("code", "a_level", "a_node").alias("a"), S.indoor_node("code", "b_level", "b_node").alias("b"), "m", R.arc_weight("kind", "m").alias("w"),
        F.lit("vertical").alias("kind"), F.col("kind").alias("vertical"), F.col("code").alias("building"), F.col("a_level").alias("level"), F.col("b_level").alias("to_level"), F.array("a_p", "b_p").alias("coords"),
    )
    both = w.unionByName(v)
    flip = both.withColumns({"a": F.col("b"), "b": F.col("a"), "level": F.col("to_level"), "to_level": F.col("level"), "coords": F.reverse("coords")})
    return both.unionByName(flip)


def assemble(parts: list[DataFrame]) -> DataFrame:
    """One arc table of all families; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def solve(arcs: DataFrame, source: str, target: str) -> DataFrame:
    """(req, hop, a, b, w, m, ...): the arcs of the cheapest route by w, req 0; no rows where there is none. For many routes see journeys."""
    spark = arcs.sparkSession
    dist = graph.shortest(arcs.select("a", "b", "w", "m"), spark.createDataFrame([(source,)], "id string"), target=target)
    nodes = graph.paths(dist, spark.createDataFrame([(source, target)], "src string, target string"))
    w = Window.partitionBy("src", "target").orderBy("hop")
    hops = nodes.withColumns({"b": F.lead("id").over(w)}).where("b IS NOT NULL").select("hop", F.col("id").alias("a"), "b")
    best = Window.partitionBy("hop").orderBy("w", "m")
    return hops.join(arcs, ["a", "b"]).withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n").withColumn("req", F.lit(0))


def refine(coarse: DataFrame, fine: DataFrame, source: str, target: str) -> DataFrame:
    """Two passes: solve on the coarse arcs, add the fine arcs of the buildings touched, solve again."""
    first = solve(coarse, source, target)
    touched = first.where("building IS NOT NULL").select("building").distinct()
    loaded = fine.join(F.broadcast(touched), "building", "left_semi")  # a route's buildings: few
    return solve(assemble([coarse, loaded]), source, target)


def to_segments(hops: DataFrame, nodes: DataFrame, links: DataFrame, edges: DataFrame | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Typed segments in order: link lines at their height, turned where entered from the far end; straight lines inside a building."""
    ends = lambda s: nodes.select(F.col("id").alias(s), F.col("building").alias(f"{s}_b"), F.struct("lon", "lat").alias(f"{s}_p"))
    geometry = links.select(F.col("id").alias("link"), "geom", "z_m", F.col("from").alias("link_from"))
    wide = assemble([hops, hops.sparkSession.createDataFrame([], "coords array<struct<lon:double,lat:double,z:double>>, level double, to_level double, vertical string, link string, building string")])
    full = wide.join(ends("a"), "a", "left").join(ends("b"), "b", "left").join(geometry, "link", "left")
    if edges is not None:  # outdoor lines, stored from a to b
        pair = lambda: [F.least("a", "b").alias("_lo"), F.greatest("a", "b").alias("_hi")]
        lines = edges.select(*pair(), F.col("a").alias("_ea"), F.col("geom").alias("_g"))
        full = full.select("*", *pair()).join(lines, ["_lo", "_hi"], "left").drop("_lo", "_hi")
    else:
        full = full.withColumns({"_ea": F.lit(None).cast("string"), "_g": F.lit(None).cast("array<struct<lon:double,lat:double>>")})
    at = lambda line, z: F.transform(line, lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"), z.cast("double").alias("z")))
    turned = F.when(F.col("a").endswith(F.concat(F.lit(":"), F.col("link_from"))), F.col("geom")).otherwise(F.reverse("geom"))
    outdoor = F.when(F.col("_ea") == F.col("a"), F.col("_g")).otherwise(F.reverse("_g"))
    coords = (
        F.when(F.col("coords").isNotNull(), F.col("coords"))
        .when(F.col("kind") == "indoor", at(turned, F.col("z_m")))
        .when((F.col("kind") == "outdoor") & F.col("_g").isNotNull(), at(outdoor, F.lit(0.3)))
        .otherwise(at(F.array("a_p", "b_p"), F.lit(1.0)))
    )
    return full.select(*keys, "hop", "kind", "link", F.coalesce("building", F.when(F.col("kind") == "intra", F.col("a_b"))).alias("building"), "level", "to_level", "vertical", F.coalesce("a_b", "building").alias("from"), F.coalesce("b_b", "building").alias("to"), coords.alias("coords"), S.round_up("m").alias("m"))


def runs(rows: DataFrame, order: str, same: list[str], keys: tuple[str, ...]) -> DataFrame:
    """Adds run: within keys, rows in order share a number while the columns in same stay equal (gaps and islands)."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = reduce(lambda a, b: a | b, (~F.col(c).eqNullSafe(F.lag(c).over(w)) for c in same)) | F.lag(F.lit(1)).over(w).isNull()
    return rows.withColumn("_changed", F.coalesce(changed, F.lit(True)).cast("long")).withColumn("run", F.sum("_changed").over(w)).drop("_changed")


#: Names up to so many are broadcast.
SMALL_NAMES = 100_000


def _named(rows: DataFrame, names: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the full name of a building's code; the names are broadcast only after a check of their number."""
    label = names.groupBy(F.col("code").alias(column)).agg(F.min(F.concat_ws(" · ", "code", "name")).alias(out))
    few = names.limit(SMALL_NAMES + 1).count() <= SMALL_NAMES
    return rows.join(F.broadcast(label) if few else label, column, "left")


def to_steps(segments: DataFrame, links: DataFrame, names: DataFrame | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, n, text, caption, kind, index, m): consecutive hops inside a building or along one floor are one step, short ones are left out.

    A start and an end step stand at either side of each route."""
    alone = ~F.col("kind").isin("intra", "walk")
    keyed = segments.withColumn("_alone", F.when(alone, F.col("hop"))).withColumn("_floor", F.when(F.col("kind") == "walk", F.col("level")))
    first = lambda c: F.min_by(c, "hop").alias(c)
    grouped = runs(keyed, "hop", ["kind", "building", "_floor", "_alone"], keys).groupBy(*keys, "run").agg(F.min("hop").alias("index"), *(first(c) for c in ("kind", "link", "building", "level", "to_level", "vertical", "to")), F.sum("m").alias("m"))
    long_ = grouped.where(~((F.col("kind") == "intra") & (F.col("m") < 15)) & ~((F.col("kind") == "walk") & (F.col("m") < 8)))
    told = long_.join(links.select(F.col("id").alias("link"), F.col("kind").alias("link_kind"), F.col("name").alias("link_name"), "z_m", "length_m", "verified", "notes"), "link", "left")
    body = told.select(*keys, "index", R.step_text().alias("text"), F.col("notes").alias("caption"), "kind", "m")
    ends = segments.groupBy(*keys).agg(F.min_by("from", "hop").alias("a"), F.max_by("to", "hop").alias("b"), F.max("hop").alias("last"))
    if names is not None:
        ends = _named(_named(ends, names, "a", "fa"), names, "b", "fb")
    else:
        ends = ends.withColumns({"fa": F.lit(None).cast("string"), "fb": F.lit(None).cast("string")})
    say = lambda t, f, c: F.concat(F.lit(t), F.lit("<b>"), R.escape_html(F.coalesce(f, c)), F.lit("</b>."))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("string")
    side = lambda index, text, kind: ends.select(*keys, index.alias("index"), text.alias("text"), none.alias("caption"), F.lit(kind).alias("kind"), zero.alias("m"))
    start, end = side(F.lit(-1), say("Start in ", "fa", "a"), "start"), side(F.col("last") + 1, say("Arrive at ", "fb", "b"), "end")
    w = Window.partitionBy(*keys).orderBy("index")
    return start.unionByName(body).unionByName(end).withColumn("n", F.row_number().over(w) - 1)


def summary(segments: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(m, indoor_m, minutes, indoor_share); the share is 1 for an empty route."""
    g = segments.groupBy(*keys) if keys else segments.groupBy()
    out = g.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("m"), F.coalesce(F.sum(F.when(F.col("kind") != "outdoor", F.col("m"))), F.lit(0)).alias("indoor_m"))
    return out.withColumns({"minutes": R.minutes("m"), "indoor_share": F.when(F.col("m") == 0, 1.0).otherwise(F.col("indoor_m") / F.col("m"))})


def frames(segments: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, n, lon, lat, z, bearing, pitch, seg, t): samples a metre apart along a route, with smoothed bearings.

    Each line of coords gives max(1, round(max(length, 1.5 rise))) samples, its end excluded. Steps under a
    micrometre keep the bearing before them; bearings are the circular mean of seven samples."""
    lines = segments.select(*keys, F.col("hop").alias("seg"), F.posexplode(S.segments("coords")).alias("i", "s"))
    dx, dy = (F.col("s.b.lon") - F.col("s.a.lon")) * S.MX, (F.col("s.b.lat") - F.col("s.a.lat")) * S.MY
    d, rise = F.hypot(dx, dy), F.abs(F.col("s.b.z") - F.col("s.a.z"))
    n = F.greatest(F.lit(1), S.round_up(F.greatest(d, rise * 1.5)).cast("int"))
    own = lines.withColumns({"_b": F.when(d >= 1e-6, S.bearing(dx, dy)), "_n": n})
    part = lambda: Window.partitionBy(*keys)
    held = own.withColumn("_b", F.coalesce(F.last("_b", ignorenulls=True).over(part().orderBy("seg", "i").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
    pts = held.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumn("_t", F.col("k") / F.col("_n"))
    mix = lambda c: F.col(f"s.a.{c}") + (F.col(f"s.b.{c}") - F.col(f"s.a.{c}")) * F.col("_t")
    pts = pts.select(*keys, "seg", "i", "k", mix("lon").alias("lon"), mix("lat").alias("lat"), mix("z").alias("z"), "_b")
    order = part().orderBy("seg", "i", "k")
    near = order.rowsBetween(-3, 3)
    return pts.withColumns({
        "bearing": F.pmod(F.degrees(F.atan2(F.sum(F.sin(F.radians("_b"))).over(near), F.sum(F.cos(F.radians("_b"))).over(near))) + 360, F.lit(360.0)),
        "pitch": R.pitch(F.coalesce(F.lead("z").over(order) - F.col("z"), F.lit(0.0))),
        "t": F.percent_rank().over(order),
        "n": F.row_number().over(order) - 1,
    }).select(*keys, "n", "lon", "lat", "z", "bearing", "pitch", "seg", "t")


def frame_steps(frame_rows: DataFrame, steps: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Frames with the latest step whose index is not after their segment; start and end steps don't count."""
    real = steps.where(~F.col("kind").isin("start", "end")).select(*keys, F.col("index").alias("seg"), F.col("n").alias("_step"))
    both = frame_rows.select(*keys, "n", "seg", F.lit(None).cast("int").alias("_step"), F.lit(1).alias("_w")).unionByName(real.select(*keys, F.lit(None).cast("int").alias("n"), "seg", F.col("_step").cast("int"), F.lit(0).alias("_w")))
    w = Window.partitionBy(*keys).orderBy("seg", "_w", "n").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("step", F.coalesce(F.last("_step", ignorenulls=True).over(w), F.lit(0))).where("_w = 1").select(*keys, "n", "seg", "step")


def frame_at(frame_rows: DataFrame, seconds: float, speed: float = 1.0, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The frame of each route that playback shows after some seconds at a speed of 1, 2 or 4; it stops on the last."""
    last = frame_rows.groupBy(*keys).agg(F.max("n").alias("last"))
    return frame_rows.join(last, list(keys)).where(F.col("n") == F.least("last", F.floor(F.lit(R.PLAY_SPEED * speed * seconds)))).drop("last")


def opened_floor(segments: DataFrame, link_levels: DataFrame | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, hop, building, floor): the floor shown with each segment; a link shows its destination's level nearest to its height (link, to, floor)."""
    floor = F.when((F.col("kind") == "vertical"), F.when(F.col("to_level") > F.col("level"), F.col("level")).otherwise(F.col("to_level"))).when(F.col("kind") == "walk", F.col("level"))
    out = segments.withColumn("floor", floor)
    if link_levels is not None:
        out = out.join(link_levels.withColumnRenamed("floor", "_f"), ["link", "to"], "left").withColumn("floor", F.coalesce("floor", F.when(F.col("kind") == "indoor", F.col("_f"))))
    return out.select(*keys, "hop", F.when(F.col("kind") == "indoor", F.col("to")).otherwise(F.coalesce("building", "to")).alias("building"), "floor")

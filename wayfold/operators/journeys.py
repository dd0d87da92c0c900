"""Many routes at once: a table of requests.

Where all arcs are few, every task gets them and solves its own requests, without a
shuffle; else all requests advance in one frontier. Both give the same rows.

Every request sees the coarse arcs of the campus, and of the floors' arcs those of
its own buildings only, so that nobody pays for floors that others walk on. In a
building whose floors a request has loaded, hops straight through cost FALLBACK as
much, so real corridors win wherever they connect.

Arcs: arc (a unique name), a, b, w (cost), m (metres), kind, building, and what a
segment needs (link, vertical, level, to_level, coords). Requests: req, source,
target (vertex ids), loaded (codes of buildings whose floors it sees). Equal costs
take the arc with the smaller name. Requests with an unknown source or target, or
with no way between them, give no rows.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import scalars as S
from . import graph, route, spatial

#: Cost of a hop straight through a building, times its length, where the request has loaded its floors.
FALLBACK = 2.5
ARC = ["arc", "a", "b", "w", "m", "kind", "link", "building", "vertical", "level", "to_level", "coords"]
_TYPES = {"link": "string", "building": "string", "vertical": "string", "level": "double", "to_level": "double", "coords": "array<struct<lon:double,lat:double,z:double>>"}


def _arcs(df: DataFrame) -> DataFrame:
    """Columns of an arc, missing ones null; the name tells parallel arcs of different links and kinds apart."""
    for c, t in _TYPES.items():
        df = df.withColumn(c, F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t))
    return df.withColumn("arc", F.concat_ws(">", "a", "b", "kind", "link")).select(*ARC)


def coarse_arcs(nodes: DataFrame, edges: DataFrame, links: DataFrame, penalty: float = R.OUTDOOR_PENALTY) -> DataFrame:
    """Arcs of the campus: edges (a, b, kind, link, m) both ways, and hops between all nodes (id, building, lon, lat) of a building. Nodes of closed links count for nothing."""
    alive, open_edges = route.alive_edges(edges, nodes, links)
    across = graph.both_ways(open_edges.select("a", "b", "kind", "link", F.col("m").cast("double").alias("m"))).withColumn("w", R.arc_weight("kind", "m", penalty))
    inside = graph.clique(alive.withColumn("ord", F.col("id"))).withColumn("kind", F.lit("intra"))
    return _arcs(across).unionByName(_arcs(inside))


def link_edges(links: DataFrame) -> DataFrame:
    """An edge (a, b, kind, link, m) between the two portals of each link."""
    return links.select(F.concat_ws(":", F.lit("P"), "id", "from").alias("a"), F.concat_ws(":", F.lit("P"), "id", "to").alias("b"), F.lit("indoor").alias("kind"), F.col("id").alias("link"), F.col("length_m").cast("double").alias("m"))


def floor_arcs(nodes: DataFrame, links: DataFrame, walks: DataFrame, verticals: DataFrame, levels: DataFrame, places: DataFrame) -> DataFrame:
    """Arcs of all floors, and anchors that tie the campus nodes of these buildings to the nearest place of the level at their height.

    nodes: id, building, lon, lat. walks, verticals: as in route.indoor_arcs. levels: code, level, elev, nodes, ord. places: code, level, i, lon, lat."""
    inside = route.indoor_arcs(walks, verticals, levels.select("code", "level", "elev"), places)
    height = links.select(F.col("id").alias("_link"), F.col("z_m").cast("double").alias("z"))
    campus = route.alive_edges(links.select(F.lit("").alias("a"), F.lit("").alias("b")).limit(0), nodes, links)[0]
    metric = lambda df: df.withColumn("_p", S.to_metric(F.struct("lon", "lat"))).withColumns({"x": F.col("_p.x"), "y": F.col("_p.y")}).drop("_p")
    there = levels.select("code").distinct()
    at = campus.withColumn("_link", S.portal_link("id")).join(height, "_link", "left").join(there, F.col("building") == F.col("code"))
    at = metric(at).select("code", "id", "z", "x", "y", "lon", "lat")
    near = graph.anchors(at.select("code", "id", "z", "x", "y"), levels, metric(places).select("code", "level", F.col("i").alias("id"), "x", "y"))
    # lines of the anchors: both ends at the level's height
    ends = at.select("id", "lon", "lat").unionByName(places.select(S.indoor_node("code", "level", "i").alias("id"), "lon", "lat"))
    p = lambda s: ends.select(F.col("id").alias(s), F.struct("lon", "lat").alias(f"_{s}"))
    lift = lambda s: F.struct(F.col(f"_{s}.lon").alias("lon"), F.col(f"_{s}.lat").alias("lat"), F.col("elev").alias("z"))
    tied = near.join(levels.select("code", "level", "elev"), ["code", "level"]).join(p("a"), "a").join(p("b"), "b")
    tied = tied.select("a", "b", "w", "m", F.lit("walk").alias("kind"), F.col("code").alias("building"), "level", F.col("level").alias("to_level"), F.array(lift("a"), lift("b")).alias("coords"))
    return _arcs(inside).unionByName(_arcs(tied))


def search(arcs: DataFrame, requests: DataFrame) -> DataFrame:
    """(req, id, d, m, arc, prev): what each request has settled up to its target, all in one frontier.

    arcs have fine: whether only requests that loaded their building see them. Vertices
    that cost more than a known way to the target are not gone on from."""
    steps = graph.kept(arcs.select("arc", "a", "b", F.col("w").cast("double").alias("w"), F.col("m").cast("double").alias("m"), "kind", "building", "fine").repartition("a"))
    none = F.lit(None).cast("string")
    zero = F.lit(0.0)
    asked = requests.select("req", "source", "target", F.coalesce("loaded", F.array().cast("array<string>")).alias("loaded"))
    frontier = graph.kept(asked.select("req", F.col("source").alias("id"), zero.alias("d"), zero.alias("m"), none.alias("arc"), none.alias("prev"), "target", "loaded"))
    order = F.struct("d", "arc", "prev", "m", "_new")
    best = lambda rows: rows.groupBy("req", "id").agg(F.min_by(F.struct("d", "m", "arc", "prev", "target", "loaded", "_new"), order).alias("x")).select("req", "id", "x.*")
    dist, rounds = frontier, 0
    while True:
        n = frontier.limit(graph.SMALL_FRONTIER + 1).count()
        if not n:
            return best(dist.withColumn("_new", F.lit(0))).select("req", "id", "d", "m", "arc", "prev")
        here = (F.broadcast(frontier) if n <= graph.SMALL_FRONTIER else frontier).select("req", "id", F.col("d").alias("d0"), F.col("m").alias("m0"), "target", "loaded")
        mine = F.coalesce(F.array_contains("loaded", F.col("building")), F.lit(False))
        cost = F.when((F.col("kind") == "intra") & mine, F.col("w") * FALLBACK).otherwise(F.col("w"))
        near = here.join(steps, F.col("id") == F.col("a")).where(~F.col("fine") | mine)
        near = near.select("req", F.col("b").alias("id"), (F.col("d0") + cost).alias("d"), (F.col("m0") + F.col("m")).alias("m"), "arc", F.col("a").alias("prev"), "target", "loaded")
        reached = dist.where(F.col("id") == F.col("target")).groupBy("req").agg(F.min("d").alias("bound"))
        near = near.join(reached, "req", "left").where(F.col("bound").isNull() | (F.col("d") <= F.col("bound"))).drop("bound")
        both = best(dist.withColumn("_new", F.lit(0)).unionByName(near.withColumn("_new", F.lit(1))))
        frontier = graph.kept(both.where("_new = 1").drop("_new"))
        dist, rounds = dist.unionByName(frontier), rounds + 1
        if rounds % graph.COMPACT == 0:
            dist = graph.kept(best(dist.withColumn("_new", F.lit(0))).drop("_new"))


def _walk_back(dist: DataFrame, requests: DataFrame) -> DataFrame:
    """(req, hop, arc): the arcs to each request's target, in order; one join a hop for all requests."""
    dist = graph.kept(dist.select("req", "id", "arc", "prev"))
    here = graph.kept(requests.select("req", F.col("target").alias("id")).join(dist, ["req", "id"]).select("req", "arc", "prev", F.lit(0).alias("back")))
    every = [here]
    while True:
        n = here.limit(graph.SMALL_FRONTIER + 1).count()
        if not n:
            break
        small = F.broadcast(here) if n <= graph.SMALL_FRONTIER else here
        here = graph.kept(small.select("req", F.col("prev").alias("id"), "back").join(dist, ["req", "id"]).where("arc IS NOT NULL").select("req", "arc", "prev", (F.col("back") + 1).alias("back")))
        every.append(here)
    out = every[0]
    for x in every[1:]:
        out = out.unionByName(x)
    w = Window.partitionBy("req")
    return out.where("arc IS NOT NULL").select("req", (F.max("back").over(w) - F.col("back")).alias("hop"), "arc")


def cheapest(near: dict[str, list[tuple]], source: str, target: str, loaded: set[str]) -> list[int]:
    """Places of the arcs on the cheapest way, none where there is no way. near: for each vertex (b, cost, place, building of a hop straight through, building whose floors it is on)."""
    best, heap, done = {source: (0.0, -1, "")}, [(0.0, source)], set()
    while heap:
        d, x = heapq.heappop(heap)
        if x == target:
            break
        if x in done:
            continue
        done.add(x)
        for b, w, place, through, floor in near.get(x, ()):
            if floor is None or floor in loaded:
                found = (d + w * FALLBACK if through in loaded else d + w, place, x)
                if b not in best or found[:2] < best[b][:2]:
                    if b not in best or found[0] < best[b][0]:
                        heapq.heappush(heap, (found[0], b))
                    best[b] = found
    way = []
    while target in best and target != source:
        _, place, target = best[target]
        way.append(place)
    return way[::-1]


def _own_hops(arcs: DataFrame, requests: DataFrame) -> DataFrame:
    """(req, hop, arc), each task solving its requests on all arcs; for few arcs."""
    table = arcs.select("arc", "a", "b", F.col("w").cast("double").alias("w"), "kind", "building", "fine").orderBy("arc").toPandas()
    sent = arcs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near, names = defaultdict(list), sent.value["arc"].tolist()
        for place, (a, b, w, kind, building, fine) in enumerate(sent.value.drop(columns="arc").itertuples(index=False)):
            near[a].append((b, w, place, building if kind == "intra" else "", building if fine else None))
        for batch in batches:
            rows = [(req, hop, names[place]) for req, source, target, loaded in batch.itertuples(index=False) for hop, place in enumerate(cheapest(near, source, target, set(loaded)))]
            yield pd.DataFrame(rows, columns=["req", "hop", "arc"])

    asked = requests.select("req", "source", "target", F.coalesce("loaded", F.array().cast("array<string>")).alias("loaded"))
    return asked.mapInPandas(run, f"req {requests.schema['req'].dataType.simpleString()}, hop int, arc string")


def hops(arcs: DataFrame, requests: DataFrame) -> DataFrame:
    """(req, hop, arc, a, b, w, m, ...): the arcs of each request's cheapest way.

    Requests with the same ends that see the same floors are one search, dealt over all cores."""
    few = arcs.limit(graph.SMALL_ARCS + 1).count() <= graph.SMALL_ARCS
    seen = F.sort_array(F.array_distinct(F.coalesce("loaded", F.array().cast("array<string>"))))
    asked = requests.select("req", "source", "target", seen.alias("loaded")).withColumn("_way", F.to_json(F.struct("source", "target", "loaded")))
    ways = asked.select(F.col("_way").alias("req"), "source", "target", "loaded").distinct().repartition(2 * requests.sparkSession.sparkContext.defaultParallelism, "req")
    found = _own_hops(arcs, ways) if few else _walk_back(search(arcs, ways), ways)
    steps = graph.kept(found).join(F.broadcast(arcs.drop("fine")) if few else arcs.drop("fine"), "arc")
    return asked.select("req", "_way").join(steps.withColumnRenamed("req", "_way"), "_way").drop("_way")


def touched(found: DataFrame, nodes: DataFrame, codes: DataFrame) -> DataFrame:
    """(req, touched): the buildings with floors (codes: code) that each route passes, by the nodes at its hops' ends."""
    ends = found.select("req", F.explode(F.array("a", "b")).alias("id")).distinct()
    code = ends.join(nodes.select("id", F.col("building").alias("_b")), "id", "left").withColumn("code", F.coalesce("_b", F.when(F.col("id").startswith("I:"), S.parse_indoor_node("id")["code"])))
    return code.join(codes.select("code").distinct(), "code", "left_semi").groupBy("req").agg(F.sort_array(F.collect_set("code")).alias("touched"))


def solve(coarse: DataFrame, fine: DataFrame, requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """(req, hop, arc, a, b, w, m, ..., loaded): two passes for all requests.

    The first solves on the coarse arcs and the floors of the rooms asked for, the
    second once more with the floors of the buildings that the first way passes.
    The others' floors are not seen. Requests that pass no building with floors keep their first way."""
    every = graph.kept(coarse.withColumn("fine", F.lit(False)).unionByName(fine.withColumn("fine", F.lit(True))))
    codes = fine.select(F.col("building").alias("code")).distinct()
    room = lambda c: F.when(F.col(c).startswith("I:"), S.parse_indoor_node(c)["code"])
    asked = graph.kept(requests.select("req", "source", "target", F.array_compact(F.array_distinct(F.array(room("source"), room("target")))).alias("loaded")))
    first = graph.kept(hops(every, asked))
    own = asked.join(touched(first, nodes, codes), "req", "left").withColumn("more", F.sort_array(F.array_union("loaded", F.coalesce("touched", F.array().cast("array<string>")))))
    again = graph.kept(own.where(F.size("more") > F.size("loaded")).select("req", "source", "target", F.col("more").alias("loaded")))
    second = hops(every, again)
    kept = first.join(again.select("req"), "req", "left_anti").join(asked.select("req", "loaded"), "req")
    return kept.unionByName(second.join(again.select("req", "loaded"), "req"))


def link_floors(links: DataFrame, levels: DataFrame) -> DataFrame:
    """(link, to, floor): for either end of each link, the level of the building there that is nearest to the link's height."""
    ends = links.select(F.col("id").alias("link"), F.col("z_m").cast("double").alias("z"), F.explode(F.array("from", "to")).alias("code"))
    at = ends.withColumn("id", F.struct("link", "code"))
    return spatial.level_nearest(at, levels, ("code",)).select("id.link", F.col("code").alias("to"), F.col("level").alias("floor"))

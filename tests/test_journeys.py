import heapq
import random

import pytest
from pyspark.sql import functions as F

from wayfold.functions import scalars as S
from wayfold.operators import graph, journeys, quality, route
from wayfold.sources import campus

NO_EDGES = "a string, b string, kind string, link string, m double"


def plain_dijkstra(arcs, source, target, loaded):
    """Costs by a search of its own over rows (a, b, w, kind, building, fine)."""
    best, heap = {source: 0.0}, [(0.0, source)]
    while heap:
        d, x = heapq.heappop(heap)
        if x == target:
            return d
        if d > best[x]:
            continue
        for a, b, w, kind, building, fine in arcs:
            if a == x and (not fine or building in loaded):
                c = d + w * (2.5 if kind == "intra" and building in loaded else 1)
                if c < best.get(b, 1e18):
                    best[b] = c
                    heapq.heappush(heap, (c, b))
    return None


def test_costs_of_the_portal_graph(spark):
    links = campus.links(spark)
    points = route.portals(links).select("id", "building", "lon", "lat")
    nodes = points.unionByName(route.buildings(points))
    arcs = journeys.coarse_arcs(nodes, journeys.link_edges(links), links)
    assert (nodes.count(), arcs.count()) == (101, 340)
    assert not [r.id for r in route.alive_edges(journeys.link_edges(links), nodes, links)[0].collect() if r.id.startswith("P:cph-lota")]
    labels = graph.components(nodes, arcs).join(nodes, "id").groupBy("label").agg(F.countDistinct("building").alias("n"))
    assert sorted(r.n for r in labels.collect()) == [9, 22]
    asked = [("SCH", "HH"), ("MC", "E5"), ("PAC", "E6"), ("SCH", "MC")]
    requests = spark.createDataFrame([(i, f"B:{a}", f"B:{b}") for i, (a, b) in enumerate(asked)], "req int, source string, target string")
    none = arcs.where("false")
    hops = journeys.solve(arcs, none, requests, nodes)
    got = {r.req: (round(r.w, 3), r.links) for r in hops.orderBy("hop").groupBy("req").agg(F.sum("w").alias("w"), F.array_compact(F.transform(F.sort_array(F.collect_list(F.struct("hop", "link"))), lambda x: x["link"])).alias("links")).collect()}
    assert got == {
        0: (301.660, ["sch-tc", "tc-al", "al-ev1", "ev1-hh"]),
        1: (482.109, ["mc-c2", "dc-c2", "dc-e3", "e3-e5"]),
        2: (825.372, ["pac-slc", "slc-mc", "mc-c2", "dc-c2", "dc-e3", "e3-e5", "e5-pse", "pse-e6"]),
    }
    assert not quality.route_uses(hops.where("req = 1"), ["dc-e3", "e3-e5"]).collect()
    steps = route.to_steps(route.to_segments(hops, nodes, links), links)
    by_req = {r.req: r.n for r in steps.groupBy("req").agg(F.count("*").alias("n")).collect()}
    assert set(by_req) == {0, 1, 2}
    first = [r.text for r in steps.where("req = 0").orderBy("n").collect()]
    assert first[0] == "Start in <b>SCH</b>." and first[-1] == "Arrive at <b>HH</b>." and "Take the <b>tunnel to TC</b> (57 m, -4 m)." in first


def made(seed, n=30, m=70):
    rng = random.Random(seed)
    rows = []
    for i in range(m):
        a, b = rng.sample(range(n), 2)
        kind, fine = rng.choice([("outdoor", False), ("intra", False), ("walk", True), ("indoor", False)])
        building = None if kind in ("outdoor", "indoor") else rng.choice("ABC")
        w = float(rng.randint(1, 9))  # many ties
        rows += [(f"{i}a", f"B:{a}", f"B:{b}", w, w, kind, building, fine), (f"{i}b", f"B:{b}", f"B:{a}", w, w, kind, building, fine)]
    asked = [(i, f"B:{rng.randrange(n)}", f"B:{rng.randrange(n + 2)}", [x for x in "ABC" if rng.random() < 0.4] or None) for i in range(25)]
    return rows, asked


@pytest.mark.parametrize("seed", [1, 2])
def test_frontier_and_own_searches_agree(spark, monkeypatch, seed):
    rows, asked = made(seed)
    arcs = graph.kept(spark.createDataFrame(rows, "arc string, a string, b string, w double, m double, kind string, building string, fine boolean"))
    requests = spark.createDataFrame(asked, "req int, source string, target string, loaded array<string>")
    order = lambda df: sorted((r.req, r.hop, r.arc) for r in df.collect())
    own = order(journeys.hops(arcs, requests))
    monkeypatch.setattr(graph, "SMALL_ARCS", 0)
    monkeypatch.setattr(graph, "COMPACT", 2)
    assert order(journeys.hops(arcs, requests)) == own
    weight = {r[0]: r for r in rows}
    for req, source, target, loaded in asked:
        way = [weight[arc] for q, _, arc in own if q == req]
        cost = plain_dijkstra([(r[1], r[2], r[3], r[5], r[6], r[7]) for r in rows], source, target, loaded or [])
        mine = sum(r[3] * (2.5 if r[5] == "intra" and r[6] in (loaded or []) else 1) for r in way)
        assert way == [] if cost is None or source == target else abs(mine - cost) < 1e-9
        if way:
            assert way[0][1] == source and way[-1][2] == target and all(x[2] == y[1] for x, y in zip(way, way[1:], strict=False))


def test_floors_of_own_buildings_only(spark):
    """Three buildings in a row; B has a floor with a corridor, stairs to an upper one, and a room that is asked for."""
    lon = lambda x: -80.54 + x / S.MX
    line = lambda a, b: [{"lon": lon(a), "lat": 43.47}, {"lon": lon(b), "lat": 43.47}]
    links = spark.createDataFrame([("ab", "A", "B", "tunnel", -4, "A – B", "open", True, "n", 50, line(0, 50)), ("bc", "B", "C", "bridge", 4, "B – C", "open", True, "n", 50, line(150, 200))],
                                  "id string, from string, to string, kind string, z_m int, name string, status string, verified boolean, notes string, length_m int, geom array<struct<lon:double,lat:double>>")
    p = route.portals(links).select("id", "building", "lon", "lat")
    nodes = p.unionByName(route.buildings(p))
    levels = spark.createDataFrame([("B", 0.0, 0.0, 40, 0), ("B", 1.0, 4.0, 40, 1), ("Z", 0.0, 0.0, 40, 0)], "code string, level double, elev double, nodes int, ord int")
    places = spark.createDataFrame([("B", 0.0, 0, lon(52), 43.47), ("B", 0.0, 1, lon(100), 43.47), ("B", 1.0, 0, lon(100), 43.47), ("B", 1.0, 1, lon(149), 43.47), ("Z", 0.0, 0, lon(52), 43.47)], "code string, level double, i int, lon double, lat double")
    path = lambda a, b: line(a, b)
    walks = spark.createDataFrame([("B", 0.0, 0, 1, 48.0, path(52, 100)), ("B", 1.0, 0, 1, 49.0, path(100, 149))], "code string, level double, a int, b int, m double, path array<struct<lon:double,lat:double>>")
    verticals = spark.createDataFrame([("B", "stair", 0.0, 1, 1.0, 0, 9.0), ("B", "stair", 0.0, 7, 1.0, 0, 1.0)], "code string, kind string, a_level double, a_node int, b_level double, b_node int, m double")
    coarse = journeys.coarse_arcs(nodes, journeys.link_edges(links), links)
    fine = journeys.floor_arcs(nodes, links, walks, verticals, levels, places)
    requests = spark.createDataFrame([(1, "B:A", "B:C"), (2, "B:A", "I:B:1:1"), (3, "B:A", "B:nowhere")], "req int, source string, target string")
    hops = graph.kept(journeys.solve(coarse, fine, requests, nodes))
    kinds = lambda q: [r.kind for r in hops.where(F.col("req") == q).orderBy("hop").collect()]
    assert kinds(1) == ["intra", "indoor", "walk", "walk", "vertical", "walk", "walk", "indoor", "intra"]
    assert kinds(2) == ["intra", "indoor", "walk", "walk", "vertical", "walk"] and kinds(3) == []
    segments = graph.kept(route.to_segments(hops, nodes, links))
    floors = route.opened_floor(segments, journeys.link_floors(links, levels))
    assert [(r.building, r.floor) for r in floors.where("req = 1").orderBy("hop").collect()] == [("A", None), ("B", 0.0), ("B", 0.0), ("B", 0.0), ("B", 0.0), ("B", 1.0), ("B", 1.0), ("C", None), ("C", None)]
    text = [r.text for r in route.to_steps(segments, links).where("req = 2").orderBy("n").collect()]
    assert "Take the stairs up to <b>B 2nd Floor</b>." in text and "Follow the corridor on <b>B 1st Floor</b> (≈ 50 m)." in text
    frames = route.frames(segments)
    assert frames.groupBy("req").agg(F.max("n").alias("n")).where("n > 100").count() == 2
    assert route.frame_steps(frames, route.to_steps(segments, links)).count() == frames.count()
    assert route.frame_at(frames, 1e9).count() == 2


@pytest.mark.parametrize("small", [0, 200_000])
def test_equal_requests_are_one_search(spark, monkeypatch, small):
    rows, asked = made(3)
    arcs = graph.kept(spark.createDataFrame(rows, "arc string, a string, b string, w double, m double, kind string, building string, fine boolean"))
    same = [(100 * k + i, s, t, loaded[::-1] if loaded and k else loaded) for k in range(4) for i, s, t, loaded in asked[:6]]
    requests = spark.createDataFrame(same, "req int, source string, target string, loaded array<string>")
    monkeypatch.setattr(graph, "SMALL_ARCS", small)
    counts = []
    for f in ("_own_hops", "search"):
        monkeypatch.setattr(journeys, f, lambda arcs, ways, old=getattr(journeys, f): (counts.append(ways.count()), old(arcs, ways))[1])
    got = journeys.hops(arcs, requests).collect()
    assert counts == [6] and got
    of = lambda k: sorted((r.req - 100 * k, r.hop, r.arc) for r in got if r.req // 100 == k)
    assert of(0) == of(1) == of(2) == of(3)

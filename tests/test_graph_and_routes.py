import heapq
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from wayfold.functions import scalars as S
from wayfold.operators import graph, quality, route
from wayfold.plans import catalog


def dijkstra(arcs, src):
    near = {}
    for a, b, w in arcs:
        near.setdefault(a, []).append((b, w))
    best, heap = {src: 0}, [(0, src)]
    while heap:
        d, x = heapq.heappop(heap)
        if d > best[x]:
            continue
        for y, w in near.get(x, ()):
            if d + w < best.get(y, 1 << 60):
                best[y] = d + w
                heapq.heappush(heap, (d + w, y))
    return best


def made(seed, n, m):
    rng = random.Random(seed)
    one = [(rng.randrange(n), rng.randrange(n), rng.randrange(1, 50)) for _ in range(m)]
    return one + [(b, a, w) for a, b, w in one]


@pytest.mark.parametrize("small", [200_000, 0])
def test_shortest_paths_and_shortcuts(spark, monkeypatch, small):
    monkeypatch.setattr(graph, "SMALL_ARCS", small)
    arcs = made(1, 40, 55)
    frame = spark.createDataFrame(arcs, "a long, b long, w long")
    src = spark.createDataFrame([(0,), (7,), (13,)], "id long")
    got = {}
    dist = graph.shortest(frame, src)
    for r in dist.collect():
        got.setdefault(r.src, {})[r.id] = r.d
    for s in (0, 7, 13):
        assert got[s] == dijkstra(arcs, s)
    other = {(r.src, r.id): (r.d, r.m, r.pred) for r in dist.collect()}
    monkeypatch.setattr(graph, "SMALL_ARCS", 200_000 - small)
    assert {(r.src, r.id): (r.d, r.m, r.pred) for r in graph.shortest(frame, src).collect()} == other
    monkeypatch.setattr(graph, "SMALL_ARCS", small)
    near = {(r.src, r.id): r.d for r in graph.shortest(frame, src, radius=40).collect()}
    assert near == {(s, i): d for s in (0, 7, 13) for i, d in dijkstra(arcs, s).items() if d <= 40}
    far = max(got[0], key=got[0].get)
    hops = graph.paths(dist, spark.createDataFrame([(0, far), (0, 999)], "src long, target long")).orderBy("hop").collect()
    assert hops[0].id == 0 and hops[-1].id == far and {h.target for h in hops} == {far}
    weight = {}
    for a, b, w in arcs:
        weight[a, b] = min(w, weight.get((a, b), 1 << 60))
    assert sum(weight[x.id, y.id] for x, y in zip(hops, hops[1:], strict=False)) == got[0][far]
    assert graph.shortest(frame, src.where("id = 0"), target=far).where(F.col("id") == far).first().d == got[0][far]
    doors = src.withColumn("ord", F.col("id"))
    cut = {(r.a, r.b): r.d for r in graph.shortcuts(dist, doors, 1).collect()}
    assert all(got[a][b] == d for (a, b), d in cut.items()) and len({frozenset(p) for p in cut}) == len(cut)


def test_every_door_gets_its_nearest_ones(spark, tmp_path):
    """Doors on a chain of long links: each has its four nearest ones, however far, as by the SQL."""
    n, rng = 8, random.Random(6)
    spark.createDataFrame([(i, i) for i in range(n)], "s_suppkey long, s_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    keys = [(rng.choice([(10, 17), (12, 20), (14, 21)]), i) for i in range(n - 1)]
    lines = [(i, k, i + k, p) for (pq, i) in keys for k, p in enumerate(pq)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    arcs = [(i, i + 1, 100 + (p * 31 + q * 17) % 900) for (p, q), i in keys]
    arcs += [(b, a, w) for a, b, w in arcs]
    assert min(w for *_, w in arcs) > 250
    found = {}
    for s in range(n):
        for d, t in sorted((d, t) for t, d in dijkstra(arcs, s).items() if t != s)[:4]:
            found.setdefault(frozenset((s, t)), (s, t, d))
    got = sorted(map(tuple, catalog.queries()["shortcuts_topk"](spark, str(tmp_path)).collect()))
    assert got == sorted(found.values()) and len(got) > 2 * n
    con = duckdb.connect()
    for t in ("supplier", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(con.sql(catalog.oracle_sql()["shortcuts_topk"]).fetchall()) == got


def test_components(spark):
    arcs = made(5, 300, 180)
    frame = spark.createDataFrame([(a, b) for a, b, _ in arcs], "a long, b long")
    got = {r.id: r.label for r in graph.components(spark.range(300), frame).collect()}
    for x in range(0, 300, 17):
        assert got[x] == min(dijkstra(arcs, x))
    # a long chain
    chain = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.label for r in graph.components(spark.range(401), graph.both_ways(chain)).collect()} == {0}


def test_components_of_a_chain_in_any_order_take_few_rounds(spark, monkeypatch):
    ids = list(range(3000))
    random.Random(4).shuffle(ids)
    arcs = graph.both_ways(spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "a long, b long"))
    rounds, keep = [], graph.kept
    monkeypatch.setattr(graph, "kept", lambda df: rounds.append(1) or keep(df))
    labels = graph.components(spark.range(3001), arcs)
    assert len(rounds) <= 10 and sorted(r.label for r in labels.select("label").distinct().collect()) == [0, 3000]


def links(spark):
    """Five buildings: a-b by tunnel, b-c by bridge, c-d closed, c-e by doorway."""
    line = lambda *p: [{"lon": -80.54 + x / S.MX, "lat": 43.47 + y / S.MY} for x, y in p]
    rows = [
        ("ab", "A", "B", "tunnel", -3, "A – B", "open", True, "notes", 50, line((0, 0), (50, 0))),
        ("bc", "B", "C", "bridge", 6, "North Bridge", "open", False, None, 40, line((130, 0), (90, 0))),
        ("cd", "C", "D", "tunnel", -3, "C – D", "closed", True, None, 30, line((150, 0), (180, 0))),
        ("ce", "C", "E", "doorway", 0, "C – E", None, True, None, 5, line((150, 20), (155, 20))),
    ]
    return spark.createDataFrame(rows, "id string, from string, to string, kind string, z_m int, name string, status string, verified boolean, notes string, length_m int, geom array<struct<lon:double,lat:double>>")


def test_route_over_links(spark):
    ln = links(spark)
    nodes, arcs = route.portal_arcs(ln)
    ids = {r.id for r in nodes.collect()}
    assert "P:cd:C" not in ids and {"B:A", "P:ab:A", "P:ce:E"} <= ids
    hops = route.solve(arcs, "B:A", "B:E")
    assert [h.link for h in hops.orderBy("hop").collect() if h.link] == ["ab", "bc", "ce"]
    assert quality.route_uses(hops, ["ab", "bc", "cd"]).collect()[0].link == "cd"
    total = sum(h.w for h in hops.collect())
    every = [(r.a, r.b, r.w) for r in arcs.collect()]
    assert abs(total - dijkstra(every, "B:A")["B:E"]) < 1e-6
    assert route.solve(arcs, "B:A", "B:D").count() == 0  # the only link is closed
    seg = route.to_segments(hops, nodes, ln)
    got = seg.orderBy("hop").collect()
    bridge = next(s for s in got if s.link == "bc")
    assert bridge.coords[0].z == 6 and bridge["from"] == "B" and bridge.to == "C"
    steps = [r.text for r in route.to_steps(seg, ln, spark.createDataFrame([("A", "Alpha")], "code string, name string")).orderBy("n").collect()]
    assert steps[0] == "Start in <b>A · Alpha</b>." and steps[-1] == "Arrive at <b>E</b>."
    assert any("tunnel to B" in s and ", -3 m)" in s for s in steps)
    assert any("North Bridge to C" in s and "(unverified)" in s for s in steps)
    s = route.summary(seg).first()
    assert s.m == sum(x.m for x in got) and s.indoor_share == 1 and abs(s.minutes - s.m / 1.3 / 60) < 1e-9
    fr = route.frames(seg)
    rows = fr.orderBy("n").collect()
    assert rows[0].t == 0 and rows[-1].t == 1 and all(70 <= r.pitch <= 85 and 0 <= r.bearing < 360 for r in rows)
    assert route.frame_at(fr, 1e9).count() == 1
    assert route.frame_steps(fr, route.to_steps(seg, ln)).count() == len(rows)


def test_two_passes_use_loaded_floors(spark):
    ln = links(spark)
    _, arcs = route.portal_arcs(ln)
    fine = spark.createDataFrame([("P:ab:B", "P:bc:B", 1.0, 1.0, "walk", None, "B"), ("P:ce:C", "P:zz:D", 1.0, 1.0, "walk", None, "Z")], "a string, b string, w double, m double, kind string, link string, building string")
    got = route.refine(arcs, fine, "B:A", "B:E").collect()
    assert any(h.kind == "walk" and h.building == "B" for h in got) and not any(h.building == "Z" for h in got)


def test_runs(spark):
    rows = spark.createDataFrame([(q, i, k) for q in "xy" for i, k in enumerate("aabbbaac")], "q string, i int, k string")
    assert [r.run for r in route.runs(rows, "i", ["k"], ("q",)).orderBy("q", "i").collect()] == [1, 1, 2, 2, 2, 3, 3, 4] * 2


def test_graph_from_polylines_and_spurs(spark):
    ways = spark.createDataFrame([(1, [(-80.0, 43.0), (-80.001, 43.0)]), (2, [(-80.001, 43.0000000001), (-80.001, 43.001)])], "way int, geom array<struct<lon:double,lat:double>>")
    v, e = graph.from_polylines(ways)
    assert v.count() == 3 and e.count() == 4 and graph.largest_component(v, e).count() == 3
    chains = spark.createDataFrame([(1, 0, 1, 5.0), (2, 1, 2, 1.0), (3, 1, 3, 5.0), (4, 2, 4, 1.0)], "id int, a int, b int, length double")
    assert {r.id for r in graph.prune_spurs(chains, 2.0).collect()} == {1, 3}


def test_pairs_of_a_large_building_are_dealt(spark, monkeypatch):
    """The pairs are those of the plain join, and no partition makes most of them."""
    from pyspark.sql import functions as F

    from wayfold.operators import graph

    rows = [("A" if i < 60 else f"B{i % 7}" if i < 90 else None, i, i // 2, i * 0.001, i * 0.002) for i in range(100)]
    nodes = spark.createDataFrame(rows, "building string, id int, ord int, lon double, lat double")
    want = sorted(map(tuple, graph.clique(nodes, k=2.0).collect()))
    monkeypatch.setattr(graph, "CLIQUE_BLOCK", 10)
    monkeypatch.setattr(graph, "CLIQUE_PAIRS", 150)
    dealt = graph.clique(nodes, k=2.0)
    assert sorted(map(tuple, dealt.collect())) == want and len(want) == sum(1 for x in rows for y in rows if x[0] and x[0] == y[0] and x[2] != y[2])
    of = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(of) > 8 and max(of) < len(want) / 3


def test_arcs_are_dealt_by_their_number(spark, monkeypatch):
    """Partitions grow with the arcs, not the rows of a partition; the distances stay the same."""
    from pyspark.sql import functions as F

    from wayfold.operators import graph

    arcs = spark.createDataFrame([(i, (i * k + 1) % 300, 1 + (i * k) % 7) for i in range(300) for k in range(1, 6)], "a long, b long, w long")
    start = spark.createDataFrame([(0,), (7,)], "id long")
    want = sorted(map(tuple, graph.shortest(arcs, start).collect()))
    monkeypatch.setattr(graph, "ARCS_A_TASK", 60)
    monkeypatch.setattr(graph, "SMALL_ARCS", 10)
    held, sizes = graph.kept, []

    def kept(df):
        out = held(df)
        if {"a", "b", "w"} <= set(df.columns):
            sizes.extend(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect())
        return out

    monkeypatch.setattr(graph, "kept", kept)
    assert sorted(map(tuple, graph.shortest(arcs, start).collect())) == want
    assert len(sizes) > 15 and max(sizes) < 200


def test_large_graphs_are_shrunk(spark, monkeypatch):
    """The labels are those of the rounds, which see roots only; ends that are no vertices tie nothing."""
    import random

    from wayfold.operators import graph

    rng = random.Random(2)
    name = lambda i: f"I:{i // 400}:0:{i}"
    edges = [(name(i), name(i + 1)) for i in range(2000) if i % 40 and i % 400 != 399] + [(name(rng.randrange(1200)), name(rng.randrange(1200))) for _ in range(20)] + [(name(5), "gone"), ("gone", name(1990))]
    vertices = spark.createDataFrame([(name(i),) for i in range(2050)], "id string")
    arcs = graph.both_ways(spark.createDataFrame(edges, "a string, b string"))
    whole, seen = graph._rounds, []
    want = sorted(map(tuple, whole(vertices, arcs).collect()))
    monkeypatch.setattr(graph, "SHRINK", 10)
    monkeypatch.setattr(graph, "EDGES_A_TASK", 300)
    monkeypatch.setattr(graph, "_rounds", lambda v, e: (seen.append(v.count()), whole(v, e))[1])
    assert sorted(map(tuple, graph.components(vertices, arcs).collect())) == want
    assert seen and max(seen) < 300
    numbers = spark.createDataFrame([(i, i // 2) for i in range(1, 500) if i % 7], "a long, b long")
    ids, seen[:] = spark.range(510), []
    assert sorted(map(tuple, graph.components(ids, graph.both_ways(numbers)).collect())) == sorted(map(tuple, whole(ids, graph.both_ways(numbers)).collect()))

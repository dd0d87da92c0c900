import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.operators import georef, indoor, polyline, raster, spatial


def points(spark, seed, n, size=200):
    rng = random.Random(seed)
    rows = [(i, float(rng.randrange(size)), float(rng.randrange(size))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id int, x double, y double")


def test_nearest_capped(spark):
    a, left = points(spark, 1, 80)
    b, right = points(spark, 2, 120)
    got = {r.id: (round(r.d, 9), r.near_id) for r in spatial.nearest_capped(left, right, 15.0).collect()}
    want = {}
    for i, x, y in a:
        d, j = min((round(float(np.hypot(x - u, y - v)), 9), j) for j, u, v in b)
        if d < 15:
            want[i] = (d, j)
    assert got == want


def test_snap_falls_back_to_vertices(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 200.0, 0.0)], "id int, x double, y double")
    doors = spark.createDataFrame([(10, 30.0, 0.0), (11, 120.0, 0.0)], "id int, x double, y double")
    vertices = spark.createDataFrame([(11, 170.0, 0.0), (11, 90.0, 0.0)], "id int, x double, y double")
    got = {r.id: (r.near_id, r.stage) for r in spatial.snap(doors, vertices, nodes).collect()}
    assert got == {10: (1, "centroid"), 11: (2, "vertex")}


def test_polygons_and_boundaries(spark):
    _, pts = points(spark, 3, 60, 20)
    ring = [(2.0, 2.0), (15.0, 3.0), (9.0, 9.0), (14.0, 16.0), (3.0, 14.0)]
    poly = spark.createDataFrame([(1, ring)], "pid int, ring array<struct<x:double,y:double>>")
    got = {r.id for r in spatial.polygons_at_points(pts, poly, 4.0).collect()}

    def inside(x, y):
        hit = False
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                hit = not hit
        return hit

    assert got == {r.id for r in pts.collect() if inside(r.x, r.y)}
    near = spatial.nearest_boundary(pts.withColumn("pid", F.lit(1)), poly).collect()
    assert len(near) == 60 and all(r.d >= 0 for r in near)
    labels = spark.createDataFrame([("a", 0.5, 0, 5.0, 5.0), ("b", 0.9, 1, 5.0, 6.0), ("c", 0.9, 2, 6.0, 5.0)], "text string, conf double, ord int, x double, y double")
    assert spatial.label_rooms(labels, poly, 4.0).first().text == "b"
    pair = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)], [(5.0, 0.2), (6.0, -3.0), (6.0, 3.0)])], "id int, a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>")
    r = spatial.nearest_pair(pair).first()
    assert abs(r.d - np.hypot(4, 0.2)) < 1e-9


def brute_distance(m):
    ys, xs = np.nonzero(~m)
    out = np.zeros(m.shape)
    for r, c in np.argwhere(m):
        out[r, c] = np.sqrt(((ys - r) ** 2 + (xs - c) ** 2).min()) if len(ys) else np.inf
    return out


@pytest.mark.parametrize("seed", range(6))
def test_kernels_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    m = rng.random((17, 23)) < 0.35 + 0.1 * seed
    assert np.allclose(raster.distance(m), brute_distance(m))
    for near in (raster.FOUR, raster.EIGHT):
        labels, n = raster.label(m, near)
        seen = np.zeros(m.shape, dtype=int)
        k = 0
        for r, c in np.argwhere(m):
            if seen[r, c]:
                continue
            k += 1
            stack = [(r, c)]
            seen[r, c] = k
            while stack:
                a, b = stack.pop()
                for dr, dc in near:
                    p = (a + dr, b + dc)
                    if 0 <= p[0] < 17 and 0 <= p[1] < 23 and m[p] and not seen[p]:
                        seen[p] = k
                        stack.append(p)
        assert n == k and (labels == seen).all()
    disk = raster.disk(2)
    wide = np.array([[any(0 <= r + a < 17 and 0 <= c + b < 23 and m[r + a, c + b] for a, b in disk) for c in range(23)] for r in range(17)])
    assert (raster.dilate(m, 2) == wide).all()
    assert not (m & ~raster.closing(m, 2)).any() and not (raster.opening(m, 2) & ~m).any()
    s = raster.skeleton(m)
    assert not (s & ~m).any() and raster.label(s, raster.EIGHT)[1] == raster.label(m, raster.EIGHT)[1]


def test_shapes():
    m = np.zeros((12, 14), dtype=bool)
    m[2:10, 2:12] = True
    m[4:7, 4:7] = False
    assert raster.fill_holes(m).sum() == 80
    out = raster.outline(m)
    assert sorted(out) == sorted([(2, 2), (12, 2), (12, 10), (2, 10)])
    line = raster.draw((5, 9), [np.array([[0, 0], [8, 4]])])
    assert line.sum() == 9 and line[0, 0] and line[4, 8]
    assert raster.polygon_mask((4, 4), [np.array([[0, 0], [3, 0], [3, 3], [0, 3]])]).sum() == 9
    a = np.zeros((20, 20), dtype=bool)
    a[3:9, 5:8] = True
    a[3, 5:12] = True
    turn, dr, dc, score = raster.correlate(a, np.roll(np.rot90(a, -1), (2, 1), (0, 1)))
    assert turn == 1 and score > 0.99
    plus = np.zeros((21, 21), dtype=bool)
    plus[10, 2:19] = plus[2:19, 10] = True
    nodes, chains = raster.trace(plus)
    assert len(nodes) == 5 and len(chains) == 4
    loop = np.zeros((9, 9), dtype=bool)
    loop[2:7, 2:7] = True
    loop[3:6, 3:6] = False
    loop[2, 2] = loop[2, 6] = loop[6, 2] = loop[6, 6] = False
    nodes, chains = raster.trace(loop)
    assert len(chains) == 1 and chains[0][0] == chains[0][1]


def test_lines(spark):
    rng = np.random.default_rng(1)
    p = np.cumsum(rng.normal(size=(200, 2)), axis=0)
    s = polyline.simplify_line(p, 1.0)
    assert (s[0] == p[0]).all() and (s[-1] == p[-1]).all() and 2 < len(s) < 200

    def off(q, a, b):
        d = b - a
        t = np.clip((q - a) @ d / (d @ d), 0, 1)
        return np.hypot(*(q - a - t * d))

    kept = [int(np.flatnonzero((p == x).all(axis=1))[0]) for x in s]
    assert all(off(p[k], p[i], p[j]) <= 1.0 + 1e-9 for i, j in zip(kept, kept[1:], strict=False) for k in range(i, j))
    a, b, c = np.array([[0, 0], [1, 0.0]]), np.array([[2, 0], [1, 0.2]]), np.array([[-1, 0], [0, 0.1]])
    assert polyline.chain_lines([a, b, c]).tolist() == [[-1, 0], [0, 0], [1, 0], [2, 0]]
    assert polyline.chain_lines([a, a + 50]) is None
    square = [np.array(x, dtype=float) for x in ([[0, 0], [1, 0]], [[1, 1], [1, 0]], [[1, 1], [0, 1]], [[0, 0], [0, 1]], [[9, 9], [8, 8]])]
    assert [len(r) for r in polyline.rings_of(square)] == [5]
    frame = spark.createDataFrame([(1, i, [tuple(map(float, q)) for q in x]) for i, x in enumerate(square)], "id int, ord int, points array<struct<x:double,y:double>>")
    assert [len(r.points) for r in polyline.assemble_rings(frame, "id").collect()] == [5]
    assert polyline.join_items(frame, "id").count() == 5


def test_floor_graph_rooms_and_shafts(spark):
    box = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    walls = [box(0.0, 0.0, 12.0, 8.0), [(5.0, 0.0), (5.0, 8.0)]]
    doors = [[(5.0, 3.6), (5.0, 4.6)]]
    P = "array<array<struct<x:double,y:double>>>"
    plans = spark.createDataFrame([("A", 0.0, walls, doors, [box(-1.0, -1.0, 13.0, 9.0)]), ("B", 0.0, [], [], [])], f"code string, level double, walls {P}, doors {P}, rings {P}")
    got = {r.code: r for r in indoor.level_graphs(plans, 0.2).collect()}
    assert got["A"].status == "ok" and got["A"].nodes and got["A"].edges and got["B"].status != "ok"
    assert [r.node is not None for r in got["A"].rooms] == [True] and 20 < got["A"].rooms[0].area < 45
    strokes = spark.createDataFrame([("A", "stair", lv, r, c) for lv in (0.0, 1.0) for r in range(20) for c in range(20) if r in (0, 19) or c in (0, 19)], "code string, kind string, level double, r int, c int")
    s = indoor.shafts(strokes, 0.1).collect()
    assert len(s) == 1 and s[0].levels == [0.0, 1.0] and abs(s[0].area - 4) < 0.5
    stops = spark.createDataFrame([("A", "stair", 0, 0.0, 5, 0.0, 3.0), ("A", "stair", 0, 1.0, 7, 4.0, 3.0), ("A", "elevator", 1, 1.0, 7, 4.0, 3.0)], "code string, kind string, shaft int, level double, node int, elev double, diagonal double")
    e = indoor.vertical_edges(stops).collect()
    assert [(x.a_node, x.b_node, x.m) for x in e] == [(5, 7, 3 * 1.8 + 4)]
    assert indoor.single_level_shafts(stops).count() == 1


def test_fit_finds_a_turned_and_moved_plan(spark):
    plan = np.argwhere(raster.polygon_mask((30, 40), [np.array([[2, 2], [36, 2], [36, 12], [18, 12], [18, 26], [2, 26]])]))[:, ::-1].astype(float) + 0.5
    v = np.array([0.8, 25.0, 100.0, -40.0])
    corners = georef._place(np.array([[2, 2], [36, 2], [36, 12], [18, 12], [18, 26], [2, 26]], dtype=float), v)
    every = georef.fit_one(plan, 1.0, [corners], 0.0)
    best = every[0]
    assert len(every) == 4 and len({round(x["degrees"] / 90) for x in every}) == 4
    assert best["score"] > 0.9 and abs((best["degrees"] - 25 + 180) % 360 - 180) < 2 and abs(best["scale"] - 0.8) < 0.03
    plans = spark.createDataFrame([("A", float(x), float(y)) for x, y in plan], "code string, x double, y double")
    prints = spark.createDataFrame([("A", [[tuple(map(float, q)) for q in corners]])], "code string, rings array<array<struct<x:double,y:double>>>")
    angles = spark.createDataFrame([("A", 0.0)], "code string, angle double")
    assert georef.fit(plans, prints, 1.0, angles).agg(F.max("score").alias("s")).first().s > 0.9
    frame = spark.createDataFrame([("A", 25.0, 0.95), ("A", 205.0, 0.7), ("A", 30.0, 0.94), ("B", 10.0, 0.5)], "code string, degrees double, score double")
    got = {r.code: (r.best, round(r.margin, 6), r.method) for r in georef.accept(frame, spark.createDataFrame([("A", 2.0), ("B", 9.0)], "code string, residual double")).collect()}
    assert got == {"A": (0.95, 0.25, "auto"), "B": (0.5, 1.0, "needs-review")}

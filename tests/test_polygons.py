import math
import random

from wayfold.operators import spatial

RING = "array<struct<x:double,y:double>>"


def star(rng, x, y, r):
    n = rng.randint(3, 9)
    return [(x + r * rng.uniform(0.3, 1) * math.cos(2 * math.pi * i / n), y + r * rng.uniform(0.3, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]


def test_a_cover_gives_the_rows_of_the_parity_test(spark):
    rng = random.Random(6)
    shapes = [(i, star(rng, rng.uniform(-300, 300), rng.uniform(-300, 300), rng.uniform(5, 200))) for i in range(30)] + [(99, [(0.0, 0.0), (64.0, 0.0), (64.0, 64.0), (0.0, 64.0)])]
    spots = [(i, rng.uniform(-400, 400), rng.uniform(-400, 400)) for i in range(3000)] + [(10_000 + i * 9 + j, 8.0 * i, 8.0 * j) for i in range(9) for j in range(9)]  # on edges and corners of cells
    polygons, points = spark.createDataFrame(shapes, f"pid int, ring {RING}"), spark.createDataFrame(spots, "id int, x double, y double")
    want = {(r.id, r.pid) for r in spatial.polygons_at_points(points, polygons, 64.0).collect()}
    for depth in (0, 2, 4):
        got = spatial.polygons_by_cover(points, spatial.cover(polygons, 64.0, depth), 64.0, depth).collect()
        assert len(got) == len({(r.id, r.pid) for r in got}) and {(r.id, r.pid) for r in got} == want
        tested = sum(r.tested for r in got)
        assert tested < (1.0, 0.5, 0.3)[depth // 2] * len(want) + 1
    assert spatial.polygons_by_cover(points.limit(0), spatial.cover(polygons, 64.0), 64.0).collect() == []


def near(a, b):
    """Nearest points of two rings, vertices of either against edges of the other."""
    best = (1e18, None, None)
    for side, (p, q) in enumerate(((a, b), (b, a))):
        for x, y in p:
            for (x1, y1), (x2, y2) in zip(q, q[1:] + q[:1], strict=True):
                n = (x2 - x1) ** 2 + (y2 - y1) ** 2
                t = max(0, min(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / n)) if n else 0
                at = (x1 + t * (x2 - x1), y1 + t * (y2 - y1))
                d = math.hypot(x - at[0], y - at[1])
                if d < best[0] - 1e-12:
                    best = (d, (x, y), at) if side == 0 else (d, at, (x, y))
    return best


def test_nearest_outlines_equal_brute_force(spark):
    rng = random.Random(7)
    left = [(i, star(rng, rng.uniform(0, 4000), rng.uniform(0, 4000), 30)) for i in range(60)] + [(900, star(rng, 90_000.0, -70_000.0, 20))]
    right = [(i, star(rng, rng.choice([0, 3000]) + rng.uniform(0, 900), rng.uniform(0, 4000), 25)) for i in range(500)]
    frame = lambda rows: spark.createDataFrame(rows, f"id int, ring {RING}")
    got = {r.id: r for r in spatial.nearest_outlines(frame(left), frame(right), 50.0).collect()}
    assert len(got) == len(left)
    for i, ring in left:
        d, p, q = near(ring, right[got[i].near_id][1])
        assert abs(got[i].d - d) < 1e-9 and math.dist(p, tuple(got[i].p)) < 1e-6 and math.dist(q, tuple(got[i].q)) < 1e-6
        assert all(math.hypot(ring[0][0] - o[0][0], ring[0][1] - o[0][1]) - 110 > d or near(ring, o)[0] >= d - 1e-9 for _, o in right)
    assert spatial.nearest_outlines(frame(left), frame([]), 50.0).collect() == []


def test_residuals_equal_all_pairs(spark):
    from wayfold.operators import georef

    rng = random.Random(3)
    points = [(k, rng.uniform(-100, 100), rng.uniform(-100, 100)) for k in "ab" for _ in range(300)] + [("a", 5000.0, 0.0), ("c", 0.0, 0.0)]
    border = [(k, rng.uniform(-30, 30), rng.uniform(-30, 30)) for k in "ab" for _ in range(80)]
    frame = lambda rows: spark.createDataFrame(rows, "code string, x double, y double")
    got = {r.code: r.residual for r in georef.residual(frame(points), frame(border), ("code",)).collect()}
    want = {k: [min(math.dist(p[1:], b[1:]) for b in border if b[0] == k) for p in points if p[0] == k] for k in "ab"}
    assert got.keys() == want.keys() and all(abs(got[k] - sum(v) / len(v)) < 1e-9 for k, v in want.items())
    every = [min(math.dist(p[1:], b[1:]) for b in border) for p in points]
    assert abs(georef.residual(frame(points).drop("code"), frame(border).drop("code")).first().residual - sum(every) / len(every)) < 1e-9


def test_crossing_edges_of_outlines_never_meet(spark):
    """Long edges stand only in the cells that they touch, and each of these once."""
    shape = "r int, r_e int, r_s struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>"
    edges = spark.createDataFrame([(1, 0, ((0.5, 0.5), (99.5, 99.5))), (2, 0, ((3.5, 80.5), (3.5, 0.5))), (3, 0, ((-9.5, 2.5), (9.5, 2.5)))], shape)
    from pyspark.sql import functions as F

    cells = [tuple(r) for r in spatial._touched(edges, "r", 1.0, F.lit(0.0)).select("r", "cx", "cy").collect()]
    assert len(cells) == len(set(cells)) and {(1, i, i) for i in range(100)} | {(2, 3, i) for i in range(81)} | {(3, i, 2) for i in range(-10, 10)} <= set(cells)
    assert len(cells) < 420  # the box of the first alone has 10,000
    padded = {tuple(r) for r in spatial._touched(edges.where("r = 3"), "r", 1.0, F.lit(1.2)).select("cx", "cy").collect()}
    assert padded == {(x, y) for x in range(-11, 11) for y in range(1, 4)}

from pyspark.sql import functions as F

from wayfold.operators import indoor, lookup, quality, spatial

RING = "array<array<struct<x:double,y:double>>>"


def test_paths_enter_at_either_end(spark):
    box = [[(0.0, 0.0), (40.0, 0.0), (40.0, 40.0), (0.0, 40.0)]]
    rows = spark.createDataFrame([(1, [(-10.0, 20.0), (-20.0, 20.0)], box, (20.0, 20.0)), (2, [(5.0, 5.0), (-20.0, 20.0)], box, (20.0, 20.0))], f"id int, path array<struct<x:double,y:double>>, rings {RING}, centroid struct<x:double,y:double>")
    at_start = {r.id: [tuple(p) for p in r.path] for r in spatial.enter(rows, at_start=True).collect()}
    assert at_start[1] == [(12.0, 20.0), (0.0, 20.0), (-10.0, 20.0), (-20.0, 20.0)] and len(at_start[2]) == 2
    turned = {r.id: [tuple(p) for p in r.path] for r in spatial.enter(rows.withColumn("path", F.reverse("path"))).collect()}
    assert turned[1] == at_start[1][::-1]


def test_only_valid_codes_are_taken_over(spark):
    old = spark.createDataFrame([("A", 1)], "code string, v int")
    new = spark.createDataFrame([("A", 2), ("../B", 3), ("C 1", 4)], "code string, v int")
    assert sorted(map(tuple, indoor.upsert_coded(old, new).collect())) == [("A", 2), ("C 1", 4)]


def test_pages_of_any_size_are_grouped(spark):
    ink = spark.createDataFrame([("a", r, c) for r in range(10) for c in range(10)] + [("b", 10**6 + r, -3 - c) for r in range(8) for c in range(8)] + [("b", 3 * 10**6, 5)], "page string, r int, c int")
    got = {r.page: (r.r0, r.c0, r.r1, r.c1, r.ink) for r in lookup.text_groups(ink, "page").collect()}
    assert got == {"a": (0, 0, 9, 9, 100), "b": (10**6, -10, 10**6 + 7, -3, 64)}


def test_selection_and_split_levels(spark):
    b = spark.createDataFrame([("A", "auto"), ("B", "no-footprint"), ("C", None)], "code string, method string")
    codes = lambda df: sorted(r.code for r in df.collect())
    assert codes(quality.chosen(b)) == ["A", "B", "C"] and codes(quality.chosen(b, registered=True)) == ["A"]
    assert codes(quality.chosen(b, ["B"], core=["C"])) == ["B"] and codes(quality.chosen(b, core=["C"])) == ["C"]
    nodes = spark.createDataFrame([("A", 0.0, i) for i in range(4)], "code string, level double, i int")
    edges = spark.createDataFrame([("A", 0.0, 0, 1), ("A", 0.0, 2, 3)], "code string, level double, a int, b int")
    assert [tuple(r) for r in quality.split_levels(nodes, edges).collect()] == [("A", 0.0, 2)]


def test_dense_cells_are_cut(spark):
    """The nearest rows as by brute force, but of a crowd in one cell a row meets only some."""
    import math
    import random

    rng = random.Random(5)
    right = [(i, i % 2, float(rng.randint(0, 60)), float(rng.randint(0, 60))) for i in range(3000)] + [(9000 + i, 1, 70.0 + rng.random() / 100, -150.0) for i in range(500)] + [(8000 + i, 0, -90.25, 40.5) for i in range(300)]
    left = [(i, i % 2, rng.uniform(-150, 150), rng.uniform(-150, 150)) for i in range(300)] + [(900, 1, 75.0, -150.0), (901, 0, 9e5, -9e5), (902, 0, 9.75, 40.5), (903, 7, 0.0, 0.0)]
    frame = lambda rows: spark.createDataFrame(rows, "id int, k int, x double, y double")
    for cap, strict in ((100.0, True), (100.0, False), (7.0, True)):
        want = {}
        for i, k, x, y in left:
            d, n = min((math.hypot(x - a, y - b), j) for j, q, a, b in right if q == k or k == 7)
            if k != 7 and (d < cap or d == cap and not strict):
                want[i] = (round(d, 9), n)
        found = spatial.nearest_capped(frame(left), frame(right), cap, ("k",), strict)
        assert {r.id: (round(r.d, 9), r.near_id) for r in found.collect()} == want
    plan = spatial.nearest_capped(frame(left), frame(right), 100.0)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan

import json

import pytest
from pyspark.sql import functions as F

from wayfold.operators import indoor, lookup, quality
from wayfold.sources import landing, maps, sinks


def test_links_round_trip(spark, tmp_path):
    feature = {"type": "Feature", "properties": {"id": "ab", "from": "A", "to": "B", "kind": "tunnel", "z_m": -3, "verified": True, "length_m": 9}, "geometry": {"type": "LineString", "coordinates": [[-80.5, 43.4], [-80.6, 43.5]]}}
    path = tmp_path / "links.json"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [feature]}))
    rows = maps.links(spark, str(path))
    r = rows.first()
    assert r.id == "ab" and r.geom[1].lat == 43.5 and r.status is None
    text = json.loads(sinks.collection(rows, "id").first().value)
    assert text["features"][0]["geometry"] == feature["geometry"] and text["features"][0]["properties"]["kind"] == "tunnel"


def test_buildings_merge_by_code(spark, tmp_path):
    ring = lambda x: [[x, 43.0], [x + 0.001, 43.0], [x, 43.001], [x, 43.0]]
    fs = [
        {"type": "Feature", "id": 1, "properties": {"osm_id": 1, "name": "First", "code": "A"}, "geometry": {"type": "Polygon", "coordinates": [ring(-80.0), ring(-80.0)]}},
        {"type": "Feature", "id": 2, "properties": {"osm_id": 2, "name": "Second", "code": "A"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring(-80.1)], [ring(-80.2)]]}},
        {"type": "Feature", "id": 3, "properties": {"osm_id": 3, "name": "None"}, "geometry": {"type": "Polygon", "coordinates": [ring(-80.3)]}},
    ]
    path = tmp_path / "b.json"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": fs}))
    b = maps.buildings(spark, str(path))
    got = maps.coded_buildings(b).collect()
    assert len(got) == 1 and got[0].name == "First" and len(got[0].rings) == 3
    assert lookup.label_points(b).count() == 2


def test_elements(spark, tmp_path):
    g = [{"lon": -80.0 + i, "lat": 43.0} for i in range(4)]
    es = [
        {"type": "relation", "id": 1, "tags": {"building": "yes", "short_name": "R", "operator": "Owner U"}, "members": [{"type": "way", "role": "outer", "geometry": g}, {"type": "way", "role": "inner", "geometry": g}]},
        {"type": "way", "id": 2, "tags": {"building": "yes", "name": "Old Hall of the owner u", "height": "9 m"}, "geometry": g},
        {"type": "way", "id": 3, "tags": {"building": "yes"}, "geometry": g[:3]},
        {"type": "way", "id": 4, "tags": {"highway": "steps", "level": "1"}, "geometry": g},
        {"type": "node", "id": 5},
    ]
    path = tmp_path / "e.json"
    path.write_text(json.dumps({"elements": es}))
    e = maps.elements(spark, str(path))
    f = {r.osm_id: r for r in maps.footprints(e, {"Old Hall of the owner u": "OH"}, "Owner U").collect()}
    assert set(f) == {1, 2} and f[1].code == "R" and f[2].code == "OH" and f[2].height_m == 9 and f[1].height_m == 12
    assert f[1].campus and f[2].campus and len(f[1].lines) == 1
    assert [r.highway for r in maps.ways(e).collect()] == ["steps"]


def test_floors_compact_and_back(spark, tmp_path):
    rows = spark.createDataFrame([("A", 0.0, 100.0, 200.0, [(101.24, 203.0, "corridor"), (99.0, 201.5, "passage")], [[(100.0, 200.0), (105.0, 200.0)]])], "code string, level double, ox double, oy double, nodes array<struct<x:double,y:double,kind:string>>, walls array<array<struct<x:double,y:double>>>")
    c = indoor.compact(rows)
    sinks.write_floors(c, str(tmp_path / "f"))
    back = indoor.expand(spark.read.parquet(str(tmp_path / "f")).where("code = 'A'")).orderBy("i").collect()
    assert [(round(r.x, 6), r.y, r.kind) for r in back] == [(101.2, 203.0, "corridor"), (99.0, 201.5, "passage")]


def test_upsert_and_rooms(spark):
    old = spark.createDataFrame([("A", 1.0, "auto"), ("B", 2.0, "auto")], "code string, tx double, method string")
    new = spark.createDataFrame([("B", None, "manual"), ("C", 3.0, "manual")], "code string, tx double, method string")
    assert {tuple(r) for r in indoor.upsert(old, new, "code").collect()} == {("A", 1.0, "auto"), ("B", 2.0, "manual"), ("C", 3.0, "manual")}
    rooms = spark.createDataFrame([("A", 1.0, 0, "20 01a", 4), ("A", 0.0, 1, "2001A", None), ("A", 2.0, 0, "2001A", 5), ("A", 0.0, 2, None, 1)], "code string, level double, ord int, number string, node int")
    assert indoor.find_room(rooms, "A", " 2001 a").first().node == 4
    assert {(r.code, r.named, r.total) for r in indoor.room_coverage(rooms).collect()} == {("A", 3, 4), (None, 3, 4)}
    known = spark.createDataFrame([("A",), ("B",)], "code string")
    asked = spark.createDataFrame([("a", "b", None), ("a", "a", None), ("a", "A", "1"), ("", "b", None), ("a", "z", None)], "from string, to string, room string")
    assert sorted(str(r.problem) for r in lookup.check_request(asked, known).collect()) == ["None", "None", "missing end", "same building", "unknown building"]


def test_landing_retries_and_keeps(spark, tmp_path):
    calls = []

    def fetch():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return '{"a": 1}'

    for _ in range(2):
        assert landing.landed(spark, str(tmp_path / "x"), fetch, "a int", wait=0).first().a == 1
    assert len(calls) == 3
    with pytest.raises(OSError):
        landing.landed(spark, str(tmp_path / "y"), lambda: (_ for _ in ()).throw(OSError("gone")), "a int", wait=0)


def test_plan_corpus_and_text_groups(spark):
    d = spark.createDataFrame([("A_02FLR.pdf", "WALL", 5), ("A_02FLR.pdf", "ROOM_NO", 2), ("B.pdf", None, 3)], "file string, layer string, items int")
    names = spark.createDataFrame([("A_02FLR.pdf", "Roof"), ("B.pdf", "Basement")], "file string, label string")
    got = {r.file: r for r in maps.plan_corpus(d, names).collect()}
    assert got["A_02FLR.pdf"].tier == "A" and got["A_02FLR.pdf"].level == 1 and got["A_02FLR.pdf"].per_class == {"wall": 5, "room_no": 2}
    assert got["B.pdf"].tier == "C" and got["B.pdf"].level == -1
    ink = spark.range(100).select(F.lit("p").alias("page"), (F.col("id") % 10).alias("r"), (F.floor(F.col("id") / 10) + F.when(F.col("id") >= 90, 60).otherwise(0)).alias("c"))
    assert [r.ink for r in lookup.text_groups(ink, "page").collect()] == [90]


def test_quality_rules(spark):
    links = spark.createDataFrame([("A", "B"), ("C", "B")], "from string, to string")
    need = spark.createDataFrame([("B", "A"), ("A", "C")], "a string, b string")
    assert [tuple(r) for r in quality.missing_pairs(need, links).collect()] == [("A", "C")]
    nodes = spark.createDataFrame([("A", 0.0, i) for i in range(4)], "code string, level double, i int")
    edges = spark.createDataFrame([("A", 0.0, 0, 1), ("A", 0.0, 2, 3), ("A", 0.0, 3, 9)], "code string, level double, a int, b int")
    assert quality.split_levels(nodes, edges.where("b < 9")).first().parts == 2
    assert [r.i for r in quality.dangling(edges, nodes).collect()] == [9]
    arcs = spark.createDataFrame([("a", "b"), ("b", "a")], "a string, b string")
    assert [r.id for r in quality.unreachable(arcs, spark.createDataFrame([("a",), ("b",), ("c",)], "id string")).collect()] == ["c"]

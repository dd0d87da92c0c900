import json

import pytest
from pyspark.sql import functions as F

from wayfold.operators import journeys
from wayfold.sources import indoor

FILE = {
    "code": "A B", "origin": [-80.5, 43.5], "floorHeightM": 4,
    "levels": [
        {"level": 0, "label": "1st Floor", "elevM": 0, "nodes": [0, 0, 500, 0], "kinds": "cp", "edges": [[0, 1, 500, [0, 0, 250, 7, 500, 0]]], "rooms": [{"n": "101", "q": 0.9, "a": 12, "v": 1, "p": [0, 0, 10, 0, 10, 10]}, {"n": None, "q": 0, "a": 3, "v": None, "p": []}],
         "walls": [[0, 0, 5, 5]], "slabs": [[0, 0, 9, 0, 9, 9]], "stairs": [{"id": "s1", "v": 0, "c": [3, 4], "bbox": [0, 0, 6, 8]}], "elevators": [{"id": "e1", "v": None, "c": [1, 1], "bbox": []}], "areaM2": 50.5, "tier": "A"},
        {"level": 1.5, "label": "Mezzanine", "elevM": 6, "nodes": [], "kinds": "", "edges": [], "rooms": [], "walls": [], "stairs": [], "elevators": [], "areaM2": 0},
    ],
    "vertical": [{"kind": "stair", "shaft": "s1", "a": [0, 0], "b": [1.5, None], "m": 9.5, "rise": 6}],
}


def test_every_part_of_a_file(spark, tmp_path):
    (tmp_path / "A B.json").write_text(json.dumps(FILE))
    part = lambda p: [tuple(r) for r in indoor.read(spark, str(tmp_path), p).collect()]
    assert part("levels") == [("A B", 0.0, "1st Floor", 0.0, 2, "A", 50.5, 0), ("A B", 1.5, "Mezzanine", 6.0, 0, None, 0.0, 1)]
    assert [r[:3] + (r[5],) for r in part("nodes")] == [("A B", 0.0, 0, "corridor"), ("A B", 0.0, 1, "passage")]
    (edge,) = part("edges")
    assert edge[:5] == ("A B", 0.0, 0, 1, 50.0) and len(edge[5]) == 3
    assert [(r[3], r[6], len(r[7])) for r in part("rooms")] == [("101", 1, 3), (None, None, 0)]
    assert len(part("walls")[0][3]) == 2 and len(part("slabs")[0][3]) == 3
    stair, lift = part("shafts")
    assert stair[2:5] == ("stair", "s1", 0) and stair[7] < stair[5] < stair[9] and lift[4] is None and lift[7:] == (*lift[5:7], *lift[5:7])
    assert part("verticals") == [("A B", "stair", "s1", 0.0, 0, 1.5, None, 9.5, 6.0)]


def test_only_files_asked_for_are_opened(spark, tmp_path):
    (tmp_path / "A.json").write_text(json.dumps(FILE | {"code": "A"}))
    (tmp_path / "B.json").write_text("this is no JSON and fails when it is read")
    nodes = indoor.read(spark, str(tmp_path), "nodes")
    with pytest.raises(Exception, match="JSON"):
        nodes.collect()
    assert nodes.where("code = 'A'").count() == 2
    assert nodes.where(F.col("code").isin("A", "C")).count() == 2 and nodes.where("code = 'A' AND code = 'C'").count() == 0
    assert indoor.read(spark, str(tmp_path), "levels").where("code = 'A' AND level = 1.5").count() == 1
    assert indoor.read(spark, str(tmp_path), "nodes").where("code = 'A' AND level = 0.0 AND i > 0").count() == 1
    chosen = spark.createDataFrame([("A",), (None,), ("A",)], "code string")
    assert indoor.read_of(spark, str(tmp_path), "edges", chosen).count() == 1
    assert indoor.read_of(spark, str(tmp_path), "edges", chosen.where("false")).count() == 0


def test_a_round_trip_can_be_routed_on(spark, tmp_path):
    places = spark.createDataFrame([(c, lv, i, -80.5 + 0.0001 * i, 43.5 + 0.0001 * lv, "corridor" if i % 2 else "passage") for c in ("M C", "E5") for lv in (0.0, 1.0) for i in range(12)], indoor.PARTS["nodes"])
    pair = places.withColumn("path", F.array(F.struct("lon", "lat"), F.struct((F.col("lon") + 0.0001).alias("lon"), "lat")))
    edges = pair.where("i < 11").select("code", "level", F.col("i").alias("a"), (F.col("i") + 1).alias("b"), F.lit(8.04).alias("m"), "path")
    levels = spark.createDataFrame([(c, lv, "L", lv * 4, 12, "A", None, int(lv)) for c in ("M C", "E5") for lv in (0.0, 1.0)], indoor.PARTS["levels"])
    verticals = spark.createDataFrame([("M C", "stair", "s", 0.0, 3, 1.0, 4, 9.0, 4.0), ("M C", "stair", "t", 0.0, None, 1.0, 4, 9.0, 4.0)], indoor.PARTS["verticals"])
    walls = pair.where("i = 0").select("code", "level", F.col("i").alias("ord"), F.col("path").alias("line"))
    rooms = pair.where("i = 2").select("code", "level", F.lit(0).alias("ord"), F.lit("1\"01").alias("number"), F.lit(0.5).alias("conf"), F.lit(7.0).alias("area"), F.col("i").alias("node"), F.col("path").alias("poly"))
    out = str(tmp_path / "floors")
    indoor.write(levels, places, edges, verticals, walls, rooms, out)
    back = {p: indoor.read(spark, out, p).where("code = 'M C'") for p in indoor.PARTS}
    assert [back[p].count() for p in ("levels", "nodes", "edges", "rooms", "walls", "verticals")] == [2, 24, 22, 2, 2, 2]
    old = {(r.level, r.i): r for r in places.where("code = 'M C'").collect()}
    for r in back["nodes"].collect():
        o = old[r.level, r.i]
        assert abs(r.lon - o.lon) < 1e-6 and abs(r.lat - o.lat) < 1e-6 and r.kind == o.kind
    assert back["rooms"].first().number == '1"01' and {r.m for r in back["edges"].collect()} == {8.0}
    links = spark.createDataFrame([], "id string, from string, to string, kind string, z_m int, name string, status string, verified boolean, notes string, length_m int, geom array<struct<lon:double,lat:double>>")
    nodes = spark.createDataFrame([("X:M C", "M C", -80.5, 43.5)], "id string, building string, lon double, lat double")
    fine = journeys.floor_arcs(nodes, links, back["edges"], back["verticals"].drop("shaft", "rise"), back["levels"].select("code", "level", "elev", "nodes", "ord"), back["nodes"].select("code", "level", "i", "lon", "lat"))
    coarse = journeys.coarse_arcs(nodes, spark.createDataFrame([], "a string, b string, kind string, link string, m double"), links)
    asked = spark.createDataFrame([(1, "X:M C", "I:M C:1:6")], "req int, source string, target string")
    assert [r.kind for r in journeys.solve(coarse, fine, asked, nodes).orderBy("hop").collect()] == ["walk"] * 4 + ["vertical"] + ["walk"] * 2

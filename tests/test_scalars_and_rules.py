import math

import pytest
from pyspark.sql import functions as F

from wayfold.functions import rules as R
from wayfold.functions import scalars as S


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("x,up,even", [(-2.5, -2, -2), (2.5, 3, 2), (-0.5, 0, 0), (1.4, 1, 1), (3.5, 4, 4)])
def test_rounding(spark, x, up, even):
    assert one(spark, S.round_up(F.lit(x))) == up
    assert one(spark, S.round_even(F.lit(x))) == even


def test_projection_and_vectors(spark):
    p = F.struct(F.lit(-80.5).alias("lon"), F.lit(43.47).alias("lat"))
    back = one(spark, S.to_lonlat(S.to_metric(p)))
    assert (back.lon, back.lat) == (-80.5, 43.47)
    pt = lambda x, y: S.point(float(x), float(y))
    q = one(spark, S.nearest_on_segment(pt(5, 5), pt(0, 0), pt(10, 0)))
    assert (q.x, q.y) == (5, 0)
    q = one(spark, S.nearest_on_segment(pt(5, 5), pt(1, 1), pt(1, 1)))
    assert (q.x, q.y) == (1, 1)
    assert one(spark, S.unit(pt(0, 0))).x == 0
    assert one(spark, S.bearing(F.lit(-1.0), F.lit(0.0))) == 270
    o = one(spark, S.offset(pt(0, 0), 90.0, 5.0))
    assert abs(o.x - 5) < 1e-9 and abs(o.y) < 1e-9


def test_affine_parts(spark):
    m = S.matrix(F.lit(2.0), F.lit(30.0), F.lit(True))
    d = one(spark, S.decompose(m))
    assert abs(d.scale - 2) < 1e-9 and abs(d.degrees - 30) < 1e-9 and d.mirror
    moved = one(spark, S.rigid(S.point(1.0, 0.0), F.lit(90.0), S.point(0.0, 0.0), 1.0, 2.0, False))
    assert (moved.x, moved.y) == (1, 0)


@pytest.mark.parametrize("level,name", [(0.0, "1st Floor"), (1.0, "2nd Floor"), (2.0, "3rd Floor"), (10.0, "11th Floor"), (20.0, "21st Floor"), (0.5, "Mezzanine (level 0.5)"), (-1.0, "Basement"), (-1.5, "Level -1.5"), (-2.0, "Level -2")])
def test_floor_name(spark, level, name):
    assert one(spark, S.floor_name(F.lit(level))) == name


def test_codec_and_polylines(spark):
    pts = F.array(*(S.point(x, y) for x, y in ((0.04, 0.0), (3.06, 4.0), (3.0, 10.0))))
    flat = one(spark, S.quantise(pts))
    assert flat == [0, 0, 31, 40, 30, 100]
    assert [(p.x, p.y) for p in one(spark, S.dequantise(S.quantise(pts)))] == [(0, 0), (3.1, 4), (3, 10)]
    assert one(spark, S.dequantise(F.array().cast("array<int>"))) == []
    assert abs(one(spark, S.length(pts)) - (math.hypot(3.02, 4) + math.hypot(0.06, 6))) < 1e-9
    assert one(spark, S.length(F.slice(pts, 1, 1))) == 0
    assert one(spark, S.middle(pts)).y == 4
    curve = one(spark, S.bezier(*(S.point(float(x), float(y)) for x, y in ((0, 0), (0, 1), (1, 1), (1, 0)))))
    assert len(curve) == 6 and (curve[-1].x, curve[-1].y) == (1, 0) and abs(curve[2].x - 0.5) < 1e-9
    quads = one(spark, S.wall_quads(pts))
    assert len(quads) == 2 and len(quads[0]) == 4


def test_point_in_ring_is_half_open(spark):
    ring = F.array(*(S.point(float(x), float(y)) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4))))
    for (x, y), want in {(2, 2): True, (0, 0): True, (4, 4): False, (5, 1): False, (-1, 2): False}.items():
        assert one(spark, S.inside(S.point(float(x), float(y)), ring)) is want
    assert one(spark, S.within(S.point(5.0, 2.0), F.array(ring), 1.0)) and not one(spark, S.within(S.point(5.1, 2.0), F.array(ring), 1.0))


@pytest.mark.parametrize("label,file,want", [("1st Floor", None, 0), ("Basement", None, -1), ("Midlevel Basement", None, -1.5), ("Mezzanine", None, 0.5), ("2nd Floor Mezzanine", None, 1.5), ("Link", None, 0), ("Penthouse", None, 90), ("Beck Hall 3rd Floor", None, 2), ("Roof", "A_05FLR.pdf", 4), ("Roof", "A_B1FLR.pdf", -1), ("Roof", "A_MBFLR.pdf", -1.5), ("Roof", "A_00FLR.pdf", 0), ("Roof", "A_02FLR_MEZ.pdf", 1.5), ("Roof", "A_0M_MEZ.pdf", 0.5), ("Roof", "A_0B_CON.pdf", -1), ("Roof", "x.pdf", None)])
def test_levels(spark, label, file, want):
    assert one(spark, R.level(F.lit(label), F.lit(file).cast("string"))) == want


def test_rules(spark):
    for layer, want in {"B-BP-WALL": "wall", "B-SP-ROOM_NO": "room_no", "": "unlayered", None: "unlayered", "x": "other", "a stair": "stair"}.items():
        assert one(spark, R.layer_class(F.lit(layer).cast("string"))) == want
    for h, n, want in ((14.0, 4.0, 3.5), (30.0, 3.0, 4.0), (None, 4.0, 4.0), (9.0, 0.0, 4.0)):
        assert one(spark, R.floor_height(F.lit(h).cast("double"), F.lit(n))) == want
    for t, level, want in (("3021", 2.0, True), ("302", 5.0, True), ("A1", 1.0, False), ("2021", 2.0, False), ("9999", -1.0, True)):
        assert one(spark, R.plausible_room(F.lit(t), F.lit(level))) is want
    for h, n, want in (("12 m", None, 12), (None, "3", 10.5), ("tall", "x", 12)):
        assert one(spark, R.building_height(F.lit(h).cast("string"), F.lit(n).cast("string"))) == want
    assert one(spark, R.building_code(F.lit("IHB-X - Some Name"))) == "IHBX"
    assert one(spark, S.escape_html(F.lit("<a & 'b'>"))) == "&lt;a &amp; 'b'&gt;"
    assert one(spark, R.matches("", F.lit("x"))) and not one(spark, R.matches("y", F.lit("x")))
    s = one(spark, R.link_style(F.lit("tunnel"), F.lit("open"), F.lit("a"), "b"))
    assert (s.r, s.g, s.b, s.a, s.width) == (255, 140, 26, 89, 3.2)

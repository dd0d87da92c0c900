"""Column functions: rounding, projection, vectors, affine maps, names, codecs and polylines.

Points are structs: (lon, lat) in degrees, (x, y) in metres. Polylines are arrays
of points. Everything here is a native expression, so it stays inside codegen.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the map projection (equirectangular about one latitude).
LAT0 = 43.471
MX = 111320 * math.cos(math.radians(LAT0))
MY = 110574.0


def c(x: Column | str | float) -> Column:
    """A column by name or value."""
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


# rounding ---------------------------------------------------------------------------------------------------------


def round_up(x: Column | str) -> Column:
    """Halves go up, for negative values too (-2.5 to -2)."""
    return F.floor(c(x) + F.lit(0.5))


def round_even(x: Column | str, digits: int = 0) -> Column:
    """Halves go to the even neighbour."""
    return F.bround(c(x), digits)


def round_to(x: Column | str, step: int) -> Column:
    """The nearest multiple of step, halves up."""
    return round_up(c(x) / F.lit(step)) * F.lit(step)


def clamp(x: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(c(x), F.lit(low)), F.lit(high))


# projection and vectors -------------------------------------------------------------------------------------------


def point(x: Column | str | float, y: Column | str | float) -> Column:
    return F.struct(c(x).alias("x"), c(y).alias("y"))


def to_metric(p: Column | str) -> Column:
    """(lon, lat) to metres."""
    p = c(p)
    return point(p["lon"] * MX, p["lat"] * MY)


def to_lonlat(p: Column | str, digits: int | None = 7) -> Column:
    """Metres to (lon, lat), rounded to digits unless None."""
    p = c(p)
    lon, lat = p["x"] / MX, p["y"] / MY
    if digits is not None:
        lon, lat = F.round(lon, digits), F.round(lat, digits)
    return F.struct(lon.alias("lon"), lat.alias("lat"))


def distance(p: Column | str, q: Column | str) -> Column:
    """Between metric points."""
    p, q = c(p), c(q)
    return F.hypot(p["x"] - q["x"], p["y"] - q["y"])


def metres(p: Column | str, q: Column | str) -> Column:
    """Between (lon, lat) points."""
    p, q = c(p), c(q)
    return F.hypot((p["lon"] - q["lon"]) * MX, (p["lat"] - q["lat"]) * MY)


def add(p: Column, q: Column) -> Column:
    return point(p["x"] + q["x"], p["y"] + q["y"])


def subtract(p: Column, q: Column) -> Column:
    return point(p["x"] - q["x"], p["y"] - q["y"])


def scaled(p: Column, k: Column | float) -> Column:
    return point(p["x"] * c(k), p["y"] * c(k))


def unit(p: Column) -> Column:
    """Of length one; the zero vector stays."""
    n = F.hypot(p["x"], p["y"])
    n = F.when(n == 0, F.lit(1.0)).otherwise(n)
    return point(p["x"] / n, p["y"] / n)


def nearest_on_segment(p: Column, a: Column, b: Column) -> Column:
    """The point of segment ab nearest to p; a where the segment is a point."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    n = dx * dx + dy * dy
    t = F.when(n == 0, F.lit(0.0)).otherwise(((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / n)
    t = clamp(t, 0.0, 1.0)
    return point(a["x"] + dx * t, a["y"] + dy * t)


def bearing(dx: Column | str, dy: Column | str) -> Column:
    """Degrees clockwise from north, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(c(dx), c(dy))) + F.lit(360.0), F.lit(360.0))


def offset(p: Column, degrees: Column | float, length: Column | float) -> Column:
    """The point at a bearing and distance."""
    r = F.radians(c(degrees))
    return point(p["x"] + F.sin(r) * c(length), p["y"] + F.cos(r) * c(length))


# affine maps ------------------------------------------------------------------------------------------------------


def affine(p: Column, scale: Column | float, degrees: Column | float, mirror: Column | bool, tx: Column | float, ty: Column | float) -> Column:
    """scale * R(degrees) * diag(+-1, 1) * p + t."""
    r, s = F.radians(c(degrees)), c(scale)
    mirror = F.lit(mirror) if isinstance(mirror, bool) else mirror
    x = F.when(mirror, -p["x"]).otherwise(p["x"])
    return point(s * (F.cos(r) * x - F.sin(r) * p["y"]) + c(tx), s * (F.sin(r) * x + F.cos(r) * p["y"]) + c(ty))


def rigid(p: Column, degrees: Column | float, pivot: Column, dx: Column | float, dy: Column | float, trusted: Column | bool = True) -> Column:
    """A floor's own shift about a pivot; untrusted shifts leave p."""
    r = F.radians(c(degrees))
    u, v = p["x"] - pivot["x"], p["y"] - pivot["y"]
    moved = point(F.cos(r) * u - F.sin(r) * v + pivot["x"] + c(dx), F.sin(r) * u + F.cos(r) * v + pivot["y"] + c(dy))
    trusted = F.lit(trusted) if isinstance(trusted, bool) else trusted
    return F.when(F.coalesce(trusted, F.lit(True)), moved).otherwise(point(p["x"], p["y"]))


def matrix(scale: Column | float, degrees: Column | float, mirror: Column) -> Column:
    """The linear part as (a00, a01, a10, a11)."""
    r, s, f = F.radians(c(degrees)), c(scale), F.when(mirror, F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.struct((s * F.cos(r) * f).alias("a00"), (-s * F.sin(r)).alias("a01"), (s * F.sin(r) * f).alias("a10"), (s * F.cos(r)).alias("a11"))


def compose(m: Column, n: Column) -> Column:
    """m after n."""
    return F.struct(*((m[f"a{i}0"] * n[f"a0{j}"] + m[f"a{i}1"] * n[f"a1{j}"]).alias(f"a{i}{j}") for i in (0, 1) for j in (0, 1)))


def decompose(m: Column) -> Column:
    """(scale, degrees, mirror) of a similarity's linear part."""
    det = m["a00"] * m["a11"] - m["a01"] * m["a10"]
    return F.struct(F.sqrt(F.abs(det)).alias("scale"), F.degrees(F.atan2(-m["a01"], m["a11"])).alias("degrees"), (det < 0).alias("mirror"))


# names and ids ----------------------------------------------------------------------------------------------------


def floor_name(level: Column | str) -> Column:
    """A level's name in words: '1st Floor' for 0, 'Basement' for -1."""
    x = c(level)
    n = (x + 1).cast("long")
    tens, ones = n % 100, n % 10
    suffix = F.when((ones == 1) & (tens != 11), "st").when((ones == 2) & (tens != 12), "nd").when((ones == 3) & (tens != 13), "rd").otherwise("th")
    text = F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))
    return F.when(x == -1, F.lit("Basement")).when(x < 0, F.concat(F.lit("Level "), text)).when(x != F.floor(x), F.concat(F.lit("Mezzanine (level "), text, F.lit(")"))).otherwise(F.concat(n.cast("string"), suffix, F.lit(" Floor")))


def indoor_node(code: Column | str, level: Column | str, i: Column | str) -> Column:
    level = c(level)
    text = F.when(level == F.floor(level), level.cast("long").cast("string")).otherwise(level.cast("string"))
    return F.concat_ws(":", F.lit("I"), c(code), text, c(i).cast("string"))


def parse_indoor_node(node: Column | str) -> Column:
    part = F.split(c(node), ":")
    return F.struct(part[1].alias("code"), part[2].cast("double").alias("level"), part[3].cast("int").alias("i"))


def portal_link(node: Column | str) -> Column:
    """The link of a portal node 'P:<link>:<end>'; null for other nodes."""
    found = F.regexp_extract(c(node), "^P:(.*):[^:]*$", 1)
    return F.when(found != "", found)


def coordinate_key(lon: Column | str, lat: Column | str) -> Column:
    return F.format_string("%.6f,%.6f", c(lon).cast("double"), c(lat).cast("double"))


def escape_html(x: Column | str) -> Column:
    x = c(x)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def number_prefix(x: Column | str) -> Column:
    """The number that a text begins with ('12 m' gives 12), else null."""
    found = F.regexp_extract(c(x), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.when(found != "", found).try_cast("double")


# codecs -----------------------------------------------------------------------------------------------------------


def quantise(points: Column | str) -> Column:
    """Points in metres to one flat array of whole decimetres."""
    return F.flatten(F.transform(c(points), lambda p: F.array(F.bround(p["x"] * 10).cast("int"), F.bround(p["y"] * 10).cast("int"))))


def dequantise(flat: Column | str) -> Column:
    flat = c(flat)
    n = (F.size(flat) / 2).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((F.get(flat, i * 2) / 10.0).alias("x"), (F.get(flat, i * 2 + 1) / 10.0).alias("y")))).otherwise(F.array().cast("array<struct<x:double,y:double>>"))


def decode_kinds(packed: Column | str) -> Column:
    """'ccp...' to the words that its letters stand for."""
    return F.transform(F.filter(F.split(c(packed), ""), lambda k: k != ""), lambda k: F.when(k == "c", "corridor").otherwise("passage"))


# polylines --------------------------------------------------------------------------------------------------------


def segments(points: Column | str) -> Column:
    """Neighbouring pairs (a, b) of a polyline."""
    points = c(points)
    n = F.size(points)
    return F.when(n > 1, F.zip_with(F.slice(points, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).otherwise(F.slice(F.transform(points, lambda p: F.struct(p.alias("a"), p.alias("b"))), 1, 0))


def length(points: Column | str) -> Column:
    """Of a metric polyline."""
    return F.aggregate(segments(points), F.lit(0.0), lambda total, s: total + distance(s["a"], s["b"]))


def bounds(points: Column | str, x: str = "x", y: str = "y") -> Column:
    points = c(points)
    xs, ys = F.transform(points, lambda p: p[x]), F.transform(points, lambda p: p[y])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def vertex_mean(points: Column | str, x: str = "x", y: str = "y") -> Column:
    """The mean of the vertices; a ring's closing one counts twice."""
    points = c(points)
    total = lambda k: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[k])
    return F.struct((total(x) / F.size(points)).alias(x), (total(y) / F.size(points)).alias(y))


def longest_ring(rings: Column | str) -> Column:
    """The ring with most vertices, the first of several."""
    return F.aggregate(c(rings), F.get(c(rings), F.lit(0)), lambda best, r: F.when(F.size(r) > F.size(best), r).otherwise(best))


def oriented(points: Column | str, start: Column) -> Column:
    """Turned round where its first point is farther from start than its last."""
    points = c(points)
    return F.when(distance(F.get(points, F.lit(0)), start) > distance(F.element_at(points, -1), start), F.reverse(points)).otherwise(points)


def middle(points: Column | str) -> Column:
    points = c(points)
    return F.element_at(points, (F.floor(F.size(points) / 2) + 1).cast("int"))


def bezier(p0: Column, p1: Column, p2: Column, p3: Column, chords: int = 6) -> Column:
    """The ends of the chords of a cubic curve."""

    def at(i: Column) -> Column:
        t = i / F.lit(float(chords))
        u = F.lit(1.0) - t
        one = lambda k: u * u * u * p0[k] + F.lit(3.0) * u * u * t * p1[k] + F.lit(3.0) * u * t * t * p2[k] + t * t * t * p3[k]
        return F.struct(one("x").alias("x"), one("y").alias("y"))

    return F.transform(F.sequence(F.lit(1), F.lit(chords)), at)


def upright(p: Column, height: Column | float, rotation: Column | int, width: Column | float) -> Column:
    """Page space (y down) to plan space (y up) under a page rotation, to three digits."""
    r = c(rotation)
    h, w = c(height), c(width)
    x = F.when(r == 90, h - p["y"]).when(r == 180, w - p["x"]).when(r == 270, p["y"]).otherwise(p["x"])
    y = F.when(r == 90, w - p["x"]).when(r == 180, p["y"]).when(r == 270, p["x"]).otherwise(h - p["y"])
    return F.struct(F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


def inside(p: Column, ring: Column | str) -> Column:
    """Even-odd test of a point in a ring; edges count from their lower end up to, but without, their upper one."""
    ring = c(ring)
    closed = F.concat(ring, F.slice(ring, 1, 1))

    def crosses(s: Column) -> Column:
        a, b = s["a"], s["b"]
        return ((a["y"] > p["y"]) != (b["y"] > p["y"])) & (p["x"] < (b["x"] - a["x"]) * (p["y"] - a["y"]) / (b["y"] - a["y"]) + a["x"])

    return F.size(F.filter(segments(closed), crosses)) % 2 == 1


def inside_any(p: Column, rings: Column | str) -> Column:
    return F.exists(c(rings), lambda r: inside(p, r))


def boundary_distance(p: Column, rings: Column | str) -> Column:
    every = F.flatten(F.transform(c(rings), lambda r: segments(F.concat(r, F.slice(r, 1, 1)))))
    return F.array_min(F.transform(every, lambda s: distance(p, nearest_on_segment(p, s["a"], s["b"]))))


def within(p: Column, rings: Column | str, buffer: float) -> Column:
    """Inside the rings grown by buffer."""
    return inside_any(p, rings) | (boundary_distance(p, rings) <= buffer)


def wall_quads(points: Column | str, thick: float = 0.16, least: float = 0.05) -> Column:
    """A rectangle for each wall segment, longer by half a thickness at both ends; short segments are skipped."""
    half = thick / 2

    def quad(s: Column) -> Column:
        d = unit(subtract(s["b"], s["a"]))
        a, b = subtract(s["a"], scaled(d, half)), add(s["b"], scaled(d, half))
        n = point(-d["y"] * half, d["x"] * half)
        return F.array(add(a, n), add(b, n), subtract(b, n), subtract(a, n))

    return F.transform(F.filter(segments(points), lambda s: distance(s["a"], s["b"]) >= least), quad)

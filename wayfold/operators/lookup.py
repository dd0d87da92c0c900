"""Lookups around a route request: who can be routed to, rooms by number, label points, a device's place, label candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import tiles
from .spatial import nearest_capped


def routable(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(code, name) of the door nodes 'X:<code>'; a code named twice takes the last name (ord), an unnamed one its code."""
    last = names.where("code IS NOT NULL").groupBy("code").agg(F.max_by("name", "ord").alias("name"))
    doors = nodes.where(F.col("id").startswith("X:")).select(F.substring_index("id", ":", -1).alias("code")).distinct()
    return doors.join(last, "code", "left").select("code", F.coalesce("name", "code").alias("name"))


def check_request(requests: DataFrame, known: DataFrame) -> DataFrame:
    """Requests (from, to, room) in upper case with a problem: missing end, unknown end, or the same building without a room; null where fine."""
    up = requests.withColumns({"from": F.upper(F.trim("from")), "to": F.upper(F.trim("to"))})
    codes = known.select("code").distinct()
    a, b = codes.select(F.col("code").alias("from"), F.lit(True).alias("_a")), codes.select(F.col("code").alias("to"), F.lit(True).alias("_b"))
    problem = (
        F.when((F.coalesce("from", F.lit("")) == "") | (F.coalesce("to", F.lit("")) == ""), "missing end")
        .when(F.col("_a").isNull() | F.col("_b").isNull(), "unknown building")
        .when((F.col("from") == F.col("to")) & (F.coalesce("room", F.lit("")) == ""), "same building")
    )
    return up.join(a, "from", "left").join(b, "to", "left").withColumn("problem", problem).drop("_a", "_b")


def numbered_rooms(rooms: DataFrame) -> DataFrame:
    """(code, level, number, x, y, node) of rooms with a number, at the mean of their outline's vertices."""
    return rooms.where("number IS NOT NULL").withColumn("_c", S.vertex_mean("poly")).select("code", "level", "number", F.col("_c.x").alias("x"), F.col("_c.y").alias("y"), "node")


def label_points(buildings: DataFrame) -> DataFrame:
    """(code, name, lon, lat): a label at the vertex mean of each coded building's longest ring."""
    p = S.vertex_mean(S.longest_ring("rings"), "lon", "lat")
    return buildings.where("code IS NOT NULL").withColumn("_p", p).select("code", "name", "_p.lon", "_p.lat")


def locate(places: DataFrame, doors: DataFrame, cap: float = 250.0) -> DataFrame:
    """(id, near_id, d): the nearest door within cap of each place."""
    return nearest_capped(places, doors, cap)


def availability(codes: DataFrame, index: DataFrame) -> DataFrame:
    """Codes with what the index has of them; nulls where it has none."""
    return codes.join(index, "code", "left")


def next_above(levels: DataFrame) -> DataFrame:
    """Adds above and rise: the next level up in the building and its height over this one."""
    w = Window.partitionBy("code").orderBy("level")
    return levels.withColumns({"above": F.lead("level").over(w), "rise": F.lead("elev").over(w) - F.col("elev")})


def text_groups(ink: DataFrame, key: str, reach: int = 12, least: int = 60, size: int = tiles.SIZE) -> DataFrame:
    """(key, label, r0, c0, r1, c1, ink): inked cells (key, r, c) grouped where at most reach apart; groups of little ink go.

    Pages of any size, in tiles. Reading the text of a group is for an OCR engine."""
    cells = ink.select(key, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")).distinct()
    labels = tiles.label(tiles.dilate(cells, key, reach // 2, size), key, size=size)
    groups = cells.join(labels, [key, "r", "c"]).groupBy(key, "label")
    box = groups.agg(F.min("r").alias("r0"), F.min("c").alias("c0"), F.max("r").alias("r1"), F.max("c").alias("c1"), F.count("*").alias("ink"))
    return box.where(F.col("ink") >= least)

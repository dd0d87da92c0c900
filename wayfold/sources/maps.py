"""Readers of map extracts, link and footprint collections, indoor files and plan side files.

All of them are plain Spark readers with fixed schemas; a path may be any that Spark reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import scalars as S

LINKS = "type string, features array<struct<type:string,properties:struct<id:string,from:string,to:string,kind:string,z_m:int,name:string,status:string,verified:boolean,source:string,notes:string,length_m:int>,geometry:struct<type:string,coordinates:array<array<double>>>>>"
BUILDINGS = "type string, features array<struct<type:string,id:bigint,properties:struct<osm_id:bigint,name:string,code:string,alt_code:string,height_m:double,levels:double,campus:boolean>,geometry:struct<type:string,coordinates:string>>>"
ELEMENTS = "elements array<struct<type:string,id:bigint,tags:map<string,string>,geometry:array<struct<lon:double,lat:double>>,members:array<struct<type:string,role:string,geometry:array<struct<lon:double,lat:double>>>>>>"
INDOOR = "code string, origin array<double>, floorHeightM double, levels array<struct<level:double,label:string,elevM:double,nodes:array<int>,kinds:string,edges:array<array<string>>,rooms:array<struct<n:string,q:double,a:bigint,v:int,p:array<int>>>,walls:array<array<int>>,slabs:array<array<int>>,areaM2:double,tier:string>>, vertical array<struct<kind:string,shaft:string,a:array<double>,b:array<double>,m:double,rise:double>>"
INDEX = "map<string,struct<levels:array<double>,elev:array<double>,labels:array<string>,rooms:int,kb:int,georef:string>>"
GEOREF = "code string, source string, level double, scale double, rotationDeg double, mirror boolean, tx double, ty double, iou double, margin double, siteScore double, residualM double, method string, levels map<string,struct<rotDeg:double,pivot:array<double>,dx:double,dy:double,score:double,trusted:boolean,inFootprint:double>>"

_POINTS = "array<array<double>>"


def _lonlat(coordinates) -> F.Column:
    return F.transform(coordinates, lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat")))


def _whole(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def links(spark: SparkSession, path: str) -> DataFrame:
    """(id, from, to, kind, z_m, name, status, verified, source, notes, length_m, geom) of a GeoJSON collection of lines."""
    f = _whole(spark, path, LINKS).select(F.explode("features").alias("f"))
    return f.select("f.properties.*", _lonlat(F.col("f.geometry.coordinates")).alias("geom"))


def buildings(spark: SparkSession, path: str) -> DataFrame:
    """(osm_id, name, code, alt_code, height_m, levels, campus, rings) of polygons; outer rings only."""
    f = _whole(spark, path, BUILDINGS).select(F.posexplode("features").alias("ord", "f"))
    text = F.col("f.geometry.coordinates")
    one = F.slice(F.from_json(text, f"array<{_POINTS}>"), 1, 1)
    many = F.transform(F.from_json(text, f"array<array<{_POINTS}>>"), lambda p: F.get(p, F.lit(0)))
    rings = F.when(F.col("f.geometry.type") == "Polygon", one).otherwise(many)
    return f.select("ord", "f.properties.*", F.transform(rings, _lonlat).alias("rings"))


def coded_buildings(rows: DataFrame) -> DataFrame:
    """(code, name, rings, centroid): metric rings merged by code; name and vertex-mean centroid are the first feature's."""
    m = rows.where("code IS NOT NULL AND code <> ''").withColumn("rings", F.transform("rings", lambda r: F.transform(r, S.to_metric)))
    m = m.withColumn("centroid", S.vertex_mean(F.flatten("rings")))
    g = m.groupBy("code").agg(F.min_by(F.struct(F.coalesce("name", "code").alias("name"), "centroid"), "ord").alias("f"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ord", "rings"))), lambda x: x["rings"])).alias("rings"))
    return g.select("code", "f.name", "rings", "f.centroid")


def elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements of a map extract with their class: relation building, way building or other; the rest is skipped."""
    e = _whole(spark, path, ELEMENTS).select(F.explode("elements").alias("e")).select("e.*")
    kind = R.way_kind(F.col("type"), F.try_element_at("tags", F.lit("building")), F.col("geometry"))
    return e.withColumn("class", kind).where("class IS NOT NULL")


def footprints(rows: DataFrame, code_by_name: dict[str, str], owner: str) -> DataFrame:
    """(osm_id, name, code, alt_code, height_m, levels, campus, lines) of the building elements; relations still need their rings assembled."""
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    alias = F.create_map(*(F.lit(x) for kv in code_by_name.items() for x in kv)) if code_by_name else None
    code = F.coalesce(tag("ref"), tag("short_name"), *([F.try_element_at(alias, tag("name"))] if alias is not None else []))
    way = F.col("class") == "way building"
    campus = F.when(way, R.campus(tag("operator"), tag("ref"), tag("short_name"), tag("name"), owner)).otherwise(R.campus(tag("operator"), tag("ref"), tag("short_name"), None, owner))
    outer = F.transform(F.filter("members", lambda m: (m["type"] == "way") & (m["role"] != "inner") & m["geometry"].isNotNull()), lambda m: m["geometry"])
    return rows.where(F.col("class").contains("building")).select(
        F.col("id").alias("osm_id"), tag("name").alias("name"), code.alias("code"), tag("old_ref").alias("alt_code"), R.building_height(tag("height"), tag("building:levels")).alias("height_m"),
        S.number_prefix(tag("building:levels")).alias("levels"), campus.alias("campus"), F.when(way, F.array("geometry")).otherwise(outer).alias("lines"),
    )


def ways(rows: DataFrame) -> DataFrame:
    """(osm_id, name, highway, tunnel, bridge, layer, level, covered, geom) of the other ways."""
    tag = lambda k: F.try_element_at("tags", F.lit(k)).alias(k)
    return rows.where("class = 'other'").select(F.col("id").alias("osm_id"), *(tag(k) for k in ("name", "highway", "tunnel", "bridge", "layer", "level", "covered")), F.col("geometry").alias("geom"))


def indoor_levels(spark: SparkSession, path: str | list[str], codes: list[str] | None = None) -> DataFrame:
    """(code, level, label, elev, ox, oy, nodes, kinds, walls, rooms): a row a floor of the buildings asked for, decoded by operators.indoor.expand.

    Files are one a building; where the folder is partitioned by code, the filter prunes them."""
    rows = _whole(spark, path, INDOOR)
    if codes is not None:
        rows = rows.where(F.col("code").isin(codes))
    lv = rows.select("code", "origin", F.explode("levels").alias("l"))
    return lv.select("code", "l.level", "l.label", F.col("l.elevM").alias("elev"), (F.get("origin", F.lit(0)) * S.MX).alias("ox"), (F.get("origin", F.lit(1)) * S.MY).alias("oy"), "l.nodes", "l.kinds", "l.walls", "l.rooms", "l.tier")


def indoor_index(spark: SparkSession, path: str) -> DataFrame:
    """(code, levels, elev, labels, rooms, kb, georef)."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", INDEX)).alias("code", "v")).select("code", "v.*")


def georefs(spark: SparkSession, path: str) -> DataFrame:
    return _whole(spark, path, GEOREF)


def present(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest rows whose file exists."""
    return manifest.join(files.select("file"), "file", "left_semi")


def wall_lines(plans: DataFrame) -> DataFrame:
    """Each plan's wall lines, else its unlayered ones, else none (classes: map of class to lines)."""
    pick = lambda k: F.try_element_at("classes", F.lit(k))
    some = lambda c: F.when(F.size(c) > 0, c)
    return plans.withColumn("walls", F.coalesce(some(pick("wall")), some(pick("unlayered")), F.slice(pick("wall"), 1, 0)))


def plan_corpus(drawings: DataFrame, labels: DataFrame) -> DataFrame:
    """(file, label, level, level_from_file, tier, drawings, per_class, per_layer) of drawings (file, layer, items) and labels (file, label).

    A PDF reader has to supply the drawings; none is needed here."""
    named = F.when(F.coalesce("layer", F.lit("")) == "", "(none)").otherwise(F.col("layer"))
    d = drawings.withColumn("class", R.layer_class("layer")).withColumn("layer", named)
    by = lambda key, most: (
        d.groupBy("file", key).agg(F.sum("items").alias("n"))
        .withColumn("_r", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("n"), key)))
        .where(F.lit(most is None) | (F.col("_r") <= (most or 0))).groupBy("file").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "n")))).alias(f"per_{key}"))
    )
    layered = d.groupBy("file").agg(F.max((F.col("layer") != "(none)").cast("int")).alias("layered"), F.count("*").alias("drawings"))
    out = labels.join(layered, "file").join(by("class", None), "file", "left").join(by("layer", 40), "file", "left")
    rooms = F.try_element_at("per_class", F.lit("room_no"))
    return out.select("file", "label", R.level("label", "file").alias("level"), R.level_of_file("file").alias("level_from_file"), R.tier(F.col("layered") == 1, rooms).alias("tier"), "drawings", "per_class", "per_layer")

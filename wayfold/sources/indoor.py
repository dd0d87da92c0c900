"""Indoor files, one a building, as a data source with pushed filters, and their writer.

A file is JSON named after its building (``<code>.json``, or anything in a folder
``code=<code>``), with whole decimetres about an origin, kinds as one letter each and
positional edges. spark.read gives one of its parts as rows. Filters on code choose
files while planning, so the others are not opened, and filters on level are applied
while reading; each file is a partition of its own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from ..functions import scalars as S

_LINE = "array<struct<lon:double,lat:double>>"
#: The parts of a file and their columns.
PARTS = {
    "levels": "code string, level double, label string, elev double, nodes int, tier string, area double, ord int",
    "nodes": "code string, level double, i int, lon double, lat double, kind string",
    "edges": f"code string, level double, a int, b int, m double, path {_LINE}",
    "rooms": f"code string, level double, ord int, number string, conf double, area double, node int, poly {_LINE}",
    "walls": f"code string, level double, ord int, line {_LINE}",
    "slabs": f"code string, level double, ord int, line {_LINE}",
    "shafts": "code string, level double, kind string, id string, node int, lon double, lat double, west double, south double, east double, north double",
    "verticals": "code string, kind string, shaft string, a_level double, a_node int, b_level double, b_node int, m double, rise double",
}
#: Codes up to so many are taken from a table to choose files.
MOST_CODES = 100_000


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri.removeprefix("file:")


class File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class IndoorReader(DataSourceReader):
    def __init__(self, path: str, part: str) -> None:
        self.path, self.part = path, part
        self.codes: set | None = None
        self.levels: set | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | EqualNullSafe | In) and len(f.attribute) == 1 else None
            if column not in ("code", "level") or column == "level" and self.part == "verticals":
                yield f
                continue
            wanted = set(f.value) if isinstance(f, In) else {f.value}
            if column == "code":
                self.codes = wanted if self.codes is None else self.codes & wanted
            else:
                self.levels = wanted if self.levels is None else self.levels & wanted

    def partitions(self) -> list[File]:
        fs, root = _fs(self.path)
        found = []
        for info in sorted(fs.get_file_info(pafs.FileSelector(root, recursive=True)), key=lambda x: x.path):
            name = info.path.rsplit("/", 1)[-1]
            if info.type == pafs.FileType.File and name[0] not in "._":
                folder = next((x[5:] for x in info.path.split("/") if x.startswith("code=")), None)
                code = unquote(folder) if folder is not None else name.rsplit(".", 1)[0]
                if self.codes is None or code in self.codes:
                    found.append(File(info.path))
        return found

    def read(self, partition: File) -> Iterator[tuple]:
        fs, _ = _fs(self.path)
        with fs.open_input_stream(partition.path) as f:
            raw = json.loads(f.read().decode("utf-8"))
        if self.codes is None or raw["code"] in self.codes:
            yield from rows(raw, self.part, self.levels)


class IndoorFiles(DataSource):
    """Options: path, and part, one of PARTS."""

    @classmethod
    def name(cls) -> str:
        return "indoor"

    def schema(self) -> str:
        return PARTS[self.options.get("part", "nodes")]

    def reader(self, schema: StructType) -> IndoorReader:
        return IndoorReader(self.options["path"], self.options.get("part", "nodes"))


def rows(raw: dict, part: str, levels: set | None = None) -> Iterator[tuple]:
    """One part of a file as rows, in the order of PARTS."""
    code, (lon0, lat0) = raw["code"], raw["origin"]
    ox, oy = lon0 * S.MX, lat0 * S.MY
    line = lambda flat: [((ox + x / 10) / S.MX, (oy + y / 10) / S.MY) for x, y in zip(flat[::2], flat[1::2], strict=True)]
    if part == "verticals":
        for v in raw.get("vertical", []):
            (la, ia), (lb, ib) = v["a"], v["b"]
            yield code, v["kind"], v["shaft"], float(la), None if ia is None else int(ia), float(lb), None if ib is None else int(ib), float(v["m"]), float(v["rise"])
        return
    for order, lv in enumerate(raw["levels"]):
        level = float(lv["level"])
        if levels is not None and level not in levels:
            continue
        if part == "levels":
            yield code, level, lv["label"], float(lv["elevM"]), len(lv["nodes"]) // 2, lv.get("tier"), None if lv.get("areaM2") is None else float(lv["areaM2"]), order
        elif part == "nodes":
            for i, (p, k) in enumerate(zip(line(lv["nodes"]), lv["kinds"], strict=True)):
                yield code, level, i, *p, "corridor" if k == "c" else "passage"
        elif part == "edges":
            for a, b, dm, flat in lv["edges"]:
                yield code, level, a, b, dm / 10, line(flat)
        elif part == "rooms":
            for i, r in enumerate(lv.get("rooms") or []):
                yield code, level, i, r["n"], float(r["q"]), float(r["a"]), r["v"], line(r["p"])
        elif part in ("walls", "slabs"):
            for i, flat in enumerate(lv.get(part) or []):
                yield code, level, i, line(flat)
        else:
            for kind, name in (("stair", "stairs"), ("elevator", "elevators")):
                for s in lv.get(name) or []:
                    at = line(s["c"])[0]
                    box = (line(s.get("bbox") or []) + [at, at])[:2]
                    yield code, level, kind, s["id"], s["v"], *at, *box[0], *box[1]


def read(spark: SparkSession, path: str, part: str) -> DataFrame:
    """One part of all files below path. Turns pushing of filters to Python sources on for the session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(IndoorFiles)
    return spark.read.format("indoor").option("part", part).load(path)


def read_of(spark: SparkSession, path: str, part: str, buildings: DataFrame) -> DataFrame:
    """The same of the buildings (code) that a table names: files are chosen by its codes where these are few, else rows by a join."""
    codes = [r.code for r in buildings.select("code").where("code IS NOT NULL").distinct().limit(MOST_CODES + 1).collect()]
    found = read(spark, path, part)
    if len(codes) <= MOST_CODES:
        return found.where(F.col("code").isin(codes)) if codes else found.where("false")
    return found.join(buildings.select("code").distinct(), "code", "left_semi")


def write(levels: DataFrame, nodes: DataFrame, edges: DataFrame, verticals: DataFrame, walls: DataFrame, rooms: DataFrame, path: str) -> None:
    """Files of the given parts (columns as in PARTS), one a building; the origin is a building's least longitude and latitude. A building's floors go through one row, as its file does."""
    origin = nodes.groupBy("code").agg(F.min("lon").alias("lon0"), F.min("lat").alias("lat0"))
    dm = lambda x, o, k: F.bround((x - F.col(o)) * k * 10).cast("int")
    flat = lambda pts: F.flatten(F.transform(pts, lambda p: F.array(dm(p["lon"], "lon0", S.MX), dm(p["lat"], "lat0", S.MY))))
    listed = lambda order, value: F.transform(F.sort_array(F.collect_list(F.struct(*order, value.alias("_v")))), lambda x: x["_v"])
    at = lambda df: df.join(origin, "code")
    by = ["code", "level"]
    point = F.array(F.struct("lon", "lat"))
    n = at(nodes).groupBy(*by).agg(F.flatten(listed(["i"], flat(point))).alias("nodes"), F.array_join(listed(["i"], F.substring("kind", 1, 1)), "").alias("kinds"))
    text = F.concat(F.lit("["), F.col("a").cast("string"), F.lit(","), F.col("b").cast("string"), F.lit(","), F.bround(F.col("m") * 10).cast("int").cast("string"), F.lit(","), F.to_json(flat(F.col("path"))), F.lit("]"))
    e = at(edges).groupBy(*by).agg(F.array_join(listed(["a", "b"], text), ",").alias("_edges"))
    w = at(walls).groupBy(*by).agg(listed(["ord"], flat(F.col("line"))).alias("walls"))
    room = F.struct(F.col("number").alias("n"), F.col("conf").alias("q"), F.bround("area").cast("long").alias("a"), F.col("node").alias("v"), flat(F.col("poly")).alias("p"))
    r = at(rooms).groupBy(*by).agg(listed(["ord"], room).alias("rooms"))
    full = levels.select(*by, "label", F.col("elev").alias("elevM"), "tier", F.col("area").alias("areaM2"), "ord").join(n, by, "left").join(e, by, "left").join(w, by, "left").join(r, by, "left")
    none = lambda t: F.array().cast(t)
    body = F.struct("level", "label", "elevM", "tier", "areaM2", F.coalesce("nodes", none("array<int>")).alias("nodes"), F.coalesce("kinds", F.lit("")).alias("kinds"),
                    F.coalesce("walls", none("array<array<int>>")).alias("walls"), F.coalesce("rooms", none(full.schema["rooms"].dataType)).alias("rooms"))
    keep = {"ignoreNullFields": "false"}
    floor = F.concat(F.regexp_replace(F.to_json(body, keep), r"\}$", ""), F.lit(',"edges":['), F.coalesce("_edges", F.lit("")), F.lit("]}"))
    floors = full.groupBy("code").agg(F.array_join(listed(["ord"], floor), ",").alias("_floors"))
    end = lambda s: F.array(F.col(f"{s}_level"), F.col(f"{s}_node").cast("double")).alias(s)
    v = verticals.groupBy("code").agg(F.sort_array(F.collect_list(F.struct("kind", "shaft", end("a"), end("b"), "m", "rise"))).alias("_v"))
    whole = floors.join(origin, "code").join(v, "code", "left")
    value = F.concat(F.lit('{"code":'), F.regexp_replace(F.to_json(F.array("code")), r"^\[|\]$", ""), F.lit(',"origin":'), F.to_json(F.array("lon0", "lat0")), F.lit(',"levels":['), "_floors", F.lit('],"vertical":'), F.coalesce(F.to_json("_v", keep), F.lit("[]")), F.lit("}"))
    whole.select("code", value.alias("value")).write.partitionBy("code").text(path)

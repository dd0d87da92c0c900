"""Writers: GeoJSON text, graph tables, floors by building, and versioned rewrites. No input path is ever overwritten."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def features(df: DataFrame, geom: str = "geom", kind: str = "LineString") -> DataFrame:
    """(value): a GeoJSON feature as a line of JSON for each row."""
    line = F.transform(geom, lambda p: F.array(p["lon"], p["lat"]))
    props = F.struct(*(c for c in df.columns if c != geom))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), F.struct(F.lit(kind).alias("type"), line.alias("coordinates")).alias("geometry"))).alias("value"))


def write_features(df: DataFrame, path: str, **kw) -> None:
    features(df, **kw).write.text(path)


def collection(df: DataFrame, order: str, **kw) -> DataFrame:
    """(value): one GeoJSON collection; for results that one line can hold."""
    f = features(df.orderBy(order), **kw)
    return f.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("value"), ","), F.lit("]}")).alias("value"))


def write_graph(vertices: DataFrame, edges: DataFrame, path: str, **meta: str | int) -> None:
    """Tables vertices, edges and meta (built, and what is given)."""
    vertices.write.parquet(f"{path}/vertices")
    edges.write.parquet(f"{path}/edges")
    spark = vertices.sparkSession
    row = spark.range(1).select(F.current_date().cast("string").alias("built"), *(F.lit(v).alias(k) for k, v in meta.items()))
    row.write.parquet(f"{path}/meta")


def write_floors(levels: DataFrame, path: str) -> None:
    """Compact floors in a folder a building, so that a route reads its own buildings only."""
    levels.write.partitionBy("code").parquet(path)


def write_index(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(path)


def next_version(df: DataFrame, path: str, version: int) -> str:
    """Writes an enriched table beside the one it was read from; the reader moves on to the new version when it is whole."""
    out = f"{path.rstrip('/')}/v={version}"
    df.write.parquet(out)
    return out

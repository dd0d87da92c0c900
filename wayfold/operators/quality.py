"""Data-quality rules as tables of violations: no rows means the rule holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import graph


def report(rules: dict[str, DataFrame]) -> DataFrame:
    """(rule, violations): the number of rows of each rule's table."""
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations") for name, df in rules.items()))


def missing(required: DataFrame, present: DataFrame) -> DataFrame:
    """Required rows that aren't there, by their columns."""
    return required.join(present.select(*required.columns).distinct(), required.columns, "left_anti")


def over(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Keys with more rows than most."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > most)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(a, b, n) in both directions; sums are combined before the flip, so it doubles groups, not rows."""
    one = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "n")).groupBy("a", "b").agg(F.sum("n").cast("long").alias("n"))


def missing_pairs(required: DataFrame, links: DataFrame) -> DataFrame:
    """Required building pairs (a, b) that no link joins in either direction."""
    return missing(required, pair_counts(links.select(F.col("from").alias("a"), F.col("to").alias("b"))).select("a", "b"))


def degenerate(lines: DataFrame, geom: str = "geom") -> DataFrame:
    return lines.where(F.coalesce(F.size(geom), F.lit(0)) < 2)


def too_long(edges: DataFrame, metres: float = 700.0, points: int = 60) -> DataFrame:
    """Outdoor edges (m, geom) beyond their budget of metres or points."""
    return edges.where((F.col("kind") == "outdoor") & ((F.col("m") > metres) | (F.size("geom") > points)))


def split_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(code, level, parts) of levels whose walk graph isn't one component. nodes: code, level, i; edges: code, level, a, b."""
    v = nodes.select(S.indoor_node("code", "level", "i").alias("id"), "code", "level")
    e = edges.select(S.indoor_node("code", "level", "a").alias("a"), S.indoor_node("code", "level", "b").alias("b"))
    labels = graph.components(v.select("id"), graph.both_ways(e))
    first = labels.where("id = label").select("id")  # one vertex a component, and edges stay on a level
    return v.join(first.hint("merge"), "id").groupBy("code", "level").agg(F.countDistinct("id").alias("parts")).where("parts > 1")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (code, level, a, b) with an end that is no node (code, level, i)."""
    ends = edges.select("code", "level", F.explode(F.array("a", "b")).alias("i"))
    return ends.join(nodes.select("code", "level", "i"), ["code", "level", "i"], "left_anti").distinct()


def unlinked_stairs(stops: DataFrame, verticals: DataFrame) -> DataFrame:
    """Buildings with stairs on two levels or more but no vertical edge."""
    many = stops.where("kind = 'stair'").groupBy("code").agg(F.countDistinct("level").alias("n")).where("n >= 2")
    return many.join(verticals.select("code").distinct(), "code", "left_anti")


def unreachable(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes outside the component of the least node; that node's id, one value, comes to the driver."""
    labels = graph.kept(graph.components(nodes.select("id"), arcs))
    main = labels.agg(F.min("label")).first()[0]
    return labels.where(F.col("label") != F.lit(main))


def route_uses(hops: DataFrame, wanted: list[str]) -> DataFrame:
    """Wanted links that a route's hops don't use."""
    spark = hops.sparkSession
    return spark.createDataFrame([(w,) for w in wanted], "link string").join(hops.select("link").where("link IS NOT NULL"), "link", "left_anti")


def over_budget(files: DataFrame, kilobytes: int) -> DataFrame:
    """Files (path, bytes) larger than a budget."""
    return files.where(F.col("bytes") > kilobytes * 1024)


def preview(rows: DataFrame, n: int) -> DataFrame:
    """The first n rows by code and level, rows without a level last: a report, not a data set."""
    return rows.orderBy("code", F.coalesce("level", F.lit(99))).limit(n)


def build_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, kind, n, metres): nodes and edges by kind."""
    a = nodes.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("node").alias("part"), "kind", "n", F.lit(0.0).alias("metres"))
    return a.unionByName(edges.groupBy("kind").agg(F.count("*").alias("n"), F.sum("m").alias("metres")).select(F.lit("edge").alias("part"), "kind", "n", "metres"))


def chosen(buildings: DataFrame, codes: list[str] | None = None, registered: bool = False, core: list[str] | None = None) -> DataFrame:
    """Buildings (code, method, ...) that a run works on: those named, else the core ones, else all; only those with a registration where asked."""
    wanted = codes or core
    out = buildings.where(F.col("code").isin(wanted)) if wanted else buildings
    return out.where(F.col("method").isNotNull() & (F.col("method") != "no-footprint")) if registered else out

"""Graphs as tables: vertices (id, ...) and arcs (a, b, w, ...), iterated by frontier.

Loops write each round to the checkpoint folder, so lineage stays short and a lost
executor costs one round.
"""

from __future__ import annotations

import heapq
import tempfile
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; a local session that names none gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="wayfold-"))
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def both_ways(edges: DataFrame, *reversed_: str) -> DataFrame:
    """Each edge (a, b, ...) and its flip; polylines in the named columns are turned round."""
    flip = edges.withColumns({"a": F.col("b"), "b": F.col("a"), **{c: F.reverse(c) for c in reversed_}})
    return edges.unionByName(flip)


def from_polylines(ways: DataFrame, factor: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, lon, lat) and arcs (a, b, w) of ways (way, geom in lon/lat, ...).

    A vertex is a coordinate to six digits and keeps the place of its first mention."""
    pts = ways.withColumn("_f", factor if factor is not None else F.lit(1.0)).select("way", "_f", F.posexplode("geom").alias("i", "p"))
    keyed = pts.withColumn("id", S.coordinate_key(F.col("p.lon"), F.col("p.lat")))
    w = Window.partitionBy("way").orderBy("i")
    nxt = keyed.withColumns({"b": F.lead("id").over(w), "q": F.lead("p").over(w)}).where("b IS NOT NULL")
    edges = nxt.select(F.col("id").alias("a"), "b", (S.metres("p", "q") * F.col("_f")).alias("w"))
    vertices = keyed.groupBy("id").agg(F.min_by("p", F.struct("way", "i")).alias("p")).select("id", "p.lon", "p.lat")
    return vertices, both_ways(edges)


#: Edges beyond which graphs are shrunk before their rounds; edges a task and a chunk of one.
SHRINK, EDGES_A_TASK, CHUNK = 50_000, 1_000_000, 200_000


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, root) of the ends of edges (a, b): the least end of their component within a chunk of edges."""

    def chunk(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = pa.chunked_array([x for c in ("a", "b") for x in (batch.column(c) for batch in held)]).combine_chunks()
        ends = (pa.concat_arrays(ends.chunks) if isinstance(ends, pa.ChunkedArray) else ends).dictionary_encode()
        ids = ends.dictionary
        order = pc.sort_indices(ids).to_numpy()
        rank = np.empty(len(ids), dtype=np.int64)
        rank[order] = np.arange(len(ids))
        u, v = rank[ends.indices.to_numpy()].reshape(2, -1)
        parent = np.arange(len(ids))
        while True:
            ru, rv = parent[u], parent[v]
            apart = ru != rv
            if not apart.any():
                break
            np.minimum.at(parent, np.maximum(ru, rv)[apart], np.minimum(ru, rv)[apart])
            while (parent[parent] != parent).any():
                parent = parent[parent]
        ordered = ids.take(pa.array(order))
        return pa.RecordBatch.from_arrays([ordered, ordered.take(pa.array(parent))], names=["id", "root"])

    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n >= CHUNK:
            yield chunk(held)
            held, n = [], 0
    if n:
        yield chunk(held)


def _shrunk(vertices: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """components() of a graph of many edges (a < b): sorted, so that near ones stand together, chunks of edges give
    each end a root; only vertices with several roots tie these, and the rounds see roots alone."""
    kind, parts = pairs.schema["a"].dataType.simpleString(), -(-n // EDGES_A_TASK)
    near = pairs.repartitionByRange(parts, "a", "b").sortWithinPartitions("a", "b").mapInArrow(_roots, f"id {kind}, root {kind}")
    roots = near.repartition(parts, "id").groupBy("id").agg(F.collect_set("root").alias("roots"))  # at most one a chunk
    every = vertices.select("id").repartition(parts, "id").distinct().withColumn("known", F.lit(True))
    state = kept(every.join(roots.hint("merge"), "id", "full").select("id", "known", F.array_min("roots").alias("root"), F.when(F.size("roots") > 1, F.col("roots")).alias("roots")))
    if not state.where("known IS NULL").isEmpty():  # ends that are no vertices tie nothing
        ids = every.select("id")
        inner = pairs.join(ids.select(F.col("id").alias("a")).hint("merge"), "a", "left_semi").join(ids.select(F.col("id").alias("b")).hint("merge"), "b", "left_semi")
        return components(vertices, both_ways(inner.select("a", "b")))
    ties = kept(state.where("roots IS NOT NULL").select(F.col("root").alias("a"), F.explode("roots").alias("b")).where("a < b").distinct())
    if ties.isEmpty():
        return state.select("id", F.coalesce("root", "id").alias("label"))
    tied = _rounds(ties.select(F.explode(F.array("a", "b")).alias("id")).distinct(), _each_way(ties)).select(F.col("id").alias("root"), "label")
    tied = F.broadcast(tied) if tied.limit(SMALL_FRONTIER + 1).count() <= SMALL_FRONTIER else tied.hint("merge")
    return state.select("id", "root").join(tied, "root", "left").select("id", F.coalesce("label", "root", "id").alias("label"))


def components(vertices: DataFrame, arcs: DataFrame) -> DataFrame:
    """(id, label): the least id of each vertex's component. Arcs go both ways. Graphs of many edges are shrunk before their rounds."""
    pairs = kept(arcs.where("a < b").select("a", "b"))
    n = pairs.count()
    if n > SHRINK and pairs.schema["a"].dataType.simpleString() in ("string", "bigint", "int"):
        return _shrunk(vertices, pairs, n)
    return _rounds(vertices, _each_way(kept(pairs.distinct()) if n > SHRINK else pairs))


def _each_way(pairs: DataFrame) -> DataFrame:
    """both_ways() of (a, b) in one read; a join over a union of two reads of a checkpoint may fail in the planner."""
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return pairs.select(ends.alias("e")).select("e.a", "e.b")


def _rounds(vertices: DataFrame, arcs: DataFrame) -> DataFrame:
    """components() by rounds of joins; each reads the arcs again, so give kept ones.

    Every vertex has a parent. In a round each looks at its neighbours' grandparents;
    the least one becomes a candidate for itself and for its own parent, so that whole
    trees are hung under smaller ones, and all move up to their grandparents. Rounds
    grow with the logarithm of a component's size, for chains in any order too."""
    links = arcs.select("a", "b")
    state, before = kept(vertices.select("id", F.col("id").alias("label"), F.col("id").alias("far"))), None

    def step(state: DataFrame) -> DataFrame:
        seen = links.join(state.select(F.col("id").alias("b"), F.col("far").alias("near")), "b").groupBy(F.col("a").alias("id")).agg(F.min("near").alias("near"))
        found = state.join(seen, "id", "left")
        own = F.struct("id", F.least("label", "far", F.coalesce("near", "far")).alias("label"))
        parent = F.struct(F.col("label").alias("id"), F.least("near", "label").alias("label"))  # least() passes over nulls
        moved = found.select(F.explode(F.array(own, parent)).alias("x")).groupBy("x.id").agg(F.min("x.label").alias("label"))
        up = moved.select(F.col("id").alias("label"), F.col("label").alias("far"))
        return moved.join(up, "label").select("id", "label", "far")

    while True:  # labels only fall, so two rounds that change nothing are the end
        state = kept(step(step(state)))
        now = state.agg(F.bit_xor(F.xxhash64("id", "label", "far"))).first()[0]
        if now == before:
            return state.select("id", "label")
        before = now


def largest_component(vertices: DataFrame, arcs: DataFrame) -> DataFrame:
    """The vertices of the largest component that has arcs; the least label of equals."""
    touched = vertices.join(arcs.select(F.col("a").alias("id")).distinct(), "id", "left_semi")
    labels = components(touched, arcs)
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    top = sizes.orderBy(F.desc("n"), "label").limit(1).select("label")
    return labels.join(F.broadcast(top), "label", "left_semi").select("id")


def keep_fraction(labels: DataFrame, fraction: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows of components with at least a fraction of the largest one's rows."""
    n = labels.groupBy(*keys, "label").agg(F.count("*").alias("n"))
    if keys:
        big = n.withColumn("top", F.max("n").over(Window.partitionBy(*keys))).where(F.col("n") >= F.col("top") * fraction)
    else:  # one number comes to the driver
        big = n.where(F.col("n") >= F.lit((n.agg(F.max("n")).first()[0] or 0) * fraction))
    big = big.select(*keys, "label")
    return labels.join(big, [*keys, "label"], "left_semi")


def reindex(rows: DataFrame, order: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds i: 0, 1, ... in order, within keys.

    Without keys the rows are sorted into ranges, each range numbers its own and
    the ranges' sizes, one number a partition, are added up."""
    if keys:
        return rows.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
    ranged = kept(rows.repartitionByRange(order).withColumn("_p", F.spark_partition_id()))
    sizes, start, begins = {r["_p"]: r["n"] for r in ranged.groupBy("_p").agg(F.count("*").alias("n")).collect()}, 0, []
    for p in sorted(sizes):
        begins += [F.lit(p), F.lit(start)]
        start += sizes[p]
    own = F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1
    base = F.try_element_at(F.create_map(*begins), F.col("_p")) if begins else F.lit(0)
    return ranged.withColumn("i", (own + base).cast("int")).drop("_p")


#: Frontiers up to so many rows are broadcast; rounds after which the distances are written anew.
SMALL_FRONTIER, COMPACT = 100_000, 6


#: Arcs a partition, so that a task's memory doesn't grow with the graph.
ARCS_A_TASK = 1_000_000

#: Arcs up to so many are sent to every task (some 40 MB there).
SMALL_ARCS = 200_000


def settled(near: dict, source, radius: float | None = None, target=None) -> list[tuple]:
    """(id, d, m, pred) of the vertices nearest to a source, in order, up to a radius or to the target. near: for each vertex (b, w, m)."""
    best, heap, out, done = {source: (0, None, 0)}, [(0, 0, source)], [], set()
    pushed = 0  # parts equal distances in the heap
    while heap:
        d, _, x = heapq.heappop(heap)
        if x in done:
            continue
        done.add(x)
        _, pred, m = best[x]
        out.append((x, d, m, pred))
        if x == target:
            break
        for b, w, step in near.get(x, ()):
            if b in done or radius is not None and d + w > radius:
                continue
            old = best.get(b)
            if old is None or d + w < old[0] or d + w == old[0] and x < old[1]:
                best[b] = (d + w, x, m + step)
                pushed += 1
                heapq.heappush(heap, (d + w, pushed, b))
    return out


def _each_source(steps: DataFrame, sources: DataFrame, radius: float | None, target) -> DataFrame:
    """Searches that need no shuffle: each task has all arcs, which are few, and takes its own sources."""
    sent = steps.sparkSession.sparkContext.broadcast(steps.toPandas())
    vertex, d, m = (steps.schema[c].dataType.simpleString() for c in ("a", "w", "m"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near = defaultdict(list)
        for a, *rest in zip(*(sent.value[c].tolist() for c in ("a", "b", "w", "m")), strict=True):
            near[a].append(rest)
        for batch in batches:
            for source in batch["id"].tolist():
                found = settled(near, source, radius, target)
                columns = dict(zip(("id", "d", "m", "pred"), zip(*found, strict=True), strict=True))
                yield pd.DataFrame({"src": pd.Series([source] * len(found), dtype=object), **{k: pd.Series(list(v), dtype=object) for k, v in columns.items()}})

    return sources.select(F.col("id").cast(vertex).alias("id")).where("id IS NOT NULL").distinct().mapInPandas(run, f"src {vertex}, id {vertex}, d {d}, m {m}, pred {vertex}")


def shortest(arcs: DataFrame, sources: DataFrame, radius: float | None = None, target: str | int | None = None) -> DataFrame:
    """(src, id, d, m, pred): distances by w from each source; m sums the arcs' m (w where there is none).

    Where the arcs are few every task searches for its own sources; else all
    sources advance in one frontier. Only vertices within the radius are returned.
    With a target the search of a source ends when no frontier vertex could improve
    it. Equal distances take the smaller predecessor. The arcs are counted before they
    are dealt, ARCS_A_TASK a partition; give kept ones where they cost much."""
    if "m" not in arcs.columns:
        arcs = arcs.withColumn("m", F.col("w"))
    parts = -(-arcs.count() // ARCS_A_TASK)
    dealt = arcs.select("a", "b", "w", "m").repartition(parts, "a", "b") if parts > 1 else arcs
    steps = kept(dealt.groupBy("a", "b").agg(F.min(F.struct("w", "m")).alias("x")).select("a", "b", "x.w", "x.m"))
    if steps.limit(SMALL_ARCS + 1).count() <= SMALL_ARCS:
        return kept(_each_source(steps, sources, radius, target))
    zero = F.lit(0).cast(steps.schema["w"].dataType)
    none = F.lit(None).cast(steps.schema["a"].dataType)
    frontier = kept(sources.select(F.col("id").alias("src"), "id", zero.alias("d"), zero.cast(steps.schema["m"].dataType).alias("m"), none.alias("pred")))
    best_of = lambda rows: rows.groupBy("src", "id").agg(F.min(F.struct("d", "pred", "m")).alias("x")).select("src", "id", "x.d", "x.m", "x.pred")
    dist, rounds = frontier, 0  # the frontiers so far; the best row of a vertex counts
    while True:
        n = frontier.limit(SMALL_FRONTIER + 1).count()
        if not n:
            return best_of(dist)
        here = F.broadcast(frontier) if n <= SMALL_FRONTIER else frontier
        near = here.join(steps, F.col("id") == F.col("a")).select("src", F.col("b").alias("id"), (F.col("d") + F.col("w")).alias("d"), (frontier["m"] + steps["m"]).alias("m"), F.col("a").alias("pred"))
        if radius is not None:
            near = near.where(F.col("d") <= radius)
        if target is not None:
            best = dist.where(F.col("id") == target).groupBy("src").agg(F.min("d").alias("bound"))
            near = near.join(best, "src", "left").where(F.col("bound").isNull() | (F.col("d") < F.col("bound"))).drop("bound")
        # known and new rows of a vertex are combined in one grouping; a vertex is on the frontier if a new row is its best
        old = F.lit(0)
        both = dist.withColumn("_new", old).unionByName(near.withColumn("_new", F.lit(1))).groupBy("src", "id").agg(F.min(F.struct("d", "pred", "_new", "m")).alias("x"))
        frontier = kept(both.where("x._new = 1").select("src", "id", "x.d", "x.m", "x.pred"))
        dist, rounds = dist.unionByName(frontier), rounds + 1
        if rounds % COMPACT == 0:
            dist = kept(best_of(dist))


def paths(dist: DataFrame, targets: DataFrame) -> DataFrame:
    """(src, target, hop, id): the vertices from each source to its targets (src, target), hop 0 the source.

    A predecessor walk for all targets at once, one join a hop; unreachable targets give no rows."""
    steps = dist.select("src", "id", "pred")
    here = kept(targets.join(dist.select("src", F.col("id").alias("target")), ["src", "target"], "left_semi").select("src", "target", F.col("target").alias("id"), F.lit(0).alias("back")))
    every = [here]
    while True:
        here = kept(here.join(steps, ["src", "id"]).where("pred IS NOT NULL").select("src", "target", F.col("pred").alias("id"), (F.col("back") + 1).alias("back")))
        if here.isEmpty():
            break
        every.append(here)
    out = every[0]
    for x in every[1:]:
        out = out.unionByName(x)
    w = Window.partitionBy("src", "target")
    return out.select("src", "target", (F.max("back").over(w) - F.col("back")).alias("hop"), "id")


def shortcuts(dist: DataFrame, doors: DataFrame, k: int = 4) -> DataFrame:
    """(a, b, d): each source's k nearest other doors (ord, id), one row a pair; the first found of a pair stays."""
    ends = dist.join(doors.select("id", F.col("ord").alias("to_ord")), "id").join(doors.select(F.col("id").alias("src"), F.col("ord").alias("from_ord")), "src").where(F.col("src") != F.col("id"))
    w = Window.partitionBy("src").orderBy("d", "to_ord")
    top = ends.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    pair = top.withColumns({"lo": F.least("src", "id"), "hi": F.greatest("src", "id")})
    return pair.groupBy("lo", "hi").agg(F.min_by(F.struct(F.col("src").alias("a"), F.col("id").alias("b"), "d"), F.struct("from_ord", "rank")).alias("x")).select("x.a", "x.b", "x.d")


#: Rows of a building on either side of a block of pairs, and pairs a partition.
CLIQUE_BLOCK, CLIQUE_PAIRS = 1_000, 4_000_000


def clique(nodes: DataFrame, factor: float = 1.25, least: float = 5.0, k: Column | float = 1.0) -> DataFrame:
    """Arcs (a, b, m, w) between all nodes (building, id, ord, lon, lat) of a building.

    Doors of one building are few; a building of more than CLIQUE_BLOCK has its pairs
    dealt in blocks, over so many partitions that each makes about CLIQUE_PAIRS."""
    sizes = nodes.where("building IS NOT NULL").groupBy("building").agg(F.count("*").alias("_n"))
    pairs = sizes.agg(F.sum(F.col("_n") * F.col("_n"))).first()[0] or 0  # one number comes to the driver
    p = nodes.select("building", F.col("id").alias("a"), F.col("ord").alias("oa"), F.struct("lon", "lat").alias("pa"))
    q = nodes.select("building", F.col("id").alias("b"), F.col("ord").alias("ob"), F.struct("lon", "lat").alias("pb"))
    m = F.greatest(F.lit(least), S.metres("pa", "pb") * factor)
    on = ["building"]
    if pairs > CLIQUE_BLOCK**2:
        large = F.broadcast(sizes.where(F.col("_n") > CLIQUE_BLOCK).select("building", F.ceil(F.col("_n") / CLIQUE_BLOCK).alias("_g")))  # a thousandth of the rows at most
        on, parts = ["building", "_i", "_j"], int(-(-pairs // CLIQUE_PAIRS))

        def blocks(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
            g = F.coalesce("_g", F.lit(1))
            dealt = df.join(large, "building", "left").withColumn(own, F.pmod(F.xxhash64(key), g)).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), g - 1)))
            return dealt.drop("_g").repartition(max(parts, 1), *on)

        p, q = blocks(p, "a", "_i", "_j"), blocks(q, "b", "_j", "_i").hint("merge")
    one = p.join(q, on).where("oa < ob").select("building", "a", "b", m.alias("m")).withColumn("w", F.col("m") * S.c(k))
    if pairs <= CLIQUE_BLOCK**2:
        return both_ways(one)
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return one.withColumn("_e", ends).select("building", "_e.a", "_e.b", "m", "w")


def anchors(campus: DataFrame, levels: DataFrame, nodes: DataFrame, cap: float = 25.0, least: float = 2.0) -> DataFrame:
    """Arcs between campus nodes (code, id, z, x, y) and the nearest indoor node of the level nearest to z (0 where null); one level only."""
    from .spatial import level_nearest, nearest_capped

    at = campus.withColumn("z", F.coalesce("z", F.lit(0.0)))
    here = at.join(level_nearest(at, levels, ("code",)), ["code", "id"])
    near = nearest_capped(here.select("code", "level", "id", "x", "y"), nodes, cap, ("code", "level"), strict=False)
    m = F.greatest(F.lit(least), F.col("d"))
    one = near.select(F.col("id").alias("a"), S.indoor_node("code", "level", "near_id").alias("b"), m.alias("m"), m.alias("w"), "code", "level")
    return both_ways(one)


def reachable(vertices: DataFrame, arcs: DataFrame) -> DataFrame:
    """(id, label, alone): components of the vertices; all are mutually reachable iff one label remains."""
    return components(vertices, arcs)


def degrees(arcs: DataFrame) -> DataFrame:
    return arcs.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"))


def prune_spurs(chains: DataFrame, least: float) -> DataFrame:
    """Drops chains (id, a, b, length) with exactly one dead end and a length under least, until none is left."""
    left = kept(chains)
    while True:
        ends = left.select(F.col("a").alias("n")).union(left.select("b")).groupBy("n").agg(F.count("*").alias("k"))
        a, b = ends.select(F.col("n").alias("a"), F.col("k").alias("ka")), ends.select(F.col("n").alias("b"), F.col("k").alias("kb"))
        spur = left.join(a, "a").join(b, "b").where((F.col("length") < least) & ((F.col("ka") == 1) != (F.col("kb") == 1))).select("id")
        after = kept(left.join(spur, "id", "left_anti"))
        if after.count() == left.count():
            return after
        left = after



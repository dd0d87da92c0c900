"""Near-duplicate join: documents whose sets of five-word shingles have Jaccard similarity 0.8 or more.

MinHash LSH forest: every set has TREES labels, the concatenated minima of DEPTH
hash functions. A range sort of (tree, label) lays each tree's labels out as a
prefix trie, and one scan of neighbours tells how deep each label has company. Two
sets are candidates where their labels share a prefix. Prefixes are first matched
at DEPTH and shortened as long as the links found so far say that too many are
missing: a link of similarity s is found at depth k with probability
p = 1 - (1 - s^k)^TREES, so each one found stands for 1/p links, and a depth is
enough where the missing ones, and one unseen link at the threshold, are at most
1 - RECALL of all. The next prefix is the longest that is enough for the links
known; with those it adds the question is asked anew. floor_depth() is where even
links at the threshold all meet.

Candidates are verified exactly on the sets of 64-bit shingle hashes, but for
those whose signatures lie six standard deviations below the threshold (a chance
of 1e-9 for a link, part of the recall).

Texts with equal sets are one node. A trie node with up to SMALL members gives its
pairs; a larger one is cut into blocks. Pairs of blocks first compare signatures,
then the sets of members that have an undecided partner, and return only sums per
member and a spanning edge for each, never the pairs. Every pair is decided in one
place: at the first depth tried that its longest common prefix reaches, in the
first tree that reaches it.

Words are what stands between white space in the lower-cased text. A text of
under five words has one shingle, all its words; one without words (null, empty)
has none, links to nothing and is a class of its own. Repeated rows give one
result each. n_links counts the other rows with similarity of 0.8 or more, rows
with an equal set included. class_id is the smallest doc_id of the class; null
doc_ids are larger than any other. Other columns are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH = 24, 8
RECALL, BINS = 0.9999, 40
#: Members of a trie node whose pairs are listed; a larger node goes through blocks.
SMALL, BLOCK = 32, 640
REMEMBERED = 200_000
_NONE = 2**63 - 1

_rng = np.random.default_rng(20240501)
_STEP = _rng.integers(0, 2**63, WORDS, dtype=np.uint64) | np.uint64(1)
_MUL = (_rng.integers(0, 2**32, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _rng.integers(0, 2**32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32)
_word_hash: dict[str, int] = {}
common.forgets(_word_hash.clear)


def found_at(depth: int, similarity: float) -> float:
    """The chance that sets of a similarity share a prefix of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def floor_depth(recall: float = 0.99999) -> int:
    """The depth below which nothing can be gained: sets at the threshold meet with this recall."""
    return next((d for d in range(DEPTH, 1, -1) if found_at(d, THRESHOLD) >= recall), 1)


def enough(depth: int, links: dict[int, int], recall: float = RECALL) -> bool:
    """Whether the links found down to a depth, by bins of their similarity, are as many of all as the recall asks for."""
    width = (1 - THRESHOLD) / BINS
    missing = sum(n * (1 / found_at(depth, THRESHOLD + width * i) - 1) for i, n in links.items())
    return missing + 1 - found_at(depth, THRESHOLD) <= (1 - recall) * max(1, sum(links.values()))


def _bins(inter: np.ndarray, union: np.ndarray) -> np.ndarray:
    return np.clip(((inter / union - THRESHOLD) / (1 - THRESHOLD) * BINS).astype(int), 0, BINS - 1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's five-word shingles."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    known = _word_hash
    try:
        h = np.array([known[w] for w in words], dtype=np.uint64)
    except KeyError:
        if len(known) > REMEMBERED:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.array([known[w] for w in words], dtype=np.uint64)
    if len(h) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest("\n".join(words))], dtype=np.uint64)
    n = len(h) - WORDS + 1
    with np.errstate(over="ignore"):
        s = h[:n] * _STEP[0]
        for i in range(1, WORDS):
            s += h[i : i + n] * _STEP[i]
            s ^= s >> np.uint64(31)
            s *= np.uint64(0x9E3779B97F4A7C15)
        s ^= s >> np.uint64(29)
        s *= np.uint64(0xBF58476D1CE4E5B9)
        s ^= s >> np.uint64(32)
    return np.unique(s)


def signature(s: np.ndarray) -> np.ndarray:
    """TREES * DEPTH minima, cut to 16 bits, which serve candidates only."""
    low = s.astype(np.uint32) ^ (s >> np.uint64(32)).astype(np.uint32)
    best = np.full(TREES * DEPTH, 2**32 - 1, dtype=np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(low), 256):
            part = low[at : at + 256]
            h = part[None, :] * _MUL[:, None]
            h += _ADD[:, None]
            np.minimum(best, h.min(axis=1), out=best)
    # high bits of a multiplicative hash are its good ones, but minima are small there: mix before cutting
    best ^= best >> np.uint32(15)
    with np.errstate(over="ignore"):
        best *= np.uint32(0x85EBCA6B)
    return (best >> np.uint32(16)).astype("<u2")


def _docs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, node, sig): node names the set of shingles, null where there is none."""

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sigs = [], []
            for text in common.strings(b.column(1)):
                s = shingles(text)
                nodes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "node", "sig"])

    return _docs(docs).mapInArrow(run, "doc_id long, node binary, sig binary")


def forest(nodes: DataFrame, floor: int) -> DataFrame:
    """(tree, label, deep, node): each tree's labels in order, less those without company at the floor; deep is the longest prefix shared with a neighbour."""

    @common.lean
    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype="<u2").reshape(b.num_rows, TREES, DEPTH).tobytes()
            width = 2 * DEPTH
            yield pa.RecordBatch.from_arrays([
                pa.array(np.tile(np.arange(TREES, dtype=np.int32), b.num_rows)),
                pa.array([sig[i : i + width] for i in range(0, len(sig), width)], pa.binary()),
                pa.array(list(itertools.chain.from_iterable(itertools.repeat(x, TREES) for x in b.column(0).to_pylist())), pa.binary()),
            ], ["tree", "label", "node"])

    @common.lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row, whose next neighbour is not known yet
        before = DEPTH  # the first row's may be in another partition

        def kept(rows: pa.RecordBatch, prior: np.ndarray, after: np.ndarray) -> pa.RecordBatch:
            deep = np.maximum(prior, after).astype(np.int32)
            return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(deep), rows.column(2)], ["tree", "label", "deep", "node"]).filter(pa.array(deep >= floor))

        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([held, b] if held else [b]).combine_chunks().to_batches()[0]
            label = np.frombuffer(b"".join(rows.column(1).to_pylist()), dtype="<u2").reshape(-1, DEPTH)
            tree = rows.column(0).to_numpy()
            same = np.cumprod(label[1:] == label[:-1], axis=1).sum(axis=1) * (tree[1:] == tree[:-1])
            prior = np.concatenate([[before], same])
            if len(same):
                yield kept(rows.slice(0, rows.num_rows - 1), prior[:-1], same)
            held, before = rows.slice(rows.num_rows - 1), prior[-1]
        if held:
            yield kept(held, np.array([before]), np.array([DEPTH]))

    grown = nodes.select("node", "sig").mapInArrow(grow, "tree int, label binary, node binary")
    ordered = grown.repartitionByRange(common.partitions(nodes.sparkSession), "tree", "label", "node").sortWithinPartitions("tree", "label", "node")
    return ordered.mapInArrow(scan, "tree int, label binary, deep int, node binary")


def _place(a: np.ndarray, b: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The longest prefix that labels share in any tree, and the first tree in which they share one of this depth."""
    deep = np.cumprod(a.reshape(-1, TREES, DEPTH) == b.reshape(-1, TREES, DEPTH), axis=2, dtype=np.uint8).sum(axis=2)
    return deep.max(axis=1), (deep >= depth).argmax(axis=1)


def level(trie: DataFrame, depth: int, above: int) -> tuple[DataFrame, DataFrame]:
    """Labels (tree, prefix, child, node) with company at a depth, and sizes (tree, prefix, n) of the trie's nodes there with two children or more at the depth above."""
    child = F.col("node") if above > DEPTH else F.substring("label", 1, 2 * above)
    rows = trie.where(F.col("deep") >= depth).select("tree", F.substring("label", 1, 2 * depth).alias("prefix"), child.alias("child"), "node")
    sizes = rows.groupBy("tree", "prefix").agg(F.count("*").alias("n"), F.min("child").alias("c0"), F.max("child").alias("c1")).where("c0 <> c1").select("tree", "prefix", "n")
    return rows, sizes


def small_pairs(members: DataFrame) -> DataFrame:
    """(a, b, tree) of the pairs of different children in trie nodes of 2 to SMALL members."""
    grouped = members.where(f"n <= {SMALL}").groupBy("tree", "prefix").agg(F.sort_array(F.collect_list(F.struct("node", "child"))).alias("nodes"))

    @common.lean
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(x["node"], y["node"], t) for t, nodes in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x, y in itertools.combinations(nodes, 2) if x["child"] != y["child"]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.binary(), pa.binary(), pa.int32()), strict=True)], ["a", "b", "tree"])

    return grouped.select("tree", "nodes").mapInArrow(pairs, "a binary, b binary, tree int").groupBy("a", "b").agg(F.min("tree").alias("tree"))


#: Share of equal minima below which no pair is verified.
LEAST_EQUAL = THRESHOLD - 6 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / (TREES * DEPTH))


def likely(pairs: DataFrame, nodes: DataFrame, depth: int, above: int) -> DataFrame:
    """Pairs that belong to this depth and tree, less those that no sets at the threshold could be."""

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), dtype="<u2").reshape(b.num_rows, -1) for i in (3, 4))
            deep, first = _place(x, y, depth)
            keep = ((x == y).mean(axis=1) >= LEAST_EQUAL) & (deep >= depth) & (deep < above) & (first == b.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(keep))

    side = lambda c: nodes.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "tree", "sig_a", "sig_b").mapInArrow(run, "a binary, b binary")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, set) of the wanted (node, doc_id), from one text each."""

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t) for t in common.strings(b.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], ["node", "set"])

    texts = common.semi_by_id(_docs(docs), wanted, "doc_id")
    return texts.mapInArrow(run, "node binary, set binary").join(wanted.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, bin) of the pairs whose sets reach the threshold."""

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                n = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= THRESHOLD * max(len(x), len(y)) - 1e-9 else 0
                union = len(x) + len(y) - n
                bins.append(int(_bins(np.array(n), np.array(union))) if n >= THRESHOLD * union - 1e-9 else None)
            bins = pa.array(bins, pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[:2], bins], ["a", "b", "bin"]).filter(bins.is_valid())

    side = lambda c: sets.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a binary, b binary, bin int")


def _inter(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of their incidence matrices."""
    every = np.concatenate([*x, *y])
    codes, which, many = np.unique(every, return_inverse=True, return_counts=True)
    shared = many > 1  # others meet nothing
    dense = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in (*x, *y)])
    use = shared[which]
    owner, column = owner[use], dense[which[use]]
    out = np.zeros((len(x), len(y)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, int(shared.sum()), 2048):
        lo, hi = np.searchsorted(column, (at, at + 2048))
        m = np.zeros((len(x) + len(y), 2048), dtype=np.float32)
        m[owner[lo:hi], column[lo:hi] - at] = 1
        out += m[: len(x)] @ m[len(x) :].T
    return out


def _undecided(left: np.ndarray, right: np.ndarray, depth: int, above: int, tree: int, same: bool) -> np.ndarray:
    """Which pairs of two blocks' signatures are decided at this depth and tree and may be links."""
    a, b = (x.reshape(-1, TREES, DEPTH) for x in (left, right))
    codes = lambda x, k: [np.ascontiguousarray(x[:, t, :k]).view(f"V{2 * k}").ravel() for t in range(TREES)]
    number = lambda x, y: np.unique(np.concatenate([x, y]), return_inverse=True)[1]

    def equal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n = number(x, y)
        return n[: len(x), None] == n[None, len(x) :]

    out = np.triu(np.ones((len(a), len(b)), dtype=bool), 1) if same else np.ones((len(a), len(b)), dtype=bool)
    for x, y in zip(codes(a, depth)[:tree], codes(b, depth)[:tree], strict=True):
        out &= ~equal(x, y)
    if above <= DEPTH:
        for x, y in zip(codes(a, above)[tree:], codes(b, above)[tree:], strict=True):
            out &= ~equal(x, y)
    for at in range(0, len(a), 16):  # few enough rows to compare whole signatures
        rows = np.flatnonzero(out[at : at + 16].any(axis=1)) + at
        if len(rows):
            out[rows] &= (left[rows][:, None, :] == right[None, :, :]).mean(axis=2, dtype=np.float32) >= LEAST_EQUAL
    return out


def _signatures(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype="<u2").reshape(-1, TREES * DEPTH)


_BLOCK = ["tree", "prefix", "i", "j"]


def open_blocks(members: DataFrame, nodes: DataFrame, depth: int, above: int) -> DataFrame:
    """(tree, prefix, i, j, mine, node, sig, size): members of pairs of blocks of large trie nodes that have an undecided partner there."""
    large = members.where(f"n > {SMALL}").withColumn("k", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    signed = large.join(nodes.select("node", "sig", "size"), "node")
    # each member goes to the pairs of blocks that hold its own
    dealt = signed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("tree", "prefix", F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j"), "mine", "node", "sig", "size")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        tree, i, j = key[0].as_py(), key[2].as_py(), key[3].as_py()
        mine, sig = table.column("mine").to_numpy(), _signatures(table)
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        keep = np.zeros(table.num_rows, dtype=bool)
        if len(left) and len(right):
            todo = _undecided(sig[left], sig[right], depth, above, tree, i == j)
            keep[left[todo.any(axis=1)]] = True
            keep[right[todo.any(axis=0)]] = True
        return table.filter(pa.array(keep))

    return dealt.groupBy(*_BLOCK).applyInArrow(run, dealt.schema)


def blocks(opened: DataFrame, sets: DataFrame, depth: int, above: int) -> DataFrame:
    """(node, other, links, bin): for each member the rows it links to in a pair of blocks, and one edge that keeps its component; and, without a node, the number of links by bins."""
    full = opened.join(sets, "node")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        tree, i, j = key[0].as_py(), key[2].as_py(), key[3].as_py()
        node, size = table.column("node").to_pylist(), table.column("size").to_numpy()
        mine, sig = table.column("mine").to_numpy(), _signatures(table)
        held = [np.frombuffer(s, dtype=np.uint64) for s in table.column("set").to_pylist()]
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        out: list[tuple] = []
        if len(left) and len(right):
            todo = _undecided(sig[left], sig[right], depth, above, tree, i == j)
            x, y = np.nonzero(todo)
            if len(x) * 50 > todo.size:
                inter = _inter([held[a] for a in left], [held[b] for b in right])[x, y]
            else:
                inter = np.array([len(np.intersect1d(held[left[a]], held[right[b]], assume_unique=True)) for a, b in zip(x, y, strict=True)], dtype=np.float32)
            length = np.array([len(s) for s in held], dtype=np.float32)
            rows, columns = left[x], right[y]
            union = length[rows] + length[columns] - inter
            link = inter >= THRESHOLD * union - 1e-6
            rows, columns = rows[link], columns[link]
            bins = np.bincount(_bins(inter[link], union[link]), minlength=BINS)
            links = np.bincount(rows, size[columns], len(node)) + np.bincount(columns, size[rows], len(node))
            parent = list(range(len(node)))

            def root(x: int) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for a, b in zip(rows.tolist(), columns.tolist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            out = [(node[x], node[root(x)], int(links[x]), None) for x in np.flatnonzero(links)]
            out += [(None, None, int(bins[k]), int(k)) for k in np.flatnonzero(bins)]
        columns_ = zip(*out, strict=True) if out else ([], [], [], [])
        return pa.table([pa.array(c, k) for c, k in zip(columns_, (pa.binary(), pa.binary(), pa.int64(), pa.int32()), strict=True)], ["node", "other", "links", "bin"])

    return full.groupBy(*_BLOCK).applyInArrow(run, "node binary, other binary, links long, bin int")


def links_of(docs: DataFrame, nodes: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b, bin) from small trie nodes and sums (node, other, links, bin) from large ones, from the deepest prefixes down."""
    floor = floor_depth()
    trie = common.stage(forest(nodes, floor), folder, "forest")
    total = trie.count()
    empty = lambda schema: docs.sparkSession.createDataFrame([], schema)
    edges, bulk, sets = empty("a binary, b binary, bin int"), empty("node binary, other binary, links long, bin int"), empty("node binary, set binary")
    depth, above = DEPTH, DEPTH + 1
    while True:
        rows, sizes = level(trie, depth, above)
        sizes = common.stage(sizes, folder, f"sizes-{depth}")
        many = sizes.agg(F.count_if(F.col("n") <= SMALL).alias("small"), F.count_if(F.col("n") > SMALL).alias("large")).first()
        if many.small or many.large:
            members = common.stage(common.join_classes(rows, sizes, ["tree", "prefix"], "n", total), folder, f"members-{depth}")
            involved = []
            if many.small:
                pairs = common.stage(likely(small_pairs(members), nodes, depth, above), folder, f"pairs-{depth}")
                involved += [pairs.select(F.col("a").alias("node")), pairs.select("b")]
            if many.large:
                opened = common.stage(open_blocks(members, nodes, depth, above), folder, f"open-{depth}")
                involved.append(opened.select("node"))
            fresh = reduce(DataFrame.union, involved).distinct().join(sets.select("node"), "node", "left_anti")
            wanted = common.stage(nodes.join(fresh, "node", "left_semi").select("node", F.when(F.col("first_id") != _NONE, F.col("first_id")).alias("doc_id")), folder, f"wanted-{depth}")
            if not wanted.isEmpty():
                sets = sets.union(common.stage(sets_of(docs, wanted), folder, f"sets-{depth}"))
            if many.small:
                edges = edges.union(common.stage(verify(pairs, sets), folder, f"edges-{depth}"))
            if many.large:
                bulk = bulk.union(common.stage(blocks(opened, sets, depth, above), folder, f"bulk-{depth}"))
        by_bin = edges.select("bin", F.lit(1).alias("n")).union(bulk.where("node IS NULL").select("bin", "links")).groupBy("bin").agg(F.sum("n").alias("n"))
        known = {r.bin: r.n for r in by_bin.collect()}
        if depth == floor or enough(depth, known):
            return edges, bulk.where("node IS NOT NULL")
        depth, above = next((d for d in range(depth - 1, floor, -1) if enough(d, known)), floor), depth


def join(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links, class_size), one row a document."""
    common.small_batches(spark)
    folder = common.work_folder(spark, "jaccard-join")
    sketched = common.stage(sketches(docs), folder, "sketches")
    grouped = sketched.where("node IS NOT NULL").groupBy("node").agg(F.min(F.coalesce("doc_id", F.lit(_NONE))).alias("first_id"), F.count("*").alias("size"))
    sigs = sketched.where("node IS NOT NULL").select("node", "sig", F.coalesce("doc_id", F.lit(_NONE)).alias("first_id")).join(grouped, ["node", "first_id"])
    nodes = common.stage(sigs.dropDuplicates(["node"]), folder, "nodes")
    edges, bulk = links_of(docs, nodes, folder)

    size_of = nodes.select("node", "size")
    other = size_of.withColumnRenamed("node", "other")
    by_edge = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a")).join(other, "other").select("node", F.col("size").alias("links"))
    linked = by_edge.union(bulk.select("node", "links")).groupBy("node").agg(F.sum("links").alias("links"))
    tree = edges.select("a", "b").union(bulk.select(F.col("node").alias("a"), F.col("other").alias("b")))
    roots = common.components(tree, folder)
    classed = nodes.select("node", "first_id", "size").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by_root = classed.groupBy("root").agg(F.min("first_id").alias("class_id"), F.sum("size").alias("class_size"))
    total = sketched.count()
    nodes_classed = common.join_classes(classed.select("node", "root", "size"), by_root, ["root"], "class_size", total).join(linked, "node", "left").select("node", "class_id", "class_size", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("size"))
    final = common.stage(nodes_classed, folder, "classes")
    with_words = common.join_classes(sketched.where("node IS NOT NULL").select("doc_id", "node"), final, ["node"], "size", total)
    alone = sketched.where("node IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("class_size"))
    return with_words.select("doc_id", F.when(F.col("class_id") != _NONE, F.col("class_id")).alias("class_id"), "n_links", "class_size").unionByName(alone)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark, common.parquet(spark, sf_dir, "documents"))


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
              ELSE list_transform(range(len(ws) - 4), lambda i: array_to_string(ws[i + 1:i + 5], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE c * 10 >= 8 * (p.n + q.n - c)),
r(v, l) USING KEY (v) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT e.b, min(r.l) FROM r JOIN e ON e.a = r.v JOIN recurring.r c ON c.v = e.b WHERE r.l < c.l GROUP BY e.b)
SELECT v AS doc_id, l AS class_id, (SELECT count(*) FROM e WHERE e.a = v) AS n_links, count(*) OVER (PARTITION BY l) AS class_size FROM r
"""

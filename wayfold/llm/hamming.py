"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code holds the signs of its values (1 where positive). Codes fall into
m segments of about log2(n) bits, each with a table from a segment's value to the
codes that have it. Codes within distance m * r + j of a query agree with it
within r bits in one of the first j + 1 segments or within r - 1 in a later one, so
the radius grows segment by segment until k verified codes lie within the distance
covered: these are provably the nearest.

Equal codes are one entry with its k smallest ids, since no other of its ids can be
among the k best. The index is dealt into blocks by a hash and the queries into
blocks too; every query block meets every index block, and the blocks' best k are
merged. Ties in distance go to the smaller id. A query finds itself.

A vector's code has as many bits as it has values, 64 at most; others are an error.
NaN sorts above all numbers in SQL and counts as positive; zero and -0.0 don't.
A null vector, or one with a null value or of another length than bits, has no
code: it is neither found nor asked. Repeated rows are found each, and asked once.
Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Codes in an index block (tables of some 30 MB) and in a query block.
INDEX_BLOCK, QUERY_BLOCK = 1 << 20, 1 << 17
_masks: dict[tuple[int, int], np.ndarray] = {}


def masks(width: int, weight: int) -> np.ndarray:
    """All values of width bits with weight ones."""
    if (width, weight) not in _masks:
        _masks[width, weight] = np.array([sum(1 << i for i in c) for c in combinations(range(width), weight)], dtype=np.uint64)
    return _masks[width, weight]


class Index:
    def __init__(self, codes: np.ndarray, ids: list[list[int]], bits: int):
        """Distinct codes, each with its smallest ids in order."""
        self.codes, self.ids = codes, ids
        self.many = np.array([len(x) for x in ids], dtype=np.int64)
        m = max(1, min(bits, round(bits / max(4, min(16, math.log2(len(codes) + 1))))))
        self.widths = [bits // m + (i < bits % m) for i in range(m)]
        self.shifts = [sum(self.widths[:i]) for i in range(m)]
        self.order, self.starts = [], []
        for w, s in zip(self.widths, self.shifts, strict=True):
            v = self.part(codes, w, s)
            self.order.append(np.argsort(v, kind="stable"))
            self.starts.append(np.concatenate([[0], np.cumsum(np.bincount(v.astype(np.int64), minlength=1 << w))]))

    @staticmethod
    def part(x: np.ndarray, width: int, shift: int) -> np.ndarray:
        return (x >> np.uint64(shift)) & np.uint64((1 << width) - 1)

    def search(self, queries: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
        """(position of the query, distance, id) of each query's k nearest."""
        for at in range(0, len(queries), 64):
            yield from self._search(queries[at : at + 64], k, at)

    def _search(self, queries: np.ndarray, k: int, base: int) -> Iterator[tuple[int, int, int]]:
        m = len(self.widths)
        active = np.arange(len(queries))
        found_q, found_c, found_d = (np.zeros(0, dtype=np.int64) for _ in range(3))
        for r in range(max(self.widths) + 1):
            for j in range(m):
                if r <= self.widths[j] and len(active):
                    probes = (self.part(queries[active], self.widths[j], self.shifts[j])[:, None] ^ masks(self.widths[j], r)[None, :]).astype(np.int64)
                    first, last = self.starts[j][probes].ravel(), self.starts[j][probes + 1].ravel()
                    many = last - first
                    ends = np.cumsum(many)
                    total = int(ends[-1])
                    c = self.order[j][np.repeat(first - (ends - many), many) + np.arange(total)]
                    q = np.repeat(np.repeat(active, probes.shape[1]), many)
                    x = queries[q] ^ self.codes[c]
                    new = np.ones(total, dtype=bool)  # not found by a nearer segment, nor by an earlier one as near
                    for i in range(m):
                        if i != j:
                            d = np.bitwise_count(self.part(x, self.widths[i], self.shifts[i]))
                            new &= d > r if i < j else d >= r
                    found_q, found_c = np.concatenate([found_q, q[new]]), np.concatenate([found_c, c[new]])
                    found_d = np.concatenate([found_d, np.bitwise_count(x[new]).astype(np.int64)])
                covered = m * r + j
                near = found_d <= covered
                enough = np.bincount(found_q[near], self.many[found_c[near]], minlength=len(queries)) >= k
                done = enough[active] if r < max(self.widths) or j < m - 1 else np.ones(len(active), dtype=bool)
                if done.any():
                    over = np.zeros(len(queries), dtype=bool)
                    over[active[done]] = True
                    mine = over[found_q] & (near | (r == max(self.widths)))
                    order = np.lexsort((found_d[mine], found_q[mine]))
                    yield from self._best(found_q[mine][order], found_d[mine][order], found_c[mine][order], k, base)
                    keep = ~over[found_q]
                    found_q, found_c, found_d = found_q[keep], found_c[keep], found_d[keep]
                    active = active[~done]
                if not len(active):
                    return

    def _best(self, q: np.ndarray, d: np.ndarray, c: np.ndarray, k: int, base: int) -> Iterator[tuple[int, int, int]]:
        cuts = np.flatnonzero(np.diff(q, prepend=-1)).tolist()
        for lo, hi in zip(cuts, [*cuts[1:], len(q)], strict=True):
            ids = sorted((x, i) for x, y in zip(d[lo:hi].tolist(), c[lo:hi].tolist(), strict=True) for i in self.ids[y])
            for x, i in ids[:k]:
                yield int(q[lo]) + base, x, i


def codes(rows: DataFrame, bits: int) -> DataFrame:
    """(vec_id, code) of the vectors that have one."""
    if not 1 <= bits <= 64:
        raise ValueError("bits must be 1 to 64")

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if v is not None and len(v) == bits and None not in v:
                    ids.append(i)
                    out.append(v)
            signs = np.zeros((len(out), 64), dtype=np.uint8)
            if out:
                values = np.array(out, dtype=np.float32)
                signs[:, 64 - bits :] = (values > 0) | np.isnan(values)
            code = np.packbits(signs, axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64) if out else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(code)], ["vec_id", "code"])

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")).where("vec_id IS NOT NULL").mapInArrow(run, "vec_id long, code long")


def _fewest(rows: DataFrame, k: int) -> DataFrame:
    """(code, ids): the k smallest ids of each code, combined batch by batch before the shuffle."""

    @common.lean
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: dict[int, list[int]] = {}
            for i, c in sorted(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                held.setdefault(c, [])
                if len(held[c]) < k:
                    held[c].append(i)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.list_(pa.int64()))], ["code", "ids"])

    some = rows.mapInArrow(first, "code long, ids array<long>").select("code", F.posexplode("ids").alias("place", "id"))
    best = Window.partitionBy("code").orderBy("id")
    return some.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def search(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int, bits: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, distance) of the k nearest vectors of every query."""
    folder = common.work_folder(spark, "hamming")
    index = common.stage(_fewest(codes(vectors, bits), k), folder, "index")
    asked = common.stage(codes(queries, bits).distinct(), folder, "asked")
    distinct = common.stage(asked.groupBy("code").agg(F.count("*").alias("size")), folder, "distinct")
    n, q, total = index.count(), distinct.count(), asked.count()
    index_blocks = max(1, -(-n // INDEX_BLOCK))
    # Each query block copies the index and builds its tables again, so more of them serve only to give every core an index block.
    query_blocks = max(1, -(-q // QUERY_BLOCK), min(-(-common.partitions(spark) // index_blocks), -(-q // 200)))
    dealt = index.select(F.pmod(F.xxhash64("code"), F.lit(index_blocks)).alias("ib"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"), "code", "ids")
    sent = distinct.select(F.pmod(F.hash("code"), F.lit(query_blocks)).alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(index_blocks - 1).cast("long"))).alias("ib"), "code")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            held = Index(left.column("code").to_numpy().view(np.uint64), left.column("ids").to_pylist(), bits)
            asked = right.column("code").to_numpy()
            out = [(int(asked[i]), d, x) for i, d, x in held.search(asked.view(np.uint64), k)]
        columns = zip(*out, strict=True) if out else ([], [], [])
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64()), strict=True)], ["code", "distance", "vec_id"])

    found = dealt.groupBy("ib", "qb").cogroup(sent.groupBy("ib", "qb")).applyInArrow(run, "code long, distance int, vec_id long")
    nearest = Window.partitionBy("code").orderBy("distance", "vec_id")
    best = found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    best = common.stage(best.groupBy("code").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "distance"))).alias("best")).join(distinct, "code"), folder, "best")
    joined = common.join_classes(asked.withColumnRenamed("vec_id", "query_id"), best, ["code"], "size", total)
    return joined.select("query_id", F.explode("best").alias("b")).select("query_id", F.col("b.rank").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.distance").alias("distance"))


def op6_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.parquet(spark, sf_dir, "embeddings")
    return search(spark, rows, rows.where("vec_id % 20 = 0"), 10)


ORACLE = """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS s FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = 64),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(len(list_filter(range(1, 65), lambda i: q.s[i] <> c.s[i])) AS INTEGER) AS distance FROM c q, c WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id, distance
FROM p QUALIFY rank <= 10
"""

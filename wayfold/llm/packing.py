"""Vector best-fit packing of documents into token sequences.

Every sequence has three capacities: tokens, documents and attention cost (the
sum of squared piece lengths). Pieces are placed from the longest to the
shortest; each goes to the open sequence that has room under all three and whose
residual scores best, either by the weighted norm of what would remain or by the
weighted dot product of the piece and the residual.

Pieces of one length are alike, so the search runs over the counts of the
lengths (2,048 rows at most, whatever the input) and handles all sequences with
the same residual at once. Each piece then finds its place by its rank within its
length: a task numbers its own pieces, and sums over the tasks give the rest.

A null text is empty and still has the end id. Documents longer than a sequence
are cut into full pieces after a first piece that may be shorter. Repeated rows
are packed one by one. Other columns are not read. An empty table gives none.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .encode import REMEMBERED, default_path, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"
#: First ranks up to so many (some 13 MB) are broadcast.
SMALL_STARTS = 100_000
_RANK_BITS = 40


def cut(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter than longest."""
    first = n % longest or min(n, longest)
    return [(0, first), *((at, longest) for at in range(first, n, longest))]


def plan(counts: dict[int, int], tokens: int, documents: int, attention: int, weights: tuple[float, float, float] = (1.0, 0.02, 0.02), score: str = "norm") -> dict[str, np.ndarray]:
    """Where the pieces of each length go.

    Arrays by (size, lo): ranks lo.. of that size fill sequences from base on,
    k in each, the first at offset. Every length must fit into an empty sequence."""
    w = np.array(weights, dtype=float)
    caps = np.array([tokens, documents, attention], dtype=float)
    room = np.zeros((0, 3), dtype=np.int64)  # of each class of open sequences
    many: np.ndarray = np.zeros(0, dtype=np.int64)
    filled: list[tuple[tuple[int, int], ...]] = []  # (size, k) of each class, in order
    done: list[tuple[tuple[tuple[int, int], ...], int]] = []
    sizes = sorted((s for s, c in counts.items() if c), reverse=True)
    for s in sizes:
        item = np.array([s, 1, s * s], dtype=np.int64)
        left = counts[s]
        alive = room[:, 0] >= sizes[-1]
        if len(alive) and not alive.all():  # no piece to come fits in these
            done += [(filled[i], int(many[i])) for i in np.flatnonzero(~alive)]
            room, many, filled = room[alive], many[alive], [filled[i] for i in np.flatnonzero(alive)]
        if len(room):
            if score == "norm":
                rank = (((room - item) / caps) ** 2 * w).sum(axis=1)
            else:
                rank = -((room / caps) * (item / caps) * w).sum(axis=1)
            fits = np.flatnonzero((room >= item).all(axis=1))
            best = fits[np.argsort(rank[fits], kind="stable")]
        else:
            best = np.zeros(0, dtype=np.int64)
        new_room, new_many, new_filled = [], [], []
        for i in best:
            if not left:
                break
            k = int((room[i] // item).min())
            full = min(int(many[i]), left // k)
            for bins, each in ((full, k), (1 if full < many[i] else 0, min(k, left - full * k))):
                if bins and each:
                    new_room.append(room[i] - each * item)
                    new_many.append(bins)
                    new_filled.append((*filled[i], (s, each)))
                    many[i] -= bins
                    left -= bins * each
        if left:
            k = int((caps.astype(np.int64) // item).min())
            if not k:
                raise ValueError(f"a piece of {s} tokens doesn't fit into an empty sequence")
            for bins, each in ((left // k, k), (1, left % k)):
                if bins and each:
                    new_room.append(caps.astype(np.int64) - each * item)
                    new_many.append(bins)
                    new_filled.append(((s, each),))
        keep = many > 0
        room = np.concatenate([room[keep], np.array(new_room, dtype=np.int64).reshape(-1, 3)])
        filled = [filled[i] for i in np.flatnonzero(keep)] + new_filled
        many = np.concatenate([many[keep], np.array(new_many, dtype=np.int64)])
    done += [(f, int(m)) for f, m in zip(filled, many, strict=True)]
    used: Counter[int] = Counter()
    rows, base = [], 0
    for pattern, bins in done:
        offset = 0
        for s, k in pattern:
            rows.append((s, used[s], base, k, offset))
            used[s] += k * bins
            offset += s * k
        base += bins
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return {"code": (table[:, 0] << _RANK_BITS) | table[:, 1], "lo": table[:, 1], "base": table[:, 2], "k": table[:, 3], "offset": table[:, 4], "sequences": np.array(base)}


def place(p: dict[str, np.ndarray], size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(p["code"], (size << _RANK_BITS) | rank, side="right") - 1
    j = rank - p["lo"][at]
    return p["base"][at] + j // p["k"][at], p["offset"][at] + (j % p["k"][at]) * size


def pieces(docs: DataFrame, tokenizer: str, end_id: int, longest: int, remembered: int = REMEMBERED) -> DataFrame:
    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc, seen = TaskContext.get().partitionId(), encoder(tokenizer, remembered), Counter()
        for b in batches:
            out: list[tuple] = []
            for doc_id, data in zip(b.column(0).to_pylist(), enc.encode(common.strings(b.column(1))), strict=True):
                ids = np.append(enc.ids(data), np.uint32(end_id)).astype("<u4")
                for i, (start, n) in enumerate(cut(len(ids), longest)):
                    out.append((doc_id, i, start, n, zlib.crc32(ids[start : start + n].tobytes()), part, seen[n]))
                    seen[n] += 1
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 0, tokens: int = 2048, documents: int | None = None, attention: int | None = None, weights: tuple[float, float, float] = (1.0, 0.02, 0.02), score: str = "norm", remembered: int = REMEMBERED, batch_rows: int = 2000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row a piece.

    documents and attention default to what tokens alone allow. remembered and
    batch_rows trade a worker's memory for its time; the result is the same."""
    common.small_batches(spark, batch_rows)
    folder = common.work_folder(spark, "packing")
    attention = tokens * tokens if attention is None else attention
    longest = min(tokens, math.isqrt(attention))
    cutted = common.stage(pieces(docs, tokenizer, end_id, longest, remembered), folder, "pieces")
    by_part = cutted.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = common.stage(by_part.withColumn("first_rank", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long")), folder, "starts")
    counts = {r.length: r.n for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # 2,048 rows at most
    sent = spark.sparkContext.broadcast(plan(counts, tokens, documents or tokens, attention, weights, score))

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = place(sent.value, size, rank)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], [*b.schema.names[:5], "sequence_id", "offset"])

    begin = starts.drop("n")  # a row for each length of each part, so they grow with the input
    begin = F.broadcast(begin) if begin.limit(SMALL_STARTS + 1).count() <= SMALL_STARTS else begin.hint("merge")
    ranked = cutted.join(begin, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first_rank") + F.col("local_rank")).alias("rank"))
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, common.parquet(spark, sf_dir, "documents"), default_path(), remembered=600_000, batch_rows=3000)

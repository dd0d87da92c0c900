"""Importance resampling towards a target: the rows whose scores (weight plus Gumbel noise) are highest.

Features are runs of 1 to ``longest`` consecutive words; a feature's bucket is its CRC-32 modulo
``buckets``. Bucket counts of source and target become one array of gains, and a
row's weight is the sum of its features' gains. The noise is drawn from a hash of
doc_id, so the draw is the same at every run.

Drawing is an external sort that goes no further than it must. Tasks sort their
eligible rows into runs of bounded length and write them to the shared folder.
Ranges of scores are cut at quantiles; how many rows each holds is counted, so
every range knows the first rank of its rows and ranges behind the last one drawn
are never read. The slices that the runs hold of a range meet in a tournament tree
(of losers) that reads them in blocks; where there are more than FAN slices, groups
of them first become longer runs. A merge ends after the number it is asked for.
Rows not drawn are told by comparison with the last one drawn, without a join.

A null text has no features: weight 0, not eligible. Nothing in source or target
leaves weights that are sums over no bucket, or gains of empty counts, as the
formula says. A null doc_id is hashed as the empty string and comes last among
equals. Repeated rows are scored, and drawn, each by itself; equal scores are in
order of doc_id, rows equal in that too in any order. Other columns are not read,
so names may clash. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import struct
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, "2024"
#: Rows of a sorted run, of a range of scores, and of a block that a merge holds of each slice; slices of one merge.
RUN_ROWS, RANGE_ROWS, BLOCK_ROWS, FAN = 1 << 19, 1 << 20, 2048, 64
REMEMBERED = 300_000

#: A row of a run. key is minus the score, then whether doc_id is missing; row makes the order total.
_RUN = np.dtype([("key", "<i8"), ("missing", "<i8"), ("doc_id", "<i8"), ("row", "<i8"), ("n_features", "<i8"), ("weight", "<i8")])
_ROW = struct.Struct("<6q")
_ORDER = ("row", "doc_id", "missing", "key")
_END = (math.inf,)

_LETTERS = bytearray(b" " * 256)
for _c in itertools.chain(range(0x30, 0x3A), range(0x61, 0x7B), range(0x80, 0x100)):
    _LETTERS[_c] = _c
for _c in range(0x41, 0x5B):
    _LETTERS[_c] = _c + 32
_LETTERS = bytes(_LETTERS)


def words(text: str | None) -> list[bytes]:
    """Runs of digits, a-z and anything beyond ASCII, A-Z lower-cased, in UTF-8."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def features(text: str | None, longest: int) -> list[bytes]:
    one = words(text)
    return one if longest == 1 else one + [b" ".join(one[i : i + n]) for n in range(2, longest + 1) for i in range(len(one) - n + 1)]


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features of all texts by bucket. Tasks give one row a bucket at most; the driver gets one number a bucket."""

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            seen = Counter()
            for text in b.column(0).to_pylist():
                seen.update(features(text, longest))
            at = np.fromiter((zlib.crc32(w) % buckets for w in seen), dtype=np.int64, count=len(seen))
            np.add.at(found, at, np.fromiter(seen.values(), dtype=np.int64, count=len(seen)))
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(found[at], pa.int64())], ["bucket", "n"])

    counts = rows.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for r in counts.collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the source."""
    k, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + k) / ((float(a) + 1) * (t + k)))) for a, b in zip(source, target, strict=True)], dtype=np.int64)


def noise(doc_id: int | None, seed: str) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


class _Gain(dict):
    """Gains of features, remembered up to a number of them."""

    def __init__(self, gain: np.ndarray) -> None:
        self.gain = gain.tolist()

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[feature] = self.gain[zlib.crc32(feature) % len(self.gain)]
        return found


def score(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, seed: str = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row, over its whole text."""

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _Gain(gain)
        for b in batches:
            ids, rows = b.column(0).to_pylist(), []
            for doc_id, text in zip(ids, b.column(1).to_pylist(), strict=True):
                found = features(text, longest)
                n = len(found) if longest == 1 else len(words(text))
                rows.append((n, len(found), weight := sum(map(of.__getitem__, found)), weight + noise(doc_id, seed)))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def merged(sources: Iterable[Iterator[tuple]]) -> Iterator[tuple]:
    """Sorted iterators as one, by a tournament tree: each inner node keeps the loser of its match, so a new row plays along one path."""
    sources = list(sources)
    heads = [next(s, _END) for s in sources]
    k = len(heads)
    winner, loser = [0] * k + list(range(k)), [0] * max(k, 1)
    for node in range(k - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        winner[node], loser[node] = (a, b) if heads[a] <= heads[b] else (b, a)
    best = winner[1] if k > 1 else 0
    while k and heads[best] is not _END:
        yield heads[best]
        heads[best] = next(sources[best], _END)
        node = (best + k) // 2
        while node:
            if heads[loser[node]] < heads[best]:
                best, loser[node] = loser[node], best
            node //= 2


def read_slice(uri: str, start: int, end: int) -> Iterator[tuple]:
    """Rows start to end of a run, a block at a time."""
    fs, path = common.file_system(uri)
    with fs.open_input_file(path) as f:
        for at in range(start, end, BLOCK_ROWS):
            f.seek(at * _RUN.itemsize)
            yield from _ROW.iter_unpack(f.read((min(end, at + BLOCK_ROWS) - at) * _RUN.itemsize))


def packed(block: list[tuple]) -> bytes:
    return b"".join(_ROW.pack(*x) for x in block)


SLICE = "part int, path string, start long, end long"


def write_runs(scored: DataFrame, cuts: np.ndarray, folder: str) -> DataFrame:
    """Sorts the eligible rows of each task into runs; a row for every range of scores that a run has a slice of."""

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            rows = np.concatenate(held)
            rows = rows[np.lexsort([rows[c] for c in _ORDER])]
            uri = f"{folder}/run-{uuid.uuid4().hex}.bin"
            common.commit_file(uri, lambda out: out.write(rows.tobytes()))
            ends = np.concatenate([[0], np.searchsorted(rows["key"], cuts, side="right"), [len(rows)]])
            part = np.flatnonzero(np.diff(ends))
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([uri] * len(part)), pa.array(ends[part], pa.int64()), pa.array(ends[part + 1], pa.int64())], ["part", "path", "start", "end"])

        for b in batches:
            rows = np.empty(b.num_rows, dtype=_RUN)
            for c in ("row", "n_features", "weight"):
                rows[c] = b.column(c).to_numpy(zero_copy_only=False)
            rows["key"] = -b.column("score").to_numpy(zero_copy_only=False)
            rows["missing"] = b.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            rows["doc_id"] = b.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            held.append(rows)
            n += len(rows)
            if n >= RUN_ROWS:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    return scored.select("row", "doc_id", "n_features", "weight", "score").mapInArrow(run, SLICE)


def _grouped(slices: DataFrame, takes: dict[int, tuple[int, int]], fan: int) -> DataFrame:
    """Slices by range, at most fan in a row, with the range's first rank and how many rows are asked of it."""
    table = slices.sparkSession.createDataFrame([(k, first, take) for k, (first, take) in takes.items()], "part int, first long, take long")
    dealt = slices.withColumn("grp", F.pmod(F.xxhash64("path"), F.lit(fan)) if fan > 1 else F.lit(0))
    rows = dealt.groupBy("part", "grp").agg(F.sort_array(F.collect_list(F.struct("path", "start", "end"))).alias("slices"))
    return rows.join(F.broadcast(table), "part")


def longer_runs(slices: DataFrame, takes: dict[int, tuple[int, int]], groups: int, folder: str) -> DataFrame:
    """One pass over ranges with many slices: groups of them are merged into runs of their own."""

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for b in batches for r in b.to_pylist()):
            uri, n = f"{folder}/run-{uuid.uuid4().hex}.bin", 0

            def put(out, r=r) -> None:
                nonlocal n
                rows = itertools.islice(merged(read_slice(s["path"], s["start"], s["end"]) for s in r["slices"]), r["take"])
                while block := list(itertools.islice(rows, BLOCK_ROWS)):
                    out.write(packed(block))
                    n += len(block)

            common.commit_file(uri, put)
            yield pa.RecordBatch.from_arrays([pa.array([r["part"]], pa.int32()), pa.array([uri]), pa.array([0], pa.int64()), pa.array([n], pa.int64())], ["part", "path", "start", "end"])

    return _grouped(slices, takes, groups).mapInArrow(run, SLICE)


DRAWN = "row long, doc_id long, n_features long, weight long, score long, rank long"


def ranked(slices: DataFrame, takes: dict[int, tuple[int, int]]) -> DataFrame:
    """The rows drawn, with their ranks: one merge a range."""

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for b in batches for r in b.to_pylist()):
            rows, rank = itertools.islice(merged(read_slice(s["path"], s["start"], s["end"]) for s in r["slices"]), r["take"]), r["first"]
            while block := list(itertools.islice(rows, BLOCK_ROWS)):
                key, missing, doc_id, row, n, weight = zip(*block, strict=True)
                ids = [None if m else d for m, d in zip(missing, doc_id, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (row, ids, n, weight, [-x for x in key], range(rank, rank + len(block)))], ["row", "doc_id", "n_features", "weight", "score", "rank"])
                rank += len(block)

    return _grouped(slices, takes, 1).mapInArrow(run, DRAWN)


def draw(scored: DataFrame, folder: str, least_words: int = LEAST_WORDS, percent: int = PERCENT, fan: int = FAN, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of scored, which is a table in the shared folder."""
    spark = scored.sparkSession
    fit = scored.where(F.col("n_words") >= least_words)
    total = fit.count()
    wanted = total * percent // 100
    out = scored.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    if not wanted:
        return out
    ranges = max(common.partitions(spark), -(-total // range_rows))
    cuts = np.unique([-int(x) - 1 for x in fit.approxQuantile("score", [i / ranges for i in range(1, ranges)], 0.1 / ranges)] if ranges > 1 else []).astype(np.int64)
    slices = common.stage(write_runs(fit, cuts, folder), folder, "slices")
    sizes = {r.part: (r.n, r.runs) for r in slices.groupBy("part").agg(F.sum(F.col("end") - F.col("start")).alias("n"), F.count("*").alias("runs")).collect()}
    takes, first = {}, 1
    for part in sorted(sizes):
        if first <= wanted:
            takes[part] = (first, min(sizes[part][0], wanted - first + 1))
        first += sizes[part][0]
    slices, runs, i = slices.where(F.col("part").isin(list(takes))), max(sizes[part][1] for part in takes), 0
    while runs > fan:  # groups by a hash of the name: their sizes are near the mean, and any size is right
        runs, i = -(-runs // fan), i + 1
        slices = common.stage(longer_runs(slices, takes, runs, folder), folder, f"slices-{i}")
    drawn = common.stage(ranked(slices, takes), folder, "drawn")
    last = drawn.where(F.col("rank") == wanted).first()
    score, row = F.col("score"), F.col("row")
    after = (score < last.score) | (score == last.score) & (
        F.lit(last.doc_id is not None) & F.col("doc_id").isNull()
        | F.coalesce(F.col("doc_id") > F.lit(last.doc_id), F.lit(False))
        | F.col("doc_id").eqNullSafe(F.lit(last.doc_id).cast("long")) & (row > last.row)
    )
    rest = scored.where((F.col("n_words") < least_words) | after)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank").unionByName(rest.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """Scores every row of docs and draws percent of those with least_words words or more."""
    common.small_batches(spark)
    folder = common.work_folder(spark, "resampling")
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    scored = common.stage(score(docs, gain, longest, seed).withColumn("row", F.monotonically_increasing_id()), folder, "scored")
    return draw(scored, folder, least_words, percent)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark, common.parquet(spark, sf_dir, "documents"), common.parquet(spark, sf_dir, "benchmark"))


ORACLE = """
WITH steps AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
source AS (SELECT r, unnest(ws) AS w FROM docs),
target AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark),
vocabulary AS (SELECT DISTINCT w FROM (SELECT w FROM source UNION ALL SELECT w FROM target)),
hashed AS (SELECT w, xor(list_reduce([4294967295::BIGINT] || [('0x' || substr(hex(encode(w)), 2 * k - 1, 2))::BIGINT for k in range(1, octet_length(encode(w)) + 1)],
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM vocabulary, steps),
s AS (SELECT bucket, count(*) AS n FROM source JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM target JOIN hashed USING (w) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(n), 0) FROM s)::DOUBLE + 10000) / ((coalesce(s.n, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(n), 0) FROM t)::DOUBLE + 10000))))::BIGINT AS g FROM s FULL JOIN t USING (bucket)),
weights AS (SELECT r, sum(g)::BIGINT AS weight FROM source JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY r),
scored AS (SELECT r, doc_id, len(ws) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score FROM docs LEFT JOIN weights USING (r)),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN rank <= (SELECT count(*) * 10 // 100 FROM ranked) THEN rank END AS rank FROM scored LEFT JOIN ranked USING (r)
"""

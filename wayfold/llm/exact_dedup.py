"""Exact dedup against immutable snapshots screened by static binary-fuse filters.

A snapshot holds one row per distinct digest, in buckets by the digest's first
bytes, and a binary-fuse filter for each bucket. An incoming batch is first
grouped by itself; its distinct digests are screened by the filters, positives
join the exact buckets, and every group of two rows or more, within the batch,
within the snapshot or across, is confirmed by comparing bytes.

Texts are equal when identical after lower-casing A-Z only. A null text is
empty; empty texts are equal to each other. A null doc_id is less than any
other. Of rows that repeat doc_id and text one stays. Other columns are not
read, so names may clash. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, fuse

#: Distinct digests a bucket should hold: its filter is about 150 KB.
BUCKET_ROWS = 1 << 17


def sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def _normal(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass").lower()  # bytes.lower: A-Z only


def digest_rows(docs: DataFrame, digest: Callable[[bytes], bytes] = sha256) -> DataFrame:
    """(doc_id, digest, sha) of every row."""

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [_normal(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([digest(x) for x in data], pa.binary()), pa.array([sha256(x) for x in data] if digest is not sha256 else [None] * len(data), pa.binary())], ["doc_id", "digest", "sha"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, digest binary, sha binary")


def _grouped(rows: DataFrame) -> DataFrame:
    """One row for each digest; the map side combines hot groups."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("size"))


def with_bucket(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int"))


def write_snapshot(rows: DataFrame, folder: str, count: int) -> tuple[DataFrame, DataFrame, int]:
    """Writes the exact buckets and their filters; both are never changed afterwards."""
    buckets = max(1, -(-count // BUCKET_ROWS))
    exact = common.stage(with_bucket(_grouped(rows), buckets), folder, "exact")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([fuse.build(_keys(table.column("digest")))], pa.binary())})

    filters = exact.select("bucket", "digest").groupBy("bucket").applyInArrow(run, "bucket int, filter binary")
    return exact, common.stage(filters, folder, "filters"), buckets


def _keys(column: pa.ChunkedArray) -> np.ndarray:
    return np.array([int.from_bytes(x[:8].ljust(8, b"\0"), "little") for x in column.to_pylist()], dtype=np.uint64)


def screen(batch: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The batch's distinct digests that a filter holds possible; a bucket meets its own filter only."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"digest": pa.array([], pa.binary())})
        hit = fuse.contains(right.column("filter")[0].as_py(), _keys(left.column("digest")))
        return pa.table({"digest": left.column("digest").filter(pa.array(hit)).combine_chunks().cast(pa.binary())})

    return with_bucket(batch.select("digest"), buckets).groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(run, "digest binary")


def dedup(spark: SparkSession, docs: DataFrame, digest: Callable[[bytes], bytes] = sha256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row per row of docs.

    Three quarters of the rows, by a hash of doc_id, form the snapshot; the
    others come as a new batch. All of them are decided on."""
    common.small_batches(spark)
    folder = common.work_folder(spark, "exact-dedup")
    found = digest_rows(docs, digest)
    rows = common.stage(found.groupBy("doc_id", "digest", "sha").agg(F.count("*").alias("n")).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0), folder, "rows")
    total, count = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    exact, filters, buckets = write_snapshot(rows.where("not batch"), folder, count)
    batch = common.stage(_grouped(rows.where("batch")), folder, "batch")
    positive = common.stage(screen(batch, filters, buckets), folder, "positive")
    old = exact.join(positive, "digest", "left_semi").select("digest", F.col("keep_id").alias("old_id"), F.col("size").alias("old_size"))
    joined = batch.join(old, "digest", "left")
    from_batch = joined.select("digest", F.greatest("keep_id", "old_id").alias("keep_id"), (F.col("size") + F.coalesce("old_size", F.lit(0))).alias("size"))
    classes = common.stage(from_batch.unionByName(exact.select("digest", "keep_id", "size").join(batch.select("digest"), "digest", "left_anti")), folder, "classes")

    # every group of two rows or more: the bytes
    several = common.join_classes(rows, classes.where("size > 1"), ["digest"], "size", total).select("doc_id").distinct()
    texts = common.semi_by_id(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), several, "doc_id")

    @common.lean
    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [_normal(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([digest(x) for x in data], pa.binary()), pa.array(data, pa.binary())], ["doc_id", "digest", "bytes"])

    bytes_of = texts.mapInArrow(normal, "doc_id long, digest binary, bytes binary")
    variants = bytes_of.groupBy("digest", "bytes").agg(F.count("*").alias("n")).groupBy("digest").agg(F.count("*").alias("k")).where("k > 1").select("digest")
    mixed = common.stage(variants, folder, "mixed")
    plain = common.join_classes(rows, classes, ["digest"], "size", total)
    if not mixed.isEmpty():  # a digest that several texts share: these rows are grouped by their bytes
        plain = plain.join(mixed, "digest", "left_anti")
        own = bytes_of.join(mixed, "digest", "left_semi")
        apart = common.stage(own.groupBy("bytes").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("size")), folder, "apart")
        again = own.groupBy("doc_id", "digest", "bytes").agg(F.count("*").alias("n")).join(apart, "bytes").withColumn("sha", F.unhex(F.sha2("bytes", 256)))
        plain = plain.drop("batch").unionByName(again.drop("bytes"))
    sha = F.coalesce("sha", "digest")
    return plain.select("doc_id", "keep_id", F.col("size").alias("group_size"), F.lower(F.hex(sha)).alias("text_sha256"), F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy")).select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def keep(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    folder = common.work_folder(spark, "kept")
    found = common.stage(dedup(spark, docs), folder, "found")
    by_id = common.stage(found.groupBy("doc_id").agg(F.bool_or("kept").alias("some"), F.bool_and("kept").alias("all")), folder, "by_id")
    out = common.anti_by_id(docs, by_id.where("NOT some"), "doc_id")
    mixed = by_id.where("some AND NOT all").select("doc_id")
    if mixed.isEmpty():
        return out
    # doc_ids of which one row stays and another goes
    sure = common.anti_by_id(out, mixed, "doc_id")
    stays = found.where("kept").select(F.col("doc_id").alias("_id"), F.unhex("text_sha256").alias("_sha"))
    rows = common.semi_by_id(docs, mixed, "doc_id")
    at = rows.columns.index("text")

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([sha256(_normal(x)) for x in b.column(at).to_pylist()], pa.binary())], [*b.schema.names, "_own"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "_own binary"])
    own = rows.mapInArrow(run, schema)
    one = own.join(stays, own["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_sha")), "left_semi").dropDuplicates(["doc_id", "_own"])
    return sure.unionByName(one.drop("_own"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark, common.parquet(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""

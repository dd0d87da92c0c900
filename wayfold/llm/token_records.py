"""Token ids in files of length-delimited binary records.

A record is: length (unsigned 64 bits), masked CRC-32 of these eight bytes
(32 bits), the payload, masked CRC-32 of the payload, all little-endian. The
payload is doc_id (signed 64 bits; a flag byte 0 where it is null), the width of
an id in bytes (16-bit where the vocabulary allows it) and the ids. Every shard
has an index of its own, arrays of doc_id, byte offset, tokens and first token,
for reads in any order. Shards follow each other in ascending doc_id order.

A null text is empty: its record holds the end id alone. Null doc_ids come
first. Repeated rows each get a record, equal ids ordered by text. Other columns
are not read. An empty table gives no shards and an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .encode import default_path, encoder

_LENGTH, _CRC, _HEAD = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<?qB")
SHARDS = "shard int, records long, tokens long, bytes long"
READ = "doc_id long, shard int, local_start long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    n = _LENGTH.pack(len(payload))
    return b"".join((n, _CRC.pack(masked(n)), payload, _CRC.pack(masked(payload))))


def read_frame(stream) -> bytes | None:
    """The next payload, None at the end; a wrong checksum or a cut record raises."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or masked(head[:8]) != _CRC.unpack(head[8:])[0]:
        raise ValueError("a record's length is damaged")
    (n,) = _LENGTH.unpack(head[:8])
    payload, crc = stream.read(n), stream.read(4)
    if len(payload) < n or len(crc) < 4 or masked(payload) != _CRC.unpack(crc)[0]:
        raise ValueError("a record is damaged")
    return payload


def pack(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return _HEAD.pack(doc_id is not None, doc_id or 0, width) + ids


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    there, doc_id, width = _HEAD.unpack_from(payload)
    return doc_id if there else None, np.frombuffer(payload, dtype=f"<u{width}", offset=_HEAD.size)


def write(spark: SparkSession, docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Writes shards and their indexes; the rows say what each shard holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        ids, offsets, counts = [], [], []

        def put(out) -> None:
            at = 0
            for b in batches:
                for doc_id, data in zip(b.column(0).to_pylist(), enc.encode(common.strings(b.column(1))), strict=True):
                    record = frame(pack(doc_id, data + end, enc.dtype.itemsize))
                    out.write(record)
                    ids.append(doc_id)
                    offsets.append(at)
                    counts.append(len(data) // enc.dtype.itemsize + 1)
                    at += len(record)

        size = common.commit_file(f"{folder}/tokens-{shard:06d}.rec", put)
        counts_ = np.array(counts, dtype=np.int64)
        index = pa.table({"doc_id": pa.array(ids, pa.int64()), "byte_offset": pa.array(offsets, pa.int64()), "n_tokens": counts_, "first_token": np.cumsum(counts_) - counts_})
        common.commit_file(f"{folder}/tokens-{shard:06d}.idx", lambda out: pq.write_table(index, out))
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([int(counts_.sum())], pa.int64()), pa.array([size], pa.int64())], ["shard", "records", "tokens", "bytes"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(common.partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return common.stage(ordered.mapInArrow(run, SHARDS), folder, "manifest")


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Every record of every shard, checked against its checksums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in (x for b in batches for x in b.column(0).to_pylist()):
            fs, path = common.file_system(f"{folder}/tokens-{shard:06d}.rec")
            start, rows = 0, []
            with fs.open_input_stream(path, buffer_size=1 << 20) as stream:
                while (payload := read_frame(stream)) is not None:
                    doc_id, ids = unpack(payload)
                    rows.append((doc_id, shard, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield _batch(rows)
                        rows = []
            if rows:
                yield _batch(rows)

    return manifest.select("shard").repartition(common.partitions(spark), "shard").mapInArrow(run, READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "shard": pa.int32(), "local_start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))


def read_at(folder: str, shard: int, byte_offset: int) -> tuple[int | None, np.ndarray]:
    """One record, by the place that the shard's index gives."""
    fs, path = common.file_system(f"{folder}/tokens-{shard:06d}.rec")
    with fs.open_input_file(path) as f:
        f.seek(byte_offset)
        return unpack(read_frame(f))


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    common.small_batches(spark, 2000)
    folder = folder or common.work_folder(spark, "token-records")
    manifest = write(spark, docs, folder, tokenizer, end_id)
    # one row a shard, as many as there are partitions
    starts, at = {}, 0
    for shard, tokens in sorted((r.shard, r.tokens) for r in manifest.select("shard", "tokens").toLocalIterator()):
        starts[shard] = at
        at += tokens
    table = spark.createDataFrame(list(starts.items()), "shard int, shard_start long")
    return read(spark, folder, manifest).join(F.broadcast(table), "shard").select("doc_id", (F.col("shard_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, common.parquet(spark, sf_dir, "documents"), default_path())

"""A deterministic, sharded WARC writer and its reader.

Records are range-sorted by page_id. Each range writes its own run of files,
starts the next when the compressed bytes pass a limit, and makes headers, record
ids and digests anew from the row alone, so that the same rows give the same
bytes. Files appear under temporary names and are renamed when whole; a manifest
lists them with records, bytes and a digest.

Of records with equal payloads (null html: empty) of at least min_bytes, that
with the largest page_id is a response and the others revisit it; a smaller
payload is always a response. Null page_ids are less than any other. Of rows that
repeat page_id and payload, the first is the response if that page_id is. A null
url leaves out the target URI; control characters in one are percent-encoded.
Other columns are not read. An empty table gives no files and an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = "file string, records long, bytes long, sha256 string"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str, kind: str, nth: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}/{kind}/{nth}')}>"


def _clean(url: str) -> str:
    return "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 6, mtime=0)


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, nth: int, date: str) -> bytes:
    digest, kind = base32_sha1(payload), "revisit" if revisit else "response"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    headers = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, digest, kind, nth)), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", _clean(url)))
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest, "response")), ("X-Payload-Length", str(len(payload)))]
        if refers_to is not None:
            headers.append(("X-Refers-To-Page-Id", str(refers_to)))
    return record(headers, block)


def _payload(html: str | None) -> bytes:
    return b"" if html is None else html.encode("utf-8", "surrogatepass")


def revisits(pages: DataFrame, min_bytes: int, folder: str) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload is that of a page with a larger id."""

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [_payload(x) for x in b.column(1).to_pylist()]
            big = pa.array([len(x) >= min_bytes for x in data])
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array([hashlib.sha256(x).digest() for x in data], pa.binary())], ["page_id", "digest"])
            yield out.filter(big)

    rows = common.stage(pages.select("page_id", "html").mapInArrow(run, "page_id long, digest binary").groupBy("page_id", "digest").agg(F.count("*").alias("n")), folder, "digests")
    classes = rows.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("size")).where("size > 1")
    total = rows.count()
    return common.join_classes(rows.drop("n"), common.stage(classes, folder, "classes"), ["digest"], "size", total).where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to")


def write(spark: SparkSession, pages: DataFrame, folder: str, min_bytes: int = 0, file_bytes: int = 256 << 20, date: str = DATE) -> DataFrame:
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    marks = common.stage(revisits(pages, min_bytes, folder), folder, "revisits")
    both = marks.select("page_id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "refers_to").unionByName(pages.select("page_id", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("refers_to")))
    ordered = both.repartitionByRange(common.partitions(spark), "page_id").sortWithinPartitions("page_id", "kind", "url", "html")

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, done = TaskContext.get().partitionId(), []

        def records() -> Iterator[bytes]:
            at, marked, seen = object(), {}, {}
            for b in batches:
                for page_id, kind, url, html, digest, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if page_id != at:
                        at, marked, seen = page_id, {}, {}
                    if kind == 0:
                        marked[digest] = refers_to
                        continue
                    payload = _payload(html)
                    key = hashlib.sha256(payload).digest()
                    nth = seen[key] = seen.get(key, -1) + 1
                    again = nth > 0 and len(payload) >= min_bytes
                    yield page_record(page_id, url, payload, marked.get(key, page_id), key in marked or again, nth, date)

        def roll() -> Iterator[tuple[str, int, int, str]]:
            left = records()
            first = next(left, None)
            n = 0
            while first is not None:
                name, held = f"part-{shard:06d}-{n:05d}.warc.gz", [0, 0, hashlib.sha256()]

                def put(out, start=first, name=name, held=held) -> None:
                    nonlocal first
                    info = b"software: wayfold\r\nformat: WARC File Format 1.1\r\n"
                    head = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(shard, name, "warcinfo")), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], info)
                    for data in (head, start):
                        out.write(data)
                        held[2].update(data)
                        held[1] += len(data)
                    held[0], first = 1, None
                    while held[1] < file_bytes and (data := next(left, None)) is not None:
                        out.write(data)
                        held[2].update(data)
                        held[1] += len(data)
                        held[0] += 1
                    first = next(left, None)

                common.commit_file(f"{folder}/{name}", put)
                yield name, held[0], held[1], held[2].hexdigest()
                n += 1

        done = list(roll())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["file", "records", "bytes", "sha256"])

    return common.stage(ordered.mapInArrow(run, FILES), folder, "manifest")


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a decompressed stream; a cut record raises."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a record doesn't begin with its version")
        headers = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8").partition(":")
            headers[k.strip().lower()] = v.strip()
        n = int(headers["content-length"])
        block = stream.read(n)
        if len(block) < n:
            raise ValueError("a record is cut off")
        yield headers, block


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """One row a page record; digests are checked against the bytes."""

    def rows(file: str) -> Iterator[tuple]:
        fs, path = common.file_system(f"{folder}/{file}")
        with fs.open_input_stream(path, buffer_size=1 << 20, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
            for h, block in parse(stream):
                if h["warc-type"] == "warcinfo":
                    continue
                if h["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
                    raise ValueError(f"{file}: a block's digest differs")
                page_id = int(h["x-page-id"]) if "x-page-id" in h else None
                digest = h["warc-payload-digest"].removeprefix("sha1:")
                if h["warc-type"] == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    if base32_sha1(payload) != digest:
                        raise ValueError(f"{file}: a payload's digest differs")
                    yield page_id, len(payload), digest, "response", None
                else:
                    to = h.get("x-refers-to-page-id")
                    yield page_id, int(h["x-payload-length"]), digest, "revisit", int(to) if to else None

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for file in (x for b in batches for x in b.column(0).to_pylist()):
            held: list[tuple] = []
            for row in rows(file):
                held.append(row)
                if len(held) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    return manifest.select("file").repartition(common.partitions(spark), "file").mapInArrow(run, READ)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    folder = common.work_folder(spark, "warc")
    return read(spark, folder, write(spark, common.parquet(spark, sf_dir, "pages"), folder))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS top,
             row_number() OVER (PARTITION BY h ORDER BY page_id DESC) AS place FROM p)
SELECT page_id, n AS payload_bytes,
       array_to_string(list_transform(range(8), lambda i: list_reduce(list_transform([15, 10, 5, 0], lambda b:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, CAST(5 * i + 1 AS INTEGER), 5))::INTEGER >> b) & 31) + 1)::INTEGER, 1)), lambda u, v: u || v)), '') AS payload_digest,
       CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN place = 1 THEN NULL ELSE top END AS refers_to
FROM s
"""

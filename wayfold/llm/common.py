"""Shared helpers: work folders, staged tables, joins that survive hot keys."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids up to this many are broadcast (about 16 MB); more go through a shuffle join.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where a local session names none (tests) a temporary one is set."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("wayfold.shared.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="wayfold-")
        spark.conf.set("wayfold.shared.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Work folders made inside each open scratch(), the innermost last.
_scratch: list[list[str]] = []


def work_folder(spark: SparkSession, name: str) -> str:
    folder = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    if _scratch:
        _scratch[-1].append(folder)
    return folder


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Drops the work folders of the operators called inside when it ends, after an error too.

    Results are lazy: write them before the end (stage, to a folder made outside)."""
    _scratch.append([])
    try:
        yield
    finally:
        for folder in _scratch.pop():
            drop_folder(folder)


def stage(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Cuts the lineage: writes a table to the shared folder and reads it again."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri:
        uri = ("file://" if uri.startswith("/") else "") + uri if ":/" not in uri else uri.replace("file:/", "file:///", 1)
    return pafs.FileSystem.from_uri(uri)


def drop_folder(uri: str) -> None:
    fs, path = file_system(uri)
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_dir(path)


def commit_file(uri: str, write) -> int:
    """Calls write(stream) on a temporary name and renames it; gives the bytes.

    A lost or repeated task leaves the final name whole or absent."""
    fs, path = file_system(uri)
    parent = os.path.dirname(path)
    fs.create_dir(parent, recursive=True)
    temporary = f"{parent}/_tmp.{uuid.uuid4().hex}"
    try:
        with fs.open_output_stream(temporary) as out:
            write(out)
        size = fs.get_file_info(temporary).size
        fs.move(temporary, path)
    except BaseException:
        if fs.get_file_info(temporary).type != pafs.FileType.NotFound:
            fs.delete_file(temporary)
        raise
    return size


def trim() -> None:
    """Gives memory that nothing uses back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: What empties the memories of operators in this worker process, and whose they are now.
_memories: list[Callable[[], None]] = []
_owner = ""


def forgets(clear: Callable[[], None]) -> None:
    """Registers what empties a module's memory when another operator takes the worker over."""
    _memories.append(clear)


def take_over(owner: str) -> None:
    """Of module level, so that workers run it on their own module's memories."""
    global _owner
    if owner != _owner:
        for clear in _memories:
            clear()
        _owner = owner
        trim()


def lean(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """For functions over a partition's batches: the worker, which lives on, is small again after each, and holds one operator's memory only."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        take_over(run.__module__)
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def parquet(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Long texts: few rows and bytes in an Arrow batch keep Python workers small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(24 << 20))


def unused(name: str, columns: list[str]) -> str:
    """A column's name that isn't among the given ones, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_classes(rows: DataFrame, classes: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join of rows with their class (one class per key) that no hot key slows.

    A class with over a thousandth of all rows is one of under 1,000 such
    classes, so these are broadcast whatever the input's size; the others hold
    a thousandth each at most and are joined by a shuffle."""
    hot = classes.where(F.col(size) * 1000 > F.lit(total))
    cold = classes.where(~(F.col(size) * 1000 > F.lit(total)))
    first = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return first.unionByName(rest)


def _by_id(rows: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    n = ids.limit(BROADCAST_ROWS + 1).count()
    ids = ids.select(F.col(key).alias("_other_key")).distinct()
    return rows.join(F.broadcast(ids) if n <= BROADCAST_ROWS else ids, rows[key].eqNullSafe(F.col("_other_key")), how)


def semi_by_id(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ids (null-safe); ids are broadcast only after a check of their number."""
    return _by_id(rows, ids, key, "left_semi")


def anti_by_id(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among ids, likewise."""
    return _by_id(rows, ids, key, "left_anti")


def strings(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Texts of an Arrow column, null as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def components(edges: DataFrame, folder: str, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges: (node, root), root the least node.

    Each round hooks every node to the least label among its neighbours and then
    jumps along labels, so long chains shrink by halves; every round is written
    to the shared folder, which survives lost executors."""
    spark = edges.sparkSession
    both = stage(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b), F.col(a))).where("u <> v").distinct(), folder, "cc_edges")
    labels = stage(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("root")), folder, "cc_0")
    for i in range(1, rounds + 1):
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        hooked = labels.join(near, "node", "left").select("node", F.least("root", F.coalesce("near", "root")).alias("root"), F.col("root").alias("was"))
        jump = hooked.select(F.col("node").alias("root"), F.col("root").alias("far"))
        after = stage(hooked.join(jump, "root", "left").select("node", F.least("root", F.coalesce("far", "root")).alias("root"), "was"), folder, f"cc_{i}")
        changed = not after.where("root <> was").isEmpty()
        labels = after.select("node", "root")
        if i > 1:
            drop_folder(f"{folder}/cc_{i - 1}")
        if not changed:
            break
    else:
        return components(labels.select(F.col("node").alias("a"), F.col("root").alias("b")).union(both.select("u", "v")), folder + "/more", rounds=2 * rounds)
    return spark.read.schema(labels.schema).parquet(f"{folder}/cc_{i}")

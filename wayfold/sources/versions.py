"""Versioned tables: every version is written aside and comes into being by one rename, on a stated base.

    <path>/data/<name>/        a version's rows, Parquet, never changed
    <path>/manifest/<n>.json   which of them version n is

Versions are numbered from 1. Committing version n + 1 renames its manifest to that
number and fails where it exists already, so of two writers from one base one
succeeds and the other is told. A writer that dies leaves rows nobody refers to, and
readers stay with the version they began with.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from ..operators import indoor


class Stale(RuntimeError):
    """The base of a commit isn't the current version any more."""


def _context(spark: SparkSession, path: str):
    fs = spark._jvm.org.apache.hadoop.fs
    where = fs.Path(path)
    uri = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toUri()
    return fs, fs.FileContext.getFileContext(uri, spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, path: str) -> int:
    """The number of the newest version, 0 where there is none."""
    fs, _ = _context(spark, path)
    folder = fs.Path(f"{path}/manifest")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return 0
    names = [s.getPath().getName() for s in system.listStatus(folder)]
    return max((int(x.removesuffix(".json")) for x in names if x.removesuffix(".json").isdigit()), default=0)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version's rows, the newest one's where none is named; later commits don't change what is read."""
    n = current(spark, path) if version is None else version
    manifest = json.loads(spark.read.text(f"{path}/manifest/{n}.json", wholetext=True).first()[0])
    return spark.read.schema(manifest["schema"]).parquet(f"{path}/data/{manifest['rows']}")


def commit(df: DataFrame, path: str, base: int) -> int:
    """Writes df as the version after base, which must be the current one; gives its number."""
    spark, rows = df.sparkSession, uuid.uuid4().hex
    fs, context = _context(spark, path)
    df.write.parquet(f"{path}/data/{rows}")
    if current(spark, path) != base:
        raise Stale(f"{path} is at version {current(spark, path)}, not {base}")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    aside = fs.Path(f"{path}/data/{rows}.json")
    out = aside.getFileSystem(spark._jsc.hadoopConfiguration()).create(aside, False)
    out.write(bytearray(json.dumps({"rows": rows, "base": base, "schema": schema}).encode()))
    out.close()
    aside.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(fs.Path(f"{path}/manifest"))
    none = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(aside, fs.Path(f"{path}/manifest/{base + 1}.json"), none)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            raise Stale(f"version {base + 1} of {path} is another writer's") from e
        raise
    return base + 1


def upsert(spark: SparkSession, path: str, new: DataFrame, key: str, base: int | None = None, attempts: int = 5) -> int:
    """new over the base by key (operators.indoor.upsert), as the next version.

    With a base of the caller's a stale one is refused; without, the newest one is taken, and again after another writer's commit."""
    for i in range(attempts):
        n = current(spark, path) if base is None else base
        try:
            return commit(indoor.upsert(read(spark, path, n), new, key), path, n)
        except Stale:
            if base is not None or i == attempts - 1:
                raise
    raise AssertionError

"""A landing zone for downloads: what has been fetched once is read from there."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def landed(spark: SparkSession, path: str, fetch: Callable[[], str], schema: str, refresh: bool = False, attempts: int = 3, wait: float = 5.0) -> DataFrame:
    """The document at path; fetch() supplies it where it is missing or to be refreshed.

    A failed fetch is tried again after wait, 2 * wait, ... seconds; the last failure is raised."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
    if refresh or not fs.exists(there):
        for i in range(1, attempts + 1):
            try:
                text = fetch()
                break
            except OSError:
                if i == attempts:
                    raise
                time.sleep(wait * i)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return spark.read.schema(schema).option("multiLine", True).json(path)

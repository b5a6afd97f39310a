"""Versioned folders: data files are written first, then one manifest that names those that count.

A version is seen whole or not at all: readers take the newest manifest whose write was completed, and
a failure before it leaves the old version as it was.  Old files stay until they are cleared.
"""

from __future__ import annotations

from py4j.java_gateway import JavaObject
from pyspark.sql import Row, SparkSession

_MANIFEST = "_manifest"


def _folder(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder; a store that cannot be reached raises."""
    at, system = _folder(spark, path)
    return system.exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    at, system = _folder(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(at)) if system.exists(at) else []


def modified(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Name, size and time of modification of a file, or of each file of a folder."""
    at, system = _folder(spark, path)
    return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in system.listStatus(at))


def latest(spark: SparkSession, root: str) -> int | None:
    """The newest complete version; None if there never was one."""
    base = f"{root.rstrip('/')}/{_MANIFEST}"
    for number in sorted((int(n) for n in children(spark, base) if n.isdigit()), reverse=True):
        if exists(spark, f"{base}/{number:012d}/_SUCCESS"):
            return number
    return None


def manifest(spark: SparkSession, root: str, version: int | None = None) -> list[Row]:
    """Entries of a version (the newest, if not given).  The list is as short as its writer keeps it."""
    number = latest(spark, root) if version is None else version
    if number is None:
        return []
    return spark.read.parquet(f"{root.rstrip('/')}/{_MANIFEST}/{number:012d}").collect()


def commit(spark: SparkSession, root: str, version: int, entries: list[tuple], schema: str) -> None:
    """Make a version of these entries; raises if there is one of that number."""
    rows = spark.createDataFrame(entries, schema)
    rows.coalesce(1).write.mode("errorifexists").parquet(f"{root.rstrip('/')}/{_MANIFEST}/{version:012d}")

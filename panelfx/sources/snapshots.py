"""Whole versions of a table below one folder: a reader sees the newest complete one, never a part of one."""

from __future__ import annotations

import re

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Written last; readers and Spark itself overlook files that begin with an underscore.
MARK = "_complete"
_VERSION = re.compile(r"version=(\d+)")
_RUN = re.compile(r"run=([\w.\-]+)")


def _folder(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _children(spark: SparkSession, path: str, pattern: re.Pattern) -> list[str]:
    """What `pattern` captures in the names below `path`."""
    files, where = _folder(spark, path)
    if not files.exists(where):
        return []
    names = [s.getPath().getName() for s in files.listStatus(where)]
    return [found.group(1) for n in names if (found := pattern.fullmatch(n))]


def complete_versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that were written to their end, in ascending order."""
    found = []
    for number in _children(spark, path, _VERSION):
        files, mark = _folder(spark, f"{path}/version={number}/{MARK}")
        if files.exists(mark):
            found.append(int(number))
    return sorted(found)


def publish(
    df: DataFrame, path: str, version: int | None = None, keep: int = 2, fmt: str = "parquet", partition_by: tuple[str, ...] = ()
) -> int:
    """Write `df` as a version of the table at `path` and return its number; by default that after the newest.

    Readers see the new version from the moment its mark is there, and the one before until then. A version
    that is complete is not written again, so a repeated batch changes nothing; what a killed run left
    of one is overwritten. The newest `keep` complete versions stay, for readers that have begun with them.
    """
    spark = df.sparkSession
    there = complete_versions(spark, path)
    if version is None:
        version = there[-1] + 1 if there else 0
    if version not in there:
        target = f"{path}/version={version}"
        df.write.mode("overwrite").partitionBy(*partition_by).format(fmt).save(target)
        files, mark = _folder(spark, f"{target}/{MARK}")
        files.create(mark, True).close()
        there = sorted([*there, version])
    for old in there[:-keep]:
        files, folder = _folder(spark, f"{path}/version={old}")
        files.delete(folder, True)
    return version


def newest(spark: SparkSession, path: str) -> str:
    """Folder of the newest complete version."""
    there = complete_versions(spark, path)
    if not there:
        raise FileNotFoundError(f"no complete version below {path}")
    return f"{path}/version={there[-1]}"


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """The newest complete version of a table."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(newest(spark, path))


def run_folder(path: str, run: str) -> str:
    if not _RUN.fullmatch(f"run={run}"):
        raise ValueError(f"a run's name has letters, digits, '_', '.' and '-' only, not {run!r}")
    return f"{path}/run={run}"


def newest_of_runs(spark: SparkSession, path: str) -> list[str]:
    """Folders of the newest complete version of every run below `path`; runs without one are left out."""
    folders = [run_folder(path, run) for run in sorted(_children(spark, path, _RUN))]
    return [newest(spark, f) for f in folders if complete_versions(spark, f)]

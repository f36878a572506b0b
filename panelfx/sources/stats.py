"""Raw token statistics on disk: nested JSON lines, per-run Parquet, provenance by path."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelfx.functions import step_from_path
from panelfx.operators.panel import flatten_stats
from panelfx.schemas import STATS, STATS_NESTED
from panelfx.sources.snapshots import newest_of_runs, publish, run_folder

# Wide element types: Spark widens narrower files to them on read.
_FILE_SCHEMA = "seq_idx bigint, sup array<double>, rank array<bigint>, entropy array<double>"


def read_with_step(
    spark: SparkSession, root: str, schema: str = _FILE_SCHEMA, pattern: str = "*.parquet"
) -> DataFrame:
    """All files below `root` whose name matches `pattern`, with `step` taken from their path."""
    return (
        spark.read.schema(schema)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .parquet(root)
        .select("*", step_from_path(F.col("_metadata.file_path")).alias("step"))
    )


def read_nested_stats(spark: SparkSession, path: str) -> DataFrame:
    """Batch objects from JSON lines; a line holding an array gives one row per element.

    Of a folder of runs, the newest complete version of each is read.
    """
    if not path.rstrip("/").endswith(".jsonl"):
        raise ValueError(f"not a .jsonl path: {path}")
    return spark.read.schema(STATS_NESTED).option("mode", "FAILFAST").json(newest_of_runs(spark, path) or path)


def write_nested_stats(
    nested: DataFrame, path: str, run: str, write_interval: int = 10, batch: str = "batch"
) -> None:
    """Write a run's batch objects as JSON lines, `write_interval` consecutive batches to a line.

    The run's lines are replaced as a whole, those of other runs stay.
    """
    objects = F.struct(*[c for c in nested.columns if c != batch])
    line = F.floor(F.col(batch) / write_interval)
    lines = (
        nested.groupBy(line.alias("line"))
        .agg(F.sort_array(F.collect_list(F.struct(F.col(batch).alias("k"), objects.alias("o")))).alias("a"))
        .select(F.to_json("a.o").alias("value"))
    )
    publish(lines, run_folder(path, run), fmt="text")


def stats_from_jsonl(spark: SparkSession, path: str, out: str | None = None, run: str | None = None) -> DataFrame:
    """Flat statistics from nested JSON lines; if `out` is given, appended there as a run named after the file."""
    flat = flatten_stats(read_nested_stats(spark, path))
    if out is not None:
        append_stats(flat, out, run or os.path.basename(path.rstrip("/")).removesuffix(".jsonl"), partition_by=())
    return flat


def append_stats(stats: DataFrame, path: str, run: str, partition_by: tuple[str, ...] = ("step",)) -> None:
    """Append a run's flat statistics to a table whose directories carry the run and the partition columns.

    Appending a run again replaces its rows as a whole: each write is a version of its own, which readers see
    once it is complete, so neither a rerun nor a run that was killed leaves rows twice or half a run.
    """
    publish(stats, run_folder(path, run), partition_by=partition_by)


def read_stats(spark: SparkSession, path: str, schema: T.StructType = STATS) -> DataFrame:
    """All runs' statistics in their newest complete version, with the column `run`."""
    whole = T.StructType([*schema.fields, T.StructField("run", T.StringType())])
    folders = newest_of_runs(spark, path)
    if not folders:
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).option("basePath", path).parquet(*folders).select(*whole.names)

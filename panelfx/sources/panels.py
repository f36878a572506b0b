"""Panels on disk: one table, a directory per model size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from panelfx.schemas import PANEL


def write_panel(panel: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet with zstd; partitioned by `model_size` when the panel has that column.

    Writing again replaces the sizes written, and leaves other sizes as they are.
    """
    writer = panel.write.mode(mode).option("compression", "zstd").option("partitionOverwriteMode", "dynamic")
    if "model_size" in panel.columns:
        writer = writer.partitionBy("model_size")
    writer.parquet(path)


def read_panel(spark: SparkSession, path: str, by_size: bool = True) -> DataFrame:
    """The panel table, or a single unpartitioned panel file when `by_size` is False."""
    fields = list(PANEL.fields)
    if by_size:
        fields.append(T.StructField("model_size", T.StringType()))
    return spark.read.schema(T.StructType(fields)).parquet(path)


def read_units(spark: SparkSession, path: str, unit: str = "seq_idx") -> DataFrame:
    """Distinct units of a panel; only the unit column is read."""
    return spark.read.schema(f"{unit} bigint").parquet(path).distinct()

"""Corpora and token tables on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from panelfx.operators.corpus import union_splits
from panelfx.schemas import CORPUS, SEQUENCES

CORRUPT = "_corrupt_record"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Text corpus from JSON lines. Packing needs document order, hence an explicit `doc_id`."""
    return spark.read.schema(CORPUS).option("mode", "FAILFAST").json(path)


def read_json_permissive(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with fixed schema; lines that do not parse are kept whole in a column of their own."""
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return (
        spark.read.schema(wide)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )


def write_splits(path: str, mode: str = "overwrite", **splits: DataFrame) -> None:
    """Named splits as one table partitioned by `split`."""
    union_splits(**splits).write.mode(mode).partitionBy("split").parquet(path)


def read_splits(spark: SparkSession, path: str, *names: str, schema: T.StructType = SEQUENCES) -> DataFrame:
    """All splits, or only the named ones (their directories alone are read)."""
    whole = spark.read.schema(
        T.StructType([*schema.fields, T.StructField("split", T.StringType())])
    ).parquet(path)
    return whole.where(whole["split"].isin(*names)) if names else whole


def write_token_counts(counts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Counts per token as one table."""
    counts.write.mode(mode).parquet(path)


def read_token_counts(spark: SparkSession, path: str, token: str = "int") -> DataFrame:
    """Counts per token, of the given token type."""
    return spark.read.schema(f"token {token}, count bigint").parquet(path)

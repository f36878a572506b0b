"""Incremental twins of two batch operators, over directories that keep growing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from panelfx.operators.panel import flatten_stats
from panelfx.schemas import STATS_NESTED, TOKENIZED
from panelfx.sources.snapshots import complete_versions, publish


def stream_flatten_stats(
    spark: SparkSession, source: str, sink: str, checkpoint: str, files_per_batch: int = 1000
) -> StreamingQuery:
    """Flatten nested statistics files as they arrive and append them to a Parquet table; a bad line is an error."""
    nested = (
        spark.readStream.schema(STATS_NESTED)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("mode", "FAILFAST")
        .json(source)
    )
    return (
        flatten_stats(nested)
        .writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def stream_token_frequency(
    spark: SparkSession,
    source: str,
    sink: str,
    checkpoint: str,
    schema: T.StructType = TOKENIZED,
    column: str = "input_ids",
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Keep a table of token counts up to date; the state is one count per distinct token.

    Every batch becomes a version of the table (`sources.snapshots.read_snapshot` reads the newest), so a
    reader sees the counts after some batch, whole, at any time. A batch that is repeated after a
    crash finds its version written, or writes it anew.
    """
    tokens = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    )
    counts = (
        tokens.select(F.explode(column).alias("token"))
        .groupBy("token")
        .agg(F.count("*").alias("count"))
    )

    def replace(batch: DataFrame, number: int) -> None:
        if number in complete_versions(batch.sparkSession, sink):
            # its state has to be made again all the same
            batch.write.format("noop").mode("overwrite").save()
        else:
            publish(batch, sink, version=number)

    return (
        counts.writeStream.outputMode("complete")
        .foreachBatch(replace)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

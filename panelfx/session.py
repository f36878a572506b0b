"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def build_session(app: str = "panelfx", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """Session with the settings the operators were tuned under; `conf` wins over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def small_batches(spark: SparkSession) -> None:
    """Let whole texts go to Python in Arrow batches of a few megabytes, unless the session has its own setting.

    Spark's default is 64 MB a batch, of which a task holds several outside of its heap.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, "8m")


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for cut lineage, as the cluster names it in `spark.checkpoint.dir`.

    Only a local master may fall back to a folder of its own; on a cluster a machine-local folder
    would be invisible to the other executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="panelfx-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


ROW_GROUP_BYTES = 16 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

# Paths made since each of the open owned_scratch blocks began.
_owners: list[list[str]] = []


@contextmanager
def owned_scratch(spark: SparkSession) -> Iterator[None]:
    """Remove at the end what `freeze` and `scratch_path` made within; results have to be written by then."""
    made: list[str] = []
    _owners.append(made)
    try:
        yield
    finally:
        _owners.remove(made)
        for path in made:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the scratch folder, owned by the innermost `owned_scratch` if there is one."""
    path = os.path.join(scratch_root(spark), f"panelfx-{label}-{uuid.uuid4().hex}")
    if _owners:
        _owners[-1].append(path)
    return path


def freeze(df: DataFrame, label: str = "frozen") -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Cuts lineage for good (lost executors cost nothing) and gives the planner true file sizes, so
    small results are broadcast by Spark's own threshold and large ones are not.
    """
    path = scratch_path(df.sparkSession, label)
    # small row groups: a task that writes long texts holds one group only
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

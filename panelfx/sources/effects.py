"""Estimated effects on disk: our partitioned table, and files named after their content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelfx.functions import size_from_effect_file
from panelfx.schemas import EFFECTS_ALL, EFFECTS_COHORT, EFFECTS_EVENT, EFFECTS_TIME

SCHEMAS = {
    "all": EFFECTS_ALL,
    "cohort": EFFECTS_COHORT,
    "time": EFFECTS_TIME,
    "event": EFFECTS_EVENT,
}
_PARTITIONS = ("estimator", "target", "view", "variant", "model_size")
_DIFF = "cohort bigint, step bigint, mean double, std double, size bigint, cohort_val bigint, mean_val double, std_val double, size_val bigint, ATT double"


def variant_name(remove_dups: bool = False, bootstrap: bool = False) -> str:
    """Name of an estimation variant: plain, nodups, boot or nodups_boot."""
    parts = [name for name, on in (("nodups", remove_dups), ("boot", bootstrap)) if on]
    return "_".join(parts) or "plain"


def write_effects(
    effects: DataFrame, root: str, estimator: str, target: str, view: str, variant: str = "plain"
) -> None:
    """Write one view; `model_size` is a column of `effects`, so all sizes go in one job.

    Writing again replaces the partitions written and leaves all others as they are.
    """
    labels = dict(estimator=estimator, target=target, view=view, variant=variant)
    labelled = effects.withColumns({k: F.lit(v) for k, v in labels.items()})
    writer = labelled.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*_PARTITIONS).parquet(f"{root}/{estimator}-{view}")


def read_effects(
    spark: SparkSession, root: str, view: str, target: str, variant: str = "plain", estimator: str = "cs"
) -> DataFrame:
    """One view of all model sizes; the filters select directories."""
    base = T._parse_datatype_string(_DIFF) if estimator == "diff" else SCHEMAS[view]
    fields = [*base.fields, *[T.StructField(p, T.StringType()) for p in _PARTITIONS]]
    table = spark.read.schema(T.StructType(fields)).parquet(f"{root}/{estimator}-{view}")
    wanted = (F.col("target") == target) & (F.col("view") == view) & (F.col("variant") == variant)
    return table.where(wanted).drop("estimator", "target", "view", "variant")


def write_effect_files(effects: DataFrame, root: str, target: str, view: str, suffix: str = "_boot") -> None:
    """Effects as one file per model size, `cs_{size}-{target}-{view}{suffix}.parquet`; sizes come to the driver.

    An estimator's table of one size is small. A file of the same name is replaced.
    """
    spark = effects.sparkSession
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    for row in effects.select("model_size").distinct().collect():
        name = f"cs_{row[0]}-{target}-{view}{suffix}"
        folder, file = jvm_path(f"{root}/_{name}"), jvm_path(f"{root}/{name}.parquet")
        one = effects.where(F.col("model_size") == row[0]).drop("model_size")
        one.coalesce(1).write.mode("overwrite").parquet(folder.toString())
        store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        part = next(s.getPath() for s in store.listStatus(folder) if s.getPath().getName().startswith("part-"))
        store.delete(file, False)
        store.rename(part, file)
        store.delete(folder, True)


def read_effect_files(
    spark: SparkSession, root: str, view: str, target: str, suffix: str = "_boot"
) -> DataFrame:
    """Effects from files `cs_{size}-{target}-{view}{suffix}*.parquet`, with `model_size`."""
    fields = [f for f in SCHEMAS[view].fields if f.name != "base_period"]
    return (
        spark.read.schema(T.StructType(fields))
        .option("pathGlobFilter", f"cs*{target}-{view}{suffix}*")
        .option("recursiveFileLookup", "true")
        .parquet(root)
        .select("*", size_from_effect_file(F.col("_metadata.file_name")).alias("model_size"))
    )

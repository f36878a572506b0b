"""Facts encoded in file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def step_from_path(path: Column) -> Column:
    """Checkpoint step from `...step7000...`, with or without a time stamp behind it."""
    return F.regexp_extract(path, r"step=?(\d+)", 1).cast("int")


def size_from_effect_file(name: Column) -> Column:
    """Model size from `cs_{size}-{target}-{view}....parquet`."""
    return F.trim(F.split_part(F.split_part(name, F.lit("_"), F.lit(2)), F.lit("-"), F.lit(1)))

"""Unit ids: batches, cohorts and order-free random keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rows per training batch, batches per cohort, and the number that stands for
# "no batch / no cohort" where an output column must be a whole number.
BATCH_SIZE = 1024
COHORT_SIZE = 1000
NO_COHORT = 200_000_000


def batch_of(unit: Column, batch_size: int = BATCH_SIZE, zero_based: bool = False) -> Column:
    """1-based training batch of a unit id."""
    unit = unit.cast("bigint")
    if zero_based:
        return F.floor(unit / batch_size).cast("bigint") + 1
    return F.ceil(unit / batch_size).cast("bigint")


def cohort_of(batch: Column, cohort_size: int = COHORT_SIZE) -> Column:
    """Step after which the unit's batch has been seen."""
    return F.ceil(batch / cohort_size).cast("bigint") * cohort_size


def hash_key(seed: int, *ids: Column) -> Column:
    """Random-looking key that depends on seed and ids only, never on partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[i.cast("string") for i in ids]))


def none_if_nan(value: Column) -> Column:
    """NaN is a number to Spark's aggregates; panel outcomes treat it as missing."""
    value = value.cast("double")
    return F.when(~F.isnan(value), value)

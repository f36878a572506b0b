"""Reductions and shifts of list columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def non_null_size(values: Column) -> Column:
    """Number of non-null elements.

    `array_contains` answers false only when there is no null element, and it is compiled code with
    an early exit; the interpreted per-element filter runs for lists that need it.
    """
    return F.when(~F.array_contains(values, F.lit(-1)), F.size(values)).otherwise(
        F.size(F.array_compact(values))
    )


def list_mean(values: Column) -> Column:
    """Mean over the non-null elements; NULL for an empty or NULL list."""
    total = F.aggregate(
        values, F.lit(0.0), lambda acc, x: acc + F.coalesce(x.cast("double"), F.lit(0.0))
    )
    return F.when(values.isNotNull(), F.try_divide(total, non_null_size(values)))


def share_equal(values: Column, wanted: int) -> Column:
    """Share of elements equal to `wanted`, over all elements; NULL for an empty or NULL list."""
    hits = F.size(values) - F.size(F.array_remove(values, wanted))
    return F.when(values.isNotNull(), F.try_divide(hits.cast("double"), F.size(values)))


def inputs_of(tokens: Column) -> Column:
    """Positions that predict something: all but the last."""
    return F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0)))


def labels_of(tokens: Column) -> Column:
    """Positions that are predicted: all but the first."""
    return F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))

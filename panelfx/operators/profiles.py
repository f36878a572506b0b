"""Profiles: the tables behind figures of effects across cohorts, times and model sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelfx.functions import warmup_cosine
from panelfx.operators.panel import LAST_SINGLE_EPOCH_STEP

# Model sizes in reporting order, and the one left out of the reports.
SIZE_ORDER = ("70M", "160M", "410M", "1.4B", "6.9B", "12B")
EXCLUDED_SIZES = ("2.8b",)
# Emphasis of a value by its flag.
EMPHASIS = {"": 0.3, "*": 1.0}


def size_rank(size: Column, order: Sequence[str] = SIZE_ORDER) -> Column:
    """Position of a size in `order`; NULL for sizes not listed."""
    position = F.array_position(F.array(*[F.lit(s) for s in order]), size)
    return F.when(position > 0, position.cast("int"))


def annotate_effects(
    effects: DataFrame,
    target: str = "sup_seq",
    order: Sequence[str] = SIZE_ORDER,
    exclude: Sequence[str] = EXCLUDED_SIZES,
    legacy_sign_flip: bool = False,
) -> DataFrame:
    """Add `memorisation`, the two-error band and its flag; order the sizes.

    Surprisal falls when a sequence is memorised, so its effects (and band ends) change sign; other
    targets keep theirs. `legacy_sign_flip` also negates the error and leaves the ends unswapped,
    as older tables have it; the flag is then always set for surprisal.
    """
    listed = F.upper(F.col("model_size"))
    df = effects
    if exclude:
        df = df.where(F.coalesce(~F.col("model_size").isin(*exclude), F.lit(True)))
    df = df.withColumn("model_size", F.when(size_rank(listed, order).isNotNull(), listed))
    df = df.withColumn("size_rank", size_rank(F.col("model_size"), order))
    if target == "sup_seq":
        ends = ("lower", "upper") if legacy_sign_flip else ("upper", "lower")
        flipped = {
            "memorisation": -F.col("ATT"),
            "lower": -F.col(ends[0]),
            "upper": -F.col(ends[1]),
        }
        if legacy_sign_flip:
            flipped["std_error"] = -F.col("std_error")
        df = df.withColumns(flipped)
    else:
        df = df.withColumn("memorisation", F.col("ATT"))
    band = 2 * F.col("std_error")
    df = df.withColumns(
        {"stdlower": F.col("memorisation") - band, "stdupper": F.col("memorisation") + band}
    )
    outside = F.coalesce((F.col("stdlower") > 0) | (F.col("stdupper") < 0), F.lit(False))
    return df.withColumn("zero_not_in_cf", F.when(outside, "*").otherwise(""))


def _flagged() -> Column:
    return F.col("zero_not_in_cband") == "*"


def profile_full(annotated: DataFrame) -> DataFrame:
    """Significant effects from treatment on."""
    return annotated.where((F.col("time") >= F.col("cohort")) & _flagged())


def profile_restricted(annotated: DataFrame, cutoff: int = LAST_SINGLE_EPOCH_STEP) -> DataFrame:
    """The full profile within the first pass over the data."""
    return profile_full(annotated).where((F.col("cohort") <= cutoff) & (F.col("time") <= cutoff))


def profile_persistent(events: DataFrame, cutoff: int = LAST_SINGLE_EPOCH_STEP) -> DataFrame:
    """Significant positive effects by time since treatment."""
    return events.where(
        F.col("relative_period").between(0, cutoff) & _flagged() & (F.col("memorisation") > 0)
    )


def profile_instantaneous(annotated: DataFrame, cutoff: int = LAST_SINGLE_EPOCH_STEP) -> DataFrame:
    """Significant effects at the time of treatment."""
    return annotated.where(
        (F.col("time") == F.col("cohort"))
        & _flagged()
        & (F.col("cohort") <= cutoff)
        & (F.col("time") <= cutoff)
    )


def profile_final(annotated: DataFrame, cutoff: int = LAST_SINGLE_EPOCH_STEP) -> DataFrame:
    """Non-negative effects at the last time of the first pass, with an emphasis value `alpha`."""
    flag = F.col("zero_not_in_cband")
    alpha = F.lit(None).cast("double")
    for value, strength in EMPHASIS.items():
        alpha = F.when(flag == value, F.lit(strength)).otherwise(alpha)
    return annotated.where(
        (F.col("cohort") <= cutoff) & (F.col("time") == cutoff) & (F.col("memorisation") >= 0)
    ).withColumn("alpha", alpha)


def lr_schedule(times: DataFrame, steps: DataFrame, time: str = "time") -> DataFrame:
    """(time, lr) at the distinct `steps`, for a run that ends at the largest of `times`."""
    total = times.agg(F.max(time)).scalar()
    return (
        steps.select(F.col(time).cast("bigint").alias("time"))
        .distinct()
        .withColumn("lr", warmup_cosine(F.col("time"), total))
    )


def profile_pivot(
    annotated: DataFrame, order: Sequence[str] = SIZE_ORDER, value: str = "memorisation"
) -> DataFrame:
    """One row per (cohort, time), one column per size of `order`."""
    return annotated.groupBy("cohort", "time").pivot("model_size", list(order)).agg(F.max(value))

"""From raw token statistics to a unit-by-time panel with cohorts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelfx.functions import batch_of, cohort_of, list_mean, none_if_nan, share_equal
from panelfx.functions.ids import BATCH_SIZE, COHORT_SIZE, NO_COHORT

LAST_SINGLE_EPOCH_STEP = 95_000  # fixed value: later steps see the data a second time


@dataclass(frozen=True)
class PanelSpec:
    """Which columns play which role; `by` columns (e.g. a model size) split the panel."""

    unit: str = "seq_idx"
    time: str = "step"
    cohort: str = "cohort"
    target: str = "sup_seq"
    by: tuple[str, ...] = ()

    def check(self, df: DataFrame) -> None:
        wanted = [self.unit, self.time, self.cohort, self.target, *self.by]
        missing = [c for c in wanted if c not in df.columns]
        if missing:
            raise ValueError(f"panel lacks columns {missing}; it has {df.columns}")


def flatten_stats(nested: DataFrame, keep_empty: bool = False) -> DataFrame:
    """One row per sequence from batch objects whose columns are lists over the batch.

    Lists of one batch must be there and equally long. A batch without sequences vanishes unless
    `keep_empty`, which leaves one all-NULL row for it.
    """
    first, *rest = nested.columns
    even = F.lit(True)
    for other in rest:
        even = even & F.size(first).eqNullSafe(F.size(other))
    rows = F.when(even & F.col(first).isNotNull(), F.arrays_zip(*nested.columns)).otherwise(
        F.raise_error(F.lit("columns of one batch differ in length or are NULL"))
    )
    explode = F.inline_outer if keep_empty else F.inline
    return nested.select(explode(rows))


def cast_stats(stats: DataFrame, step: Column | None = None) -> DataFrame:
    """Fixed types for the raw statistics; `step` defaults to the column of that name."""
    return stats.select(
        *[c for c in stats.columns if c not in {"seq_idx", "sup", "rank", "entropy", "step"}],
        F.col("seq_idx").cast("bigint").alias("seq_idx"),
        "sup",
        F.col("rank").cast("array<int>").alias("rank"),
        "entropy",
        (F.col("step") if step is None else step).cast("int").alias("step"),
    )


def panel_export(stats: DataFrame, keys: Sequence[str] = ("seq_idx", "step")) -> DataFrame:
    """One panel row per raw-statistics row: a projection, nothing is shuffled."""
    return stats.select(
        *keys,
        list_mean(F.col("sup")).alias("sup_seq"),
        list_mean(F.col("entropy")).alias("entr_seq"),
        share_equal(F.col("rank"), 0).alias("acc_seq"),
        list_mean(F.col("rank")).alias("avg_rank"),
    )


def restrict_units(df: DataFrame, reference: DataFrame, unit: str = "seq_idx") -> DataFrame:
    """Rows of units that occur in `reference`."""
    return df.join(reference.select(unit).distinct(), unit, "left_semi")


def missing_units(df: DataFrame, reference: DataFrame, unit: str = "seq_idx") -> DataFrame:
    """Units of `reference` that `df` lacks; must be empty before effects are estimated."""
    return reference.select(unit).distinct().join(df.select(unit), unit, "left_anti")


def require_units(
    df: DataFrame, reference: DataFrame, unit: str = "seq_idx", by: Sequence[str] = ()
) -> None:
    """Raise if a reference unit is missing, anywhere or in one of the panels that `by` separates."""
    if not by:
        absent = [r[0] for r in missing_units(df, reference, unit).limit(5).collect()]
        if absent:
            raise ValueError(f"units of the reference set are missing, e.g. {absent}")
        return
    wanted = reference.agg(F.count_distinct(unit)).scalar()
    counts = restrict_units(df, reference, unit).groupBy(*by).agg(
        F.count_distinct(unit).alias("n_units")
    )
    short = counts.where(F.col("n_units") != wanted).limit(5).collect()
    if short:
        raise ValueError(f"units of the reference set are missing in {short}")


def assign_cohorts(
    df: DataFrame,
    unit: str = "seq_idx",
    batch_size: int = BATCH_SIZE,
    cohort_size: int = COHORT_SIZE,
    zero_based: bool = False,
) -> DataFrame:
    """Add `batch_idx` and `cohort`; never-treated units get the sentinel batch and a NULL cohort.

    By default ids count from 1 and ids <= 0 are never treated. With `zero_based` ids count from 0,
    as the sampler numbers them, and only negative ids are never treated.
    """
    treated = F.col(unit) >= 0 if zero_based else F.col(unit) > 0
    batch = F.when(treated, batch_of(F.col(unit), batch_size, zero_based)).otherwise(
        F.lit(NO_COHORT).cast("bigint")
    )
    return df.withColumn("batch_idx", batch).withColumn(
        "cohort", F.when(treated, cohort_of(F.col("batch_idx"), cohort_size))
    )


def remove_dups(
    df: DataFrame,
    cutoff: int = LAST_SINGLE_EPOCH_STEP,
    time: str = "step",
    cohort: str = "cohort",
) -> DataFrame:
    """Keep cohorts (and controls) and times up to `cutoff`."""
    return df.where(
        ((F.col(cohort) <= cutoff) | F.col(cohort).isNull()) & (F.col(time) <= cutoff)
    )


def missing_steps(found: DataFrame, start: int, stop: int, by: int, step: str = "step") -> DataFrame:
    """Expected steps `start, start+by, ... < stop` without any row in `found`."""
    expected = found.sparkSession.range(start, stop, by).select(F.col("id").cast("int").alias(step))
    return expected.join(
        found.select(F.col(step).cast("int").alias(step)).distinct(), step, "left_anti"
    )


def require_steps(found: DataFrame, start: int = 0, stop: int = 144_000, by: int = 1000) -> None:
    """Raise, listing them, if checkpoint steps are missing."""
    gaps = sorted(r[0] for r in missing_steps(found, start, stop, by).collect())
    if gaps:
        raise RuntimeError(f"some runs are missing: {gaps}")


def unbalanced_units(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """Units not observed exactly once at every time of their panel; NaN outcomes are missing."""
    seen = panel.where(none_if_nan(F.col(spec.target)).isNotNull())
    by = list(spec.by)
    times = seen.select(*by, spec.time).distinct().groupBy(*by).agg(F.count("*").alias("_times"))
    units = seen.groupBy(*by, spec.unit).agg(
        F.count("*").alias("n_rows"), F.count_distinct(spec.time).alias("n_times")
    )
    joined = units.join(times, by) if by else units.withColumn(
        "_times", times.select("_times").scalar()
    )
    odd = (F.col("n_rows") != F.col("_times")) | (F.col("n_times") != F.col("_times"))
    return joined.where(odd).drop("_times")

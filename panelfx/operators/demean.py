"""Two-way demeaning and the simple difference built on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelfx.functions import none_if_nan
from panelfx.functions.ids import NO_COHORT
from panelfx.operators.panel import PanelSpec
from panelfx.session import freeze


def _unit_times(y: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per unit and time: their number, outcomes seen, mean, and squares around it.

    Repeated rows of a unit are added up before anything is shuffled, so what is gathered per unit later is
    never longer than there are times.
    """
    return y.groupBy(*keys).agg(
        F.count("*").alias("_rows"),
        F.count("_y").alias("_n"),
        F.avg("_y").alias("_mean"),
        (F.var_pop("_y") * F.count("_y")).alias("_squares"),
    )


def demean_two_way(panel: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Replace the target by `y - mean over time's rows - mean over unit's rows + overall mean`.

    One pass adds up outcomes per unit and time, from which all three means follow; the second joins them
    to the rows.
    """
    spec.check(panel)
    by = list(spec.by)
    y = panel.withColumn("_y", none_if_nan(F.col(spec.target)))
    sums = freeze(_unit_times(y.select(*by, spec.unit, spec.time, "_y"), [*by, spec.unit, spec.time]), "sums")
    total = (F.sum(F.col("_mean") * F.col("_n")), F.sum("_n"))

    def mean_of(*keys: str) -> DataFrame:
        return sums.groupBy(*by, *keys).agg(F.try_divide(*total).alias("_m"))

    times = mean_of(spec.time)
    if by:
        times = times.join(mean_of().withColumnRenamed("_m", "_overall"), by)
    else:
        times = times.withColumn("_overall", sums.agg(F.try_divide(*total)).scalar())
    shifts = times.select(*by, spec.time, (F.col("_m") - F.col("_overall")).alias("_time_shift"))
    # one row per time, written down: its size in bytes is known to the join
    rows = y.join(freeze(shifts, "shifts"), [*by, spec.time])
    means = mean_of(spec.unit).withColumnRenamed("_m", "_unit_mean")
    return (
        rows.join(means, [*by, spec.unit])
        .withColumn(spec.target, F.col("_y") - F.col("_time_shift") - F.col("_unit_mean"))
        .select(*panel.columns)
    )


def simple_diff(panel: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Control mean minus treated mean of the demeaned target, per cohort and time.

    The demeaned rows are never built, and the panel is read once: its rows are added up per unit and time,
    listed per unit with the unit's mean, and added up again per (cohort, time) cell, in which the time mean
    and the overall mean are constants.
    Output: the control cell's `mean, std, size`, the treated cell's with suffix `_val`, and `ATT`.
    Note the sign: control minus treated, the opposite of the group-time effects.
    """
    spec.check(panel)
    y = panel.select(
        *spec.by,
        spec.unit,
        spec.time,
        F.coalesce(F.col(spec.cohort), F.lit(NO_COHORT)).cast("bigint").alias("cohort"),
        none_if_nan(F.col(spec.target)).alias("_y"),
    )
    by = list(spec.by)
    parts = ["cohort", spec.time, "_rows", "_n", "_mean", "_squares"]
    units = (
        _unit_times(y, [*by, spec.unit, "cohort", spec.time])
        .groupBy(*by, spec.unit)
        .agg(
            F.try_divide(F.sum(F.col("_mean") * F.col("_n")), F.sum("_n")).alias("_unit_mean"),
            F.collect_list(F.struct(*parts)).alias("_list"),
        )
    )
    own = F.col("_mean") - F.col("_unit_mean")
    listed = units.select(*by, "_unit_mean", F.inline("_list")).withColumn("_own", own)
    squares = F.sum(F.col("_squares") + F.col("_n") * F.col("_own") ** 2)
    cells = (
        listed.groupBy(*by, "cohort", spec.time)
        .agg(
            F.sum(F.col("_mean") * F.col("_n")).alias("_s"),
            F.sum("_n").alias("_n"),
            F.try_divide(F.sum(F.col("_own") * F.col("_n")), F.sum("_n")).alias("_own"),
            F.max("_n").alias("_most"),
            F.stddev_samp("_own").alias("_std"),
            squares.alias("_squares"),
            F.sum("_rows").alias("size"),
        )
        # of repeated rows the squares around their own means come in as well
        .withColumn(
            "std",
            F.when(F.col("_most") <= 1, F.col("_std")).otherwise(
                F.sqrt(F.greatest(F.try_divide(F.col("_squares") - F.col("_n") * F.col("_own") ** 2, F.col("_n") - 1), F.lit(0.0)))
            ),
        )
    )
    # everything below runs on at most cohorts x times rows
    cells = freeze(cells.select(*by, "cohort", spec.time, "_s", "_n", "_own", "std", "size"), "cells")
    at_time = W.partitionBy(*by, spec.time)
    time_mean = F.try_divide(F.sum("_s").over(at_time), F.sum("_n").over(at_time))
    control = F.max(
        F.when(F.col("cohort") == NO_COHORT, F.struct("_own", "std", "size"))
    ).over(at_time)
    overall = F.try_divide(F.sum("_s"), F.sum("_n"))
    rows = cells.withColumns({"_time_mean": time_mean, "_control": control})
    if by:
        rows = rows.join(cells.groupBy(*by).agg(overall.alias("_overall")), by)
    else:
        rows = rows.withColumn("_overall", cells.agg(overall).scalar())
    cells = rows
    shift = F.col("_time_mean") - F.col("_overall")
    pairs = cells.where((F.col("cohort") != NO_COHORT) & F.col("_control").isNotNull())
    return pairs.select(
        *by,
        F.lit(NO_COHORT).cast("bigint").alias("cohort"),
        spec.time,
        (F.col("_control._own") - shift).alias("mean"),
        F.col("_control.std").alias("std"),
        F.col("_control.size").alias("size"),
        F.col("cohort").alias("cohort_val"),
        (F.col("_own") - shift).alias("mean_val"),
        F.col("std").alias("std_val"),
        F.col("size").alias("size_val"),
        (F.col("_control._own") - F.col("_own")).alias("ATT"),
    )

"""Group-time effects under staggered adoption, their aggregations, errors and bands.

Differences-in-differences with never-treated controls and no covariates, where the doubly robust
estimator is a difference of group means. All of it works on small tables derived from one or two
passes over the panel:

* folded units: one row per unit with its outcomes in order of time, the only shuffle of the panel;
* `cells`: mean and size per (cohort, time);
* `contrast_squares`, `influence_squares`: squared influence of units on each estimate, for analytic errors of
  all views, of panels without and with gaps;
* `bootstrap_sums`, `bootstrap_pairs`: weighted sums per group, for the multiplier bootstrap.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelfx.operators.panel import PanelSpec
from panelfx.operators.unitblocks import (
    bootstrap_pairs,
    bootstrap_sums,
    contrast_squares,
    fold_lists,
    fold_units,
    influence_squares,
    largest_draws,
    pair_sums,
    times_of,
    unit_observations,
)
from panelfx.session import freeze

VIEWS = ("all", "cohort", "time", "event")
_KEYS = {"cohort": "cohort", "time": "time", "event": "relative_period"}
_MEASURES = ("ATT", "std_error", "lower", "upper", "zero_not_in_cband")


@dataclass(frozen=True)
class EffectOptions:
    """How effects are estimated.

    base_period: "varying" compares a time before treatment with the time just before it,
        "universal" compares every time with the last one before treatment.
    se: "none", "analytic" or "bootstrap".
    balance: "strict" raises unless all units of a cohort are seen at all times; "pairwise"
        averages each difference over the units seen at both of its times.
    band: "pointwise" or "simultaneous" (bootstrap only: one critical value for a whole view).
    """

    base_period: str = "varying"
    se: str = "analytic"
    balance: str = "strict"
    alpha: float = 0.05
    boot_iterations: int = 1000
    seed: int = 1234
    multiplier: str = "rademacher"
    band: str = "simultaneous"

    def __post_init__(self) -> None:
        allowed = {
            "base_period": ("varying", "universal"),
            "se": ("none", "analytic", "bootstrap"),
            "balance": ("strict", "pairwise"),
            "multiplier": ("rademacher", "mammen"),
            "band": ("pointwise", "simultaneous"),
        }
        for name, values in allowed.items():
            if getattr(self, name) not in values:
                raise ValueError(f"{name} must be one of {values}, not {getattr(self, name)!r}")


def cells_of(units: DataFrame, spec: PanelSpec) -> DataFrame:
    """Mean, size and a fingerprint of the unit set per (cohort, time): by..., cohort, time, ..."""
    y = unit_observations(units, spec).withColumn("_h", F.xxhash64("unit"))
    return y.groupBy(*spec.by, "cohort", "time").agg(
        F.count("*").alias("n"),
        F.avg("y").alias("mean"),
        # Folded units have one row a time, so equal sums at two times mean the same set of units.
        F.bit_xor("_h").alias("units_xor"),
        F.sum(F.shiftright("_h", 32)).alias("units_sum"),
    )


def _before(time: Column, value: Column, cohort: Column, spec: PanelSpec, options) -> Column:
    """`value` at the base period of each (cohort, time) row."""
    of_cohort = W.partitionBy(*spec.by, "cohort")
    last_untreated = F.max(F.when(time < cohort, F.struct(time, value))).over(of_cohort)
    if options.base_period == "universal":
        return last_untreated
    previous = F.lag(F.struct(time, value)).over(of_cohort.orderBy("time"))
    return F.when(time < cohort, previous).otherwise(last_untreated)


def _against_base(
    groups: DataFrame, spec: PanelSpec, options: EffectOptions, value: str, out: str
) -> DataFrame:
    """Contrast with the controls' row of the same time, then with the base period's row.

    `value` is a number or a list. Adds `base_period` and `out`; only treated rows with a base
    remain. Windows span one time (a row per cohort) or one cohort (a row per time).
    """
    is_list = groups.schema[value].dataType.typeName() == "array"

    def minus(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: x - y) if is_list else a - b

    control = F.max(F.when(F.col("cohort").isNull(), F.struct(F.lit(1), F.col(value)))).over(
        W.partitionBy(*spec.by, "time")
    )
    gap = groups.withColumn("_control", control).where(F.col("cohort").isNotNull())
    gap = gap.withColumn("_gap", minus(F.col(value), F.col(f"_control.{value}")))
    base = _before(F.col("time"), F.col("_gap"), F.col("cohort"), spec, options)
    return (
        gap.withColumn("_base", base)
        .where(F.col("_base").isNotNull())
        .withColumn("base_period", F.col("_base.time"))
        .withColumn(out, minus(F.col("_gap"), F.col("_base._gap")))
        .drop("_control", "_gap", "_base")
    )


def _require_balance(cells: DataFrame, spec: PanelSpec) -> DataFrame:
    """Make the mean of a cohort fail loudly if its unit set changes over time."""
    of_cohort = W.partitionBy(*spec.by, "cohort")
    at_time = W.partitionBy(*spec.by, "time")

    def steady(name: str) -> Column:
        return F.min(name).over(of_cohort) == F.max(name).over(of_cohort)

    marked = cells.withColumns(
        {
            "_steady": steady("n") & steady("units_xor") & steady("units_sum"),
            "_times": F.count("*").over(of_cohort),
        }
    ).withColumn(
        "_control_times", F.max(F.when(F.col("cohort").isNull(), F.col("_times"))).over(at_time)
    )
    fine = F.col("_steady") & F.coalesce(F.col("_times") == F.col("_control_times"), F.lit(False))
    message = F.concat(
        F.lit("unbalanced panel at cohort "),
        F.coalesce(F.col("cohort").cast("string"), F.lit("never treated")),
        F.lit(", time "),
        F.col("time").cast("string"),
        F.lit("; unbalanced_units lists the units"),
    )
    return marked.withColumn(
        "mean", F.when(fine, F.col("mean")).otherwise(F.raise_error(message))
    ).drop("_steady", "_times", "_control_times")


def att_gt(
    panel: DataFrame, spec: PanelSpec = PanelSpec(), options: EffectOptions = EffectOptions(se="none")
) -> DataFrame:
    """Point estimates: by..., cohort, base_period, time, n (units of the cohort), ATT.

    Several rows of one unit and time raise, whichever the balance.
    """
    units = fold_units(panel, spec)
    if options.balance == "strict":
        return _att_from_cells(cells_of(units, spec), spec, options)
    units = freeze(units, "units")
    cells = freeze(cells_of(units, spec), "cells")
    bases = freeze(_all_bases(cells, spec, options), "bases")
    stats = pair_sums(units, _pairs(bases, spec), spec, times_of(cells))
    return _pairwise(units, bases, stats, spec).select(*spec.by, "cohort", "base_period", "time", "n", "ATT")


def _att_from_cells(cells: DataFrame, spec: PanelSpec, options: EffectOptions) -> DataFrame:
    checked = _require_balance(cells, spec)
    return _against_base(checked, spec, options, "mean", "ATT").select(
        *spec.by, "cohort", "base_period", "time", "n", "ATT"
    )


def _all_bases(cells: DataFrame, spec: PanelSpec, options: EffectOptions) -> DataFrame:
    """Base period of every cohort at every time of its panel, observed for that cohort or not."""
    by = list(spec.by)
    times = F.sort_array(F.collect_set("time"))
    cohorts = cells.where(F.col("cohort").isNotNull()).select(*by, "cohort").distinct()
    if by:
        cohorts = cohorts.join(cells.groupBy(*by).agg(times.alias("times")), by)
    else:
        cohorts = cohorts.withColumn("times", cells.agg(times).scalar())
    every = cohorts.select(*by, "cohort", "times", F.explode("times").alias("time"))
    limit = F.col("cohort")
    if options.base_period == "varying":
        limit = F.least("time", "cohort")
    base = F.array_max(F.filter("times", lambda x: x < limit))
    return (
        every.withColumn("base_period", base)
        .where(F.col("base_period").isNotNull())
        .drop("times")
    )


def _pairs(cells: DataFrame, spec: PanelSpec) -> DataFrame:
    """by..., cohort, t, s: the differences over time that the cells need, for cohorts and controls."""
    by = list(spec.by)
    moved = cells.where(F.col("time") != F.col("base_period"))
    own = moved.select(*by, "cohort", F.col("time").alias("t"), F.col("base_period").alias("s"))
    control = own.withColumn("cohort", F.lit(None).cast("bigint")).distinct()
    return own.unionByName(control)


def _stats_of_cells(pairs: DataFrame, cells: DataFrame, spec: PanelSpec) -> DataFrame:
    """`pair_sums` of a balanced panel: by..., cohort, t, s, n, mean from the means of the cells."""
    by = list(spec.by)

    def at(time: str, out: str) -> DataFrame:
        return cells.select(
            *[F.col(c).alias(f"_{out}_{c}") for c in [*by, "cohort"]],
            F.col("time").alias(f"_{out}_time"),
            F.col("mean").alias(f"_{out}"),
            F.col("n").alias(f"_{out}_n"),
        )

    found = pairs
    for time, out in (("t", "first"), ("s", "second")):
        same = [F.col(c).eqNullSafe(F.col(f"_{out}_{c}")) for c in [*by, "cohort"]]
        found = found.join(at(time, out), [*same, F.col(time) == F.col(f"_{out}_time")])
    return found.select(
        *by, "cohort", "t", "s", F.col("_first_n").alias("n"), (F.col("_first") - F.col("_second")).alias("mean")
    )


def _control_of(stats: DataFrame, spec: PanelSpec, columns: dict[str, str]) -> DataFrame:
    """by..., time, base_period and the given columns of the controls' pairs, renamed."""
    return stats.where(F.col("cohort").isNull()).select(
        *spec.by, F.col("t").alias("time"), F.col("s").alias("base_period"),
        *[F.col(c).alias(name) for c, name in columns.items()],
    )


def _own_of(stats: DataFrame, spec: PanelSpec, columns: dict[str, str]) -> DataFrame:
    return stats.where(F.col("cohort").isNotNull()).select(
        *spec.by, "cohort", F.col("t").alias("time"), F.col("s").alias("base_period"),
        *[F.col(c).alias(name) for c, name in columns.items()],
    )


def _pairwise(units: DataFrame, bases: DataFrame, stats: DataFrame, spec: PanelSpec) -> DataFrame:
    """Effects of an unbalanced panel, from the units seen at both times of each difference.

    `n` counts the cohort's units, whenever they are seen: cohort shares do not depend on the cell.
    """
    by = list(spec.by)
    sizes = units.groupBy(*by, "cohort").agg(F.count("*").alias("n"))
    return (
        bases.join(_own_of(stats, spec, {"mean": "_own_mean"}), [*by, "cohort", "time", "base_period"])
        .join(_control_of(stats, spec, {"mean": "_control_mean"}), [*by, "time", "base_period"])
        .join(sizes, [*by, "cohort"])
        .withColumn("ATT", F.col("_own_mean") - F.col("_control_mean"))
        .drop("_own_mean", "_control_mean")
    )


def _weights(effects: DataFrame, view: str, spec: PanelSpec) -> DataFrame:
    """The cells that enter a view, with key, weight and the view's estimate on every row."""
    by = list(spec.by)
    if view == "event":
        used = effects.withColumn("_key", F.col("time") - F.col("cohort"))
    else:
        used = effects.where(F.col("time") >= F.col("cohort")).withColumn("_key", F.col(view))
    of_key = W.partitionBy(*by, "_key")
    size = F.lit(1).cast("bigint") if view == "cohort" else F.col("n")
    total = F.sum(size).over(of_key)
    return used.withColumn("_n_used", total).withColumn("_w", size / F.col("_n_used")).withColumn(
        "_theta", F.sum(F.col("_w") * F.col("ATT")).over(of_key)
    )


def aggregate_effects(effects: DataFrame, view: str, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Average group-time effects over a view; point estimates only.

    cohort: plain mean over times since treatment. time and event: mean over the cohorts treated by
    then, or having that distance to treatment, weighted by cohort size.
    """
    by, key = list(spec.by), _KEYS[view]
    if view == "event":
        effects = effects.withColumn(key, F.col("time") - F.col("cohort"))
    else:
        effects = effects.where(F.col("time") >= F.col("cohort"))
    if view == "cohort":
        return effects.groupBy(*by, key).agg(F.avg("ATT").alias("ATT"))
    return effects.groupBy(*by, key).agg(
        (F.sum(F.col("n") * F.col("ATT")) / F.sum("n")).alias("ATT")
    )


def _contrast_rows(effects: DataFrame, stats: DataFrame, views: tuple[str, ...], spec: PanelSpec) -> DataFrame:
    """The estimates of the views as sums of group differences: by..., cohort, view, _k0, _k1, _k2, t, s, w, mean.

    View "all" has one entry per pair of times and group, as cells share the controls' differences; the
    key is then (group, t, s). In the other views the key is `_k1`, and the controls' weights of equal times
    are added up first, so a view never has more entries than there are cells, for each side.
    """
    by = list(spec.by)
    none = F.lit(None).cast("bigint")
    rows: list[DataFrame] = []
    if "all" in views:
        rows.append(stats.select(
            *by, "cohort", F.lit("all").alias("view"), F.col("cohort").alias("_k0"), F.col("t").alias("_k1"),
            F.col("s").alias("_k2"), "t", "s", (F.lit(1.0) / F.col("n")).alias("w"), "mean",
        ))
    for view in views:
        if view == "all":
            continue
        used = _weights(effects, view, spec).select(
            *by, "cohort", "_key", F.col("time").alias("t"), F.col("base_period").alias("s"), "_w"
        )
        control = used.groupBy(*by, "_key", "t", "s").agg((-F.sum("_w")).alias("_w")).withColumn("cohort", none)
        both = used.unionByName(control)
        sizes = stats.select(*[F.col(c).alias(f"_p_{c}") for c in [*by, "cohort", "t", "s"]], "n", "mean")
        same = [F.col(c).eqNullSafe(F.col(f"_p_{c}")) for c in [*by, "cohort"]]
        same += [F.col(c) == F.col(f"_p_{c}") for c in ("t", "s")]
        rows.append(both.join(sizes, same).select(
            *by, "cohort", F.lit(view).alias("view"), none.alias("_k0"), F.col("_key").alias("_k1"), none.alias("_k2"),
            "t", "s", (F.col("_w") / F.col("n")).alias("w"), "mean",
        ))
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def _analytic_all(effects: DataFrame, squares: DataFrame, spec: PanelSpec) -> DataFrame:
    by = list(spec.by)
    found = squares.where(F.col("view") == "all").select(
        *by, F.col("_k0").alias("cohort"), F.col("_k1").alias("t"), F.col("_k2").alias("s"), "var"
    )
    # A universal base compares the base period with itself: no difference, no variance.
    spread = F.coalesce("_own_var", F.lit(0.0)) + F.coalesce("_control_var", F.lit(0.0))
    return (
        effects.join(_own_of(found, spec, {"var": "_own_var"}), [*by, "cohort", "time", "base_period"], "left")
        .join(_control_of(found, spec, {"var": "_control_var"}), [*by, "time", "base_period"], "left")
        .withColumn("std_error", F.sqrt(spread))
        .drop("_own_var", "_control_var")
    )


def _analytic_view(effects: DataFrame, squares: DataFrame, view: str, spec: PanelSpec) -> DataFrame:
    """Aggregated effects with influence-function errors.

    An aggregate is a weighted sum of differences of group means, so a unit's influence is that sum of its
    own deviations over the cells it is seen in. Estimated cohort shares add
    `sum n_k (ATT_k - theta)^2 / (sum n_k)^2`; the two don't covary, as deviations sum to zero in each cell.
    """
    by = list(spec.by)
    weighted = _weights(effects, view, spec)
    points = weighted.groupBy(*by, "_key").agg(
        F.max("_theta").alias("ATT"),
        F.sum(F.col("n") * (F.col("ATT") - F.col("_theta")) ** 2 / F.col("_n_used") ** 2).alias(
            "_share_var"
        ),
    )
    if view == "cohort":
        points = points.withColumn("_share_var", F.lit(0.0))
    found = squares.where(F.col("view") == view).select(*by, F.col("_k1").alias("_key"), "var")
    total = F.coalesce("var", F.lit(0.0)) + F.col("_share_var")
    return points.join(found, [*by, "_key"], "left").select(
        *by, F.col("_key").alias(_KEYS[view]), "ATT", F.sqrt(total).alias("std_error")
    )


def _boot_cells(
    effects: DataFrame, sums: DataFrame, cells: DataFrame, spec: PanelSpec, options: EffectOptions
) -> DataFrame:
    """Effects with `draws` (the bootstrap draws of the cell) and `w` (weight sums of its cohort)."""
    by = list(spec.by)
    sizes = cells.select(
        *[F.col(c).alias(f"_c_{c}") for c in [*by, "cohort", "time"]], F.col("n").alias("_size")
    )
    same = [sums[c].eqNullSafe(sizes[f"_c_{c}"]) for c in [*by, "cohort", "time"]]
    mean = F.col("total") / F.col("_size")
    size = F.col("_size")
    centred = sums.join(sizes, same).select(
        *by,
        "cohort",
        "time",
        "w",
        F.zip_with("s", "w", lambda s, w: (s - w * mean) / size).alias("z"),
    )
    draws = _against_base(centred, spec, options, "z", "draws").select(
        *by, "cohort", "time", "draws", "w"
    )
    return effects.join(draws, [*by, "cohort", "time"])


def _boot_pairs(
    effects: DataFrame, draws: DataFrame, weights: DataFrame, spec: PanelSpec
) -> DataFrame:
    """`_boot_cells` of a panel with gaps, from the draws of its pairs of times and the cohorts' weight sums."""
    by = list(spec.by)
    return (
        effects.join(_own_of(draws, spec, {"z": "_own_z"}), [*by, "cohort", "time", "base_period"])
        .join(_control_of(draws, spec, {"z": "_control_z"}), [*by, "time", "base_period"])
        .join(weights.where(F.col("cohort").isNotNull()), [*by, "cohort"])
        .withColumn("draws", F.zip_with("_own_z", "_control_z", lambda a, b: a - b))
        .drop("_own_z", "_control_z")
    )


def _boot_view(cells: DataFrame, view: str, spec: PanelSpec) -> DataFrame:
    by = list(spec.by)
    weighted = _weights(cells, view, spec)
    w = F.col("_w")
    tilt = F.lit(0.0) if view == "cohort" else (F.col("ATT") - F.col("_theta")) / F.col("_n_used")
    draws = weighted.select(
        *by,
        "_key",
        F.zip_with("draws", "w", lambda d, v: w * d + tilt * v).alias("draws"),
    )
    points = weighted.groupBy(*by, "_key").agg(F.max("_theta").alias("ATT"))
    return (
        fold_lists(draws, [*by, "_key"], ["draws"])
        .join(points, [*by, "_key"])
        .select(*by, F.col("_key").alias(_KEYS[view]), "ATT", "draws")
    )


def _quantile(sorted_list: Column, q: float, size: int) -> Column:
    """Linearly interpolated quantile of a sorted list of known size."""
    at = (size - 1) * q
    low = int(at)
    high = min(low + 1, size - 1)
    a, b = F.get(sorted_list, F.lit(low)), F.get(sorted_list, F.lit(high))
    return a + (b - a) * (at - low)


def _boot_band(estimates: DataFrame, spec: PanelSpec, options: EffectOptions) -> DataFrame:
    """Standard errors from the draws' interquartile range, and the band's critical value."""
    by, size = list(spec.by), options.boot_iterations
    normal = NormalDist()
    unit_iqr = normal.inv_cdf(0.75) - normal.inv_cdf(0.25)
    ordered = estimates.withColumn("_sorted", F.sort_array("draws"))
    iqr = _quantile(F.col("_sorted"), 0.75, size) - _quantile(F.col("_sorted"), 0.25, size)
    with_se = ordered.withColumn("std_error", iqr / unit_iqr).drop("_sorted")
    if options.band == "pointwise":
        return with_se.drop("draws").withColumn(
            "_crit", F.lit(normal.inv_cdf(1 - options.alpha / 2))
        )
    with_se = freeze(with_se, "draws")
    crit = _quantile(F.sort_array("largest"), 1 - options.alpha, size)
    largest = largest_draws(with_se, by).select(*by, crit.alias("_crit"))
    banded = with_se.drop("draws")
    if by:
        return banded.join(largest, by)
    return banded.withColumn("_crit", largest.scalar())


def _with_band(estimates: DataFrame, crit: Column) -> DataFrame:
    reach = crit * F.col("std_error")
    lower, upper = F.col("ATT") - reach, F.col("ATT") + reach
    outside = F.coalesce((lower > 0) | (upper < 0), F.lit(False))
    return estimates.withColumns(
        {
            "lower": lower,
            "upper": upper,
            "zero_not_in_cband": F.when(outside, "*").otherwise(""),
        }
    )


def compute_effects(
    panel: DataFrame,
    spec: PanelSpec = PanelSpec(),
    options: EffectOptions = EffectOptions(),
    views: tuple[str, ...] = VIEWS,
) -> dict[str, DataFrame]:
    """Effects per view ("all", "cohort", "time", "event") with errors, bands and flags.

    The panel is folded into one row per unit, which is written to the shared folder; every view and
    error comes from that table. With `balance="pairwise"` each difference uses the units seen at both of
    its times, and errors, bands and draws follow each unit's own pattern of times.
    """
    by = list(spec.by)
    units = freeze(fold_units(panel, spec), "units")
    cells = freeze(cells_of(units, spec), "cells")
    z = F.lit(NormalDist().inv_cdf(1 - options.alpha / 2))
    out: dict[str, DataFrame] = {}

    def finish(df: DataFrame, view: str, crit: Column) -> None:
        keys = ["cohort", "base_period", "time"] if view == "all" else [_KEYS[view]]
        out[view] = _with_band(df, crit).select(*by, *keys, *_MEASURES)

    gaps = options.balance == "pairwise"
    if gaps:
        bases = freeze(_all_bases(cells, spec, options), "bases")
        stats = freeze(pair_sums(units, _pairs(bases, spec), spec, times_of(cells)), "pairs")
        effects = _pairwise(units, bases, stats, spec)
    else:
        effects = _att_from_cells(cells, spec, options)
    if options.se == "none":
        for view in views:
            points = effects if view == "all" else aggregate_effects(effects, view, spec)
            finish(points.withColumn("std_error", F.lit(None).cast("double")), view, z)
        return out
    effects = freeze(effects, "effects")
    if options.se == "analytic":
        if not gaps:
            stats = freeze(_stats_of_cells(_pairs(effects, spec), cells, spec), "pairs")
        entries = _contrast_rows(effects, stats, views, spec)
        key = ["view", "_k0", "_k1", "_k2"]
        if gaps:
            squares = influence_squares(units, entries, by, key, times_of(cells))
        else:
            squares = contrast_squares(units, cells, entries, spec, key, times_of(cells))
        if len(views) > 1:
            squares = freeze(squares, "squares")
        for view in views:
            errors = _analytic_all if view == "all" else partial(_analytic_view, view=view)
            finish(errors(effects, squares, spec=spec), view, z)
        return out
    drawing = (options.boot_iterations, options.seed, options.multiplier)
    if gaps:
        boot = _boot_pairs(effects, *bootstrap_pairs(units, cells, stats, spec, *drawing), spec)
    else:
        boot = _boot_cells(effects, bootstrap_sums(units, cells, spec, *drawing), cells, spec, options)
    boot = freeze(boot, "boot")
    for view in views:
        drawn = boot if view == "all" else _boot_view(boot, view, spec)
        finish(_boot_band(drawn, spec, options), view, F.col("_crit"))
    return out

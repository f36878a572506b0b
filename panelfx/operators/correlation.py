"""Correlations of profiles between model sizes, over the (cohort, time) cells both have."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelfx.operators.ordering import running_total
from panelfx.operators.profiles import SIZE_ORDER, profile_pivot, size_rank
from panelfx.session import freeze


def profile_correlation(
    annotated: DataFrame,
    method: str = "pearson",
    order: Sequence[str] = SIZE_ORDER,
    value: str = "memorisation",
) -> DataFrame:
    """(other, model_size, value) for every unordered pair of sizes, the diagonal included.

    `model_size` comes no later than `other` in `order`. Rows are sorted by both.
    """
    wide = profile_pivot(annotated, order, value)
    if method == "pearson":
        pairs = _pearson(wide, order)
    elif method == "spearman":
        pairs = _spearman(_pair_rows(wide, order))
    elif method == "kendall":
        pairs = _kendall(_pair_rows(wide, order))
    else:
        raise ValueError(f"unknown method {method!r}")
    return pairs.select("other", "model_size", "value").orderBy(
        size_rank(F.col("model_size"), order), size_rank(F.col("other"), order)
    )


def _pairs(order: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(order) for b in order[i:]]


def _col(name: str):
    return F.col(f"`{name}`")


def _pearson(wide: DataFrame, order: Sequence[str]) -> DataFrame:
    """All coefficients in one aggregate over the wide table; `corr` skips incomplete pairs."""
    entries = F.array(
        *[
            F.struct(
                F.lit(b).alias("other"),
                F.lit(a).alias("model_size"),
                F.corr(_col(a), _col(b)).alias("value"),
            )
            for a, b in _pairs(order)
        ]
    )
    return wide.agg(entries.alias("e")).select(F.inline("e"))


def _pair_rows(wide: DataFrame, order: Sequence[str]) -> DataFrame:
    """(other, model_size, x, y): the complete rows of every pair."""
    entries = F.array(
        *[
            F.struct(
                F.lit(b).alias("other"),
                F.lit(a).alias("model_size"),
                _col(a).alias("x"),
                _col(b).alias("y"),
            )
            for a, b in _pairs(order)
        ]
    )
    rows = wide.select(F.inline(entries))
    return freeze(rows.where(F.col("x").isNotNull() & F.col("y").isNotNull()), "pairs")


_PAIR = ["model_size", "other"]


def _positions(rows: DataFrame, side: str) -> DataFrame:
    """Per pair and distinct value of `side`: rows before it, and rows having it."""
    counts = rows.groupBy(*_PAIR, side).agg(F.count("*").alias("ties"))
    return running_total(counts, [*_PAIR, side], F.col("ties"), "below", within=_PAIR)


def _ranked(rows: DataFrame) -> DataFrame:
    """Rows with mean ranks `rank_x`, `rank_y` and the tie groups' first positions."""
    out = rows
    for side in ("x", "y"):
        at = _positions(rows, side).select(
            *_PAIR,
            side,
            F.col("below").alias(f"below_{side}"),
            (F.col("below") + (F.col("ties") + 1) / 2).alias(f"rank_{side}"),
        )
        out = out.join(at, [*_PAIR, side])
    return out


def _spearman(rows: DataFrame) -> DataFrame:
    return _ranked(rows).groupBy(*_PAIR).agg(F.corr("rank_x", "rank_y").alias("value"))


def _tie_pairs(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    counts = rows.groupBy(*_PAIR, *by).agg(F.count("*").alias("c"))
    return counts.groupBy(*_PAIR).agg(
        F.sum((F.col("c") * (F.col("c") - 1) / 2).cast("bigint")).alias(name)
    )


def _kendall(rows: DataFrame) -> DataFrame:
    """Tau-b without comparing all pairs of rows.

    Rows are numbered by x. Two rows with different numbers first differ at one binary digit; for
    each digit, rows that share the digits above it form a group, and the concordant pairs decided
    there are, for each row with digit 1, the rows with digit 0 and smaller y. Running totals over
    (group, y) give these counts: n log n rows in all, spread by range.
    """
    ranked = freeze(_ranked(rows), "ranks")
    top = ranked.agg(F.max("below_x")).first()[0] or 0
    digits = range(max(int(top).bit_length(), 1))
    split = F.array(
        *[
            F.struct(
                F.lit(d).alias("digit"),
                F.shiftright("below_x", d + 1).alias("grp"),
                F.shiftright("below_x", d).bitwiseAND(1).alias("bit"),
            )
            for d in digits
        ]
    )
    group = [*_PAIR, "digit", "grp"]
    leveled = ranked.select(*_PAIR, F.col("below_y").alias("y"), F.inline(split))
    counts = leveled.groupBy(*group, "y").agg(
        F.sum(1 - F.col("bit")).alias("zeros"), F.sum("bit").alias("ones")
    )
    smaller = running_total(counts, [*group, "y"], F.col("zeros"), "smaller", within=group)
    concordant = smaller.groupBy(*_PAIR).agg(
        F.sum(F.col("ones") * F.col("smaller")).alias("concordant")
    )
    n = ranked.groupBy(*_PAIR).agg(F.count("*").alias("n"))
    every = (F.col("n") * (F.col("n") - 1) / 2).cast("bigint")
    untied_x = every - F.col("tied_x")
    untied_y = every - F.col("tied_y")
    # pairs that differ in x and in y are concordant or discordant
    decided = every - F.col("tied_x") - F.col("tied_y") + F.col("tied_xy")
    score = 2 * F.col("concordant") - decided
    value = F.try_divide(
        score.cast("double"), F.sqrt(untied_x.cast("double")) * F.sqrt(untied_y.cast("double"))
    )
    return (
        n.join(concordant, _PAIR)
        .join(_tie_pairs(ranked, ["below_x"], "tied_x"), _PAIR)
        .join(_tie_pairs(ranked, ["below_y"], "tied_y"), _PAIR)
        .join(_tie_pairs(ranked, ["below_x", "below_y"], "tied_xy"), _PAIR)
        .select(*_PAIR, value.alias("value"))
    )

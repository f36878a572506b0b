"""Ranges of a global order, and running totals over it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelfx.session import freeze

# A range of a running total: small enough for one task, large enough to be worth one.
RANGE_ROWS = 2_000_000
FEWEST_RANGE_ROWS = 20_000
# Rows that a range's borders are drawn from.
SAMPLED = 200


def range_index(value: Column, starts: Sequence, kind: T.DataType | None = None) -> Column:
    """Number of the range `value` is in: how many of the ascending `starts` are not above it.

    A bisection over a literal list, so the expression stays small however many ranges there are. A start
    may be a tuple for a struct of several columns, whose type then is `kind`; a NULL is in the first range.
    """
    if not starts:
        return F.lit(0)
    if all(type(s) is int for s in starts):
        list_of = F.split(F.lit(",".join(map(str, starts))), ",").cast("array<bigint>")
    else:
        list_of = F.array(*[F.struct(*map(F.lit, s)) if isinstance(s, tuple) else F.lit(s) for s in starts])
    if kind is not None:
        list_of = list_of.cast(T.ArrayType(kind))
    steps = [1 << k for k in range(len(starts).bit_length() - 1, -1, -1)]

    def narrowed(found: Column, step: Column) -> Column:
        later = found + step
        below = (later <= len(starts)) & (F.get(list_of, later - 1) <= value)
        return F.when(below, later).otherwise(found)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), narrowed)


def range_starts(df: DataFrame, keys: Sequence[str], ranges: int, rows: int) -> list[tuple]:
    """Smallest keys of about equally long ranges of an order, from a sample of some hundred rows a range."""
    if ranges < 2:
        return []
    drawn = df.select(*keys).sample(min(1.0, SAMPLED * ranges / rows), seed=0).collect()
    found = sorted(tuple(r) for r in drawn if None not in tuple(r))
    places = sorted({found[len(found) * k // ranges] for k in range(1, ranges)}) if found else []
    return places


def running_total(
    df: DataFrame,
    order_by: Sequence[str],
    weight: Column,
    name: str,
    within: Sequence[str] = (),
) -> DataFrame:
    """Add `name`: the sum of `weight` over all rows before this one in the ascending order of `order_by`.

    The order has to be total (unique keys), and `df` narrow. It is written down once; ranges of the order,
    whose borders are fixed from a sample, are added up, one number per range travels to the driver,
    and no task sees more than its ranges. Fixed borders give the same ranges again wherever the result is
    evaluated. With `within`, which must lead the order, totals restart for every value of these columns.
    """
    spark = df.sparkSession
    rows_written = freeze(df, "unsplit")
    rows = rows_written.count()
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(min(wanted, rows // FEWEST_RANGE_ROWS), rows // RANGE_ROWS, 1)
    starts_at = range_starts(rows_written, order_by, ranges, rows)
    key = F.struct(*order_by)
    kind = rows_written.select(key.alias("k")).schema["k"].dataType
    split = rows_written.withColumn("_rt_range", range_index(key, starts_at, kind))
    sums = split.groupBy("_rt_range").agg(F.sum(weight).cast("bigint").alias("_rt_sum")).collect()
    offsets, total = [], 0
    for row in sorted(sums, key=lambda r: r["_rt_range"]):
        offsets.append((row["_rt_range"], total))
        total += row["_rt_sum"] or 0
    starts = spark.createDataFrame(offsets, "_rt_range int, _rt_start bigint")
    before = (
        W.partitionBy("_rt_range").orderBy(*order_by).rowsBetween(W.unboundedPreceding, -1)
    )
    placed = (
        split.join(F.broadcast(starts), "_rt_range")  # one row per range
        .withColumn(name, F.col("_rt_start") + F.coalesce(F.sum(weight).over(before), F.lit(0)))
        .drop("_rt_start", "_rt_range")
    )
    if not within:
        return placed
    firsts = placed.groupBy(*[F.col(c).alias(f"_rt_{c}") for c in within]).agg(
        F.min(name).alias("_rt_first")
    )
    same = [F.col(c).eqNullSafe(F.col(f"_rt_{c}")) for c in within]
    since_first = F.col(name) - F.col("_rt_first")
    return placed.join(firsts, same).withColumn(name, since_first).select(*placed.columns)

"""Sampling without replacement by hashed keys: same rows for any partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelfx.functions import hash_key
from panelfx.functions.ids import BATCH_SIZE, COHORT_SIZE
from panelfx.session import freeze

# Seeds and sizes of the published sample.
TRAIN_SEED = 1994
VALIDATION_SEED = 1234
BATCHES_PER_COHORT = 10
SEQUENCES_PER_BATCH = 10
VALIDATION_ROWS = 2000
# Hexadecimal digits of a key, and those counted in one round.
KEY_DIGITS = 32
PREFIX_DIGITS = 4
# Row numbers carry their task above this many bits.
TASK_SHIFT = 33


def sample_two_stage(
    sequences: DataFrame,
    n_batches: int = BATCHES_PER_COHORT,
    n_sequences: int = SEQUENCES_PER_BATCH,
    seed: int = TRAIN_SEED,
    batch_size: int = BATCH_SIZE,
    cohort_size: int = COHORT_SIZE,
    unit: str = "seq_idx",
) -> DataFrame:
    """(cohort, batch_idx, seq_idx): `n_batches` per cohort, then `n_sequences` per batch.

    Ids count from 0; the last batch does not take part unless its last id is there. An absent id does
    not keep the rest of its batch out, a repeated one counts once, and only ids of the table are
    drawn. Only the id column is read. Both rankings run within a cohort's batches and a batch's
    rows, whose numbers are bounded by `cohort_size` and `batch_size`.
    """
    batch_of = F.floor(F.col(unit) / batch_size).cast("bigint")
    ids = sequences.select(unit, batch_of.alias("batch_idx")).where(F.col(unit) >= 0).distinct()
    complete = sequences.agg(F.floor((F.max(unit) + 1) / batch_size)).scalar()
    full = (
        ids.select("batch_idx")
        .distinct()
        .where(F.col("batch_idx") < complete)
        .select(F.floor(F.col("batch_idx") / cohort_size).cast("bigint").alias("cohort"), "batch_idx")
    )
    in_cohort = W.partitionBy("cohort").orderBy(hash_key(seed, F.col("batch_idx")), "batch_idx")
    batches = full.withColumn("_k", F.row_number().over(in_cohort)).where(F.col("_k") <= n_batches)
    in_batch = W.partitionBy("batch_idx").orderBy(hash_key(seed, F.col(unit)), unit)
    return (
        ids.join(batches.select("cohort", "batch_idx"), "batch_idx")
        .withColumn("_k", F.row_number().over(in_batch))
        .where(F.col("_k") <= n_sequences)
        .select("cohort", "batch_idx", unit)
    )


def sample_uniform(df: DataFrame, n: int, seed: int = VALIDATION_SEED, unit: str = "seq_idx") -> DataFrame:
    """`n` rows without replacement: those with the smallest hashed keys (all rows if there are fewer).

    A radix selection finds the n-th smallest key: counts of 65,536 key prefixes tell in which of them it is,
    and those of the next four digits, of that prefix alone, tell more, until the count is met exactly;
    the sample is then a filter, and no row is sorted or gathered. Two rounds are the rule. Where an id
    occurs in more rows than are left to draw, these are numbered and the first of them taken. Rows without an id
    share one key.
    """
    key = hash_key(seed, F.col(unit))
    if n <= 0:
        return df.limit(0)
    below, left = "", n
    while len(below) < KEY_DIGITS:
        digits = F.substring(key, len(below) + 1, PREFIX_DIGITS)
        of_prefix = df.select(unit).where(key.startswith(below))
        counts = sorted(tuple(r) for r in of_prefix.groupBy(digits.alias("p")).count().collect())
        for prefix, rows in counts:
            if rows > left:
                break
            left -= rows
        else:
            return df
        below += prefix
        if not left:
            return df.where(key < below)
    return df.where(key < below).unionByName(_first_rows(df.where(key == below), left))


def _first_rows(rows: DataFrame, n: int) -> DataFrame:
    """`n` of the rows, which are written down with numbers; one count per task is all that is gathered."""
    numbered = freeze(rows.withColumn("_row", F.monotonically_increasing_id()), "tied")
    task = F.shiftright("_row", TASK_SHIFT)
    taken = F.lit(False)
    for part, count in sorted(tuple(r) for r in numbered.groupBy(task.alias("t")).count().collect()):
        if n <= 0:
            break
        taken = taken | ((task == part) & (F.col("_row") < (part << TASK_SHIFT) + min(n, count)))
        n -= count
    return numbered.where(taken).drop("_row")

"""Surprisal, rank and entropy of true tokens, from logits or from a user's scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelfx.functions import entropy_of, surprisal_of, target_rank
from panelfx.schemas import STATS


def token_statistics(
    scored: DataFrame,
    keys: Sequence[str] = ("seq_idx", "pos"),
    logits: str = "logits",
    target: str = "target",
    method: str = "arrow",
) -> DataFrame:
    """keys..., sup, rank, entropy per token position; no shuffle.

    All three are NULL where the target is NULL or the list is NULL or empty; a target outside the
    list is an error. `method="arrow"` computes on Arrow batches, one pass over the list for all
    three; `method="native"` gives the same in Spark expressions, for short lists.
    """
    if method == "native":
        known = F.col(target).isNotNull()
        return scored.select(
            *keys,
            surprisal_of(F.col(logits), F.col(target)).alias("sup"),
            target_rank(F.col(logits), F.col(target)).alias("rank"),
            F.when(known & (F.size(logits) > 0), entropy_of(F.col(logits))).alias("entropy"),
        )
    if method != "arrow":
        raise ValueError(f"method must be 'native' or 'arrow', not {method!r}")
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            known = pc.and_(
                pc.is_valid(batch.column("_target")),
                pc.greater(pc.fill_null(pc.list_value_length(batch.column("_logits")), 0), 0),
            )
            used = batch.filter(known)
            if used.num_rows == 0:
                nothing = [pa.nulls(batch.num_rows, kind) for kind in kinds]
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *nothing], names=names)
                continue
            lists = used.column("_logits")
            offsets = lists.offsets.to_numpy()
            starts, lengths = offsets[:-1] - offsets[0], np.diff(offsets)
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            targets = used.column("_target").to_numpy()
            outside = (targets < 0) | (targets >= lengths)
            if outside.any():
                raise IndexError(f"target outside the vocabulary: {targets[outside][0]}")
            chosen = x[starts + targets]
            top = np.maximum.reduceat(x, starts)
            shifted = x - np.repeat(top, lengths)
            weight = np.exp(shifted)
            mass = np.add.reduceat(weight, starts)
            with np.errstate(invalid="ignore"):
                product = np.where(weight > 0, weight * shifted, 0.0)
            out = [
                np.log(mass) + top - chosen,
                np.add.reduceat(x > np.repeat(chosen, lengths), starts, dtype=np.int32),
                np.log(mass) - np.add.reduceat(product, starts) / mass,
            ]
            at = pa.array(np.where(known, np.cumsum(known) - 1, 0), mask=~known.to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in keys] + [pa.array(o, kind).take(at) for o, kind in zip(out, kinds, strict=True)],
                names=names,
            )

    names, kinds = [*keys, "sup", "rank", "entropy"], [pa.float64(), pa.int32(), pa.float64()]
    narrow = scored.select(*keys, F.col(logits).alias("_logits"), F.col(target).alias("_target"))
    schema = T.StructType(
        [narrow.schema[k] for k in keys]
        + [
            T.StructField("sup", T.DoubleType()),
            T.StructField("rank", T.IntegerType()),
            T.StructField("entropy", T.DoubleType()),
        ]
    )
    return narrow.mapInArrow(run, schema)


def sequence_surprisal(tokens: DataFrame, keys: Sequence[str] = ("seq_idx",)) -> DataFrame:
    """Mean surprisal per sequence from token rows."""
    return tokens.groupBy(*keys).agg(F.avg("sup").alias("sup_seq"))


def sequence_statistics(
    tokens: DataFrame, keys: Sequence[str] = ("seq_idx",), pos: str = "pos"
) -> DataFrame:
    """Token rows gathered into one row of lists per sequence, in position order."""
    ordered = F.sort_array(F.collect_list(F.struct(pos, "sup", "rank", "entropy")))
    return (
        tokens.groupBy(*keys)
        .agg(ordered.alias("t"))
        .select(
            *keys,
            F.col("t.sup").alias("sup"),
            F.col("t.rank").alias("rank"),
            F.col("t.entropy").alias("entropy"),
        )
    )


def nest_batches(stats: DataFrame, batch_size: int, unit: str = "seq_idx") -> DataFrame:
    """Batch objects whose columns are lists over the sequences of a batch."""
    batch = F.floor(F.col(unit) / batch_size).cast("bigint")
    ordered = F.sort_array(F.collect_list(F.struct(unit, "sup", "rank", "entropy")))
    return (
        stats.groupBy(batch.alias("batch"))
        .agg(ordered.alias("b"))
        .select(
            "batch", *[F.col(f"b.{c}").alias(c) for c in ("sup", "rank", "entropy", unit)]
        )
    )


def score_sequences(
    sequences: DataFrame,
    scorer: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: T.StructType = STATS,
) -> DataFrame:
    """Run a user's batch scorer over the sequences; its batches must follow `schema`."""
    return sequences.mapInArrow(scorer, schema)

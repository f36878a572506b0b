"""Mixing sources to target weights: temperature by bisection, budgets as block permutations."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelfx.llm.texts import unused
from panelfx.operators.ordering import running_total
from panelfx.session import freeze

UNKNOWN = "(none)"
SALTS = 64


@dataclass(frozen=True)
class MixOptions:
    """Target of the mixture and how it is realised.

    The exponent is the one at which the weights' entropy meets a target: `entropy` times that of equal weights, or,
    where that is None, the part `toward` of the way from the sources' own entropy to that of equal
    weights. Targets below the sources' own entropy take an exponent above 1. No source is repeated more than
    `repeats` times (None: no limit): the exponent is raised until that holds; with both targets None it
    is the smallest at which it does. `budget` is the number of tokens of the mixture (None: as many
    as the input has), block_tokens the size of a block, about.
    """

    entropy: float | None = None
    toward: float | None = 0.5
    repeats: float | None = 4.0
    budget: int | None = None
    block_tokens: int = 65_536
    seed: int = 0


# Beyond this exponent the largest source has all the weight there is.
SHARPEST = 64.0


def tempered(shares: list[float], exponent: float) -> list[float]:
    """Shares raised to the exponent and normalised; empty sources stay empty."""
    raised = [p**exponent if p > 0 else 0.0 for p in shares]
    total = math.fsum(raised)
    return [r / total for r in raised]


def entropy(weights: list[float]) -> float:
    return -math.fsum(w * math.log(w) for w in weights if w > 0)


def largest_passing(passes, low: float = 0.0, high: float = 1.0, steps: int = 60) -> float:
    """Bisection for the largest exponent that passes, where passing ones are below failing ones."""
    if passes(high):
        return high
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if passes(middle) else (low, middle)
    return low


def choose_exponent(tokens: list[int], options: MixOptions) -> float:
    """Exponent of the temperature for sources of so many tokens.

    Entropy falls and the smallest source's repetition falls as the exponent grows. Without tokens, with a
    single source or with equal ones, it is 1.
    """
    total = sum(tokens)
    full = [t for t in tokens if t > 0]
    if len(set(full)) < 2:
        return 1.0
    shares = [t / total for t in full]
    budget = total if options.budget is None else options.budget
    most, own = math.log(len(full)), entropy(shares)
    target = None
    if options.entropy is not None:
        target = options.entropy * most
    elif options.toward is not None:
        target = own + options.toward * (most - own)
    mixed = 0.0
    if target is not None:
        low, high = (0.0, 1.0) if target >= own else (1.0, SHARPEST)
        mixed = largest_passing(lambda e: entropy(tempered(shares, e)) >= target, low, high)
    if options.repeats is not None:

        def within(e: float) -> bool:
            return all(w * budget <= options.repeats * t for w, t in zip(tempered(shares, e), full, strict=True))

        if not within(mixed):
            top = max(1.0, mixed)
            mixed = top - largest_passing(lambda d: within(top - d), 0.0, top - mixed)
    return mixed


def count_words(text: Column) -> Column:
    """Words separated by white space; null and blank texts have none."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("bigint")


def source_budgets(narrow: DataFrame, options: MixOptions) -> tuple[DataFrame, float]:
    """Per source: tokens, weight, budget, whole epochs and the tokens left for a part of one more.

    The list of sources passes through the driver: it names the data sets of a mixture. A source
    without tokens has weight 0.
    """
    rows = narrow.groupBy("_source").agg(F.sum("_tokens").alias("tokens")).orderBy("_source").collect()
    tokens = [r["tokens"] for r in rows]
    exponent = choose_exponent(tokens, options)
    total = sum(tokens)
    budget = total if options.budget is None else options.budget
    weights = tempered([t / total for t in tokens], exponent) if total else [0.0] * len(tokens)
    table = []
    for row, weight in zip(rows, weights, strict=True):
        wanted = int(round(weight * budget))
        epochs, rest = divmod(wanted, row["tokens"]) if row["tokens"] else (0, 0)
        table.append((row["_source"], row["tokens"], weight, wanted, epochs, rest, -(-row["tokens"] // options.block_tokens)))
    schema = "_source string, source_tokens bigint, weight double, budget bigint, epochs bigint, _rest bigint, _blocks bigint"
    return narrow.sparkSession.createDataFrame(table, schema), exponent


def planned_copies(docs: DataFrame, options: MixOptions = MixOptions(), extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, source, n_tokens, source_tokens, weight, budget, copies.

    A source with budget for e whole epochs and a rest has each document e times; the rest is filled by
    one more permutation of its blocks: documents fall into blocks by a hash, whole blocks are taken in
    a hashed order until one no longer fits, and of that block documents in a hashed order while tokens
    are left (the last of them may pass the budget by less than its own length). Block totals are added
    up over ranges of all blocks, so a source of any size is never in one task; a block is bounded.

    Null sources are a source of their own. Documents without tokens get the copies of the epochs.
    Repeated rows are separate documents; rows equal in id and text are interchangeable, and which of
    them is the last to fit is then without effect on the result. An empty table gives an empty result.
    """
    text_key = F.xxhash64("doc_id", "text")
    narrow = freeze(
        docs.select(
            "doc_id",
            "source",
            F.coalesce(F.col("source").cast("string"), F.lit(UNKNOWN)).alias("_source"),
            count_words(F.col("text")).alias("_tokens"),
            F.xxhash64(F.lit(options.seed), text_key).alias("_order"),
            *extra,
        ),
        "tokens",
    )
    budgets, _ = source_budgets(narrow, options)
    block = F.pmod(F.xxhash64("_order"), F.greatest("_blocks", F.lit(1)))
    # a source may hold a third of all rows: the join with its budget is dealt by a salt as well
    salted = budgets.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(F.lit(1), "_order"), F.lit(SALTS)).cast("int")
    dealt = narrow.withColumn("_salt", salt).join(salted, ["_source", "_salt"]).withColumn("_block", block)
    totals = dealt.groupBy("_source", "_block", "_rest").agg(F.sum("_tokens").alias("_size"))
    totals = totals.withColumn("_turn", F.xxhash64(F.lit(options.seed + 1), "_source", "_block"))
    placed = running_total(totals, ["_source", "_turn", "_block"], F.col("_size"), "_before", within=["_source"])
    state = placed.select(
        "_source",
        "_block",
        (F.col("_rest") - F.col("_before")).alias("_left"),
        (F.col("_before") + F.col("_size") <= F.col("_rest")).alias("_whole"),
    )
    marked = dealt.join(state, ["_source", "_block"])
    cut = (~F.col("_whole")) & (F.col("_left") > 0)
    inner = W.partitionBy("_source", "_block").orderBy("_order", "_tokens").rowsBetween(W.unboundedPreceding, -1)
    whole = marked.where(~cut).withColumn("_more", (F.col("_whole") & (F.col("_rest") > 0)).cast("bigint"))
    part = marked.where(cut).withColumn(
        "_more", (F.coalesce(F.sum("_tokens").over(inner), F.lit(0)) < F.col("_left")).cast("bigint")
    )
    out = ["doc_id", "source", F.col("_tokens").alias("n_tokens"), "source_tokens", "weight", "budget"]
    return whole.unionByName(part).select(*out, (F.col("epochs") + F.col("_more")).alias("copies"), "_order", *extra)


def mix(docs: DataFrame, options: MixOptions = MixOptions()) -> DataFrame:
    """`docs` as the mixture has them: every row as often as planned_copies says, columns unchanged.

    Plans meet documents by hashes of id and text, so planning does not shuffle texts. Rows equal in id,
    text and source count as one with all their copies.
    """
    names = docs.columns
    order, copy = unused("order_key", names), unused("copy", names)
    plan = planned_copies(docs, options).groupBy("_order", F.col("source").alias("_named")).agg(
        F.sum("copies").alias("_copies"), F.count("*").alias("_rows")
    )
    plan = freeze(plan, "plan").select(*[F.col(c).alias(unused(c, names)) for c in ("_order", "_named", "_copies", "_rows")])
    key, named, copies, many = plan.columns
    odd = freeze(plan.where((F.col(many) > 1) & (F.col(copies) > 0)), "odd")
    keyed = docs.withColumn(order, F.xxhash64(F.lit(options.seed), F.xxhash64("doc_id", "text")))

    def repeated(rows: DataFrame) -> DataFrame:
        return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*names)

    def meeting(side: DataFrame) -> DataFrame:
        return keyed.join(side, F.col("source").eqNullSafe(F.col(named)) & (F.col(order) == F.col(key)))

    single = repeated(meeting(plan.where((F.col(many) == 1) & (F.col(copies) > 0))))
    if odd.isEmpty():
        return single
    return single.unionByName(repeated(meeting(odd).dropDuplicates([order, "source"])))

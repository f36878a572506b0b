"""Whole jobs, from files to files; each is a composition of operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelfx.operators.corpus import pack_sequences, sequence_lookup, tokenize, vocabulary
from panelfx.operators.demean import simple_diff
from panelfx.operators.effects import VIEWS, EffectOptions, compute_effects
from panelfx.operators.correlation import profile_correlation
from panelfx.operators.panel import (
    PanelSpec,
    assign_cohorts,
    cast_stats,
    panel_export,
    remove_dups,
    require_steps,
    require_units,
    restrict_units,
)
from panelfx.operators.profiles import (
    annotate_effects,
    lr_schedule,
    profile_final,
    profile_full,
    profile_instantaneous,
    profile_persistent,
    profile_restricted,
)
from panelfx.operators.sampling import VALIDATION_ROWS, sample_two_stage, sample_uniform
from panelfx.session import owned_scratch
from panelfx.sources.corpora import read_corpus, write_splits
from panelfx.sources.effects import read_effects, variant_name, write_effects
from panelfx.sources.panels import read_panel, read_units, write_panel
from panelfx.sources.stats import read_with_step


def pack_corpus(
    spark: SparkSession, jsonl: str, out: str, vocab: DataFrame | None = None, **packing
) -> None:
    """Text corpus -> token ids -> rows of fixed length."""
    with owned_scratch(spark):
        docs = read_corpus(spark, jsonl)
        tokenized = tokenize(docs, vocabulary(docs) if vocab is None else vocab)
        tokenized.write.mode("overwrite").parquet(f"{out}/tokenized")
        packed = pack_sequences(spark.read.schema(tokenized.schema).parquet(f"{out}/tokenized"), **packing)
        packed.write.mode("overwrite").parquet(f"{out}/packed")


def build_subset(
    sequences: DataFrame,
    out: str,
    validation: DataFrame | None = None,
    n_validation: int = VALIDATION_ROWS,
    **sampling,
) -> None:
    """Two-stage sample of the training rows, uniform sample of the validation rows, as splits."""
    wanted = sample_two_stage(sequences, **sampling).select("seq_idx")
    splits = {"train": sequence_lookup(sequences, wanted).select("seq_idx", "input_ids")}
    if validation is not None:
        splits["validation"] = sample_uniform(validation, n_validation).select("seq_idx", "input_ids")
    write_splits(out, **splits)


def export_panel(
    spark: SparkSession,
    runs: str,
    out: str,
    sizes: Sequence[str],
    pattern: str = "*.parquet",
    check: bool = True,
    **steps: int,
) -> None:
    """Raw statistics of every size below `runs/{size}` -> one panel table, written by one job."""
    panels = []
    for size in sizes:
        stats = read_with_step(spark, f"{runs}/{size}", pattern=pattern)
        if check:
            require_steps(stats.select("step"), **steps)
        panels.append(panel_export(cast_stats(stats)).withColumn("model_size", F.lit(size)))
    if panels:
        write_panel(reduce(DataFrame.unionByName, panels), out)


def load_panel(
    spark: SparkSession, panel: str, reference_size: str, dups: bool = True, **cohorts
) -> DataFrame:
    """Panel of all sizes on the units of the reference size, with cohorts."""
    whole = read_panel(spark, panel)
    reference = read_units(spark, f"{panel}/model_size={reference_size}")
    require_units(whole, reference, by=["model_size"])
    data = assign_cohorts(restrict_units(whole, reference), **cohorts)
    return data if dups else remove_dups(data)


def estimate(
    panel: DataFrame,
    out: str,
    target: str,
    options: EffectOptions = EffectOptions(),
    deduplicated: bool = False,
    only_simple_diff: bool = False,
) -> None:
    """Effects of every model size at once, written view by view, and the simple difference."""
    spec = PanelSpec(target=target, by=("model_size",))
    boot = options.se == "bootstrap"
    with owned_scratch(panel.sparkSession):
        if not only_simple_diff:
            for view, effects in compute_effects(panel, spec, options, VIEWS).items():
                write_effects(effects, out, "cs", target, view, variant_name(deduplicated, boot))
        diff = simple_diff(panel, spec).withColumn("step", F.col("step").cast("bigint"))
        write_effects(diff, out, "diff", target, "all", variant_name(deduplicated))


def profiles(
    spark: SparkSession, effects: str, target: str, variant: str = "boot", **annotation
) -> dict[str, DataFrame]:
    """The tables behind the figures of one target.

    All targets have the full profile; surprisal has the others as well.
    """
    table = annotate_effects(read_effects(spark, effects, "all", target, variant), target, **annotation)
    out = {"full": profile_full(table)}
    if target != "sup_seq":
        return out
    events = annotate_effects(
        read_effects(spark, effects, "event", target, variant), target, **annotation
    )
    steps = spark.range(0, 96_000, 1000).withColumnRenamed("id", "time")
    order = {"order": annotation["order"]} if "order" in annotation else {}
    return {
        **out,
        "restricted": profile_restricted(table),
        "lr": lr_schedule(table, steps),
        "persistent": profile_persistent(events),
        "instantaneous": profile_instantaneous(table),
        "final": profile_final(table),
        "correlation": profile_correlation(table, "pearson", **order),
    }

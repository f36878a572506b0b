"""Named queries: every operator, run over the driver's whole tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelfx.catalog.inputs import (
    ORDERS,
    SEGMENT_ORDER,
    SEGMENTS,
    documents,
    events_panel,
    numbered_panel,
    orders_panel,
    quarter_index,
    raw_stats,
    rounded,
    scored_tokens,
    table,
)
from panelfx.operators.corpus import (
    next_token_pairs,
    pack_sequences,
    sequence_lookup,
    token_frequency,
    tokenize,
    union_splits,
    vocabulary,
    words_of,
)
from panelfx.operators.correlation import profile_correlation
from panelfx.operators.demean import demean_two_way, simple_diff
from panelfx.operators.effects import EffectOptions, aggregate_effects, att_gt, compute_effects
from panelfx.operators.panel import (
    assign_cohorts,
    cast_stats,
    flatten_stats,
    missing_steps,
    missing_units,
    panel_export,
    remove_dups,
    restrict_units,
    unbalanced_units,
)
from panelfx.operators.profiles import (
    annotate_effects,
    lr_schedule,
    profile_final,
    profile_full,
    profile_instantaneous,
    profile_persistent,
    profile_pivot,
    profile_restricted,
)
from panelfx.operators.sampling import sample_two_stage, sample_uniform
from panelfx.operators.tokenstats import (
    nest_batches,
    score_sequences,
    sequence_surprisal,
    token_statistics,
)
from panelfx.plans.jobs import estimate, load_panel, profiles
from panelfx.schemas import STATS_SHORT
from panelfx.session import freeze, scratch_path
from panelfx.sources.corpora import (
    CORRUPT,
    read_corpus,
    read_json_permissive,
    read_splits,
    read_token_counts,
    write_splits,
    write_token_counts,
)
from panelfx.sources.effects import read_effect_files, read_effects, write_effect_files, write_effects
from panelfx.sources.panels import read_panel, read_units, write_panel
from panelfx.sources.snapshots import newest_of_runs, read_snapshot
from panelfx.sources.stats import (
    append_stats,
    read_nested_stats,
    read_stats,
    read_with_step,
    write_nested_stats,
)
from panelfx.streaming.incremental import stream_flatten_stats, stream_token_frequency

Query = Callable[[SparkSession, str], DataFrame]
CUTOFF = 20
PACK = 64
BOOT = EffectOptions(se="bootstrap", boot_iterations=50, seed=1234)
_QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        _QUERIES[name] = fn
        return fn

    return register


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


# --- effects -------------------------------------------------------------------------------------


@query("att_by_event")
def att_by_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effect of a first urgent order on spend, by distance to it."""
    cells = att_gt(orders_panel(spark, sf_dir), ORDERS)
    return rounded(aggregate_effects(cells, "event", ORDERS))


@query("att_by_cohort")
def att_by_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregate_effects(att_gt(orders_panel(spark, sf_dir), ORDERS), "cohort", ORDERS))


@query("att_by_time")
def att_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregate_effects(att_gt(orders_panel(spark, sf_dir), ORDERS), "time", ORDERS))


@query("att_gt")
def att_gt_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(att_gt(orders_panel(spark, sf_dir), ORDERS))



@query("att_gt_universal")
def att_gt_universal(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = EffectOptions(base_period="universal", se="none")
    return rounded(att_gt(orders_panel(spark, sf_dir), ORDERS, options))


def _analytic(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    panel = orders_panel(spark, sf_dir)
    return compute_effects(panel, ORDERS, EffectOptions(), views=(view,))[view]


@query("att_gt_se")
def att_gt_se(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_analytic(spark, sf_dir, "all"))


@query("att_by_cohort_se")
def att_by_cohort_se(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_analytic(spark, sf_dir, "cohort"))


@query("att_by_time_se")
def att_by_time_se(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_analytic(spark, sf_dir, "time"))


@query("att_by_event_se")
def att_by_event_se(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_analytic(spark, sf_dir, "event"))


@query("att_gt_bootstrap")
def att_gt_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = orders_panel(spark, sf_dir)
    return rounded(compute_effects(panel, ORDERS, BOOT, views=("all",))["all"])


@query("att_by_event_bootstrap")
def att_by_event_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = orders_panel(spark, sf_dir)
    return rounded(compute_effects(panel, ORDERS, BOOT, views=("event",))["event"])


@query("att_gt_pairwise")
def att_gt_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users x days with gaps: every difference over the users seen on both days."""
    panel = events_panel(spark, sf_dir)
    options = EffectOptions(balance="pairwise")
    return rounded(compute_effects(panel, ORDERS, options, views=("all",))["all"])


def _gap_query(view: str, options: EffectOptions) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(compute_effects(events_panel(spark, sf_dir), ORDERS, options, views=(view,))[view])

    return run


# Users x days with gaps: errors and draws follow each user's own days.
for _view in ("cohort", "time", "event"):
    _QUERIES[f"att_by_{_view}_pairwise_se"] = _gap_query(_view, EffectOptions(balance="pairwise"))
_QUERIES["att_gt_pairwise_bootstrap"] = _gap_query("all", replace(BOOT, balance="pairwise"))
_QUERIES["att_by_event_pairwise_bootstrap"] = _gap_query("event", replace(BOOT, balance="pairwise"))


@query("att_by_segment")
def att_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All segments in one run, as model sizes are."""
    return rounded(att_gt(orders_panel(spark, sf_dir, segments=True), SEGMENTS))


@query("unbalanced_users")
def unbalanced_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unbalanced_units(events_panel(spark, sf_dir), ORDERS)


@query("demean_two_way")
def demean_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(demean_two_way(orders_panel(spark, sf_dir), ORDERS))



@query("simple_diff")
def diff_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(simple_diff(orders_panel(spark, sf_dir), ORDERS))



@query("simple_diff_unbalanced")
def simple_diff_unbalanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(simple_diff(events_panel(spark, sf_dir), ORDERS))


# --- panel ---------------------------------------------------------------------------------------


def _numbered_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") - 500).alias("seq_idx"),
        quarter_index(F.col("o_orderdate")).cast("int").alias("step"),
        F.round("o_totalprice", 2).alias("sup_seq"),
    )


def _cohort_query(zero_based: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return assign_cohorts(
            _numbered_orders(spark, sf_dir), batch_size=64, cohort_size=10, zero_based=zero_based
        )

    return run


_QUERIES["assign_cohorts"] = _cohort_query(False)
_QUERIES["assign_cohorts_zero_based"] = _cohort_query(True)


@query("remove_dups")
def cut_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_dups(orders_panel(spark, sf_dir), CUTOFF, "t", "g")



def _segment_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "customer")
        .where(F.col("c_mktsegment") == "BUILDING")
        .select(F.col("c_custkey").alias("seq_idx"))
    )


@query("restrict_units")
def restrict_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("seq_idx"), "o_orderkey")
    return restrict_units(orders, _segment_units(spark, sf_dir))



@query("missing_units")
def units_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of the segment without an order above 480,000."""
    orders = (
        table(spark, sf_dir, "orders")
        .where(F.col("o_totalprice") > 480_000)
        .select(F.col("o_custkey").alias("seq_idx"))
    )
    return missing_units(orders, _segment_units(spark, sf_dir))



@query("missing_steps")
def days_without_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "events").select(F.dayofmonth("ts").alias("step"))
    return missing_steps(found, 0, 40, 1)



@query("scan_with_step")
def scan_with_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written to one directory per day, read back with the day taken from the path."""
    root = scratch_path(spark, "runs")
    events = table(spark, sf_dir, "events").select(
        "event_id", "value", F.dayofmonth("ts").alias("day")
    )
    run = F.concat(F.lit("size-step"), F.col("day").cast("string"), F.lit("_2024-01-01T00-00-00"))
    events.withColumn("run", run).drop("day").write.partitionBy("run").parquet(root)
    return read_with_step(spark, root, schema="event_id bigint, value double")


@query("panel_export")
def export_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = raw_stats(spark, sf_dir).withColumn("step", F.lit(0))
    return rounded(panel_export(cast_stats(stats)))



def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nest_batches(raw_stats(spark, sf_dir), 4)


def _stats_as_text(stats: DataFrame) -> DataFrame:
    return stats.select(
        "seq_idx",
        F.size("sup").alias("n"),
        F.aggregate("sup", F.lit(0.0), lambda a, x: a + x).alias("sup_sum"),
        F.array_join(F.col("rank").cast("array<string>"), ",").alias("ranks"),
        F.aggregate("entropy", F.lit(0.0), lambda a, x: a + x).alias("entropy_sum"),
    )


@query("flatten_stats")
def flatten_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics nested into batches, written as JSON lines, read back and flattened."""
    path = f"{scratch_path(spark, 'stats')}.jsonl"
    write_nested_stats(_nested(spark, sf_dir), path, "all")
    return rounded(_stats_as_text(flatten_stats(read_nested_stats(spark, path))))



@query("append_runs")
def append_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same statistics appended as two runs, one of them twice, then exported."""
    path = scratch_path(spark, "steps")
    stats = raw_stats(spark, sf_dir)
    for run, step in (("first", 0), ("second", 1000), ("first", 0)):
        append_stats(stats.withColumn("step", F.lit(step)), path, run)
    schema = T.StructType([*stats.schema.fields, T.StructField("step", T.IntegerType())])
    return rounded(panel_export(cast_stats(read_stats(spark, path, schema).drop("run"))))


@query("panel_store")
def stored_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A panel of two model sizes written, read back, and kept to the units of the first size."""
    path = scratch_path(spark, "panel")
    panel = panel_export(cast_stats(raw_stats(spark, sf_dir).withColumn("step", F.lit(0))))
    write_panel(panel.where(F.col("seq_idx") % 2 == 0).withColumn("model_size", F.lit("a")), path)
    write_panel(panel.withColumn("model_size", F.lit("b")), path)
    units = read_units(spark, f"{path}/model_size=a")
    return rounded(restrict_units(read_panel(spark, path), units))


# --- token statistics ----------------------------------------------------------------------------


def _token_query(method: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(token_statistics(scored_tokens(spark, sf_dir), method=method))

    return run


@query("token_statistics_edges")
def token_statistics_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the tokens have a target or logits, in turn NULL or empty otherwise."""
    tokens = scored_tokens(spark, sf_dir)
    token = F.col("seq_idx") * 10 + F.col("pos")
    edged = tokens.withColumns(
        {
            "target": F.when(token % 6 != 0, F.col("target")),
            "logits": F.when(token % 6 == 3, F.slice("logits", 1, 0)).otherwise(F.col("logits")),
        }
    )
    return rounded(token_statistics(edged))


_QUERIES["token_statistics"] = _token_query("native")
_QUERIES["token_statistics_arrow"] = _token_query("arrow")


@query("sequence_surprisal")
def mean_surprisal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sequence_surprisal(token_statistics(scored_tokens(spark, sf_dir))))



# --- corpus --------------------------------------------------------------------------------------


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary(documents(spark, sf_dir))


_QUERIES["vocabulary"] = _vocabulary


def _tokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(documents(spark, sf_dir), _vocabulary(spark, sf_dir))


def _ids_as_text(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "input_ids", F.array_join(F.col("input_ids").cast("array<string>"), " ")
    )


@query("tokenize")
def tokenize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids_as_text(_tokenized(spark, sf_dir))



def _word_lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda text: [len(word) for word in text.split()])


@query("tokenize_custom")
def tokenize_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tokenizer of the user's: each word becomes its number of characters."""
    return _ids_as_text(tokenize(documents(spark, sf_dir), tokenizer=_word_lengths))


@query("token_frequency")
def frequency_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = documents(spark, sf_dir).select(words_of(F.col("text")).alias("input_ids"))
    return token_frequency(words)



@query("token_count_store")
def token_count_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts written and read back."""
    path = scratch_path(spark, "counts")
    write_token_counts(frequency_of_words(spark, sf_dir), path)
    return read_token_counts(spark, path, "string")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = documents(spark, sf_dir).select("doc_id", words_of(F.col("text")).alias("input_ids"))
    return pack_sequences(words, PACK)


@query("pack_sequences")
def pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = _packed(spark, sf_dir)
    return packed.select("seq_idx", F.array_join("input_ids", " ").alias("words"))



@query("next_token_pairs")
def word_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = documents(spark, sf_dir).select("doc_id", words_of(F.col("text")).alias("words"))
    return next_token_pairs(words, "doc_id", "words")



@query("sample_two_stage")
def two_stage_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq_idx"))
    return sample_two_stage(orders, n_batches=3, n_sequences=5, batch_size=64, cohort_size=10)



@query("sample_uniform")
def uniform_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq_idx"), "o_custkey"
    )
    return sample_uniform(orders, 500)



@query("sequence_lookup")
def sampled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of two-stage sampled documents: batches of 10 documents, cohorts of 5 batches."""
    docs = documents(spark, sf_dir).select(
        F.col("doc_id").alias("seq_idx"), words_of(F.col("text")).alias("input_ids")
    )
    wanted = sample_two_stage(docs, n_batches=2, n_sequences=3, batch_size=10, cohort_size=5)
    found = sequence_lookup(docs, wanted)
    return found.select("cohort", "batch_idx", "seq_idx", F.array_join("input_ids", " ").alias("words"))



def _two_splits(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    words = words_of(F.col("text")).alias("input_ids")
    bench = table(spark, sf_dir, "benchmark").select((-100 - F.col("item_id")).alias("seq_idx"), words)
    train = documents(spark, sf_dir).select(F.col("doc_id").alias("seq_idx"), words)
    return {"train": train, "validation": bench}


def _digests(splits: DataFrame) -> DataFrame:
    """Number of words and digest of the word list of every row."""
    words = F.array_join("input_ids", " ")
    return splits.select("seq_idx", F.size("input_ids").alias("n_words"), F.md5(words).alias("md5"), "split")


@query("union_splits")
def both_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(union_splits(**_two_splits(spark, sf_dir)))



@query("split_store")
def split_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits written as word lists, and both read back."""
    path = scratch_path(spark, "splits")
    write_splits(path, **_two_splits(spark, sf_dir))
    schema = T.StructType(
        [T.StructField("seq_idx", T.LongType()), T.StructField("input_ids", T.ArrayType(T.StringType()))]
    )
    return _digests(read_splits(spark, path, "train", "validation", schema=schema))


@query("read_json_permissive")
def read_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' JSON, with every 'error' event's line damaged, read with bad lines kept."""
    path = scratch_path(spark, "props")
    props = F.col("props")
    damaged = F.when(F.col("event_type") == "error", F.concat(F.lit("{"), props)).otherwise(props)
    table(spark, sf_dir, "events").select(damaged.alias("value")).write.text(path)
    rows = read_json_permissive(spark, path, T.StructType([T.StructField("k", T.LongType())]))
    return rows.groupBy("k", F.col(CORRUPT).alias("bad_line")).agg(F.count("*").alias("n"))



@query("read_corpus")
def corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as JSON lines, read back with a fixed schema."""
    path = scratch_path(spark, "corpus")
    documents(spark, sf_dir).write.json(path)
    return read_corpus(spark, path).select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("md5"))


# --- profiles ------------------------------------------------------------------------------------


def _segment_effects(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    panel = orders_panel(spark, sf_dir, segments=True)
    return compute_effects(panel, SEGMENTS, EffectOptions(), views=(view,))[view]


def _annotated(spark: SparkSession, sf_dir: str, view: str = "all") -> DataFrame:
    effects = _segment_effects(spark, sf_dir, view)
    return annotate_effects(effects, "acc_seq", SEGMENT_ORDER, exclude=("HOUSEHOLD",))


def _annotate_query(target: str, legacy: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        effects = _segment_effects(spark, sf_dir, "all")
        return rounded(
            annotate_effects(effects, target, SEGMENT_ORDER[:4], ("HOUSEHOLD",), legacy)
        )

    return run


_QUERIES["annotate_effects"] = _annotate_query("sup_seq")
_QUERIES["annotate_effects_legacy"] = _annotate_query("sup_seq", legacy=True)
_QUERIES["annotate_effects_accuracy"] = _annotate_query("acc_seq")


def _profile_query(profile: Callable[[DataFrame], DataFrame], view: str = "all") -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(profile(_annotated(spark, sf_dir, view)))

    return run


_QUERIES["profile_full"] = _profile_query(profile_full)
_QUERIES["profile_restricted"] = _profile_query(lambda a: profile_restricted(a, CUTOFF))
_QUERIES["profile_instantaneous"] = _profile_query(lambda a: profile_instantaneous(a, CUTOFF))
_QUERIES["profile_final"] = _profile_query(lambda a: profile_final(a, CUTOFF))
_QUERIES["profile_persistent"] = _profile_query(lambda a: profile_persistent(a, CUTOFF), "event")


def _profile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects per segment as a profile table; point estimates will do."""
    effects = att_gt(orders_panel(spark, sf_dir, segments=True), SEGMENTS)
    return effects.withColumn("memorisation", F.col("ATT"))


@query("profile_pivot")
def pivot_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile_pivot(_profile_table(spark, sf_dir), SEGMENT_ORDER))



def _correlation_query(method: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(profile_correlation(_profile_table(spark, sf_dir), method, SEGMENT_ORDER))

    return run


_QUERIES["profile_correlation"] = _correlation_query("pearson")
_QUERIES["profile_correlation_spearman"] = _correlation_query("spearman")
_QUERIES["profile_correlation_kendall"] = _correlation_query("kendall")


@query("panel_job")
def panel_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From an exported panel of two sizes to the full profile, by the whole jobs and through their files."""
    panel, effects = scratch_path(spark, "panel"), scratch_path(spark, "effects")
    write_panel(numbered_panel(spark, sf_dir, {"70m": 1.0, "12b": 3.0}), panel)
    loaded = load_panel(spark, panel, "70m", batch_size=16, cohort_size=4)
    estimate(loaded, effects, "acc_seq", EffectOptions())
    full = profiles(spark, effects, "acc_seq", "plain")["full"]
    measures = ("ATT", "std_error", "lower", "upper", "zero_not_in_cband", "memorisation", "stdlower", "stdupper", "zero_not_in_cf")
    return rounded(full.select("cohort", "base_period", "time", "model_size", "size_rank", *measures))


@query("lr_schedule")
def schedule_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learning rate on every day with an order, for a run as long as the order history."""
    days = table(spark, sf_dir, "orders").select(
        F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).cast("bigint").alias("time")
    )
    return rounded(lr_schedule(days, days), 8)



@query("effect_store")
def effect_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects of all segments written in one job; one variant read back by its labels."""
    root = scratch_path(spark, "effects")
    effects = _segment_effects(spark, sf_dir, "event")
    write_effects(effects, root, "cs", "spend", "event")
    return rounded(read_effects(spark, root, "event", "spend"))


@query("effect_files")
def effect_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects of all segments as a file each, read back with the size from the file's name."""
    root = scratch_path(spark, "effect-files")
    write_effect_files(freeze(_segment_effects(spark, sf_dir, "event")), root, "spend", "event")
    return rounded(read_effect_files(spark, root, "event", "spend"))


# --- incremental and user code -------------------------------------------------------------------


@query("stream_flatten_stats")
def stream_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, sink = f"{scratch_path(spark, 'in')}.jsonl", scratch_path(spark, "out")
    write_nested_stats(_nested(spark, sf_dir), source, "all")
    arrived = newest_of_runs(spark, source)[0]
    stream_flatten_stats(spark, arrived, sink, scratch_path(spark, "progress")).awaitTermination()
    return rounded(_stats_as_text(spark.read.parquet(sink)))



@query("stream_token_frequency")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, sink = scratch_path(spark, "in"), scratch_path(spark, "out")
    words = documents(spark, sf_dir).select(words_of(F.col("text")).alias("input_ids"))
    words.write.parquet(source)
    progress = scratch_path(spark, "progress")
    stream_token_frequency(spark, source, sink, progress, words.schema).awaitTermination()
    return read_snapshot(spark, sink)



def _length_scorer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stands in for a model: the surprisal of a sequence is its number of words over 100."""
    for batch in batches:
        counts = batch.column("input_ids").value_lengths().cast(pa.float64())
        scores = pc.divide(counts, pa.scalar(100.0))
        yield pa.RecordBatch.from_arrays(
            [batch.column("seq_idx"), scores], names=["seq_idx", "sup_seq"]
        )


@query("score_sequences")
def score_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(
        F.col("doc_id").alias("seq_idx"), words_of(F.col("text")).alias("input_ids")
    )
    return rounded(score_sequences(docs, _length_scorer, STATS_SHORT))


"""Plans: what is read, what is shuffled, and where Python runs."""

import re

import pytest
from conftest import SPEC

from panelfx.operators.corpus import next_token_pairs, token_frequency
from panelfx.operators.demean import simple_diff
from panelfx.operators.effects import aggregate_effects, att_gt
from panelfx.operators.panel import cast_stats, flatten_stats, panel_export, remove_dups, restrict_units
from panelfx.operators.sampling import sample_two_stage
from panelfx.operators.tokenstats import token_statistics
from panelfx.schemas import SEQUENCES, STATS, STATS_NESTED


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"Exchange hashpartitioning", plan_of(df)))


@pytest.fixture(scope="module")
def panel(golden, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "panel")
    golden.selectExpr("*", "'x' as note", "1.0D as other").write.parquet(path)
    return golden.sparkSession.read.parquet(path)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    def store(schema):
        path = str(tmp_path_factory.mktemp("plans") / "table")
        spark.createDataFrame([], schema).selectExpr("*", "'x' as note").write.parquet(path)
        return spark.read.parquet(path)

    return store


def test_effects_read_four_columns_and_run_in_the_jvm(panel):
    df = aggregate_effects(att_gt(panel, SPEC), "event")
    plan = plan_of(df)
    assert "ReadSchema: struct<u:bigint,t:int,g:bigint,y:double>" in plan
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("FileScan") == 1
    # one over the panel (its units, so that repeated rows are seen), the others over cohort x time rows
    assert shuffles(df) <= 6
    assert len(re.findall(r"Exchange hashpartitioning\(unit", plan)) == 1


def test_no_window_over_everything(panel):
    assert "SinglePartition" not in plan_of(att_gt(panel, SPEC))
    for df in (att_gt(panel, SPEC), simple_diff(panel, SPEC)):
        for partition in re.findall(r"windowspecdefinition\(([^,)]*)", plan_of(df)):
            assert re.match(r"(cohort|time|t)#", partition)


def test_simple_diff_reads_no_other_columns(panel):
    plan = plan_of(simple_diff(panel, SPEC))
    assert "note" not in plan and "other" not in plan and "Python" not in plan


def test_filters_reach_the_scan(panel):
    plan = plan_of(remove_dups(panel, 2, "t", "g").select("u"))
    assert "PushedFilters: [IsNotNull(t), Or(LessThanOrEqual(g,2),IsNull(g)), LessThanOrEqual(t,2)]" in plan
    assert "ReadSchema: struct<u:bigint,t:int,g:bigint>" in plan


def test_restriction_is_a_semi_join_on_one_column(panel):
    plan = plan_of(restrict_units(panel, panel, "u"))
    assert "LeftSemi" in plan and "ReadSchema: struct<u:bigint>" in plan


def test_projections_do_not_shuffle(stored):
    tokens = stored("seq_idx bigint, pos int, target int, logits array<float>")
    for df in (
        panel_export(cast_stats(stored(STATS).selectExpr("*", "1 as step"))),
        flatten_stats(stored(STATS_NESTED).drop("note")),
        token_statistics(tokens, method="native"),
        token_statistics(tokens, method="arrow"),
        next_token_pairs(stored(SEQUENCES)),
    ):
        assert "Exchange" not in plan_of(df)


def test_counts_are_partly_aggregated_before_the_shuffle(stored):
    plan = plan_of(token_frequency(stored(SEQUENCES)))
    assert plan.count("HashAggregate") == 2 and "ReadSchema: struct<input_ids:array<int>>" in plan


def test_sampling_reads_ids_and_limits_groups_early(stored):
    plan = plan_of(sample_two_stage(stored(SEQUENCES), 2, 2))
    assert "WindowGroupLimit" in plan
    assert set(re.findall(r"ReadSchema: (\S+)", plan)) == {"struct<seq_idx:bigint>"}

import json

import pytest
from pyspark.sql import functions as F

from panelfx.operators.panel import (
    assign_cohorts,
    cast_stats,
    flatten_stats,
    missing_steps,
    missing_units,
    panel_export,
    remove_dups,
    require_steps,
    require_units,
    restrict_units,
)
from panelfx.functions import step_from_path
from panelfx.schemas import STATS, STATS_NESTED
from panelfx.sources.stats import read_nested_stats, read_stats, read_with_step, stats_from_jsonl

NESTED_LINE = [
    {"sup": [[0.5, 1.5], [1, 2]], "rank": [[0, 3], [0, 0]], "entropy": [[1, 1], [2, 2]], "seq_idx": [1, 1025]},
    {"sup": [[3, 4]], "rank": [[5, 0]], "entropy": [[0.5, 0.5]], "seq_idx": [-100]},
]


@pytest.fixture
def nested_file(tmp_path):
    path = tmp_path / "data.jsonl"
    path.write_text(json.dumps(NESTED_LINE) + "\n\n" + json.dumps(NESTED_LINE[1:]) + "\n")
    return str(path)


def test_nested_lines_to_panel_with_cohorts(spark, nested_file):
    flat = flatten_stats(read_nested_stats(spark, nested_file))
    assert flat.count() == 4
    panel = panel_export(cast_stats(flat.distinct(), F.lit(7)))
    rows = {r["seq_idx"]: r for r in assign_cohorts(panel).collect()}
    wanted = {
        1: (1.0, 1.0, 0.5, 1.5, 1, 1000),
        1025: (1.5, 2.0, 1.0, 0.0, 2, 1000),
        -100: (3.5, 0.5, 0.5, 2.5, 200_000_000, None),
    }
    for unit, values in wanted.items():
        r = rows[unit]
        got = (r["sup_seq"], r["entr_seq"], r["acc_seq"], r["avg_rank"], r["batch_idx"], r["cohort"])
        assert got == values


def test_flat_files_are_written(spark, nested_file, tmp_path):
    out = str(tmp_path / "flat")
    stats_from_jsonl(spark, nested_file, out)
    assert read_stats(spark, out).count() == 4


def test_suffix_is_checked(spark):
    with pytest.raises(ValueError, match="jsonl"):
        read_nested_stats(spark, "/tmp/data.json")


def test_empty_lists_and_uneven_lists(spark):
    stats = spark.createDataFrame([(1, [], [], []), (2, [1.0, None, 3.0], [0, 1], [2.0]), (3, None, None, None)], STATS)
    rows = {r["seq_idx"]: r for r in panel_export(cast_stats(stats, F.lit(0))).collect()}
    for empty in (1, 3):
        assert [rows[empty][c] for c in ("sup_seq", "entr_seq", "acc_seq", "avg_rank")] == [None] * 4
    assert rows[2]["sup_seq"] == 2.0 and rows[2]["acc_seq"] == 0.5
    uneven = spark.createDataFrame([([[1.0]], [[1], [2]], [[1.0]], [5])], STATS_NESTED)
    with pytest.raises(Exception, match="differ in length"):
        flatten_stats(uneven).collect()


def test_empty_batches(spark):
    empty = spark.createDataFrame([([], [], [], [])], STATS_NESTED)
    assert flatten_stats(empty).count() == 0
    assert [tuple(r) for r in flatten_stats(empty, keep_empty=True).collect()] == [(None,) * 4]


def test_cohort_edges(spark):
    ids = spark.createDataFrame([(i,) for i in (0, 1, 1024, 1025, 1_024_000, 1_024_001, -100)], "seq_idx bigint")
    got = {r["seq_idx"]: (r["batch_idx"], r["cohort"]) for r in assign_cohorts(ids).collect()}
    assert got == {
        0: (200_000_000, None),
        1: (1, 1000),
        1024: (1, 1000),
        1025: (2, 1000),
        1_024_000: (1000, 1000),
        1_024_001: (1001, 2000),
        -100: (200_000_000, None),
    }
    zero = {r["seq_idx"]: (r["batch_idx"], r["cohort"]) for r in assign_cohorts(ids, zero_based=True).collect()}
    assert zero[0] == (1, 1000) and zero[1024] == (2, 1000) and zero[1_024_000] == (1001, 2000)
    assert zero[-100] == (200_000_000, None)


def test_cut_keeps_controls(spark):
    rows = [(95_000, 1), (96_000, 1), (None, 95_000), (None, 96_000), (1000, 96_000)]
    df = spark.createDataFrame(rows, "cohort bigint, step int")
    assert sorted(map(tuple, remove_dups(df).collect()), key=str) == [(95_000, 1), (None, 95_000)]


def test_reference_units(spark):
    data = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "a"), (3, "b")], "seq_idx bigint, size string")
    reference = spark.createDataFrame([(1,), (2,), (1,)], "seq_idx bigint")
    assert restrict_units(data, reference).count() == 3
    assert missing_units(data, reference).count() == 0
    require_units(data, reference)
    with pytest.raises(ValueError, match="size='b'"):
        require_units(data, reference, by=["size"])
    with pytest.raises(ValueError, match="9"):
        require_units(data, spark.createDataFrame([(9,)], "seq_idx bigint"))


def test_steps(spark):
    found = spark.createDataFrame([(0,), (2000,), (2000,)], "step int")
    assert [r["step"] for r in missing_steps(found, 0, 4000, 1000).orderBy("step").collect()] == [1000, 3000]
    with pytest.raises(RuntimeError, match=r"\[1000, 3000\]"):
        require_steps(found, 0, 4000, 1000)
    require_steps(found, 0, 4000, 2000)


@pytest.mark.parametrize("stamp", ["", "_2024-01-01T00-00-00"])
def test_step_from_path(spark, tmp_path, stamp):
    name = f"size-70m-step7000{stamp}"
    path = str(tmp_path / name / "data-size-70m-step7000.parquet")
    row = spark.createDataFrame([(path,)], "p string").select(step_from_path(F.col("p"))).first()
    assert row[0] == 7000
    stats = spark.createDataFrame([(1, [0.5], [0], [1.0])], STATS)
    stats.write.parquet(path)
    read = read_with_step(spark, str(tmp_path))
    assert [(r["seq_idx"], r["rank"], r["step"]) for r in read.collect()] == [(1, [0], 7000)]


def test_export_is_one_projection(spark):
    stats = spark.createDataFrame([(1, [0.5], [0], [1.0])], STATS)
    plan = panel_export(cast_stats(stats, F.lit(0)))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan

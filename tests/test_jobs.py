import json

import pytest
from pyspark.sql import functions as F

from panelfx.operators.effects import EffectOptions
from panelfx.operators.corpus import token_frequency
from panelfx.operators.ordering import running_total
from panelfx.operators.panel import flatten_stats
from panelfx.plans.jobs import build_subset, estimate, export_panel, load_panel, pack_corpus, profiles
from panelfx.schemas import SEQUENCES, STATS, TOKENIZED
from panelfx.sources.corpora import read_splits
from panelfx.sources.effects import read_effects
from panelfx.sources.panels import read_panel
from panelfx.sources.snapshots import complete_versions, newest, publish, read_snapshot
from panelfx.sources.stats import append_stats, read_nested_stats, read_stats, stats_from_jsonl, write_nested_stats
from panelfx.streaming.incremental import stream_flatten_stats, stream_token_frequency

STEPS = range(0, 5000, 1000)


@pytest.fixture(scope="module")
def runs(spark, tmp_path_factory):
    """Two sizes x five steps of raw statistics: cohorts 2000 and 3000, and controls."""
    root = tmp_path_factory.mktemp("runs")
    units = [-100, -101, -102, -103] + [1_024_001 + i for i in range(4)] + [2_048_001 + i for i in range(4)]
    for size, strength in (("70m", 0.5), ("12b", 1.0)):
        for step in STEPS:
            rows = []
            for u in units:
                cohort = 0 if u <= 0 else (2000 if u < 2_048_000 else 3000)
                drop = strength if cohort and step >= cohort else 0.0
                level = 5.0 + (u * 7 + step // 1000 * 3) % 5 * 0.01 - step / 10_000 - drop
                rows.append((u, [level, level + 0.2], [0, 3], [1.0, 2.0]))
            path = root / size / f"run-{size}-step{step}_2024-01-01T00-00-00" / f"data-{size}-step{step}.parquet"
            spark.createDataFrame(rows, STATS).coalesce(1).write.parquet(str(path))
    return str(root)


def test_runs_to_profiles(spark, runs, tmp_path):
    panel_path, out = str(tmp_path / "panel"), str(tmp_path / "effects")
    with pytest.raises(RuntimeError, match="5000"):
        export_panel(spark, runs, panel_path, ["70m"], stop=6000)
    export_panel(spark, runs, panel_path, ["70m", "12b"], stop=5000)
    assert read_panel(spark, panel_path).count() == 2 * 5 * 12
    panel = load_panel(spark, panel_path, "70m")
    assert load_panel(spark, panel_path, "70m", dups=False).count() == panel.count()
    estimate(panel, out, "sup_seq", EffectOptions(se="bootstrap", boot_iterations=200))
    cohorts = read_effects(spark, out, "cohort", "sup_seq", "boot").collect()
    assert {(r["model_size"], r["cohort"]) for r in cohorts} == {(s, c) for s in ("70m", "12b") for c in (2000, 3000)}
    for r in cohorts:
        assert r["ATT"] == pytest.approx(-1.0 if r["model_size"] == "12b" else -0.5, abs=0.05)
    assert read_effects(spark, out, "all", "sup_seq", estimator="diff").count() == 2 * 2 * 5
    tables = profiles(spark, out, "sup_seq")
    assert set(tables) == {"full", "restricted", "lr", "persistent", "instantaneous", "final", "correlation"}
    assert tables["instantaneous"].count() == 4
    assert all(r["memorisation"] > 0.4 for r in tables["full"].collect())
    assert tables["lr"].count() == 96
    pairs = {(r["model_size"], r["other"]): r["value"] for r in tables["correlation"].collect()}
    assert pairs[("70M", "12B")] > 0.9 and pairs[("70M", "70M")] == pytest.approx(1.0)
    estimate(panel, out, "acc_seq", only_simple_diff=True)
    assert read_effects(spark, out, "all", "acc_seq", estimator="diff").count() == 20


def test_corpus_to_subset(spark, tmp_path):
    corpus = tmp_path / "corpus.jsonl"
    texts = [f"w{i % 7} w{i % 3} x" for i in range(40)]
    corpus.write_text("\n".join(json.dumps({"doc_id": i, "text": t}) for i, t in enumerate(texts)))
    out = str(tmp_path / "validation")
    pack_corpus(spark, str(corpus), out, length=10)
    validation = spark.read.schema(SEQUENCES).parquet(f"{out}/packed")
    assert validation.count() == 12
    train = spark.createDataFrame([(i, [i]) for i in range(64)], SEQUENCES)
    subset = str(tmp_path / "subset")
    build_subset(train, subset, validation, n_validation=5, n_batches=2, n_sequences=3, batch_size=8, cohort_size=4)
    splits = read_splits(spark, subset).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in splits} == {"train": 12, "validation": 5}


def test_streamed_statistics_equal_batch(spark, tmp_path):
    source, sink, progress = (str(tmp_path / d) for d in ("in.jsonl", "out", "progress"))
    line = [{"sup": [[1.0], [2.0]], "rank": [[0], [1]], "entropy": [[0.5], [0.6]], "seq_idx": [1, 2]}]
    (tmp_path / "in.jsonl").mkdir()
    for part in range(3):
        (tmp_path / "in.jsonl" / f"{part}.jsonl").write_text(json.dumps(line) + "\n")
        stream_flatten_stats(spark, source, sink, progress, files_per_batch=1).awaitTermination()
    batch = flatten_stats(read_nested_stats(spark, source))
    key = lambda df: sorted(map(str, df.select("seq_idx", "sup", "rank", "entropy").collect()))
    assert key(spark.read.schema(STATS).parquet(sink)) == key(batch)


def test_streamed_counts_equal_batch(spark, tmp_path):
    source, sink, progress = (str(tmp_path / d) for d in ("in", "out", "progress"))
    for part in range(3):
        rows = [(part * 10 + i, [i % 4, part]) for i in range(8)]
        spark.createDataFrame(rows, TOKENIZED).write.mode("append").parquet(source)
        stream_token_frequency(spark, source, sink, progress, files_per_batch=2).awaitTermination()
    wanted = {r["token"]: r["count"] for r in token_frequency(spark.read.parquet(source)).collect()}
    assert {r["token"]: r["count"] for r in read_snapshot(spark, sink).collect()} == wanted


@pytest.mark.parametrize("range_rows", [7, 2_000_000])
def test_running_total_restarts_within_groups(spark, monkeypatch, range_rows):
    monkeypatch.setattr("panelfx.operators.ordering.RANGE_ROWS", range_rows)
    rows = [(g, i, i % 3) for g in ("a", "b") for i in range(200)]
    df = spark.createDataFrame(rows, "g string, i bigint, w bigint").repartition(6)
    got = {(r["g"], r["i"]): r["before"] for r in running_total(df, ["g", "i"], F.col("w"), "before", ["g"]).collect()}
    for g in "ab":
        total = 0
        for i in range(200):
            assert got[(g, i)] == total
            total += i % 3


def test_jobs_can_run_twice_and_clean_up(spark, runs, tmp_path):
    import os

    from panelfx.session import scratch_root

    panel_path, out = str(tmp_path / "panel"), str(tmp_path / "effects")
    before = set(os.listdir(scratch_root(spark)))
    counts = []
    for _ in range(2):
        export_panel(spark, runs, panel_path, ["70m", "12b"], stop=5000)
        estimate(load_panel(spark, panel_path, "70m"), out, "sup_seq", EffectOptions(se="analytic"))
        counts.append((read_panel(spark, panel_path).count(), read_effects(spark, out, "all", "sup_seq", "plain").count()))
    assert counts[0] == counts[1] and counts[0][0] == 2 * 5 * 12
    export_panel(spark, runs, panel_path, ["70m"], stop=5000)
    assert read_panel(spark, panel_path).count() == counts[0][0]
    assert set(os.listdir(scratch_root(spark))) == before


def test_a_bad_line_stops_the_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    good = json.dumps({"seq_idx": [1], "sup": [[0.5]], "rank": [[1]], "entropy": [[0.1]]})
    (source / "a.json").write_text(good + "\n" + good[:20] + "\n")
    with pytest.raises(Exception, match="FAILED_READ_FILE|MALFORMED"):
        stream_flatten_stats(spark, str(source), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()


def test_readers_see_whole_versions_only(spark, tmp_path):
    path = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        read_snapshot(spark, path)
    publish(spark.range(10), path)
    before = read_snapshot(spark, path)
    # what a killed run leaves: files, but no mark
    spark.range(3).write.parquet(f"{path}/version=1")
    assert read_snapshot(spark, path).count() == 10
    assert publish(spark.range(20), path, version=1) == 1
    assert read_snapshot(spark, path).count() == 20
    # a reader that began earlier still finds its files
    assert before.count() == 10
    # a repeated batch changes nothing
    publish(spark.range(99), path, version=1)
    assert read_snapshot(spark, path).count() == 20
    publish(spark.range(5), path)
    assert complete_versions(spark, path) == [1, 2] and read_snapshot(spark, path).count() == 5


def test_a_killed_stream_goes_on(spark, tmp_path):
    """The last batch is not committed: neither when its version is complete nor when half of it is there."""
    import os

    source, sink, progress = (str(tmp_path / d) for d in ("in", "out", "progress"))

    def feed(part):
        rows = [(part * 10 + i, [i % 4, part]) for i in range(8)]
        spark.createDataFrame(rows, TOKENIZED).write.mode("append").parquet(source)

    def counts():
        return {r["token"]: r["count"] for r in read_snapshot(spark, sink).collect()}

    for part, damage in ((0, None), (1, "commit"), (2, "version")):
        feed(part)
        stream_token_frequency(spark, source, sink, progress).awaitTermination()
        wanted = {r["token"]: r["count"] for r in token_frequency(spark.read.parquet(source)).collect()}
        assert counts() == wanted
        commits = sorted((int(f) for f in os.listdir(f"{progress}/commits") if f.isdigit()))
        if damage:
            os.remove(f"{progress}/commits/{commits[-1]}")
            os.remove(f"{progress}/commits/.{commits[-1]}.crc")
        if damage == "version":
            os.remove(f"{newest(spark, sink)}/_complete")
            before = counts()
            assert before != wanted and sum(before.values()) == 32
        if damage:
            stream_token_frequency(spark, source, sink, progress).awaitTermination()
            assert counts() == wanted


def test_a_run_appended_again_is_there_once(spark, tmp_path):
    path = str(tmp_path / "stats")
    assert read_stats(spark, path).count() == 0
    stats = spark.createDataFrame([(1, [1.0], [0], [0.5]), (2, [2.0], [1], [0.5])], STATS).withColumn("step", F.lit(0))
    schema = f"{STATS.simpleString()[7:-1]},step:int".replace(":", " ")
    from pyspark.sql import types as T

    wide = T._parse_datatype_string(schema)
    for run, rows in (("a", stats), ("b", stats), ("a", stats), ("b", stats.where("seq_idx = 1"))):
        append_stats(rows, path, run)
    found = sorted((r["run"], r["seq_idx"], r["step"]) for r in read_stats(spark, path, wide).collect())
    assert found == [("a", 1, 0), ("a", 2, 0), ("b", 1, 0)]
    with pytest.raises(ValueError, match="letters"):
        append_stats(stats, path, "a/b")


def test_nested_runs_are_replaced(spark, tmp_path):
    path, out = f"{tmp_path}/raw.jsonl", str(tmp_path / "flat")
    nested = spark.createDataFrame(
        [(0, [[1.0]], [[0]], [[0.5]], [7]), (1, [[2.0]], [[1]], [[0.5]], [8])],
        "batch int, sup array<array<double>>, rank array<array<int>>, entropy array<array<double>>, seq_idx array<bigint>",
    )
    for run in ("x", "y", "x"):
        write_nested_stats(nested, path, run)
    assert sorted(r["seq_idx"] for r in flatten_stats(read_nested_stats(spark, path)).collect()) == [7, 7, 8, 8]
    for _ in range(2):
        stats_from_jsonl(spark, path, out)
    rows = read_stats(spark, out).collect()
    assert sorted(r["seq_idx"] for r in rows) == [7, 7, 8, 8] and {r["run"] for r in rows} == {"raw"}

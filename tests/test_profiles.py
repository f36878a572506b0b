import numpy as np
import pandas as pd
import pytest

from panelfx.operators.correlation import profile_correlation
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
from panelfx.sources.effects import read_effect_files, read_effects, variant_name, write_effects

EFFECT = "model_size string, cohort bigint, time bigint, ATT double, std_error double, lower double, upper double, zero_not_in_cband string"


def annotated(spark, rows, target="sup_seq", **kw):
    return annotate_effects(spark.createDataFrame(rows, EFFECT), target, **kw)


def test_sign_and_flags(spark):
    rows = [("70m", 1000, 2000, -0.2, 0.05, -0.3, -0.1, "*"), ("12b", 1000, 2000, 0.01, 0.05, -0.1, 0.2, "")]
    a, b = annotated(spark, rows).orderBy("size_rank").collect()
    assert (a["model_size"], a["size_rank"], b["model_size"], b["size_rank"]) == ("70M", 1, "12B", 6)
    assert [a[c] for c in ("memorisation", "lower", "upper", "stdlower", "stdupper")] == pytest.approx([0.2, 0.1, 0.3, 0.1, 0.3])
    assert a["zero_not_in_cf"] == "*" and b["zero_not_in_cf"] == ""
    legacy = {r["model_size"]: r for r in annotated(spark, rows, legacy_sign_flip=True).collect()}
    assert legacy["12B"]["zero_not_in_cf"] == "*" and legacy["70M"]["std_error"] == -0.05
    assert legacy["70M"]["lower"] == 0.3 and legacy["70M"]["upper"] == 0.1


def test_other_targets_keep_their_sign_and_sizes_are_listed(spark):
    rows = [("2.8b", 1, 2, 0.5, 0.1, 0.3, 0.7, "*"), ("33b", 1, 2, 0.5, 0.1, 0.3, 0.7, "*"), ("1.4b", 1, 2, 0.5, None, None, None, "")]
    got = annotated(spark, rows, "acc_seq").collect()
    assert {r["model_size"] for r in got} == {None, "1.4B"}
    assert all(r["memorisation"] == 0.5 for r in got)
    assert [r["zero_not_in_cf"] for r in got if r["model_size"] == "1.4B"] == [""]


def test_profiles(spark):
    def row(cohort, time, att, flag):
        return ("70m", cohort, time, -att, 0.1, -att - 0.2, -att + 0.2, flag)

    rows = [
        row(1000, 1000, 0.3, "*"),
        row(1000, 95_000, 0.2, ""),
        row(2000, 1000, 0.3, "*"),
        row(2000, 96_000, 0.3, "*"),
        row(96_000, 96_000, 0.3, "*"),
        row(3000, 95_000, 0.0, "*"),
        row(4000, 95_000, -0.1, "*"),
    ]
    a = annotated(spark, rows)
    cells = lambda df: {(r["cohort"], r["time"]) for r in df.collect()}
    full = {(1000, 1000), (2000, 96_000), (96_000, 96_000), (3000, 95_000), (4000, 95_000)}
    assert cells(profile_full(a)) == full
    assert cells(profile_restricted(a)) == {(1000, 1000), (3000, 95_000), (4000, 95_000)}
    assert cells(profile_instantaneous(a)) == {(1000, 1000)}
    final = {(r["cohort"], r["alpha"]) for r in profile_final(a).collect()}
    assert final == {(1000, 0.3), (3000, 1.0)}


def test_persistent(spark):
    rows = [("70m", p, 0, float(-v), 0.1, float(-v), float(-v), f) for p, v, f in [(-1, 1, "*"), (0, 1, "*"), (5, 1, ""), (95_000, 1, "*"), (96_000, 1, "*"), (7, -1, "*")]]
    events = annotated(spark, rows).withColumnRenamed("cohort", "relative_period")
    assert {r["relative_period"] for r in profile_persistent(events).collect()} == {0, 95_000}


def test_lr(spark):
    times = spark.createDataFrame([(143_000,), (5,)], "time bigint")
    steps = spark.createDataFrame([(0,), (1430,), (143_000,), (0,)], "time bigint")
    lr = {r["time"]: r["lr"] for r in lr_schedule(times, steps).collect()}
    assert lr == pytest.approx({0: 0.0001, 1430: 0.001, 143_000: 0.0001})


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(3)
    rows = []
    for c in range(12):
        for t in range(10):
            base = rng.normal()
            for size in ("70M", "160M", "410M"):
                if size == "410M" and (c + t) % 3 == 0:
                    continue
                noise = rng.normal()
                value = round(base + noise, 1)  # one digit, so that there are ties
                rows.append((size, c, t, value))
    return rows


@pytest.mark.parametrize("method", ["pearson", "spearman", "kendall"])
def test_correlations_match_pandas(spark, monkeypatch, table, method):
    monkeypatch.setattr("panelfx.operators.ordering.RANGE_ROWS", 50)
    order = ("70M", "160M", "410M")
    df = spark.createDataFrame(table, "model_size string, cohort bigint, time bigint, memorisation double")
    got = profile_correlation(df, method, order).collect()
    assert [(r["model_size"], r["other"]) for r in got] == [(a, b) for i, a in enumerate(order) for b in order[i:]]
    pdf = pd.DataFrame(table, columns=["s", "c", "t", "v"]).pivot(index=["c", "t"], columns="s", values="v")
    for r in got:
        a, b = r["model_size"], r["other"]
        pair = pdf[[a, b]].dropna() if a != b else pd.concat([pdf[a], pdf[a]], axis=1).dropna()
        x, y = pair.iloc[:, 0].to_numpy(), pair.iloc[:, 1].to_numpy()
        if method == "pearson":
            wanted = np.corrcoef(x, y)[0, 1]
        elif method == "spearman":
            wanted = np.corrcoef(pd.Series(x).rank(), pd.Series(y).rank())[0, 1]
        else:
            sx, sy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
            wanted = (sx * sy).sum() / np.sqrt((sx**2).sum() * (sy**2).sum())
        assert r["value"] == pytest.approx(wanted, abs=1e-9)


def test_pivot(spark, table):
    df = spark.createDataFrame(table, "model_size string, cohort bigint, time bigint, memorisation double")
    wide = profile_pivot(df, ("70M", "410M"))
    assert wide.columns == ["cohort", "time", "70M", "410M"] and wide.count() == 120
    assert wide.where("`410M` is null").count() == 40


def test_effect_store(spark, tmp_path):
    rows = [("70m", 1, 0.5, 0.1, 0.3, 0.7, "*"), ("12b", 2, 0.4, 0.1, 0.2, 0.6, "*")]
    df = spark.createDataFrame(rows, "model_size string, relative_period bigint, ATT double, std_error double, lower double, upper double, zero_not_in_cband string")
    root = str(tmp_path)
    write_effects(df, root, "cs", "sup_seq", "event", variant_name(bootstrap=True))
    write_effects(df, root, "cs", "acc_seq", "event", variant_name(True, True))
    got = read_effects(spark, root, "event", "sup_seq", "boot")
    assert {(r["model_size"], r["relative_period"], r["ATT"]) for r in got.collect()} == {("70m", 1, 0.5), ("12b", 2, 0.4)}
    assert "PartitionFilters: [isnotnull" in got._jdf.queryExecution().toString()


def test_files_named_after_their_content(spark, tmp_path):
    rows = [(1000, 2000, 0.5, 0.1, 0.3, 0.7, "*")]
    df = spark.createDataFrame(rows, EFFECT.removeprefix("model_size string, "))
    pdf = df.toPandas()
    for name in ("cs_70m-sup_seq-all_boot", "cs_1.4b-sup_seq-all_boot", "cs_1.4b-sup_seq-all", "cs_12b-acc_seq-all_boot", "cs_12b-sup_seq-event_boot"):
        pdf.to_parquet(tmp_path / f"{name}.parquet", index=False)
    got = read_effect_files(spark, str(tmp_path), "all", "sup_seq")
    assert {(r["model_size"], r["cohort"], r["ATT"]) for r in got.collect()} == {("70m", 1000, 0.5), ("1.4b", 1000, 0.5)}

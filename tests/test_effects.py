import numpy as np
import pytest
from conftest import GOLDEN, SPEC, panel_rows
from pyspark.sql import functions as F

from panelfx.operators.demean import demean_two_way, simple_diff
from panelfx.operators.effects import EffectOptions, aggregate_effects, att_gt, compute_effects
from panelfx.operators.panel import PanelSpec, unbalanced_units
from panelfx.operators.unitblocks import unit_mammen, unit_signs

SCHEMA = "u bigint, t int, g bigint, y double"
CELLS = {(2, 2): (2.0, 0.5), (2, 3): (2.0, 0.0), (3, 2): (0.0, 0.5), (3, 3): (3.0, 0.5)}


def frame(spark, units):
    return spark.createDataFrame(panel_rows(units), SCHEMA)


def by_cell(df):
    return {(r["cohort"], r["time"]): r for r in df.collect()}


def test_golden_cells(golden):
    rows = by_cell(compute_effects(golden, SPEC)["all"])
    assert rows.keys() == CELLS.keys()
    for cell, (att, se) in CELLS.items():
        assert rows[cell]["ATT"] == pytest.approx(att)
        assert rows[cell]["std_error"] == pytest.approx(se)
    assert {c: r["base_period"] for c, r in rows.items()} == {
        (2, 2): 1,
        (2, 3): 1,
        (3, 2): 1,
        (3, 3): 2,
    }
    assert rows[(3, 2)]["zero_not_in_cband"] == "" and rows[(3, 3)]["zero_not_in_cband"] == "*"


@pytest.mark.parametrize(
    ("view", "key", "wanted"),
    [
        ("cohort", "cohort", {2: 2.0, 3: 3.0}),
        ("time", "time", {2: 2.0, 3: 2.5}),
        ("event", "relative_period", {-1: 0.0, 0: 2.5, 1: 2.0}),
    ],
)
def test_golden_views(golden, view, key, wanted):
    points = aggregate_effects(att_gt(golden, SPEC), view)
    assert {r[key]: r["ATT"] for r in points.collect()} == pytest.approx(wanted)
    full = compute_effects(golden, SPEC, views=(view,))[view]
    assert {r[key]: r["ATT"] for r in full.collect()} == pytest.approx(wanted)


def numpy_cells(units, base="varying"):
    """Effect and influence values of every cell, straight from the definition."""
    ids = list(units)
    y = np.array([units[u][1] for u in ids])
    g = np.array([units[u][0] or 0 for u in ids])
    n, out = len(ids), {}
    for cohort in sorted(set(g) - {0}):
        for t in range(1, y.shape[1] + 1):
            b = t - 1 if (t < cohort and base == "varying") else cohort - 1
            if b < 1:
                continue
            d = y[:, t - 1] - y[:, b - 1]
            own, control = g == cohort, g == 0
            att = d[own].mean() - d[control].mean()
            psi = np.zeros(n)
            psi[own] = (d[own] - d[own].mean()) * n / own.sum()
            psi[control] = -(d[control] - d[control].mean()) * n / control.sum()
            out[(int(cohort), t)] = (att, psi)
    return out, g


def numpy_event(units):
    cells, g = numpy_cells(units)
    n, out = len(g), {}
    events = {t - c for c, t in cells}
    for e in events:
        used = [(c, t) for c, t in cells if t - c == e]
        share = np.array([(g == c).mean() for c, _ in used])
        att = np.array([cells[k][0] for k in used])
        w = share / share.sum()
        theta = w @ att
        psi = sum(wi * cells[k][1] for wi, k in zip(w, used))
        in_k = np.array([(g == c).astype(float) for c, _ in used]) - share[:, None]
        weight = (in_k / share.sum() - np.outer(share, in_k.sum(0)) / share.sum() ** 2).T @ att
        out[e] = (theta, np.sqrt(np.mean((psi + weight) ** 2) / n))
    return out


@pytest.mark.parametrize("base", ["varying", "universal"])
def test_against_numpy(spark, random_panel, base):
    wanted, g = numpy_cells(random_panel, base)
    options = EffectOptions(base_period=base)
    rows = by_cell(compute_effects(frame(spark, random_panel), SPEC, options, ("all",))["all"])
    assert rows.keys() == wanted.keys()
    for cell, (att, psi) in wanted.items():
        assert rows[cell]["ATT"] == pytest.approx(att, abs=1e-9)
        se = np.sqrt(np.mean(psi**2) / len(g))
        assert rows[cell]["std_error"] == pytest.approx(se, abs=1e-9)


def test_event_errors_include_weight_estimation(spark, random_panel):
    uneven = {u: v for u, v in random_panel.items() if not (v[0] == 5 and u % 8 == 1)}
    wanted = numpy_event(uneven)
    rows = compute_effects(frame(spark, uneven), SPEC, views=("event",))["event"].collect()
    assert {r["relative_period"] for r in rows} == wanted.keys()
    for r in rows:
        assert r["ATT"] == pytest.approx(wanted[r["relative_period"]][0], abs=1e-9)
        assert r["std_error"] == pytest.approx(wanted[r["relative_period"]][1], abs=1e-9)


def test_unit_and_time_effects_do_not_matter(golden):
    shifted = golden.withColumn("y", F.col("y") + 100 * F.col("u") + 7 * F.col("t") * F.col("t"))
    before, after = by_cell(att_gt(golden, SPEC)), by_cell(att_gt(shifted, SPEC))
    for cell in before:
        assert after[cell]["ATT"] == pytest.approx(before[cell]["ATT"])


def test_unbalanced_panel_raises_and_lists_units(spark, golden):
    holes = golden.where(~((F.col("u") == 2) & (F.col("t") == 3)))
    with pytest.raises(Exception, match="unbalanced panel at cohort 2"):
        att_gt(holes, SPEC).collect()
    assert [r["u"] for r in unbalanced_units(holes, SPEC).collect()] == [2]


def test_swapped_units_are_seen_as_unbalanced(golden):
    # sizes stay equal over time, the unit set does not
    odd = golden.where(~((F.col("u") == 1) & (F.col("t") == 2))).unionByName(
        golden.where((F.col("u") == 2) & (F.col("t") == 2))
    )
    with pytest.raises(Exception, match="unbalanced"):
        att_gt(odd, SPEC).collect()


def test_missing_outcomes_are_nan_or_null(spark, golden):
    holes = golden.withColumn(
        "y", F.when((F.col("u") == 2) & (F.col("t") == 3), F.lit(float("nan"))).otherwise(F.col("y"))
    )
    rows = by_cell(compute_effects(holes, SPEC, EffectOptions(balance="pairwise"), ("all",))["all"])
    # only unit 1 is left in cohort 2 at time 3: (4 - 1) - (1 + 1) / 2
    assert rows[(2, 3)]["ATT"] == pytest.approx(2.0)
    assert rows[(2, 2)]["ATT"] == pytest.approx(2.0)


def test_pairwise_equals_strict_on_balanced_panel(spark, random_panel):
    panel = frame(spark, random_panel)
    strict = compute_effects(panel, SPEC, EffectOptions())
    pairs = compute_effects(panel, SPEC, EffectOptions(balance="pairwise"))
    a, b = by_cell(strict["all"]), by_cell(pairs["all"])
    assert a.keys() == b.keys()
    for cell in a:
        assert a[cell]["ATT"] == pytest.approx(b[cell]["ATT"], abs=1e-9)
        assert a[cell]["std_error"] == pytest.approx(b[cell]["std_error"], abs=1e-9)
    for view, key in (("cohort", "cohort"), ("time", "time"), ("event", "relative_period")):
        left = {r[key]: r["ATT"] for r in strict[view].collect()}
        right = {r[key]: r["ATT"] for r in pairs[view].collect()}
        assert left == pytest.approx(right)


def test_cohorts_treated_at_the_first_time_are_left_out(spark):
    units = {**GOLDEN, 7: (1, [5, 6, 7]), 8: (1, [1, 2, 3])}
    assert by_cell(att_gt(frame(spark, units), SPEC)).keys() == CELLS.keys()


@pytest.mark.parametrize("multiplier", ["rademacher", "mammen"])
def test_bootstrap_errors_approach_analytic_ones(spark, random_panel, multiplier):
    panel = frame(spark, random_panel)
    analytic = compute_effects(panel, SPEC, EffectOptions())
    options = EffectOptions(
        se="bootstrap", boot_iterations=2000, multiplier=multiplier, band="pointwise"
    )
    boot = compute_effects(panel, SPEC, options)
    for view in ("all", "cohort", "time", "event"):
        keys = [c for c in ("cohort", "time", "relative_period") if c in boot[view].columns]
        a = {tuple(r[k] for k in keys): r for r in analytic[view].collect()}
        for r in boot[view].collect():
            wanted = a[tuple(r[k] for k in keys)]
            assert r["ATT"] == pytest.approx(wanted["ATT"], abs=1e-9)
            assert r["std_error"] == pytest.approx(wanted["std_error"], rel=0.15)


def test_bootstrap_equals_direct_sums_and_ignores_partitioning(spark, random_panel):
    options = EffectOptions(se="bootstrap", boot_iterations=40, seed=3)
    panel = frame(spark, random_panel)
    one = by_cell(compute_effects(panel.coalesce(1), SPEC, options, ("all",))["all"])
    many = by_cell(compute_effects(panel.repartition(13), SPEC, options, ("all",))["all"])
    cells, g = numpy_cells(random_panel)
    v = unit_signs([str(u) for u in random_panel], 3, 40)
    draws = {k: psi @ v / len(g) for k, (_, psi) in cells.items()}
    z = 1.3489795003921634
    se = {k: (np.quantile(d, 0.75) - np.quantile(d, 0.25)) / z for k, d in draws.items()}
    crit = np.quantile(np.max([np.abs(draws[k]) / se[k] for k in draws], axis=0), 0.95)
    for cell, row in one.items():
        assert row["std_error"] == pytest.approx(many[cell]["std_error"], abs=1e-12)
        assert row["std_error"] == pytest.approx(se[cell], abs=1e-9)
        assert row["upper"] - row["ATT"] == pytest.approx(crit * se[cell], abs=1e-9)


def test_multipliers_have_mean_zero_and_variance_one():
    ids = [str(i) for i in range(400)]
    for weights in (unit_signs(ids, 1, 300), unit_mammen(ids, 1, 300)):
        assert weights.shape == (400, 300)
        assert abs(weights.mean()) < 0.01 and abs(weights.var() - 1) < 0.02
        assert len({tuple(w) for w in weights}) == 400


def test_groups_are_separate(spark, random_panel):
    panel = frame(spark, random_panel)
    both = panel.withColumn("size", F.lit("a")).unionByName(
        panel.withColumn("size", F.lit("b")).withColumn("y", 3 * F.col("y"))
    )
    spec = PanelSpec("u", "t", "g", "y", by=("size",))
    alone = {v: df.collect() for v, df in compute_effects(panel, SPEC).items()}
    joint = compute_effects(both, spec)
    for view, rows in alone.items():
        keys = [c for c in ("cohort", "time", "relative_period") if c in joint[view].columns]
        got = {(r["size"], *[r[k] for k in keys]): r for r in joint[view].collect()}
        assert len(got) == 2 * len(rows)
        for r in rows:
            for size, factor in (("a", 1), ("b", 3)):
                twin = got[(size, *[r[k] for k in keys])]
                assert twin["ATT"] == pytest.approx(factor * r["ATT"], abs=1e-9)
                assert twin["std_error"] == pytest.approx(factor * r["std_error"], abs=1e-9)


def test_large_groups_are_salted(spark, random_panel, monkeypatch):
    import panelfx.operators.unitblocks as ub

    panel = frame(spark, random_panel)
    options = EffectOptions(se="bootstrap", boot_iterations=30)
    plain = by_cell(compute_effects(panel, SPEC, options, ("all",))["all"])
    monkeypatch.setattr(ub, "ROWS_PER_SALT", 20)
    salted = by_cell(compute_effects(panel, SPEC, options, ("all",))["all"])
    for cell in plain:
        assert salted[cell]["std_error"] == pytest.approx(plain[cell]["std_error"], abs=1e-9)


def test_duplicate_rows_raise(spark, golden):
    twice = golden.unionByName(golden)
    with pytest.raises(Exception, match="several rows for one unit and time"):
        compute_effects(twice, SPEC, views=("all",))["all"].collect()


def test_unknown_options_and_columns():
    with pytest.raises(ValueError, match="base_period"):
        EffectOptions(base_period="first")


def test_missing_column(golden):
    with pytest.raises(ValueError, match="nope"):
        att_gt(golden, PanelSpec("u", "t", "g", "nope"))


# --- demeaning -----------------------------------------------------------------------------------


def test_golden_simple_diff(golden):
    rows = {(r["t"], r["cohort_val"]): r for r in simple_diff(golden, SPEC).collect()}
    att = {(1, 2): 4 / 3, (1, 3): 1.0, (2, 2): -2 / 3, (2, 3): 1.0, (3, 2): -2 / 3, (3, 3): -2.0}
    assert {k: r["ATT"] for k, r in rows.items()} == pytest.approx(att)
    assert rows[(1, 2)]["mean"] == pytest.approx(0.777778, abs=1e-6)
    assert rows[(3, 3)]["mean_val"] == pytest.approx(1.111111, abs=1e-6)
    assert rows[(2, 2)]["std"] == pytest.approx(0.471405, abs=1e-6)
    assert rows[(2, 3)]["std_val"] == pytest.approx(0.0, abs=1e-9)
    assert all(r["size"] == r["size_val"] == 2 and r["cohort"] == 200_000_000 for r in rows.values())


def test_simple_diff_moves_opposite_to_effects(golden):
    simple = {(r["cohort_val"], r["t"]): r["ATT"] for r in simple_diff(golden, SPEC).collect()}
    for r in att_gt(golden, SPEC).collect():
        moved = simple[(r["cohort"], r["time"])] - simple[(r["cohort"], r["base_period"])]
        assert moved == pytest.approx(-r["ATT"])


def test_demeaned_sums_vanish(spark, random_panel):
    demeaned = demean_two_way(frame(spark, random_panel), SPEC)
    for key in ("u", "t"):
        sums = demeaned.groupBy(key).agg(F.sum("y").alias("s")).collect()
        assert max(abs(r["s"]) for r in sums) < 1e-9


def test_demeaning_of_groups_with_holes(spark, random_panel):
    rows = [(*r, "ab"[r[0] % 2]) for r in panel_rows(random_panel) if (r[0] * r[1]) % 7]
    panel = spark.createDataFrame(rows, SCHEMA + ", size string")
    got = {(r["u"], r["t"]): r["y"] for r in demean_two_way(panel, PanelSpec("u", "t", "g", "y", by=("size",))).collect()}
    assert len(got) == len(rows)
    for size in "ab":
        u, t, y = (np.array([r[k] for r in rows if r[4] == size]) for k in (0, 1, 3))
        mean_of = lambda key, y=y: (np.bincount(key, y) / np.maximum(np.bincount(key), 1))[key]
        residual = y - mean_of(t) - mean_of(u) + y.mean()
        assert np.allclose([got[k] for k in zip(u.tolist(), t.tolist(), strict=True)], residual)


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_demeaning_does_not_depend_on_the_kind_of_join(spark, random_panel, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = {(r["u"], r["t"]): r["y"] for r in demean_two_way(frame(spark, random_panel), SPEC).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    y = np.array([v[1] for v in random_panel.values()])
    residual = y - y.mean(axis=0) - y.mean(axis=1, keepdims=True) + y.mean()
    for i, u in enumerate(random_panel):
        assert [got[u, t + 1] for t in range(y.shape[1])] == pytest.approx(residual[i].tolist())


def test_doubled_rows_are_no_balanced_panel(golden):
    with pytest.raises(Exception, match="unbalanced panel"):
        att_gt(golden.unionByName(golden), SPEC).collect()
    assert unbalanced_units(golden.unionByName(golden), SPEC).count() == len(GOLDEN)


def test_nan_outcomes_are_listed(spark, golden):
    holes = golden.withColumn("y", F.when((F.col("u") == 2) & (F.col("t") == 2), float("nan")).otherwise(F.col("y")))
    assert [r["u"] for r in unbalanced_units(holes, SPEC).collect()] == [2]


# --- panels with gaps ----------------------------------------------------------------------------


@pytest.mark.parametrize("small", [False, True])
def test_parts_of_contrasts_give_the_same_errors(spark, random_panel, monkeypatch, small):
    """Contrasts in many parts, chunks and segments, and pairs in many parts, against the definition."""
    if small:
        for name, value in (("PART_ENTRIES", 9), ("ENTRIES_TOGETHER", 4), ("SEGMENT", 3), ("PART_NUMBERS", 150)):
            monkeypatch.setattr(f"panelfx.operators.unitblocks.{name}", value)
    panel = frame(spark, random_panel)
    wanted, g = numpy_cells(random_panel)
    rows = by_cell(compute_effects(panel, SPEC, views=("all", "event"))["all"])
    for cell, (att, psi) in wanted.items():
        assert rows[cell]["ATT"] == pytest.approx(att, abs=1e-9)
        assert rows[cell]["std_error"] == pytest.approx(np.sqrt(np.mean(psi**2) / len(g)), abs=1e-9)
    options = EffectOptions(se="bootstrap", boot_iterations=30, balance="pairwise")
    gaps = by_cell(compute_effects(panel, SPEC, options, ("all",))["all"])
    strict = by_cell(compute_effects(panel, SPEC, EffectOptions(se="bootstrap", boot_iterations=30), ("all",))["all"])
    for cell, row in strict.items():
        for measure in ("ATT", "std_error", "lower", "upper"):
            assert gaps[cell][measure] == pytest.approx(row[measure], abs=1e-9)


def gap_influence(rows, view):
    """Estimate and influence of every unit for each key of a view, unit by unit from the definition."""
    y, cohort = {}, {}
    for u, t, g, v in rows:
        cohort[u] = g
        y[u, t] = v
    times = sorted({t for _, t in y})
    units = sorted(cohort)
    cells = {}
    for g in sorted({c for c in cohort.values() if c is not None}):
        for t in times:
            before = [s for s in times if s < min(t, g)]
            if not before:
                continue
            base = before[-1]
            sides = []
            for group in (g, None):
                seen = {u: y[u, t] - y[u, base] for u in units if cohort[u] == group and (u, t) in y and (u, base) in y}
                sides.append(seen)
            if all(sides):
                own, control = (np.mean(list(s.values())) for s in sides)
                psi = {u: (d - own) / len(sides[0]) for u, d in sides[0].items()}
                psi.update({u: -(d - control) / len(sides[1]) for u, d in sides[1].items()})
                cells[g, t] = (own - control, psi)
    size = {g: sum(c == g for c in cohort.values()) for g in set(cohort.values())}
    key = {"cohort": lambda g, t: g, "time": lambda g, t: t, "event": lambda g, t: t - g}[view]
    out = {}
    for k in {key(g, t) for g, t in cells if view == "event" or t >= g}:
        used = [(g, t) for g, t in cells if key(g, t) == k and (view == "event" or t >= g)]
        n = np.array([1 if view == "cohort" else size[g] for g, _ in used], float)
        att = np.array([cells[c][0] for c in used])
        theta = n @ att / n.sum()
        influence = dict.fromkeys(units, 0.0)
        for (g, t), share, a in zip(used, n / n.sum(), att, strict=True):
            for u, e in cells[g, t][1].items():
                influence[u] += share * e
            if view != "cohort":
                for u in units:
                    influence[u] += (a - theta) / n.sum() if cohort[u] == g else 0.0
        out[k] = (theta, influence)
    return out


@pytest.fixture(scope="module")
def gap_rows(random_panel):
    return [r for r in panel_rows(random_panel) if (r[0] * 7 + r[1] * 3) % 5 and not (r[0] % 9 == 0 and r[1] > 6)]


@pytest.mark.parametrize(("view", "name"), [("cohort", "cohort"), ("time", "time"), ("event", "relative_period")])
def test_views_of_a_panel_with_gaps(spark, gap_rows, view, name):
    panel = spark.createDataFrame(gap_rows, SCHEMA)
    wanted = gap_influence(gap_rows, view)
    rows = compute_effects(panel, SPEC, EffectOptions(balance="pairwise"), (view,))[view].collect()
    assert {r[name] for r in rows} == wanted.keys()
    for r in rows:
        theta, influence = wanted[r[name]]
        assert r["ATT"] == pytest.approx(theta, abs=1e-9)
        error = np.sqrt(sum(i * i for i in influence.values()))
        assert r["std_error"] == pytest.approx(error, abs=1e-9)
        assert r["zero_not_in_cband"] == ("*" if abs(theta) > 1.959963984540054 * error else "")


def test_bootstrap_of_a_panel_with_gaps(spark, gap_rows):
    panel = spark.createDataFrame(gap_rows, SCHEMA)
    options = EffectOptions(se="bootstrap", boot_iterations=60, seed=5, balance="pairwise", band="pointwise")
    rows = compute_effects(panel, SPEC, options, ("event",))["event"].collect()
    wanted = gap_influence(gap_rows, "event")
    for r in rows:
        theta, influence = wanted[r["relative_period"]]
        v = unit_signs([str(u) for u in influence], 5, 60)
        draws = np.array(list(influence.values())) @ v
        error = (np.quantile(draws, 0.75) - np.quantile(draws, 0.25)) / 1.3489795003921634
        assert r["ATT"] == pytest.approx(theta, abs=1e-9) and r["std_error"] == pytest.approx(error, abs=1e-9)


def test_pairwise_errors_equal_strict_ones_on_a_balanced_panel(spark, random_panel):
    panel = frame(spark, random_panel)
    strict = compute_effects(panel, SPEC)
    pairs = compute_effects(panel, SPEC, EffectOptions(balance="pairwise"))
    for view, key in (("cohort", "cohort"), ("time", "time"), ("event", "relative_period")):
        left = {r[key]: r["std_error"] for r in strict[view].collect()}
        assert left == pytest.approx({r[key]: r["std_error"] for r in pairs[view].collect()})


@pytest.mark.parametrize("which", ["unit", "row", "panel"])
@pytest.mark.parametrize("balance", ["strict", "pairwise"])
def test_any_repeated_row_raises(golden, which, balance):
    again = {"unit": golden.where("u = 1"), "row": golden.where("u = 3 AND t = 2"), "panel": golden.unionByName(golden)}[which]
    with pytest.raises(Exception, match="several rows for one unit and time"):
        att_gt(golden.unionByName(again), SPEC, EffectOptions(se="none", balance=balance)).collect()


def test_a_unit_with_several_cohorts_raises(spark, golden):
    for other in ("3L", "CAST(NULL AS bigint)"):
        moved = golden.withColumn("g", F.when((F.col("u") == 1) & (F.col("t") == 2), F.expr(other)).otherwise(F.col("g")))
        with pytest.raises(Exception, match="several cohorts for unit 1"):
            att_gt(moved, SPEC).collect()


def test_no_draw_is_exploded(spark, random_panel):
    from panelfx.operators.effects import _boot_band

    draws = spark.createDataFrame([(k, [0.1 * k, -0.3, 0.2], 0.0) for k in range(5)], "cohort int, draws array<double>, ATT double")
    plan = _boot_band(draws, SPEC, EffectOptions(se="bootstrap", boot_iterations=3))._jdf.queryExecution().toString()
    assert "Generate" not in plan and "posexplode" not in plan


def test_many_cohorts_need_no_pass_per_part_of_contrasts(spark, monkeypatch):
    """Cohorts that grow with the units: errors without gaps come from one matrix a cohort, as the definition has them."""
    rng = np.random.default_rng(3)
    units = {u: ([None, *range(4, 84, 4)][u % 21], [float(y) for y in rng.normal(size=7)]) for u in range(126)}
    wanted = compute_effects(frame(spark, units), SPEC, EffectOptions(balance="pairwise"))
    wanted = {view: {tuple(r)[: len(r) - 5]: r["std_error"] for r in df.collect()} for view, df in wanted.items()}

    def no_parts(*_args):
        raise AssertionError("contrasts were cut into parts, each of them a pass over all units")

    monkeypatch.setattr("panelfx.operators.unitblocks._contrast_parts", no_parts)
    for view, df in compute_effects(frame(spark, units), SPEC).items():
        found = {tuple(r)[: len(r) - 5]: r["std_error"] for r in df.collect()}
        assert found.keys() == wanted[view].keys()
        for cell, error in found.items():
            assert error == pytest.approx(wanted[view][cell], abs=1e-9)

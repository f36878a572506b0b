import math
from collections import Counter

import pytest

from panelfx.llm.mixing import MixOptions, choose_exponent, entropy, mix, planned_copies, tempered

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, copies string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "mine") for i, s, t in rows], SCHEMA)


def corpus():
    rows = [(k, "big", " ".join(["w"] * (1 + k % 17))) for k in range(600)]
    rows += [(1000 + k, "small", "a b c d") for k in range(20)] + [(2000 + k, None, "x y") for k in range(10)]
    return rows + [(3000, "empty", ""), (3001, "empty", None), (3002, "big", "   ")]


def test_exponent_meets_the_entropy():
    tokens = [900, 80, 15, 5, 0]
    e = choose_exponent(tokens, MixOptions(entropy=0.8, repeats=None))
    weights = tempered([t / 1000 for t in tokens], e)
    assert entropy(weights) == pytest.approx(0.8 * math.log(4), abs=1e-9) and weights[4] == 0
    assert choose_exponent([10, 10], MixOptions(entropy=0.99)) == 1.0
    assert choose_exponent([], MixOptions()) == choose_exponent([0, 7], MixOptions()) == 1.0


def test_exponent_meets_the_repetition_limit():
    tokens = [900, 80, 15, 5]
    for options in (MixOptions(entropy=None, repeats=3.0), MixOptions(entropy=1.0, repeats=3.0)):
        weights = tempered([t / 1000 for t in tokens], choose_exponent(tokens, options))
        assert max(w * 1000 / t for w, t in zip(weights, tokens, strict=True)) == pytest.approx(3.0, abs=1e-6)


@pytest.mark.parametrize("options", [MixOptions(), MixOptions(budget=20_000, block_tokens=64), MixOptions(budget=100, block_tokens=16), MixOptions(budget=0)])
def test_budgets_are_met_by_whole_epochs_and_one_part(spark, options):
    rows = corpus()
    plan = planned_copies(docs(spark, rows), options).collect()
    assert len(plan) == len(rows)
    total = sum(len((t or "").split()) for _, _, t in rows)
    budget = total if options.budget is None else options.budget
    assert sum({r.source: r.budget for r in plan}.values()) == pytest.approx(budget, abs=3)
    for source in {r.source for r in plan}:
        own = [r for r in plan if r.source == source]
        used = sum(r.copies * r.n_tokens for r in own)
        most = max(r.n_tokens for r in own)
        assert own[0].source_tokens == sum(r.n_tokens for r in own)
        assert 0 <= used - own[0].budget < max(most, 1)
        copies = {r.copies for r in own if r.n_tokens}
        assert not copies or max(copies) - min(copies) <= 1


def test_mix_repeats_rows_as_planned(spark):
    rows = corpus() + [(5, "big", "same same"), (5, "big", "same same"), (None, "big", "z"), (None, "big", "z")]
    table = docs(spark, rows)
    options = MixOptions(budget=4_000, block_tokens=64)
    planned = Counter()
    for r in planned_copies(table, options).collect():
        planned[r.doc_id, r.source, r.n_tokens] += r.copies
    mixed = mix(table, options)
    assert mixed.columns == table.columns and mixed.schema == table.schema
    got = Counter((r.doc_id, r.source, len((r.text or "").split())) for r in mixed.collect())
    assert got == +planned
    assert mix(table, options).count() == mixed.count()


def test_empty_table(spark):
    assert planned_copies(docs(spark, [])).count() == 0 and mix(docs(spark, [])).count() == 0


def plain_plan(spark, rows, options):
    """Copies of every row, by a loop over blocks and documents; hashes are Spark's."""
    from pyspark.sql import functions as F

    table = docs(spark, rows)
    order = F.xxhash64(F.lit(options.seed), F.xxhash64("doc_id", "text"))
    keyed = table.select("doc_id", "source", "text", order.alias("o"), F.xxhash64(order).alias("b")).collect()
    sources = {}
    for r in keyed:
        sources.setdefault(r.source or "(none)", []).append((r.doc_id, len((r.text or "").split()), r.o, r.b))
    names = sorted(sources)
    tokens = [sum(d[1] for d in sources[s]) for s in names]
    weights = tempered([t / sum(tokens) for t in tokens], choose_exponent(tokens, options))
    out = {}
    for name, own, weight in zip(names, tokens, weights, strict=True):
        wanted = round(weight * (sum(tokens) if options.budget is None else options.budget))
        epochs, rest = divmod(wanted, own) if own else (0, 0)
        many = max(-(-own // options.block_tokens), 1)
        blocks = {}
        for d in sources[name]:
            blocks.setdefault(d[3] % many, []).append(d)
        turns = spark.createDataFrame([(name, b) for b in blocks], "s string, b bigint")
        turn = {r.b: r.t for r in turns.select("b", F.xxhash64(F.lit(options.seed + 1), "s", "b").alias("t")).collect()}
        left = rest
        for b in sorted(blocks, key=lambda b: (turn[b], b)):
            size = sum(d[1] for d in blocks[b])
            for d in sorted(blocks[b], key=lambda d: (d[2], d[1])):
                more = rest > 0 and left >= size
                if not more and left > 0:
                    before = sum(e[1] for e in blocks[b] if (e[2], e[1]) < (d[2], d[1]))
                    more = before < left
                out[d[0], d[2]] = epochs + more
            left -= size
    return out


@pytest.mark.parametrize("options", [MixOptions(block_tokens=64), MixOptions(budget=9_000, block_tokens=200), MixOptions(entropy=0.2, block_tokens=16)])
def test_plan_is_that_of_a_plain_loop(spark, options):
    rows = corpus()
    found = {(r.doc_id, r._order): r.copies for r in planned_copies(docs(spark, rows), options).collect()}
    assert found == plain_plan(spark, rows, options)


def test_targets_on_either_side_bind():
    """Half way to equal weights, and entropies below the sources' own, are met exactly."""
    tokens = [900, 80, 15, 5]
    own, most = entropy([t / 1000 for t in tokens]), math.log(4)
    for options, wanted in (
        (MixOptions(repeats=None), (own + most) / 2), (MixOptions(toward=0.9, repeats=None), own + 0.9 * (most - own)),
        (MixOptions(toward=-0.1, repeats=None), own - 0.1 * (most - own)), (MixOptions(entropy=0.1, repeats=None), 0.1 * most),
    ):
        e = choose_exponent(tokens, options)
        assert entropy(tempered([t / 1000 for t in tokens], e)) == pytest.approx(wanted, abs=1e-9)
        assert (e < 1) == (wanted > own)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_copies_differ_on_the_given_tables(spark, folder):
    plan = planned_copies(spark.read.parquet(f"/root/testdata/{folder}/documents.parquet")).collect()
    by_source = {}
    for r in plan:
        by_source.setdefault(r.source, [set(), r.source_tokens, r.budget, 0])[0].add(r.copies)
        by_source[r.source][3] += r.copies * r.n_tokens
    assert len({r.copies for r in plan}) > 1
    shares = [v[1] for v in by_source.values()]
    own = entropy([t / sum(shares) for t in shares])
    mixed = [v[3] for v in by_source.values()]
    assert entropy([t / sum(mixed) for t in mixed]) > own


def test_clashing_names_stay(spark):
    table = docs(spark, corpus()).selectExpr("*", "1 AS _order", "2 AS _copies", "3 AS order_key", "4 AS copy", "5 AS _rows", "6 AS _named")
    mixed = mix(table, MixOptions(budget=2_000, block_tokens=64))
    assert mixed.columns == table.columns
    assert {tuple(r)[-6:] for r in mixed.collect()} == {(1, 2, 3, 4, 5, 6)}

"""Whole and right results where one unit, word or document holds a third of everything."""

import numpy as np
from conftest import SPEC
from pyspark.sql import functions as F

from panelfx.operators.corpus import pack_sequences, tokenize, vocabulary
from panelfx.operators.demean import demean_two_way, simple_diff
from panelfx.session import freeze


def test_hot_unit(spark):
    unit = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).cast("bigint")
    rows = spark.range(30_000).select(
        unit.alias("u"),
        (F.col("id") % 40).alias("t"),
        F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("y"),
    )
    panel = freeze(rows.withColumn("g", F.when(F.col("u") % 4 > 0, (F.col("u") % 4) * 10)))
    u, t, g, y = (panel.toPandas()[c].to_numpy() for c in "utgy")
    _, u = np.unique(u, return_inverse=True)
    mean_of = lambda key: (np.bincount(key, y) / np.bincount(key))[key]
    residual = y - mean_of(t) - mean_of(u) + y.mean()
    got = simple_diff(panel, SPEC).collect()
    controls = set(t[np.isnan(g)].tolist())
    present = {(a, b) for a, b in zip(t[~np.isnan(g)].tolist(), g[~np.isnan(g)].tolist(), strict=True) if a in controls}
    assert {(r.t, r.cohort_val) for r in got} == present
    for r in got:
        for members, suffix in ((np.isnan(g), ""), (g == r.cohort_val, "_val")):
            cell = residual[members & (t == r.t)]
            assert r[f"size{suffix}"] == len(cell)
            assert np.isclose(r[f"mean{suffix}"], cell.mean()) and np.isclose(r[f"std{suffix}"], cell.std(ddof=1))
    total = demean_two_way(panel, SPEC).agg(F.sum(F.abs("y"))).first()[0]
    assert np.isclose(total, np.abs(residual).sum())


def test_hot_word_and_hot_document(spark, monkeypatch):
    monkeypatch.setattr("panelfx.operators.corpus.HEAD_WORDS", 20)
    length = F.when(F.col("id") == 5, 15_000).otherwise(300)
    word = lambda x: F.when(x % 3 == 0, "the").otherwise(
        F.concat(F.lit("w"), F.pmod(F.xxhash64(x, F.col("id")), F.lit(500)).cast("string"))
    )
    texts = F.array_join(F.transform(F.sequence(F.lit(1), length), word), " ")
    docs = freeze(spark.range(100).select(F.col("id").alias("doc_id"), texts.alias("text")))
    vocab = freeze(vocabulary(docs))
    ids = {r["token"]: r["token_id"] for r in vocab.collect()}
    assert sorted(ids.values()) == list(range(len(ids))) and ids["the"] == 0
    wanted = {r["doc_id"]: [ids[w] for w in r["text"].split()] for r in docs.collect()}
    tokens = tokenize(docs, vocab)
    assert {r["doc_id"]: list(r["input_ids"]) for r in tokens.collect()} == wanted
    stream = [t for k in sorted(wanted) for t in wanted[k]]
    rows = {r["seq_idx"]: r["input_ids"] for r in pack_sequences(tokens, 512).collect()}
    assert len(rows) == len(stream) // 512
    assert [t for k in sorted(rows, reverse=True) for t in rows[k]] == stream[: len(rows) * 512]

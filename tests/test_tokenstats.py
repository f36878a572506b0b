import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelfx.operators.tokenstats import (
    nest_batches,
    score_sequences,
    sequence_statistics,
    sequence_surprisal,
    token_statistics,
)
from panelfx.operators.panel import flatten_stats
from panelfx.schemas import SEQUENCES

SCHEMA = "seq_idx bigint, pos int, target int, logits array<float>"


@pytest.mark.parametrize("method", ["native", "arrow"])
def test_golden(spark, method):
    scored = spark.createDataFrame([(1, 0, 2, [1.0, 2.0, 3.0]), (1, 1, 0, [1.0, 2.0, 3.0])], SCHEMA)
    rows = {r["pos"]: r for r in token_statistics(scored, method=method).collect()}
    assert rows[0]["sup"] == pytest.approx(0.407606, abs=1e-6) and rows[0]["rank"] == 0
    assert rows[1]["sup"] == pytest.approx(2.407606, abs=1e-6) and rows[1]["rank"] == 2
    assert rows[0]["entropy"] == rows[1]["entropy"] == pytest.approx(0.832396, abs=1e-6)


@pytest.mark.parametrize("method", ["native", "arrow"])
def test_extremes(spark, method):
    inf = float("inf")
    scored = spark.createDataFrame(
        [(1, 0, 0, [0.0, 0.0]), (1, 1, 1, [-inf, 5.0]), (1, 2, 0, [1000.0, -1000.0, 999.0])], SCHEMA
    )
    rows = {r["pos"]: r for r in token_statistics(scored, method=method).collect()}
    assert rows[0]["rank"] == 0 and rows[0]["entropy"] == pytest.approx(math.log(2))  # a tie is not above
    assert rows[1]["sup"] == 0.0 and rows[1]["entropy"] == 0.0
    assert rows[2]["sup"] == pytest.approx(0.3132617, abs=1e-6)


def test_methods_agree_and_stay_in_range(spark):
    rng = np.random.default_rng(1)
    rows = [(i // 10, i % 10, int(rng.integers(50)), [float(x) for x in rng.normal(size=50) * 3]) for i in range(200)]
    scored = spark.createDataFrame(rows, SCHEMA)
    native = token_statistics(scored, method="native").toPandas().sort_values(["seq_idx", "pos"])
    arrow = token_statistics(scored, method="arrow").toPandas().sort_values(["seq_idx", "pos"])
    for c in ("sup", "rank", "entropy"):
        assert np.allclose(native[c], arrow[c])
    assert native["entropy"].between(0, math.log(50)).all() and native["rank"].between(0, 49).all()


def test_sequences_and_batches_round_trip(spark):
    rows = [(s, p, 0, [float(s), float(p)]) for s in range(9) for p in range(3)]
    tokens = token_statistics(spark.createDataFrame(rows, SCHEMA))
    stats = sequence_statistics(tokens)
    flat = flatten_stats(nest_batches(stats, 4).drop("batch"))
    wanted = {r["seq_idx"]: (r["sup"], r["rank"], r["entropy"]) for r in stats.collect()}
    got = {r["seq_idx"]: (r["sup"], r["rank"], r["entropy"]) for r in flat.collect()}
    assert got == wanted and len(got) == 9
    means = {r["seq_idx"]: r["sup_seq"] for r in sequence_surprisal(tokens).collect()}
    assert means == pytest.approx({k: np.mean(v[0]) for k, v in wanted.items()})


def test_scorer(spark):
    def scorer(batches):
        for batch in batches:
            n = batch.column("input_ids").value_lengths()
            lists = lambda t: pa.array([[0] * v for v in n.to_pylist()], type=pa.list_(t))
            yield pa.RecordBatch.from_arrays(
                [batch.column("seq_idx"), lists(pa.float64()), lists(pa.int32()), lists(pa.float64())],
                names=["seq_idx", "sup", "rank", "entropy"],
            )

    rows = spark.createDataFrame([(1, [5, 6]), (2, [7])], SEQUENCES)
    scored = score_sequences(rows, scorer)
    assert {r["seq_idx"]: r["n"] for r in scored.select("seq_idx", F.size("sup").alias("n")).collect()} == {1: 2, 2: 1}


@pytest.mark.parametrize("method", ["native", "arrow"])
def test_missing_targets_and_logits(spark, method):
    rows = [(1, 0, 1, [0.0, 1.0]), (1, 1, None, [0.0, 1.0]), (1, 2, 0, []), (1, 3, 0, None), (1, 4, 0, [2.0])]
    got = {r.pos: (r.sup, r.rank, r.entropy) for r in token_statistics(spark.createDataFrame(rows, SCHEMA), method=method).collect()}
    assert got[1] == got[2] == got[3] == (None, None, None)
    assert got[0][1] == 0 and got[0][0] == pytest.approx(0.3132617) and got[4] == (0.0, 0, 0.0)
    none = token_statistics(spark.createDataFrame(rows[1:4], SCHEMA), method=method).collect()
    assert all(r.sup is r.rank is r.entropy is None for r in none)


@pytest.mark.parametrize("method", ["native", "arrow"])
@pytest.mark.parametrize("target", [-1, -100, 2])
def test_targets_outside_the_vocabulary(spark, method, target):
    rows = [(1, 0, 1, [0.0, 1.0]), (1, 1, target, [0.0, 1.0]), (1, 2, 0, [0.0, 1.0])]
    with pytest.raises(Exception, match="outside the vocabulary"):
        token_statistics(spark.createDataFrame(rows, SCHEMA), method=method).collect()

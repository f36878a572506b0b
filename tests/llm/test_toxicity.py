import os
import zlib

import numpy as np
import pytest

from panelfx.llm.queries import toxicity
from panelfx.llm.toxicity import FtrlOptions, features, toxicity_scores

SF_DIR = "/root/testdata/sf0.1"


def test_features_stay_within_texts():
    import pyarrow as pa

    at, owner = features(pa.array(["A b. c", "", None, "b", "x y"]), 20)
    assert np.bincount(owner, minlength=5).tolist() == [6, 0, 0, 1, 3]
    alone = features(pa.array(["x y"]), 20)[0]
    assert sorted(alone.tolist()) == sorted(at[owner == 4].tolist())


def test_learns_planted_words(spark):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(600):
        toxic = k % 5 == 0
        text = [*rng.choice(words, 40), *(["vile", "Scum!"] if toxic else [])]
        rng.shuffle(text)
        rows.append((k, " ".join(text), "keep", 3))
        if k < 400:
            labels.append((k, int(toxic)))
    rows += [(None, None, "keep", 3), (1000, "", "keep", 3), (3, rows[3][1], "keep", 3), (1001, "vile scum " * 20_000, "keep", 3)]
    labels += [(None, 1), (7, None), (0, 0), (9999, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string, index int")
    table = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    scored = toxicity_scores(docs, table)
    got = {(r.doc_id, r.text is None): r.score for r in scored.collect()}
    assert scored.columns == ["doc_id", "text", "index", "score"] and scored.count() == len(rows)
    assert all((got[k, False] >= 0.3) == (k % 5 == 0) for k in range(400, 600))
    assert got[1001, False] > 0.9 and got[None, True] == got[1000, False] < 0.5
    assert toxicity_scores(docs.limit(0), table).count() == 0
    blank = toxicity_scores(docs, table.limit(0)).select("score").distinct().collect()
    assert [r.score for r in blank] == [0.5]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in toxicity(spark, SF_DIR).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    held = [(rows[i].score, y, rows[i].predicted) for i, y in labels.items() if i in rows and rows[i].held_out]
    good, bad = [s for s, y, _ in held if y == 0], [s for s, y, _ in held if y == 1]
    assert np.mean([[g < b for g in good] for b in bad]) > 0.95
    assert sum(p for _, y, p in held if y == 0) < 0.02 * len(good)


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k, f"a{k} b") for k in range(50)], "doc_id bigint, text string")
    table = spark.createDataFrame([(k, k % 2) for k in range(50)], "doc_id bigint, toxic int")
    from panelfx.llm.toxicity import labelled_sample

    assert labelled_sample(docs, table, "toxic", FtrlOptions(max_train_docs=20)).count() == 20


def plain_ftrl(texts, labels, orders, options):
    """FTRL-proximal as published, coordinate by coordinate, over dictionaries."""
    import math

    import pyarrow as pa

    z, n = {}, {}
    bias = 1 << options.bits

    def weight(i):
        l1 = 0.0 if i == bias else options.l1
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        sign = -1.0 if z[i] < 0 else 1.0
        return -(z[i] - sign * l1) / ((options.beta + math.sqrt(n.get(i, 0.0))) / options.alpha + options.l2)

    for order in orders:
        for k in order:
            at = sorted(set(features(pa.array([texts[k]]), options.bits)[0].tolist())) + [bias]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values()))))) - labels[k]
            for i in at:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / options.alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z if weight(i)}


def test_weights_are_those_of_plain_ftrl(spark):
    from pyspark.sql import functions as F

    from panelfx.llm.toxicity import labelled_sample, train

    rng = np.random.default_rng(7)
    words = [f"w{k}" for k in range(60)]
    texts = {k: " ".join([*rng.choice(words, 25), *(["vile"] if k % 4 == 0 else [])]) for k in range(150)}
    labels = {k: float(k % 4 == 0) for k in texts}
    options = FtrlOptions(bits=12, rounds=3)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    table = spark.createDataFrame(list(labels.items()), "doc_id bigint, toxic double")
    sample = labelled_sample(docs, table, "toxic", options)
    assert sample.count() == len(texts)
    # the hashed order of each round
    place = {t: k for k, t in texts.items()}
    keyed = sample.select("text", *[F.xxhash64(F.lit(t), "_key").alias(f"o{t}") for t in range(options.rounds)]).collect()
    orders = [[place[r.text] for r in sorted(keyed, key=lambda r, t=t: r[f"o{t}"])] for t in range(options.rounds)]
    wanted = plain_ftrl(texts, labels, orders, options)
    found = train(sample, options)
    got = {**dict(zip(found.index.tolist(), found.value.tolist(), strict=True)), 1 << options.bits: found.bias}
    assert got.keys() == wanted.keys() and all(abs(got[i] - wanted[i]) < 1e-9 for i in got)


def test_the_sample_is_bounded_in_rows(spark):
    from pyspark.sql import functions as F

    from panelfx.llm.toxicity import labelled_sample

    options = FtrlOptions(max_train_docs=50)
    # one id holds a third of all rows, with many texts; others are repeated as they are
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 40 + 100).alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("text "), F.col("id").cast("string"))).otherwise(F.lit("same")).alias("text"),
    )
    labels = spark.createDataFrame([(k, k % 2) for k in [7, *range(100, 140)]], "doc_id bigint, toxic int")
    sample = labelled_sample(rows, labels, "toxic", options)
    assert sample.count() == 50
    few = labelled_sample(rows.where("doc_id <> 7"), labels, "toxic", options)
    assert few.count() == 40

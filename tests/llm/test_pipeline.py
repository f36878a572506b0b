import base64
import hashlib
import importlib
import math
import os

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from panelfx.llm.jaccard_join import JaccardOptions
from panelfx.llm.mixing import MixOptions
from panelfx.llm.queries import llm_oracles, llm_queries
from panelfx.llm.toxicity import FtrlOptions, features

SF_DIR = "/root/testdata/sf0.001"


def test_queries_are_named_by_operator():
    names = list(llm_queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert llm_oracles().keys() <= llm_queries().keys()
    entry = importlib.import_module("__spark_entry__")
    assert entry.queries()["pipeline"] is corpus_pipeline.run and set(names) <= entry.queries().keys()


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_url_filter_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF_DIR}/pages.parquet'")
    mine = llm_queries()["op1_url_filter"](spark, SF_DIR)
    theirs = con.execute(llm_oracles()["op1_url_filter"])
    columns = [d[0] for d in theirs.description]
    assert sorted(map(tuple, mine.select(columns).collect()), key=repr) == sorted(theirs.fetchall(), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    original = {r.doc_id: r for r in docs.collect()}
    schema = docs.schema
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.schema == schema
        if name in ("toxicity", "near_copies"):
            kept = {r.doc_id: r for r in docs.collect()}
            assert 0.7 * before.count() <= len(kept) <= before.count()
            assert all(r == original[i] for i, r in kept.items())
        if name == "secrets":
            assert docs.count() == before.count()
            changed = [r for r in docs.collect() if r.text != original[r.doc_id].text]
            assert changed and all("[secret]" in r.text and r.n_chars == len(r.text) for r in changed)
        if name == "mixing":
            assert {tuple(r) for r in docs.collect()} <= {tuple(r) for r in before.collect()}
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and docs.count() > 0


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_run(spark):
    assert corpus_pipeline.ORACLE_SQL is None
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert rows and all(r.n_tokens >= 0 and len(r.ids_sha256) == 64 for r in rows)


def test_empty_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_what_op4_predicts_as_toxic_goes(spark, monkeypatch):
    scores = [0.1, 0.29, 0.3, 0.4, 0.5, 0.9]
    docs = spark.createDataFrame(list(enumerate(scores)), "doc_id long, kept double")
    monkeypatch.setattr(corpus_pipeline, "toxicity_scores", lambda docs, labels, name: docs.withColumn(name, docs["kept"]))
    left = corpus_pipeline.drop_toxic(spark, docs, SF_DIR)
    assert sorted(r.doc_id for r in left.collect()) == [0, 1]


def plain_toxic(docs, labels, options):
    """Scores by FTRL-proximal over dictionaries, one labelled document after the other, in the hashed order."""
    z, n, bias = {}, {}, 1 << options.bits

    def weight(i):
        if abs(z.get(i, 0.0)) <= (0.0 if i == bias else options.l1):
            return 0.0
        shrunk = z[i] - math.copysign(0.0 if i == bias else options.l1, z[i])
        return -shrunk / ((options.beta + math.sqrt(n.get(i, 0.0))) / options.alpha + options.l2)

    def at(text):
        return sorted(set(features(pa.array([text or ""]), options.bits)[0].tolist())) + [bias]

    def sigmoid(x):
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))

    found = {k: at(t) for k, t in docs.items()}
    for order in labels:
        for k, label in order:
            w = {i: weight(i) for i in found[k]}
            g = sigmoid(sum(w.values())) - label
            for i in found[k]:
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / options.alpha * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {k: sigmoid(sum(weight(i) for i in f)) for k, f in found.items()}


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_run_against_a_plain_version(spark):
    """Every stage by plain loops: FTRL, all pairs of shingle sets, patterns, the mixture's plan, a library's ids."""
    import tiktoken
    from pyspark.sql import functions as F

    from test_jaccard_join import brute as near_groups_of
    from test_mixing import plain_plan
    from test_secrets import brute as secrets_of

    options = FtrlOptions()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").where("toxic IS NOT NULL")
    keyed = labels.select("doc_id", "toxic", *[F.xxhash64(F.lit(t), F.xxhash64(F.lit(20), "doc_id")).alias(f"o{t}") for t in range(options.rounds)]).collect()
    assert len({r.doc_id for r in keyed}) == len(keyed) < options.max_train_docs
    orders = [[(r.doc_id, float(r.toxic)) for r in sorted(keyed, key=lambda r, t=t: r[f"o{t}"]) if r.doc_id in docs] for t in range(options.rounds)]
    scores = plain_toxic({k: r.text for k, r in docs.items()}, orders, options)
    kept = {k: r for k, r in docs.items() if scores[k] < corpus_pipeline.TOXIC_FROM}
    assert 0 < len(kept) < len(docs)

    groups = near_groups_of([(k, r.text) for k, r in kept.items()], JaccardOptions(80, 100, 5))
    kept = {k: kept[k] for k, n, c in groups if not n or k == c}

    def clean(text):
        out, end = [], 0
        for a, _, b in secrets_of(text):
            if a >= end:
                out += [text[end:a], "[secret]"]
            end = max(end, b)
        return "".join(out) + text[end:]

    texts = {k: clean(r.text) for k, r in kept.items()}
    copies = plain_plan(spark, [(k, kept[k].source, t) for k, t in texts.items()], MixOptions())
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    wanted = []
    for (k, _), times in copies.items():
        ids = np.array(library.encode_ordinary(texts[k]), "<u4")
        row = (k, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[k].encode()).hexdigest())
        wanted += [row] * times
    assert sorted(wanted) == sorted(tuple(r) for r in corpus_pipeline.run(spark, SF_DIR).collect())

import random

import pytest
from pyspark.sql import functions as F

from panelfx.operators.corpus import (
    next_token_pairs,
    pack_sequences,
    sequence_lookup,
    token_frequency,
    tokenize,
    union_splits,
    vocabulary,
)
from panelfx.operators.sampling import sample_two_stage, sample_uniform
from panelfx.schemas import SEQUENCES, TOKENIZED
from panelfx.sources.corpora import CORRUPT, read_corpus, read_json_permissive, read_splits, write_splits


def packed(df, length):
    return {r["seq_idx"]: list(r["input_ids"]) for r in pack_sequences(df, length).collect()}


def test_golden_packing(spark):
    docs = spark.createDataFrame([(0, [1, 2, 3]), (1, [4]), (2, []), (3, [5, 6, 7, 8])], TOKENIZED)
    assert packed(docs, 3) == {-100: [1, 2, 3], -101: [4, 5, 6]}


@pytest.mark.parametrize(("parts", "range_rows"), [(1, 2_000_000), (7, 5)])
def test_packing_keeps_every_token_in_order(spark, monkeypatch, parts, range_rows):
    monkeypatch.setattr("panelfx.operators.ordering.RANGE_ROWS", range_rows)
    rng = random.Random(5)
    # sparse ids, one document far longer than the others
    ids = rng.sample(range(10_000_000), 80)
    docs = [(i, [rng.randrange(1000) for _ in range(rng.choice([0, 1, 5, 40]))]) for i in ids]
    docs[3] = (docs[3][0], list(range(5000)))
    df = spark.createDataFrame(docs, TOKENIZED).repartition(parts)
    stream = [t for _, tokens in sorted(docs) for t in tokens]
    rows = packed(df, 16)
    assert len(rows) == len(stream) // 16
    assert [t for k in sorted(rows, reverse=True) for t in rows[k]] == stream[: len(rows) * 16]
    assert max(rows) == -100 and min(rows) == -99 - len(rows)


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["b a a", "", "  a \n c\tb ", "a é", "   "]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_vocabulary_and_tokens(spark, docs):
    vocab = {r["token"]: (r["token_id"], r["count"]) for r in vocabulary(docs).collect()}
    assert vocab == {"a": (0, 4), "b": (1, 2), "c": (2, 1), "é": (3, 1)}
    ids = {r["doc_id"]: r["input_ids"] for r in tokenize(docs, vocabulary(docs)).collect()}
    assert ids == {0: [1, 0, 0], 1: [], 2: [0, 2, 1], 3: [0, 3], 4: []}


@pytest.mark.parametrize("head", [0, 1, 3, 100])
def test_rare_words_take_the_shuffled_path(spark, docs, monkeypatch, head):
    import panelfx.operators.corpus as corpus

    monkeypatch.setattr(corpus, "HEAD_WORDS", head)
    ids = {r["doc_id"]: r["input_ids"] for r in tokenize(docs, vocabulary(docs)).collect()}
    assert ids == {0: [1, 0, 0], 1: [], 2: [0, 2, 1], 3: [0, 3], 4: []}


@pytest.mark.parametrize("head", [1, 100])
def test_unknown_words(spark, docs, monkeypatch, head):
    import panelfx.operators.corpus as corpus

    monkeypatch.setattr(corpus, "HEAD_WORDS", head)
    vocab = vocabulary(docs).where(F.col("token") != "c")
    ids = {r["doc_id"]: r["input_ids"] for r in tokenize(docs, vocab, unknown_id=99).collect()}
    assert ids[2] == [0, 99, 1]
    with pytest.raises(Exception, match="outside the vocabulary: c"):
        tokenize(docs, vocab).collect()


def test_custom_tokenizer(docs):
    def characters(batches):
        for texts in batches:
            yield texts.map(lambda text: [ord(c) for c in text.strip()])

    ids = {r["doc_id"]: r["input_ids"] for r in tokenize(docs, tokenizer=characters).collect()}
    assert ids[0] == [98, 32, 97, 32, 97] and ids[1] == []


def test_frequency(spark):
    tokens = spark.createDataFrame([(0, [1, 2, 2]), (1, [2]), (2, [])], TOKENIZED)
    assert {r["token"]: r["count"] for r in token_frequency(tokens).collect()} == {1: 1, 2: 3}


def test_pairs(spark):
    rows = spark.createDataFrame([(7, [1, 2, 3]), (8, [4]), (9, [])], SEQUENCES)
    assert [tuple(r) for r in next_token_pairs(rows).orderBy("pos").collect()] == [(7, 0, 1, 2), (7, 1, 2, 3)]


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_two_stage_counts_and_determinism(spark, parts):
    ids = spark.range(0, 8 * 5 * 3 + 5).withColumnRenamed("id", "seq_idx").repartition(parts)
    rows = sample_two_stage(ids, 2, 3, seed=9, batch_size=8, cohort_size=5).collect()
    assert len(rows) == 3 * 2 * 3 and len({r["seq_idx"] for r in rows}) == len(rows)
    for r in rows:
        assert r["batch_idx"] == r["seq_idx"] // 8 and r["cohort"] == r["batch_idx"] // 5
        assert r["batch_idx"] < 15  # the partial batch takes no part
    once = sample_two_stage(ids.coalesce(1), 2, 3, seed=9, batch_size=8, cohort_size=5).collect()
    assert sorted(rows) == sorted(once)
    other = sample_two_stage(ids, 2, 3, seed=10, batch_size=8, cohort_size=5).collect()
    assert sorted(rows) != sorted(other)


@pytest.mark.parametrize("n", [0, 1, 50, 300, 1000])
def test_uniform_is_the_smallest_keys(spark, n):
    import hashlib

    ids = spark.range(300).withColumnRenamed("id", "seq_idx")
    got = {r["seq_idx"] for r in sample_uniform(ids.repartition(5), n, seed=2).collect()}
    keys = sorted(range(300), key=lambda i: hashlib.md5(f"2:{i}".encode()).hexdigest())
    assert got == set(keys[:n])


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_lookup_with_and_without_broadcast(spark, threshold):
    rows = spark.createDataFrame([(i, [i, i + 1]) for i in range(50)], SEQUENCES)
    wanted = spark.createDataFrame([(3,), (49,), (77,)], "seq_idx bigint")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        found = {r["seq_idx"]: r["input_ids"] for r in sequence_lookup(rows, wanted).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    assert found == {3: [3, 4], 49: [49, 50]}


def test_building_a_lookup_reads_no_sequences(spark, tmp_path):
    """Only the wanted ids are evaluated while the plan is built, and they are broadcast by their size."""
    path = str(tmp_path / "sequences")
    spark.createDataFrame([(i, [i]) for i in range(50)], SEQUENCES).write.parquet(path)
    plan = sequence_lookup(spark.read.parquet(path), spark.range(3).withColumnRenamed("id", "seq_idx"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_splits(spark, tmp_path):
    a = spark.createDataFrame([(1, [1])], SEQUENCES)
    b = spark.createDataFrame([(-100, [2])], SEQUENCES)
    assert union_splits(train=a, validation=b).count() == 2
    path = str(tmp_path / "subset")
    write_splits(path, train=a, validation=b)
    assert read_splits(spark, path).count() == 2
    only = read_splits(spark, path, "validation")
    assert [(r["seq_idx"], r["split"]) for r in only.collect()] == [(-100, "validation")]


def test_json_sources(spark, tmp_path):
    good = tmp_path / "good.json"
    good.write_text('{"doc_id": 1, "text": "x y"}\n')
    assert [tuple(r) for r in read_corpus(spark, str(good)).collect()] == [(1, "x y")]
    bad = tmp_path / "bad.json"
    bad.write_text('{"doc_id": 1, "text": "x"}\n{"doc_id": \n')
    with pytest.raises(Exception):
        read_corpus(spark, str(bad)).collect()
    from panelfx.schemas import CORPUS

    rows = read_json_permissive(spark, str(bad), CORPUS).cache().collect()
    assert {r[CORRUPT] for r in rows} == {None, '{"doc_id": '}


def test_absent_and_repeated_ids_keep_their_batches(spark):
    ids = [i for i in range(64) if i not in (5, 20)] + [9, 9, 64, 65]
    rows = sample_two_stage(spark.createDataFrame([(i,) for i in ids], "seq_idx bigint"), 9, 8, seed=1, batch_size=8, cohort_size=4)
    got = sorted(r.seq_idx for r in rows.collect())
    assert got == [i for i in range(64) if i not in (5, 20)]


@pytest.mark.parametrize("head", [400_000, 1])
def test_rows_that_share_an_id_are_tokenised_apart(spark, monkeypatch, head):
    import panelfx.operators.corpus as corpus

    monkeypatch.setattr(corpus, "HEAD_WORDS", head)
    docs = spark.createDataFrame([(1, "a b"), (1, "a c"), (None, "c"), (2, "x a")], "doc_id bigint, text string")
    vocab = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("x", None)], "token string, token_id int")
    got = sorted((r.doc_id or 0, r.input_ids) for r in corpus.tokenize(docs, vocab, unknown_id=9).collect())
    assert got == [(0, [2]), (1, [0, 1]), (1, [0, 2]), (2, [9, 0])]


@pytest.mark.parametrize("ids", [(1, 1, 2), (1, None, 2)])
def test_packing_refuses_ids_that_lose_tokens(spark, ids):
    rows = spark.createDataFrame([(i, [1, 2, 3]) for i in ids], "doc_id bigint, input_ids array<int>")
    with pytest.raises(Exception, match="NULL or repeated id"):
        pack_sequences(rows, 2).collect()


@pytest.mark.parametrize(("part", "length"), [(1, 16), (7, 16), (100, 3), (100, 1), (10_000, 4000)])
def test_packing_in_many_parts(spark, monkeypatch, part, length):
    """Parts of any size, rows longer than parts, documents longer than parts, empty and NULL lists, words as tokens."""
    monkeypatch.setattr("panelfx.operators.corpus.PART_TOKENS", part)
    rng = random.Random(part * length)
    docs = [(i * 3 - 50, [f"w{rng.randrange(99)}" for _ in range(rng.choice([0, 0, 1, 2, 9, 60]))]) for i in range(120)]
    docs[7] = (docs[7][0], None)
    docs[40] = (docs[40][0], [f"long{k}" for k in range(3000)])
    df = spark.createDataFrame(docs, "doc_id bigint, input_ids array<string>").repartition(5)
    stream = [t for _, tokens in sorted(docs) for t in tokens or []]
    rows = packed(df, length)
    assert len(rows) == len(stream) // length
    assert [t for k in sorted(rows, reverse=True) for t in rows[k]] == stream[: len(rows) * length]


def test_tokens_are_exchanged_once(spark, tmp_path, monkeypatch):
    """Lists are moved by one exchange; of what it makes, only incomplete rows are moved again."""
    import panelfx.operators.corpus as corpus

    frozen = []
    monkeypatch.setattr(corpus, "freeze", lambda df, label="frozen": frozen.append((label, df)) or df)
    docs = spark.createDataFrame([(i, list(range(50))) for i in range(100)], TOKENIZED)
    path = str(tmp_path / "tokens")
    docs.write.parquet(path)
    out = pack_sequences(spark.read.parquet(path), 16)
    (pieces,) = [df for label, df in frozen if label == "pieces"]
    plan = pieces._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert len({r["seq_idx"] for r in out.collect()}) == 5000 // 16


def test_packing_of_no_tokens(spark):
    assert packed(spark.createDataFrame([], TOKENIZED), 4) == {}
    assert packed(spark.createDataFrame([(1, []), (2, None)], TOKENIZED), 4) == {}


def test_uniform_sample_sorts_nothing_and_draws_ties(spark, monkeypatch):
    import panelfx.operators.sampling as sampling

    ids = spark.range(300).withColumnRenamed("id", "seq_idx")
    plan = sample_uniform(ids, 50, seed=2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Sort" not in plan and "Exchange" not in plan
    # an id that a third of all rows share: as many of its rows as are left to draw
    rows = spark.range(900).select((F.col("id") % 3 * F.col("id")).alias("seq_idx"), F.col("id").alias("row"))
    for n in (1, 200, 299, 300, 301, 450, 899, 900, 1000):
        drawn = sample_uniform(rows.repartition(7), n, seed=5).collect()
        assert len(drawn) == min(n, 900) == len({r["row"] for r in drawn})
    counts = {n: sum(r["seq_idx"] == 0 for r in sample_uniform(rows, n, seed=5).collect()) for n in (100, 500, 900)}
    assert counts[900] == 300 and counts[100] <= counts[500] <= 300
    # short prefixes take more rounds and give the same rows
    wanted = {r["seq_idx"] for r in sample_uniform(ids, 77, seed=4).collect()}
    monkeypatch.setattr(sampling, "PREFIX_DIGITS", 1)
    assert {r["seq_idx"] for r in sample_uniform(ids, 77, seed=4).collect()} == wanted


def test_ranges_by_bisection(spark):
    from panelfx.operators.ordering import range_index

    for starts in ([], [5], [2, 4, 8], list(range(0, 2000, 7))):
        found = spark.range(-3, 2100).select("id", range_index(F.col("id"), starts).alias("r")).collect()
        assert all(r["r"] == sum(s <= r["id"] for s in starts) for r in found)
    names = spark.createDataFrame([("a",), ("b",), ("zz",)], "s string").select(range_index(F.col("s"), ["b", "c"])).collect()
    assert [r[0] for r in names] == [0, 1, 2]

import math
import os
import random

import numpy as np
import pytest

from panelfx.llm import jaccard_join
from panelfx.llm.jaccard_join import (
    JaccardOptions,
    different_lists,
    group_tokens,
    jaccard_groups,
    keep_one,
    rare_entries,
    shared_entries,
)

SF_DIR = "/root/testdata/sf0.001"


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*[w[k:] for k in range(width)], strict=False)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(rows, options):
    sets = [shingles(t, options.width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in enumerate(sets):
        for b in range(a):
            y = sets[b]
            if x and y and options.den * len(x & y) >= options.num * len(x | y):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(s), least.get(find(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, key string, n int")


def found(spark, rows, options):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_groups(table(spark, rows), options).collect()), key=repr)


def families(seed=1):
    """Documents of many lengths, each with versions edited at random places, and a passage all of one kind share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 4)))
    passage = [word() for _ in range(60)]
    texts = []
    for n in [1, 2, 3, 5, 9, 11, 12, 14, 19, 20, 21, 25, 33, 40, 45, 70, 150, 400, 1500]:
        base = [word() for _ in range(n)]
        if n > 30 and rng.random() < 0.7:
            base[5:5] = passage
        for _ in range(7):
            other = list(base)
            for _ in range(rng.randrange(0, max(2, n // 40))):
                k = rng.randrange(len(other))
                other[k : k + 1] = rng.choice([[], [word()], [other[k], word()]])
            texts.append(" ".join(other).upper() if rng.random() < 0.3 else "\n ".join(other))
    texts += ["", None, " \t", *[" ".join(passage)] * 3, " ".join(passage[:-1]), "\x1c \x85 b"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("options", [JaccardOptions(90, 100, 3), JaccardOptions()])
def test_families(spark, options):
    rows = families()
    assert found(spark, rows, options) == brute(rows, options)


def test_chain_of_versions_is_one_group(spark):
    words = [f"w{k}" for k in range(400)]
    rows = [(900 - k, " ".join(words[k : k + 300])) for k in range(0, 60, 5)]
    options = JaccardOptions(90, 100, 3)
    assert found(spark, rows, options) == brute(rows, options)
    assert {c for _, _, c in found(spark, rows, options)} == {845}


def test_repeated_and_null_ids_and_empty_tables(spark):
    options = JaccardOptions(90, 100, 3)
    rows = [(5, "a b c d"), (5, "q r s t"), (3, "A B C D"), (None, "a b c d"), (None, "z z"), (None, None), (5, "a b c d")]
    assert found(spark, rows, options) == brute(rows, options)
    assert found(spark, [], options) == []


def test_size_classes_leave_no_pair_out():
    options = JaccardOptions(90, 100, 3)
    for a in range(1, 60):
        for b in range(a, 70):
            reachable = options.den * a >= options.num * b
            assert ((a, b) in options.partner_classes(a)) == ((a, b) in options.partner_classes(b)) == reachable
            if reachable:
                need = options.least_overlap(a, b)
                assert options.den * need >= options.num * (a + b - need)
                assert options.den * (need - 1) < options.num * (a + b - need + 1)
                # the smaller set's class is one that both are entered for, with more groups than can differ
                (edge,) = [e for e in options.schemes(a) if e > a]
                assert edge in options.schemes(b) and a + b - 2 * need <= options.most_apart(edge) < options.groups(edge)
    assert options.subsets(20) == 190 + 20 + 20 + 1 + 1 and math.comb(20, 18) == 190


def test_keep_one(spark):
    rows = [(9, "a b c d e f"), (2, "a b c d e f"), (4, "other words here in this text"), (7, ""), (8, None), (4, "other words here in this text")]
    kept = keep_one(table(spark, rows))
    assert kept.columns == ["doc_id", "text", "key", "n"]
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 7, 8]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_documents_of_the_small_tables(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    options = JaccardOptions(90, 100, 3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_groups(docs, options).collect()), key=repr)
    assert got == brute(rows, options)


@pytest.mark.parametrize("options", [JaccardOptions(90, 100, 3), JaccardOptions(80, 100, 5), JaccardOptions(1, 2, 2)])
def test_linked_sets_share_a_list(options):
    """Sets of all sizes at the threshold, differing wherever they can, meet; sets that share a passage don't."""
    rng = np.random.default_rng(options.num)
    draw = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    pairs = []
    for a in [*range(1, 60), 75, 120, 333, 1000, 4000]:
        for b in {a, a * options.den // options.num, (a + a * options.den // options.num) // 2}:
            need = options.least_overlap(a, b)
            common = draw(need)
            for _ in range(6):
                pairs.append((np.unique(np.r_[common, draw(a - need)]), np.unique(np.r_[common, draw(b - need)])))
    tokens, owner = group_tokens([s for pair in pairs for s in pair], options)
    of = [set() for _ in range(2 * len(pairs))]
    for token, k in zip(tokens.tolist(), owner.tolist(), strict=True):
        of[k].add(token)
    assert all(of[2 * k] & of[2 * k + 1] for k in range(len(pairs)))
    if options.num >= 80:
        passage = draw(60)
        others = [np.unique(np.r_[passage, draw(400)]) for _ in range(300)]
        tokens, owner = group_tokens(others, options)
        _, times = np.unique(tokens, return_counts=True)
        assert (times > 1).sum() < len(times) / 500


def test_lists_of_a_common_passage_stay_closed(spark):
    """2,000 documents around one passage, a few of them with versions: no pairs are made but those of versions."""
    rng = random.Random(8)
    passage = [f"p{k}" for k in range(50)]
    texts = [passage + [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(80, 200))] for _ in range(2000)]
    texts += [t[:60] + ["changed"] + t[60:] for t in texts[:20]]
    options = JaccardOptions(90, 100, 3)
    rows = {r.doc_id: r.component_id for r in jaccard_groups(table(spark, list(enumerate(map(" ".join, texts)))), options).collect()}
    assert rows == {k: k if k < 2000 else k - 2000 for k in range(2020)}


@pytest.mark.parametrize("rows_a_batch", ["3", "10000"])
def test_entries_of_shared_lists(spark, rows_a_batch):
    """Lists of one key, of a key repeated, and of many, cut by batches anywhere."""
    rng = random.Random(4)
    entries = [(t, rng.randrange(6) if t % 3 else 7) for t in range(60) for _ in range(rng.randrange(1, 9))]
    entries += [(1000, k % 40) for k in range(200)]
    table = spark.createDataFrame([(t, k, k * 10) for t, k in entries], "token bigint, key bigint, n int")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
    try:
        found = sorted(tuple(r) for r in shared_entries(table).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    lists = {}
    for t, k in entries:
        lists.setdefault(t, set()).add(k)
    assert found == sorted((t, k, k * 10, min(ks)) for t, ks in lists.items() if len(ks) > 1 for k in ks)


def test_lists_of_the_same_classes_are_compared_once(spark):
    lists = {1: [10, 11], 2: [10, 11], 3: [10, 11, 12], 4: [12, 13], 5: [10, 14]}
    component = {10: 10, 11: 11, 12: 12, 13: 12, 14: 14}
    rows = [(t, k, component[k]) for t, keys in lists.items() for k in keys]
    found = different_lists(spark.createDataFrame(rows, "token bigint, key bigint, component bigint")).collect()
    kept = {t: sorted(r["key"] for r in found if r["token"] == t) for t in {r["token"] for r in found}}
    assert kept == {1: [10, 11], 3: [10, 11, 12], 5: [10, 14]}


def around_a_passage(count, rng):
    """Texts of 310 words around one passage, a tenth of them with a version."""
    passage = [f"p{k}" for k in range(60)]
    texts = [passage + [f"w{rng.randrange(10**6)}" for _ in range(250)] for _ in range(count)]
    return texts + [t[:70] + ["changed"] + t[70:] for t in texts[: count // 10]]


def around_a_text(count, rng):
    """One text and versions of it that link with it alone."""
    base = [f"b{k}" for k in range(300)]
    versions = [list(base) for _ in range(count)]
    for v in versions:
        for k in rng.sample(range(5, 295, 11), 6):
            v[k] = f"x{rng.randrange(10**6)}"
    return [base, *versions]


@pytest.mark.parametrize("made", [around_a_passage, around_a_text])
def test_pairs_in_open_lists_do_not_grow_with_the_square(spark, monkeypatch, made):
    met = []

    def counted(placed):
        lists = different_lists(placed).localCheckpoint()
        met.append(sum(r["count"] * (r["count"] - 1) // 2 for r in lists.groupBy("token").count().collect()))
        return lists

    monkeypatch.setattr(jaccard_join, "different_lists", counted)
    for count in (40, 160):
        rows = list(enumerate(" ".join(t) for t in made(count, random.Random(count))))
        assert found(spark, rows, JaccardOptions()) == brute(rows, JaccardOptions())
    assert met[1] <= 6 * max(met[0], 20)


def test_longest_lists_go_first(spark):
    """Of a class and edge the longest lists go, as many as may; what is strongest is in the longest lists."""
    lists = {1: [10, 11, 12, 13], 2: [10, 11, 12], 3: [10, 11], 4: [12, 13], 5: [10, 14]}
    spare = {10: 2, 11: 1, 12: 0, 13: 1, 14: 0}
    rows = [(t, k, 0 if t == 5 else 7, 0 if t == 5 else spare[k], min(keys)) for t, keys in lists.items() for k in keys]
    shared = spark.createDataFrame(rows, "token bigint, key bigint, edge int, spare int, pivot bigint")
    left = sorted(tuple(r) for r in rare_entries(shared).select("token", "key", "strength").collect())
    assert left == [(1, 12, 9), (2, 11, 9), (2, 12, 9), (3, 10, 9), (3, 11, 9), (4, 12, 9), (4, 13, 6), (5, 10, 2), (5, 14, 2)]


@pytest.mark.parametrize("options", [JaccardOptions(90, 100, 3), JaccardOptions(80, 100, 5), JaccardOptions(1, 2, 2)])
def test_linked_sets_have_spare_groups_in_common(options):
    for a in range(1, 250):
        for b in range(a, a * options.den // options.num + 1):
            apart = a + b - 2 * options.least_overlap(a, b)
            (edge,) = [e for e in options.schemes(a) if e > a]
            assert options.groups(edge) - apart >= max(options.spare(a, edge), options.spare(b, edge)) >= 1

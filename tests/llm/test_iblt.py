import hashlib
import random

import numpy as np
import pytest

from panelfx.llm.iblt import SketchOptions, chosen, edited, likeness, paragraph_keys, peel, sketches, version_fingerprints


def brute_likeness(a, b):
    x, y = (set(paragraph_keys([t.encode()], SketchOptions())[0].tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def some_texts(n=60, seed=4):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 7))) for _ in range(300)]
    texts = ["".join(rng.choice(words) + rng.choice("   \n") for _ in range(rng.randrange(0, 400))) for _ in range(n)]
    return texts + ["", "  \n ", "é😀 ü", "one", "x " * 30_000, "same line\n" * 50]


def test_peeling_recovers_the_difference():
    rng = np.random.default_rng(1)
    a = rng.integers(1, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:380], rng.integers(1, 2**63, 13).astype(np.uint64)])
    one, two = (sketches(k, np.array([len(k)]), 96) for k in (a, b))
    empty, plus, minus, who, found = peel([x - y for x, y in zip(one, two, strict=True)])
    assert empty[0] and plus[0] == 20 and minus[0] == 13
    assert set(found[who >= 0].tolist()) == set(a[380:].tolist())
    assert set(found[who < 0].tolist()) == set(b[380:].tolist())


def test_too_small_a_sketch_fails_and_is_retried():
    keys = np.arange(1, 2001).astype(np.uint64)
    none = np.zeros(0, np.uint64)
    small = [x - y for x, y in zip(sketches(keys, np.array([2000]), 24), sketches(none, np.array([0]), 24), strict=True)]
    assert not peel(small)[0][0]
    assert likeness((keys, np.array([2000])), (keys[:1500], np.array([1500])), SketchOptions())[0] == 0.75


def test_every_text_against_every_next():
    texts = some_texts()
    keys, counts = paragraph_keys([t.encode() for t in texts], SketchOptions())
    n = len(texts)
    a, b = chosen(keys, counts, np.arange(n - 1)), chosen(keys, counts, np.arange(1, n))
    got = likeness(a, b, SketchOptions())
    assert got.tolist() == pytest.approx([brute_likeness(x, y) for x, y in zip(texts, texts[1:], strict=False)])


def rows_of(spark, pairs, parts=None):
    table = spark.createDataFrame([(i, t, "x") for i, t in pairs], "doc_id bigint, text string, fingerprint string")
    return version_fingerprints(table if parts is None else table.repartition(parts)).collect()


def test_whole_table(spark):
    texts = some_texts()
    pairs = [(7 * k + k % 3, t) for k, t in enumerate(texts)]
    ids = sorted((i for i, _ in pairs), reverse=True)
    text = dict(pairs)
    following = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    rows = rows_of(spark, pairs, 5)
    assert sorted(r.doc_id for r in rows) == sorted(ids)
    prints = {}
    for r in rows:
        mine, other = text[r.doc_id], text[following[r.doc_id]]
        changed = edited(mine, other)
        third = len(mine) // 3
        assert changed == mine[: len(mine) - third] + other[:third]
        assert r.n_chars == len(mine) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.near_edited == pytest.approx(brute_likeness(mine, changed))
        assert r.near_next == pytest.approx(brute_likeness(mine, other))
        for t, p in ((mine, r.fingerprint), (changed, r.edited_fingerprint)):
            assert prints.setdefault(t, p) == p


def test_nulls_and_repeated_ids(spark):
    rows = rows_of(spark, [(3, "b"), (3, "a"), (None, "z z"), (1, None), (2, "q"), (2, "q"), (None, None)])
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars) for r in rows) == [
        (False, 1, 0), (False, 2, 1), (False, 2, 1), (False, 3, 1), (False, 3, 1), (True, 0, 0), (True, 0, 3)
    ]
    alone = rows_of(spark, [(None, "abc def")])[0]
    assert alone.near_next == 1.0 and alone.n_chars == 7
    one = rows_of(spark, [(4, "abc def")])[0]
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abc dab").hexdigest()
    assert rows_of(spark, []) == []

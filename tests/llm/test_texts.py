import random

import numpy as np
import pyarrow as pa

from panelfx.llm.components import connected_components
from panelfx.llm.texts import hash_spans, shingle_sets, slices, split_words

TEXTS = ["The CAT sat\ton  the\x0bmat", "", None, "  ", "É a\x85b É", "a", "x" * 3000 + " y"]


def plain_words(text):
    return (text or "").encode().lower().split()


def test_words_are_those_of_bytes_split():
    words = split_words(pa.array(TEXTS))
    found = [
        [words.word(i) for i in range(a, b)] for a, b in zip(words.first[:-1], words.first[1:], strict=True)
    ]
    assert found == [plain_words(t) for t in TEXTS]


def test_equal_words_have_equal_hashes_wherever_they_stand():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab") * rng.randrange(1, 9) for _ in range(50)) for _ in range(40)]
    words = split_words(pa.array(texts))
    by_hash, by_word = {}, {}
    for i, h in enumerate(words.hashes().tolist()):
        by_hash.setdefault(h, set()).add(words.word(i))
        by_word.setdefault(words.word(i), set()).add(h)
    assert all(len(v) == 1 for v in by_hash.values()) and all(len(v) == 1 for v in by_word.values())
    data = np.frombuffer(b"aa", np.uint8)
    assert len(set(hash_spans(data, np.array([0, 0]), np.array([1, 2])).tolist())) == 2


def test_shingles_of_short_texts():
    sets = shingle_sets(split_words(pa.array(["a b c d", "a b", "", None, "A B", "a b c a b c"])), 3)
    assert [len(s) for s in sets] == [2, 1, 0, 0, 1, 3]
    assert sets[1].tolist() == sets[4].tolist()


def test_slices_hold_every_row_once():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (5, 900, 0, 1, 2000, 3)] + [None])], ["text"])
    parts = list(slices(batch, "text", 1000))
    assert [v for p in parts for v in p.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert len(parts) > 1


def test_components_of_random_links(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1060)]
    edges += [(2000, k) for k in range(2001, 2200)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    links = spark.createDataFrame([*edges, (None, 3)], "a bigint, b bigint")
    found = {r.node: r.component for r in connected_components(links).collect()}
    assert found == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert connected_components(links.limit(0)).count() == 0

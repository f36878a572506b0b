import math
from collections import Counter

import numpy as np
import pytest

from panelfx.llm.lattice_lm import LatticeOptions, Pieces, expected_counts, lattice_scores, word_log_probabilities

VOCABULARY = [b" ", b"a", b"b", b"c", b"ab", b"bc", b" a", b"abc", b" ab"]
SCORES = np.log(np.arange(1, 10) / 45)
BYTES = [bytes([k]) for k in range(256)] + [b"th", b"the", b" the", b" a", b"an", b"and", "é".encode()]


def splits(word, pieces):
    if not word:
        return [[]]
    return [[word[:n]] + rest for n in range(1, len(word) + 1) if word[:n] in pieces for rest in splits(word[n:], pieces)]


def test_marginals_are_sums_over_all_segmentations():
    score = dict(zip(VOCABULARY, SCORES, strict=True))
    words = [b"abc", b"a", b"cab", b"abcabc", b"bbbb"]
    expected = [math.log(sum(math.exp(sum(score[p] for p in s)) for s in splits(b" " + w, score))) for w in words]
    assert word_log_probabilities(Pieces(VOCABULARY, SCORES), words) == pytest.approx(expected)


def test_expected_counts_are_means_over_all_segmentations():
    score = dict(zip(VOCABULARY, SCORES, strict=True))
    words, times = [b"abc", b"a", b"cab", b"bcab"], np.array([1.0, 2.0, 1.0, 3.0])
    expected = np.zeros(len(VOCABULARY))
    for word, n in zip(words, times, strict=True):
        every = splits(b" " + word, score)
        share = np.exp([sum(score[p] for p in s) for s in every])
        for s, w in zip(every, share / share.sum(), strict=True):
            for p in s:
                expected[VOCABULARY.index(p)] += w * n
    assert expected_counts(Pieces(VOCABULARY, SCORES), words, times) == pytest.approx(expected)


def brute(rows, train):
    tokens = [[*(t or "").encode().lower().split(), None] for _, t in rows]
    count = Counter(w for k, ws in enumerate(tokens) if k in train for w in ws)
    n, v = sum(count.values()), len(count)
    return sorted(
        (i if i is not None else -1, len(ws), sum(count[w] > 0 for w in ws), n,
         round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6))
        for (i, _), ws in zip(rows, tokens, strict=True)
    )


@pytest.mark.parametrize("head", [262_144, 2, 0])
def test_base_scores_for_any_share_of_broadcast_words(spark, head):
    rows = [(1, "The cat and THE dog"), (2, "a\tb\x0bthe thin\x1cg"), (3, ""), (4, None), (5, "new words " * 3), (None, "the cat"),
            (2, "a\tb\x0bthe thin\x1cg"), (6, "x" * 5_000 + " the"), (7, "é É the")]
    train = {0, 1, 2, 3, 6}
    schema = "doc_id bigint, text string, score string"
    docs = spark.createDataFrame([(i, t, "mine") for i, t in rows], schema)
    learnt = spark.createDataFrame([(*rows[k], "mine") for k in sorted(train)], schema)
    got = lattice_scores(learnt, docs, BYTES, LatticeOptions(head=head)).collect()
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    assert found == brute(rows, train)
    by_id = {r.doc_id: r.score for r in got}
    assert by_id[3] == by_id[4] > by_id[None] > by_id[1] and all(math.isfinite(s) and s < 0 for s in by_id.values())


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert lattice_scores(docs, docs.limit(0), BYTES).count() == 0
    row = lattice_scores(docs.limit(0), docs, BYTES).first()
    assert row.train_tokens == 0 and row.n_known == 0 and math.isfinite(row.score)
    assert row.base_score == pytest.approx(0.0)


def test_training_makes_seen_words_likelier(spark):
    docs = spark.createDataFrame([(k, "the thane and an anthem") for k in range(30)], "doc_id bigint, text string")
    other = spark.createDataFrame([(1, "the thane and an anthem"), (2, "zzq qqz xxw vv kqjkqj")], "doc_id bigint, text string")
    score = {r.doc_id: r.score for r in lattice_scores(docs, other, BYTES).collect()}
    assert score[1] > score[2]


def test_long_pieces_take_part_in_all_segmentations(spark):
    """Rulers and other pieces of a hundred bytes, against every segmentation by recursion."""
    long = [b" " + b"=" * 99, b"=" * 64, b"=" * 17, b"-" * 100, b" " + b"x" * 40]
    pieces = BYTES + [b"==", b"====", *long]
    share = np.log(np.arange(1, len(pieces) + 1) / sum(range(1, len(pieces) + 1)))
    score = dict(zip(pieces, share, strict=True))

    def marginal(word):
        total = [0.0] + [-math.inf] * len(word)
        for end in range(1, len(word) + 1):
            ways = [total[end - n] + score[word[end - n : end]] for n in range(1, end + 1) if word[end - n : end] in score]
            total[end] = max(ways) + math.log(sum(math.exp(w - max(ways)) for w in ways))
        return total[-1]

    words = [b"=" * n for n in (16, 17, 56, 99, 200)] + [b"-" * 100, b"x" * 40, b"x" * 41]
    found = word_log_probabilities(Pieces(pieces, share), words)
    assert found == pytest.approx([marginal(b" " + w) for w in words])
    docs = spark.createDataFrame([(1, "=" * 56), (2, "-" * 100), (3, "")], "doc_id bigint, text string")
    few = {r.doc_id: r.score for r in lattice_scores(docs.limit(0), docs, pieces, LatticeOptions(rounds=0)).collect()}
    plain = {r.doc_id: r.score for r in lattice_scores(docs.limit(0), docs, pieces[:-5], LatticeOptions(rounds=0)).collect()}
    # more segmentations by long pieces outweigh the smaller shares of the others
    assert few[1] > plain[1] + 1 and few[2] > plain[2] + 100


def test_a_null_text_is_no_text_named_none(spark):
    rows = [(5, None), (5, "None"), (5, "None"), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.n_tokens, r.n_known, round(r.base_score, 9)) for r in lattice_scores(docs, docs, BYTES, LatticeOptions(head=0)).collect())
    # four ends and two words in training
    base = lambda counts: sum(math.log10((c + 0.5) / (6 + 0.5 * 3)) for c in counts)
    assert got == [(1, 1, round(base([4]), 9))] * 2 + [(2, 2, round(base([4, 2]), 9))] * 2

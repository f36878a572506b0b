import math

import numpy as np
import pytest

from panelfx.llm.near_vectors import DescentOptions, near_groups


def brute(rows, threshold=0.95):
    usable = {}
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            usable[k] = x / np.abs(x).max()
            usable[k] /= np.linalg.norm(usable[k])
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for a in usable:
        for b in usable:
            if a != b and len(usable[a]) == len(usable[b]) and float(usable[a] @ usable[b]) >= threshold:
                links[a] += 1
                parent[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            groups[find(k)] = min(groups.get(find(k), i), i)
    out = []
    for k, (i, _) in enumerate(rows):
        c = groups.get(find(k)) if k in usable else i
        out.append((i, links[k], c, i is not None and i == c))
    return sorted(out, key=repr)


def found(spark, rows, options=DescentOptions()):
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<float>, label int, kept string")
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_groups(table, options).collect()), key=repr)


def as_float32(v):
    return None if v is None else [None if x is None else float(np.float32(x)) for x in v]


def planted(seed=1, n=700, dim=24):
    rng = np.random.default_rng(seed)
    rows = [rng.standard_normal(dim) for _ in range(n)]
    for base, copies, noise in ((0, 120, 0.08), (1, 5, 0.03), (2, 1, 0.04), (3, 30, 0.2)):
        rows += [rows[base] + noise * rng.standard_normal(dim) for _ in range(copies)]
    rows += [rows[10] * 3.0, rows[10], rows[10]]
    return [(k, as_float32(v.tolist())) for k, v in enumerate(rows)]


def test_planted_groups(spark):
    rows = planted()
    assert found(spark, rows) == brute(rows)


def test_lists_full_of_links_do_not_bound_the_counts(spark):
    rows = planted()
    assert found(spark, rows, DescentOptions(lists=3, longest=6, rounds=1)) == brute(rows)


def test_unusable_vectors(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
            (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.001]), (7, [0.0, 1.0]), (7, [1.0, 0.0])]
    assert found(spark, rows) == brute(rows)


def test_empty_and_single(spark):
    assert found(spark, []) == []
    assert found(spark, [(5, [1.0, 2.0])]) == [(5, 0, 5, True)]


def near(rng, axis, cosine):
    """A unit vector at this cosine of `axis`."""
    side = rng.standard_normal(len(axis))
    side -= (side @ axis) * axis
    return cosine * axis + math.sqrt(1 - cosine**2) * side / np.linalg.norm(side)


def test_touching_groups_of_full_lists_are_one(spark):
    rng = np.random.default_rng(3)
    one = np.eye(32)[0]
    two = near(rng, one, 0.97)
    rows = [near(rng, axis, 0.995) for axis in (one, two) for _ in range(200)]
    rows = [(k, as_float32(v.tolist())) for k, v in enumerate(rows)]
    wanted = brute(rows)
    assert {r[2] for r in wanted} == {0}
    assert found(spark, rows) == wanted
    assert found(spark, rows, DescentOptions(searches=1)) == wanted


def hot_and_pairs(seed=5, hot=900, pairs=200, dim=32):
    """One large group and pairs apart from it."""
    rng = np.random.default_rng(seed)
    axis = np.eye(dim)[0]
    rows = [near(rng, axis, 0.995) for _ in range(hot)]
    for _ in range(pairs):
        one = rng.standard_normal(dim)
        one /= np.linalg.norm(one)
        rows += [one, near(rng, one, 0.955)]
    return [(k, as_float32(v.tolist())) for k, v in enumerate(rows)]


def test_audit_sees_small_groups_beside_a_large_one(spark, monkeypatch):
    monkeypatch.setattr("panelfx.llm.near_vectors.WINDOW", 4)
    rows = hot_and_pairs()
    options = DescentOptions(trees=1, rounds=0)
    assert found(spark, rows, options) == brute(rows)
    with pytest.raises(RuntimeError, match="searches found"):
        found(spark, rows, DescentOptions(trees=1, rounds=0, searches=1))


@pytest.mark.parametrize("searches", [1, None])
def test_links_that_the_audit_finds_are_kept(spark, monkeypatch, searches):
    """The audit reports one link between two groups and a recall that is high enough."""
    import panelfx.llm.near_vectors as nv

    rng = np.random.default_rng(11)
    axes = np.eye(16)[:3]
    rows = [(k, as_float32(near(rng, axes[k % 3], 0.999).tolist())) for k in range(90)]
    real, calls = nv.audit, []

    def audit(labelled, sample, options):
        reached, missed = real(labelled, sample, options)
        calls.append(reached)
        if len(calls) > 1:
            return reached, missed
        labels = sorted(r.label for r in labelled.select("label").distinct().collect())
        assert len(labels) == 3
        return 0.9995, spark.createDataFrame([(labels[0], labels[1])], "a bigint, b bigint")

    monkeypatch.setattr(nv, "audit", audit)
    got = found(spark, rows, DescentOptions(searches=searches))
    assert len({c for _, _, c, _ in got}) == 2
    assert len(calls) == 2

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from panelfx.llm import prefix_trie as trie_module
from panelfx.llm.prefix_trie import NodeTable, PerfectHash, borrowed_turns, conversations_of, prefix_trie
from panelfx.llm.queries import TRIE_SQL, conversation_trie

NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain_trie(rows, borrow):
    """Nodes of the trie of rows (conv_id, turn, role, text), by the definition."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own[conv].append(((turn is not None, turn or 0, digest), (role, text)))
    turns = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 6 if borrow else 0
        whole[c] = tuple(turns.get(c - c % 100, [])[:h] + mine[h:])
    members = defaultdict(list)
    for c, path in whole.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below)]
        ends = sorted(c for c in convs if whole[c] == node)
        out.append((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs),
            sum(len(m) == len(node) + 1 for m in below), len(leaves),
            sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def found_rows(df):
    return sorted((tuple(r) for r in df.select(*NAMES).collect()), key=repr)


def random_rows(seed, convs, longest=6, letters="ab"):
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.choice(400, convs, replace=False).tolist():
        for t in range(int(rng.integers(1, longest + 1))):
            rows.append((c, t, str(rng.choice(["user", "bot"])), str(rng.choice(list(letters))) * int(rng.integers(1, 3))))
    return [rows[i] for i in rng.permutation(len(rows))]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_hashes_are_minimal_and_perfect(n):
    keys = np.random.default_rng(n).choice(10**12, n, replace=False).astype(np.uint64)
    table = PerfectHash(keys)
    assert table.size == n and sorted(table.slots(keys).tolist()) == list(range(n))


def test_lookups_are_verified_and_collisions_mended():
    hi, lo = np.array([1, 1, 2, 5], np.uint64), np.array([1, 1, 9, 5], np.uint64)
    table = NodeTable(hi, lo)
    assert table.built[0] == table.built[1] and len(set(table.built.tolist())) == 3
    assert table.slots(np.array([1, 7], np.uint64), np.array([2, 7], np.uint64)).tolist() == [-1, -1]
    # two digests made to share the first key
    lo = np.array([3, 4], np.uint64)
    hi = trie_module.mix(lo) ^ np.uint64(77)
    assert len(set(NodeTable(hi, lo).built.tolist())) == 2 and NodeTable(hi, lo).seed == 1


@pytest.mark.parametrize("borrow", [False, True])
def test_nodes_are_those_of_the_definition(spark, borrow):
    rows = random_rows(1, 120)
    rows += [(7000 + k, t, "user", "same" * t) for k in range(80) for t in range(5)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    whole = conversations_of(turns, borrowed_turns, 5, 100) if borrow else conversations_of(turns)
    assert found_rows(prefix_trie(whole)) == plain_trie(rows, borrow)


def test_small_shards_pieces_and_segments(spark, monkeypatch):
    """Subtrees that run over many shards, ranges and rounds of merging give the same nodes."""
    for name, value in (("SHARD_TURNS", 7), ("SHARD_CONVS", 3), ("SEGMENT_IDS", 4), ("FAN", 3)):
        monkeypatch.setattr(trie_module, name, value)
    rows = random_rows(2, 200, 5) + [(8000 + k, t, "user", "hot") for k in range(60) for t in range(4)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        found = found_rows(prefix_trie(conversations_of(turns, borrowed_turns, 5, 100)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == plain_trie(rows, True)


def test_nulls_repeats_ties_and_clashing_columns(spark):
    rows = [
        (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (2, None, "", ""), (2, 0, "user", "a"),
        (3, 5, "x", "b"), (3, 5, "user", "a"), (3, 5, "x", "b"), (None, 0, "user", "lost"), (-250, 1, "user", None),
        (-205, 0, "user", "head"), (4, 0, "a", "ab"), (5, 0, "aa", "b"), (200, 0, "", ""),
    ]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr(
        "*", "1 AS base", "2 AS path", "3 AS hi", "4 AS digest"
    )
    assert found_rows(prefix_trie(conversations_of(turns))) == plain_trie(rows, False)
    positive = [r for r in rows if r[0] is None or r[0] >= 0]
    found = prefix_trie(conversations_of(turns.where("conv_id IS NULL OR conv_id >= 0"), borrowed_turns, 5, 100))
    assert found_rows(found) == plain_trie(positive, True)


def test_turnless_long_and_no_conversations(spark):
    # 13 takes four turns of an absent conversation and has fewer of its own
    conv = next(c for c in range(101, 200) if borrowed_turns(c) == 4)
    rows = [(conv, t, "user", "x") for t in range(3)] + [(300, t, "user", f"{t % 7}") for t in range(700)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    found = found_rows(prefix_trie(conversations_of(turns, borrowed_turns, 5, 100)))
    assert len(found) == 701 and found == plain_trie(rows, True)
    assert prefix_trie(conversations_of(turns.limit(0))).count() == 0


def test_the_query_matches_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    expected = sorted(con.sql(TRIE_SQL).select(*NAMES).fetchall(), key=repr)
    assert found_rows(conversation_trie(spark, folder)) == expected

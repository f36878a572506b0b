"""Conversation prefix trie: sorted conversations, minimal-perfect-hash node tables, counts pushed up parent slots."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelfx.llm.texts import mix
from panelfx.session import freeze

# Turns and conversations of one node table, a single conversation excepted.
SHARD_TURNS = 100_000
SHARD_CONVS = 50_000
# Conversation ids in one row of a node's list of ends.
SEGMENT_IDS = 20_000
# Neighbouring pieces whose open nodes are merged together.
FAN = 64
OUT_BYTES = 8 << 20
ROOT = (np.uint64(0x6A09E667F3BCC908), np.uint64(0xBB67AE8584CAA73B))
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


# ---- whole conversations

def by_own_turns(conv_id: int) -> int:
    return 0


def borrowed_turns(conv_id: int) -> int:
    """How many turns a conversation takes from the first of its hundred."""
    return zlib.crc32(str(conv_id).encode()) % 6


def conversations_of(turns: DataFrame, heads: Callable[[int], int] = by_own_turns, most: int = 0, group: int = 1) -> DataFrame:
    """One row per conversation: conv_id, path (16-byte digests of its turns), chars (their code points, 64-bit).

    `turns` has conv_id, turn, role, text. Null roles and texts are empty, null turns come first, equal
    turn numbers are ordered by the digest of (role, text), repeated rows all count, rows without a
    conv_id are left out. With `heads`, the first heads(conv_id) turns (at most `most`) are those of
    conversation conv_id - conv_id % group instead, if it has as many, and none if it is absent.
    Texts become digests before anything is shuffled; one shuffle, in which a task streams through its turns
    in order.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    keyed = turns.where("conv_id IS NOT NULL").select(
        (F.col("conv_id") - F.col("conv_id") % group).cast("bigint").alias("base"),
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        F.unhex(F.substring(digest, 1, 32)).alias("digest"),
        F.length(text).cast("bigint").alias("chars"),
    )

    def join_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_base, head = None, (b"", b"")
        now, held = None, []
        rows: list[tuple[int, bytes, bytes]] = []
        size = 0

        def rebuilt() -> tuple[int, bytes, bytes]:
            nonlocal head_base, head
            base, conv = now
            path, chars = (b"".join(part) for part in zip(*held, strict=True))
            if conv == base:
                head_base, head = base, (path[: most * 16], chars[: most * 8])
            k = heads(conv)
            first = head if head_base == base else (b"", b"")
            return conv, first[0][: k * 16] + path[k * 16 :], first[1][: k * 8] + chars[k * 8 :]

        def batch_of() -> pa.RecordBatch:
            conv, path, chars = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(conv, pa.int64()), pa.array(path, pa.binary()), pa.array(chars, pa.binary())], ["conv_id", "path", "chars"]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            base, conv = (batch.column(c).to_numpy() for c in ("base", "conv_id"))
            digests = b"".join(batch.column("digest").to_pylist())
            chars = batch.column("chars").to_numpy().astype("<i8").tobytes()
            cuts = [0, *(np.flatnonzero(conv[1:] != conv[:-1]) + 1).tolist(), len(conv)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if now is None or conv[a] != now[1]:
                    if held:
                        rows.append(rebuilt())
                        size += len(rows[-1][1])
                    now, held = (int(base[a]), int(conv[a])), []
                held.append((digests[16 * a : 16 * b], chars[8 * a : 8 * b]))
            if size > OUT_BYTES:
                yield batch_of()
                rows, size = [], 0
        if held:
            rows.append(rebuilt())
        if rows:
            yield batch_of()

    # a group's first conversation comes before all that borrow from it
    order = ["base", F.col("conv_id") != F.col("base"), "conv_id", F.asc_nulls_first("turn"), "digest"]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartition(parts, "base").sortWithinPartitions(*order).select("base", "conv_id", "digest", "chars")
    return ordered.mapInArrow(join_turns, "conv_id bigint, path binary, chars binary")


# ---- node tables

class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: levels of bits at which one key alone fell on a place.

    Keys that share a place go on to the next level; a key's slot is the number of set bits before its own.
    """

    def __init__(self, keys: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0
        while len(keys):
            at = self.places(keys, len(self.levels), max(2 * len(keys), 16))
            alone = np.bincount(at, minlength=max(2 * len(keys), 16)) == 1
            self.levels.append((alone, self.size + np.cumsum(alone) - alone))
            self.size += int(alone.sum())
            keys = keys[~alone[at]]

    @staticmethod
    def places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64(level * 0x9E37_79B9_7F4A + 1)) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; any slot, or -1, for a key that was not built in."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (bits, before) in enumerate(self.levels):
            at = self.places(keys[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = before[at[hit]]
            left = left[~hit]
        return out


class NodeTable:
    """Slots of distinct 128-bit digests, each slot holding its digest, so that every lookup is verified."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray) -> None:
        self.seed = 0
        while True:
            keys = self.keys(hi, lo)
            self.hash = PerfectHash(np.unique(keys))
            self.hi, self.lo = np.zeros(self.hash.size, np.uint64), np.zeros(self.hash.size, np.uint64)
            at = self.hash.slots(keys)
            self.hi[at], self.lo[at] = hi, lo
            # two digests with one key would have left one of them in the slot
            if (self.hi[at] == hi).all() and (self.lo[at] == lo).all():
                self.built = at
                return
            self.seed += 1

    def keys(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        return hi ^ mix(lo + np.uint64(self.seed))

    def slots(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Slot of each digest, -1 where it is not in the table."""
        at = self.hash.slots(self.keys(hi, lo))
        return np.where((at >= 0) & (self.hi[at] == hi) & (self.lo[at] == lo), at, -1)


@dataclass
class Records:
    """Nodes or parts of nodes as columns. `n_children`, `n_leaves` and `saved` are those of closed subtrees
    below; `first` and `last` tell that the node is on the path of its piece's first or last conversation."""

    hi: np.ndarray
    lo: np.ndarray
    parent_hi: np.ndarray
    parent_lo: np.ndarray
    depth: np.ndarray
    chars: np.ndarray
    conv_id: np.ndarray
    n_convs: np.ndarray
    n_children: np.ndarray
    n_leaves: np.ndarray
    saved: np.ndarray
    first: np.ndarray
    last: np.ndarray
    was_open: np.ndarray

    def columns(self) -> dict[str, np.ndarray]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def __getitem__(self, rows: np.ndarray) -> Records:
        return Records(*(c[rows] for c in self.columns().values()))


def joined(*parts: Records) -> Records:
    return Records(*(np.concatenate(c) for c in zip(*(p.columns().values() for p in parts), strict=True)))


def settle(records: Records) -> tuple[Records, np.ndarray, np.ndarray, NodeTable]:
    """Merge records of equal digests and push the counts of nodes that can't grow any more up to their parents.

    Nodes with `first` or `last` set stay open: conversations of a neighbouring piece may share them.
    Returns the nodes by slot, the slots' parent slots (-1 for the root), which are open, and the table.
    """
    table = NodeTable(records.hi, records.lo)
    at, size = table.built, table.hash.size

    def summed(values: np.ndarray) -> np.ndarray:
        out = np.zeros(size, np.int64)
        np.add.at(out, at, values)
        return out

    def placed(values: np.ndarray) -> np.ndarray:
        out = np.zeros(size, values.dtype)
        out[at] = values
        return out

    def either(values: np.ndarray) -> np.ndarray:
        out = np.zeros(size, bool)
        out[at[values]] = True
        return out

    least = np.full(size, np.iinfo(np.int64).max)
    np.minimum.at(least, at, records.conv_id)
    r = records
    nodes = Records(
        table.hi, table.lo, placed(r.parent_hi), placed(r.parent_lo), placed(r.depth), placed(r.chars), least,
        summed(r.n_convs), summed(r.n_children), summed(r.n_leaves), summed(r.saved),
        either(r.first), either(r.last), either(r.was_open),
    )
    parent = np.where(nodes.depth > 0, table.slots(nodes.parent_hi, nodes.parent_lo), -1)
    is_open = nodes.first | nodes.last
    order = np.argsort(-nodes.depth, kind="stable")
    edges = np.flatnonzero(np.diff(nodes.depth[order], prepend=-1, append=-1))
    for a, b in zip(edges, edges[1:], strict=False):
        some = order[a:b]
        some = some[~is_open[some]]
        nodes.n_leaves[some] += nodes.n_children[some] == 0
        nodes.saved[some] += (nodes.n_convs[some] - 1) * nodes.chars[some]
        some = some[parent[some] >= 0]
        up = parent[some]
        np.add.at(nodes.n_children, up, 1)
        np.add.at(nodes.n_leaves, up, nodes.n_leaves[some])
        np.add.at(nodes.saved, up, nodes.saved[some])
    return nodes, parent, is_open, table


def prefix_records(paths: list[bytes], chars: list[bytes], conv_ids: np.ndarray) -> tuple[Records, np.ndarray]:
    """One record for each conversation and each of its prefixes, from depth 0; and the record of each whole one."""
    n = len(paths)
    sizes = np.array([len(p) // 16 for p in paths], np.int64)
    digests = np.frombuffer(b"".join(paths), "<u8").reshape(-1, 2)
    starts = np.cumsum(sizes) - sizes
    heads = starts + np.arange(n)
    total = int(sizes.sum()) + n
    hi, lo = np.empty(total, np.uint64), np.empty(total, np.uint64)
    hi[heads], lo[heads] = ROOT
    longest = np.argsort(-sizes, kind="stable")
    falling = -sizes[longest]
    for d in range(int(sizes.max(initial=0))):
        some = longest[: np.searchsorted(falling, -d, "left")]
        here, turn = heads[some] + d, starts[some] + d
        hi[here + 1] = mix(hi[here] * np.uint64(0x9FB21C651E98DF25) + digests[turn, 0] + mix(lo[here]))
        lo[here + 1] = mix(lo[here] * np.uint64(0xD6E8FEB86659FD93) + digests[turn, 1] + mix(hi[here + 1]))
    who = np.repeat(np.arange(n), sizes + 1)
    depth = np.arange(total) - heads[who]
    before = np.maximum(np.arange(total) - 1, 0)
    lengths = np.zeros(total, np.int64)
    lengths[depth > 0] = np.frombuffer(b"".join(chars), "<i8")
    none, no = np.zeros(total, np.int64), np.zeros(total, bool)
    first, last = who == 0, who == n - 1
    records = Records(
        hi, lo, np.where(depth > 0, hi[before], 0).astype(np.uint64), np.where(depth > 0, lo[before], 0).astype(np.uint64),
        depth, lengths, conv_ids[who], np.ones(total, np.int64), none, none.copy(), none.copy(), first, last, no,
    )
    return records, heads + sizes


SCHEMA = (
    "kind int, piece bigint, hi bigint, lo bigint, parent_hi bigint, parent_lo bigint, depth bigint, chars bigint, conv_id bigint, "
    "parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, first boolean, last boolean, "
    "was_open boolean, ends string"
)
CLOSED, OPEN, SEGMENT = 0, 1, 2


def out_batch(kind: int, piece: int, nodes: Records, parent_conv: np.ndarray | None = None, known: np.ndarray | None = None, ends: list | None = None) -> pa.RecordBatch:
    n = len(nodes.hi)
    columns = {k: pa.array(v.view(np.int64) if v.dtype == np.uint64 else v) for k, v in nodes.columns().items()}
    columns["kind"], columns["piece"] = pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, piece, np.int64))
    columns["parent_conv_id"] = pa.nulls(n, pa.int64()) if parent_conv is None else pa.array(parent_conv, mask=~known)
    columns["ends"] = pa.nulls(n, pa.string()) if ends is None else pa.array(ends, pa.string())
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([columns[c] for c in names], names)


def closed_batch(nodes: Records, parent: np.ndarray, is_open: np.ndarray, ends: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of the closed nodes; the parent's conv_id is null where the parent is still open."""
    some = np.flatnonzero(~is_open)
    up = parent[some]
    return out_batch(CLOSED, 0, nodes[some], nodes.conv_id[up], (up >= 0) & ~is_open[up], None if ends is None else ends[some].tolist())


def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node tables over a task's conversations (in order of path and id), shard after shard."""
    piece = TaskContext.get().partitionId()
    paths: list[bytes] = []
    chars: list[bytes] = []
    ids: list[int] = []
    size = 0
    carry: Records | None = None

    def shard() -> Iterator[pa.RecordBatch]:
        nonlocal carry
        conv_ids = np.array(ids, np.int64)
        records, whole = prefix_records(paths, chars, conv_ids)
        if carry is not None:
            # the piece's first conversation came in an earlier shard, its last comes in this one
            records.first[:] = False
            carry.last[:] = False
            records = joined(records, carry)
        nodes, parent, is_open, table = settle(records)
        ends = np.full(len(nodes.hi), None, object)
        ends[~nodes.was_open & ~is_open] = EMPTY_SHA
        slot = table.built[whole]
        edges = [0, *(np.flatnonzero(slot[1:] != slot[:-1]) + 1).tolist(), len(slot)]
        rows: list[int] = []
        texts: list[str] = []
        for a, b in zip(edges, edges[1:], strict=False):
            s = slot[a]
            if ends[s] is not None:
                ends[s] = hashlib.sha256(",".join(map(str, ids[a:b])).encode()).hexdigest()
            else:
                for c in range(a, b, SEGMENT_IDS):
                    rows.append(c)
                    texts.append(",".join(map(str, ids[c : min(b, c + SEGMENT_IDS)])))
        if rows:
            lists = nodes[slot[rows]]
            lists.conv_id = conv_ids[rows]
            yield out_batch(SEGMENT, piece, lists, ends=texts)
        yield closed_batch(nodes, parent, is_open, ends)
        carry = nodes[np.flatnonzero(is_open)]
        carry.was_open[:] = True

    for batch in batches:
        for conv, path, count in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "path", "chars")), strict=True):
            ids.append(conv)
            paths.append(path)
            chars.append(count)
            size += len(path) // 16
            if size >= SHARD_TURNS or len(ids) >= SHARD_CONVS:
                yield from shard()
                paths, chars, ids, size = [], [], [], 0
    if ids:
        yield from shard()
    if carry is not None:
        yield out_batch(OPEN, piece, carry)


def merged(batches: Iterator[pa.RecordBatch], last_round: bool) -> Iterator[pa.RecordBatch]:
    """Open nodes of groups of neighbouring pieces (column `piece`), in order of group and `member`."""
    group, held = None, []

    def together() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        columns = {f.name: table.column(f.name).to_numpy() for f in fields(Records)}
        for c in ("hi", "lo", "parent_hi", "parent_lo"):
            columns[c] = columns[c].view(np.uint64)
        for c in ("first", "last", "was_open"):
            columns[c] = columns[c].astype(bool)
        member = table.column("member").to_numpy()
        columns["first"] = columns["first"] & (member == member[0]) & (not last_round)
        columns["last"] = columns["last"] & (member == member[-1]) & (not last_round)
        nodes, parent, is_open, _ = settle(Records(**columns))
        yield closed_batch(nodes, parent, is_open)
        if is_open.any():
            yield out_batch(OPEN, group, nodes[np.flatnonzero(is_open)])

    for batch in batches:
        groups = batch.column("piece").to_numpy()
        cuts = [0, *(np.flatnonzero(groups[1:] != groups[:-1]) + 1).tolist(), len(groups)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if group is not None and groups[a] != group:
                yield from together()
                held = []
            group = int(groups[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield from together()


def list_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's list of ends, from its segments in order, one segment at a time."""
    now, running = None, None
    out: list[tuple[int, int, str]] = []

    def batch_of() -> pa.RecordBatch:
        hi, lo, sha = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(sha)], ["hi", "lo", "sha"])

    for batch in batches:
        for hi, lo, ends in zip(*(batch.column(c).to_pylist() for c in ("hi", "lo", "ends")), strict=True):
            if (hi, lo) != now:
                if now is not None:
                    out.append((*now, running.hexdigest()))
                now, running = (hi, lo), hashlib.sha256()
            else:
                running.update(b",")
            running.update(ends.encode())
    if now is not None:
        out.append((*now, running.hexdigest()))
        yield batch_of()


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie over whole conversations, as `conversations_of` gives them.

    Columns: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. A conversation without turns is a member of the root, whose
    counts and parents are as any node's; an empty table has no node.

    Conversations are sorted by their turn digests, so a subtree is a run of neighbours, however hot its
    top is; ranges of that order, cut where memory asks for it, are the shards. In a shard, distinct prefix
    digests get the slots of a minimal perfect hash, counts are scattered into flat arrays and pushed up
    through parent slots from the deepest level. Only nodes on the paths at a range's two borders can go
    on in a neighbour: they are passed on open, 64 ranges at a time, until one group is left. A task holds
    one shard, or FAN ranges' border paths; a single conversation is held whole, 24 bytes a turn. The digest
    of a node's list of ends is sequential by definition; long lists are written as segments and
    streamed.
    """
    spark = conversations.sparkSession
    whole = freeze(conversations, "conversations")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    planted = freeze(
        whole.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(plant, SCHEMA), "trie"
    )
    closed = [planted.where(F.col("kind") == CLOSED)]
    still = planted.where(F.col("kind") == OPEN)
    pieces = still.agg(F.max("piece")).first()[0]
    if pieces is None:
        return node_rows(closed[0].withColumn("ends", F.lit(EMPTY_SHA)))
    pieces += 1
    while True:
        last_round = pieces <= FAN
        groups = -(-pieces // FAN)
        grouped = still.withColumn("member", F.col("piece")).withColumn("piece", F.floor(F.col("piece") / FAN).cast("bigint"))

        def merge(batches: Iterator[pa.RecordBatch], last_round: bool = last_round) -> Iterator[pa.RecordBatch]:
            return merged(batches, last_round)

        step = freeze(
            grouped.repartition(max(min(groups, parts), 1), "piece").sortWithinPartitions("piece", "member").mapInArrow(merge, SCHEMA), "merged"
        )
        closed.append(step.where(F.col("kind") == CLOSED))
        if last_round:
            break
        still, pieces = step.where(F.col("kind") == OPEN), groups
    nodes = closed[0]
    for more in closed[1:]:
        nodes = nodes.unionByName(more)
    segments = planted.where(F.col("kind") == SEGMENT).select("hi", "lo", "conv_id", "ends")
    digests = freeze(
        segments.repartition(parts, "hi", "lo")
        .sortWithinPartitions("hi", "lo", "conv_id")
        .mapInArrow(list_digests, "hi bigint, lo bigint, sha string"),
        "ends",
    )
    # nodes that were open at some time: border paths, few beside all nodes
    tops = closed[1]
    for more in closed[2:]:
        tops = tops.unionByName(more)
    above = tops.unionByName(closed[0].where("was_open")).select(
        F.col("hi").alias("parent_hi"), F.col("lo").alias("parent_lo"), F.col("conv_id").alias("_above")
    )
    placed = (
        nodes.join(above, ["parent_hi", "parent_lo"], "left")
        .join(digests, ["hi", "lo"], "left")
        .withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "_above")))
        .withColumn("ends", F.coalesce("ends", "sha", F.lit(EMPTY_SHA)))
    )
    return node_rows(placed)


def node_rows(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256")
    )

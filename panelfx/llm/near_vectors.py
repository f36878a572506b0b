"""Near-duplicate vectors: a neighbour graph refined by NN-descent, its threshold links and their groups."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelfx.llm.components import connected_components
from panelfx.llm.texts import hash_runs, list_array, mix
from panelfx.session import freeze

SIGN_BITS = 62
WINDOW = 256
BLOCK = 512
# Neighbours found with single precision are taken at their word only this far from the threshold.
DOUBT = 1e-4


@dataclass(frozen=True)
class DescentOptions:
    """Parameters of the search.

    `lists` is the length of neighbour lists; a list that is full of links is doubled up to `longest`,
    and counts beyond it come from comparing whole groups. `trees` random orders give the first graph,
    `rounds` is the number of refinements. `audit` vectors are compared with all others; as long as less
    than `recall` of their links was found, the search goes on with new orders and audits further vectors,
    at the latest until all were audited. With `searches`, more of them raise. Links between groups that an
    audit finds are kept, and up to `audits` more audits follow while they find any.
    """

    threshold: float = 0.95
    lists: int = 16
    longest: int = 64
    trees: int = 16
    rounds: int = 2
    audit: int = 512
    recall: float = 0.999
    audits: int = 4
    searches: int | None = None
    seed: int = 0

    @property
    def floor(self) -> float:
        """Cosine of twice the threshold's angle: a path of two links never leaves it."""
        return max(2 * self.threshold**2 - 1, 0.0) - DOUBT


def unit_rows(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Unit vectors in double precision, and the rows they belong to; unusable rows are left out."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    found, rows = [], []
    for row, value in enumerate(column):
        if not value.is_valid or len(value.values) == 0 or value.values.null_count:
            continue
        x = value.values.to_numpy(zero_copy_only=False).astype(np.float64)
        top = np.abs(x).max()
        if not np.isfinite(top) or top == 0:
            continue
        x = x / top
        found.append(x / math.sqrt(float(x @ x)))
        rows.append(row)
    return found, np.array(rows, np.int64)


def vector_key(unit: np.ndarray) -> int:
    """64-bit digest of a vector's bytes as a signed integer (0 and -0 are equal)."""
    words = (unit + 0.0).view(np.uint64)
    return int(hash_runs(words, len(words)).view(np.int64)[0])


def keyed_vectors(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, key, unit) of every row; key and unit are null where the vector can't be used."""
    narrow = vectors.selectExpr(f"`{vec_id}` AS vec_id", f"`{embedding}` AS embedding")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, rows = unit_rows(batch.column("embedding"))
            keys = np.zeros(batch.num_rows, np.int64)
            keys[rows] = [vector_key(u) for u in units]
            unusable = np.ones(batch.num_rows, bool)
            unusable[rows] = False
            raw = np.full(batch.num_rows, None, object)
            for row, unit in zip(rows, units, strict=True):
                raw[row] = unit.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(keys, mask=unusable), pa.array(raw, pa.binary())], ["vec_id", "key", "unit"]
            )

    kind = narrow.schema["vec_id"].dataType.simpleString()
    return narrow.mapInArrow(read, f"vec_id {kind}, key bigint, unit binary")


def stacked(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def ordered_by_signs(points: DataFrame, options: DescentOptions, search: int, kind: type = np.float32) -> DataFrame:
    """Each vector once per tree, with the signs of its random projections as a sortable number.

    Where `points` has a label, it takes the place of the key in the result; the order does not depend on it.
    """
    label = "label" if "label" in points.columns else "key"
    first = search * options.trees

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            sizes = np.array([len(u) // 8 for u in batch.column("unit").to_pylist()])
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                part = batch.take(pa.array(rows))
                x = stacked(part.column("unit").to_pylist())
                for tree in range(first, first + options.trees):
                    if (dim, tree) not in planes:
                        rng = np.random.default_rng([options.seed, dim, tree])
                        planes[dim, tree] = rng.standard_normal((dim, SIGN_BITS))
                    signs = (x @ planes[dim, tree] > 0).astype(np.int64) @ (np.int64(1) << np.arange(SIGN_BITS, dtype=np.int64)[::-1])
                    keys = part.column("key").to_numpy()
                    salt = mix(keys.view(np.uint64) + np.uint64(tree)).view(np.int64)
                    small = [u.astype(kind).tobytes() for u in x]
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, tree, np.int32)), pa.array(signs),
                         pa.array(salt), part.column(label), pa.array(small, pa.binary())],
                        ["dim", "tree", "signs", "salt", "key", "unit"],
                    )

    spread = points.select(*dict.fromkeys(["key", label, "unit"])).mapInArrow(
        project, "dim int, tree int, signs bigint, salt bigint, key bigint, unit binary"
    )
    parts = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), spread.sparkSession.sparkContext.defaultParallelism)
    by = ["dim", "tree", "signs", "salt"]
    return spread.repartitionByRange(parts, *by).sortWithinPartitions(*by)


def best_pairs(keys: np.ndarray, others: np.ndarray, sims: np.ndarray, most: int, floor: float) -> list[np.ndarray]:
    """The `most` best partners above `floor` of each row of `sims`, as (a, b, sim) columns."""
    sims = np.where(keys[:, None] == others[None, :], -2.0, sims)
    if sims.shape[1] > most:
        cut = np.argpartition(-sims, most - 1, axis=1)[:, :most]
        value = np.take_along_axis(sims, cut, axis=1)
    else:
        cut, value = np.broadcast_to(np.arange(sims.shape[1]), sims.shape), sims
    keep = value >= floor
    rows = np.repeat(np.arange(len(keys)), keep.sum(axis=1))
    return [keys[rows], others[cut[keep]], value[keep].astype(np.float64)]


def edge_batch(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "sim"])


def first_graph(points: DataFrame, options: DescentOptions, search: int) -> DataFrame:
    """Edges (a, b, sim) between vectors that are close in some order, both ways.

    A task walks its part of an order in blocks and compares each block with itself and the one before,
    so a region of any density costs the same per vector. Where `points` has a label, edges are links
    in double precision between different labels, and a and b are labels.
    """
    labelled = "label" in points.columns
    kind, floor = (np.float64, options.threshold) if labelled else (np.float32, options.floor)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, tag = None, None
        for batch in batches:
            group = batch.column("dim").to_numpy() * np.int64(1 << 20) + batch.column("tree").to_numpy()
            cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]).tolist() + [batch.num_rows]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                if start == stop:
                    continue
                if group[start] != tag:
                    before, tag = None, group[start]
                for at in range(start, stop, WINDOW):
                    part = batch.slice(at, min(WINDOW, stop - at))
                    keys = part.column("key").to_numpy()
                    raw = part.column("unit").to_pylist()
                    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1)
                    found = [best_pairs(keys, keys, x @ x.T, options.lists, floor)]
                    if before is not None:
                        old_keys, old = before
                        sims = x @ old.T
                        found.append(best_pairs(keys, old_keys, sims, options.lists, floor))
                        found.append(best_pairs(old_keys, keys, sims.T, options.lists, floor))
                    before = keys, x
                    yield edge_batch(found)

    return ordered_by_signs(points, options, search, kind).mapInArrow(walk, "a bigint, b bigint, sim double")


def trimmed(edges: DataFrame, options: DescentOptions, most: int) -> DataFrame:
    """The best neighbours of each vector: `lists` of them, or `most` where the list is full of links."""
    once = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    best = W.partitionBy("a").orderBy(F.desc("sim"), "b")
    ranked = once.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= most)
    return ranked.where((F.col("_rank") <= options.lists) | (F.col("sim") >= options.threshold)).drop("_rank")


def neighbours_of_neighbours(graph: DataFrame, points: DataFrame, options: DescentOptions) -> DataFrame:
    """Edges between the members of each vector's neighbourhood: its list and a sample of its reverse list."""
    back = graph.select(F.col("b").alias("a"), F.col("a").alias("b"))
    fair = W.partitionBy("a").orderBy(F.xxhash64("a", "b"), "b")
    back = back.withColumn("_rank", F.row_number().over(fair)).where(F.col("_rank") <= options.lists).drop("_rank")
    around = graph.select("a", "b").unionByName(back).distinct()
    members = around.join(points.select(F.col("key").alias("b"), "unit"), "b")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches))
        keys = whole["b"].to_numpy()
        x = stacked(whole["unit"].to_pylist())
        yield edge_batch([best_pairs(keys, keys, x @ x.T, options.lists, options.floor)])

    # a list has at most `longest` entries and the sample `lists`, so a group is small
    return members.groupBy("a").applyInArrow(join, "a bigint, b bigint, sim double")


def sure_links(graph: DataFrame, points: DataFrame, options: DescentOptions) -> DataFrame:
    """Edges at or above the threshold in double precision, as (a, b)."""
    clear = graph.where(F.col("sim") >= options.threshold + DOUBT).select("a", "b")
    near = graph.where(F.abs(F.col("sim") - options.threshold) < DOUBT).select("a", "b")
    both = near.join(points.select(F.col("key").alias("a"), F.col("unit").alias("_one")), "a").join(
        points.select(F.col("key").alias("b"), F.col("unit").alias("_two")), "b"
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("_one").to_pylist(), batch.column("_two").to_pylist(), strict=True)
            sims = [float(np.frombuffer(a) @ np.frombuffer(b)) for a, b in rows]
            yield batch.filter(pa.array([s >= options.threshold for s in sims], pa.bool_())).select(["a", "b"])

    return clear.unionByName(both.select("a", "b", "_one", "_two").mapInArrow(check, "a bigint, b bigint"))


def labelled_points(points: DataFrame, groups: DataFrame) -> DataFrame:
    """`points` with their component as label; a vector without links is its own."""
    named = points.join(groups.withColumnRenamed("node", "key"), "key", "left")
    return named.withColumn("label", F.coalesce("component", "key")).drop("component")


def joined_groups(groups: DataFrame, graph: DataFrame, points: DataFrame, options: DescentOptions, search: int) -> DataFrame:
    """`groups` joined by the links between them that full lists had no room for.

    A link seen in an order is only dropped if the lists of both ends are full of links, so only such
    vectors are walked again, without the pairs within a group. That is repeated until no link between
    two groups is left in the orders; each group that has one is joined, so rounds are logarithmic.
    """
    full = graph.where(F.col("sim") >= options.threshold - DOUBT).groupBy(F.col("a").alias("key")).agg(F.count("*").alias("_n"))
    full = freeze(points.select("key", "unit").join(full.where(F.col("_n") >= options.lists).select("key"), "key"), "full")
    while True:
        labelled = labelled_points(full, groups)
        if labelled.select("label").distinct().limit(2).count() < 2:
            return groups
        links = freeze(first_graph(labelled, options, search).select("a", "b").distinct(), "between")
        if links.isEmpty():
            return groups
        known = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
        groups = freeze(connected_components(known.unionByName(links)), "groups")


def counted_links(groups: DataFrame, points: DataFrame, options: DescentOptions) -> DataFrame:
    """(key, links): for each vector of a group the number of vectors linked with it, copies included.

    All links lie within groups, and here they are counted whatever the lists hold: a group's vectors
    are dealt into blocks and every pair of blocks is one small matrix product. Only counts leave a task.
    """
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("_blocks"))
    dealt = (
        groups.join(sizes, "component")
        .withColumn("_block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
        .join(points.withColumnRenamed("key", "node"), "node")
    )
    partner = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    paired = dealt.select("component", "node", "_block", "unit", "copies", partner.alias("_other")).select(
        "component",
        F.least("_block", "_other").alias("_i"),
        F.greatest("_block", "_other").alias("_j"),
        "_block",
        "node",
        "unit",
        "copies",
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches))
        block, i, j = (whole[c].to_numpy() for c in ("_block", "_i", "_j"))
        keys, copies = whole["node"].to_numpy(), whole["copies"].to_numpy()
        x = stacked(whole["unit"].to_pylist())
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        linked = x[left] @ x[right].T >= options.threshold
        linked &= keys[left][:, None] != keys[right][None, :]
        sums = [linked @ copies[right]]
        nodes = [keys[left]]
        if len(i) and i[0] != j[0]:
            sums.append(linked.T @ copies[left])
            nodes.append(keys[right])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sums).astype(np.int64))], ["key", "links"]
        )

    blocks = paired.groupBy("component", "_i", "_j").applyInArrow(count, "key bigint, links bigint")
    return blocks.groupBy("key").agg(F.sum("links").alias("links"))


def audit_sample(labelled: DataFrame, audited: DataFrame, options: DescentOptions, search: int) -> DataFrame:
    """(key, label, unit) of options.audit vectors that were not audited yet, about as many of each size of group.

    Sizes are classes of a factor of two; a large group is one of some tens, so it doesn't crowd out the small ones.
    """
    open_ = labelled.select("key", "label").join(audited, "key", "left_anti")
    sizes = labelled.groupBy("label").agg(F.floor(F.log2(F.count("*") + 0.5)).alias("_size"))
    sized = freeze(open_.join(sizes, "label"), "sized")
    classes = F.broadcast(sized.groupBy("_size").agg(F.count("*").alias("_many")))
    uniform = (F.pmod(F.xxhash64(F.lit(options.seed + search), "key"), F.lit(1 << 52)) + 1) / F.lit(float(1 << 52))
    drawn = sized.join(classes, "_size").orderBy(-F.log(uniform) * F.col("_many"), "key").limit(options.audit)
    return freeze(drawn.select("key", "label").join(labelled.select("key", "unit"), "key"), "sample")


def audit(labelled: DataFrame, sample: DataFrame, options: DescentOptions) -> tuple[float, DataFrame]:
    """Mean share of its links found, over the sampled vectors that have any, and the links (a, b) between labels missed.

    The sample is compared with all vectors block by block. A link within a group counts as found, as
    counted_links compares all of a group. Each vector counts once, whatever the number of its links or copies.
    """
    drawn = sample.toArrow()
    if not drawn.num_rows:
        return 1.0, sample.selectExpr("key AS a", "label AS b")
    columns = drawn["key"].to_numpy(), drawn["label"].to_numpy(), drawn["unit"].to_pylist()
    shared = labelled.sparkSession.sparkContext.broadcast(columns)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, labels, raw = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2_048):
                part = batch.slice(at, 2_048)
                units = part.column("unit").to_pylist()
                for dim in {len(u) for u in units}:
                    mine = np.array([k for k, u in enumerate(raw) if len(u) == dim], np.int64)
                    rows = np.array([k for k, u in enumerate(units) if len(u) == dim], np.int64)
                    if not len(mine):
                        continue
                    linked = stacked([raw[k] for k in mine]) @ stacked([units[k] for k in rows]).T >= options.threshold
                    linked &= keys[mine][:, None] != part.column("key").to_numpy()[rows][None, :]
                    one, two = np.nonzero(linked)
                    pairs = np.stack([mine[one], part.column("label").to_numpy()[rows[two]]])
                    pairs, many = np.unique(pairs, axis=1, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[pairs[0]]), pa.array(labels[pairs[0]]), pa.array(pairs[1]), pa.array(many.astype(np.int64))],
                        ["key", "a", "b", "links"],
                    )

    seen = labelled.select("key", "label", "unit").mapInArrow(compare, "key bigint, a bigint, b bigint, links bigint")
    seen = freeze(seen.groupBy("key", "a", "b").agg(F.sum("links").alias("links")), "audit")
    found = F.sum(F.when(F.col("a") == F.col("b"), F.col("links")).otherwise(0)) / F.sum("links")
    share = seen.groupBy("key").agg(found.alias("_share")).agg(F.avg("_share")).first()[0]
    return 1.0 if share is None else share, seen.where("a <> b").select("a", "b").distinct()


def near_groups(
    vectors: DataFrame, options: DescentOptions = DescentOptions(), vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall) of every row; other columns are ignored.

    Two vectors link when their cosine in double precision reaches the threshold. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing, vectors of different length
    never do. Equal vectors are one point with a number of copies, so copies are not paired; each
    copy counts as linked with the others. component_id is the smallest vec_id reachable by links (for
    a null id: of the others in its group, if any), kept tells whether it is the row's own. Every row
    gives one row, repeated ids too; an empty table gives none. recall is the mean share of their
    links found over the audited vectors that have any (see audit); it is the same in all rows.
    """
    rows = freeze(keyed_vectors(vectors, vec_id, embedding), "vectors")
    points = freeze(
        rows.where("key IS NOT NULL").groupBy("key").agg(F.first("unit").alias("unit"), F.count("*").alias("copies")), "points"
    )
    graph = points.sparkSession.createDataFrame([], "a bigint, b bigint, sim double")
    known = graph.select("a", "b")
    audited = points.select("key").limit(0)
    for search in itertools.count():
        found = graph.unionByName(first_graph(points, options, search))
        graph = freeze(trimmed(found, options, options.lists), "graph")
        most = options.lists
        for _ in range(options.rounds):
            most = min(2 * most, options.longest)
            found = graph.unionByName(neighbours_of_neighbours(graph, points, options))
            graph = freeze(trimmed(found, options, most), "graph")
        links = sure_links(graph, points, options).unionByName(known)
        groups = freeze(connected_components(links), "groups")
        groups = joined_groups(groups, graph, points, options, search)
        labelled = labelled_points(points, groups)
        sample = audit_sample(labelled, audited, options, search)
        reached, missed = audit(labelled, sample, options)
        for _ in range(options.audits):
            if missed.isEmpty():
                break
            # links that the audit found are links, whatever the recall is; others are looked for with new vectors
            known = groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(missed)
            groups = freeze(connected_components(known), "groups")
            if reached < options.recall:
                break
            audited = audited.unionByName(sample.select("key"))
            labelled = labelled_points(points, groups)
            sample = audit_sample(labelled, audited, options, search)
            reached, missed = audit(labelled, sample, options)
        known = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
        if reached >= options.recall:
            groups = freeze(connected_components(known.unionByName(missed)), "groups")
            break
        if options.searches is not None and search + 1 >= options.searches:
            raise RuntimeError(f"{search + 1} searches found {reached:.4f} of the audited links, less than {options.recall}")
        # lists are cut again in the next search, what they joined stays
        audited = audited.unionByName(sample.select("key"))
    counts = freeze(counted_links(groups, points, options), "counts")
    named = rows.join(groups.withColumnRenamed("node", "key"), "key", "left").withColumn(
        "component", F.coalesce("component", "key")
    )
    least = named.where("key IS NOT NULL").groupBy("component").agg(F.min("vec_id").alias("_least"))
    extra = points.select("key", "copies").join(counts, "key", "left").select(
        "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    component = F.coalesce("_least", "vec_id")
    return (
        named.select("vec_id", "key", "component")
        .join(least, "component", "left")
        .join(extra, "key", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
            component.alias("component_id"),
            F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
            F.lit(float(reached)).alias("recall"),
        )
    )

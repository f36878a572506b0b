"""N-gram Jaccard join: subsets of small sets, inverted lists for large ones, boundary chosen by cost."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelfx.llm.components import connected_components
from panelfx.llm.texts import give_back, list_array, mix, shingle_sets, slices, split_words
from panelfx.session import freeze

# Sets up to this size may go to the subset side; beyond it the number of subsets explodes.
MOST_SMALL = 40
WORDS_OF_BITS = 8
# Sizes of one class differ by this factor at most, as numerator and denominator.
CLASS_NUM, CLASS_DEN = 7, 5
# Sets whose list entries a task makes together, in shingles, and the classes it remembers having entered.
TOGETHER = 200_000
REMEMBERED = 200_000


@dataclass(frozen=True)
class JaccardOptions:
    """Sets link when den * |A and B| >= num * |A or B|; shingles have `width` words."""

    num: int = 80
    den: int = 100
    width: int = 5

    def least_overlap(self, a: int, b: int) -> int:
        return -(-self.num * (a + b) // (self.num + self.den))

    def partner_classes(self, n: int) -> list[tuple[int, int]]:
        """Size pairs (a, b), a <= b, that a set of n can be one side of."""
        low, high = -(-self.num * n // self.den), n * self.den // self.num
        return [(a, n) for a in range(max(low, 1), n)] + [(n, b) for b in range(n, high + 1)]

    def subsets(self, n: int) -> int:
        return sum(math.comb(n, self.least_overlap(*pair)) for pair in self.partner_classes(n))

    @staticmethod
    def class_edges(n: int) -> list[int]:
        """Smallest sizes of the classes, up to the one that n is in and the next."""
        edges = [1]
        while edges[-1] <= n:
            edges.append(max(edges[-1] + 1, edges[-1] * CLASS_NUM // CLASS_DEN))
        return edges

    def most_apart(self, edge: int) -> int:
        """Most shingles that are in one of two linked sets only, the smaller below size `edge`."""
        both = edge - 1 + (edge - 1) * self.den // self.num
        return (self.den - self.num) * both // (self.num + self.den)

    def groups(self, edge: int) -> int:
        """Groups that shingles are dealt into, for pairs whose smaller set is below `edge`: more than can differ."""
        apart = self.most_apart(edge)
        return apart + 5 + apart // 8

    def spare(self, n: int, edge: int) -> int:
        """Groups that a set of n has in common, at least, with any set it links with for the class below `edge`."""
        both = n + (n * self.den // self.num if n < edge else edge - 1)
        return self.groups(edge) - (self.den - self.num) * both // (self.num + self.den)

    def schemes(self, n: int) -> list[int]:
        """Edges of the classes that the smaller set of a pair with a set of n can be in."""
        low = max(-(-self.num * n // self.den), 1)
        edges = self.class_edges(n)
        return [high for e, high in zip(edges, edges[1:], strict=False) if high > low and e <= n]

    def entries(self, n: int) -> int:
        """List entries of a set of n."""
        return sum(self.groups(edge) for edge in self.schemes(n))


def set_key(shingles: np.ndarray) -> int:
    """64-bit digest of a set, as a signed integer; equal sets have equal digests."""
    with np.errstate(over="ignore"):
        both = np.array([mix(shingles).sum(), mix(shingles ^ np.uint64(0x1F83D9ABFB41BD6B)).sum()], np.uint64)
        word = mix(both[:1] * np.uint64(3) + mix(both[1:]) + np.uint64(len(shingles)))
    return int(word.view(np.int64)[0])


def parity_bits(shingles: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each of 512 buckets: two sets differ by at least as many shingles as bits."""
    odd = np.bincount((shingles >> np.uint64(5)).astype(np.int64) & (64 * WORDS_OF_BITS - 1), minlength=64 * WORDS_OF_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def set_rows(docs: DataFrame, options: JaccardOptions) -> DataFrame:
    """One row per document: doc_id, n, key, the whole set if it is small, parities b0, b1, ... (0 without shingles)."""
    bits = [f"b{k}" for k in range(WORDS_OF_BITS)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(split_words(part.column("text")), options.width)
                parities = np.stack([parity_bits(s) for s in sets])
                small = [s if len(s) <= MOST_SMALL else s[:0] for s in sets]
                flat = np.concatenate([*small, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int32()),
                     pa.array([set_key(s) for s in sets], pa.int64()),
                     list_array(flat, [len(s) for s in small], pa.int64()),
                     *[pa.array(parities[:, k]) for k in range(WORDS_OF_BITS)]],
                    ["doc_id", "n", "key", "small", *bits],
                )
        give_back()

    key = docs.schema["doc_id"].dataType.simpleString()
    parity = ", ".join(f"{b} bigint" for b in bits)
    return docs.mapInArrow(read, f"doc_id {key}, n int, key bigint, small array<bigint>, {parity}")


def group_entries(sets: list[np.ndarray], options: JaccardOptions) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of the groups that sets are entered under in lists, the set each is of, its class and what may yet go.

    For a class of sizes, shingles are dealt by hash into more groups than the number of shingles in which two
    linked sets can differ, so at least one group is the same in both; a set is entered for each class that the
    smaller set of a pair with it can be in. A token is the sum of the hashes of a group's shingles, together with
    the class and the group. Of linked sets `spare` groups or more agree, so each may leave out all but one of so
    many, if all sets leave out what comes first in one order of the tokens: the last of those that agree stays in
    both. Empty groups come first, by token, and are left out here; then the longest lists (see `rare_entries`), by
    the number told last.
    """
    which = [(k, edge) for k, s in enumerate(sets) for edge in options.schemes(len(s))]
    owner = np.array([k for k, _ in which], np.int64)
    edges = np.array([e for _, e in which], np.int64)
    many = np.array([options.groups(e) for _, e in which], np.int64)
    spare = np.array([options.spare(len(sets[k]), e) - 1 for k, e in which], np.int64)
    sizes = np.array([len(s) for s in sets], np.int64)
    ends = np.cumsum(sizes)
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    n = sizes[owner]
    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    shingle = flat[np.repeat(ends[owner] - n, n) + inner]
    base = np.cumsum(many) - many
    at = (mix(shingle ^ np.uint64(0x3C6EF372FE94F82B)) % np.repeat(many, n).astype(np.uint64)).astype(np.int64) + np.repeat(base, n)
    total = np.zeros(int(many.sum()), np.uint64)
    np.add.at(total, at, mix(shingle))
    pair = np.repeat(np.arange(len(which)), many)
    group = np.arange(len(total)) - base[pair]
    tokens = mix(total + mix(edges[pair].astype(np.uint64) * np.uint64(1 << 32) + group.astype(np.uint64)))
    empty = np.flatnonzero(np.bincount(at, minlength=len(total)) == 0)
    empty = empty[np.lexsort((tokens[empty], pair[empty]))]
    of_pair = np.bincount(pair[empty], minlength=len(which))
    before = np.arange(len(empty)) - (np.cumsum(of_pair) - of_pair)[pair[empty]]
    entered = np.ones(len(total), bool)
    entered[empty[before < spare[pair[empty]]]] = False
    spare = spare - np.minimum(of_pair, spare)
    kept = pair[entered]
    return tokens[entered].view(np.int64), owner[kept], edges[kept], spare[kept]


def group_tokens(sets: list[np.ndarray], options: JaccardOptions) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that sets are entered under in lists, and the set each is of."""
    return group_entries(sets, options)[:2]


def list_entries(docs: DataFrame, options: JaccardOptions, smallest: int) -> DataFrame:
    """(token, key, edge, spare) of all sets of `smallest` shingles or more; a task enters equal sets once."""
    names = ["token", "key", "edge", "spare"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                sets, keys = [], []
                for found in shingle_sets(split_words(part.column("text")), options.width):
                    key = set_key(found) if len(found) >= smallest else None
                    if key is not None and key not in seen:
                        seen.add(key)
                        sets.append(found)
                        keys.append(key)
                if len(seen) > REMEMBERED:
                    seen = set()
                at = 0
                while at < len(sets):
                    stop, held = at, 0
                    while stop < len(sets) and (stop == at or held + len(sets[stop]) <= TOGETHER):
                        held += len(sets[stop])
                        stop += 1
                    tokens, owner, edges, spare = group_entries(sets[at:stop], options)
                    columns = [tokens, np.array(keys[at:stop], np.int64)[owner], edges.astype(np.int32), spare.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)
                    at = stop
        del seen
        give_back()

    return docs.select("text").mapInArrow(read, "token bigint, key bigint, edge int, spare int")


def subset_tokens(small: DataFrame, options: JaccardOptions) -> DataFrame:
    """(token, key, edge, spare) for every subset of every size class of small sets; edge and spare are 0.

    A subset's token is the sum of its hashes, made from the sum of all by taking away what is left
    out, together with the pair of sizes it is for.
    """
    names = ["token", "key", "edge", "spare"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, members in zip(batch["key"].to_pylist(), batch["small"].to_pylist(), strict=True):
                s = mix(np.array(members, np.int64).view(np.uint64))
                n, whole = len(s), s.sum()
                tokens = []
                for a, b in options.partner_classes(n):
                    left_out = n - options.least_overlap(a, b)
                    chosen = list(itertools.combinations(range(n), left_out))
                    picks = np.array(chosen, np.int64).reshape(len(chosen), left_out)
                    sums = whole - s[picks].sum(axis=1, dtype=np.uint64)
                    tokens.append(mix(sums + mix(np.array([a * 1_000_003 + b], np.uint64))))
                tokens = np.concatenate(tokens).view(np.int64)
                none = np.zeros(len(tokens), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (tokens, np.full(len(tokens), key), none, none)], names)

    return small.select("key", "small").mapInArrow(read, "token bigint, key bigint, edge int, spare int")


def choose_boundary(sigs: DataFrame, options: JaccardOptions) -> int:
    """Largest size that goes to the subset side, so that subsets and list entries made are fewest.

    Sets are counted per size (at most MOST_SMALL rows come to the driver).
    """
    sizes = sigs.where(F.col("n") <= MOST_SMALL).groupBy("n").agg(F.count("*").alias("sets"))
    table = {r["n"]: r["sets"] for r in sizes.collect()}
    costs = [sum(sets * options.entries(n) for n, sets in table.items())]
    for n in range(1, MOST_SMALL + 1):
        costs.append(costs[-1] + table.get(n, 0) * (options.subsets(n) - options.entries(n)))
    return int(np.argmin(costs))


def shared_entries(entries: DataFrame) -> DataFrame:
    """The entries (token, key, others) of lists of several keys, each once, with the list's smallest key as `pivot`.

    One exchange: lists stream through their tasks in order of token and key. Of a list that goes on in the next
    batch only its first entry and the last key are held, so a list of any length costs no memory.
    """
    others = [c for c in entries.columns if c not in ("token", "key")]
    names = ["token", "key", *others, "pivot"]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_list: tuple[int, int, list, int, bool] | None = None  # token, first key, its others, last key, told
        for batch in batches:
            if not batch.num_rows:
                continue
            token, key = (batch.column(c).to_numpy() for c in ("token", "key"))
            rest = [batch.column(c).to_numpy() for c in others]
            new = np.r_[True, token[1:] != token[:-1]]
            again = np.r_[False, (token[1:] == token[:-1]) & (key[1:] == key[:-1])]
            heads = np.flatnonzero(new)
            run = np.cumsum(new) - 1
            pivot, of_pivot = key[heads], [c[heads] for c in rest]
            told = np.zeros(len(heads), bool)
            if open_list is not None and open_list[0] == token[0]:
                _, pivot[0], held, last, told[0] = open_list
                again[0] = key[0] == last
                for column, value in zip(of_pivot, held, strict=True):
                    column[0] = value
            later = (key != pivot[run]) & ~again
            several = np.zeros(len(heads), bool)
            several[run[later]] = True
            first = several & ~told
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[token[heads[first]], token[later]]), pa.array(np.r_[pivot[first], key[later]]),
                 *[pa.array(np.r_[p[first], c[later]]) for p, c in zip(of_pivot, rest, strict=True)],
                 pa.array(np.r_[pivot[first], pivot[run[later]]])],
                names,
            )
            open_list = (int(token[-1]), int(pivot[-1]), [c[-1] for c in of_pivot], int(key[-1]), bool(told[-1] or several[-1]))

    ordered = entries.repartition("token").sortWithinPartitions("token", "key")
    kinds = "".join(f"{c} {entries.schema[c].dataType.simpleString()}, " for c in others)
    return ordered.mapInArrow(mark, f"token bigint, key bigint, {kinds}pivot bigint")


def rare_entries(shared: DataFrame) -> DataFrame:
    """(token, key, pivot, strength) of `shared` without the `spare` longest lists of each class and edge.

    Lists are ordered by length and token, the same for all classes, so linked sets keep a list in common (see
    `group_entries`); a passage that many sets have in common makes few groups of its own, and these go. `strength` is
    the length of all lists that the class has for the edge: the most central of several versions has the most.
    """
    length = shared.groupBy("token").agg(F.count("*").alias("_long"))
    of_set = W.partitionBy("key", "edge")
    ranked = shared.join(length, "token").select(
        "token", "key", "pivot", "spare", F.row_number().over(of_set.orderBy(F.desc("_long"), "token")).alias("_rank"),
        F.sum("_long").over(of_set).alias("strength"),
    )
    return ranked.where("_rank > spare").select("token", "key", "pivot", "strength")


def different_lists(placed: DataFrame) -> DataFrame:
    """(token, key, component) of the lists whose classes are in several components, one of each set of classes.

    `placed` has an entry once. Classes that agree in one group mostly do in many, and all these lists pair the same
    classes. A set of classes is known by two 64-bit digests and its size; its smallest token stands for it.
    """
    of_list = W.partitionBy("token")
    digests = [F.bit_xor(F.xxhash64(F.lit(seed), "key")).over(of_list).alias(f"_set{seed}") for seed in (1, 2)]
    listed = placed.select(
        "token", "key", "component", *digests, F.count("*").over(of_list).alias("_many"),
        F.min("component").over(of_list).alias("_least"), F.max("component").over(of_list).alias("_most"),
    ).where("_least <> _most")
    return listed.groupBy("_set1", "_set2", "_many", "key").agg(F.min("token").alias("token"), F.min("component").alias("component")).select(
        "token", "key", "component"
    )


def bits_apart(suffix: str) -> Column:
    return sum(F.bit_count(F.col(f"b{k}").bitwiseXOR(F.col(f"b{k}{suffix}"))) for k in range(WORDS_OF_BITS))


def plausible(pairs: DataFrame, sigs: DataFrame, options: JaccardOptions) -> DataFrame:
    """The pairs (a, b) whose sizes and full parities allow a link."""
    columns = ["n", *[f"b{k}" for k in range(WORDS_OF_BITS)]]
    one = sigs.select(F.col("key").alias("a"), *columns)
    two = sigs.select(F.col("key").alias("b"), *[F.col(c).alias(f"{c}_p") for c in columns])
    return pairs.join(one, "a").join(two, "b").where(may_link(options, "_p")).select("a", "b")


def may_link(options: JaccardOptions, other: str) -> Column:
    """Sizes are close enough and the parities differ in no more bits than linked sets can."""
    n, m = F.col("n"), F.col(f"n{other}")
    need = F.expr(f"({options.num} * (n + n{other}) + {options.num + options.den - 1}) div {options.num + options.den}")
    sizes = options.den * F.least(n, m) >= options.num * F.greatest(n, m)
    return sizes & (bits_apart(other) <= n + m - 2 * need)


def confirmed(pairs: DataFrame, texts: DataFrame, members: DataFrame, options: JaccardOptions) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""
    sets = freeze(candidate_sets(texts, members, pairs, options), "candidates")
    one = sets.select(F.col("key").alias("a"), F.col("shingles").alias("_one"))
    two = sets.select(F.col("key").alias("b"), F.col("shingles").alias("_two"))
    both = F.size(F.array_intersect("_one", "_two"))
    union = F.size("_one") + F.size("_two") - both
    return pairs.join(one, "a").join(two, "b").where(options.den * both >= options.num * union).select("a", "b")


def jaccard_groups(docs: DataFrame, options: JaccardOptions = JaccardOptions()) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document (columns doc_id, text; others are ignored).

    Words are separated by blanks and control characters 9 to 13, A-Z count as lower case; fewer
    words than a shingle has are one shingle. Null, empty and blank texts have no shingle, link with
    nothing and are their own component. component_id is the smallest doc_id linked directly or over
    other documents; every row gives one row, repeated and null ids too (a null id never names a
    component with another id in it). An empty table gives an empty result.

    Equal sets are one class, found by digest (64 bits), so copies are never paired. Classes up to a
    size chosen by cost meet by subsets of the size that a partner must share, larger ones in inverted
    lists, which are kept by groups of shingles (see group_tokens): a passage that many documents share
    does not make them meet, as it would in lists of single shingles. A list of many classes is not expanded into
    pairs: each class is first compared with one class of the list; only classes of a list that are then still in
    different components are compared with each other, if their sizes and parities allow a link, and lists of the same
    classes once. All candidates
    are confirmed on the whole sets, so parities cost no link.
    """
    texts = docs.select("doc_id", "text")
    rows = freeze(set_rows(texts, options), "sets")
    members = rows.select("doc_id", "n", "key")
    sigs = freeze(rows.where("n > 0").drop("doc_id").dropDuplicates(["key"]), "signatures")
    boundary = choose_boundary(sigs, options)
    reach = -(-options.num * (boundary + 1) // options.den)
    subsets = subset_tokens(sigs.where(F.col("n") <= boundary), options)
    shared = freeze(shared_entries(list_entries(texts, options, reach).unionByName(subsets)), "shared")
    rare = freeze(rare_entries(shared), "rare")
    strongest = rare.groupBy("token").agg(F.max_by("key", F.struct("strength", "key")).alias("strongest"))
    live = freeze(rare.join(strongest, "token").select("token", "key", "pivot", "strongest"), "entries")

    met = live.select(F.col("key").alias("a"), F.explode(F.array("pivot", "strongest")).alias("b")).where("a <> b").distinct()
    first = freeze(plausible(met, sigs, options), "pairs")
    groups = freeze(connected_components(confirmed(first, texts, members, options)), "groups")

    # of a list's pairs, those with the two classes that all others were compared with are done
    rest = live.where("key <> pivot AND key <> strongest").select("token", "key")
    placed = rest.join(groups.withColumnRenamed("node", "key"), "key", "left").withColumn(
        "component", F.coalesce("component", "key")
    )
    open_lists = freeze(different_lists(placed), "open").join(sigs.drop("small"), "key")
    other = open_lists.select("token", *[F.col(c).alias(f"{c}_p") for c in open_lists.columns if c != "token"])
    apart = (F.col("key") > F.col("key_p")) & (F.col("component") != F.col("component_p"))
    second = (
        open_lists.join(other, (open_lists["token"] == other["token"]) & apart & may_link(options, "_p"))
        .select(F.col("key").alias("a"), F.col("key_p").alias("b"))
        .distinct()
        .join(first, ["a", "b"], "left_anti")
    )
    more = confirmed(freeze(second, "pairs"), texts, members, options)
    merged = connected_components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    classes = members.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("_least"))
    named = freeze(
        classes.join(merged.withColumnRenamed("node", "key"), "key", "left").select(
            "key", "_least", F.coalesce("component", "key").alias("component")
        ),
        "classes",
    )
    smallest = named.groupBy("component").agg(F.min("_least").alias("component_id"))
    named = named.join(smallest, "component").select("key", "component_id")
    return members.join(named, "key", "left").select(
        "doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def candidate_sets(texts: DataFrame, members: DataFrame, pairs: DataFrame, options: JaccardOptions) -> DataFrame:
    """(key, shingles) of the classes in pairs: one document of each is read again."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    chosen = members.where("n > 0").join(wanted, "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("_doc"))
    found = freeze(chosen.select("_doc").distinct(), "chosen")
    again = texts.join(found, texts["doc_id"].eqNullSafe(found["_doc"]), "left_semi").select("text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [s for s in shingle_sets(split_words(part.column("text")), options.width) if len(s)]
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_key(s) for s in sets], pa.int64()), list_array(flat, [len(s) for s in sets], pa.int64())],
                    ["key", "shingles"],
                )

    return again.mapInArrow(read, "key bigint, shingles array<bigint>").dropDuplicates(["key"])


def keep_one(docs: DataFrame, options: JaccardOptions = JaccardOptions()) -> DataFrame:
    """`docs` with one row of each group: the one whose doc_id is the group's.

    Documents without words are kept. Rows that repeat both id and text count once; rows of one group
    that repeat only the id all stay, and so do all rows of a group without any id.
    """
    groups = freeze(jaccard_groups(docs, options), "groups")
    # written down, so that short lists are joined without moving the texts
    away = freeze(groups.where("n_shingles > 0 AND doc_id <> component_id").select("doc_id").distinct(), "away")
    repeated = groups.where("n_shingles > 0").groupBy("doc_id").count().where("count > 1").select("doc_id")
    repeated = freeze(repeated.where("doc_id IS NOT NULL"), "repeated")
    kept = docs.join(away, "doc_id", "left_anti").select(docs.columns)
    if repeated.isEmpty():
        return kept
    single = kept.join(repeated, "doc_id", "left_anti").select(docs.columns)
    return single.unionByName(
        kept.join(repeated, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"])
    )

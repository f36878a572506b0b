"""Language-model scores: words as lattices of subword pieces, all segmentations weighted."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelfx.llm.texts import byte_table, mix, slices, split_words
from panelfx.session import freeze

LOG10 = math.log(10.0)
# Words of a task are counted together until so many different ones are held.
COUNTED_TOGETHER = 400_000
# Lattice cells worked on together.
CELLS = 1 << 20


@dataclass(frozen=True)
class LatticeOptions:
    """`rounds` fits the piece scores to the training words, `head` is how many of the most frequent words
    are broadcast with their counts (8 + 8 bytes each; the rest meet their counts in a join), `floor`
    the pseudo-count of every piece.
    """

    rounds: int = 2
    head: int = 262_144
    floor: float = 0.1


class Pieces:
    """A piece vocabulary with log probabilities, looked up by hash together with all its prefixes.

    The hash of a span is a difference of running sums of byte terms, moved to power 0 by the inverse
    of its first power, so spans of any length are looked up without reading their bytes again.
    """

    BASE = 0x5851F42D4C957F2D
    SLOT_BITS = 20

    def __init__(self, pieces: list[bytes], scores: np.ndarray) -> None:
        self.scores = scores
        number = {p[:n]: -1 for p in pieces for n in range(1, len(p) + 1)}
        number.update({p: i for i, p in enumerate(pieces)})
        spans = list(number)
        ends = np.cumsum([len(p) for p in spans])
        starts = ends - [len(p) for p in spans]
        sums, inverse = self.running(np.frombuffer(b"".join(spans), np.uint8), starts, ends)
        keys = mix((sums[ends] - sums[starts]) * inverse[0])
        order = np.argsort(keys)
        self.keys, self.index = keys[order], np.fromiter(number.values(), np.int64, len(number))[order]
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces share a hash")
        slots = (self.keys >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)
        self.slots = np.searchsorted(slots, np.arange((1 << self.SLOT_BITS) + 1))
        self.fullest = int(np.diff(self.slots).max())

    def running(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Running sums of byte terms (powers count from each word's start), and inverse powers."""
        lengths = ends - starts
        most = int(lengths.max()) if len(lengths) else 1
        powers = np.cumprod(np.full(most, self.BASE, np.uint64))
        inverse = np.cumprod(np.full(most, pow(self.BASE, -1, 1 << 64), np.uint64))
        inner = np.arange(len(data)) - np.repeat(starts, lengths)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte_table()[data] * powers[inner])]), inverse

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece number of each key, -1 for a mere prefix of pieces, -2 for neither."""
        slot = (keys >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)
        out = np.full(len(keys), -2)
        at, end = self.slots[slot], self.slots[slot + 1]
        for k in range(self.fullest):
            place = np.minimum(at + k, len(self.keys) - 1)
            hit = (at + k < end) & (self.keys[place] == keys)
            out[hit] = self.index[place[hit]]
        return out

    def arcs(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every piece in words that fill `data`: its first byte, its length and its number."""
        sums, inverse = self.running(data, starts, ends)
        lengths = ends - starts
        alive = np.arange(len(data))
        inner, stop = alive - np.repeat(starts, lengths), np.repeat(ends, lengths)
        heads, sizes, found = [], [], []
        size = 0
        while len(alive):
            size += 1
            alive = alive[stop[alive] - alive >= size]
            number = self.find(mix((sums[alive + size] - sums[alive]) * inverse[inner[alive]]))
            whole = number >= 0
            heads.append(alive[whole])
            sizes.append(np.full(int(whole.sum()), size))
            found.append(number[whole])
            alive = alive[number > -2]
        nothing = np.zeros(0, np.int64)
        return np.concatenate([nothing, *heads]), np.concatenate([nothing, *sizes]), np.concatenate([nothing, *found])


def joined(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words one after the other, each with the blank before it."""
    lengths = np.array([len(w) + 1 for w in words], np.int64)
    ends = np.cumsum(lengths)
    return np.frombuffer(b"".join(b" " + w for w in words), np.uint8), ends - lengths, ends


@dataclass
class Lattice:
    """Arcs of many words, by the depth they end at and the cell they end in.

    Position p of word w is a cell; `to`, `size` and `piece` describe arcs, `heads` the first arc of
    every cell and `levels` the first cell of every depth; `first` and `last` are the words' end cells.
    """

    to: np.ndarray
    size: np.ndarray
    piece: np.ndarray
    heads: np.ndarray
    levels: np.ndarray
    first: np.ndarray
    last: np.ndarray


def build_lattice(pieces: Pieces, words: list[bytes]) -> Lattice:
    data, starts, ends = joined(words)
    head, size, piece = pieces.arcs(data, starts, ends)
    word = np.repeat(np.arange(len(words)), ends - starts)[head]
    depth = head + size - starts[word]
    to = head + size + word  # every word has one cell more than bytes
    order = np.lexsort((to, depth))
    to, size, piece, depth = to[order], size[order], piece[order], depth[order]
    heads = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
    levels = np.searchsorted(depth[heads], np.arange(1, int(depth.max()) + 2))
    first = starts + np.arange(len(words))
    return Lattice(to, size, piece, heads, levels, first, ends + np.arange(len(words)))


def forward_log(pieces: Pieces, lattice: Lattice) -> np.ndarray:
    """Log probability of reaching each cell: all words advance together, one byte at a time.

    The probability of a prefix is the sum over the pieces it may end with of the probability of what
    is before the piece times the piece's own.
    """
    forward = np.full(int(lattice.last[-1]) + 1, -np.inf)
    forward[lattice.first] = 0.0
    bounds = np.append(lattice.heads, len(lattice.to))
    for a, b in zip(lattice.levels[:-1].tolist(), lattice.levels[1:].tolist(), strict=True):
        low, high = bounds[a], bounds[b]
        heads = bounds[a:b] - low
        to = lattice.to[low:high]
        value = forward[to - lattice.size[low:high]] + pieces.scores[lattice.piece[low:high]]
        top = np.maximum.reduceat(value, heads)
        total = np.add.reduceat(np.exp(value - np.repeat(top, np.diff(bounds[a : b + 1]))), heads)
        forward[to[heads]] = top + np.log(total)
    return forward


def word_log_probabilities(pieces: Pieces, words: list[bytes]) -> np.ndarray:
    """Natural log of each word's marginal probability over all segmentations."""
    out = np.zeros(len(words))
    for a, b in portions(words):
        lattice = build_lattice(pieces, words[a:b])
        out[a:b] = forward_log(pieces, lattice)[lattice.last]
    return out


def expected_counts(pieces: Pieces, words: list[bytes], times: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the words' segmentations, words weighted by `times`."""
    out = np.zeros(len(pieces.scores))
    for a, b in portions(words):
        lattice = build_lattice(pieces, words[a:b])
        forward = forward_log(pieces, lattice)
        lengths = lattice.last - lattice.first + 1
        whole, weight = np.repeat(forward[lattice.last], lengths), np.repeat(times[a:b], lengths)
        backward = np.full(len(forward), -np.inf)
        backward[lattice.last] = 0.0
        bounds = np.append(lattice.heads, len(lattice.to))[lattice.levels]
        shares = np.zeros(len(lattice.to))
        for low, high in zip(bounds[-2::-1].tolist(), bounds[:0:-1].tolist(), strict=True):
            # no two arcs that end at one depth start in the same cell
            to = lattice.to[low:high]
            start = to - lattice.size[low:high]
            value = backward[to] + pieces.scores[lattice.piece[low:high]]
            share = np.exp(forward[start] + value - whole[start]) * weight[start]
            shares[low:high] = share
            backward[start] = np.logaddexp(backward[start], value)
        out += np.bincount(lattice.piece, shares, minlength=len(out))
    return out


def portions(words: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of words of about CELLS bytes."""
    at, held = 0, 0
    for i, word in enumerate(words):
        held += len(word) + 1
        if held >= CELLS:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(words):
        yield at, len(words)


def count_words(docs: DataFrame) -> DataFrame:
    """(key, word, c): how often each word (A-Z in lower case) occurs; one row for a hash of it and itself."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def flush() -> pa.RecordBatch:
            keys = np.fromiter(held, np.uint64, len(held)).view(np.int64)
            rows = list(held.values())
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64())],
                ["key", "word", "c"],
            )

        for batch in batches:
            for part in slices(batch, "text"):
                words = split_words(part.column("text"))
                keys, first, times = np.unique(words.hashes(), return_index=True, return_counts=True)
                for key, at, n in zip(keys.tolist(), first.tolist(), times.tolist(), strict=True):
                    entry = held.get(key)
                    if entry is None:
                        held[key] = [words.word(at), n]
                    else:
                        entry[1] += n
                if len(held) >= COUNTED_TOGETHER:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(read, "key bigint, word binary, c bigint").groupBy("key", "word").agg(F.sum("c").alias("c"))


def fit_pieces(counts: DataFrame, pieces: list[bytes], options: LatticeOptions) -> np.ndarray:
    """Log probabilities of the pieces, fitted to the counted words by expectation maximisation.

    The vocabulary's order is the first score (a piece of rank r has a share like 1 / (r + 1)). A round
    is one pass over the different words; the sums per piece, as many as the vocabulary has, pass through
    the driver. Every piece keeps a pseudo-count, so a text of any bytes has a probability.
    """
    spark = counts.sparkSession
    share = 1.0 / (np.arange(len(pieces)) + 1.0)
    scores = np.log(share / share.sum())
    for _ in range(options.rounds):
        shared = spark.sparkContext.broadcast((pieces, scores))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = Pieces(*shared.value)
            total = np.zeros(len(model.scores))
            for batch in batches:
                total += expected_counts(model, batch.column("word").to_pylist(), batch.column("c").to_numpy().astype(float))
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["piece", "times"])

        sums = counts.select("word", "c").mapInArrow(expect, "piece bigint, times double").groupBy("piece").agg(F.sum("times").alias("times")).toArrow()
        times = np.full(len(pieces), options.floor)
        times[sums["piece"].to_numpy()] += sums["times"].to_numpy()
        scores = np.log(times / times.sum())
        shared.unpersist()
    return scores


def lattice_scores(train: DataFrame, docs: DataFrame, pieces: list[bytes], options: LatticeOptions = LatticeOptions()) -> DataFrame:
    """Scores of `docs` (doc_id, text) by a model of the texts of `train`.

    The model: a text is its words (A-Z in lower case, split at blanks and controls 9 to 13) and an end.
    A word, with a blank before it, is any sequence of pieces that spells it; its probability is the sum
    over all of them of the product of the pieces' probabilities. The end competes with the words by
    its share of the training tokens. `pieces` has to hold all single bytes.

    Columns: doc_id, n_tokens (words and the end), n_known (those in training), train_tokens,
    base_score (word unigrams with half a count added, log10) and score (the model's log10
    probability). A null text is empty: its only token is the end. Every row gives one row, repeated
    ones too. Without training texts all counts are 0 and the pieces' order decides.
    """
    spark = docs.sparkSession
    counts = freeze(count_words(train), "words")
    ends = train.count()
    totals = counts.agg(F.count("*"), F.sum("c")).first()
    different, tokens = totals[0] + (ends > 0), (totals[1] or 0) + ends
    scores = fit_pieces(counts, pieces, options)
    head = counts.groupBy("key").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "key").limit(options.head).toArrow()
    order = np.argsort(head["key"].to_numpy().astype(np.int64).view(np.uint64))
    known_keys = head["key"].to_numpy().astype(np.int64).view(np.uint64)[order]
    known_counts = head["c"].to_numpy().astype(np.int64)[order]
    shared = spark.sparkContext.broadcast((pieces, scores, known_keys, known_counts))
    divisor = math.log10(tokens + 0.5 * (different + 1))
    end_share = (ends + 0.5) / (tokens + 1.0)
    word_share = math.log(1.0 - end_share) if end_share < 1 else 0.0
    has_end = ends > 0

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, values, keys, times = shared.value
        model = Pieces(vocabulary, values)
        seen: dict[int, float] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                words = split_words(part.column("text"))
                n = part.num_rows
                hashes = words.hashes()
                different, first, place = np.unique(hashes, return_index=True, return_inverse=True)
                if len(seen) > COUNTED_TOGETHER:
                    seen.clear()
                new = [k for k, h in enumerate(different.tolist()) if h not in seen]
                fresh = word_log_probabilities(model, [words.word(first[k]) for k in new])
                seen.update(zip(different[new].tolist(), fresh.tolist(), strict=True))
                marginal = np.array([seen[h] for h in different.tolist()]) if len(different) else np.zeros(0)
                at = np.minimum(np.searchsorted(keys, different), max(len(keys) - 1, 0))
                in_head = keys[at] == different if len(keys) else np.zeros(len(different), bool)
                c = np.where(in_head, times[at] if len(keys) else 0, 0)
                owner = np.repeat(np.arange(n), words.counts)
                counted = in_head[place]
                logs = np.log10(c + 0.5)
                base = np.bincount(owner[counted], logs[place][counted], minlength=n).astype(float)
                base += math.log10(ends + 0.5) - (words.counts + 1) * divisor
                known = np.bincount(owner[counted], minlength=n) + has_end
                total = np.bincount(owner, marginal[place] + word_share, minlength=n) + math.log(end_share)
                ids = part.column("doc_id")
                texts = part.column("text").to_pylist()
                rows = [xxhash.xxh64_intdigest(f"{i!r}\n{t or ''}") for i, t in zip(ids.to_pylist(), texts, strict=True)]
                row_keys = np.array(rows, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row_keys), ids, pa.array(words.counts + 1), pa.array(known.astype(np.int64)), pa.array(base),
                     pa.array(total / LOG10), pa.nulls(n, pa.int64()), pa.array(np.ones(n, np.int64))],
                    NAMES,
                )
                rare, many = np.unique(np.stack([owner[~counted], place[~counted]]), axis=1, return_counts=True)
                m = len(many)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row_keys[rare[0]]), pa.nulls(m, ids.type), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()),
                     pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64()), pa.array(different[rare[1]].view(np.int64)),
                     pa.array(many.astype(np.int64))],
                    NAMES,
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = freeze(
        docs.select("doc_id", "text").mapInArrow(
            score,
            f"row bigint, doc_id {kind}, n_tokens bigint, n_known bigint, base double, score double, key bigint, times bigint",
        ),
        "scored",
    )
    by_hash = counts.groupBy("key").agg(F.sum("c").alias("c"))
    tail = rows.where("key IS NOT NULL").select("row", "key", "times").join(by_hash, "key", "left")
    rest = tail.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("_base"),
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("_known"),
    )
    main = rows.where("key IS NULL").drop("key", "times")
    copies = main.groupBy("row").agg(F.count("*").alias("_copies"))
    # rows equal in id and text share their sums, so each gets an equal part
    rest = rest.join(copies, "row").select("row", F.col("_base") / F.col("_copies"), (F.col("_known") / F.col("_copies")).cast("bigint")).toDF("row", "_base", "_known")
    return main.join(rest, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(int(tokens)).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", F.lit(0.0))).alias("base_score"),
        "score",
    )


NAMES = ["row", "doc_id", "n_tokens", "n_known", "base", "score", "key", "times"]

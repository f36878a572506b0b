"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelfx.llm.texts import give_back, letter_gap_table, mix, slices, split_words
from panelfx.session import freeze


@dataclass(frozen=True)
class FtrlOptions:
    """Parameters of the model and of its training; max_train_docs bounds the labelled sample."""

    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.0
    rounds: int = 3
    max_train_docs: int = 12_000


def features(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all texts and the text each belongs to, with repetitions.

    Words are runs of letters, digits and non-ASCII characters, A-Z in lower case. A feature is a
    word, two neighbouring words, or two words with one between them.
    """
    words = split_words(texts, letter_gap_table())
    one = words.hashes()
    owner = np.repeat(np.arange(len(words.counts)), words.counts)
    found, owners = [one], [owner]
    for gap, tag in ((1, 0x632BE59BD9B4E019), (2, 0x9FB21C651E98DF25)):
        same = owner[gap:] == owner[:-gap]
        found.append(mix(one[:-gap] * np.uint64(tag) + one[gap:])[same])
        owners.append(owner[:-gap][same])
    return (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(owners)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


class Ftrl:
    """State of FTRL-proximal; the last coordinate is the bias, which L1 does not touch."""

    def __init__(self, options: FtrlOptions, z: np.ndarray | None = None, n: np.ndarray | None = None) -> None:
        size = (1 << options.bits) + 1
        self.options = options
        self.z = np.zeros(size) if z is None else z
        self.n = np.zeros(size) if n is None else n

    def weights(self, at: np.ndarray) -> np.ndarray:
        o, z = self.options, self.z[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - np.where(at == len(self.z) - 1, 0.0, o.l1), 0.0)
        return -shrunk / ((o.beta + np.sqrt(self.n[at])) / o.alpha + o.l2)

    def update(self, at: np.ndarray, label: float) -> None:
        """One document: `at` are its distinct features."""
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = float(sigmoid(w.sum())) - label
        root = np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])
        self.z[at] += g - root / self.options.alpha * w
        self.n[at] += g * g


@dataclass
class SparseWeights:
    """Non-zero weights by feature, and the bias: what is broadcast (at most 2**bits entries)."""

    bits: int
    index: np.ndarray
    value: np.ndarray
    bias: float


def sample_key(doc_id: Column) -> Column:
    return F.xxhash64(F.lit(20), doc_id)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, options: FtrlOptions) -> DataFrame:
    """At most max_train_docs labelled documents (text, label), chosen by a hash of the id, then of the text.

    Labels are reduced to one row per id (a repeated id with differing labels counts as positive) and
    to the bound before they meet the documents, so the broadcast side is at most that many ids. An id may
    occur in many rows: different texts of it are different documents, equal ones count once, and the
    bound holds for these. Null ids and null labels are left out; a null text is empty.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("double")).alias("_label"))
        .orderBy(sample_key(F.col("doc_id")), "doc_id")
        .limit(options.max_train_docs)
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("_text"))
    named = keyed.select("doc_id", "_text").join(F.broadcast(chosen), "doc_id").distinct()
    order = sample_key(F.col("doc_id"))
    few = freeze(named.orderBy(order, "doc_id", "_text").limit(options.max_train_docs), "chosen")
    return (
        keyed.join(F.broadcast(few), ["doc_id", "_text"])
        .dropDuplicates(["doc_id", "_text"])
        .select("text", "_label", order.alias("_key"))
    )


def train(sample: DataFrame, options: FtrlOptions) -> SparseWeights:
    """Fit on (text, _label, _key), which labelled_sample has bounded.

    FTRL is sequential: averaging models trained on parts shrinks them below the L1 threshold. So the
    sample is written once and every round streams through it in one task, batch by batch, in a
    hashed order of its own. The state, the coordinates that moved (2**bits at most), is written down after a
    round and comes first in the next one's stream; only non-zero weights reach the driver. Without
    documents the score is 0.5 everywhere.
    """
    packed = ["i", "z", "n"]
    sample = freeze(sample, "labelled").select("text", "_label", "_key", *[F.lit(None).cast("binary").alias(c) for c in packed])
    state: DataFrame | None = None

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ftrl(options)
        for batch in batches:
            known = np.flatnonzero(batch.column("i").is_valid().to_numpy(zero_copy_only=False))
            if len(known):
                for row in batch.select(packed).take(pa.array(known)).to_pylist():
                    at = np.frombuffer(row["i"], np.int64)
                    model.z[at], model.n[at] = np.frombuffer(row["z"]), np.frombuffer(row["n"])
                batch = batch.slice(int(known[-1]) + 1)
            for part in slices(batch, "text"):
                at, owner = features(part.column("text"), options.bits)
                order = np.argsort(owner, kind="stable")
                bounds = np.searchsorted(owner[order], np.arange(part.num_rows + 1))
                at = at[order]
                for row, label in enumerate(part.column("_label").to_pylist()):
                    model.update(np.unique(at[bounds[row] : bounds[row + 1]]), label)
        moved = np.flatnonzero(model.n)
        weights = model.weights(moved)
        # many coordinates a row: Spark moves some dozen rows, not a million
        for k in range(0, len(moved), 50_000):
            i = moved[k : k + 50_000]
            w = weights[k : k + 50_000]
            used = np.flatnonzero(w)
            arrays = [i, model.z[i], model.n[i], i[used], w[used]]
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays], [*packed, "used", "w"])

    for turn in range(options.rounds):
        rows = sample
        if state is not None:
            before = state.select(
                F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("_label"), F.lit(None).cast("bigint").alias("_key"), *packed
            )
            rows = before.unionByName(sample)
        ordered = rows.repartition(1).sortWithinPartitions(F.col("i").isNull(), F.xxhash64(F.lit(turn), "_key"), "_key", "text")
        state = freeze(ordered.mapInArrow(fit, "i binary, z binary, n binary, used binary, w binary"), "state")
    found = state.select("used", "w").collect() if state is not None else []
    index = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["used"], np.int64) for r in found)])
    value = np.concatenate([np.zeros(0), *(np.frombuffer(r["w"]) for r in found)])
    plain = index < 1 << options.bits
    return SparseWeights(options.bits, index[plain], value[plain], float(value[~plain].sum()))


def score_texts(docs: DataFrame, weights: SparseWeights, name: str = "score") -> DataFrame:
    """`docs` with the probability of label 1 of each whole text (null: as empty, the bias alone).

    A feature counts once per text however often it occurs. One pass without a shuffle; a column of
    the result's name is replaced, all other columns and all rows are kept.
    """
    kept = docs.drop(name)
    names = kept.columns
    shared = docs.sparkSession.sparkContext.broadcast((weights.bits, weights.index, weights.value, weights.bias))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = SparseWeights(*shared.value)
        dense = np.zeros(1 << w.bits)
        dense[w.index] = w.value
        for batch in batches:
            for part in slices(batch, "text"):
                at, owner = features(part.column("text"), w.bits)
                used = dense[at] != 0
                once = np.unique(owner[used] * (1 << w.bits) + at[used])
                sums = np.bincount(once >> w.bits, dense[once & ((1 << w.bits) - 1)], minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sigmoid(sums + w.bias))], [*names, name])
        give_back()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(score, f"{schema}, `{name}` double")


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    options: FtrlOptions = FtrlOptions(),
    name: str = "score",
) -> DataFrame:
    """Train on the labelled documents and score all of them: `docs` with a column `name`, 0 to 1.

    `docs` has doc_id and text, `labels` doc_id and the column `label`. Null and empty texts have the score of no
    words; null ids, ids without a label and null labels do not train; ids repeated in `labels` count once,
    as positive if any row is; of documents repeated with id and text one trains and all are scored. A column
    of the name of the result is replaced, all others stay. An empty table gives an empty result, and without
    labelled documents every score is 0.5.
    """
    return score_texts(docs, train(labelled_sample(docs, labels, label, options), options), name)

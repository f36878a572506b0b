"""Document fingerprints: invertible Bloom lookup sketches of paragraph cells, subtracted and peeled."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelfx.llm.texts import hash_spans, mix, space_table
from panelfx.operators.ordering import range_index, running_total

HASHES = 3
# Texts handled together in a task, in bytes.
TOGETHER = 1 << 20


@dataclass(frozen=True)
class SketchOptions:
    """Cells of the sketch that is the fingerprint, and how paragraphs are cut.

    A line is a paragraph, and a paragraph ends early after a word whose hash is 0 modulo `cut`, so
    that an edit within a long line changes only the cells around it. When peeling fails, both sketches
    are made anew with `growth` times the cells.
    """

    cells: int = 24
    cut: int = 4
    growth: int = 4


def paragraph_keys(raw: list[bytes], options: SketchOptions) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all paragraphs of all texts, and how many each text has.

    Digests are of a text's paragraph and how often it has come before in the text, so all digests of a
    text differ and a repeated paragraph counts as often as it occurs.
    """
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    word = ~space_table()[data]
    before = np.concatenate([[False], word])
    before[offsets] = False
    after = np.concatenate([word, [False]])
    after[offsets] = False
    starts = np.flatnonzero(word & ~before[:-1])
    ends = np.flatnonzero(word & ~after[1:]) + 1
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(raw), np.int64)
    hashes = hash_spans(data, starts, ends)
    lines = np.cumsum(data == 10)
    last = np.zeros(len(starts), bool)
    last[first[1:][np.diff(first) > 0] - 1] = True
    last[:-1] |= lines[starts[1:]] != lines[starts[:-1]]
    last |= hashes % np.uint64(options.cut) == 0
    heads = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    # the sum of hashes mixed with their place in the paragraph identifies its word sequence
    place = np.arange(len(starts)) - np.repeat(heads, np.diff(np.append(heads, len(starts))))
    keys = np.add.reduceat(mix(hashes + mix(place.astype(np.uint64) + np.uint64(1))), heads)
    text = np.searchsorted(first, heads, "right") - 1
    order = np.lexsort((keys, text))
    k, t = keys[order], text[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (t[1:] != t[:-1])])
    runs = np.flatnonzero(new)
    nth = np.arange(len(k)) - np.repeat(runs, np.diff(np.append(runs, len(k))))
    return mix(k + mix(nth.astype(np.uint64))), np.bincount(t, minlength=len(raw))


def check_of(keys: np.ndarray) -> np.ndarray:
    return mix(keys ^ np.uint64(0x2545F4914F6CDD1D))


def places(keys: np.ndarray, cells: int) -> np.ndarray:
    """Cell of each key for each of the hashes, every one in a third of its own."""
    third = cells // HASHES
    return np.stack([
        (mix(keys + np.uint64(k * 1_000_003 + cells)) % np.uint64(third)).astype(np.int64) + k * third for k in range(HASHES)
    ])


def sketches(keys: np.ndarray, counts: np.ndarray, cells: int) -> list[np.ndarray]:
    """Counts, key sums and check sums of every text's cells, sums modulo 2**64."""
    n = len(counts)
    at = places(keys, cells) + np.repeat(np.arange(n), counts) * cells
    out = [np.bincount(at.ravel(), minlength=n * cells).astype(np.int64)]
    for values in (keys, check_of(keys)):
        total = np.zeros(n * cells, np.uint64)
        for row in at:
            np.add.at(total, row, values)
        out.append(total)
    return [a.reshape(n, cells) for a in out]


def peel(difference: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Recover what subtracted sketches hold, all texts at once.

    Returns whether each text's sketch came out empty, how many keys it held with each sign, and the keys
    (text and digest, those of the first version positive) that were recovered.
    """
    n, cells = difference[0].shape
    count, key, check = (a.reshape(-1).copy() for a in difference)
    plus, minus = np.zeros(n, np.int64), np.zeros(n, np.int64)
    texts, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    active = np.arange(n * cells)
    while len(active):
        active = active[np.abs(count[active]) == 1]
        sign = count[active]
        value = np.where(sign < 0, np.uint64(0) - key[active], key[active])
        proof = np.where(sign < 0, np.uint64(0) - check[active], check[active])
        pure = check_of(value) == proof
        digest, sign, who = value[pure], sign[pure], active[pure] // cells
        if not len(digest):
            break
        # a key may show in several of its cells and is taken once
        order = np.lexsort((digest, who))
        digest, sign, who = digest[order], sign[order], who[order]
        once = np.concatenate([[True], (digest[1:] != digest[:-1]) | (who[1:] != who[:-1])])
        digest, sign, who = digest[once], sign[once], who[once]
        proofs = check_of(digest)
        touched = []
        for row in places(digest, cells):
            at = who * cells + row
            np.add.at(count, at, -sign)
            np.add.at(key, at, np.where(sign < 0, digest, np.uint64(0) - digest))
            np.add.at(check, at, np.where(sign < 0, proofs, np.uint64(0) - proofs))
            touched.append(at)
        plus += np.bincount(who[sign > 0], minlength=n)
        minus += np.bincount(who[sign < 0], minlength=n)
        texts.append(np.where(sign > 0, who, -who - 1))
        found.append(digest)
        active = np.unique(np.concatenate(touched))
    empty = ~((count != 0) | (key != 0) | (check != 0)).reshape(n, cells).any(axis=1)
    return empty, plus, minus, np.concatenate(texts), np.concatenate(found)


def chosen(keys: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of some of the texts."""
    ends = np.cumsum(counts)
    n = counts[rows]
    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return keys[np.repeat(ends[rows] - n, n) + inner], n


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], options: SketchOptions) -> np.ndarray:
    """Shared paragraphs over all paragraphs of two versions of each text, from their subtracted sketches.

    Texts whose difference does not peel out of the sketches get larger ones until it does. Two texts
    without paragraphs are alike (1).
    """
    n = len(a[1])
    out = np.ones(n)
    rows, cells = np.arange(n), options.cells
    while len(rows):
        later = []
        # tables of one round stay within a few megabytes
        step = max(1, (1 << 18) // cells)
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            one, two = chosen(*a, some), chosen(*b, some)
            difference = [x - y for x, y in zip(sketches(*one, cells), sketches(*two, cells), strict=True)]
            empty, plus, minus, _, _ = peel(difference)
            both = one[1] - plus
            union = both + plus + minus
            good = empty & (both == two[1] - minus)
            out[some[good]] = np.where(union[good] > 0, both[good] / np.maximum(union[good], 1), 1.0)
            later.append(some[~good])
        rows = np.concatenate(later)
        cells *= options.growth
    return out


def spelled(sketch: list[np.ndarray], row: int) -> str:
    """A text's sketch as a string: the cells' counts, key sums and check sums in base 64."""
    raw = sketch[0][row].astype("<u4").tobytes() + sketch[1][row].astype("<u8").tobytes() + sketch[2][row].astype("<u8").tobytes()
    return base64.b64encode(raw).decode()


def edited(text: str, following: str) -> str:
    """The text whose last third (rounded down) is the next document's beginning instead."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def in_order(docs: DataFrame, parts: int) -> DataFrame:
    """(part, guest, doc_id, text) by descending doc_id, each part followed by the first rows of the next.

    Every part starts at an id at an equal distance from the last one in the order; for that the ids
    alone are ranked, and only these starts come to the driver. Rows with a part's first id also go to
    the part before it as guests, those with the largest id to the last part. Null ids come last.
    Texts are shuffled once.
    """
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").distinct()
    total = ids.count()
    step = max(1, -(-total // parts))
    ranked = running_total(ids, ["doc_id"], F.lit(1), "_rank")
    chosen_ids = ranked.where((total - 1 - F.col("_rank")) % step == 0).select("doc_id").collect()
    starts = sorted((r["doc_id"] for r in chosen_ids), reverse=True)
    last = max(len(starts) - 1, 0)
    if starts:
        # starts descend, their complements ascend
        part = F.when(F.col("doc_id").isNull(), last).otherwise(range_index(F.bitwise_not("doc_id"), [~s for s in starts[1:]]))
        first = F.element_at(F.split(F.lit(",".join(map(str, starts))), ",").cast("array<bigint>"), F.col("_part") + 1)
        guest = F.when(F.col("doc_id") == first, F.when(F.col("_part") > 0, F.col("_part") - 1).otherwise(last))
    else:
        part, guest = F.lit(0), F.lit(0)
    placed = docs.select("doc_id", "text").withColumn("_part", part.cast("int")).withColumn("_guest", guest.cast("int"))
    places_of = F.array(
        F.struct(F.col("_part").alias("part"), F.lit(False).alias("guest")),
        F.struct(F.col("_guest").alias("part"), F.lit(True).alias("guest")),
    )
    rows = F.explode(F.filter(places_of, lambda r: r["part"].isNotNull()))
    spread = placed.select("doc_id", "text", rows.alias("_row")).select("_row.part", "_row.guest", "doc_id", "text")
    return spread.repartition(parts, "part").sortWithinPartitions("part", "guest", F.desc_nulls_last("doc_id"), "text")


def version_fingerprints(docs: DataFrame, options: SketchOptions = SketchOptions()) -> DataFrame:
    """Fingerprints of every document (doc_id, text) and of its edited text, and their likeness.

    The next document is the one of the next smaller doc_id (after the smallest: the one of the largest;
    rows of one id in the order of their texts, null ids last). Columns: doc_id, n_chars (code points),
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. A null text is empty; texts
    without words have an empty sketch, which is like another empty one (1) and unlike all others (0).
    Equal texts have equal fingerprints. Every row gives one row; a single document follows itself.
    """
    spark = docs.sparkSession
    parts = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        size, tag, closed = 0, None, False
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("part", "guest", "doc_id", "text"))
            for part, guest, doc_id, text in zip(*columns, strict=True):
                if part != tag:
                    ids, texts, size, tag, closed = [], [], 0, part, False
                if closed:
                    continue
                ids.append(doc_id)
                texts.append(text or "")
                size += len(texts[-1])
                # a guest completes its part; otherwise the last text held waits for its next one
                closed = guest
                if len(ids) > 1 and (closed or size >= TOGETHER):
                    yield compared(ids[:-1], texts, options)
                    ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return in_order(narrow, parts).mapInArrow(
        compare,
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )


def compared(ids: list, texts: list[str], options: SketchOptions) -> pa.RecordBatch:
    """Rows of len(ids) texts; texts has one more, the next of the last."""
    n = len(ids)
    changed = [edited(texts[i], texts[i + 1]) for i in range(n)]
    raw, raw_changed = [t.encode() for t in texts], [t.encode() for t in changed]
    keys, counts = paragraph_keys(raw, options)
    mine = chosen(keys, counts, np.arange(n))
    following = chosen(keys, counts, np.arange(1, n + 1))
    other = paragraph_keys(raw_changed, options)
    prints, other_prints = sketches(*mine, options.cells), sketches(*other, options.cells)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64()),
         pa.array([hashlib.sha256(r).hexdigest() for r in raw_changed], pa.string()),
         pa.array([spelled(prints, i) for i in range(n)], pa.string()),
         pa.array([spelled(other_prints, i) for i in range(n)], pa.string()),
         pa.array(likeness(mine, other, options)), pa.array(likeness(mine, following, options))],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )

"""Whole texts as numpy arrays: words, their hashes and hashes of word sequences.

The functions run inside Arrow tasks. A batch is cut into slices of a few megabytes, so memory does
not depend on how many rows Spark puts into a batch; a single text is never cut.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
HASH_BYTES = 1 << 20
SEED = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """Bit mixer for unsigned 64-bit values."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def byte_table() -> np.ndarray:
    return mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(SEED))


def space_table() -> np.ndarray:
    """True for the bytes that separate words: blank and the controls 9 to 13."""
    table = np.zeros(256, bool)
    table[[9, 10, 11, 12, 13, 32]] = True
    return table


def letter_gap_table() -> np.ndarray:
    """True for every ASCII byte that is neither a letter nor a digit."""
    table = np.zeros(256, bool)
    table[[b for b in range(128) if not chr(b).isalnum()]] = True
    return table


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `limit` bytes of text, one row at least; nulls count as empty."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, stop - at)
        at = stop


@dataclass
class Words:
    """Words of several texts: byte spans in `data`, and the index of each text's first word."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return hash_spans(self.data, self.starts, self.ends)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after the other, and the offset of each text (and the end)."""
    whole = pc.fill_null(texts, "").cast(pa.large_binary())
    _, offsets, data = whole.buffers()
    at = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def split_words(texts: pa.Array, gaps: np.ndarray | None = None, lower: bool = True) -> Words:
    """Maximal runs of bytes that `gaps` does not mark (default: white space); A-Z in lower case."""
    data, offsets = text_bytes(texts)
    if lower:
        data = lower_table()[data]
    inside = ~(space_table() if gaps is None else gaps)[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    before[offsets] = False
    after[offsets] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each non-empty byte span, about a megabyte of bytes at a time."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    lengths = ends - starts
    total = np.cumsum(lengths)
    table = byte_table()
    base = np.uint64(0x5851F42D4C957F2D)
    powers = np.ones(0, np.uint64)
    at = 0
    while at < len(starts):
        before = total[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(total, before + HASH_BYTES, "right")))
        n = lengths[at:stop]
        heads = total[at:stop] - n - before
        inner = np.arange(int(n.sum())) - np.repeat(heads, n)
        if n.max() > len(powers):
            powers = np.cumprod(np.full(int(n.max()), base, np.uint64))
        terms = table[data[np.repeat(starts[at:stop], n) + inner]] * powers[inner]
        out[at:stop] = mix(np.add.reduceat(terms, heads) + n.astype(np.uint64) * np.uint64(SEED))
        at = stop
    return out


def hash_runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` neighbouring hashes (one per position that has them all)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + hashes[k : k + n])
    return out


def shingle_sets(words: Words, width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its `width`-word shingles.

    A text with fewer words has its whole word sequence as one shingle, a text without words none.
    """
    hashes = words.hashes()
    runs = hash_runs(hashes, width)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(runs[a : b - width + 1]))
        else:
            out.append(hash_runs(hashes[a:b], b - a) if b > a else runs[:0])
    return out


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Arrow lists of the given lengths over consecutive values."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def unused(stem: str, names: list[str]) -> str:
    """A column name that is not among `names`, whatever the case."""
    taken = {n.lower() for n in names}
    while stem.lower() in taken:
        stem += "_"
    return stem


def give_back() -> None:
    """Return what a finished task has freed to the system: workers go on living, and their heaps would add up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)

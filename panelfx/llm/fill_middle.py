"""Fill-in-middle rows: cuts between tokens, found through a learned rank index over their boundaries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelfx.llm.texts import slices, space_table, text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# Residuals are kept as signed bytes.
ERROR = 127


@dataclass(frozen=True)
class FimOptions:
    """`seed` starts the hashed string; of 100 documents `rate` are cut, of 100 of these `spm` suffix first."""

    seed: int = 42
    rate: int = 50
    spm: int = 80


class RankIndex:
    """Offset of every boundary of several texts, as straight pieces and one byte of residual each.

    A piece covers ranks of one text; its line runs through its first and last offset, moved so that
    residuals lie around zero, and no residual is beyond ERROR: a piece that cannot keep to that is
    halved (two boundaries always can). A rank's offset is the rounded line plus the stored residual,
    which is exact.
    """

    def __init__(self, values: np.ndarray, heads: np.ndarray) -> None:
        """`values`: offsets of all texts one after the other; `heads`: index of each text's first."""
        self.residual = np.zeros(len(values), np.int8)
        starts, ends = heads[:-1], heads[1:]
        done: list[tuple[np.ndarray, ...]] = []
        while len(starts):
            sizes = ends - starts
            slope = (values[ends - 1] - values[starts]) / np.maximum(sizes - 1, 1)
            first = np.cumsum(sizes) - sizes
            step = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
            at = np.repeat(starts, sizes) + step
            off = values[at] - self.line(np.repeat(values[starts], sizes), np.repeat(slope, sizes), step)
            low, high = np.minimum.reduceat(off, first), np.maximum.reduceat(off, first)
            fits = high - low <= 2 * ERROR
            shift = (low + high) // 2
            inside = np.repeat(fits, sizes)
            self.residual[at[inside]] = (off - np.repeat(shift, sizes))[inside]
            done.append((starts[fits], (values[starts] + shift)[fits], slope[fits]))
            left, right = starts[~fits], ends[~fits]
            middle = (left + right) // 2
            starts, ends = np.concatenate([left, middle]), np.concatenate([middle, right])
        first, base, slope = (np.concatenate(c) for c in zip(*done, strict=True)) if done else (np.zeros(0, np.int64),) * 3
        order = np.argsort(first)
        self.first, self.base, self.slope = first[order], base[order], slope[order]

    @staticmethod
    def line(base: np.ndarray, slope: np.ndarray, step: np.ndarray) -> np.ndarray:
        return base + np.floor(slope * step + 0.5).astype(np.int64)

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        """Offsets at these indices: predicted by the piece, corrected by the residual."""
        piece = np.searchsorted(self.first, ranks, "right") - 1
        predicted = self.line(self.base[piece], self.slope[piece], ranks - self.first[piece])
        return predicted + self.residual[ranks]


def boundaries(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, text offsets, boundary offsets within the text (0 first, then each token's end), first boundary of each text.

    A token is a word (bytes without blanks and the controls 9 to 13) with the white space before it, or
    the white space that ends a text.
    """
    data, offsets = text_bytes(texts)
    blank = space_table()[data]
    ends = np.zeros(len(data) + 1, bool)
    # a word ends before white space or with its text, white space only with its text
    ends[1:-1] = ~blank[:-1] & blank[1:]
    ends[offsets] = True
    places = np.flatnonzero(ends)
    filled = np.diff(offsets) > 0
    after = np.searchsorted(places, offsets[:-1], "right")
    tokens = np.where(filled, np.searchsorted(places, offsets[1:], "right") - after, 0)
    heads = np.concatenate([[0], np.cumsum(tokens + 1)])
    values = np.zeros(heads[-1], np.int64)
    inner = np.ones(heads[-1], bool)
    inner[heads[:-1]] = False
    nth = np.arange(int(tokens.sum())) - np.repeat(np.cumsum(tokens) - tokens, tokens)
    values[inner] = places[np.repeat(after, tokens) + nth] - np.repeat(offsets[:-1], tokens)
    return data, offsets, values, heads


def draws(doc_ids: list, seed: int) -> np.ndarray:
    """Four numbers a document: the first 8-digit groups of the SHA-256 of `seed:doc_id` (a null id is no digits)."""
    raw = [hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).digest()[:16] for d in doc_ids]
    return np.frombuffer(b"".join(raw), ">u4").reshape(-1, 4).astype(np.int64)


def fill_in_middle(docs: DataFrame, options: FimOptions = FimOptions()) -> DataFrame:
    """Every document (doc_id, text) cut at two of its token boundaries and put into an order for infilling.

    Columns: doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (code points, null if
    plain), output. A document is plain if it is empty, holds a mark or is not drawn. A null text is
    empty, a null doc_id is hashed as no digits, repeated rows give equal rows, other columns are left out
    whatever their names. One pass without a shuffle; boundaries of a few megabytes of text are indexed
    at a time, those of a single long text at once.
    """

    def rearrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield rearranged(part.column("doc_id"), part.column("text"), options)

    narrow = docs.select("doc_id", "text")
    key = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(
        rearrange,
        f"doc_id {key}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string",
    )


def rearranged(doc_ids: pa.Array, texts: pa.Array, options: FimOptions) -> pa.RecordBatch:
    data, offsets, values, heads = boundaries(texts)
    n = np.diff(heads) - 1
    drawn = draws(doc_ids.to_pylist(), options.seed)
    index = RankIndex(values, heads)
    cuts = np.sort(drawn[:, :2] % (n + 1)[:, None], axis=1)
    first, second = (index.offsets(heads[:-1] + cuts[:, k]) for k in (0, 1))
    raw = data.tobytes()
    forms, prefix_chars, middle_chars, outputs = [], [], [], []
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        text = raw[a:b]
        if a == b or drawn[i, 2] % 100 >= options.rate or any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE)):
            forms.append("plain")
            prefix_chars.append(None)
            middle_chars.append(None)
            outputs.append(text.decode())
            continue
        prefix, middle, suffix = (t.decode() for t in (text[: first[i]], text[first[i] : second[i]], text[second[i] :]))
        prefix_chars.append(len(prefix))
        middle_chars.append(len(middle))
        if drawn[i, 3] % 100 < options.spm:
            forms.append("spm")
            outputs.append(f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}")
        else:
            forms.append("psm")
            outputs.append(f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}")
    return pa.RecordBatch.from_arrays(
        [doc_ids, pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(prefix_chars, pa.int64()),
         pa.array(middle_chars, pa.int64()), pa.array(outputs, pa.string())],
        ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
    )


def restored(output: Column | str, form: Column | str) -> Column:
    """The text before its parts were put in order; a null form or output gives null.

    A text that was cut holds no mark, and marks cannot overlap, so each occurs once.
    """
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    head, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    psm = F.concat(
        F.substring_index(F.substring_index(head, SUFFIX, 1), PREFIX, -1), middle, F.substring_index(head, SUFFIX, -1)
    )
    spm = F.concat(
        F.substring_index(head, PREFIX, -1), middle, F.substring_index(F.substring_index(head, PREFIX, 1), SUFFIX, -1)
    )
    return F.when(form == "psm", psm).when(form == "spm", spm).when(form == "plain", output)

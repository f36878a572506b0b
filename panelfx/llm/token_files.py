"""Token-id files: one array of ids a shard, with Elias-Fano coded document boundaries and document ids."""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelfx.llm.texts import slices
from panelfx.operators.ordering import running_total
from panelfx.session import freeze, scratch_path

MAGIC = b"EFIDS\x00\x01\n"
# One in so many positions of the upper bits is sampled for select.
SAMPLE = 512
# Bytes of ids that a reading task holds at a time, a single document excepted.
READ_BYTES = 4 << 20
BLOCK_DOCS = 8192
# Rows whose mean size tells how many shards a table needs.
SIZED_ROWS = 4096
# Bounds of the words a task remembers.
MAX_WORDS = 500_000
MAX_WORD = 64


# ---- bits

def pack(values: np.ndarray, width: int) -> bytes:
    """Unsigned values of `width` bits (0 to 63) one after the other, lowest bit first, in whole words."""
    bits = len(values) * width
    words = np.zeros(-(-bits // 64) + 1, np.uint64)
    if bits:
        values = values.astype(np.uint64)
        at = np.arange(len(values), dtype=np.uint64) * np.uint64(width)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.bitwise_or.at(words, word, values << shift)
        over = np.flatnonzero(shift + np.uint64(width) > np.uint64(64))
        np.bitwise_or.at(words, word[over] + 1, values[over] >> (np.uint64(64) - shift[over]))
    return words[:-1].tobytes()


def unpack(raw: bytes | memoryview, width: int, first: int, last: int) -> np.ndarray:
    """Values first to last (exclusive) of what `pack` wrote."""
    if not width or last <= first:
        return np.zeros(max(last - first, 0), np.uint64)
    low, high = first * width // 64, -(-last * width // 64)
    words = np.append(np.frombuffer(raw, "<u8", high - low, low * 8), np.uint64(0))
    at = np.arange(first, last, dtype=np.uint64) * np.uint64(width) - np.uint64(low * 64)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    upper = np.where(shift > 0, words[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    return ((words[word] >> shift) | upper) & np.uint64((1 << width) - 1)


class EliasFano:
    """A nondecreasing sequence in about 2 + log2(range / length) bits a value.

    The lower bits are packed side by side; the upper bits are a bit vector with a one at
    (upper part + index) for each value. Every SAMPLE-th one's place is kept, in as many bits as the
    longest place needs, so a value is found by scanning from the sample before it.
    """

    HEAD = "<qqQBBqq"

    def __init__(self, raw: bytes | memoryview) -> None:
        raw = memoryview(raw)
        self.n, self.least, span, self.width, self.place_bits, low_bytes, high_bytes = struct.unpack_from(self.HEAD, raw)
        at = struct.calcsize(self.HEAD)
        self.low, at = raw[at : at + low_bytes], at + low_bytes
        self.high, at = raw[at : at + high_bytes], at + high_bytes
        self.samples = raw[at:]

    @classmethod
    def encode(cls, values: np.ndarray) -> bytes:
        values = np.asarray(values, np.int64)
        n = len(values)
        least = int(values[0]) if n else 0
        span = int(values[-1]) - least if n else 0
        if n and (np.diff(values) < 0).any() and (values[1:] < values[:-1]).any():
            raise ValueError("values have to be in ascending order")
        # differences of 64-bit integers fit in 64 bits without a sign
        parts = values.astype(np.uint64) - np.uint64(least & (2**64 - 1))
        width = min(max((span // n).bit_length() - 1, 0), 63) if n else 0
        places = (parts >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = int(places[-1]) + 1 if n else 0
        upper = np.zeros(-(-bits // 8), np.uint8)
        np.bitwise_or.at(upper, places >> 3, (1 << (places & 7)).astype(np.uint8))
        place_bits = bits.bit_length()
        low = pack(parts & np.uint64((1 << width) - 1), width)
        samples = pack(places[::SAMPLE], place_bits)
        return struct.pack(cls.HEAD, n, least, span, width, place_bits, len(low), len(upper)) + low + upper.tobytes() + samples

    def select(self, first: int, last: int) -> np.ndarray:
        """Values first to last (exclusive)."""
        if not 0 <= first <= last <= self.n:
            raise IndexError(f"{first} to {last} of {self.n} values")
        if first == last:
            return np.zeros(0, np.int64)
        sample = first // SAMPLE
        start = int(unpack(self.samples, self.place_bits, sample, sample + 1)[0]) // 8
        wanted, found, held = last - sample * SAMPLE, [], 0
        at = start
        before = int(unpack(self.samples, self.place_bits, sample, sample + 1)[0])
        while held < wanted:
            # a few bits a value: mostly one round
            step = max(64, (wanted - held) // 2)
            ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high[at : at + step], np.uint8), bitorder="little")) + at * 8
            ones = ones[ones >= before]
            found.append(ones)
            held, at = held + len(ones), at + step
        places = np.concatenate(found)[first - sample * SAMPLE : wanted]
        upper = (places - np.arange(first, last)).astype(np.uint64) << np.uint64(self.width)
        parts = upper | unpack(self.low, self.width, first, last)
        return (parts + np.uint64(self.least & (2**64 - 1))).astype(np.int64)

    def __getitem__(self, i: int) -> int:
        return int(self.select(i, i + 1)[0])

    def rank(self, value: int) -> int:
        """How many values are smaller."""
        low, high = 0, self.n
        while low < high:
            middle = (low + high) // 2
            if self[middle] < value:
                low = middle + 1
            else:
                high = middle
        return low


# ---- files

def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given as a plain path or a URI."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class TokenWriter:
    """Writes one file: magic, ids, boundaries, document ids, a footer and its length.

    Ids go to the file as they come; of each document only its end and id are held until the file is
    closed. Null document ids come first.
    """

    def __init__(self, files: fs.FileSystem, path: str, id_type: str) -> None:
        self.out = files.open_output_stream(path)
        self.out.write(MAGIC)
        self.id_type = np.dtype(id_type)
        self.ends: list[np.ndarray] = []
        self.doc_ids: list[int] = []
        self.nulls = 0
        self.n_ids = 0

    def add(self, doc_ids: Sequence[int | None], ids: list[bytes]) -> None:
        """Documents whose ids are given as little-endian unsigned 32-bit integers."""
        sizes = np.array([len(i) for i in ids], np.int64) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        if len(flat) and flat.max() > np.iinfo(self.id_type).max:
            raise ValueError(f"ids do not fit into {self.id_type}")
        self.out.write(flat.astype(self.id_type).tobytes())
        self.ends.append(self.n_ids + np.cumsum(sizes))
        known = [d for d in doc_ids if d is not None]
        self.nulls += len(doc_ids) - len(known)
        self.doc_ids += known
        self.n_ids += len(flat)

    def close(self) -> tuple[int, int]:
        """Documents and ids written."""
        ends = np.concatenate([np.zeros(1, np.int64), *self.ends])
        bounds, names = EliasFano.encode(ends), EliasFano.encode(np.array(self.doc_ids, np.int64))
        about = {"docs": len(ends) - 1, "ids": self.n_ids, "nulls": self.nulls, "id_type": self.id_type.str, "bounds": len(bounds), "names": len(names)}
        footer = json.dumps(about).encode()
        self.out.write(bounds + names + footer + struct.pack("<q", len(footer)) + MAGIC)
        self.out.close()
        return len(ends) - 1, self.n_ids


class TokenFile:
    """Reads a file of `TokenWriter`: its ends are held coded, ids are read where they are asked for."""

    def __init__(self, files: fs.FileSystem, path: str) -> None:
        self.file = files.open_input_file(path)
        size = self.file.size()
        tail = struct.calcsize("<q") + len(MAGIC)
        end = self.file.read_at(tail, size - tail)
        if end[8:] != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{path} is not a file of token ids")
        (length,) = struct.unpack("<q", end[:8])
        about = json.loads(self.file.read_at(length, size - tail - length))
        self.docs, self.n_ids, self.nulls = about["docs"], about["ids"], about["nulls"]
        self.id_type = np.dtype(about["id_type"])
        coded = self.file.read_at(about["bounds"] + about["names"], size - tail - length - about["bounds"] - about["names"])
        self.bounds, self.names = EliasFano(coded[: about["bounds"]]), EliasFano(coded[about["bounds"] :])

    def doc_ids(self, first: int, last: int) -> list[int | None]:
        nulls = max(min(last, self.nulls) - first, 0)
        return [None] * nulls + self.names.select(max(first - self.nulls, 0), max(last - self.nulls, 0)).tolist()

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start to end (exclusive) of the shard."""
        width = self.id_type.itemsize
        return np.frombuffer(self.file.read_at((end - start) * width, len(MAGIC) + start * width), self.id_type)

    def doc(self, i: int) -> np.ndarray:
        """Ids of the i-th document."""
        start, end = self.bounds.select(i, i + 2).tolist()
        return self.ids(start, end)

    def find(self, doc_id: int) -> np.ndarray | None:
        """Ids of the first document with this id, None if there is none."""
        at = self.names.rank(doc_id)
        if at == self.names.n or self.names[at] != doc_id:
            return None
        return self.doc(at + self.nulls)


# ---- encoding

class LibraryEncoder:
    """Ids of whole texts by a tokenizer of the `tokenizers` library, with `end_id` after each.

    Where the tokenizer lower-cases, splits by one pattern and looks at nothing across its matches, each distinct
    match is encoded once: all new ones of a batch go through the library as one text. That is so for
    words of ASCII and Latin-1 letters, digits and signs, whose case and classes no version of Unicode changes;
    a word with any other character goes through the library as a whole. Other tokenizers encode whole
    texts. Strings of special tokens within texts are ordinary text.
    """

    SAFE = re.compile("[\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
    SPACE = re.compile("[\t-\r ]+")
    # What the pattern's classes are among safe characters in lower case.
    CLASSES = (("\\p{L}", "a-z\u00df-\u00f6\u00f8-\u00ff"), ("\\p{N}", "0-9"))

    def __init__(self, spec: str, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True
        self.end = np.array([end_id], "<u4").tobytes()
        self.known: dict[str, bytes] = {}
        self.pattern, self.suffix = self.word_pattern(json.loads(spec))
        if self.pattern:
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(self.suffix)]] = True

    @staticmethod
    def word_pattern(spec: dict) -> tuple[re.Pattern | None, str]:
        """The pattern whose matches are encoded for themselves, for safe words, and the mark of a match's last token."""
        steps = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        suffix = spec["model"].get("end_of_word_suffix")
        fits = (
            steps == ["NFC", "Replace", "Lowercase"]
            and [s["type"] for s in split] == ["Split", "ByteLevel"]
            and (split[0]["behavior"], split[0]["invert"]) == ("Removed", True)
            and not (split[1]["add_prefix_space"] or split[1]["use_regex"])
            and suffix
            and spec.get("post_processor") is None
            and not spec["model"].get("dropout")
        )
        if not fits:
            return None, ""
        pattern = split[0]["pattern"]["Regex"]
        for name, members in LibraryEncoder.CLASSES:
            pattern = pattern.replace(name, members)
        return (None, "") if "\\p" in pattern else (re.compile(pattern), suffix)

    def library(self, texts: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", c.ids).tobytes() for c in coded]

    def learn(self, pieces: list[str]) -> None:
        """Ids of new matches, from one text in which blanks part them."""
        raw = self.library([" ".join(pieces)])[0]
        ends = ((np.flatnonzero(self.ends[np.frombuffer(raw, "<u4")]) + 1) * 4).tolist()
        if len(ends) != len(pieces):
            self.known.update(zip(pieces, self.library(pieces), strict=True))
            return
        self.known.update(zip(pieces, [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))

    def split(self, text: str, unsafe: set[str]) -> list[str]:
        """The matches of a text, words that are not safe as they are; these are added to `unsafe`."""
        if self.SAFE.fullmatch(text):
            return self.pattern.findall(text.lower())
        out: list[str] = []
        for word in self.SPACE.split(text):
            if not self.SAFE.fullmatch(word):
                unsafe.add(word)
                out.append(word)
            elif word:
                out += self.pattern.findall(word.lower())
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not self.pattern:
            return [r + self.end for r in self.library(texts)]
        if len(self.known) > MAX_WORDS:
            self.known.clear()
        unsafe: set[str] = set()
        split = [self.split(t, unsafe) for t in texts]
        new = set().union(*split) - self.known.keys() - unsafe
        short = [w for w in new if len(w) <= MAX_WORD]
        for at in range(0, len(short), 16_384):
            self.learn(short[at : at + 16_384])
        others = [*unsafe, *(w for w in new if len(w) > MAX_WORD)]
        table = self.known
        if others:
            table = dict(table)
            for at in range(0, len(others), 1024):
                some = others[at : at + 1024]
                table.update(zip(some, self.library(some), strict=True))
        return [b"".join([*map(table.__getitem__, words), self.end]) for words in split]


@dataclass(frozen=True)
class TokenFileOptions:
    """`shard_bytes`: bytes of text a shard should hold (a document is never cut); `id_type`: as numpy names it."""

    end_id: int = 2
    id_type: str = "<u2"
    shard_bytes: int = 256 << 20
    least_bytes: int = 32 << 20


def write_token_files(docs: DataFrame, folder: str, spec: str, options: TokenFileOptions = TokenFileOptions()) -> DataFrame:
    """Encode documents (doc_id, text) and write their ids to files below `folder` in ascending doc_id order.

    `spec` is the tokenizer as JSON. Rows are dealt into ranges of (doc_id, text hash, row); each task
    encodes its range and writes one file under a name of its own, and only the files of the attempts
    that Spark commits are in the returned manifest: shard, file, n_docs, n_ids, base (ids before the
    shard). A lost or repeated task leaves at most a file that nothing lists. Null texts are empty, so only
    the end id is written for them; null ids come first; rows of one id are in the order of their texts'
    hashes, and repeated rows are all kept. Other columns are left out. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    files, where = open_folder(folder)
    files.create_dir(where, recursive=True)
    shared = spark.sparkContext.broadcast(spec)
    narrow = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    rows = docs.count()
    if not rows:
        return spark.createDataFrame([], "shard int, file string, n_docs bigint, n_ids bigint, base bigint")
    # only the number of shards follows from this estimate
    size = int(rows * narrow.select(F.octet_length("text").alias("n")).limit(SIZED_ROWS).agg(F.avg("n")).first()[0])
    wanted = 2 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    shards = max(min(wanted, size // options.least_bytes), size // options.shard_bytes, 1)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, root = open_folder(folder)
        encode = LibraryEncoder(shared.value, options.end_id)
        shard, writer, name = TaskContext.get().partitionId(), None, f"shard-{uuid.uuid4().hex}.ids"
        for batch in batches:
            for part in slices(batch, "text"):
                if writer is None:
                    writer = TokenWriter(target, f"{root}/{name}", options.id_type)
                writer.add(part.column("doc_id").to_pylist(), encode(part.column("text").to_pylist()))
        if writer is not None:
            n_docs, n_ids = writer.close()
            yield pa.RecordBatch.from_pylist(
                [{"shard": shard, "file": name, "n_docs": n_docs, "n_ids": n_ids}],
                pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
            )

    order = [F.asc_nulls_first("doc_id"), F.col("_hash"), F.col("_row")]
    keyed = narrow.withColumn("_hash", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    written = (
        keyed.repartitionByRange(shards, *order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
        .mapInArrow(write, "shard int, file string, n_docs bigint, n_ids bigint")
    )
    return running_total(freeze(written, "shards"), ["shard"], F.col("n_ids"), "base")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of the files, ids as little-endian 32-bit integers.

    `start` counts the ids of all documents before it. A task reads blocks of documents: their boundaries
    are selected from the coded sequence, and their ids are read in pieces of a few megabytes. Repeated
    rows come back as often as they were written, null ids as null.
    """
    spark = manifest.sparkSession
    blocks = manifest.where("n_docs > 0").select(
        "file", "base", "n_docs", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_docs") - 1, F.lit(BLOCK_DOCS).cast("bigint"))).alias("first")
    )
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, root = open_folder(folder)
        for batch in batches:
            for row in batch.to_pylist():
                yield from read_block(TokenFile(source, f"{root}/{row['file']}"), row["base"], row["first"], min(row["first"] + BLOCK_DOCS, row["n_docs"]))

    return blocks.repartition(parts, "file", "first").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def read_block(file: TokenFile, base: int, first: int, last: int) -> Iterator[pa.RecordBatch]:
    bounds = file.bounds.select(first, last + 1)
    names = file.doc_ids(first, last)
    limit = READ_BYTES // 4
    at = 0
    while at < len(names):
        stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        stop = min(stop, len(names))
        flat = file.ids(int(bounds[at]), int(bounds[stop])).astype("<u4")
        edges = pa.py_buffer(((bounds[at : stop + 1] - bounds[at]) * 4).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[at:stop], pa.int64()), pa.array(base + bounds[at:stop], pa.int64()),
             pa.array(np.diff(bounds[at : stop + 1]), pa.int64()),
             pa.Array.from_buffers(pa.binary(), stop - at, [None, edges, pa.py_buffer(flat)])],
            ["doc_id", "start", "n_tokens", "ids"],
        )
        at = stop


def token_file_rows(docs: DataFrame, spec: str, options: TokenFileOptions = TokenFileOptions()) -> DataFrame:
    """Write documents to a new folder of the shared scratch folder and read them back."""
    folder = scratch_path(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder, spec, options), folder)

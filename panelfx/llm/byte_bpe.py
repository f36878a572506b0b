"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decoding."""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from panelfx.llm.texts import give_back, slices

# Bounds of what one task remembers between texts; beyond them it starts anew.
MAX_STATES = 400_000
MAX_MATCHES = 400_000
# Above every rank.
NEVER = 1 << 62


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank from a file of `base64 rank` lines (ranks 0, 1, 2, ... without gaps)."""
    with open(path, "rb") as lines:
        pairs = [(int(rank), base64.b64decode(text)) for text, rank in map(bytes.split, lines)]
    pairs.sort()
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks have gaps")
    return [text for _, text in pairs]


def merge_plain(text: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The definition: merge the neighbouring pair of lowest rank (the leftmost of them) until none is left."""
    parts = [text[i : i + 1] for i in range(len(text))]
    while len(parts) > 1:
        best = min((ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if best[0] == NEVER:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return [ranks[p] for p in parts]


NO_EDGES: dict = {}


class State:
    """What the transducer knows after some bytes of a match.

    `suffix` is the longest end of the bytes read that some token starts with: a token that is still
    growing starts within it. `live` holds the positions within that suffix where the next token may
    start, as (bytes back, last token before it, tokens before it that have not been emitted).
    """

    __slots__ = ("edges", "final", "live", "suffix")

    def __init__(self, suffix: bytes, live: tuple) -> None:
        self.suffix = suffix
        self.live = live
        # most states are ends of words, which nothing follows
        self.edges: dict[int, tuple[State, tuple[int, ...]]] = NO_EDGES
        self.final: tuple[int, ...] = live[-1][2]


class Transducer:
    """The merges of a byte-level BPE vocabulary as a finite-state transducer, determinised as needed.

    Every prefix of a text has one encoding, and it ends with the one token that is a suffix of the
    prefix and may follow the encoding before it; two tokens may be neighbours if merging their joined
    bytes gives them back. A non-deterministic automaton would guess where the growing token starts.
    A state here is the set of these guesses; a transition emits the tokens on which all of them
    agree. A guess older than the longest token is gone, so output lags by a bounded number of bytes.
    """

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        self.ranks = {text: rank for rank, text in enumerate(tokens)}
        self.prefixes = {text[:n] for text in tokens for n in range(len(text) + 1)}
        self.halves: dict[int, tuple[int, int]] = {}
        self.neighbours: dict[tuple[int, int], bool] = {}
        self.start: State | None = None
        self.states: dict[tuple, State] = {}
        self.restart()

    def restart(self) -> None:
        # States live until the next restart: looking for garbage among them every 2,000 objects is in vain.
        gc.set_threshold(200_000, 50, 50)
        self.close()
        self.start = State(b"", ((0, -1, ()),))

    def close(self) -> None:
        """Forget all states. They refer to each other in circles, and would else wait for the garbage collector."""
        for state in self.states.values():
            state.edges = NO_EDGES
        if self.start is not None:
            self.start.edges = NO_EDGES
        self.states.clear()
        self.neighbours.clear()

    def split(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one (of two bytes or more)."""
        known = self.halves.get(token)
        if known is None:
            text = self.tokens[token]
            inner = (text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1) if j - i < len(text))
            parts = merge_plain(text, {t: self.ranks[t] for t in inner if t in self.ranks})
            if len(parts) != 2:
                raise ValueError(f"token {token} can't be made by one merge")
            known = self.halves[token] = parts[0], parts[1]
        return known

    def may_follow(self, left: int, right: int) -> bool:
        """Whether `left`, `right` is the encoding of their joined bytes.

        It is unless some merge crosses their border first. The pieces at the border are looked at from
        the last pair of them back to single bytes: a pair stands until one of its pieces is merged
        into the larger one (of rank `over`), and it merges if its own rank comes before that.
        """
        if left < 0:
            return True
        pair = left, right
        known = self.neighbours.get(pair)
        if known is None:
            tokens = self.tokens
            over_left = over_right = NEVER
            while True:
                rank = self.ranks.get(tokens[left] + tokens[right], NEVER)
                if rank < over_left and rank <= over_right and rank < NEVER:
                    known = False
                    break
                one, two = len(tokens[left]) > 1, len(tokens[right]) > 1
                if one and (left > right or not two):
                    over_left, left = left, self.split(left)[1]
                elif two:
                    over_right, right = right, self.split(right)[0]
                else:
                    known = True
                    break
            self.neighbours[pair] = known
        return known

    def step(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        """Determinise one transition and keep it."""
        read = state.suffix + bytes([byte])
        for back, last, waiting in state.live:
            text = read[len(read) - back - 1 :]
            token = self.ranks.get(text)
            if token is not None and self.may_follow(last, token):
                end = (0, token, (*waiting, token))
                break
        else:
            raise ValueError("no token fits: the vocabulary lacks single bytes")
        suffix = next(read[i:] for i in range(len(read) + 1) if read[i:] in self.prefixes)
        live = [(back + 1, last, waiting) for back, last, waiting in state.live if back + 1 <= len(suffix)]
        live.append(end)
        first = live[0][2]
        agreed = len(first)
        for _, _, waiting in live:
            while waiting[:agreed] != first[:agreed]:
                agreed -= 1
        out = first[:agreed]
        key = suffix, tuple(live) if not agreed else tuple((back, last, waiting[agreed:]) for back, last, waiting in live)
        target = self.states.get(key)
        if target is None:
            target = self.states[key] = State(*key)
        if state.edges is NO_EDGES:
            state.edges = {}
        state.edges[byte] = target, out
        return target, out

    def encode(self, text: bytes) -> list[int]:
        """Token ids of one match."""
        if len(self.states) > MAX_STATES:
            self.restart()
        out: list[int] = []
        state = self.start
        for byte in text:
            edge = state.edges.get(byte)
            if edge is None:
                edge = self.step(state, byte)
            state = edge[0]
            if edge[1]:
                out.extend(edge[1])
        out.extend(state.final)
        return out


class Matcher:
    """All matches of a pattern, as the `regex` library finds them.

    For texts of ASCII and Latin-1 characters alone, whose classes are the same in every version of Unicode, the
    standard library finds the same matches in half the time, with the classes spelled out.
    """

    SAFE = re.compile("[\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
    CLASSES = (("\\p{L}", "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"), ("\\p{N}", "0-9"))

    def __init__(self, pattern: str) -> None:
        self.findall_any = regex.compile(pattern).findall
        self.findall_safe = None
        plain, depth, at = "", 0, 0
        while at < len(pattern):
            known = next((c for c in self.CLASSES if pattern.startswith(c[0], at)), None)
            if known:
                plain += known[1] if depth else f"[{known[1]}]"
                at += len(known[0])
                continue
            step = 2 if pattern[at] == "\\" else 1
            depth += {"[": 1, "]": -1}.get(pattern[at], 0) if step == 1 else 0
            plain += pattern[at : at + step]
            at += step
        # other properties, flags and set operations are left to the other library
        if not re.search(r"\\[pPX]|\(\?[a-zA-Z]|--|&&|\|\||\[\[", plain):
            self.findall_safe = re.compile(plain).findall

    def findall(self, text: str) -> list[str]:
        if self.findall_safe is not None and self.SAFE.fullmatch(text):
            return self.findall_safe(text)
        return self.findall_any(text)


class Packed(dict):
    """Ids of a match as little-endian 32-bit integers, made when first asked for."""

    def __init__(self, transducer: Transducer) -> None:
        super().__init__()
        self.transducer = transducer

    def __missing__(self, match: str) -> bytes:
        ids = np.array(self.transducer.encode(match.encode()), "<u4").tobytes()
        if len(match) <= 64:
            if len(self) >= MAX_MATCHES:
                self.clear()
            self[match] = ids
        return ids


class Utf8Stream:
    """Incremental UTF-8: bytes in any cut go in, whole characters come out.

    Between feeds it holds the unfinished character (at most three bytes); the bytes it still waits
    for follow from the first of them. Bytes that can't be UTF-8 come out as U+FFFD.
    """

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def wanted(first: int) -> int:
        """Length of the character that starts with this byte; 0 for a continuation or invalid byte."""
        if first < 0x80:
            return 1
        return 2 if 0xC2 <= first < 0xE0 else 3 if 0xE0 <= first < 0xF0 else 4 if 0xF0 <= first < 0xF5 else 0

    def feed(self, more: bytes) -> str:
        data = self.held + more
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            need = self.wanted(data[-back])
            if need:
                cut -= back if need > back else 0
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        held, self.held = self.held, b""
        return held.decode("utf-8", "replace")


def decode_chunks(ids: np.ndarray, tokens: list[bytes], chunk: int = 65_536) -> Iterator[bytes]:
    """Bytes of the ids, a bounded number of tokens at a time."""
    for at in range(0, len(ids), chunk):
        yield b"".join(map(tokens.__getitem__, ids[at : at + chunk].tolist()))


def decode_text(chunks: Iterable[bytes]) -> Iterator[str]:
    """Characters of a byte stream that may be cut within characters."""
    stream = Utf8Stream()
    for chunk in chunks:
        yield stream.feed(chunk)
    yield stream.close()


def encode_text(pattern: Matcher, packed: Packed, text: str) -> bytes:
    """Packed ids of a whole text."""
    return b"".join(map(packed.__getitem__, pattern.findall(text)))


def with_token_ids(docs: DataFrame, tokens: list[bytes], pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """`docs` with an array<int> column of token ids; null and empty texts give an empty array.

    An existing column of that name is replaced.
    """
    kept = docs.drop(ids)
    shared = docs.sparkSession.sparkContext.broadcast(tokens)
    names = kept.columns

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, packed = Matcher(pattern), Packed(Transducer(shared.value))
        for batch in batches:
            for part in slices(batch, text):
                coded = [np.frombuffer(encode_text(matcher, packed, t or ""), "<u4") for t in part.column(text).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(c) for c in coded])]).astype(np.int32)
                flat = np.concatenate([*coded, np.zeros(0, "<u4")]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [*names, ids]
                )
        packed.transducer.close()
        packed.clear()
        give_back()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(encode, f"{schema}, `{ids}` array<int>")


def with_texts(docs: DataFrame, tokens: list[bytes], ids: str = "token_ids", text: str = "text") -> DataFrame:
    """`docs` with the decoded text of an array<int> column; a null or empty array gives an empty text.

    Ids outside the vocabulary raise. An existing column of that name is replaced.
    """
    kept = docs.drop(text)
    shared = docs.sparkSession.sparkContext.broadcast(tokens)
    names = kept.columns

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = []
                for value in part.column(ids):
                    row = np.array(value.values, np.int64) if value.is_valid else np.zeros(0, np.int64)
                    if len(row) and row.min() < 0:
                        raise IndexError("negative token id")
                    texts.append("".join(decode_text(decode_chunks(row, shared.value))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*names, text])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(decode, f"{schema}, `{text}` string")


def token_digests(docs: DataFrame, tokens: list[bytes], pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: n_tokens, SHA-256 of the packed ids, SHA-256 of the bytes they decode to.

    Every row gives one row, in one pass without a shuffle; a null text counts as empty, whose digests
    are those of no bytes. Long texts are decoded piece by piece. Other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokens)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        matcher, packed = Matcher(pattern), Packed(Transducer(vocabulary))
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, coded, decoded = array("q"), [], []
                for value in part.column("text").to_pylist():
                    raw = encode_text(matcher, packed, value or "")
                    ids = np.frombuffer(raw, "<u4")
                    back = hashlib.sha256()
                    for characters in decode_text(decode_chunks(ids, vocabulary)):
                        back.update(characters.encode())
                    sizes.append(len(ids))
                    coded.append(hashlib.sha256(raw).hexdigest())
                    decoded.append(back.hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(coded), pa.array(decoded)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        packed.transducer.close()
        packed.clear()
        give_back()

    narrow = docs.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text")
    key = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(digest, f"doc_id {key}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from panelfx.llm.byte_bpe import Matcher, Transducer, Utf8Stream, merge_plain, read_ranks, token_digests, with_texts, with_token_ids

PATTERN = public_tokenizers.PATTERN
FILES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]
TEXTS = ["", None, "Hello  world's\n\n\ttest 123", "é漢字😀 ￿\x1c\x85", "a" * 20_000 + "xy" * 500, " ", "'ll 'LL ſK", "<|endoftext|>"]


def reference(name):
    with open(public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", FILES)
def test_random_texts_as_the_library_has_them(name):
    tokens, library, rng = read_ranks(public_tokenizers.path(name)), reference(name), random.Random(1)
    transducer, matcher = Transducer(tokens), regex.compile(PATTERN)
    alphabet = "abehTHE  \n\t\r'sdé漢字😀_-=0129  \x1c\x85ſK"
    for _ in range(800):
        text = "".join(rng.choice(alphabet) if rng.random() < 0.8 else chr(rng.choice([rng.randrange(1, 0xD7FF), rng.randrange(0xE000, 0x10FFFF)])) for _ in range(rng.randrange(40)))
        assert [i for m in matcher.findall(text) for i in transducer.encode(m.encode())] == library.encode_ordinary(text)


def test_every_token_is_its_own_encoding():
    tokens = read_ranks(public_tokenizers.path(FILES[0]))
    transducer = Transducer(tokens)
    assert all(transducer.encode(t) == [i] for i, t in enumerate(tokens))


def test_neighbours_by_the_definition():
    tokens, rng = read_ranks(public_tokenizers.path(FILES[0])), random.Random(2)
    transducer = Transducer(tokens)
    for _ in range(3000):
        text = rng.choice(tokens) + rng.choice(tokens)
        cut = rng.randrange(1, len(text))
        if text[:cut] in transducer.ranks and text[cut:] in transducer.ranks:
            pair = [transducer.ranks[text[:cut]], transducer.ranks[text[cut:]]]
            assert transducer.may_follow(*pair) == (merge_plain(text, transducer.ranks) == pair)


def test_small_memory_gives_the_same(monkeypatch):
    import panelfx.llm.byte_bpe as module

    monkeypatch.setattr(module, "MAX_STATES", 50)
    transducer = Transducer(read_ranks(public_tokenizers.path(FILES[0])))
    library = reference(FILES[0])
    for text in ["internationalisation", " tokenization", "aaaaabbbbb", "zqxj" * 30]:
        assert transducer.encode(text.encode()) == library.encode_ordinary(text)


def test_utf8_in_any_cut():
    data, rng = "aé漢😀z\u0000".encode() * 3, random.Random(3)
    for _ in range(200):
        stream, out, at = Utf8Stream(), "", 0
        while at < len(data):
            n = rng.randrange(1, 6)
            out += stream.feed(data[at : at + n])
            at += n
        assert out + stream.close() == data.decode() and stream.held == b""
    stream = Utf8Stream()
    assert stream.feed(b"a\xe6\xbc") == "a" and stream.close() == "�"


def test_digests_and_round_trip(spark):
    docs = spark.createDataFrame([(k, t, "mine") for k, t in enumerate(TEXTS)] + [(0, "", "x"), (None, "n", "x")], "doc_id bigint, text string, n_tokens string")
    tokens, library = read_ranks(public_tokenizers.path(FILES[0])), reference(FILES[0])
    rows = token_digests(docs, tokens, PATTERN).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = "n" if r.doc_id is None else TEXTS[r.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    coded = with_token_ids(docs, tokens, PATTERN)
    assert {r.doc_id: r.token_ids for r in coded.collect()}[2] == library.encode_ordinary(TEXTS[2])
    back = with_texts(coded.withColumnRenamed("text", "was"), tokens)
    assert all(r.text == (r.was or "") for r in back.collect())
    assert token_digests(docs.limit(0), tokens, PATTERN).count() == 0


def test_plain_texts_have_the_same_matches():
    """Texts of every safe character, against the other library; patterns with other classes go to it at once."""
    import random

    matcher, library = Matcher(PATTERN), regex.compile(PATTERN)
    assert matcher.findall_safe is not None
    rng = random.Random(1)
    letters = [chr(k) for k in range(256) if Matcher.SAFE.fullmatch(chr(k))] + [" "] * 20 + ["'"] * 9 + list("sdmtlvre") * 3
    texts = ["".join(rng.choice(letters) for _ in range(80)) for _ in range(3000)]
    texts += ["\x1c a\x85b\xa0c", "ª²µº½", "ΑΣ 12 ½", "a\r\n \n b  ", "", "\t\t"]
    assert all(matcher.findall(t) == library.findall(t) for t in texts)
    for other in (r"\p{Lu}+", r"(?i:a)\p{L}", r"[[:alpha:]]+"):
        assert Matcher(other).findall_safe is None


def test_states_are_forgotten_with_their_task():
    """No circle of states waits for the garbage collector."""
    import gc
    import weakref

    class Probe(dict):
        pass

    transducer = Transducer([bytes([k]) for k in range(256)] + [b"ab", b"abc"])
    probes = []
    for word in (b"abcab", b"xyzabc"):
        transducer.encode(word)
    for state in transducer.states.values():
        if state.edges:
            state.edges = Probe(state.edges)
            probes.append(weakref.ref(state.edges))
    assert probes
    gc.disable()
    try:
        del state
        transducer.close()
        assert all(p() is None for p in probes) and not transducer.states
    finally:
        gc.enable()

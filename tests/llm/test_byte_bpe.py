"""Byte-level BPE against the tiktoken library."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken

from stridelab.llm import byte_bpe
from stridelab.llm import queries as Q
from stridelab.llm.common import read

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def lines() -> bytes:
    with open(PATH, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def other(lines):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.parse_ranks(lines), special_tokens={})


@pytest.fixture(scope="module")
def vocabulary(lines):
    return byte_bpe.Vocabulary(lines, P.PATTERN)


def ids(packed: bytes) -> list[int]:
    return np.frombuffer(packed, dtype="<u4").tolist()


def noise(rng: random.Random, n: int) -> str:
    kinds = ["abcdeinrst ", "éàßöçñ ", "中文字 ", "0123456789", " \n\t\r 　", "!?.,;'\"-", "\U0001f600\U00020000", "IDtehr'sll've "]
    return "".join(rng.choice(rng.choice(kinds)) for _ in range(n))


def test_texts_equal_the_library(vocabulary, other):
    rng = random.Random(2)
    texts = ["", " ", "  a", "it's we'll", "<|endoftext|>", "\x00\x01", "a" * 20_000, " " * 5_000, "\n" * 999, *(noise(rng, rng.randrange(80)) for _ in range(3000))]
    for text in texts:
        got = vocabulary.encode(text)
        assert ids(got) == other.encode_ordinary(text), text[:80]
        assert vocabulary.decode(got) == text.encode()


def test_bytes_equal_the_library(vocabulary, other):
    rng = random.Random(3)
    for _ in range(4000):
        piece = bytes(rng.choice(b"aeinrst the") if rng.random() < 0.6 else rng.randrange(256) for _ in range(rng.randrange(1, 50)))
        assert ids(vocabulary.encoder.encode(piece)) == other._core_bpe.encode_single_piece(piece)


def test_forgetting_changes_nothing(lines, other, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MOVES", 200)
    monkeypatch.setattr(byte_bpe, "KEPT", 5)
    small, rng = byte_bpe.Vocabulary(lines, P.PATTERN), random.Random(4)
    for _ in range(300):
        text = noise(rng, 60)
        assert ids(small.encode(text)) == other.encode_ordinary(text)
    assert len(small.encoder.moves) <= 200 + 300 and len(small.kept) <= 5


def test_a_small_vocabulary_with_overlapping_merges():
    ranks = {bytes([b]): b for b in range(256)}
    ranks |= {name: 256 + k for k, name in enumerate([b"ab", b"bc", b"abc", b"cc", b"aa", b"aaa", b"bca", b"abab"])}
    other = tiktoken.Encoding("small", pat_str=".+", mergeable_ranks=ranks, special_tokens={})
    encoder, rng = byte_bpe.Encoder(ranks), random.Random(5)
    for _ in range(3000):
        piece = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 15)))
        assert ids(encoder.encode(piece)) == other._core_bpe.encode_single_piece(piece), piece


def test_told_after_bounded_lookahead(vocabulary, lines):
    """No state waits longer than the longest token."""
    longest = max(map(len, byte_bpe.parse_ranks(lines)))
    vocabulary.encode("the quick brown foxes unhappily reinterpreted internationalisation " * 3)
    for key in vocabulary.encoder.readings:
        assert all(len(untold) <= longest for _, _, untold in byte_bpe._unpacked(key))


def test_plain_pattern_splits_alike():
    plain, own, rng = byte_bpe.plain_pattern(P.PATTERN), regex.compile(P.PATTERN), random.Random(6)
    assert plain is not None
    for code in [*range(0xD800), *range(0xE000, 0x10000)]:
        c = chr(code)
        text = f"a{c}a1{c}1 {c}  {c}!{c}\n{c}"
        assert plain.findall(text) == own.findall(text)
    for _ in range(3000):
        text = "".join(x for x in noise(rng, 50) if ord(x) < 0x10000)
        assert plain.findall(text) == own.findall(text)
    assert byte_bpe.plain_pattern(r"\p{L}+|\d") is None


def test_decoder_streams_whole_characters(vocabulary):
    rng = random.Random(7)
    for _ in range(200):
        data = noise(rng, 40).encode() if rng.random() < 0.7 else bytes(rng.randrange(256) for _ in range(40))
        tokens = np.frombuffer(b"".join(vocabulary.encoder.encode(data[k : k + 3]) for k in range(0, len(data), 3)), dtype="<u4")
        decoder, parts, k = byte_bpe.Decoder(vocabulary), [], 0
        while k < len(tokens):
            step = rng.randrange(1, 4)
            parts.append(decoder.feed(tokens[k : k + step]))
            k += step
        parts.append(decoder.finish())
        assert b"".join(parts) == data
        assert "".join(p.decode("utf-8", "replace") for p in parts) == data.decode("utf-8", "replace")


def test_unknown_ids_are_an_error(vocabulary):
    for bad in (50256, 4_000_000_000):
        with pytest.raises(ValueError):
            vocabulary.decode(np.array([1, bad], dtype="<u4").tobytes())


def test_columns_nulls_repeats_and_clashing_names(spark, other):
    rows = [(1, None, "x", 0), (2, "", "x", 0), (3, "twice", "x", 1), (3, "twice", "x", 1), (4, "é中\U0001f600", None, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, token_ids string, __coded int").repartition(3)
    tokenizer = byte_bpe.Tokenizer(spark, PATH, P.PATTERN)
    for out in (tokenizer.round_trip(docs), tokenizer.decode(tokenizer.encode(docs))):
        found = out.collect()
        assert len(found) == len(rows) and {"doc_id", "text", "token_ids", "decoded", "__coded"} == set(out.columns)
        for r in found:
            assert ids(r.token_ids) == other.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert tokenizer.round_trip(docs.limit(0)).collect() == []


def test_registered_query_equals_the_library(spark, sf_dir, other):
    texts = {r.doc_id: r.text or "" for r in read(spark, sf_dir, "documents").collect()}
    out = Q.queries()["op13_byte_bpe"](spark, sf_dir).collect()
    assert len(out) == len(texts)
    for r in out:
        want = other.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_rank_files_are_checked(spark, tmp_path):
    with pytest.raises(ValueError):
        byte_bpe.Encoder({b"a": 0})
    assert byte_bpe.parse_ranks(base64.b64encode(b"ab") + b" 7\n\n") == {b"ab": 7}

from __future__ import annotations

import random
from functools import lru_cache

import pytest
from pyspark.sql import Row

from stridelab.llm import queries, token_counts

PIECES = {"▁": -4.0, "▁a": -2.0, "a": -2.5, "b": -2.5, "ab": -3.0, "ba": -3.2, "▁ab": -3.5, "abb": -5.0, "c": -6.0, "▁the": -1.0, "é": -5.0}


def plain(word: str, pieces: dict[str, float], byte: float) -> int:
    """Tokens of the best segmentation, by trying all; fewer tokens on equal scores."""
    text = token_counts.MARK + word

    @lru_cache(None)
    def best(at: int) -> tuple[float, int]:
        if at == 0:
            return 0.0, 0
        size = len(text[at - 1].encode())
        s, n = best(at - 1)
        choices = [(s + byte * size, n + size)]
        for start in range(at):
            if text[start:at] in pieces:
                s, n = best(start)
                choices.append((s + pieces[text[start:at]], n + 1))
        return max(choices, key=lambda c: (c[0], -c[1]))

    return best(len(text))[1]


def test_trie_walk_matches_every_segmentation():
    rng = random.Random(3)
    counter = token_counts.TrieCounter(PIECES)
    words = ["".join(rng.choice("abcé☃t") for _ in range(rng.randint(1, 9))) for _ in range(400)] + ["the", "them", "a", "abb"]
    texts = [" ".join(words[i : i + 7]) for i in range(0, len(words), 7)]
    got = counter.count(texts)
    for text, (tokens, n) in zip(texts, got, strict=True):
        assert n == len(text.split()) and tokens == sum(plain(w, PIECES, counter.byte) for w in text.split())


def test_shared_prefixes_are_scored_once(monkeypatch):
    looked = []

    class Watched(dict):
        def get(self, key, default=None):
            looked.append(key)
            return super().get(key, default)

    counter = token_counts.TrieCounter(Watched(PIECES))
    counter.count(["abab ababc ababa abab"])
    once = len(looked)
    counter.count(["abab ababa"])
    assert len(looked) == once  # terminal counts are stored


def test_forgetting_counts_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT", 2)
    counter = token_counts.TrieCounter(PIECES)
    assert [counter.count(["ab abb c the"]) for _ in range(3)] == [[(sum(plain(w, PIECES, counter.byte) for w in "ab abb c the".split()), 4)]] * 3


def test_long_words_and_nothing():
    counter = token_counts.TrieCounter(PIECES)
    assert counter.count(["ab" * 20_000])[0][1] == 1
    assert counter.count([None, "", "  \n"]) == [(0, 0)] * 3


def test_nulls_repeats_clashing_columns_and_empty_tables(spark):
    rows = [Row(doc_id=1, text="the a", n_tokens="x", n=1), Row(doc_id=1, text="the a", n_tokens="x", n=1), Row(doc_id=None, text=None, n_tokens=None, n=None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, n int")
    out = token_counts.token_counts(df, PIECES)
    assert out.columns == ["doc_id", "n_tokens", "n_pretokens"]
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_pretokens) for r in out.collect()) == [(0, 0, 0), (1, 2, 2), (1, 2, 2)]
    assert token_counts.token_counts(df.limit(0), PIECES).count() == 0


def test_whole_table_against_plain_segmentation(spark, sf_dir):
    pieces = token_counts.load_pieces(queries.VOCABULARY)
    byte = token_counts.TrieCounter(pieces).byte
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len(r.text) < 1500}
    known: dict[str, int] = {}
    for r in queries.queries()["op2_token_counts"](spark, sf_dir).collect():
        if r.doc_id in texts:
            words = texts[r.doc_id].split()
            for w in words:
                known[w] = known.get(w) or plain(w, pieces, byte)
            assert r.n_tokens == sum(known[w] for w in words)


@pytest.mark.parametrize("word", ["the", "them", "unbelievable", "naïve", "☃"])
def test_scores_are_probabilities(word):
    pieces = token_counts.load_pieces(queries.VOCABULARY)
    import math

    assert sum(math.exp(p) for p in pieces.values()) == pytest.approx(1.0)
    assert token_counts.TrieCounter(pieces).count([word])[0][0] >= 1

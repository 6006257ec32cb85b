"""Spelling variants against a comparison of all pairs."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridelab.llm import queries as Q
from stridelab.llm import spelling
from stridelab.llm.common import read
from tests.oracle import compare, connect


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts: dict[str, int], ratio: int = 10) -> dict[str, tuple]:
    found = {}
    for w, n in counts.items():
        own = [x for x in counts if near(w, x)]
        best = min(own, key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        found[w] = (n, len(own), form, counts[form] if form is not None else None)
    out = {}
    for w, (n, k, form, form_n) in found.items():
        root = w
        while found[root][2] is not None:
            root = found[root][2]
        out[w] = (n, k, form, form_n, root)
    return out


def made(rng: random.Random, n: int, letters: str, longest: int) -> dict[str, int]:
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(longest))) for _ in range(n)}
    return {w: rng.choice([1, 1, 2, 5, 30, 400, 5000]) for w in words}


def variants(spark, counts: dict[str, int]) -> dict[str, tuple]:
    df = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n long, root string").repartition(3)
    rows = spelling.variants(df).collect()
    out = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}
    assert len(rows) == len(out) == len(counts)
    return out


@pytest.mark.parametrize("letters", ["ab", "abé中\U0001f600", "abcdefghij"])
def test_a_trie_finds_all_neighbours(letters):
    rng = random.Random(letters)
    for _ in range(12):
        counts = made(rng, rng.choice([1, 3, 200]), letters, 7)
        words = sorted(counts)
        cuts = sorted({0, len(words), *(rng.randrange(len(words) + 1) for _ in range(2))})
        blocks = [words[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        shards = [spelling.Shard.unpack(spelling.Shard.build(b, np.array([counts[w] for w in b])).pack()) for b in blocks]
        n_near, best, form = spelling.search(words, shards)
        for k, w in enumerate(words):
            own = [x for x in words if near(w, x)]
            want = min(own, key=lambda x: (-counts[x], x), default=None)
            assert (n_near[k], form[k]) == (len(own), want) and (want is None or best[k] == counts[want])


def test_equals_all_pairs(spark):
    counts = made(random.Random(8), 500, "abc", 8)
    assert variants(spark, counts) == brute(counts)


def test_many_shards_and_passes_change_nothing(spark, monkeypatch):
    counts = made(random.Random(9), 300, "abcd", 7)
    monkeypatch.setattr(spelling, "SHARD_WORDS", 20)
    monkeypatch.setattr(spelling, "BLOCK_BYTES", 6_000)
    monkeypatch.setattr(spelling, "TOGETHER", 7)
    assert variants(spark, counts) == brute(counts)


def test_one_form_of_very_many_and_a_long_chain(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    counts = {"commonword": 10**9}
    counts |= {"commonword"[:i] + c + "commonword"[i + 1 :]: 2 for i in range(10) for c in letters if c != "commonword"[i]}
    counts |= {"x" * (20 - k): 3 * 10**k for k in range(9)}
    got = variants(spark, counts)
    assert got == brute(counts)
    assert got["x" * 20][4] == "x" * 12 and sum(v[4] == "commonword" for v in got.values()) == 251


def test_long_words_ties_and_empty_tables(spark):
    long = "a" * 30_000
    counts = {long: 2, long + "b": 20, long + "c": 20, "": 5, "q": 60, "r": 60}
    got = variants(spark, counts)
    assert got[long] == (2, 2, long + "b", 20, long + "b")
    assert got[""] == (5, 2, "q", 60, "q")
    assert variants(spark, {}) == {}


def test_runs_and_counts(spark):
    rows = [(1, "Abcdefg abcdéfg-short Ünicodes123zzzzzzzz", 0), (None, None, 1), (2, "", 2)]
    docs = spark.createDataFrame(rows, "id int, text string, word int")
    runs = docs.select(F.explode(spelling.long_runs(F.col("text"), Q.WORD_LETTERS, 7)).alias("word"))
    assert sorted(r.word for r in runs.collect()) == sorted(["abcdefg", "abcdéfg", "Ünicodes", "zzzzzzzz"])
    got = spelling.counted(runs.union(runs).union(spark.sql("SELECT CAST(null AS STRING)"))).collect()
    assert {(r.word, r.n) for r in got} == {("abcdefg", 2), ("abcdéfg", 2), ("Ünicodes", 2), ("zzzzzzzz", 2)}


def test_registered_query_equals_its_sql(spark, sf_dir):
    assert compare(Q.queries()["op12_spelling"](spark, sf_dir), connect(sf_dir), Q.ORACLES["op12_spelling"]) is None


def test_registered_query_counts_as_plain_code_does(spark, sf_dir):
    import re

    counts: Counter[str] = Counter()
    for r in read(spark, sf_dir, "documents").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{r.doc_id}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
            if len(word) >= 7:
                counts[word] += 1
    got = {r.word: r.n for r in Q.queries()["op12_spelling"](spark, sf_dir).collect()}
    assert got == {w: n for w, n in counts.items() if n >= 2}

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F

from stridelab.llm import components as components_module
from stridelab.llm import simhash
from stridelab.llm.components import connected_components


def plain_simhash(text: str | None, size: int = 3) -> int:
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for mark in "\t\n\x0b\x0c\r":
        words = words.replace(mark, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(n: int, links) -> list[int]:
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(int(a)), find(int(b))
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("text", [None, "", "  \n", "one", "One TWO", "a b c d e", "É a b C\td\x0be", "x " * 500])
def test_fingerprint_is_the_majority_of_shingle_hashes(text):
    assert simhash.simhash(text.encode() if text is not None else None) == plain_simhash(text)


def test_long_texts_are_cut_without_losing_shingles(monkeypatch):
    text = " ".join(f"W{i % 37}x{i}" for i in range(3000))
    whole = simhash.simhash(text.encode())
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert simhash.simhash(text.encode()) == whole == plain_simhash(text)


def near_values(seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    values = []
    for base in rng.integers(0, 2**63, 60, dtype=np.uint64):
        for _ in range(rng.integers(1, 6)):
            x = base
            for bit in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= np.uint64(1) << np.uint64(bit)
            values.append(x)
    return np.unique(np.array(values, dtype=np.uint64))


@pytest.mark.parametrize("frontier", [1 << 20, 16])
def test_trie_links_connect_what_all_pairs_connect(monkeypatch, frontier):
    monkeypatch.setattr(simhash, "FRONTIER", frontier)
    values = near_values(3)
    apart = np.bitwise_count(values[:, None] ^ values[None, :])
    found = simhash.trie_links(values, np.array([0, len(values)]), 3)
    assert components(len(values), found) == components(len(values), np.argwhere(apart <= 3))
    assert len(found) < len(values)


@pytest.mark.parametrize(("crowd", "expected"), [(1_000_000, None), (2, None), (2, 1 << 30)])
def test_distributed_links_lose_none(spark, crowd, expected):
    values = near_values(5)
    prints = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "print long")
    rows = simhash.fingerprint_links(prints, 3, crowd, expected).collect()
    at = {int(v): i for i, v in enumerate(values.view(np.int64))}
    apart = np.bitwise_count(values[:, None] ^ values[None, :])
    assert components(len(values), [(at[r.a], at[r.b]) for r in rows]) == components(len(values), np.argwhere(apart <= 3))


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 150)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)] + [(5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = components(300, edges)
    assert got == {n: want[n] for a, b in edges if a != b for n in (a, b)}


def test_components_in_one_task_and_by_rounds(spark, monkeypatch):
    """Few edges take a handful of jobs, not rounds of joins; both ways name the same components."""
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(-30, 30)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(170)]
    table = spark.createDataFrame(edges, "a long, b long")
    named = lambda: {r.node: r.component for r in connected_components(table).collect()}

    def rounds(*_):
        raise AssertionError("rounds over a few edges")

    settled = components_module._settled
    monkeypatch.setattr(components_module, "_settled", rounds)
    few = named()
    monkeypatch.setattr(components_module, "_settled", settled)
    monkeypatch.setattr(components_module, "ONE_TASK", 0)
    assert few == named() and len(set(few.values())) > 2


def test_stars_of_a_long_chain_and_of_copies():
    rng = np.random.default_rng(4)
    order = rng.permutation(50_000)
    a, b = components_module.stars(order[:-1], order[1:])
    assert len(a) == 49_999 and set(b) == {0} and set(a) == set(range(1, 50_000))
    a, b = components_module.stars(np.array([7, -2, 7, 9]), np.array([-2, 7, -2, 10]))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(7, -2), (10, 9)]


def test_groups_match_brute_force_with_nulls_repeats_and_clashing_columns(spark):
    text = " ".join(f"word{i % 50} thing{i}" for i in range(200))
    rows = [
        Row(doc_id=7, text=text, print="x", component_id="y", fingerprint=1.0),
        Row(doc_id=3, text=text.upper(), print="x", component_id="y", fingerprint=1.0),
        Row(doc_id=9, text=None, print=None, component_id=None, fingerprint=None),
        Row(doc_id=8, text="", print=None, component_id=None, fingerprint=None),
        Row(doc_id=5, text="alone here", print="x", component_id="y", fingerprint=1.0),
        Row(doc_id=5, text="alone here", print="x", component_id="y", fingerprint=1.0),
        Row(doc_id=None, text="nobody knows", print="x", component_id="y", fingerprint=1.0),
    ]
    got = simhash.near_duplicate_groups(spark.createDataFrame(rows)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: (r.component_id, r.fingerprint) for r in got}
    assert by_id[7] == (3, f"{plain_simhash(text):016x}") and by_id[3][0] == 3
    assert by_id[9] == (8, "0" * 16) and by_id[5][0] == 5 and by_id[None][0] is None
    kept = simhash.keep_one_per_group(spark.createDataFrame(rows))
    assert kept.columns == ["doc_id", "text", "print", "component_id", "fingerprint"]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 3), (False, 5), (False, 8), (True, 0)]


@pytest.mark.parametrize("few", [1 << 20, 0])
@pytest.mark.parametrize("percent", [None, 80])
def test_one_row_of_each_group_stays_where_ids_repeat(spark, monkeypatch, few, percent):
    """Rows of one id count in their own texts' groups; rows without an id, too."""
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", few)
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (5, b), (7, b), (None, c), (None, c), (None, a), (9, None), (9, None)]
    kept = simhash.keep_one_per_group(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(3, a), (5, b), (None, c), (9, None)], key=str)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicate_groups(empty).count() == 0
    assert simhash.keep_one_per_group(empty).count() == 0


def test_whole_table_against_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = simhash.near_duplicate_groups(docs).orderBy("doc_id").collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = np.array([plain_simhash(texts[r.doc_id]) for r in got], dtype=np.uint64)
    assert [r.fingerprint for r in got] == [f"{p:016x}" for p in prints]
    apart = np.bitwise_count(prints[:, None] ^ prints[None, :])
    want = components(len(got), np.argwhere(apart <= 3))
    assert [r.component_id for r in got] == [got[w].doc_id for w in want]


def shingle_set(text: str | None, size: int = 5) -> frozenset:
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) or frozenset([tuple(words)] if words else [])


@pytest.mark.parametrize("order", [(20_000, 1 << 18), (3, 5)])
def test_near_copies_by_exact_jaccard_match_brute_force(spark, monkeypatch, order):
    """Also those further apart than three bits; groups, chains, a passage that many share, texts of few words."""
    monkeypatch.setattr(simhash, "ORDER_TEXTS", order[0])
    monkeypatch.setattr(simhash, "ORDER_SHINGLES", order[1])
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(40)]
    texts: list[str | None] = [None, "", "one two", "One TWO", "one two three"]
    for _ in range(25):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(8, 160))] + passage * rng.randrange(2)
        for _ in range(rng.randrange(1, 6)):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.component_id for r in simhash.near_duplicate_groups(docs, percent=80).orderBy("doc_id").collect()]
    sets = [shingle_set(t) for t in texts]
    prints = [plain_simhash(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    narrow = [(i, j) for i, j in pairs if (prints[i] ^ prints[j]).bit_count() <= 3]
    alike = [(i, j) for i, j in pairs if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    want = components(len(texts), narrow + alike)
    assert want != components(len(texts), narrow)
    assert got == want


def test_texts_of_one_shingle_set_and_an_empty_table(spark):
    a = " ".join(["a b c d e f g h i j k l m n o p"] * 2)
    docs = spark.createDataFrame([(1, a), (2, a + " a b c d e f g"), (3, "other")], "doc_id long, text string")
    assert [r.component_id for r in simhash.near_duplicate_groups(docs, percent=80).orderBy("doc_id").collect()] == [1, 1, 3]
    assert simhash.keep_one_per_group(docs.limit(0), percent=80).count() == 0

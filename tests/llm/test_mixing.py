from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from stridelab.llm import mixing


def plain_exponent(tokens: list[int], target: mixing.Target) -> float:
    total = sum(tokens)
    p = [t / total for t in tokens if t]

    def too_flat(a: float) -> bool:
        z = sum(x**a for x in p)
        w = [x**a / z for x in p]
        if target.entropy is not None:
            return -sum(x * math.log(x) for x in w) > target.entropy
        most = max(x / y for x, y in zip(w, p, strict=True))
        least = min(x / y for x, y in zip(w, p, strict=True))
        return (most / least if target.budget is None else target.budget / total * most) > target.max_repeats

    if not too_flat(0.0):
        return 0.0
    if too_flat(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if too_flat(mid) else (low, mid)
    return high


@pytest.mark.parametrize("target", [mixing.Target(max_repeats=2.0), mixing.Target(entropy=1.2), mixing.Target(max_repeats=1.5, budget=900.0), mixing.Target(entropy=9.0), mixing.Target(entropy=0.1), mixing.Target(max_repeats=100.0)])
def test_exponent_is_the_bisected_one(spark, target):
    tokens = [600, 200, 120, 60, 20, 0]
    sources = spark.createDataFrame([(f"s{i}", t, 1) for i, t in enumerate(tokens)], "source string, tokens long, rows long")
    assert mixing.solve_exponent(sources, target) == pytest.approx(plain_exponent(tokens, target), abs=1e-7)


def corpus(spark):
    rows = [(i, "big" if i % 3 else f"s{i % 7}", " ".join(["w"] * (5 + i % 11))) for i in range(600)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def test_every_source_meets_its_budget_and_every_document_appears(spark):
    docs = corpus(spark)
    target = mixing.Target(max_repeats=2.0)
    out = mixing.mix(docs, target, block_tokens=100, mix_block_tokens=500).collect()
    plan = {r.source[1:]: r for r in mixing.weights(mixing.source_tokens(docs, F.concat(F.lit("s"), "source"), mixing.word_count(F.col("text"))), target).collect()}
    used, epochs, seen = Counter(), defaultdict(set), Counter()
    for r in out:
        used[r.source] += r.mix_tokens
        epochs[r.source].add(r.epoch)
        seen[r.doc_id, r.epoch] += 1
    assert {r.doc_id for r in out} == set(range(600)) and max(seen.values()) == 1
    for s, p in plan.items():
        assert -1e-6 <= used[s] - p.budget < 15 + 1e-6
        assert max(epochs[s]) == math.ceil(p.repeats) - 1 <= 1
    assert max(p.repeats for p in plan.values()) == pytest.approx(2.0, abs=1e-6) and plan["big"].repeats == 1.0
    assert sum(p.weight for p in plan.values()) == pytest.approx(1.0)


def test_blocks_hold_the_weights(spark):
    out = mixing.mix(corpus(spark), mixing.Target(entropy=1.9), block_tokens=50, mix_block_tokens=2000).collect()
    by_block = defaultdict(Counter)
    for r in out:
        by_block[r.mix_block][r.source] += r.mix_tokens
    weight = {r.source: r.mix_weight for r in out}
    for counts in by_block.values():
        for s, w in weight.items():
            assert counts[s] / sum(counts.values()) == pytest.approx(w, abs=0.03)


def test_a_given_budget_cuts_the_last_epoch(spark):
    out = mixing.mix(corpus(spark), mixing.Target(max_repeats=1.5, budget=3000.0), block_tokens=100).collect()
    used = Counter()
    for r in out:
        used[r.source] += r.mix_tokens
    weight = {r.source: r.mix_weight for r in out}
    assert all(0 <= used[s] - w * 3000 < 16 for s, w in weight.items())


def test_the_same_input_gives_the_same_mix_however_it_is_partitioned(spark):
    docs = corpus(spark)
    rows = lambda df: sorted(map(tuple, mixing.mix(df, mixing.Target(max_repeats=2.0), block_tokens=100).collect()))
    assert rows(docs) == rows(docs.repartition(7, "text"))


def test_nulls_ties_repeats_clashing_columns_and_empty_tables(spark):
    rows = [Row(doc_id=1, source=None, text="a b", epoch="x", s_key=1, at=1, b=2), Row(doc_id=1, source=None, text="a b", epoch="x", s_key=1, at=1, b=2), Row(doc_id=None, source="s", text=None, epoch=None, s_key=None, at=None, b=None), Row(doc_id=3, source="n", text="", epoch=None, s_key=None, at=None, b=None), Row(doc_id=4, source="n", text="long " * 5000, epoch=None, s_key=None, at=None, b=None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, epoch string, s_key long, at long, b long")
    out = mixing.mix(df, mixing.Target(max_repeats=2.0))
    assert out.columns == ["doc_id", "source", "text", "s_key", "at", "b", "epoch", "mix_block", "mix_tokens", "mix_weight"]
    first = [r for r in out.collect() if r.epoch == 0]
    assert Counter(r.doc_id for r in first) == {1: 2, None: 1, 3: 1, 4: 1}
    assert mixing.mix(df.limit(0), mixing.Target(max_repeats=2.0)).count() == 0


def test_target_needs_one_aim(spark):
    with pytest.raises(ValueError):
        mixing.solve_exponent(spark.createDataFrame([("a", 1, 1)], "source string, tokens long, rows long"), mixing.Target())


def test_block_starts_are_running_sums_in_each_epochs_order(spark):
    rng = random.Random(3)
    rows = [(k, b, e, rng.randrange(1, 50)) for k in ("sa", "sb") for e in range(3) for b in range(60)]
    df = spark.createDataFrame(rows, "k string, b long, e int, tokens long")
    order = {(r.k, r.e, r.b): r.h for r in df.select("k", "e", "b", F.xxhash64(F.lit(7), "k", "e", "b").alias("h")).collect()}
    want = {}
    for k in ("sa", "sb"):
        for e in range(3):
            at = 0
            for _, b, _, n in sorted((r for r in rows if r[0] == k and r[2] == e), key=lambda r: order[k, e, r[1]]):
                want[k, e, b] = at
                at += n
    for stretches in (1, 4, 1024):
        assert {(r.k, r.e, r.b): r.start for r in mixing.block_starts(df, 7, stretches).collect()} == want

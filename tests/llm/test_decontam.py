from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Row

from stridelab.llm import decontam


def plain_distance(item: str, text: str) -> int:
    """The least edit distance of the whole item to any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def prose(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice("abcdefghilmnoprst") for _ in range(rng.randint(2, 8))) for _ in range(words))


def edited(rng: random.Random, text: str, edits: int) -> str:
    out = list(text)
    for _ in range(edits):
        k = rng.randrange(len(out))
        rng.choice([lambda: out.pop(k), lambda: out.insert(k, "z"), lambda: out.__setitem__(k, "q")])()
    return "".join(out)


def test_lemma_bound_is_never_below_one():
    bounds = decontam.Bounds()
    for m in range(1, 600):
        assert bounds.shared(m) >= 1 and bounds.edits(m) == m // 10 and 1 <= bounds.gram(m) <= m


def test_index_finds_exactly_what_alignment_finds():
    rng = random.Random(4)
    items = [(i, prose(rng, rng.randint(8, 40))) for i in range(12)]
    index = decontam.Index(items, decontam.Bounds())
    texts = []
    for _ in range(60):
        i, item = rng.choice(items)
        budget = index.bounds.edits(len(item))
        texts.append(f"{prose(rng, 30)} {edited(rng, item, rng.randint(0, budget + 6))} {prose(rng, 30)}")
    texts += [prose(rng, 60), "", None, items[0][1].upper().replace(" ", "\n\t ")]
    found = index.matches(texts)
    for text, hits in zip(texts, found, strict=True):
        want = {}
        for i, item in items:
            d = plain_distance(decontam.normalise(item), decontam.normalise(text))
            if d <= index.bounds.edits(len(decontam.normalise(item))):
                want[i] = d
        assert {i: min(x[1] for x in hits if x[0] == i) for i, *_ in hits} == want


def test_long_texts_are_searched_whole(monkeypatch):
    rng = random.Random(9)
    item = prose(rng, 30)
    text = prose(rng, 3000) + " " + edited(rng, item, 3) + " " + prose(rng, 200) + " " + item
    monkeypatch.setattr(decontam, "PIECE", 700)
    found = decontam.Index([(5, item)], decontam.Bounds()).matches([text])[0]
    assert len(found) == 2 and found[1][1] == 0
    assert decontam.normalise(text)[found[1][2] : found[1][3]] == item


def test_banded_alignment_matches_the_plain_one():
    rng = random.Random(1)
    for _ in range(40):
        item = prose(rng, 8)
        text = edited(rng, item, rng.randint(0, 4))
        a, b = (np.array([ord(c) for c in s], dtype=np.uint32) for s in (item, text))
        assert min(decontam.banded(a, b, -12, 12, 12))[0] == plain_distance(item, text)


def plain_occurrences(item: str, text: str, budget: int) -> list[tuple[int, int, int]]:
    """(distance, start, end) by a full alignment, then the least ones that do not overlap."""
    row = [(0, j) for j in range(len(text) + 1)]
    for i, a in enumerate(item, 1):
        new = [(i, 0)]
        for j, b in enumerate(text, 1):
            steps = [(row[j - 1][0] + (a != b), row[j - 1][1]), (row[j][0] + 1, row[j][1]), (new[-1][0] + 1, new[-1][1])]
            new.append(min(steps))
        row = new
    kept: list[tuple[int, int, int]] = []
    for d, start, end in sorted((d, start, j) for j, (d, start) in enumerate(row) if d <= budget and start < j):
        if all(end <= s or e <= start for _, s, e in kept):
            kept.append((d, start, end))
    return sorted(kept, key=lambda x: x[1])


def test_every_occurrence_of_items_of_all_lengths():
    """Lengths 1 to 60 with repeats, exact and edited, side by side and apart."""
    rng = random.Random(12)
    for m in range(1, 61):
        letters = "ab" if m % 7 == 0 else "abcdefgh"
        item = "".join(rng.choice(letters) for _ in range(m))
        parts = []
        for _ in range(12):
            parts.append("".join(rng.choice("xyz ") for _ in range(rng.choice([0, 1, 3, 40]))))
            parts.append(edited(rng, item, rng.choice([0, 0, 1, m // 10, m // 10 + 1])) if m > 2 else item)
        text = "".join(parts)
        got = decontam.Index([(1, item)], decontam.Bounds()).matches([text])[0]
        assert [x[1:] for x in got] == plain_occurrences(item, decontam.normalise(text), m // 10), m


def test_rows_repeats_nulls_and_clashing_columns(spark):
    rng = random.Random(2)
    items = [prose(rng, 25), prose(rng, 25)]
    bench = spark.createDataFrame([(1, items[0]), (2, items[1]), (3, None), (None, "x" * 50), (4, "absent"), (5, " ")], "item_id long, text string")
    text = f"{items[0]} {prose(rng, 10)} {items[0]} {items[1]}"
    rows = [Row(doc_id=1, text=text, item_id="own", distance=None), Row(doc_id=1, text=text, item_id="own", distance=None), Row(doc_id=2, text=None, item_id=None, distance=1), Row(doc_id=None, text=items[1], item_id=None, distance=1), Row(doc_id=4, text="", item_id="a", distance=1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string, distance int")
    got = decontam.contaminated(docs, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.occurrences, r.distance) for r in got) == [(0, 2, 1, 0), (1, 1, 2, 0), (1, 1, 2, 0), (1, 2, 1, 0), (1, 2, 1, 0)]
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 4]


def test_items_in_blocks_give_the_same(spark, sf_dir, monkeypatch):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    key = lambda df: sorted(map(tuple, df.collect()))
    whole = key(decontam.contaminated(docs, bench))
    monkeypatch.setattr(decontam, "BLOCK", 2000)
    assert whole and key(decontam.contaminated(docs, bench)) == whole


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(docs, none).count() == 0
    assert decontam.drop_contaminated(docs, none).count() == 1
    assert decontam.contaminated(docs.limit(0), none).count() == 0

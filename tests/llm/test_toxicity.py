from __future__ import annotations

import random
import zlib

from pyspark.sql import Row
from pyspark.sql import functions as F

from stridelab.llm import queries, toxicity
from stridelab.llm.common import id_bucket

WORDS = ["morning", "water", "river", "between", "quietly", "garden", "market", "window", "people", "stone", "letter", "winter", "yellow", "simple", "answer"]
BAD = ["scoundrel", "blockhead", "nitwit"]


def sample(rng: random.Random, toxic: bool, n: int = 80) -> str:
    words = [rng.choice(WORDS) + rng.choice(["", "s", "ing", "ly"]) for _ in range(n)]
    if toxic:
        for _ in range(max(3, n // 20)):
            words[rng.randrange(n)] = rng.choice(BAD)
    return " ".join(words)


def fitted(seed: int = 1) -> toxicity.Model:
    rng = random.Random(seed)
    return toxicity.Model(toxicity.Settings()).fit([sample(rng, True) for _ in range(150)], [sample(rng, False) for _ in range(300)])


def test_held_out_accuracy():
    model, rng = fitted(), random.Random(99)
    hits = [model.score(sample(rng, True)) >= 0.5 for _ in range(100)]
    false = [model.score(sample(rng, False)) >= 0.5 for _ in range(200)]
    assert sum(hits) >= 95 and sum(false) <= 4


def test_windows_keep_the_whole_text():
    text = " ".join(f"w{i}" for i in range(1003))
    assert b" ".join(w.removeprefix(toxicity.OPENING).strip() for w in toxicity.windows(text, 8)).decode() == text
    assert toxicity.windows(None, 8) == toxicity.windows("  ", 8) == []


def test_a_bad_word_at_the_end_of_a_long_text_is_seen():
    model, rng = fitted(), random.Random(3)
    clean = sample(rng, False, 4000)
    assert model.measures(clean + " " + " ".join(BAD))[3] > model.measures(clean)[3]


def test_scores_without_one_of_the_classes_and_of_nothing():
    assert toxicity.Model(toxicity.Settings()).fit([], ["some text"]).score("x") == 0.0
    assert toxicity.Model(toxicity.Settings()).fit(["some text"], []).score("x") == 1.0
    model = fitted()
    assert 0.0 <= model.score(None) == model.score("") < 0.5


def test_fit_leaves_held_out_rows_alone(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(300):
        toxic = i % 3 == 0
        held = zlib.crc32(str(i).encode()) % 5 == 0
        # In held-out rows the labels are wrong: learning from them would show.
        rows.append((i, sample(rng, toxic)))
        labels.append((i, int(toxic != held)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([*labels, (None, 1), (5, None), (7, 0), (7, 0), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known, id_bucket("doc_id", 5) != 0)
    out = toxicity.scored(docs, model, id_bucket("doc_id", 5) == 0).collect()
    assert sum((r.predicted == 1) == (r.doc_id % 3 == 0) for r in out) >= 290
    assert {r.doc_id for r in out if r.held_out} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0}


def test_nulls_repeats_clashing_columns_and_empty_tables(spark):
    model = fitted()
    rows = [Row(doc_id=None, text=None, score="a", predicted=1, __score=2.0), Row(doc_id=1, text="", score="a", predicted=1, __score=2.0), Row(doc_id=1, text="scoundrel nitwit blockhead " * 9, score="a", predicted=1, __score=2.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, predicted int, __score double")
    out = toxicity.scored(docs, model, F.lit(False))
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and sorted(r.predicted for r in out.collect()) == [0, 0, 1]
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == 2
    assert toxicity.scored(docs.limit(0), model, F.lit(False)).count() == 0
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(docs, empty, F.lit(True)).score("x") == 0.0


def test_query_is_accurate_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = queries.queries()["op10_toxicity"](spark, sf).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.toxic for r in out) >= 0.95 * len(out)

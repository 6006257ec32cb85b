from __future__ import annotations

import math
import re
import sys
import time
import zlib
from collections import Counter, defaultdict
from itertools import groupby

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from stridelab.llm import langid, queries


@pytest.fixture(scope="module")
def model():
    words = {"the": {"en": 60}, "die": {"de": 50, "en": 1}, "a": {"en": 20, "de": 1}}
    grams = {"^": {"en": 90, "de": 60}, "$": {"en": 90, "de": 60}, "sch": {"de": 30}, "ing$": {"en": 25}, "e": {"en": 70, "de": 50}}
    totals = {("en", 0): 100, ("de", 0): 80, ("en", 1): 300, ("de", 1): 200, ("en", 3): 200, ("de", 3): 150, ("en", 4): 150, ("de", 4): 100}
    return langid.Model(["en", "de"], words, grams, totals)


def test_known_words_come_first_and_unseen_ones_back_off(model):
    assert model.predict("THE the")[0] == "en" and model.predict("die die the")[0] == "de"
    assert model.predict("waschen")[0] == "de" and model.predict("sinking")[0] == "en"
    model._prepare()
    row = lambda g: model.gram_table[model.gram_at[g]]
    assert (model.backoff("waschen") == row("sch")).all()  # the longest length with a known gram
    assert (model.backoff("qq") == (row("^") + row("$")) / 2).all()


def test_whole_text_counts(model):
    assert model.predict("the " * 50 + "die " * 200)[0] == "de"
    assert model.predict(" ".join(["die"] * 20_000 + ["the"] * 30_000))[0] == "en"


def test_nothing_to_read(model):
    for text in (None, "", "123 !? _", "\n"):
        assert model.predict(text) == (langid.UNKNOWN, 0.0)
    assert langid.Model([], {}, {}, {}).predict("the") == (langid.UNKNOWN, 0.0)


def test_ties_go_to_the_first_language(model):
    assert langid.Model(["b", "a"], {}, {}, {}).predict("zzz") == ("a", 0.5)


@pytest.mark.parametrize("kept", [1, 3, 200_000])
def test_kept_scores_do_not_change_results(model, monkeypatch, kept):
    texts = ["waschen the", "sinking a", "qq die", "one two three four five", "waschen the"]
    before = [model.predict(t) for t in texts]
    monkeypatch.setattr(langid, "KEPT", kept)
    model._prepare()
    assert [model.predict(t) for t in texts * 3] == before * 3


def test_learning_skips_held_out_rows_and_nulls(spark):
    rows = []
    for i in range(200):
        lang = "xx" if i % 2 else "yy"
        text = {"xx": "alpha beta gamma", "yy": "uno dos tres"}[lang]
        held = zlib.crc32(str(i).encode()) % 3 == 1
        rows.append((i, text, lang if not held else {"xx": "yy", "yy": "xx"}[lang]))  # wrong where it must not be read
    rows += [(1000, None, "xx"), (1001, "alpha", None), (None, "uno", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    bucket = F.crc32(F.col("doc_id").cast("string")) % 3
    learned = langid.fit(docs, bucket != 1)
    out = {r.doc_id: r.lang_pred for r in langid.identify(docs, learned, F.coalesce(bucket == 1, F.lit(False))).collect()}
    assert all(out[i] == ("xx" if i % 2 else "yy") for i in range(200)) and out[1000] == "und" and out[1001] == "xx"


def test_nulls_repeats_clashing_columns_and_empty_tables(spark, model):
    rows = [Row(doc_id=1, text="the", lang_pred=1, score="s", p="p"), Row(doc_id=1, text="the", lang_pred=1, score="s", p="p"), Row(doc_id=None, text=None, lang_pred=None, score=None, p=None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang_pred int, score string, p string")
    out = langid.identify(df, model, F.lit(False))
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"] and sorted(r.lang_pred for r in out.collect()) == ["en", "en", "und"]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.identify(df, langid.fit(empty, F.lit(True)), F.lit(False)).filter("lang_pred = 'und'").count() == 3


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = queries.queries()["op3_language_id"](spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 for r in out)


def test_only_letters_make_words():
    model = langid.Model(["en"], {"a": {"en": 1}}, {}, {("en", 0): 1})
    for text in ("\u00b2\u00bd 12", "\u2460 \u2167 _ 7", "", None):
        assert model.predict(text) == ("und", 0.0)
    assert model.predict("\u00bda\u00b2")[0] == "en"


def test_words_of_all_characters_in_time_that_ordinary_texts_take():
    every = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if not "\ud800" <= c <= "\udfff")
    plain = Counter("".join(run) for known, run in groupby(every.lower(), str.isalpha) if known)
    assert langid.word_counts(every) == plain and langid.word_counts(None) == Counter()
    assert langid.word_counts("a\u00b2b\u00bd a\u00b2b \u00b2") == Counter(a=2, b=2)
    text = "\u00e9tait une fois la m\u00e9moire " * 20_000
    start = time.process_time()
    Counter(re.findall(r"[^\W\d_]+", text.lower()))
    usual = time.process_time() - start
    start = time.process_time()
    langid.word_counts(text)
    assert time.process_time() - start < 4 * usual + 0.05


def test_query_against_a_plain_version(spark, sf_dir):
    """Counts of every word and n-gram from the rows that may be learned from, then a plain sum over each text."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    words, grams = defaultdict(Counter), defaultdict(Counter)
    letters = lambda t: ["".join(g) for known, g in groupby((t or "").lower(), str.isalpha) if known]
    cut = lambda w, n: [f"^{w}$"[i : i + n] for i in range(len(w) + 3 - n)]
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.text is not None and r.lang is not None:
            for w in letters(r.text):
                words[r.lang][w] += 1
                for n in range(1, 6):
                    grams[r.lang, n].update(cut(w, n))
    languages = sorted(words)
    known = set().union(*words.values())
    any_gram = [set()] + [set().union(*(grams[x, n] for x in languages)) for n in range(1, 6)]

    def score(w: str, x: str) -> float:
        if w in known:
            return math.log((words[x][w] + 0.5) / (sum(words[x].values()) + 1))
        for n in range(5, 0, -1):
            found = [g for g in cut(w, n) if g in any_gram[n]]
            if found:
                return sum(math.log((grams[x, n][g] + 0.5) / (sum(grams[x, n].values()) + 1)) for g in found) / len(found)
        return 0.0

    got = {r.doc_id: r for r in queries.queries()["op3_language_id"](spark, sf_dir).collect()}
    for r in rows:
        totals = {x: sum(score(w, x) for w in letters(r.text)) for x in languages}
        best = max(languages, key=lambda x: totals[x]) if letters(r.text) else "und"
        share = 1 / sum(math.exp(t - totals[best]) for t in totals.values()) if letters(r.text) else 0.0
        assert got[r.doc_id].lang_pred == best and abs(got[r.doc_id].score - share) < 1e-6

"""Language identification by word-first backoff.

A known word is scored by its log frequency in each language. An unseen word
falls back to the longest length of character n-grams (of the word between
boundary marks) of which at least one is known, and is scored by the mean log
frequency of the known ones.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"
#: Unseen words whose scores a task keeps.
KEPT = 200_000
#: Runs of letters and of numbers that are no digits (fractions, raised digits); few texts have any of the latter.
_WORD = re.compile(r"[^\W\d_]+")
RESULT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])


@dataclass(frozen=True)
class Settings:
    """``rows`` bounds the labelled rows of a language that are learned from (a
    hash sample of about that size); ``words`` and ``grams`` bound the model."""

    rows: int = 4000
    words: int = 20_000
    grams: int = 20_000
    longest: int = 5


def word_counts(text: str | None) -> Counter[str]:
    """Lower-cased runs of letters, as ``\\p{L}+`` has them, with their counts."""
    counts = Counter(_WORD.findall((text or "").lower()))
    for run in [w for w in counts if not w.isalpha()]:
        times = counts.pop(run)
        for letters, part in groupby(run, str.isalpha):
            if letters:
                counts["".join(part)] += times
    return counts


class Model:
    def __init__(self, languages: list[str], words: dict[str, dict[str, int]], grams: dict[str, dict[str, int]], totals: dict[tuple[str, int], int], longest: int = 5):
        """``words`` and ``grams``: counts by item and language; ``totals``: by language and length (0: words)."""
        self.languages = sorted(languages)
        self.words, self.grams, self.totals, self.longest = words, grams, totals, longest

    def _row(self, counts: dict[str, int], length: int) -> np.ndarray:
        return np.array([math.log((counts.get(x, 0) + 0.5) / (self.totals.get((x, length), 0) + 1.0)) for x in self.languages])

    def _prepare(self) -> None:
        """Scores by row: first of the known words, behind them of unseen ones as they come."""
        self.at = {w: i for i, w in enumerate(self.words)}
        known = np.array([self._row(c, 0) for c in self.words.values()]).reshape(-1, len(self.languages))
        self.table = np.concatenate([known, np.zeros((KEPT, len(self.languages)))])
        self.gram_at = {g: i for i, g in enumerate(self.grams)}
        self.gram_table = np.array([self._row(c, len(g)) for g, c in self.grams.items()]).reshape(-1, len(self.languages))

    def backoff(self, word: str) -> np.ndarray:
        marked = f"^{word}$"
        size = len(marked)
        at = self.gram_at.get
        for n in range(min(self.longest, size), 0, -1):
            found = [k for i in range(size - n + 1) if (k := at(marked[i : i + n])) is not None]
            if found:
                return self.gram_table[found].sum(axis=0) / len(found)
        return np.zeros(len(self.languages))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, its share of the likelihood); ``und`` and 0 without a letter or a model."""
        counts = word_counts(text)
        if not counts or not self.languages:
            return UNKNOWN, 0.0
        if "at" not in self.__dict__:
            self._prepare()
        if len(self.at) + len(counts) > len(self.table):
            self._prepare()  # forget the unseen words so far
            if len(self.at) + len(counts) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((len(counts), len(self.languages)))])
        rows = list(map(self.at.get, counts))
        if None in rows:
            for k, (word, i) in enumerate(zip(counts, rows, strict=True)):
                if i is None:
                    rows[k] = self.at[word] = len(self.at)
                    self.table[rows[k]] = self.backoff(word)
        total = np.fromiter(counts.values(), dtype=float, count=len(counts)) @ self.table[rows]
        share = np.exp(total - total.max())
        best = int(np.argmax(total))
        return self.languages[best], float(share[best] / share.sum())

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("languages", "words", "grams", "totals", "longest")}


def fit(docs: DataFrame, eligible: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: Settings = Settings()) -> Model:
    """Learn from eligible rows with text and language; counts are aggregated on the executors.

    Only the commonest words and n-grams of each language (bounded numbers)
    come to the driver.
    """
    known = docs.filter(eligible).filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, settings.rows / n))).otherwise(share)
    sample = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20))
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("item")).groupBy("lang", "item").agg(F.count("*").alias("n"))
    words = words.withColumn("size", F.lit(0)).cache()
    marked = F.concat(F.lit("^"), F.col("item"), F.lit("$"))
    lengths = F.array(*(F.lit(n) for n in range(1, settings.longest + 1)))
    grams = words.select("lang", "n", marked.alias("w"), F.explode(lengths).alias("size")).filter(F.length("w") >= F.col("size"))
    grams = grams.select("lang", "n", "size", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - F.col("size") + 1), lambda i: F.substring("w", i, F.col("size")))).alias("item"))
    grams = grams.groupBy("lang", "item", "size").agg(F.sum("n").alias("n"))
    counts = words.select("lang", "item", "size", "n").unionByName(grams)
    totals = Window.partitionBy("lang", "size")
    ranked = Window.partitionBy("lang", F.col("size") == 0).orderBy(F.desc("n"), "item")
    counts = counts.withColumns({"total": F.sum("n").over(totals), "rank": F.row_number().over(ranked)})
    top = counts.filter(F.col("rank") <= F.when(F.col("size") == 0, settings.words).otherwise(settings.grams)).collect()
    words.unpersist()
    kept: tuple[dict, dict] = ({}, {})
    sums: dict[tuple[str, int], int] = {}
    for r in top:
        kept[r["size"] > 0].setdefault(r["item"], {})[r["lang"]] = r["n"]
        sums[r["lang"], r["size"]] = r["total"]
    return Model(list(sizes), kept[0], kept[1], sums, settings.longest)


def predict_column(model: Model, text: Column) -> Column:
    @F.pandas_udf(RESULT)
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([model.predict(t) for t in batch], columns=["lang", "score"])

    return predicted.asNondeterministic()(text)


def identify(docs: DataFrame, model: Model, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred and score of every row, from its whole text alone.

    Null texts and texts without a letter are ``und`` with score 0; ties go to
    the first language by name; repeated rows are judged alike.
    """
    out = docs.select(F.col(id_col), held_out.alias("held_out"), predict_column(model, F.col(text_col)).alias("p"))
    return out.select(id_col, "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))

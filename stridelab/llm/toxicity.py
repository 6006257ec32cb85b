"""Toxicity by compression distance.

Windows of a text are compressed with an ordinary and with a toxic zstandard
dictionary; what the toxic one saves in bytes is a window's gain. A logistic
curve, fitted on the training rows, turns a text's mean gain, the share and
number of its gaining windows and the largest gain into a score, with 0.5 as
the calibrated threshold.

Only the ordinary dictionary is trained by zstandard. A toxic dictionary
trained in the same way on toxic windows did not give right results (see the
README for figures): most of a toxic row is ordinary text, so what it saves
on a short toxic word drowns in what two dictionaries save by chance. Instead,
the toxic dictionary is the ordinary one behind the stretches that set toxic
rows apart by a likelihood-ratio test over rows, near copies counted once. In
effect a learned list of stretches decides, matched by compression.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, give_back

#: Opens every window and ends both dictionaries: with that much to match, a window is always
#: written compressed, and a gain is not lost in the cost of beginning to compress.
OPENING = bytes(range(14, 26))
_TRIM = ".,!?;:|\"'()[]&%#*$"


@dataclass(frozen=True)
class Settings:
    """``rows``, ``chars`` and ``sample_chars`` bound what is fitted on: so many
    labelled rows of each class, none longer than ``chars`` characters and all
    of a class together not longer than ``sample_chars``; zstandard trains on
    ``samples`` of their windows. ``stretches`` bounds the toxic ones."""

    rows: int = 1500
    chars: int = 60_000
    sample_chars: int = 20_000_000
    samples: int = 40_000
    stretches: int = 400
    window: int = 8
    dictionary: int = 8192
    min_ratio: float = 8.0
    min_g2: float = 26.0


def windows(text: str | None, size: int) -> list[bytes]:
    words = (text or "").lower().encode("utf-8", "replace").split()
    return [OPENING + b" " + b" ".join(words[i : i + size]) + b" " for i in range(0, len(words), size)]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=15, chain_log=15, search_log=5, min_match=5, target_length=64, strategy=zstandard.STRATEGY_LAZY2,
        write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)


def _near_copy_free(texts: list[str], size: int = 16, shared: int = 3) -> list[str]:
    """One text of each family of edited copies: none that shares several of its least shingle hashes with one before it."""
    holders: dict[int, list[int]] = {}
    kept: list[str] = []
    for text in texts:
        words = text.lower().encode("utf-8", "replace").split()
        marks = sorted({xxhash.xxh64_intdigest(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))})[:size]
        alike = Counter(k for m in marks for k in holders.get(m, ()))
        if max(alike.values(), default=0) < min(shared, len(marks)):
            for m in marks:
                holders.setdefault(m, []).append(len(kept))
            kept.append(text)
    return kept


def _stretches(text: str) -> set[str]:
    """Words (marked by an ending ``$``) and the beginnings of words, from four letters."""
    out: set[str] = set()
    for word in set(text.lower().split()):
        word = word.strip(_TRIM)
        if len(word) >= 3:
            out.add(word + "$")
            out.update(word[:k] for k in range(4, min(len(word), 11)))
    return out


def telling_stretches(toxic: list[str], ordinary: list[str], settings: Settings) -> list[str]:
    """Stretches found in more toxic rows than chance allows, the most telling first."""
    nt, no = len(toxic), len(ordinary)
    in_toxic, in_ordinary = Counter(), Counter()
    for texts, counts in ((toxic, in_toxic), (ordinary, in_ordinary)):
        for text in texts:
            counts.update(_stretches(text))

    def g2(s: str) -> float:
        a, b = in_toxic[s], in_ordinary[s]
        ea, eb = nt * (a + b) / (nt + no), no * (a + b) / (nt + no)
        return 2 * (a * math.log(a / ea) + (b * math.log(b / eb) if b else 0.0))

    scores = {s: g2(s) for s, a in in_toxic.items() if a * no > settings.min_ratio * nt * (in_ordinary[s] + 0.5 * min(1.0, no / 500))}
    ranked = sorted((s for s in scores if scores[s] > settings.min_g2), key=lambda s: (-scores[s], s))
    by_start: dict[str, list[str]] = {}
    for s in scores:
        by_start.setdefault(s[:3], []).append(s)
    chosen: list[str] = []
    bases: list[str] = []
    for s in ranked:
        bare = s.rstrip("$")
        if any(bare.startswith(b) or b.startswith(bare) for b in bases):
            continue
        bases.append(bare)
        same = [x for x in by_start[s[:3]] if x.startswith(bare[:4]) and in_toxic[x] >= 0.8 * in_toxic[s]]
        chosen.append(max(same, key=lambda x: (len(x), x)))
    return chosen


class Model:
    """The two dictionaries and the curve. Without rows of both classes, the score is the toxic share."""

    def __init__(self, settings: Settings):
        self.settings = settings
        self.ordinary, self.toxic = b"", b""
        self.weights = np.zeros(7)
        self.prior: float | None = 0.0

    def fit(self, toxic: list[str], ordinary: list[str], share: float | None = None) -> Model:
        """``share``: how much of the labelled rows is toxic, where the two lists don't show it."""
        toxic, ordinary = [t for t in toxic if t], [t for t in ordinary if t]
        if not toxic or not ordinary:
            self.prior = 1.0 if toxic else 0.0
            return self
        bare_toxic, bare_ordinary = _near_copy_free(toxic), _near_copy_free(ordinary)
        samples = [w for t in bare_ordinary for w in windows(t, self.settings.window)]
        samples = [w[len(OPENING) :] for w in samples]
        samples.sort(key=xxhash.xxh64_intdigest)
        samples = samples[: self.settings.samples]
        try:
            self.ordinary = zstandard.train_dictionary(self.settings.dictionary, samples).as_bytes()
        except zstandard.ZstdError:  # too little text to train on
            self.ordinary = b"".join(samples)[: self.settings.dictionary].ljust(8)
        head = b""
        for s in telling_stretches(bare_toxic, bare_ordinary, self.settings)[: self.settings.stretches]:
            head = b" " + (s[:-1] + " " if s.endswith("$") else s).encode("utf-8", "replace") + head
        self.ordinary += OPENING
        self.toxic = head + self.ordinary
        self.prior = None
        rows = bare_toxic + bare_ordinary
        self._calibrate(np.array([self.measures(t) for t in rows]), np.array([1.0] * len(bare_toxic) + [0.0] * len(bare_ordinary)), share if share is not None else len(toxic) / (len(toxic) + len(ordinary)))
        return self

    def _calibrate(self, x: np.ndarray, y: np.ndarray, share: float, steps: int = 80, ridge: float = 1e-2) -> None:
        """Ridge logistic regression by Newton's method; the classes weigh as much as among the labelled rows."""
        x = np.c_[x, np.ones(len(x))]
        share = min(max(share, 0.01), 0.99)
        weight = np.where(y > 0, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum())) * len(y)
        beta = np.zeros(x.shape[1])
        penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            gradient = x.T @ (weight * (p - y)) + penalty @ beta
            hessian = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + penalty
            step = np.linalg.solve(hessian, gradient)
            beta -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < 1e-8:
                break
        self.weights = beta

    def _pair(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        if "pair" not in self.__dict__:
            self.pair = _compressor(self.ordinary), _compressor(self.toxic)
        return self.pair

    def measures(self, text: str | None) -> list[float]:
        """Mean gain, shares of windows that gain one and two bytes or more, logs of their numbers, largest gain."""
        plain, toxic = self._pair()
        cut = windows(text, self.settings.window)
        if not cut:
            return [0.0] * 6
        gains = np.array([len(plain.compress(w)) - len(toxic.compress(w)) for w in cut])
        one, two = int((gains >= 1).sum()), int((gains >= 2).sum())
        return [float(gains.mean()), one / len(gains), two / len(gains), math.log1p(one), math.log1p(two), float(gains.max())]

    def score(self, text: str | None) -> float:
        if self.prior is not None:
            return self.prior
        z = float(np.dot([*self.measures(text), 1.0], self.weights))
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "pair"}


def fit(docs: DataFrame, labels: DataFrame, eligible: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", settings: Settings = Settings()) -> Model:
    """Fit on a bounded sample of labelled rows: those of each class with the least id hash.

    ``eligible`` tells which ids may be learned from. Null labels and ids are
    skipped; of an id's labels the largest counts.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.filter(F.col("id").isNotNull() & F.col("label").isin(0, 1)).groupBy("id").agg(F.max("label").alias("label"))
    texts = docs.filter(eligible).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.length("text") <= settings.chars)
    picked = [known.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(2 * settings.rows) for k in (1, 0)]
    sample = texts.join(F.broadcast(picked[0].unionByName(picked[1])), "id")  # at most 4 x rows ids
    # An id that repeats is learned from once, by its least text.
    one = sample.groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    so_far = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0)  # over that bounded sample
    one = one.withColumn("chars", F.sum(F.length("text")).over(so_far)).filter(F.col("chars") <= settings.sample_chars)
    rows = one.orderBy(F.xxhash64("id"), "id").collect()
    by_label = {k: [r["text"] for r in rows if r["label"] == k][: settings.rows] for k in (1, 0)}
    sizes = {r["label"]: r["count"] for r in known.join(texts.select("id"), "id", "left_semi").groupBy("label").count().collect()}
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    return Model(settings).fit(by_label[1], by_label[0], share)


def score_column(model: Model, text: Column) -> Column:
    """The score of each text, null and empty ones included (whole texts are read)."""

    @F.pandas_udf(T.DoubleType())
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([model.score(t) for t in batch], dtype="float64")
        give_back()

    return scores.asNondeterministic()(text)


def scored(docs: DataFrame, model: Model, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score and predicted (1 from a score of 0.5 on), one row per row."""
    out = docs.select(F.col(id_col), held_out.alias("held_out"), score_column(model, F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under the threshold, with their columns unchanged."""
    score = free_name(docs, "__score")
    return docs.withColumn(score, score_column(model, F.col(text_col))).filter(F.col(score) < threshold).select(*docs.columns)

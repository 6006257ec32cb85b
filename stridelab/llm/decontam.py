"""Benchmark decontamination by the q-gram lemma.

An occurrence of an item of length m with at most k edits shares at least
m + 1 - q(k + 1) q-grams with the text, all on k + 1 neighbouring diagonals
(position in the text minus position in the item). Shared q-grams are counted
in overlapping bands of diagonals, each of which holds such a neighbourhood
whole; bands that reach the bound are verified by a banded alignment.

Texts and items are compared lower-cased with runs of white space as one space.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, free_name, give_back

#: Code points of normalised text that are indexed at a time.
PIECE = 1 << 20
#: Code points of benchmark items that one pass over the documents looks for.
BLOCK = 8_000_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

MATCH = T.ArrayType(
    T.StructType(
        [
            T.StructField("item_id", T.LongType()),
            T.StructField("distance", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
        ]
    )
)


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _grams(points: np.ndarray, q: int) -> np.ndarray:
    """A hash of each q-gram."""
    n = len(points) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    wide, out = points.astype(np.uint64), np.zeros(n, dtype=np.uint64)
    for i in range(q):
        out = out * _MULTIPLIER + wide[i : i + n]
    return out ^ (out >> np.uint64(29))


@dataclass(frozen=True)
class Bounds:
    """``q``: the longest grams; ``error_rate``: edits for each code point of an item."""

    q: int = 8
    error_rate: float = 0.1

    def edits(self, length: int) -> int:
        return int(self.error_rate * length + 1e-9)

    def gram(self, length: int) -> int:
        """The grams of an item: the longest up to ``q`` of which the lemma asks for one at least; all of it where nothing may be edited."""
        edits = self.edits(length)
        return min(self.q, length // (edits + 1)) if edits else length

    def shared(self, length: int) -> int:
        return length + 1 - self.gram(length) * (self.edits(length) + 1)


class _Grams:
    """The grams of one length of the items that are sought by them."""

    def __init__(self, q: int, items: list[int], points: list[np.ndarray], bits: int = 22):
        self.q = q
        grams = [_grams(points[i], q) for i in items]
        every = np.concatenate(grams)
        owner = np.repeat(np.array(items, dtype=np.int64), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams])
        order = np.argsort(every, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.keys, first = np.unique(every[order], return_index=True)
        self.first = np.r_[first, len(every)]
        self.mask = np.uint64((1 << bits) - 1)
        self.sieve = np.zeros(1 << bits, dtype=bool)
        self.sieve[(self.keys & self.mask).astype(np.int64)] = True

    def hits(self, text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece, item, diagonal) of every gram that a piece of the text and an item share."""
        grams = _grams(text, self.q)
        at = np.flatnonzero(self.sieve[(grams & self.mask).astype(np.int64)])
        found = np.minimum(np.searchsorted(self.keys, grams[at]), len(self.keys) - 1)
        hit = self.keys[found] == grams[at]
        at, found = at[hit], found[hit]
        piece = np.searchsorted(starts, at, side="right") - 1
        whole = at + self.q <= starts[piece + 1]
        at, found, piece = at[whole], found[whole], piece[whole]
        counts = self.first[found + 1] - self.first[found]
        entry = np.repeat(self.first[found] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum()) if len(counts) else np.zeros(0, np.int64)
        return np.repeat(piece, counts), self.owner[entry], np.repeat(at - starts[piece], counts) - self.place[entry]


class Index:
    """The q-grams of a block of items. Items without a code point are left out."""

    def __init__(self, items: Iterable[tuple[int, str]], bounds: Bounds):
        self.bounds = bounds
        kept = [(i, p) for i, text in items if len(p := _points(normalise(text)))]
        self.ids = [i for i, _ in kept]
        self.points = [p for _, p in kept]
        self.texts = [p.tobytes().decode("utf-32-le", "surrogatepass") for p in self.points]
        lengths = [len(p) for p in self.points]
        self.longest = max(lengths, default=0)
        self.edits = np.array([bounds.edits(m) for m in lengths], dtype=np.int64)
        self.need = np.array([bounds.shared(m) for m in lengths], dtype=np.int64)
        self.width = 2 * self.edits + 8
        by_gram: dict[tuple[int, bool], list[int]] = {}
        for i, m in enumerate(lengths):
            by_gram.setdefault((bounds.gram(m), bounds.edits(m) > 0), []).append(i)
        self.tables = [(_Grams(q, own, self.points), edited) for (q, edited), own in sorted(by_gram.items())]

    def candidates(self, pieces: list[np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
        """(piece, item, first diagonal, last diagonal) of every band that reaches the bound.

        An item without an edit budget is its own only gram; its band is the
        one diagonal.
        """
        starts = np.cumsum([0, *(len(p) for p in pieces)])
        text = np.concatenate(pieces)
        bands = (int(starts[-1]) + 2 * self.longest) // 8 + 2
        for table, edited in self.tables:
            piece, item, diagonal = table.hits(text, starts)
            if not edited:
                yield from zip(piece.tolist(), item.tolist(), diagonal.tolist(), diagonal.tolist(), strict=True)
                continue
            diagonal = diagonal + self.longest
            width, edits = self.width[item], self.edits[item]
            band = diagonal // width
            lower = (diagonal % width <= edits) & (band > 0)
            band, item, piece = np.r_[band, band[lower] - 1], np.r_[item, item[lower]], np.r_[piece, piece[lower]]
            keys, n = np.unique((piece * len(self.ids) + item) * bands + band, return_counts=True)
            item = (keys // bands) % len(self.ids)
            enough = n >= self.need[item]
            for key, i in zip(keys[enough].tolist(), item[enough].tolist(), strict=True):
                low = (key % bands) * int(self.width[i]) - self.longest
                yield key // bands // len(self.ids), i, low, low + int(self.width[i] + self.edits[i])

    def matches(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """Per text: (item id, edit distance, start, end) of the occurrences found."""
        if not self.ids:
            return [[] for _ in texts]
        # Of each (item, end): the least distance, and of those the first start.
        ends: list[dict[tuple[int, int], tuple[int, int]]] = [{} for _ in texts]
        overlap = 4 * self.longest + 64
        queue: list[tuple[int, int, np.ndarray]] = []
        held = 0
        for row, text in enumerate(texts):
            points = _points(normalise(text))
            for begin in range(0, max(1, len(points) - overlap), PIECE):
                piece = points[begin : begin + PIECE + overlap]
                if not len(piece):
                    continue
                queue.append((row, begin, piece))
                held += len(piece)
                if held >= PIECE:
                    self._verify(queue, ends)
                    queue, held = [], 0
        if queue:
            self._verify(queue, ends)
        return [self._apart(found) for found in ends]

    def _verify(self, queue, ends) -> None:
        for k, i, low, high in self.candidates([p for _, _, p in queue]):
            row, begin, piece = queue[k]
            m, reach = len(self.points[i]), high - low
            # The neighbouring bands see the same occurrences; whatever a band holds overlaps an exact one that is long enough.
            a, b = max(0, low - reach), min(len(piece), high + reach + m)
            near = piece[a:b].tobytes().decode("utf-32-le", "surrogatepass")
            exact = near.find(self.texts[i])
            found = []
            while exact >= 0:
                found.append((0, a + exact, a + exact + m))
                exact = near.find(self.texts[i], exact + 1)
            if high > low and (not found or m <= 4 * reach):
                found += banded(self.points[i], piece, low, high, int(self.edits[i]))
            for distance, start, end in found:
                key, best = (i, begin + end), (distance, begin + start)
                if best < ends[row].get(key, (distance + 1, 0)):
                    ends[row][key] = best

    def _apart(self, found: dict[tuple[int, int], tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        """Occurrences of an item that do not overlap: the least distances first, of these the first in the text."""
        by_item: dict[int, list[tuple[int, int, int]]] = {}
        for (i, end), (distance, start) in found.items():
            by_item.setdefault(i, []).append((distance, start, end))
        out = []
        for i, own in by_item.items():
            kept: list[tuple[int, int, int]] = []  # (start, end, distance), by start
            for distance, start, end in sorted(own):
                k = bisect_left(kept, (start, end, distance))
                if (k == 0 or kept[k - 1][1] <= start) and (k == len(kept) or kept[k][0] >= end):
                    kept.insert(k, (start, end, distance))
            out += [(self.ids[i], distance, start, end) for start, end, distance in kept]
        return sorted(out, key=lambda x: (x[0], x[2]))


def banded(item: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> list[tuple[int, int, int]]:
    """(distance, start, end) of the alignments of the whole item on diagonals low..high, one for each end.

    A cell holds its cost and, in its low bits, the diagonal on which its
    alignment began, so the least cell also tells where the match starts (the first place of several).
    """
    m, width = len(item), high - low + 1
    shift = 32
    one = np.int64(1) << shift
    steps = np.arange(width, dtype=np.int64) * one
    row = np.arange(width, dtype=np.int64)
    padded = np.full(m + width, 0xFFFFFFFF, dtype=np.uint32)
    a, b = max(0, low), min(len(text), low + m + width)
    if b > a:
        padded[a - low : b - low] = text[a:b]
    dropped = np.full(width, np.int64(1) << 62)
    limit = (np.int64(budget) + 1) << shift
    for i in range(m):
        kept = row + (padded[i : i + width] != item[i]) * one
        np.add(row[1:], one, out=dropped[:-1])
        row = np.minimum(kept, dropped)
        row = np.minimum.accumulate(row - steps) + steps
        if i % 8 == 7 and row.min() >= limit:  # costs never fall again
            return []
    out = []
    for k in np.flatnonzero((row >> shift) <= budget).tolist():
        start = low + int(row[k] & (one - 1))
        out.append((int(row[k] >> shift), max(0, start), max(0, min(len(text), low + k + m))))
    return [x for x in out if x[1] < x[2]]


def _blocks(benchmark: DataFrame, item_id: str, item_text: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``BLOCK`` code points, dealt by hash; only one block is on the driver at a time."""
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK)
    for k in range(blocks):
        yield [(r["id"], r["text"]) for r in items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).orderBy("id", "text").collect()]


def _matcher(items: list[tuple[int, str]], bounds: Bounds):
    shared: dict[str, Index] = {}

    @F.pandas_udf(MATCH)
    def matches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if "index" not in shared:
            shared["index"] = Index(items, bounds)
        for batch in batches:
            yield pd.Series([[dict(zip(("item_id", "distance", "start", "end"), x, strict=True)) for x in found] for found in shared["index"].matches(list(batch))])
        shared.clear()
        give_back()

    return matches.asNondeterministic()


def with_matches(docs: DataFrame, benchmark: DataFrame, out: str, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", bounds: Bounds = Bounds()) -> DataFrame:
    """``docs`` with an array column ``out`` of the benchmark occurrences in each text.

    The items go to the tasks in blocks of about ``BLOCK`` code points, each in
    a pass of its own that is written before the next block is read. Null and
    empty texts have no matches; null items and those without a letter or mark
    are skipped; start and end are positions in the normalised text. An item
    occurs wherever its whole text stands with at most ``error_rate`` edits a
    code point (none below 10); overlapping occurrences count once. All other
    columns, whatever their names, pass unchanged.
    """
    df = docs.withColumn(out, F.array().cast(MATCH))
    written = False
    for items in _blocks(benchmark, item_id, item_text):
        df = checkpointed(df) if written else df
        df = df.withColumn(out, F.concat(out, _matcher(items, bounds)(F.col(text_col))))
        written = True
    return df


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", bounds: Bounds = Bounds()) -> DataFrame:
    """One row per document (row) and benchmark item found in it.

    Columns: id, item_id, occurrences, distance (the least), start and end (of
    the first occurrence with that distance). Clean documents have no row.
    """
    parts: list[DataFrame] = []
    keyed = docs.select(F.col(id_col), F.col(text_col))
    for items in _blocks(benchmark, item_id, item_text):
        parts = [*parts[:-1], checkpointed(parts[-1])] if parts else parts  # a pass ends before the next block is read
        found = keyed.select(id_col, _matcher(items, bounds)(F.col(text_col)).alias("__matches")).filter(F.size("__matches") > 0)
        ids = F.array_distinct(F.transform("__matches", lambda m: m["item_id"]))
        exploded = found.select(F.col(id_col), "__matches", F.explode(ids).alias("item_id"))
        own = exploded.select(id_col, "item_id", F.filter("__matches", lambda m: m["item_id"] == F.col("item_id")).alias("own"))
        best = F.array_min(F.transform("own", lambda m: F.struct(m["distance"].alias("distance"), m["start"].alias("start"), m["end"].alias("end"))))
        parts.append(own.select(id_col, "item_id", F.size("own").cast("long").alias("occurrences"), best.alias("best")))
    if not parts:
        empty = keyed.select(id_col, F.lit(0).cast("long").alias("item_id"), F.lit(0).cast("long").alias("occurrences"), F.lit(None).cast(MATCH.elementType).alias("best"))
        parts = [empty.filter(F.lit(False))]
    return reduce(DataFrame.unionByName, parts).select(
        id_col, "item_id", "occurrences", F.col("best.distance").cast("long").alias("distance"), F.col("best.start").alias("start"), F.col("best.end").alias("end")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", bounds: Bounds = Bounds()) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item occurs, with their columns unchanged."""
    matches = free_name(docs, "__matches")
    df, written = docs, False
    for items in _blocks(benchmark, item_id, item_text):
        df = checkpointed(df) if written else df
        df = df.withColumn(matches, _matcher(items, bounds)(F.col(text_col))).filter(F.size(F.col(matches)) == 0).select(*docs.columns)
        written = True
    return df

"""Pairs within groups of any size, found in blocks of bounded size.

A group is cut into blocks by hash; every two of its blocks (and each with
itself) meet in one place, where rows are compared in memory and only the
pairs asked for come out. A group of m rows sends each row to m / size places,
so groups should be as small as filters can make them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back

#: Rows of a block.
SIZE = 1024
#: Pairs of rows that are compared at a time.
PAIRS = 1 << 18


class Lists(NamedTuple):
    """A column of lists: all values in a row, and where each list begins and ends among them."""

    values: np.ndarray
    edges: np.ndarray

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of some rows, with the place among ``rows`` that each belongs to."""
        sizes = self.edges[rows + 1] - self.edges[rows]
        which = np.repeat(np.arange(len(rows)), sizes)
        return which, self.values[np.arange(len(which)) + np.repeat(self.edges[rows] - (np.cumsum(sizes) - sizes), sizes)]


def in_blocks(rows: DataFrame, key: str, item: str, size: int = SIZE) -> DataFrame:
    """``rows`` with columns block, low and high: once for each pair of blocks that its own is part of."""
    blocks = F.ceil(F.count("*").over(Window.partitionBy(key)) / size)
    placed = rows.withColumn("__n", blocks).withColumn("block", F.pmod(F.xxhash64(item), F.col("__n")).cast("int"))
    met = placed.withColumn("__o", F.explode(F.sequence(F.lit(0), (F.col("__n") - 1).cast("int"))))
    return met.withColumns({"low": F.least("block", "__o"), "high": F.greatest("block", "__o")}).drop("__n", "__o")


def pairs_within(rows: DataFrame, key: str, near: Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], np.ndarray], out: Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], list[np.ndarray]], schema: str) -> DataFrame:
    """Pairs (i, j) of rows with equal ``key`` that ``near`` keeps, written by ``out`` as rows of longs.

    ``rows`` come from ``in_blocks``; fixed-size binary columns arrive as rows
    of uint64, arrays of numbers as ``Lists``. Rows of a group are held at most two blocks at a time.
    """
    order = [key, "low", "high"]
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
            columns: dict[str, np.ndarray] = {}
            for name in table.column_names:
                column = table.column(name).combine_chunks()
                if pa.types.is_binary(column.type):
                    columns[name] = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(len(column), -1)
                elif pa.types.is_list(column.type):
                    columns[name] = Lists(column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy().astype(np.int64))
                else:
                    columns[name] = column.to_numpy(zero_copy_only=False)
            marks = np.stack([columns[c].astype(np.int64) for c in order], axis=1)
            edges = np.r_[0, np.flatnonzero(np.any(marks[1:] != marks[:-1], axis=1)) + 1, len(marks)]
            for i, j in _every_pair(edges, columns["block"] != columns["low"], columns["low"] == columns["high"]):
                keep = near(columns, i, j)
                if keep.any():
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in out(columns, i[keep], j[keep])], names=names)

        def last_group(batch: pa.RecordBatch) -> int:
            marks = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in order]
            other = np.flatnonzero(np.any([m != m[-1] for m in marks], axis=0))
            return int(other[-1]) + 1 if len(other) else 0

        for batch in batches:
            if not batch.num_rows:
                continue
            if held and any(held[-1].column(held[-1].schema.get_field_index(c))[-1] != batch.column(batch.schema.get_field_index(c))[0] for c in order):
                yield from found(pa.Table.from_batches(held))
                held = []
            cut = last_group(batch)
            if cut:
                yield from found(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from found(pa.Table.from_batches(held))
        held.clear()
        give_back()

    return rows.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


def _every_pair(edges: np.ndarray, second: np.ndarray, single: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of all pairs within each group (of two blocks: across them), many small groups at a time."""
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a < 2:
            continue
        if single[a]:
            for start in range(a, b, max(1, PAIRS // (b - a))):
                end = min(b, start + max(1, PAIRS // (b - a)))
                i, j = np.meshgrid(np.arange(start, end), np.arange(start, b), indexing="ij")
                upper = j > i
                waiting.append((i[upper], j[upper]))
        else:
            other = second[a:b]
            i, j = np.meshgrid(a + np.flatnonzero(~other), a + np.flatnonzero(other), indexing="ij")
            waiting.append((i.ravel(), j.ravel()))
        held += len(waiting[-1][0])
        if held >= PAIRS:
            yield from _cut(waiting)
            waiting, held = [], 0
    if waiting:
        yield from _cut(waiting)


def _cut(waiting: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    i, j = (np.concatenate(x) for x in zip(*waiting, strict=True))
    for k in range(0, len(i), PAIRS):
        yield i[k : k + PAIRS], j[k : k + PAIRS]

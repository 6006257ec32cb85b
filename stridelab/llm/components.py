"""Connected components of an edge table: of many edges by alternating large and small stars, of few in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, give_back, parts_for

#: Edges (two longs each) up to which one task joins them in memory; they are counted first.
#: The rounds of stars are some forty plans a call, which is what a driver has to hold of small tables.
ONE_TASK = 1 << 19


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node but the least of its component to that one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        lx, ly = label[x], label[y]
        apart = lx != ly
        if not apart.any():
            break
        x, y = x[apart], y[apart]
        np.minimum.at(label, np.maximum(lx, ly)[apart], np.minimum(lx, ly)[apart])
        while not np.array_equal(up := label[label], label):
            label = up
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [[column.to_numpy(zero_copy_only=False) for column in batch.columns] for batch in batches if batch.num_rows]
    if held:
        a, b = stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
    held.clear()
    give_back()


def _large_star(edges: DataFrame, parts: int) -> DataFrame:
    """Each node's larger neighbours are linked to its least neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(parts)
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")).coalesce(parts)
    return both.filter("b > a").join(least, "a").coalesce(parts).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct().coalesce(parts)


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).coalesce(parts)
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).coalesce(parts).distinct().coalesce(parts)


def _settled(edges: DataFrame, parts: int, max_rounds: int) -> DataFrame:
    """Stars until nothing moves: each node's edge leads to the least of its component."""
    edges, mark = edges.coalesce(parts), None
    for _ in range(max_rounds):
        edges = checkpointed(_small_star(_large_star(edges, parts), parts))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges
        mark = now
    raise RuntimeError("components did not settle; raise max_rounds")


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component: least node.

    Up to ``ONE_TASK`` edges of longs are joined in one task. Of more, each
    round is two joins on aggregated neighbours; no neighbour list is ever
    gathered. Every round is checkpointed; the last rounds' checksum decides.
    Few edges stay in few partitions: each round has several shuffles, and a
    shuffle of n partitions into n leaves n files however little is in them.
    Self-links are ignored (their nodes appear only if linked otherwise).
    """
    edges = checkpointed(edges.select("a", "b").filter("a <> b").distinct())
    total = edges.count()
    if 0 < total <= ONE_TASK and {kind for _, kind in edges.dtypes} == {"bigint"}:
        edges = checkpointed(edges.coalesce(1).mapInArrow(_in_one_task, "a long, b long"))
    elif total:
        edges = _settled(edges, parts_for(total), max_rounds)
    heads = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(heads)

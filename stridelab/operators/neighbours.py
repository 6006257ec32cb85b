"""The nearest rows of rows, over columns with gaps, in blocks or by leaves.

Queries and rows are dealt into blocks of bounded size. Every block of queries
meets every block of rows in a place of its own, where matrix products give
all distances at once; the few that can be among the nearest are computed again
term by term. Each place gives the ``k`` best of each query, and Spark keeps
the best of these: before and after the one shuffle by query.

Without gaps, many rows are dealt into leaves of space instead, and a query
meets only the leaves that may hold one of its nearest.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed, ship_package

#: Rows of a block of either side.
BLOCK = 4096
#: Rows of a leaf, leaves at most, and rows of the sample that cuts them, for each.
LEAF, LEAVES, SAMPLE = 1024, 4096, 64
#: Distances that are held at a time.
CELLS = 1 << 22


def numbered(df: DataFrame, out: str) -> DataFrame:
    """``df`` written, with a number that is each row's own."""
    written = checkpointed(df)
    return written.withColumn(out, F.monotonically_increasing_id())


def nearest(queries: DataFrame, rows: DataFrame, columns: Sequence[str], number: str, tie: str, k: int, value: str | None = None) -> DataFrame:
    """The ``k`` nearest of ``rows`` of each query: (query, wanted, d, tie, row, value, nth).

    query and row are numbers of rows, nth counts from 1, and wanted is the
    place of the column that the query lacks, or -1.

    Both tables have the double ``columns``, the ``number`` that a row has in
    both (no query finds itself) and the column ``tie``. With ``value`` None,
    a query has a search for each column that it lacks, among the rows that
    have it, and ``value`` is theirs; else there is one search among all rows,
    and ``value`` is that column's.

    Distance is Euclidean over the columns both have, scaled up for the others;
    rows without one in common are not near. Ties go by ``tie``, then by
    value, then by number. Nulls, NaN and infinities count as missing. No
    place holds more than two blocks. Where something is missing, work grows
    with queries times rows, and each row is sent once for each block of the
    other side; else see ``_by_leaves``.
    """
    kind = rows.schema[tie].dataType.simpleString()
    sides = []
    for df, own, other in ((queries, "__q", "__r"), (rows, "__r", "__q")):
        xs = F.array(*(F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")).otherwise(float("nan")) for c in columns)).alias("x")
        keep = [F.col(number).alias("number"), F.col(tie).alias("tie"), xs, (F.lit(0.0) if value is None or own == "__q" else F.col(value).cast("double")).alias("value")]
        sides.append((df.select(*keep), own, other))
    whole = [side.agg(F.count("*").alias("n"), F.max(F.exists("x", F.isnan)).alias("gaps")).first() for side, _, _ in sides]
    counts = [w["n"] for w in whole]
    blocks = dict(zip(("__q", "__r"), (max(1, -(-n // BLOCK)) for n in counts), strict=True))
    each = value is None

    def within(left: pa.Table, right: pa.Table) -> pa.Table:
        return _block(left, right, k, each)

    schema = f"query long, wanted int, d double, tie {kind}, row long, value double"
    if not each and columns and counts[0] and counts[1] > 2 * BLOCK and not any(w["gaps"] for w in whole):
        found = _by_leaves(sides[0][0], sides[1][0], counts[1], len(columns), k, within, schema)
    else:
        met = []
        for side, own, other in sides:
            dealt = side.withColumn(own, F.pmod(F.xxhash64("number"), F.lit(blocks[own])).cast("int"))
            met.append(dealt.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(blocks[other] - 1)))))
        found = met[0].groupBy("__q", "__r").cogroup(met[1].groupBy("__q", "__r")).applyInArrow(within, schema)
    best = Window.partitionBy("query", "wanted").orderBy("d", "tie", "value", "row")
    return found.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k)


def _tree(points: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """The column and the cut of each node of a full binary tree with at least so many leaves, halving the points."""
    size = (1 << max(0, leaves - 1).bit_length()) - 1
    dims, cuts = np.zeros(size, dtype=np.int64), np.zeros(size)
    parts = [points]
    for node in range(size):
        own = parts[node]
        if len(own):
            dims[node] = np.argmax(np.ptp(own, axis=0))
            cuts[node] = np.partition(own[:, dims[node]], (len(own) - 1) // 2)[(len(own) - 1) // 2]
        left = own[:, dims[node]] <= cuts[node]
        parts += [own[left], own[~left]]
        parts[node] = own[:0]
    return dims, cuts


def _by_leaves(queries: DataFrame, rows: DataFrame, n: int, width: int, k: int, within: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What ``within`` finds for queries and rows that meet in leaves of space; nothing is missing.

    A sample on the driver cuts space into leaves of about as many rows. The
    rows of its own leaf give a query a distance within which its ``k`` nearest
    lie (none, if they are fewer); then it meets the leaves whose rows' bounds
    are as near as that, so the cuts decide the work and not the result. A
    leaf with more rows or queries than a block, such as one of equal rows, is
    met in blocks. Work grows with the queries times a leaf's rows and the
    leaves near a query, which are many where the columns are; leaves grow
    once there are over ``LEAF * LEAVES`` rows.
    """
    ship_package(rows.sparkSession)
    leaves = min(LEAVES, -(-n // LEAF))
    some = rows.filter(F.pmod(F.xxhash64("number", F.lit("sample")), F.lit(max(1, n // (leaves * SAMPLE)))) == 0).select("x").toArrow()
    dims, cuts = _tree(some.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width), leaves)

    def matrix(x: pa.Array) -> np.ndarray:
        return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)

    @F.arrow_udf("int")
    def leaf_of(x: pa.Array) -> pa.Array:
        points = matrix(x)
        node = np.zeros(len(points), dtype=np.int64)
        for _ in range(len(cuts).bit_length()):
            node = 2 * node + 1 + (points[np.arange(len(points)), dims[node]] > cuts[node])
        return pa.array((node - len(cuts)).astype(np.int32))

    queries, rows = (checkpointed(df.withColumn("leaf", leaf_of("x"))) for df in (queries, rows))
    bounds = rows.groupBy("leaf").agg(F.count("*").alias("n"), F.array(*(F.min(F.col("x")[i]) for i in range(width))).alias("low"), F.array(*(F.max(F.col("x")[i]) for i in range(width))).alias("high"))
    found = bounds.collect()  # a row for each leaf
    names, low, high = np.array([r["leaf"] for r in found], dtype=np.int32), np.array([r["low"] for r in found]), np.array([r["high"] for r in found])
    row_blocks = np.zeros(len(cuts) + 1, dtype=np.int32)
    row_blocks[names] = [-(-r["n"] // BLOCK) for r in found]

    def met(asking: DataFrame) -> DataFrame:
        query_blocks = np.zeros(len(cuts) + 1, dtype=np.int32)
        for r in asking.groupBy("leaf").agg(F.count("*").alias("n")).collect():  # a row for each leaf
            query_blocks[r["leaf"]] = -(-r["n"] // BLOCK)

        def blocks(counts: np.ndarray) -> Column:
            return F.arrow_udf(lambda leaf: pa.array(counts[leaf.to_numpy()]), "int")("leaf")

        sides = []
        for df, own, other in ((asking, "__q", "__r"), (rows, "__r", "__q")):
            counted = df.withColumns({"__q": blocks(query_blocks), "__r": blocks(row_blocks)}).filter("__q > 0 AND __r > 0")
            sides.append(counted.withColumn(own, F.pmod(F.xxhash64("number"), F.col(own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1))))
        keys = ["leaf", "__q", "__r"]
        return sides[0].groupBy(*keys).cogroup(sides[1].groupBy(*keys)).applyInArrow(within, schema)

    @F.arrow_udf("array<int>")
    def near(x: pa.Array, reach: pa.Array) -> pa.Array:
        points, limit = matrix(x), reach.fill_null(np.inf).to_numpy(zero_copy_only=False) ** 2 * (1 + 1e-9)
        ends, which = [0], []
        step = max(1, CELLS // max(1, len(names)))
        for start in range(0, len(points), step):
            part = points[start : start + step]
            apart = sum(np.maximum(np.maximum(low[None, :, i] - part[:, None, i], part[:, None, i] - high[None, :, i]), 0.0) ** 2 for i in range(width))
            q, own = np.nonzero(apart <= limit[start : start + step, None])
            which.append(names[own])
            ends += (ends[-1] + np.cumsum(np.bincount(q, minlength=len(part)))).tolist()
        return pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), pa.array(np.concatenate(which) if which else names[:0]))

    reach = met(queries).groupBy("query").agg(F.get(F.array_sort(F.collect_list("d")), F.lit(k - 1)).alias("reach"))
    asked = queries.join(reach, F.col("number") == F.col("query"), "left").select("number", "x", "reach")
    return met(checkpointed(asked.select("number", "x", F.explode(near("x", "reach")).alias("leaf"))))


def _points(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Values with 0 for missing ones, and where there are values."""
    column = table.column("x").combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    x = flat.reshape(len(column), -1)
    here = ~np.isnan(x)
    return np.where(here, x, 0.0), here


def _block(left: pa.Table, right: pa.Table, k: int, each: bool) -> pa.Table:
    """The ``k`` best rows of a block for each search of the queries of another."""
    schema = pa.schema([("query", pa.int64()), ("wanted", pa.int32()), ("d", pa.float64()), ("tie", right.schema.field("tie").type), ("row", pa.int64()), ("value", pa.float64())])
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    (a, in_a), (b, in_b) = _points(left), _points(right)
    numbers, queries = right.column("number").to_numpy(), left.column("number").to_numpy()
    values = right.column("value").to_numpy()
    order = pa.compute.rank(right.column("tie"), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
    # Distances stay when both sides move; near the origin the products keep their digits.
    centre = np.divide(b.sum(axis=0), in_b.sum(axis=0), out=np.zeros(b.shape[1]), where=in_b.any(axis=0))
    a0, b0 = np.where(in_a, a - centre, 0.0), np.where(in_b, b - centre, 0.0)
    parts: list[tuple[np.ndarray, ...]] = []
    for start in range(0, len(a), max(1, CELLS // len(b))):
        part = slice(start, start + max(1, CELLS // len(b)))
        ma, mb = in_a[part].astype(float), in_b.astype(float)
        shared = ma @ mb.T
        first, second = (a0[part] ** 2) @ mb.T, ma @ (b0.T ** 2)
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(shared > 0, a.shape[1] / shared, np.inf)
            rough = np.where(shared > 0, np.maximum(first + second - 2 * (a0[part] @ b0.T), 0.0) * scale, np.inf)
            # By how much the products may be off.
            off = np.where(shared > 0, (first + second) * scale * 1e-12, 0.0)
        rough[queries[part][:, None] == numbers[None, :]] = np.inf
        for wanted in range(a.shape[1]) if each else (-1,):
            asks = np.flatnonzero(~in_a[part][:, wanted]) if each else np.arange(len(rough))
            has = np.flatnonzero(in_b[:, wanted]) if each else np.arange(len(b))
            if not len(asks) or not len(has):
                continue
            far, slack = rough[np.ix_(asks, has)], off[np.ix_(asks, has)]
            upper = far + slack
            kth = np.partition(upper, min(k, len(has)) - 1, axis=1)[:, [min(k, len(has)) - 1]]
            q, r = np.nonzero((far - slack <= kth) & np.isfinite(far))
            q, r = asks[q], has[r]
            both = in_a[part][q] & in_b[r]
            squares = np.where(both, (a[part][q] - b[r]) ** 2, 0.0).sum(axis=1)
            d = np.sqrt(squares * (a.shape[1] / both.sum(axis=1)))
            given = b[r, wanted] if each else values[r]
            sort = np.lexsort((numbers[r], given, order[r], d, q))
            q, r, d, given = q[sort], r[sort], d[sort], given[sort]
            begins = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, dtype=np.int64)
            nth = np.arange(len(q)) - np.repeat(begins, np.diff(np.r_[begins, len(q)]))
            keep = nth < k
            parts.append((queries[part][q[keep]], np.full(int(keep.sum()), wanted), d[keep], r[keep], given[keep]))
    if not parts:
        return schema.empty_table()
    q, wanted, d, r, given = (np.concatenate(x) for x in zip(*parts, strict=True))
    return pa.Table.from_arrays([pa.array(q), pa.array(wanted.astype(np.int32)), pa.array(d), right.column("tie").combine_chunks().take(pa.array(r)), pa.array(numbers[r]), pa.array(given)], schema=schema)

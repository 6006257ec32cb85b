"""Kendall's tau-b of large columns, by counting inversions in stretches.

Rows in the order of (x, y) have as many discordant pairs as there are places
where a larger y stands before a smaller one. Both columns are cut at values
that occur; a pair of rows then lies in two stretches of x and two of y, which
a table of counts settles, or in one stretch of x or of y, and is counted there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .distributed import SKETCH

#: Rows that a stretch should have, and the most cuts of a column.
ROWS, MOST_CUTS = 1_000_000, 1023


def inversions(y: np.ndarray) -> int:
    """Pairs of places at which a larger value stands before a smaller one."""
    rank = np.unique(y, return_inverse=True)[1].astype(np.int64)
    total = 0
    for bit in reversed(range(int(rank.max(initial=0)).bit_length())):
        # Values that agree above this bit stand together, in their old order.
        group, one = rank >> (bit + 1), (rank >> bit) & 1
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        ones = np.cumsum(one)
        before = np.repeat((ones - one)[starts], np.diff(np.r_[starts, len(rank)]))
        total += int((ones - before)[one == 0].sum())
        rank = rank[np.argsort(group * 2 + one, kind="stable")]
    return total


def _coded(x: Column, cuts: Sequence[float]) -> Column:
    """Twice the number of cuts below x, and one more if x is a cut."""
    sorted_cuts = np.array(cuts, dtype=float)

    @F.arrow_udf("int")
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            v = batch.to_numpy(zero_copy_only=False)
            yield pa.array((np.searchsorted(sorted_cuts, v, "left") + np.searchsorted(sorted_cuts, v, "right")).astype(np.int32))

    return code(x)


def _within(rows: DataFrame, by: str, order: Sequence[str]) -> int:
    """Inversions of y in each stretch of several values."""

    def count(table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_numpy() for c in order]
        y = table.column("y").to_numpy()[np.lexsort(columns[::-1])]
        return pa.table({"n": pa.array([inversions(y)], type=pa.int64())})

    found = rows.filter(F.col(by) % 2 == 0).groupBy(by).applyInArrow(count, "n long")
    return int(found.agg(F.sum(F.col("n").cast("decimal(38,0)"))).first()[0] or 0)


def _ties(rows: DataFrame, keys: Sequence[str]) -> int:
    n = F.col("count").cast("decimal(38,0)")
    return int(rows.groupBy(*keys).count().agg(F.sum(n * (n - 1) / 2)).first()[0] or 0)


def kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (a, b, tau) over the rows that have both columns; NaN counts as missing.

    NaN where a column has no two different values. The rows are written once,
    as two numbers each. A value that many rows share is a stretch of its own
    and needs no counting inside; any other stretch has about ``ROWS`` rows, or
    a ``MOST_CUTS``-th of all if these are more. The driver gets cuts and a
    table of counts of bounded size.
    """
    x, y = (F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in (a, b))
    rows = checkpointed(df.select((x + 0.0).alias("x"), (y + 0.0).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL"))
    n = rows.count()
    tau = math.nan
    if n > 1:
        steps = min(MOST_CUTS, n // ROWS)
        places = F.array(*(F.lit((k + 1) / (steps + 1)) for k in range(steps)))
        cut = lambda c: F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(c, F.lit(SKETCH)), places)
        cuts = [sorted(set(c)) for c in rows.agg(cut("x"), cut("y")).first()] if steps else [[], []]
        coded = checkpointed(rows.withColumns({"s": _coded(F.col("x"), cuts[0]), "t": _coded(F.col("y"), cuts[1])}))
        table = np.zeros((2 * len(cuts[0]) + 1, 2 * len(cuts[1]) + 1))
        cells = coded.groupBy("s", "t").count().collect()  # a table of bounded size
        # Python's integers: products of counts may be beyond 64 bits.
        table = table.astype(object)
        for r in cells:
            table[r["s"], r["t"]] = r["count"]
        above = np.zeros(table.shape[1], dtype=object)  # rows in earlier stretches of x, by stretch of y
        discordant = 0
        for line in table:
            larger = np.r_[np.cumsum(above[::-1])[::-1][1:], [0]]
            discordant += int((larger * line).sum())
            above = above + line
        discordant += _within(coded, "s", ["x", "y"]) + _within(coded, "t", ["s", "y"])
        pairs = n * (n - 1) // 2
        tied_x, tied_y, tied = _ties(rows, ["x"]), _ties(rows, ["y"]), _ties(rows, ["x", "y"])
        below = (pairs - tied_x) * (pairs - tied_y)
        tau = (pairs - tied_x - tied_y + tied - 2 * discordant) / math.sqrt(below) if below else math.nan
    return df.sparkSession.createDataFrame([(a, b, tau)], "a string, b string, tau double")

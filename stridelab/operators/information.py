"""Mutual information of a number and a class by nearest neighbours on the line.

For each row, the radius is the distance to its k-th nearest row of its own
class, and m the number of rows of any class nearer than that. The estimate is
psi(n) + <psi(k)> - <psi(rows of the class)> - <psi(m)>, and 0 at least.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .distributed import running_sums
from .labels import in_stretches, with_ordinal

#: Rows of a stretch.
STRETCH = 1_000_000
#: Terms of the asymptotic series of psi, and how far arguments are lifted before it is used.
_SERIES = (-1 / 12, 1 / 120, -1 / 252, 1 / 240, -1 / 132)
_LIFT = 8


def digamma(x: Column) -> Column:
    """psi of a number of 1 or more."""
    y = x + float(_LIFT)
    series = sum((F.lit(c) / F.pow(y, F.lit(2.0 * (k + 1))) for k, c in enumerate(_SERIES)), F.ln(y) - 0.5 / y)
    return series - sum((1 / (x + float(k)) for k in range(_LIFT)), F.lit(0.0))


def neighbour_information(df: DataFrame, x: str, label: str, k: int = 3, stretch: int | None = None) -> DataFrame:
    """One row ``mi`` (nats): the nearest-neighbour estimate between column ``x`` and the classes of ``label``.

    Rows without a number (null, NaN) or a class, and classes of one row, are
    left out; a class of fewer than k + 1 rows has its own k. 0 for an empty
    table. Distances that are equal but for rounding may count as either. Classes are put in order in stretches of ``stretch`` rows, each with
    the k rows before and behind it, and rows between two ends are told by sums
    that run in stretches, so no task holds a class, however large.
    """
    size = STRETCH if stretch is None else stretch
    number = F.col(x).cast("double") + 0.0
    rows = df.select(number.alias("x"), F.col(label).alias("y")).filter("x IS NOT NULL AND NOT isnan(x) AND y IS NOT NULL")
    ordered = checkpointed(with_ordinal(rows, ["y"], ["x"], stretch=size))
    sizes = ordered.groupBy("y").agg(F.count("*").alias("own")).filter("own > 1").withColumnRenamed("y", "__y")
    near = Window.partitionBy("y", "__stretch").orderBy("pos")
    placed = in_stretches(ordered, "pos", size, k, k, ["y", "pos", "x"])
    before = {j: F.lag("x", j).over(near) for j in range(1, k + 1)}
    after = {j: F.lead("x", j).over(near) for j in range(1, k + 1)}
    held = placed.withColumns({f"__b{j}": c for j, c in before.items()} | {f"__a{j}": c for j, c in after.items()})
    held = held.filter("__own").join(sizes, F.col("y") == F.col("__y"))
    own_k = F.least(F.lit(k), F.col("own") - 1)
    radius = F.lit(None).cast("double")
    for kk in range(1, k + 1):
        # The kk nearest are j before and kk - j behind the row; the farthest of them is their radius.
        ends = []
        for j in range(kk + 1):
            sides = ([F.col("x") - F.col(f"__b{j}")] if j else []) + ([F.col(f"__a{kk - j}") - F.col("x")] if kk - j else [])
            whole = F.greatest(*sides) if len(sides) > 1 else sides[0]
            missing = (F.col(f"__b{j}").isNull() if j else F.lit(False)) | (F.col(f"__a{kk - j}").isNull() if kk - j else F.lit(False))
            ends.append(F.when(~missing, whole))
        radius = F.when(own_k == kk, F.least(*ends)).otherwise(radius)
    reached = held.withColumns({"k": own_k, "r": radius})
    # An end at which a neighbour lies is that neighbour's value: a sum may round past it.
    low, high = F.col("x") - F.col("r"), F.col("x") + F.col("r")
    for j in range(1, k + 1):
        low = F.when(F.col("x") - F.col(f"__b{j}") == F.col("r"), F.col(f"__b{j}")).otherwise(low)
        high = F.when(F.col(f"__a{j}") - F.col("x") == F.col("r"), F.col(f"__a{j}")).otherwise(high)
    spans = checkpointed(reached.select("x", "r", "own", "k", low.alias("low"), high.alias("high")))
    n = spans.count()
    if not n:
        return df.sparkSession.createDataFrame([(0.0,)], "mi double")
    marks = spans.select(F.col("x").alias("v"), F.lit(1).cast("long").alias("c"))
    for end in ("low", "high"):
        marks = marks.unionByName(spans.select(F.col(end).alias("v"), F.lit(0).cast("long").alias("c")))
    at = marks.groupBy("v").agg(F.sum("c").alias("own_c")).withColumn("up_to", F.col("own_c"))
    sums = checkpointed(running_sums(at, "v", ["up_to"]).select("v", "up_to", (F.col("up_to") - F.col("own_c")).alias("below")))
    lows = sums.select(F.col("v").alias("low"), F.col("up_to").alias("low_to"), F.col("below").alias("low_below"))
    highs = sums.select(F.col("v").alias("high"), F.col("up_to").alias("high_to"), F.col("below").alias("high_below"))
    inside = F.when(F.col("r") > 0, F.col("high_below") - F.col("low_to")).otherwise(F.col("high_to") - F.col("low_below"))
    m = spans.join(lows, "low").join(highs, "high").withColumn("m", inside)
    psi = m.agg(*(F.avg(digamma(F.col(c).cast("double"))).alias(c) for c in ("k", "own", "m")))
    return psi.select(F.greatest(F.lit(0.0), digamma(F.lit(float(n))) + F.col("k") - F.col("own") - F.col("m")).alias("mi"))

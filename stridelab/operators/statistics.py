"""Summaries and statistics of samples and features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .distributed import quantiles, running_sums


def summary(df: DataFrame, keys: Sequence[str], event: Column, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Per group: events, samples, share of events in per cent (two digits), and further aggregates."""
    out = df.groupBy(*keys).agg(F.sum(event.cast("long")).alias("fog_count"), F.count(event).alias("total_samples"), *(x.alias(n) for n, x in (extra or {}).items()))
    return out.withColumn("fog_percentage", F.round(F.col("fog_count") / F.col("total_samples") * 100, 2))


def flag_summary(df: DataFrame, flags: Mapping[str, str]) -> DataFrame:
    """One row per flag plus ``Any`` and ``None``: how many rows have it, and their share in per cent.

    ``flags``: name by column. The classes may overlap. One pass over ``df``.
    """
    set_ = {name: F.coalesce(F.col(c) == 1, F.lit(False)) for c, name in flags.items()}
    some = F.lit(False)
    for x in set_.values():
        some = some | x
    classes = {**set_, "Any": some, "None": ~some}
    one = df.agg(F.count("*").alias("n"), *(F.sum(x.cast("long")).alias(f"c{i}") for i, x in enumerate(classes.values())))
    rows = F.explode(F.array(*(F.struct(F.lit(name).alias("event_type"), F.col(f"c{i}").alias("count")) for i, name in enumerate(classes))))
    return one.select("n", rows.alias("r")).select("r.event_type", "r.count", (F.col("r.count") / F.col("n") * 100).alias("percentage"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std (of a sample), min, exact quartiles and max: one row per column."""
    parts = []
    for i, c in enumerate(columns):
        x = F.col(c)
        parts.append(F.struct(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).cast("double").alias("min"), F.max(x).cast("double").alias("max")).alias(f"s{i}"))
    middle = quantiles(df, columns, [0.25, 0.5, 0.75])
    q = [F.array(*(F.lit(v).cast("double") for v in middle[c])) for c in columns]
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("s"), q[i].alias("q")) for i, c in enumerate(columns))))
    out = df.agg(*parts).select(rows.alias("r"))
    s, at = F.col("r.s"), F.col("r.q")
    return out.select(F.col("r.column").alias("column"), s["count"].alias("count"), s["mean"].alias("mean"), s["std"].alias("std"), s["min"].alias("min"), at[0].alias("q25"), at[1].alias("q50"), at[2].alias("q75"), s["max"].alias("max"))


def unpivoted(df: DataFrame, make, columns: Sequence[str], value: str) -> DataFrame:
    """One aggregate per column in one pass, as rows (column, value)."""
    one = df.agg(*(make(F.col(c)).alias(f"v{i}") for i, c in enumerate(columns)))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"v{i}").alias(value)) for i, c in enumerate(columns))))
    return one.select(rows.alias("r")).select("r.column", f"r.{value}")


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return unpivoted(df, lambda x: F.count_if(x.isNull()), columns, "nulls")


def constant_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns with at most one distinct value, null counted as one; all columns of an empty table.

    One partial aggregate: the least and the largest value, and the nulls.
    """

    def constant(x: Column) -> Column:
        return F.min(x).eqNullSafe(F.max(x)) & F.count(x).isin(F.lit(0), F.count("*"))

    return unpivoted(df, constant, columns, "constant").filter("constant").select("column")


def top_variance(df: DataFrame, columns: Sequence[str], n: int) -> DataFrame:
    return unpivoted(df, F.var_samp, columns, "variance").orderBy(F.desc("variance"), "column").limit(n)


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson's r of each pair of columns (a before b), over the rows that have both; one pass."""
    pairs = list(combinations(columns, 2))
    whole = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(a).cast("double"))
    one = df.agg(*(F.corr(whole(a, b), whole(b, a)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    rows = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs))))
    return one.select(rows.alias("x")).select("x.a", "x.b", "x.r")


def rank_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as average ranks, for Spearman's correlation (``correlations`` of these); null stays null.

    Ranks are found over each column's distinct values, in stretches.
    """
    out = df
    for i, c in enumerate(columns):
        counts = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias(f"__v{i}")).agg(F.count("*").alias("n")).withColumn("up_to", F.col("n"))
        ranks = running_sums(counts, f"__v{i}", ["up_to"]).select(f"__v{i}", (F.col("up_to") - (F.col("n") - 1) / 2).alias(f"__r{i}"))
        out = out.join(ranks, F.col(c) == F.col(f"__v{i}"), "left")
    return out.withColumns({c: F.col(f"__r{i}") for i, c in enumerate(columns)}).select(*df.columns)


def high_pairs(r: DataFrame, above: float = 0.9, n: int = 10) -> DataFrame:
    finite = F.col("r").isNotNull() & ~F.isnan("r")
    return r.filter(finite & (F.abs("r") > above)).orderBy(F.desc(F.abs("r")), "a", "b").limit(n)


def cohens_d(df: DataFrame, columns: Sequence[str], label: Column) -> DataFrame:
    """The absolute standardised difference between two classes (label 1 and 0) of each column.

    0 where the pooled deviation is 0.
    """
    parts = []
    for i, c in enumerate(columns):
        for k in (0, 1):
            x = F.when(label == k, F.col(c))
            parts += [F.count(x).alias(f"n{i}_{k}"), F.avg(x).alias(f"m{i}_{k}"), F.var_samp(x).alias(f"v{i}_{k}")]
    one = df.agg(*parts)

    def effect(i: int) -> Column:
        n0, n1 = F.col(f"n{i}_0"), F.col(f"n{i}_1")
        pooled = F.sqrt(((n0 - 1) * F.col(f"v{i}_0") + (n1 - 1) * F.col(f"v{i}_1")) / (n0 + n1 - 2))
        return F.when(pooled > 0, F.abs(F.col(f"m{i}_1") - F.col(f"m{i}_0")) / pooled).otherwise(F.lit(0.0))

    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), effect(i).alias("d")) for i, c in enumerate(columns))))
    return one.select(rows.alias("r")).select("r.column", "r.d")


def histogram(df: DataFrame, x: str, bins: int) -> DataFrame:
    """Counts of equal bins between the least and the largest value; the last bin has both its edges."""
    ends = df.agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    place = F.when(width > 0, F.floor((F.col(x) - F.col("__lo")) / width)).otherwise(0)
    counted = df.filter(F.col(x).isNotNull()).join(F.broadcast(ends)).select(F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))  # one row of ends
    counts = counted.groupBy("bin").agg(F.count("*").alias("count"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("count"))


def top_per_group(df: DataFrame, group: str, value: str, key: str, n: int) -> DataFrame:
    """The ``n`` largest of each group; ties by key. Spark limits each group before the shuffle."""
    best = Window.partitionBy(group).orderBy(F.desc(value), key)
    return df.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)


def cumulative_count(df: DataFrame, value: str, key: str, shares: Sequence[float]) -> DataFrame:
    """How many of the largest values it takes to pass each share of the total (over a small table)."""
    running = Window.orderBy(F.desc(value), key).rowsBetween(Window.unboundedPreceding, 0)
    total = df.agg(F.sum(value).alias("__total"))
    cumulated = df.withColumn("cum", F.sum(value).over(running)).join(F.broadcast(total)).withColumn("cum", F.col("cum") / F.col("__total"))  # one row
    one = cumulated.agg(*((F.count_if(F.col("cum") <= q) + 1).alias(f"k{round(q * 100)}") for q in shares))
    return one

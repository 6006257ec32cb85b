"""Time-domain features of a signal, as aggregates over long-form windows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAMES = ["mean", "std", "skew", "kurt", "median", "iqr", "rms", "peak_to_peak", "zero_crossing_rate"]


def samples(windows: DataFrame, keys: Sequence[str], signal: str, pos: str = "i", out: str = "x") -> DataFrame:
    """Windows as one row per sample."""
    return windows.select(*keys, F.posexplode(signal).alias(pos, out)).withColumn(out, F.col(out).cast("double"))


def time_features(rows: DataFrame, keys: Sequence[str], x: str = "x", pos: str = "i") -> DataFrame:
    """The nine features of each window of long-form ``rows``.

    Moments are those of the population; skew and kurtosis of a constant signal
    are null. The crossing rate counts changes of sign (to and from zero too)
    over the number of samples.
    """
    ordered = Window.partitionBy(*keys).orderBy(pos)
    crossing = F.coalesce(F.signum(F.col(x)) != F.signum(F.lag(x).over(ordered)), F.lit(False)).cast("int")
    quartiles = F.percentile(x, F.array(F.lit(0.25), F.lit(0.75)))
    out = rows.withColumn("__cross", crossing).groupBy(*keys).agg(
        F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("std"),
        F.skewness(x).alias("skew"),
        F.kurtosis(x).alias("kurt"),
        F.median(x).alias("median"),
        quartiles.alias("__q"),
        F.sqrt(F.avg(F.col(x) * F.col(x))).alias("rms"),
        (F.max(x) - F.min(x)).alias("peak_to_peak"),
        (F.sum("__cross") / F.count("*")).alias("zero_crossing_rate"),
    )
    return out.withColumn("iqr", F.col("__q")[1] - F.col("__q")[0]).select(*keys, *NAMES)


def local_maxima(rows: DataFrame, keys: Sequence[str], x: str = "x", pos: str = "i") -> DataFrame:
    """Rows strictly above both neighbours (plateaus are left to ``peaks``)."""
    ordered = Window.partitionBy(*keys).orderBy(pos)
    out = rows.withColumns({"__a": F.lag(x).over(ordered), "__b": F.lead(x).over(ordered)})
    return out.filter((F.col(x) > F.col("__a")) & (F.col(x) > F.col("__b"))).drop("__a", "__b")


def peaks(x: np.ndarray, distance: int) -> np.ndarray:
    """Local maxima (a plateau's middle; no edges) at least ``distance`` apart.

    The highest stay; of equal heights the later one.
    """
    if len(x) < 3:
        return np.zeros(0, dtype=int)
    change = np.flatnonzero(np.diff(x)) + 1
    starts, ends = np.r_[0, change], np.r_[change, len(x)]
    heights = x[starts]
    inner = np.arange(1, len(starts) - 1)
    top = inner[(heights[inner] > heights[inner - 1]) & (heights[inner] > heights[inner + 1])]
    places = (starts[top] + ends[top] - 1) // 2
    keep = np.ones(len(places), dtype=bool)
    for k in np.argsort(x[places], kind="stable")[::-1]:
        if keep[k]:
            near = np.abs(places - places[k]) < distance
            near[k] = False
            keep &= ~near
    return places[keep]


def cadence(signal: Column, rate: float = 64, min_seconds: float = 0.3) -> Column:
    """Steps per minute from the peaks of each window."""
    distance = max(1, int(min_seconds * rate))

    @F.pandas_udf("double")
    def steps(batch: pd.Series) -> pd.Series:
        found = [None if v is None else np.asarray(v, dtype=float) for v in batch]
        return pd.Series([None if v is None else (len(peaks(v, distance)) / (len(v) / rate / 60) if len(v) else 0.0) for v in found], dtype="float64")

    return steps(signal)

"""All features of windows: per channel, per magnitude of a channel group, and one cadence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import nonlinear, spectral, time_domain, wavelet

FAMILIES = {"time": time_domain.NAMES, "frequency": spectral.NAMES, "wavelet": wavelet.NAMES, "nonlinear": nonlinear.NAMES}


def magnitude(channels: Sequence[Column]) -> Column:
    """The Euclidean norm over channels, sample by sample."""
    squares = F.transform(channels[0], lambda x: x.cast("double") * x.cast("double"))
    for c in channels[1:]:
        squares = F.zip_with(squares, c, lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.transform(squares, F.sqrt)


def cadence_group(groups: Mapping[str, Sequence[int]]) -> str:
    """The first group whose name starts with ``acc``, else the first."""
    return next((g for g in groups if g.startswith("acc")), next(iter(groups)))


def feature_names(n_channels: int, groups: Mapping[str, Sequence[int]] | None = None, families: Sequence[str] = tuple(FAMILIES)) -> list[str]:
    """Names in order. Without groups there is one magnitude over all channels, ``mag_``."""
    own = [n for f in families for n in FAMILIES[f]]
    prefixes = [f"ch{i}_" for i in range(n_channels)] + ([f"{g}_mag_" for g in groups] if groups else ["mag_"])
    return [p + n for p in prefixes for n in own] + ["cadence"]


def _time_struct(signal: Column) -> Column:
    """The time-domain features of an array, without leaving the row."""
    x = F.transform(signal, lambda v: v.cast("double"))
    n = F.size(x).cast("double")
    total = lambda f: F.aggregate(x, F.lit(0.0), lambda a, v: a + f(v))
    mean = total(lambda v: v) / n
    # A struct field computed once, so each moment reads the mean rather than sums again.
    return F.transform(F.array(F.struct(x.alias("x"), mean.alias("m"), F.array_sort(x).alias("s"))), lambda r: _from_moments(r["x"], r["m"], r["s"], n))[0]


def _from_moments(x: Column, mean: Column, ordered: Column, n: Column) -> Column:
    moment = lambda k: F.aggregate(x, F.lit(0.0), lambda a, v: a + F.pow(v - mean, F.lit(k))) / n
    m2 = moment(2.0)

    def quantile(q: float) -> Column:
        place = (n - 1) * q
        low = F.floor(place).cast("int")
        a, b = F.get(ordered, low), F.coalesce(F.get(ordered, low + 1), F.get(ordered, low))
        return a + (b - a) * (place - low)

    pairs = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: (F.signum(a) != F.signum(b)).cast("int"))
    return F.struct(
        mean.alias("mean"),
        F.sqrt(m2).alias("std"),
        F.when(m2 > 0, moment(3.0) / F.pow(m2, F.lit(1.5))).alias("skew"),
        F.when(m2 > 0, moment(4.0) / (m2 * m2) - 3).alias("kurt"),
        quantile(0.5).alias("median"),
        (quantile(0.75) - quantile(0.25)).alias("iqr"),
        F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / n).alias("rms"),
        (F.array_max(x) - F.array_min(x)).alias("peak_to_peak"),
        (F.aggregate(pairs, F.lit(0), lambda a, v: a + v) / n).alias("zero_crossing_rate"),
    )


def feature_table(windows: DataFrame, keys: Sequence[str], channels: Sequence[str], groups: Mapping[str, Sequence[int]] | None = None, rate: float = 64, families: Sequence[str] = tuple(FAMILIES)) -> DataFrame:
    """One row per window: keys, features in ``feature_names`` order. No shuffle."""
    signals = {f"ch{i}_": F.col(c) for i, c in enumerate(channels)}
    if groups:
        signals |= {f"{g}_mag_": magnitude([F.col(channels[i]) for i in members]) for g, members in groups.items()}
        walking = f"{cadence_group(groups)}_mag_"
    else:
        signals["mag_"] = magnitude([F.col(c) for c in channels])
        walking = "mag_"
    arrays = windows.select(*keys, *(s.alias(p) for p, s in signals.items()))
    make = {"time": _time_struct, "frequency": lambda s: spectral.frequency_features(s, rate), "wavelet": wavelet.wavelet_features, "nonlinear": nonlinear.nonlinear_features}
    structs = arrays.select(*keys, *(make[f](F.col(p)).alias(f"{p}|{f}") for p in signals for f in families), time_domain.cadence(F.col(walking), rate).alias("cadence"))
    return structs.select(*keys, *(F.col(f"`{p}|{f}`.{n}").alias(p + n) for p in signals for f in families for n in FAMILIES[f]), "cadence")

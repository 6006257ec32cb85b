"""Spectral features from Welch's estimate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The bands (Hz, both ends included) and the least power that counts.
LOCOMOTION_BAND = (0.5, 3.0)
FREEZE_BAND = (3.0, 8.0)
LEAST_POWER = 1e-12
SEGMENT = 256

NAMES = ["psd_peak_freq", "psd_total_energy", "spectral_centroid", "power_loco_band", "power_freeze_band", "freezing_index", "locomotion_band_index"]
FEATURES = T.StructType([T.StructField(n, T.DoubleType()) for n in NAMES])


def welch(x: np.ndarray, rate: float = 64, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and one-sided density: periodic Hann, half overlap, each segment's mean removed.

    ``x`` may hold several signals of one length, one per row.
    """
    x = np.atleast_2d(np.asarray(x, dtype=float))
    n = x.shape[1]
    size = min(segment, n)
    hop = size - size // 2
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    parts = np.lib.stride_tricks.sliding_window_view(x, size, axis=1)[:, ::hop]
    parts = parts - parts.mean(axis=2, keepdims=True)
    power = np.abs(np.fft.rfft(parts * window, axis=2)) ** 2 / (rate * np.sum(window**2))
    power[..., 1 : -1 if size % 2 == 0 else None] *= 2
    return np.arange(size // 2 + 1) * rate / size, power.mean(axis=1)


def trapezoid(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    return ((y[..., 1:] + y[..., :-1]) * np.diff(x) / 2).sum(axis=-1)


def band_power(f: np.ndarray, p: np.ndarray, band: tuple[float, float]) -> np.ndarray:
    inside = (f >= band[0]) & (f <= band[1])
    return trapezoid(p[..., inside], f[inside]) if inside.any() else np.zeros(p.shape[:-1])


def features(x: np.ndarray, rate: float = 64) -> np.ndarray:
    """The seven features of signals of one length, one row each; NaN where undefined."""
    f, p = welch(x, rate)
    with np.errstate(invalid="ignore", divide="ignore"):
        total, mass = trapezoid(p, f), p.sum(axis=1)
        loco, freeze = band_power(f, p, LOCOMOTION_BAND), band_power(f, p, FREEZE_BAND)
        centroid = np.where(mass > 0, (p * f).sum(axis=1) / mass, np.nan)
        index = np.where(loco > LEAST_POWER, freeze / loco, np.nan)
        share = np.where(total > 0, loco / total, 0.0)
    return np.stack([f[p.argmax(axis=1)], total, centroid, loco, freeze, index, share], axis=1)


def by_length(batch: pd.Series) -> Iterator[tuple[list[int], np.ndarray]]:
    """A batch's signals stacked by length, with their places; null and empty ones are left out."""
    groups: dict[int, list[int]] = {}
    values = list(batch)
    for i, v in enumerate(values):
        if v is not None and len(v):
            groups.setdefault(len(v), []).append(i)
    for places in groups.values():
        yield places, np.stack([np.asarray(values[i], dtype=float) for i in places])


def frequency_features(signal: Column, rate: float = 64) -> Column:
    """A struct of the seven features; null for a null signal, and null fields where undefined."""

    @F.pandas_udf(FEATURES)
    def run(batch: pd.Series) -> pd.DataFrame:
        out = np.full((len(batch), len(NAMES)), np.nan)
        for places, x in by_length(batch):
            out[places] = features(x, rate)
        return pd.DataFrame(out, columns=NAMES).astype(object).where(~np.isnan(out), None)

    return run(signal)


def density(signal: Column, rate: float = 64, segment: int = SEGMENT) -> Column:
    """The density of each frequency bin, as an array."""

    @F.pandas_udf("array<double>")
    def run(batch: pd.Series) -> pd.Series:
        out: list = [None] * len(batch)
        for places, x in by_length(batch):
            for i, row in zip(places, welch(x, rate, segment)[1], strict=True):
                out[i] = row
        return pd.Series(out, dtype=object)

    return run(signal)

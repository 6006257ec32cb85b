"""Daubechies-4 wavelet features."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spectral import by_length

# The published low-pass analysis taps of db4.
LOW = np.array([-0.010597401784997278, 0.032883011666982945, 0.030841381835986965, -0.18703481171888114, -0.02798376941698385, 0.6308807679295904, 0.7148465705525415, 0.23037781330885523])
HIGH = -LOW[::-1] * (-1.0) ** np.arange(8)
LEVELS = 3
NAMES = [f"wavelet_energy_{i}" for i in range(4)] + ["wavelet_entropy"] + [f"wavelet_var_{i}" for i in range(4)]
FEATURES = T.StructType([T.StructField(n, T.DoubleType()) for n in NAMES])


def step(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level of approximation and detail; the signal is mirrored at its ends, edge samples doubled."""
    n = x.shape[1]
    places = 2 * np.arange((n + 7) // 2)[:, None] + 1 - np.arange(8)[None, :]
    period = places % (2 * n)
    mirrored = np.where(period < n, period, 2 * n - 1 - period)
    taken = x[:, mirrored]
    return taken @ LOW, taken @ HIGH


def decompose(x: np.ndarray, levels: int = LEVELS) -> list[np.ndarray]:
    """Approximation, then details from the coarsest to the finest."""
    approximation, details = np.atleast_2d(np.asarray(x, dtype=float)), []
    for _ in range(levels):
        approximation, detail = step(approximation)
        details.append(detail)
    return [approximation, *reversed(details)]


def features(x: np.ndarray) -> np.ndarray:
    bands = decompose(x)
    energy = np.stack([(b**2).sum(axis=1) for b in bands], axis=1)
    total = energy.sum(axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        p = np.where(total > 0, energy / total, np.nan)
        entropy = np.where(total[:, 0] > 0, -np.nansum(np.where(p > 0, p * np.log(p), 0.0), axis=1), np.nan)
    return np.concatenate([energy, entropy[:, None], np.stack([b.var(axis=1) for b in bands], axis=1)], axis=1)


def wavelet_features(signal: Column) -> Column:
    @F.pandas_udf(FEATURES)
    def run(batch: pd.Series) -> pd.DataFrame:
        out = np.full((len(batch), len(NAMES)), np.nan)
        for places, x in by_length(batch):
            out[places] = features(x)
        return pd.DataFrame(out, columns=NAMES).astype(object).where(~np.isnan(out), None)

    return run(signal)


def coefficients(signal: Column) -> Column:
    """The four bands as an array of arrays."""

    @F.pandas_udf("array<array<double>>")
    def run(batch: pd.Series) -> pd.Series:
        out: list = [None] * len(batch)
        for places, x in by_length(batch):
            bands = decompose(x)
            for row, i in enumerate(places):
                out[i] = [b[row] for b in bands]
        return pd.Series(out, dtype=object)

    return run(signal)

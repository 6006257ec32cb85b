"""Entropies and fractal dimension of a signal."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMES = ["sample_entropy", "approx_entropy", "higuchi_fd"]
#: Embedding length, tolerance as a share of the deviation, and the longest lag.
M, R_SHARE, K_MAX = 2, 0.2, 10


def _matches(x: np.ndarray, m: int, r: float | None) -> list[np.ndarray]:
    """For runs of m and of m + 1 samples: of each, the runs (itself included) within r of it in every sample."""
    r = R_SHARE * float(np.std(x)) if r is None else r
    near = np.abs(x[:, None] - x[None, :]) <= r
    n = len(x) - m + 1
    both = near[:n, :n].copy()
    for i in range(1, m):
        both &= near[i : i + n, i : i + n]
    longer = both[: n - 1, : n - 1] & near[m : m + n - 1, m : m + n - 1]
    return [both.sum(axis=1), longer.sum(axis=1)]


def sample_entropy(x: np.ndarray, m: int = M, r: float | None = None, found: list[np.ndarray] | None = None) -> float:
    """With n - m + 1 runs at either length; NaN if one has no match or the signal is too short."""
    if len(x) <= m + 1:
        return math.nan
    share = []
    for own in found or _matches(x, m, r):
        n = len(own)
        share.append((own.sum() - n) / (n * (n - 1)) if n > 1 else 0.0)
    return -math.log(share[1] / share[0]) if share[0] > 0 and share[1] > 0 else math.nan


def approx_entropy(x: np.ndarray, m: int = M, r: float | None = None, found: list[np.ndarray] | None = None) -> float:
    """Self-matches count; NaN for a signal of at most m samples."""
    if len(x) <= m:
        return math.nan
    shorter, longer = (float(np.mean(np.log(own / len(own)))) for own in found or _matches(x, m, r))
    return shorter - longer


def curve_lengths(x: np.ndarray, k_max: int = K_MAX) -> np.ndarray:
    """Mean curve lengths of windows (rows of ``x``) at the lags 1 to ``k_max``.

    All differences at a lag are one strided subtraction; each counts by the
    number of steps of the curve that it belongs to. 0 at lags without steps.
    """
    rows, n = x.shape
    out = np.zeros((rows, k_max))
    for k in range(1, min(k_max, n - 1) + 1):
        start = np.arange(n - k) % k
        steps = (n - 1 - start) // k
        out[:, k - 1] = np.abs(x[:, k:] - x[:, :-k]) @ ((n - 1) / (steps * k)) / k
    return out


def higuchi_rows(x: np.ndarray, k_max: int = K_MAX, textbook: bool = False) -> np.ndarray:
    """Slope of log curve length over log lag, negated, of each row of ``x``; NaN for short or flat ones.

    Lengths are not divided by the lag a second time, so the value is one less
    than the textbook's, which ``textbook`` gives.
    """
    if x.shape[1] < 4:
        return np.full(len(x), math.nan)
    with np.errstate(divide="ignore", invalid="ignore"):
        logs = np.log(curve_lengths(x, k_max))
        lags = np.log(np.arange(1, k_max + 1))
        away = lags - lags.mean()
        slope = logs @ away / (away @ away)
    return np.where(np.isfinite(logs).all(axis=1), -slope + (1.0 if textbook else 0.0), math.nan)


def higuchi(x: np.ndarray, k_max: int = K_MAX, textbook: bool = False) -> float:
    """``higuchi_rows`` of one signal."""
    return float(higuchi_rows(np.asarray(x, dtype=float)[None, :], k_max, textbook)[0])


def nonlinear_features(signal: Column, m: int = M, r: float | None = None, k_max: int = K_MAX, names: Sequence[str] = NAMES) -> Column:
    """A struct of the features in ``names``. Memory is the square of a window's length, per window."""
    wanted = [n for n in NAMES if n in names]
    entropies = [f for f in ("sample_entropy", "approx_entropy") if f in wanted]
    plain = {"sample_entropy": sample_entropy, "approx_entropy": approx_entropy}

    @F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in wanted]))
    def run(batch: pd.Series) -> pd.DataFrame:
        signals = [None if v is None or not len(v) else np.asarray(v, dtype=float) for v in batch]
        out = {n: np.full(len(signals), math.nan) for n in wanted}
        by_size: dict[int, list[int]] = {}
        for i, x in enumerate(signals):
            if x is None:
                continue
            by_size.setdefault(len(x), []).append(i)
            found = _matches(x, m, r) if entropies and len(x) > m else None
            for name in entropies:
                out[name][i] = plain[name](x, m, r, found)
        if "higuchi_fd" in wanted:
            for at in by_size.values():
                out["higuchi_fd"][at] = higuchi_rows(np.stack([signals[i] for i in at]), k_max)
        return pd.DataFrame({n: pd.Series(np.where(np.isfinite(v), v, np.nan)).astype(object).where(np.isfinite(v), None) for n, v in out.items()})

    return run(signal)

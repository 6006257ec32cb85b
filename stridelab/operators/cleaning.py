"""Cleaning of windows: outliers by median absolute deviation, gaps by polynomial.

A window is a row with an array per channel. The fits run as Arrow UDFs over
batches of windows: a global least-squares polynomial has no aggregate form
that stays well conditioned for long windows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Makes the deviation comparable to a standard deviation of normal data.
MAD_SCALE = 1.4826
ARRAY = T.ArrayType(T.DoubleType())
#: Condition up to which the normal equations of a window are solved together with others.
WELL = 1e6


def outlier_mask(x: np.ndarray, threshold: float = 3.0) -> np.ndarray:
    """True for outliers. A window with a missing value has none.

    A zero deviation is replaced by the standard deviation, or by 1 if that is
    zero too.
    """
    if not len(x) or np.isnan(x).any():
        return np.zeros(len(x), dtype=bool)
    away = np.abs(x - np.median(x))
    spread = np.median(away) or float(np.std(x)) or 1.0
    return away > threshold * MAD_SCALE * spread


def _fitted(x: np.ndarray, bad: np.ndarray, order: int) -> np.ndarray:
    """``x`` with the bad places from a polynomial over the good ones (two at least)."""
    t = (np.arange(len(x)) - (len(x) - 1) / 2) / len(x)
    good = ~bad
    curve = np.polynomial.Polynomial.fit(t[good], x[good], min(order, int(good.sum()) - 1), domain=[-0.5, 0.5])
    out = x.copy()
    out[bad] = curve(t[bad])
    return out


def fill_outliers(x: np.ndarray, threshold: float = 3.0, order: int = 3) -> np.ndarray:
    bad = outlier_mask(x, threshold)
    if not bad.any():
        return x
    if (~bad).sum() >= 2:
        return _fitted(x, bad, order)
    out = x.copy()
    out[bad] = np.median(x)
    return out


def fill_missing(x: np.ndarray, order: int = 3) -> np.ndarray:
    """Gaps from a polynomial over the rest; one value repeats, none gives zeros."""
    bad = np.isnan(x)
    good = int((~bad).sum())
    if good == len(x):
        return x
    if good >= 2:
        return _fitted(x, bad, order)
    return np.where(bad, x[~bad][0] if good else 0.0, x)


def _refilled(x: np.ndarray, bad: np.ndarray, order: int) -> None:
    """Bad places of windows (rows of ``x``) from polynomials over their good ones, in place; two good ones at least.

    Windows with good places enough and well spread are fitted together, by
    the normal equations in Legendre polynomials; the others one by one.
    """
    at = np.flatnonzero(bad.any(axis=1))
    if not len(at):
        return
    size = x.shape[1]
    basis = np.polynomial.legendre.legvander(2 * (np.arange(size) - (size - 1) / 2) / size, order)
    good = ~bad[at]
    squares = (good @ (basis[:, :, None] * basis[:, None, :]).reshape(size, -1)).reshape(len(at), order + 1, order + 1)
    well = (good.sum(axis=1) > order) & (np.linalg.cond(squares) < WELL)
    if well.any():
        rows = at[well]
        sums = np.where(good[well], x[rows], 0.0) @ basis
        curves = np.linalg.solve(squares[well], sums[:, :, None])[:, :, 0] @ basis.T
        x[rows] = np.where(bad[rows], curves, x[rows])
    for row in at[~well]:
        x[row] = _fitted(x[row], bad[row], order)


def _outliers_refilled(x: np.ndarray, threshold: float, order: int) -> None:
    """``fill_outliers`` of each row of ``x``, in place."""
    whole = np.flatnonzero(~np.isnan(x).any(axis=1))
    own = x[whole]
    middle = np.median(own, axis=1, keepdims=True)
    away = np.abs(own - middle)
    spread, deviation = np.median(away, axis=1, keepdims=True), np.std(own, axis=1, keepdims=True)
    spread = np.where(spread != 0, spread, np.where(deviation != 0, deviation, 1.0))
    bad = away > threshold * MAD_SCALE * spread
    few = bad.any(axis=1) & ((~bad).sum(axis=1) < 2)
    own[few] = np.where(bad[few], middle[few], own[few])
    bad[few] = False
    _refilled(own, bad, order)
    x[whole] = own


def _gaps_refilled(x: np.ndarray, order: int) -> None:
    """``fill_missing`` of each row of ``x``, in place."""
    bad = np.isnan(x)
    for row in np.flatnonzero((~bad).sum(axis=1) < 2):
        x[row] = fill_missing(x[row], order)
    bad = np.isnan(x)
    _refilled(x, bad, order)


def _applied(f: Callable[[np.ndarray], None], x: Column) -> Column:
    """``f`` on stacks of windows of equal length."""

    @F.pandas_udf(ARRAY)
    def run(batch: pd.Series) -> pd.Series:
        windows = [None if v is None else np.asarray(v, dtype=float) for v in batch]
        by_size: dict[int, list[int]] = {}
        for i, v in enumerate(windows):
            if v is not None and len(v):
                by_size.setdefault(len(v), []).append(i)
        for at in by_size.values():
            stack = np.stack([windows[i] for i in at])
            f(stack)
            for i, row in zip(at, stack, strict=True):
                windows[i] = row
        return pd.Series(windows, dtype=object)

    return run(x)


def outliers_filled(x: Column, threshold: float = 3.0, order: int = 3) -> Column:
    return _applied(lambda v: _outliers_refilled(v, threshold, order), x)


def missing_filled(x: Column, order: int = 3) -> Column:
    return _applied(lambda v: _gaps_refilled(v, order), x)


def cleaned(x: Column, threshold: float = 3.0, outlier_order: int = 3, missing_order: int = 3, outliers: bool = True, missing: bool = True) -> Column:
    """Outliers first, then gaps, in one pass."""

    def both(v: np.ndarray) -> None:
        if outliers:
            _outliers_refilled(v, threshold, outlier_order)
        if missing:
            _gaps_refilled(v, missing_order)

    return _applied(both, x)


def clean_windows(windows: DataFrame, channels: list[str], **options) -> DataFrame:
    return windows.withColumns({c: cleaned(F.col(c), **options) for c in channels})


def outlier_rows(rows: DataFrame, keys: list[str], x: str = "x", threshold: float = 3.0) -> DataFrame:
    """The outliers of long-form windows (one row per sample), by aggregates alone.

    Adds ``is_outlier``. Both medians and the deviation share the partitioning
    by ``keys``.
    """
    from pyspark.sql import Window

    within = Window.partitionBy(*keys)
    out = rows.withColumns({"__median": F.median(x).over(within), "__gaps": F.max(F.col(x).isNull().cast("int")).over(within), "__std": F.stddev_pop(x).over(within)})
    out = out.withColumn("__away", F.abs(F.col(x) - F.col("__median")))
    out = out.withColumn("__mad", F.median("__away").over(within))
    spread = F.when(F.col("__mad") != 0, F.col("__mad")).when(F.col("__std") > 0, F.col("__std")).otherwise(1.0)
    flagged = (F.col("__gaps") == 0) & (F.col("__away") > threshold * MAD_SCALE * spread)
    return out.withColumn("is_outlier", F.coalesce(flagged, F.lit(False))).drop("__median", "__gaps", "__std", "__away", "__mad")

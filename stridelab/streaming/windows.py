"""Streaming extensions: event-time windows, sessions, and count windows that fill as rows arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.windows import Geometry


def event_windows(stream: DataFrame, time: str, keys: list[str], length: str, slide: str | None, late: str, aggregates: list[Column]) -> DataFrame:
    """Aggregates per event-time window; rows later than ``late`` are left out."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return stream.withWatermark(time, late).groupBy(window.alias("window"), *keys).agg(*aggregates)


def sessions(stream: DataFrame, time: str, keys: list[str], gap: str, late: str, aggregates: list[Column]) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("session"), *keys).agg(*aggregates)


def count_windows(stream: DataFrame, key: str, order: str, value: str, geometry: Geometry) -> DataFrame:
    """(key, k, mean) of each count window, emitted when its last row arrives.

    The state of a key is its open windows' rows (fewer than a window's size
    plus a step). Rows of one trigger are put in order; rows older than those
    of an earlier trigger count as they arrive.
    """
    kind = stream.schema[key].dataType.simpleString()
    size, step = geometry.size, geometry.step

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, first = state.get if state.exists else ([], 0)
        held = list(held)
        fresh = pd.concat(list(batches)).sort_values(order)
        held += fresh[value].astype(float).tolist()
        out = []
        while len(held) >= size:
            out.append((k[0], first, sum(held[:size]) / size))
            held, first = held[step:], first + 1
        state.update((held, first))
        yield pd.DataFrame(out, columns=[key, "k", "mean"])

    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, k long, mean double", "held array<double>, first long", "append", GroupStateTimeout.NoTimeout)

"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def nan_to_null(x: Column) -> Column:
    return F.nanvl(x, F.lit(None).cast("double"))


def finite(x: Column) -> Column:
    """NaN and infinities become null."""
    infinity = F.lit(float("inf"))
    return F.when((x == infinity) | (x == -infinity) | F.isnan(x), F.lit(None)).otherwise(x)


def mapped(x: Column, names: Mapping[int, str]) -> Column:
    """The name of a code; null for a code without one."""
    out = F.lit(None).cast("string")
    for code, name in names.items():
        out = F.when(x == code, name).otherwise(out)
    return out


def any_flag(*flags: Column) -> Column:
    """1 if any flag is 1, else 0; a null flag counts as not set."""
    out = F.lit(False)
    for flag in flags:
        out = out | F.coalesce(flag == 1, F.lit(False))
    return out.cast("int")


def equals_flag(x: Column, value: int) -> Column:
    """1 where ``x`` is ``value``, else 0 (null included)."""
    return F.coalesce(x == value, F.lit(False)).cast("int")


def code(prefix: str, number: Column, width: int = 0) -> Column:
    """A key such as ``S07``."""
    return F.format_string(f"{prefix}%0{width}d" if width else f"{prefix}%d", number.cast("long"))


def sensor_of(feature: Column, sensors: Mapping[int, str], prefixes: Sequence[str] = (), default: str = "Global") -> Column:
    """The sensor behind a feature's name: by channel number (``ch3_...``), by prefix, else ``default``."""
    channel = F.regexp_extract(feature, r"^ch(\d+)_", 1)
    out = F.lit(default)
    for prefix in reversed(prefixes):
        out = F.when(feature.startswith(prefix), prefix.rstrip("_")).otherwise(out)
    by_channel = F.lit(None).cast("string")
    for number, name in sensors.items():
        by_channel = F.when(channel == str(number), name).otherwise(by_channel)
    return F.when(channel != "", F.coalesce(by_channel, F.lit(default))).otherwise(out)


def effect_size_name(d: Column) -> Column:
    size = F.abs(d)
    return F.when(size >= 0.8, "Large").when(size >= 0.5, "Medium").when(size >= 0.2, "Small").otherwise("Negligible")

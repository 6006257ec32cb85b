"""Layouts of the raw recordings. All schemas are explicit; nothing is inferred."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Column names and file patterns of the five layouts.
_AXES3 = ("forward", "vertical", "lateral")
ANKLE_THIGH_TRUNK = ["time_ms", *(f"acc_{a}_{p}" for p in ("ankle", "thigh", "trunk") for a in _AXES3), "annotation"]
LOWER_BACK = ["frame", "time_s", *(f"{s}_{a}_lower_back" for s in ("acc", "gyr") for a in ("ml", "ap", "si")), "freezing_flag"]
FOOT_CHANNELS = [f"{s}_{a}" for s in ("acc", "gyr") for a in ("x", "y", "z")]
ONE_FOOT = ["time_s", *FOOT_CHANNELS, "fog_label"]
MULTIMODAL = ["frame_id", "timestamp", *(f"sensor_{i}" for i in range(1, 25)), *(f"raw_{i}" for i in range(1, 34)), "fog_label"]
EVENT_FLAGS = ["StartHesitation", "Turn", "Walking"]
# Label texts of the layouts.
FREEZE_TEXT = {0: "No Freeze", 1: "Freeze"}
FEET_TEXT = {0: "No FoG", 1: "FoG Active"}
MULTIMODAL_TEXT = {0: "No FoG", 1: "FoG Active"}

_INTEGERS = {"time_ms": T.IntegerType(), "annotation": T.IntegerType(), "freezing_flag": T.IntegerType(), "fog_label": T.IntegerType(), "frame": T.LongType(), "frame_id": T.LongType(), "timestamp": T.StringType()}


def struct(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, _INTEGERS.get(n, T.DoubleType())) for n in names])


@dataclass(frozen=True)
class Layout:
    """How a dataset's files look: pattern, separator, header, names and error policy."""

    pattern: str
    names: list[str] = field(default_factory=list)
    separator: str = ","
    header: bool = False
    rate: int = 64
    #: Whether one bad file ends the load, or is left out.
    fail_fast: bool = False


LAYOUTS = {
    "ankle_thigh_trunk": Layout("S*.txt", ANKLE_THIGH_TRUNK, r"\s+", False, 64, True),
    "lower_back": Layout("SUB*.txt", LOWER_BACK, "\t", True, 128),
    "both_feet": Layout("S*/*_foot_trial_*.csv", ONE_FOOT, ",", True, 200),
    "multimodal": Layout("*/task_*.txt", MULTIMODAL, ",", False, 500),
    "competition": Layout("*/*/*.csv", [], ",", True, 128),
}

"""Labels of samples: binary, onsets, and episodes with a lead-in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import equals_flag, mapped
from ..session import checkpointed

# Annotation codes and the names of multiclass labels.
NOT_IN_EXPERIMENT, NORMAL, EPISODE = 0, 1, 2
MULTICLASS_NAMES = {0: "No FoG", 1: "FoG", 2: "Pre-FoG"}
BINARY_NAMES = {0: "No FoG", 1: "FoG"}


def in_order(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def with_ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "pos", stretch: int | None = None) -> DataFrame:
    """The zero-based place of each row within its recording.

    A recording is put in order in one task. With ``stretch``, for recordings
    longer than that: all rows are dealt by ranges of keys and order, about
    ``stretch`` to a task, and written; a row's place is its place in its range
    behind the recording's rows in the ranges before.
    """
    if stretch is None:
        return df.withColumn(out, F.row_number().over(in_order(keys, order)).cast("long") - 1)
    parts = 1 + df.count() // stretch
    dealt = checkpointed(df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order))
    # In a written partition, rows are numbered as they lie there.
    rows = dealt.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    names = [f"__k{i}" for i in range(len(keys))]
    own = rows.groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col("__part").alias("__p")).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.sum("__n").over(Window.partitionBy(*names).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    bases = own.withColumn("__base", F.coalesce(before, F.lit(0)))
    same = F.col("__part") == F.col("__p")
    for k, n in zip(keys, names, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(n))
    return rows.join(bases, same).withColumn(out, F.col("__at") - F.col("__first") + F.col("__base")).drop("__part", "__at", "__p", "__n", "__first", "__base", *names)


def in_stretches(df: DataFrame, pos: str, stretch: int, behind: int, ahead: int, needed: Sequence[str], out: str = "__stretch", own: str = "__own") -> DataFrame:
    """Rows by stretches of ``stretch`` places, each with copies of its neighbours' rows near its ends.

    A stretch has the ``behind`` places before it and the ``ahead`` after it;
    a copy has only the columns ``needed`` and ``own`` false.
    """
    last = F.floor((F.col(pos) + behind) / stretch)
    first = F.greatest(F.lit(0), F.ceil((F.col(pos) - ahead + 1) / stretch) - 1)
    spread = df.withColumn(out, F.explode(F.sequence(first, last)))
    spread = spread.withColumn(own, F.col(out) == F.floor(F.col(pos) / stretch))
    return spread.withColumns({c: F.when(F.col(own), F.col(c)) for c in df.columns if c not in needed})


def onset(annotation: Column, within: WindowSpec, episode: int = EPISODE) -> Column:
    """1 where an episode begins. A recording's first row never counts as an onset."""
    before = F.lag(annotation).over(within)
    return F.coalesce((annotation == episode) & (before != episode), F.lit(False)).cast("int")


def lead_samples(seconds: float, rate: float) -> int:
    return int(seconds * rate)


def with_labels(df: DataFrame, keys: Sequence[str], order: Sequence[str], annotation: str = "annotation", lead: int = 32, episode: int = EPISODE, stretch: int | None = None) -> DataFrame:
    """``binary_label`` (in an episode or not) and ``multiclass_label``.

    The ``lead`` rows before an onset become class 2, unless in an episode
    themselves. Both need one partitioning by ``keys``. With ``stretch``, a
    recording is labelled in stretches of so many places, and ``order`` must
    be its ordinal: a stretch has the place before it and the ``lead`` after.
    """
    rows, within = df, in_order(keys, order)
    if stretch is not None:
        (pos,) = order
        rows = in_stretches(df, pos, stretch, 1, lead, [*keys, pos, annotation])
        within = in_order([*keys, "__stretch"], order)
    out = rows.withColumns({"binary_label": equals_flag(F.col(annotation), episode), "__onset": onset(F.col(annotation), within, episode)})
    if lead > 0:
        ahead = F.max("__onset").over(within.rowsBetween(1, lead))
        label = F.when((F.col("binary_label") == 0) & (ahead == 1), 2).otherwise(F.col("binary_label"))
    else:
        label = F.col("binary_label")
    out = out.withColumn("multiclass_label", label.cast("int")).drop("__onset")
    return out if stretch is None else out.filter("__own").drop("__stretch", "__own")


def label_distribution(df: DataFrame, label: str, names: dict[int, str] = MULTICLASS_NAMES) -> DataFrame:
    """label, count, percentage (two digits) and name, one row per label."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy())  # over a few labels
    return counts.select("label", "count", F.round(F.col("count") / total * 100, 2).alias("percentage"), mapped(F.col("label"), names).alias("label_name"))

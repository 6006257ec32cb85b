"""Count-based sliding windows within a recording, and leave-one-subject-out folds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Geometry:
    """Window length and step in samples; both are truncated, not rounded."""

    size: int
    step: int

    @classmethod
    def of(cls, seconds: float = 4.0, overlap: float = 0.5, rate: float = 64) -> Geometry:
        size = int(seconds * rate)
        step = int(size * (1 - overlap))
        if size < 1 or step < 1:
            raise ValueError("a window and its step need at least one sample")
        return cls(size, step)

    def count(self, rows: int) -> int:
        """The windows of a recording of so many rows; a partial tail is none."""
        return max(0, (rows - self.size) // self.step + 1)

    def info(self, rate: float) -> dict[str, float]:
        return {"window_samples": self.size, "step_samples": self.step, "window_seconds": self.size / rate, "overlap": 1 - self.step / self.size}


def _reach(geometry: Geometry, pos: str) -> tuple[Column, Column]:
    """The first and the last window that a row lies in."""
    first = F.greatest(F.lit(0), F.ceil((F.col(pos) - geometry.size + 1) / geometry.step)).cast("long")
    return first, F.floor(F.col(pos) / geometry.step).cast("long")


def assigned(df: DataFrame, geometry: Geometry, pos: str = "pos", out: str = "k") -> DataFrame:
    """Each row once for every window that it lies in (ceil(size / step) at most)."""
    if geometry.step == geometry.size:
        return df.withColumn(out, F.floor(F.col(pos) / geometry.size).cast("long"))
    return df.withColumn(out, F.explode(F.sequence(*_reach(geometry, pos))))


def sliding(df: DataFrame, geometry: Geometry, keys: Sequence[str], channels: Sequence[str] = (), labels: Sequence[str] = (), pos: str = "pos", aggregates: Sequence = (), stretch: int | None = None) -> DataFrame:
    """One row per complete window: keys, k, an array per channel and a vote per label.

    Ties of a vote go to the smallest label. The rows are grouped by the keys'
    own partitioning, so numbering rows before costs no second shuffle. With
    ``stretch``, for recordings longer than a task should hold, windows are
    dealt by the stretch of so many places in which they begin; only the rows
    near a stretch's end are sent to two.
    """
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(pos, F.col(c).alias("x")))), lambda s: s["x"])
    if stretch is None:
        rows, by = assigned(df, geometry, pos), [*keys, "k"]
    else:
        begin = lambda k: F.floor(k * geometry.step / stretch)
        first, last = _reach(geometry, pos)
        dealt = df.withColumn("__stretch", F.explode(F.sequence(begin(first), begin(last)))).repartition(*keys, "__stretch")
        rows = assigned(dealt, geometry, pos).filter(F.col("__stretch") == begin(F.col("k")))
        by = [*keys, "__stretch", "k"]
    grouped = rows.groupBy(*by).agg(
        F.count("*").alias("__n"),
        *(ordered(c).alias(c) for c in channels),
        *(F.mode(c, True).alias(c) for c in labels),
        *aggregates,
    )
    return grouped.filter(F.col("__n") == geometry.size).drop("__n", "__stretch")


#: Folds of a list, folds of all lists up to which these are sent to every task, and tagged rows that are worth a task.
FOLDS, SENT_FOLDS, TAGGED = 4096, 1 << 20, 1 << 24


def leave_one_out(train: DataFrame, test: DataFrame, subject: str = "subject") -> DataFrame:
    """(fold, role) of each window: train where the subject differs, test where it is the fold's.

    Folds are the distinct subjects of ``test``. Rows multiply by the number of
    folds, as the operator is defined; take ``fold_counts`` where counts are
    enough. They meet the folds in lists of bounded length, which a row goes
    through in the task that has it; rows are dealt evenly before, by the
    number that they become.
    """
    folds = test.filter(F.col(subject).isNotNull()).select(F.col(subject).alias("fold")).distinct()
    n = folds.count()
    lists = max(1, -(-n // FOLDS))
    listed = folds.groupBy(F.pmod(F.xxhash64("fold"), F.lit(lists)).alias("__list")).agg(F.collect_list("fold").alias("__folds"))
    dealt = train.repartition(1 + train.count() * n // TAGGED)
    if n <= SENT_FOLDS:
        met = dealt.crossJoin(F.broadcast(listed))
    else:
        met = dealt.withColumn("__list", F.explode(F.sequence(F.lit(0), F.lit(lists - 1)).cast("array<bigint>"))).join(listed, "__list")
    trained = met.select(*train.columns, F.explode("__folds").alias("fold")).filter(F.col(subject) != F.col("fold")).withColumn("role", F.lit("train"))
    tested = test.withColumn("fold", F.col(subject)).withColumn("role", F.lit("test"))
    return trained.unionByName(tested)


def fold_counts(train: DataFrame, test: DataFrame, label: str, classes: Sequence[int], subject: str = "subject") -> DataFrame:
    """Windows per class of each (fold, role), without multiplying any row.

    A fold's training counts are the totals less the subject's own.
    """
    names = [f"class_{c}" for c in classes]
    per_class = [F.sum((F.col(label) == c).cast("long")).alias(n) for c, n in zip(classes, names, strict=True)]
    own = train.groupBy(subject).agg(*per_class)
    total = train.agg(*(x.alias(f"all_{n}") for x, n in zip(per_class, names, strict=True)))
    tested = test.groupBy(F.col(subject).alias("fold")).agg(*per_class)
    trained = tested.select("fold").join(own, F.col("fold") == F.col(subject), "left").join(F.broadcast(total))  # one row
    trained = trained.select("fold", F.lit("train").alias("role"), *((F.coalesce(F.col(f"all_{n}"), F.lit(0)) - F.coalesce(F.col(n), F.lit(0))).alias(n) for n in names))
    return tested.select("fold", F.lit("test").alias("role"), *names).unionByName(trained)


def evaluable(counts: DataFrame, classes: Sequence[int] = (0, 1)) -> DataFrame:
    """Folds whose test windows have all the classes."""
    return counts.filter((F.col("role") == "test") & (F.least(*(F.col(f"class_{c}") for c in classes)) > 0)).select("fold")


def context(df: DataFrame, keys: Sequence[str], event: Column, half: int, pos: str = "pos", time: str | None = None) -> DataFrame:
    """The rows from ``half`` before a recording's first event to ``half`` after (exclusive), with ``center``, its place.

    ``rel_time`` is the time since the slice's first row. Only slices are
    brought together, not recordings.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    centers = df.filter(event).groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True))).agg(F.min(pos).alias("center"))
    near = (F.col(pos) >= F.col("center") - half) & (F.col(pos) < F.col("center") + half)
    for k, n in zip(keys, names, strict=True):
        near = near & F.col(k).eqNullSafe(F.col(n))
    out = df.join(centers, near).drop(*names)
    if time:
        out = out.withColumn("rel_time", F.col(time) - F.min_by(time, pos).over(Window.partitionBy(*keys)))
    return out

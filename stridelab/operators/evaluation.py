"""Evaluation: thresholds, confusion counts, pooled metrics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .distributed import running_sums

METRICS = ["accuracy", "balanced_acc", "precision", "recall", "f1"]


def confusion(df: DataFrame, keys: Sequence[str], label: Column, predicted: Column) -> DataFrame:
    """tn, fp, fn and tp of each group."""
    n = lambda y, p: F.sum(((label == y) & (predicted == p)).cast("long"))
    return df.groupBy(*keys).agg(n(0, 0).alias("tn"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(1, 1).alias("tp"))


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def with_metrics(cm: DataFrame) -> DataFrame:
    """The five metrics of confusion counts; 0 where a denominator is 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    recall = _share(tp, tp + fn)
    return cm.withColumns(
        {
            "accuracy": _share(tp + tn, tn + fp + fn + tp),
            "balanced_acc": (recall + _share(tn, tn + fp)) / 2,
            "precision": _share(tp, tp + fp),
            "recall": recall,
            "f1": _share(2 * tp, 2 * tp + fp + fn),
        }
    )


def pooled(per_fold: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Metrics of the summed counts, each with the folds' standard deviation (of a sample)."""
    sums = per_fold.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")), *(F.stddev_samp(m).alias(f"{m}_std") for m in METRICS))
    return with_metrics(sums)


def metric_statistics(per_fold: DataFrame, metrics: Sequence[str] = tuple(METRICS)) -> DataFrame:
    """mean, std (of a sample), min and max of each metric over the folds."""
    one = per_fold.agg(*(F.struct(F.avg(m).alias("mean"), F.stddev_samp(m).alias("std"), F.min(m).alias("min"), F.max(m).alias("max")).alias(m) for m in metrics))
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("s")) for m in metrics)))
    return one.select(rows.alias("r")).select("r.metric", "r.s.mean", "r.s.std", "r.s.min", "r.s.max")


def normalised(cm: DataFrame) -> DataFrame:
    """(actual, predicted, share): each actual class's row sums to 1; 0 for an absent class."""
    cells = F.explode(F.array(*(F.struct(F.lit(y).alias("actual"), F.lit(p).alias("predicted"), F.col(c).alias("n")) for y, p, c in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")))))
    rows = cm.select(cells.alias("r")).select("r.actual", "r.predicted", "r.n")
    return rows.withColumn("share", _share(F.col("n"), F.sum("n").over(Window.partitionBy("actual"))))


def curve(df: DataFrame, label: Column, score: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Precision and recall at each distinct score taken as the threshold.

    Rows are first summed by score; the sums run over stretches of the distinct scores.
    """
    by_score = df.groupBy(*keys, score.alias("threshold")).agg(F.sum((label == 1).cast("long")).alias("tp"), F.count("*").alias("flagged"))
    out = running_sums(by_score, "threshold", ["tp", "flagged"], keys, descending=True)
    positives = by_score.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(F.sum("tp").alias("positives"))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys)) if keys else None
    out = out.join(positives, same) if keys else out.join(F.broadcast(positives))  # one row
    return out.select(*keys, "threshold", (F.col("tp") / F.col("flagged")).alias("precision"), _share(F.col("tp"), F.col("positives")).alias("recall"))


def best_threshold(points: DataFrame, keys: Sequence[str] = (), low: float = 0.05, high: float = 0.95) -> DataFrame:
    """The threshold with the largest F1 (the smallest on ties), clipped; 0.5 without points."""
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-9)
    best = points.withColumn("__f", F.struct(F.round(f1, 12).alias("f"), (-F.col("threshold")).alias("t"))).groupBy(*keys).agg(F.max("__f").alias("b"))
    return best.select(*keys, F.when(F.col("b").isNull(), 0.5).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), -F.col("b.t")))).alias("threshold"))


def selection_frequency(chosen: DataFrame, column: str, runs: int) -> DataFrame:
    """In which share of the runs each feature was selected."""
    return chosen.groupBy(column).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / runs)

"""Leave-one-subject-out training and evaluation, fold by fold.

A fold is: constant features dropped, z-scores by subject, settings searched on
inner folds that never split a subject (the best features of each sensor and
the medians that fill their gaps are found anew on each), the best one fitted,
a threshold from its out-of-fold scores, and the held-out subject's confusion
counts. The feature table is read per fold by partition, and what comes to the
driver are column names, counts, scores of settings and thresholds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import finite
from ..session import checkpointed
from . import evaluation, models, selection, statistics, tuning
from .distributed import gathered


@dataclass(frozen=True)
class Classifier:
    """``make``: an estimator of a seed and the parameters of ``grid``, by name the values to try."""

    make: tuning.Make
    grid: Mapping = field(default_factory=dict)


@dataclass
class Report:
    """Results per (classifier, fold), and why the others were left out."""

    results: DataFrame | None = None
    skipped: list[tuple[str, str, str]] = field(default_factory=list)
    chosen: dict[tuple[str, str], list[str]] = field(default_factory=dict)
    #: The best setting of each (classifier, fold).
    best: dict[tuple[str, str], dict] = field(default_factory=dict)

    def settings(self, spark: SparkSession) -> DataFrame:
        """(classifier, parameter, value, folds): the value chosen in most folds; ties to the least in text order."""
        rows = [(name, p, str(v)) for (name, _), setting in self.best.items() for p, v in setting.items()]
        counts = spark.createDataFrame(rows, "classifier string, parameter string, value string").groupBy("classifier", "parameter", "value").agg(F.count("*").alias("folds"))
        most = F.min(F.struct(-F.col("folds"), F.col("value").alias("value"))).alias("m")
        return counts.groupBy("classifier", "parameter").agg(most).select("classifier", "parameter", "m.value", (-F.col("m.col1")).alias("folds"))


def prepared(train: DataFrame, test: DataFrame, columns: Sequence[str], subject: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides without infinities and constant columns, as z-scores; gaps stay."""
    clean = {c: finite(F.col(c).cast("double")) for c in columns}
    train, test = train.withColumns(clean), test.withColumns(clean)
    constant = {r["column"] for r in statistics.constant_columns(train, columns).collect()}
    kept = [c for c in columns if c not in constant]
    if not kept:
        return train, test, []
    return checkpointed(selection.normalise_train(train, kept, subject)), checkpointed(selection.normalise_test(test, train, kept, subject)), kept


def inner_folds(train: DataFrame, subject: str, most: int = 3) -> DataFrame | None:
    """``train`` with ``inner``, a fold per group of subjects; None with fewer than two subjects."""
    n = train.select(subject).distinct().count()
    if n < 2:
        return None
    folds = selection.group_folds(train, subject, min(most, n)).select(F.col(subject).alias("__s"), F.col("fold").alias("inner"))
    return train.join(F.broadcast(folds), F.col(subject) == F.col("__s")).drop("__s")  # a row per subject


def threshold(train: DataFrame, label: str, make: tuning.Make, setting: Mapping, selectors: Mapping[tuple[object, int], tuning.SensorKBestModel], seed: int = 42, balance: tuning.Balance = tuning.oversampled) -> float:
    """The F1-best threshold over out-of-fold scores of one setting; ``selectors`` are those fitted on the inner folds."""

    def out_of_fold(part: tuple[object, DataFrame, DataFrame]) -> DataFrame | None:
        fold, inside, outside = part
        chosen = selectors.get((fold, setting["k"]))
        if chosen is None or not chosen.columns:
            return None
        return models.scored(_fitted(make, seed, setting, chosen, inside, label, balance), chosen.transform(outside)).select("label", "score")

    scored = [x for x in tuning.at_once(train, out_of_fold, list(tuning.parts(train, "inner"))) if x is not None]
    if not scored:
        return 0.5
    return evaluation.best_threshold(evaluation.curve(reduce(DataFrame.unionByName, scored), F.col("label"), F.col("score"))).first()["threshold"]


def _fitted(make: tuning.Make, seed: int, setting: Mapping, chosen: tuning.SensorKBestModel, rows: DataFrame, label: str, balance: tuning.Balance):
    balanced = gathered(balance(chosen.filled(rows), chosen.columns, label))
    vectors = gathered(chosen.transform(balanced).select("features", "label", "weight"))
    model = _made(make, seed, setting).fit(vectors)
    balanced.unpersist()
    vectors.unpersist()
    return model


def _made(make: tuning.Make, seed: int, setting: Mapping):
    return make(seed, **{p: v for p, v in setting.items() if p != "k"})


def leave_one_subject_out(features: DataFrame, columns: Sequence[str], label: str, classifiers: Mapping[str, tuning.Make | Classifier], sensor: Column | None = None, k: int | Sequence[int] = 10, subject: str = "subject", folds: Sequence | None = None, seed: int = 42, settings: int = 20, balance: tuning.Balance = tuning.oversampled, at_once: int = 2) -> Report:
    """Confusion counts and metrics of every classifier on every subject left out.

    ``classifiers``: by name, a ``Classifier`` (or its ``make`` alone).
    ``sensor``: the group of the column named in ``column``; the ``k`` best of
    each group are kept, and several ``k`` are part of the search. At most
    ``settings`` settings of ``k`` and a classifier's grid are tried, drawn
    without replacement; the one with the largest mean F1 over the inner folds
    wins. ``at_once`` folds run side by side. A fold with fewer than two training subjects, with one class in its
    training rows or without a varying feature is skipped, and so is a
    classifier that cannot be fitted on it.
    """
    ks = [k] if isinstance(k, int) else list(k)
    names = folds if folds is not None else sorted(r[0] for r in features.select(subject).distinct().collect())
    every = {name: c if isinstance(c, Classifier) else Classifier(c) for name, c in classifiers.items()}

    def one(fold) -> tuple[list, Report]:
        return _fold(features, fold, columns, label, every, sensor, ks, subject, seed, settings, balance)

    report, rows = Report(), []
    for done, part in tuning.at_once(features, one, list(names), at_once):
        rows += done
        report.skipped += part.skipped
        report.chosen |= part.chosen
        report.best |= part.best
    if rows:
        results = features.sparkSession.createDataFrame(rows, "classifier string, fold string, threshold double, tn long, fp long, fn long, tp long")
        report.results = evaluation.with_metrics(results)
    return report


def _fold(features: DataFrame, fold, columns: Sequence[str], label: str, classifiers: Mapping[str, Classifier], sensor: Column | None, ks: list[int], subject: str, seed: int, settings: int, balance: tuning.Balance) -> tuple[list, Report]:
    """Rows of results of one subject left out, and what is told of it."""
    report, rows = Report(), []
    train, test, kept = prepared(features.filter(F.col(subject) != fold), features.filter(F.col(subject) == fold), columns, subject)
    split = inner_folds(train, subject) if kept else None
    if split is None or train.select(label).distinct().count() < 2:
        report.skipped.append(("*", str(fold), "no varying feature" if not kept else "too few subjects or classes"))
        return rows, report
    split = checkpointed(split)
    selector = tuning.SensorKBest(kept, label, sensor)
    whole = dict(zip(ks, (m for _, m in selector.fitMultiple(split, [{selector.k: each} for each in ks])), strict=True))
    for name, classifier in classifiers.items():
        try:
            _made(classifier.make, seed, {p: list(v)[0] for p, v in classifier.grid.items()})  # what no setting can make is told as such
            found = tuning.search(split, "inner", selector, classifier.make, classifier.grid, ks, settings, seed, balance=balance)
            best = found.best
            if best is None:
                raise ValueError("no setting could be fitted on all inner folds")
            chosen = whole[best["k"]]
            t = threshold(split, label, classifier.make, best, found.selectors, seed, balance)
            model = _fitted(classifier.make, seed, best, chosen, split, label, balance)
            marked = models.scored(model, chosen.transform(test)).withColumn("p", (F.col("score") >= t).cast("int"))
            counts = evaluation.confusion(marked, [], F.col("label"), F.col("p")).first()  # one row: a fold's result
        except tuning.UNFIT as error:
            report.skipped.append((name, str(fold), str(error).splitlines()[0][:200]))
            continue
        rows.append((name, str(fold), float(t), *(int(counts[c] or 0) for c in ("tn", "fp", "fn", "tp"))))
        report.chosen[name, str(fold)], report.best[name, str(fold)] = chosen.columns, best
    return rows, report

"""Settings searched on inner folds, with the selection of columns refitted on each.

A selector and a classifier are judged together: on each inner fold the
selector sees the training rows alone. Its ranking of the columns does not
depend on how many are taken, so it is found once per fold and shared by all
settings; the settings with one number of columns share their table of vectors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark.errors import IllegalArgumentException
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from . import evaluation, models, selection
from .distributed import gathered

#: What a setting that cannot be fitted may raise; a lost executor or a failed job is not among these.
UNFIT = (ValueError, RuntimeError, IllegalArgumentException)
#: Makes an estimator of a seed and a setting's parameters.
Make = Callable[..., object]


class SensorKBest(Estimator):
    """The ``k`` best columns of each sensor by their F, gaps filled by the columns' medians.

    ``sensor`` is the group of the column named in ``column``. Ties go by name;
    a column without an F (constant, or one class only) is never taken.
    """

    k = Param(Params._dummy(), "k", "columns of each sensor", TypeConverters.toInt)

    def __init__(self, columns: Sequence[str], label: str, sensor: Column | None = None, k: int = 10):
        super().__init__()
        self.columns, self.label, self.sensor = list(columns), label, sensor
        self._set(k=k)

    def _ranking(self, df: DataFrame) -> tuple[list[tuple[str, int]], dict[str, float]]:
        """(column, place in its sensor) and medians: a row for each column."""
        medians = selection.medians(df, self.columns)
        scores = selection.anova(selection.fill_with(df, medians), self.columns, self.label).filter("f IS NOT NULL AND NOT isnan(f)")
        ranked = selection.select_per_group(scores, self.sensor if self.sensor is not None else F.lit("all"), len(self.columns))
        return [(r["column"], r["rank"]) for r in ranked.collect()], medians

    def _chosen(self, ranking: tuple[list[tuple[str, int]], dict[str, float]], k: int) -> SensorKBestModel:
        places, medians = ranking
        taken = {c for c, place in places if place <= k}
        return SensorKBestModel([c for c in self.columns if c in taken], medians, self.label)

    def _fit(self, dataset: DataFrame) -> SensorKBestModel:
        return self._chosen(self._ranking(dataset), self.getOrDefault(self.k))

    def fitMultiple(self, dataset: DataFrame, paramMaps: Sequence[Mapping[Param, int]]) -> Iterator[tuple[int, SensorKBestModel]]:
        """One ranking for all numbers of columns."""
        ranking = self._ranking(dataset)
        return iter([(i, self._chosen(ranking, m.get(self.k, self.getOrDefault(self.k)))) for i, m in enumerate(paramMaps)])


class SensorKBestModel(Model):
    """Fills the chosen columns and puts them into ``features``, with ``label`` and ``weight``."""

    def __init__(self, columns: Sequence[str], medians: Mapping[str, float], label: str):
        super().__init__()
        self.columns, self.label = list(columns), label
        self.medians = {c: medians[c] for c in columns}

    def filled(self, dataset: DataFrame) -> DataFrame:
        return selection.fill_with(dataset, self.medians)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if not self.columns:
            raise ValueError("no column was chosen")
        return models.assembled(self.filled(dataset), self.columns, self.label)


def oversampled(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Rows of each class repeated until it is as large as the largest."""
    return selection.oversample(df.withColumn("__key", F.xxhash64(*columns)), label, "__key").drop("__key", "copy")


def with_adasyn(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Rows and the synthetic ones of the minority."""
    keyed = df.select(*columns, label).withColumn("__key", F.xxhash64(*columns))
    return keyed.drop("__key").unionByName(models.adasyn(keyed, "__key", columns, label).select(*columns, label))


Balance = Callable[[DataFrame, Sequence[str], str], DataFrame]


def parts(df: DataFrame, fold: str) -> Iterator[tuple[object, DataFrame, DataFrame]]:
    """(fold, the rows outside it, its own)."""
    for k in sorted(r[0] for r in df.select(fold).distinct().collect()):
        yield k, df.filter(F.col(fold) != k), df.filter(F.col(fold) == k)


@dataclass
class Search:
    """Settings in the order tried, the F1 of each on each inner fold (NaN if it could not be fitted), and the selectors by fold and k."""

    settings: list[dict]
    f1: list[list[float]]
    balanced: list[list[float]]
    selectors: dict[tuple[object, int], SensorKBestModel] = field(default_factory=dict)

    def mean(self, i: int) -> float:
        """NaN if a fold failed, and without folds."""
        return sum(self.f1[i]) / len(self.f1[i]) if self.f1[i] else math.nan

    @property
    def best(self) -> dict | None:
        """The first of the settings with the largest mean F1; None if none could be fitted."""
        able = [i for i in range(len(self.settings)) if not math.isnan(self.mean(i))]
        return self.settings[max(able, key=lambda i: (self.mean(i), -i))] if able else None


def judged(model, rows: DataFrame) -> tuple[float, float]:
    """F1 and balanced accuracy of rows with a label, at one half."""
    scored = models.scored(model, rows).withColumn("p", (F.col("score") > 0.5).cast("int"))
    one = evaluation.with_metrics(evaluation.confusion(scored, [], F.col("label").cast("int"), F.col("p"))).first()
    return one["f1"], one["balanced_acc"]


def search(train: DataFrame, fold: str, selector: SensorKBest, make: Make, grid: Mapping, ks: Sequence[int], n: int = 20, seed: int = 42, parallelism: int = 8, balance: Balance = oversampled) -> Search:
    """At most ``n`` settings of ``grid`` and ``ks``, drawn without replacement, judged on the folds of the column ``fold``.

    A setting that cannot be fitted on a fold, such as one with one class in
    its training rows, has NaN there. Settings are fitted ``parallelism`` at a
    time; the driver holds their scores.
    """
    settings = models.sampled_grid({"k": list(ks), **grid}, n, seed)
    used = sorted({s["k"] for s in settings})
    selectors: dict[tuple[object, int], SensorKBestModel] = {}

    def fold_scores(part: tuple[object, DataFrame, DataFrame]) -> list[tuple[float, float]]:
        name, inside, outside = part
        found = [(math.nan, math.nan)] * len(settings)
        if inside.select(selector.label).distinct().count() < 2:
            return found
        for i, chosen in selector.fitMultiple(inside, [{selector.k: k} for k in used]):
            selectors[name, used[i]] = chosen
        for k in used:
            chosen, mine = selectors[name, k], [i for i, s in enumerate(settings) if s["k"] == k]
            if not chosen.columns:
                continue
            balanced = gathered(balance(chosen.filled(inside), chosen.columns, selector.label))
            rows, held = gathered(chosen.transform(balanced).select("features", "label", "weight")), gathered(chosen.transform(outside).select("features", "label", "weight"))

            def one(i: int, rows: DataFrame = rows, held: DataFrame = held) -> tuple[float, float]:
                try:
                    return judged(make(seed, **{p: v for p, v in settings[i].items() if p != "k"}).fit(rows), held)
                except UNFIT:
                    return math.nan, math.nan

            for i, scores in zip(mine, at_once(train, one, mine, parallelism), strict=True):
                found[i] = scores
            for df in (balanced, rows, held):
                df.unpersist()
        return found

    by_fold = at_once(train, fold_scores, list(parts(train, fold)), parallelism)
    return Search(settings, [[found[i][0] for found in by_fold] for i in range(len(settings))], [[found[i][1] for found in by_fold] for i in range(len(settings))], selectors)


def at_once(df: DataFrame, work: Callable, items: list, most: int = 8) -> list:
    """``work`` on each item, on a few threads of the driver."""
    if len(items) < 2:
        return [work(x) for x in items]
    with ThreadPool(min(most, len(items))) as pool:
        return pool.map(inheritable_thread_target(df.sparkSession)(work), items)


def choose_k(train: DataFrame, key: str, selector: SensorKBest, make: Make, ks: Sequence[int] = (3, 5, 8, 10, 15), folds: int = 5, seed: int = 42, balance: Balance = with_adasyn) -> tuple[int | None, DataFrame]:
    """The number of columns a sensor with the largest mean F1 over stratified folds, and the scores of each.

    (k, n_columns of a selector of all rows, f1_mean, f1_std, bal_mean); the
    deviation is the population's, and ties go to the lesser k.
    """
    dealt = selection.stratified_folds(train, selector.label, key, folds, seed)
    found = search(dealt, "fold", selector, make, {}, sorted(ks), len(ks), seed, balance=balance)
    order = sorted(range(len(found.settings)), key=lambda i: found.settings[i]["k"])
    whole = {i: m for i, m in selector.fitMultiple(train, [{selector.k: found.settings[i]["k"]} for i in order])}
    rows = []
    for place, i in enumerate(order):
        mean, each = found.mean(i), found.f1[i]
        spread = math.sqrt(sum((x - mean) ** 2 for x in each) / len(each)) if each else math.nan
        rows.append((found.settings[i]["k"], len(whole[place].columns), mean, spread, sum(found.balanced[i]) / len(each) if each else math.nan))
    able = [r for r in rows if not math.isnan(r[2])]
    best = max(able, key=lambda r: (r[2], -r[0]))[0] if able else None
    return best, train.sparkSession.createDataFrame(rows, "k int, n_columns int, f1_mean double, f1_std double, bal_mean double")


def around(k: int, least: int = 3, most: int = 15) -> list[int]:
    """Numbers of columns to search near a chosen one."""
    return sorted({max(least, k - 3), k, min(most, k + 5)})

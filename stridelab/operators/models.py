"""Classifiers and their search, on pyspark.ml."""

from __future__ import annotations

import math
import random
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from . import neighbours
from .distributed import gathered


def assembled(df: DataFrame, columns: Sequence[str], label: str = "label") -> DataFrame:
    """``features`` vector and double ``label``, with a balanced ``weight`` per class."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}  # a row per class
    weight = F.lit(1.0)
    for y, n in counts.items():
        weight = F.when(F.col(label) == y, sum(counts.values()) / (len(counts) * n)).otherwise(weight)
    out = VectorAssembler(inputCols=list(columns), outputCol="features").transform(df)
    return out.withColumns({"label": F.col(label).cast("double"), "weight": weight})


def logistic(rows: int, c: float = 1.0, iterations: int = 100) -> LogisticRegression:
    """Ridge logistic regression with the inverse penalty ``c``."""
    return LogisticRegression(maxIter=iterations, regParam=1.0 / (c * max(1, rows)), standardization=False, weightCol="weight")


def forest(trees: int = 100, depth: int = 20, seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=trees, maxDepth=min(depth, 30), minInstancesPerNode=5, seed=seed, weightCol="weight")


def boosted(rounds: int = 100, depth: int = 6, rate: float = 0.1, seed: int = 42) -> GBTClassifier:
    return GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed, weightCol="weight")


def perceptron(inputs: int, hidden: Sequence[int] = (100, 50), seed: int = 42) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(layers=[inputs, *hidden, 2], maxIter=50, seed=seed)


def fourier(df: DataFrame, columns: Sequence[str], size: int = 64, gamma: float | None = None, seed: int = 42) -> DataFrame:
    """Random Fourier features of an RBF kernel as ``features``; a linear machine on them approximates the kernel's."""
    rng = np.random.default_rng(seed)
    gamma = 1.0 / len(columns) if gamma is None else gamma
    w = rng.normal(scale=math.sqrt(2 * gamma), size=(size, len(columns)))
    b = rng.uniform(0, 2 * math.pi, size)
    waves = [F.cos(sum((F.lit(float(w[i, j])) * F.col(c) for j, c in enumerate(columns)), F.lit(float(b[i])))) * math.sqrt(2 / size) for i in range(size)]
    names = [f"rff_{i}" for i in range(size)]
    return VectorAssembler(inputCols=names, outputCol="features").transform(df.select("*", *(x.alias(n) for x, n in zip(waves, names, strict=True)))).drop(*names)


def kernel_machine(penalty: float = 1e-3) -> LinearSVC:
    """For ``fourier`` features; ``Calibrated`` gives it probabilities."""
    return LinearSVC(maxIter=50, regParam=penalty, weightCol="weight")


def platt(margins: DataFrame, passes: int = 100, tolerance: float = 1e-9) -> tuple[float, float]:
    """a and b of 1 / (1 + exp(a margin + b)), the likeliest for rows (margin, label 0 or 1).

    Targets are drawn in from 0 and 1 by the number of rows of each class. A
    Newton step takes two passes: one sums gradient and Hessian, one the loss
    at ever shorter steps, of which the first that lowers it enough is taken.
    What comes to the driver are these sums.
    """
    rows = margins.select(F.col("margin").cast("double").alias("m"), (F.col("label") > 0).alias("y")).filter("m IS NOT NULL AND y IS NOT NULL")
    rows = gathered(rows)
    up, down = rows.agg(F.count_if("y"), F.count_if(~F.col("y"))).first()
    if not up or not down:
        rows.unpersist()
        raise ValueError("margins of two classes are needed")
    m, t = F.col("m"), F.when(F.col("y"), (up + 1.0) / (up + 2.0)).otherwise(1.0 / (down + 2.0))

    def loss(a: float, b: float) -> Column:
        z = m * a + b
        return F.sum(F.when(z >= 0, t * z + F.log1p(F.exp(-z))).otherwise((t - 1) * z + F.log1p(F.exp(z))))

    a, b = 0.0, math.log((down + 1.0) / (up + 1.0))
    steps = [0.5**k for k in range(12)]
    for _ in range(passes):
        z = m * a + b
        p = 1 / (1 + F.exp(z))
        d1, d2 = t - p, p * (1 - p)
        ga, gb, haa, hab, hbb, now = rows.agg(F.sum(m * d1), F.sum(d1), F.sum(m * m * d2), F.sum(m * d2), F.sum(d2), loss(a, b)).first()
        if abs(ga) < tolerance * (up + down) and abs(gb) < tolerance * (up + down):
            break
        haa, hbb = haa + 1e-12, hbb + 1e-12
        det = haa * hbb - hab * hab
        da, db = -(hbb * ga - hab * gb) / det, -(haa * gb - hab * ga) / det
        slope = ga * da + gb * db
        tried = rows.agg(*(loss(a + s * da, b + s * db).alias(f"l{k}") for k, s in enumerate(steps))).first()
        good = next((s for s, found in zip(steps, tried, strict=True) if found < now + 1e-4 * s * slope), None)
        if good is None:
            break
        a, b = a + good * da, b + good * db
    rows.unpersist()
    return a, b


class Calibrated:
    """An estimator of margins with probabilities, by ``platt`` on margins of rows that it was not fitted on."""

    def __init__(self, estimator, folds: int = 5, seed: int = 42):
        self.estimator, self.folds, self.seed = estimator, folds, seed

    def fit(self, df: DataFrame) -> Calibrated:
        """``df``: features, label and what the estimator needs. Rows are dealt into folds by their features; equal ones stay together."""
        fold = F.pmod(F.xxhash64(F.lit(self.seed), vector_to_array("features")), F.lit(self.folds))
        dealt = gathered(df.withColumn("__fold", fold))
        parts = []
        for k in range(self.folds):
            inside = dealt.filter(F.col("__fold") != k)
            if inside.select("label").distinct().count() == 2:
                model = self.estimator.fit(inside)
                parts.append(model.transform(dealt.filter(F.col("__fold") == k)).select(vector_to_array("rawPrediction")[1].alias("margin"), "label"))
        if not parts:
            raise ValueError("no fold leaves rows of two classes")
        self.a, self.b = platt(reduce(DataFrame.unionByName, parts))
        self.model = self.estimator.fit(dealt.drop("__fold"))
        dealt.unpersist()
        return self

    def scores(self, df: DataFrame) -> DataFrame:
        """``df`` with ``score``, the probability of class 1."""
        out = self.model.transform(df)
        z = vector_to_array("rawPrediction")[1] * self.a + self.b
        return out.withColumn("score", 1 / (1 + F.exp(z))).drop("rawPrediction", "prediction")


class Boosting:
    """AdaBoost (SAMME) over weighted decision stumps."""

    def __init__(self, rounds: int = 150, rate: float = 0.05):
        self.rounds, self.rate = rounds, rate
        self.stumps: list[tuple[float, object]] = []

    def fit(self, df: DataFrame) -> Boosting:
        """``df``: features and label. The weights are recomputed from the stumps, so nothing accumulates in a plan."""
        self.stumps = []
        n = df.count()
        for _ in range(self.rounds):
            weighted = self._weighted(df, n)
            stump = DecisionTreeClassifier(maxDepth=1, weightCol="w", predictionCol="p", rawPredictionCol="r", probabilityCol="q").fit(weighted)
            wrong, total = stump.transform(weighted).agg(F.sum(F.when(F.col("p") != F.col("label"), F.col("w")).otherwise(0.0)), F.sum("w")).first()
            error = min(max(wrong / total, 1e-10), 1 - 1e-10)
            if error >= 0.5:
                break
            self.stumps.append((self.rate * math.log((1 - error) / error), stump))
            if error <= 1e-9:
                break
        return self

    def _weighted(self, df: DataFrame, n: int) -> DataFrame:
        exponent = F.lit(0.0)
        out = df
        for k, (alpha, stump) in enumerate(self.stumps):
            stump = stump.copy()
            stump.setPredictionCol(f"p{k}").setRawPredictionCol(f"r{k}").setProbabilityCol(f"q{k}")
            out = stump.transform(out).drop(f"r{k}", f"q{k}")
            exponent = exponent + F.when(F.col(f"p{k}") != F.col("label"), F.lit(alpha)).otherwise(0.0)
        return out.withColumn("w", F.exp(exponent) / n).select("features", "label", "w")

    def scores(self, df: DataFrame) -> DataFrame:
        """``df`` with ``score``, the weighted share of votes for class 1."""
        out, votes, total = df, F.lit(0.0), sum(a for a, _ in self.stumps) or 1.0
        for k, (alpha, stump) in enumerate(self.stumps):
            stump = stump.copy()
            stump.setPredictionCol(f"p{k}").setRawPredictionCol(f"r{k}").setProbabilityCol(f"q{k}")
            out = stump.transform(out).drop(f"r{k}", f"q{k}")
            votes = votes + F.col(f"p{k}") * alpha
        return out.withColumn("score", votes / total).drop(*(f"p{k}" for k in range(len(self.stumps))))


def scored(model, df: DataFrame) -> DataFrame:
    """``df`` with the model's ``score`` for class 1 (its margin where it has no probability; see ``Calibrated``)."""
    if isinstance(model, (Boosting, Calibrated)):
        return model.scores(df)
    out = model.transform(df)
    source = "probability" if "probability" in out.columns else "rawPrediction"
    return out.withColumn("score", vector_to_array(source)[1]).drop("rawPrediction", "probability", "prediction")


def importances(df: DataFrame, columns: Sequence[str], trees: int = 200, depth: int = 15, seed: int = 42, label: str = "label") -> DataFrame:
    """(column, importance) by a random forest."""
    model = forest(trees, depth, seed).fit(assembled(df, columns, label))
    rows = [(c, float(x)) for c, x in zip(columns, model.featureImportances.toArray(), strict=True)]
    return df.sparkSession.createDataFrame(rows, "column string, importance double")


def with_p_values(scores: DataFrame, rows: DataFrame, label: str) -> DataFrame:
    """``scores`` (a row per column, with ``f``) and ``p``: how likely so large an F is by chance.

    The degrees of freedom are those of the rows and the classes that ``label``
    has in them (null is no class). An F that is null or not a number has
    p 1.
    """
    classes, n = rows.agg(F.count_distinct(label), F.count(label)).first()

    @F.pandas_udf("double")
    def survival(f: pd.Series) -> pd.Series:
        return f.map(lambda x: f_survival(x, classes - 1, n - classes))

    return scores.withColumn("p", survival("f"))


def f_survival(f: float, a: int, b: int) -> float:
    """P(F > f) with a and b degrees of freedom, by the incomplete beta's continued fraction."""
    if f is None or math.isnan(f) or f <= 0 or a < 1 or b < 1:
        return 1.0
    x, p, q = b / (b + a * f), b / 2, a / 2
    if x > (p + 1) / (p + q + 2):
        return 1.0 - _beta(1 - x, q, p)
    return _beta(x, p, q)


def _beta(x: float, p: float, q: float) -> float:
    if x <= 0:
        return 0.0
    front = math.exp(math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) + p * math.log(x) + q * math.log1p(-x)) / p if x < 1 else 1.0
    c, d = 1.0, 1.0 - (p + q) * x / (p + 1)
    d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
    total = d
    for m in range(1, 300):
        for step in (m * (q - m) * x / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * x / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1.0 + step * d
            c = 1.0 + step / c
            d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
            c = c if abs(c) > 1e-300 else 1e-300
            total *= c * d
        if abs(c * d - 1) < 1e-12:
            break
    return front * total


def sampled_grid(grid: Mapping, n: int, seed: int = 42) -> list[dict]:
    """At most ``n`` settings of a parameter grid, drawn without replacement."""
    every = [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]
    return every if len(every) <= n else random.Random(seed).sample(every, n)


def search(estimator, df: DataFrame, grid: Mapping, fold: str, folds: int, n: int = 20, parallelism: int = 2, seed: int = 42):
    """The best model of a randomised search over given folds (groups are never split)."""
    settings: Iterable[dict] = sampled_grid(grid, n, seed)
    maps = [ParamGridBuilder().baseOn(s).build()[0] for s in settings]
    validator = CrossValidator(estimator=Pipeline(stages=[estimator]), estimatorParamMaps=maps, evaluator=BinaryClassificationEvaluator(metricName="areaUnderPR"), numFolds=folds, foldCol=fold, parallelism=parallelism, seed=seed)
    return validator.fit(df)


def adasyn(df: DataFrame, key: str, columns: Sequence[str], label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Synthetic minority rows (label 1), more of them where the majority is near.

    A row gets its share of the deficit by the majority's share among its ``k``
    nearest other rows; each synthetic row lies between it and one of its ``k``
    nearest minority rows, at a place that key, number and seed decide. Keys
    may repeat: rows are told apart by a number of their own, and only draws
    of rows with equal keys are alike. A row without a neighbour, or without
    one of the minority, gives none. Neighbours are found in blocks.
    """
    number, flag = "__row", "__major"
    rows = neighbours.numbered(df.withColumn(flag, (F.col(label) == 0).cast("double")), number)
    sizes = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}  # a row per class
    deficit = max(0, sizes.get(0, 0) - sizes.get(1, 0))
    minority = rows.filter(F.col(label) == 1)
    hardness = neighbours.nearest(minority, rows, columns, number, key, k, flag).groupBy("query").agg(F.avg("value").alias("r"))
    hardness = checkpointed(hardness)  # read twice
    total = F.broadcast(hardness.agg(F.sum("r").alias("total")))  # one row
    times = F.when(F.col("total") > 0, F.round(F.col("r") / F.col("total") * deficit)).otherwise(0).cast("int")
    plan = hardness.join(total).select("query", times.alias("times")).filter("times > 0")
    own = checkpointed(neighbours.nearest(minority, minority, columns, number, key, k, flag).select("query", "row", (F.col("nth") - 1).alias("nth")))
    near = own.groupBy("query").agg(F.count("*").cast("int").alias("have"))
    keys = minority.select(F.col(number).alias("query"), F.col(key).alias("source"), F.array(*columns).alias("xa"))
    many = plan.join(near, "query").join(keys, "query").select("*", F.explode(F.sequence(F.lit(1), "times")).alias("t"))
    draw = lambda s: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(s)), F.col("source").cast("string"), F.col("t").cast("string"))), 1, 8), 16, 10).cast("long")
    drawn = many.withColumn("nth", (draw(seed) % F.col("have")).cast("int"))
    part = draw(seed + 1) % 1000 / 1000.0
    ends = minority.select(F.col(number).alias("row"), F.array(*columns).alias("xb"))
    made = drawn.withColumn("part", part).join(own, ["query", "nth"]).join(ends, "row")
    point = F.zip_with("xa", "xb", lambda x, y: x + (y - x) * F.col("part"))
    return made.select("source", "t", *(point[i].alias(c) for i, c in enumerate(columns)), F.lit(1).alias(label))

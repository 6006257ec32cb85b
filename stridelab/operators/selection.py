"""From features to model inputs: normalising, selecting, imputing, resampling, folds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from . import neighbours
from .distributed import dealt_rank, quantiles
from .statistics import unpivoted

#: Added to deviations before dividing.
EPSILON = 1e-8


def _strict_mean(x: Column) -> Column:
    """The mean, null if any value is (one missing value voids a subject's feature)."""
    return F.when(F.count_if(x.isNull()) == 0, F.avg(x))


def _strict_std(x: Column) -> Column:
    return F.when(F.count_if(x.isNull()) == 0, F.stddev_pop(x))


def subject_statistics(train: DataFrame, columns: Sequence[str], subject: str = "subject") -> DataFrame:
    """Mean, deviation (of the population, plus epsilon) and rows of each subject."""
    parts = [F.count("*").alias("n")]
    for c in columns:
        parts += [_strict_mean(F.col(c)).alias(f"{c}__mean"), (_strict_std(F.col(c)) + EPSILON).alias(f"{c}__std")]
    return train.groupBy(subject).agg(*parts)


def normalise_train(train: DataFrame, columns: Sequence[str], subject: str = "subject") -> DataFrame:
    """z-scores within each subject. The wide rows stay where they are; a row per subject is joined to them (sent to all tasks, if Spark finds the rows to be few)."""
    own = subject_statistics(train, columns, subject).withColumnRenamed(subject, "__own")
    joined = train.join(own, F.col(subject).eqNullSafe(F.col("__own")))
    scores = {c: (F.col(c) - F.col(f"{c}__mean")) / F.col(f"{c}__std") for c in columns}
    return joined.withColumns(scores).select(*train.columns)


def normalise_test(test: DataFrame, train: DataFrame, columns: Sequence[str], subject: str = "subject") -> DataFrame:
    """z-scores by the training subjects' means and deviations, averaged by their rows.

    The deviation is the mean of the subjects', not the pooled one; a subject
    whose feature is void voids the average.
    """
    own = subject_statistics(train, columns, subject)
    averages = []
    for c in columns:
        for part in ("mean", "std"):
            x = F.col(f"{c}__{part}")
            averages.append(F.when(F.count_if(x.isNull()) == 0, F.sum(x * F.col("n")) / F.sum("n")).alias(f"{c}__{part}"))
    overall = own.agg(*averages)
    joined = test.join(F.broadcast(overall))  # one row
    scores = {c: (F.col(c) - F.col(f"{c}__mean")) / F.col(f"{c}__std") for c in columns}
    return joined.withColumns(scores).select(*test.columns)


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """The median of each column; 0 for a column without values."""
    found = quantiles(df, columns, [0.5])
    return {c: found[c][0] if found[c][0] is not None else 0.0 for c in columns}


def fill_with(df: DataFrame, values: Mapping[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


def anova(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """F of each column between the classes of ``label``, from per-class counts, sums and squares.

    Columns are centred first, so that the squares keep their digits.
    """
    centre = df.agg(*(F.avg(c).alias(f"{c}__c") for c in columns))
    centred = df.join(F.broadcast(centre)).select(F.col(label).alias("__y"), *((F.col(c) - F.col(f"{c}__c")).alias(c) for c in columns))  # one row
    per_class = centred.groupBy("__y").agg(*(F.struct(F.count(c).alias("n"), F.sum(c).alias("s"), F.sum(F.col(c) * F.col(c)).alias("q")).alias(c) for c in columns))

    def f_score(x: Column) -> Column:
        total, n, groups = F.sum(x["s"]), F.sum(x["n"]), F.count(x["n"])
        between = F.sum(x["s"] * x["s"] / x["n"]) - total * total / n
        inside = F.sum(x["q"]) - F.sum(x["s"] * x["s"] / x["n"])
        return F.when(inside > 0, (between / (groups - 1)) / (inside / (n - groups)))

    return unpivoted(per_class, f_score, columns, "f")


def select_per_group(scores: DataFrame, group: Column, k: int, value: str = "f") -> DataFrame:
    """The ``k`` best columns of each group (all, if it has fewer); ties by name."""
    best = Window.partitionBy("grp").orderBy(F.desc(value), "column")
    ranked = scores.withColumn("grp", group).withColumn("rank", F.row_number().over(best))
    return ranked.filter(F.col("rank") <= k).select(F.col("grp").alias("sensor"), "column", value, "rank")


def binned_information(df: DataFrame, x: str, label: str, bins: int = 8) -> DataFrame:
    """Mutual information (nats) between a column cut at its quantiles and the label.

    An approximation of the nearest-neighbour estimate by equal-frequency bins.
    """
    cuts = [F.lit(v).cast("double") for v in quantiles(df, [x], [k / bins for k in range(1, bins)])[x]]
    above = sum(((F.col(x) > c).cast("int") for c in cuts), F.lit(0))
    binned = df.filter(F.col(x).isNotNull()).select(above.alias("b"), F.col(label).alias("y"))
    joint = binned.groupBy("b", "y").agg(F.count("*").alias("n"))
    w = Window.partitionBy
    shares = joint.select("n", F.sum("n").over(w()).alias("t"), F.sum("n").over(w("b")).alias("nb"), F.sum("n").over(w("y")).alias("ny"))
    return shares.agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("nb") * F.col("ny")))).alias("mi"))


def knn_impute(df: DataFrame, key: str, columns: Sequence[str], k: int = 5) -> DataFrame:
    """Gaps filled by the mean of the ``k`` nearest other rows that have the value.

    Distance is Euclidean over the columns both rows have, scaled up for the
    missing ones; ties by ``key``, then by the value. A gap without such rows
    takes the column's mean, and stays if the column has no value. Keys may
    repeat or be null: rows are told apart by a number of their own, and as
    many come out as went in. Infinities count as missing, in distances and as
    values. Rows with gaps are held against all rows in blocks (see
    ``neighbours``); rows without stay where they are.
    """
    clean = {c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")) for c in columns}
    number = "__row"
    rows = neighbours.numbered(df.withColumns(clean), number)
    gap = F.greatest(*(F.col(c).isNull().cast("int") for c in columns)) if len(columns) > 1 else F.col(columns[0]).isNull().cast("int")
    holes = rows.filter(gap == 1)
    near = neighbours.nearest(holes, rows, columns, number, key, k)
    means = near.groupBy(F.col("query").alias(number), "wanted").agg(F.avg("value").alias("v"))
    filled = means.groupBy(number).agg(*(F.max(F.when(F.col("wanted") == i, F.col("v"))).alias(f"__knn{i}") for i in range(len(columns))))
    overall = F.broadcast(rows.agg(*(F.avg(c).alias(f"__mean{i}") for i, c in enumerate(columns))))  # one row
    joined = holes.join(filled, number, "left").join(overall)
    done = joined.withColumns({c: F.coalesce(F.col(c), F.col(f"__knn{i}"), F.col(f"__mean{i}")) for i, c in enumerate(columns)})
    return rows.filter(gap == 0).select(*df.columns).unionByName(done.select(*df.columns))


def oversample(df: DataFrame, label: str, key: str) -> DataFrame:
    """Rows of each class repeated, in turn, until it is as large as the largest.

    ``copy`` is 0 for the original. Every row repeats floor or ceil(largest / own) times.
    """
    sizes = df.groupBy(label).agg(F.count("*").alias("__own"))
    largest = sizes.agg(F.max("__own").alias("__most"))
    plan = sizes.join(F.broadcast(largest))  # one row
    ranked = dealt_rank(df, label, key, "__nth").join(F.broadcast(plan), label)  # a row per class
    times = F.floor(F.col("__most") / F.col("__own")) + (F.col("__nth") < F.col("__most") % F.col("__own")).cast("int")
    return ranked.withColumn("copy", F.explode(F.sequence(F.lit(0), times.cast("int") - 1))).drop("__own", "__most", "__nth")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (classes x own): the balanced weight of each class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    return counts.select(label, "n", (F.sum("n").over(every) / (F.count("*").over(every) * F.col("n"))).alias("weight"))


def group_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """(group, n, fold): largest groups first, each to the fold with the fewest rows so far.

    The greedy step runs on the driver, over one row per group (subject).
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), group).collect()
    loads = [0] * folds
    placed = []
    for r in sizes:
        fold = loads.index(min(loads))
        loads[fold] += r["n"]
        placed.append((r[group], r["n"], fold))
    kind = df.schema[group].dataType.simpleString()
    return df.sparkSession.createDataFrame(placed, f"{group} {kind}, n long, fold int")


def stratified_folds(df: DataFrame, label: str, key: str, folds: int, seed: int = 42) -> DataFrame:
    """``fold`` of each row, dealt in turn within each class in an order set by the seed."""
    return dealt_rank(df, label, key, "__nth", seed).withColumn("fold", (F.col("__nth") % folds).cast("int")).drop("__nth")

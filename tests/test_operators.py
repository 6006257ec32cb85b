"""Operators whose edge cases the driver's tables do not show."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridelab.operators import cleaning, distributed, evaluation, information, kendall, labels, models, neighbours, selection, statistics, training, tuning, windows
from stridelab.operators.distributed import dealt_rank, quantiles, running_sums


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_summary_counts_null_events_as_missing(spark):
    df = table(spark, [("a", 2), ("a", None), ("a", 1)], "s string, y int")
    r = statistics.summary(df, ["s"], F.col("y") == 2).first()
    assert (r.fog_count, r.total_samples, r.fog_percentage) == (1, 2, 50.0)


def test_pairwise_correlation_uses_rows_with_both(spark):
    df = table(spark, [(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (None, 100.0), (4.0, None)], "a double, b double")
    assert statistics.correlations(df, ["a", "b"]).first().r == pytest.approx(1.0)


def test_rank_columns_average_ties(spark):
    df = table(spark, [(3.0,), (1.0,), (3.0,), (2.0,)], "a double")
    assert sorted(r.a for r in statistics.rank_columns(df, ["a"]).collect()) == [1.0, 2.0, 3.5, 3.5]


def plain_information(rows, k):
    psi = lambda n: sum(1 / j for j in range(1, n)) - 0.5772156649015329
    rows = [(x, y) for x, y in rows if x is not None and y is not None and x == x]
    rows = [(x, y) for x, y in rows if sum(v == y for _, v in rows) > 1]
    parts = []
    for i, (x, y) in enumerate(rows):
        own = sorted(abs(x - u) for j, (u, v) in enumerate(rows) if v == y and j != i)
        kk = min(k, len(own))
        r = own[kk - 1]
        m = sum(abs(x - u) < r or (r == 0 and u == x) for u, _ in rows)
        parts.append(psi(kk) - psi(len(own) + 1) - psi(m))
    return max(0.0, psi(len(rows)) + sum(parts) / len(parts)) if rows else 0.0


@pytest.mark.parametrize("stretch", [20, 1000])
def test_neighbour_information_equals_a_plain_count(spark, stretch):
    rng = random.Random(stretch)
    tables = [
        [(rng.gauss(2 * (i % 2), 1), i % 2) for i in range(90)],
        [(float(rng.randrange(8)), rng.choice([0, 1, 2, None])) for _ in range(80)] + [(0.5, 7), (None, 1), (float("nan"), 1), (-0.0, 1), (0.0, 1)],
        [(0.125 * rng.randrange(30), i % 3) for i in range(70)] + [(9.0, 5), (9.5, 5)],
        [],
    ]
    for rows, ks in zip(tables, ([3], [3], [1], [2]), strict=True):
        df = table(spark, rows, "x double, y int").repartition(3)
        for k in ks:
            assert information.neighbour_information(df, "x", "y", k, stretch).first().mi == pytest.approx(plain_information(rows, k), abs=1e-9)


def plain_kendall(rows):
    both = [(x, y) for x, y in rows if x is not None and y is not None and x == x and y == y]
    sign = lambda d: (d > 0) - (d < 0)
    s = dx = dy = 0
    for i, (x, y) in enumerate(both):
        for u, v in both[:i]:
            s += sign(x - u) * sign(y - v)
            dx += x != u
            dy += y != v
    return s / math.sqrt(dx * dy) if dx and dy else math.nan


@pytest.mark.parametrize("size", [1_000_000, 5])
def test_kendall_equals_a_count_of_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(kendall, "ROWS", size)
    rng = random.Random(size)
    tables = [
        [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(150)],
        [(float(i), -float(i)) for i in range(60)],
        [(rng.choice([1.0, 1.0, 2.0, None, rng.random()]), rng.choice([0.0, -0.0, 3.0, float("nan"), rng.random()])) for _ in range(200)],
        [(1.0, float(i)) for i in range(5)],
        [],
    ]
    for rows in tables:
        got = kendall.kendall(table(spark, rows, "u double, v double").repartition(3), "u", "v").first()
        assert (got.a, got.b) == ("u", "v") and got.tau == pytest.approx(plain_kendall(rows), nan_ok=True)


def test_inversions_are_counted():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 333):
        y = rng.integers(0, 20, n)
        assert kendall.inversions(y) == sum(int((y[:i] > y[i]).sum()) for i in range(n))


def test_histogram_of_one_value_and_right_edge(spark):
    df = table(spark, [(0.0,), (1.0,), (2.0,), (None,)], "a double")
    assert [r["count"] for r in statistics.histogram(df, "a", 2).orderBy("bin").collect()] == [1, 2]
    assert [r["count"] for r in statistics.histogram(df.filter("a = 1"), "a", 2).orderBy("bin").collect()] == [1, 0]


def test_cohens_d_of_equal_constants_is_zero(spark):
    df = table(spark, [(1.0, 0), (1.0, 0), (1.0, 1), (1.0, 1)], "a double, y int")
    assert statistics.cohens_d(df, ["a"], F.col("y")).first().d == 0.0


def test_one_gap_voids_a_subjects_feature(spark):
    df = table(spark, [("a", 1.0), ("a", None), ("b", 1.0), ("b", 3.0)], "subject string, x double")
    got = {(r.subject, r.x) for r in selection.normalise_train(df, ["x"]).collect()}
    assert {x for s, x in got if s == "a"} == {None} and sorted(round(x, 4) for s, x in got if s == "b") == [-1.0, 1.0]
    test = table(spark, [("c", 2.0)], "subject string, x double")
    assert selection.normalise_test(test, df, ["x"]).first().x is None
    assert selection.normalise_test(test, df.filter("subject = 'b'"), ["x"]).first().x == pytest.approx(0.0)


def test_oversample_repeats_in_turn(spark):
    df = table(spark, [(i, 0) for i in range(7)] + [(10 + i, 1) for i in range(3)], "id int, y int")
    rows = selection.oversample(df, "y", "id").collect()
    copies = sorted(sum(r.id == i for r in rows) for i in (10, 11, 12))
    assert sum(r.y == 1 for r in rows) == 7 and copies == [2, 2, 3]


def test_knn_falls_back_to_the_mean(spark):
    df = table(spark, [(1, None, 1.0), (2, 4.0, None), (3, None, 3.0)], "id int, a double, b double")
    out = {r.id: (r.a, r.b) for r in selection.knn_impute(df, "id", ["a", "b"]).collect()}
    assert out == {1: (4.0, 1.0), 2: (4.0, 2.0), 3: (4.0, 3.0)}


def test_group_folds_never_split_a_group(spark):
    df = table(spark, [(g, i) for g, n in (("a", 5), ("b", 4), ("c", 3), ("d", 3)) for i in range(n)], "g string, i int")
    got = {r.g: r.fold for r in selection.group_folds(df, "g", 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 0}


def test_fold_counts_equal_the_theta_join(spark):
    w = table(spark, [(s, k, (k + i) % 2) for i, s in enumerate("abc") for k in range(5)], "subject string, k int, y int")
    tagged = windows.leave_one_out(w, w).groupBy("fold", "role").pivot("y", [0, 1]).count().fillna(0)
    counts = windows.fold_counts(w, w, "y", [0, 1])
    assert {tuple(r) for r in counts.collect()} == {tuple(r) for r in tagged.collect()}


def test_metrics_without_positives(spark):
    df = table(spark, [(0, 0), (0, 0)], "y int, p int")
    r = evaluation.with_metrics(evaluation.confusion(df, [], F.col("y"), F.col("p"))).first()
    assert (r.accuracy, r.balanced_acc, r.precision, r.recall, r.f1) == (1.0, 0.5, 0.0, 0.0, 0.0)


def test_threshold_is_clipped(spark):
    df = table(spark, [(1, 0.99), (0, 0.2), (0, 0.1)], "y int, s double")
    points = evaluation.curve(df, F.col("y"), F.col("s"))
    assert evaluation.best_threshold(points).first().threshold == 0.95
    assert evaluation.best_threshold(points.limit(0)).first().threshold == 0.5


def test_boosting_learns_a_threshold(spark):
    rows = [(float(i), float((i * 7) % 5), int(i > 25)) for i in range(50)]
    df = models.assembled(table(spark, rows, "a double, b double, y int"), ["a", "b"], "y")
    out = models.Boosting(3).fit(df).scores(df).collect()
    assert sum((r.score >= 0.5) == bool(r.y) for r in out) >= 49


def plain_platt(rows):
    m, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 0.0, 0.0
    for _ in range(20_000):  # plain descent on the mean loss
        p = 1 / (1 + np.exp(a * m + b))
        a, b = a - 0.5 * ((t - p) * m).mean(), b - 0.5 * (t - p).mean()
    return a, b


def test_platt_equals_a_plain_fit(spark):
    rng = random.Random(8)
    rows = [(rng.gauss(1.0 if y else -0.5, 1), float(y)) for y in [0] * 70 + [1] * 30]
    got = models.platt(table(spark, [*rows, (None, 1.0)], "margin double, label double"))
    assert got == pytest.approx(plain_platt(rows), abs=1e-4) and got[0] < 0
    apart = [(float(i), float(i >= 10)) for i in range(20)]
    a, b = models.platt(table(spark, apart, "margin double, label double"))
    assert math.isfinite(a) and math.isfinite(b) and a < 0
    with pytest.raises(ValueError):
        models.platt(table(spark, [(1.0, 1.0)], "margin double, label double"))


def test_calibrated_scores_are_probabilities_in_the_order_of_margins(spark):
    rng = random.Random(9)
    rows = [(rng.gauss(y, 1), rng.gauss(0, 1), y) for y in [0] * 60 + [1] * 40]
    df = models.assembled(table(spark, rows, "a double, b double, y int"), ["a", "b"], "y")
    model = models.Calibrated(models.kernel_machine(), 3).fit(df)
    out = models.scored(model, df).collect()
    margin = {tuple(r.features): r.rawPrediction[1] for r in model.model.transform(df).collect()}
    ordered = sorted(out, key=lambda r: margin[tuple(r.features)])
    assert all(0 < r.score < 1 for r in out) and all(x.score <= y.score + 1e-12 for x, y in zip(ordered, ordered[1:], strict=False))
    assert sum((r.score > 0.5) == bool(r.y) for r in out) > 60


def test_stacked_cleaning_equals_window_by_window(spark):
    rng = np.random.default_rng(3)
    windows_ = [rng.normal(size=n) for n in (64, 64, 64, 16, 5, 3, 2, 1, 64, 64, 64)]
    windows_[0][[3, 40]] = [90.0, -70.0]
    windows_[1][10:14] = np.nan
    windows_[2][:55] = np.nan
    windows_[3][:] = 4.0
    windows_[3][2] = 9.0
    windows_[4][1] = np.nan
    windows_[5][:] = [np.nan, 2.0, np.nan]
    windows_[6][:] = np.nan
    windows_[8][:] = [0.0] * 60 + [5.0] * 4
    windows_[9][[0, 63]] = 1e3
    windows_[10][5:] = np.nan
    rows = [(i, [None if np.isnan(v) else float(v) for v in w]) for i, w in enumerate(windows_)] + [(11, []), (12, None)]
    df = table(spark, rows, "id int, x array<double>").coalesce(1)
    out = {r.id: r for r in df.select("id", cleaning.outliers_filled(F.col("x")).alias("o"), cleaning.missing_filled(F.col("x")).alias("m"), cleaning.cleaned(F.col("x")).alias("c")).collect()}
    for i, w in enumerate(windows_):
        outliers, gaps = cleaning.fill_outliers(w.copy()), cleaning.fill_missing(w.copy())
        both = cleaning.fill_missing(outliers.copy())
        for got, want in ((out[i].o, outliers), (out[i].m, gaps), (out[i].c, both)):
            assert [np.nan if v is None else v for v in got] == pytest.approx(list(want), rel=1e-8, abs=1e-8, nan_ok=True), i
    assert out[11].c == [] and out[12].c is None


def test_leave_one_subject_out_end_to_end(spark):
    rng = random.Random(5)
    rows = [(s, float(y * 2 + rng.gauss(0, 0.3)), rng.gauss(0, 1), 1.0, y) for s in "abcd" for y in [0] * 14 + [1] * 6]
    rows += [("e", 1.0, float("inf"), 1.0, 0)]

    def broken(seed):
        raise RuntimeError("no such model")

    df = table(spark, rows, "subject string, good double, noise double, same double, y int")
    report = training.leave_one_subject_out(df, ["good", "noise", "same"], "y", {"logistic": lambda s: models.logistic(60), "broken": broken}, k=1, folds=["a", "b"])
    out = {r.fold: r for r in report.results.collect()}
    assert set(out) == {"a", "b"} and all(r.f1 > 0.8 and r.tn + r.fp == 14 for r in out.values())
    assert report.chosen["logistic", "a"] == ["good"] and sorted(report.skipped) == [("broken", "a", "no such model"), ("broken", "b", "no such model")]
    alone = training.leave_one_subject_out(df.filter("subject IN ('a', 'b')"), ["good"], "y", {"logistic": lambda s: models.logistic(60)}, folds=["a"])
    assert alone.results is None and alone.skipped[0][2] == "too few subjects or classes"


def test_sampled_grid_is_repeatable():
    grid = {"a": [1, 2, 3], "b": [4, 5]}
    assert models.sampled_grid(grid, 3) == models.sampled_grid(grid, 3) and len(models.sampled_grid(grid, 99)) == 6


def test_synthetic_rows_lie_between_minority_rows(spark):
    rows = [(i, float(i), 0.0, int(i >= 16)) for i in range(20)]
    made = models.adasyn(table(spark, rows, "id long, a double, b double, y int"), "id", ["a", "b"], "y").collect()
    assert made and all(16 <= r.a <= 19 and r.y == 1 for r in made)


@pytest.fixture(params=[(16, 20, 3), (16, 1, 15), (4096, 1_000_000, 255)])
def sketches(request, monkeypatch):
    """Sizes of a sketch, of a piece that is put in order, and the cuts of one that is cut again."""
    for name, value in zip(("SKETCH", "PIECE_ROWS", "CUTS"), request.param, strict=True):
        monkeypatch.setattr(distributed, name, value)
    return request.param


def test_quantiles_are_exact(spark, sketches):
    rng = random.Random(sketches[0])
    rows = [(rng.choice([rng.gauss(0, 1), 5.0, 1e9 * rng.random(), -3.5]), rng.randrange(3) if i % 5 else None, None, 7.0) for i in range(700)]
    df = table(spark, rows, "a double, b int, c double, d double")
    p = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = quantiles(df, ["a", "b", "c", "d"], p)
    for i, c in enumerate("abd"):
        values = [r["abcd".index(c)] for r in rows if r["abcd".index(c)] is not None]
        assert got[c] == pytest.approx(list(np.quantile(values, p)), rel=1e-12), i
    assert got["c"] == [None] * len(p)


def test_quantiles_of_columns_with_infinities(spark, sketches):
    inf = float("inf")
    rows = [(inf if i % 7 == 0 else -inf if i % 7 == 1 else float(i), inf, float("nan") if i % 2 else float(i)) for i in range(500)]
    df = table(spark, rows, "a double, b double, c double")
    p = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = quantiles(df, ["a", "b", "c"], p)
    a = sorted(r[0] for r in rows)
    for q, x in zip(p, got["a"], strict=True):
        low, part = int((len(a) - 1) * q), (len(a) - 1) * q % 1
        want = a[low] if a[low] == a[min(low + 1, len(a) - 1)] or not part else a[low] + (a[low + 1] - a[low]) * part
        assert x == pytest.approx(want, nan_ok=True)
    assert got["b"] == [inf] * len(p) and got["c"] == pytest.approx(list(np.quantile(range(0, 500, 2), p)))
    described = statistics.describe(df, ["a"]).collect()
    assert len(described) >= 1


def test_quantiles_of_extreme_and_repeated_values_end(spark, sketches):
    least, most = 5e-324, 1.7e308
    rng = random.Random(4)
    columns = {
        "wide": [rng.choice([-most, most, 0.0, least, -least, 1.0]) for _ in range(200)],
        "narrow": [0.0 if i % 2 else least for i in range(200)],
        "spread": [(-1.0) ** i * 10.0 ** rng.randrange(-307, 308) for i in range(200)],
        "half": [7.0] * 100 + [rng.gauss(0, 1e-300) for _ in range(100)],
        "close": [1.0 + rng.randrange(40) * 2.0**-52 for _ in range(200)],
    }
    rows = list(zip(*columns.values(), strict=True))
    p = [0.0, 0.25, 0.5, 0.505, 0.75, 1.0]
    got = quantiles(table(spark, rows, ", ".join(f"{c} double" for c in columns)).repartition(3), list(columns), p)
    for c, values in columns.items():
        ordered = sorted(values)
        for q, x in zip(p, got[c], strict=True):
            low, part = int(199 * q), 199 * q % 1
            a, b = ordered[low], ordered[min(low + 1, 199)]
            assert x == pytest.approx(a if a == b else a * (1 - part) + b * part, rel=1e-9, abs=0.0), (c, q)


def test_quantiles_read_the_table_three_times(spark):
    seen = spark.sparkContext.accumulator(0)
    n = 2 * distributed.SKETCH
    df = spark.range(n).withColumn("y", (F.col("id") * 7919) % 3001)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    columns = ["id", "y", *(f"c{i}" for i in range(20))]
    read = df.mapInPandas(count, df.schema).withColumns({f"c{i}": F.col("y") * i for i in range(20)})
    quantiles(read, columns, [0.25, 0.5, 0.75])
    assert seen.value == 3 * n
    quantiles(read.limit(1000), columns[:3], [0.5])
    assert seen.value <= 4 * n


def test_quantiles_of_an_empty_table(spark):
    assert quantiles(table(spark, [], "a double"), ["a"], [0.5]) == {"a": [None]}


def test_constant_columns_by_least_and_largest(spark):
    nan = float("nan")
    rows = [(1, None, "x", nan, 1.0, None, 1), (1, None, "x", nan, nan, 2, 2), (1, None, "x", nan, 1.0, 2, 1)]
    df = table(spark, rows, "a int, b double, c string, d double, e double, f int, g int")
    out = statistics.constant_columns(df, list("abcdefg"))
    assert {r["column"] for r in out.collect()} == {"a", "b", "c", "d"}
    assert "Expand" not in out._jdf.queryExecution().toString()
    assert {r["column"] for r in statistics.constant_columns(df.limit(0), ["a", "b"]).collect()} == {"a", "b"}


def plain_knn(rows, width, k):
    """rows: (key, x0, x1, ...). Filled rows, compared one by one."""
    out = []
    missing = lambda x: x is None or math.isnan(x) or math.isinf(x)
    for i, row in enumerate(rows):
        filled = [row[0]]
        for c in range(1, width + 1):
            if not missing(row[c]):
                filled.append(row[c])
                continue
            near = []
            for j, other in enumerate(rows):
                both = [d for d in range(1, width + 1) if not missing(row[d]) and not missing(other[d])]
                if j != i and both and not missing(other[c]):
                    d = math.sqrt(sum((row[x] - other[x]) ** 2 for x in both) * (width / len(both)))
                    near.append((d, (other[0] is not None, other[0] or 0), other[c]))
            near.sort()
            values = [v for _, _, v in near[:k]]
            own = [o[c] for o in rows if not missing(o[c])]
            filled.append(sum(values) / len(values) if values else sum(own) / len(own) if own else None)
        out.append(tuple(filled))
    return out


@pytest.mark.parametrize(("block", "cells"), [(4096, 1 << 22), (7, 30)])
def test_knn_imputation_equals_a_plain_search(spark, monkeypatch, block, cells):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "CELLS", cells)
    rng = random.Random(6)
    value = lambda: None if rng.random() < 0.25 else rng.choice([float(rng.randrange(4)), rng.gauss(0, 1), float("inf")] if rng.random() < 0.3 else [float(rng.randrange(4))])
    rows = [(rng.choice([None, *range(15)]), value(), value(), value(), None) for _ in range(60)] + [(3, 1.0, None, 2.0, None)] * 4
    df = table(spark, rows, "key int, a double, b double, c double, d double").withColumn("__q", F.lit("kept")).repartition(3)
    out = selection.knn_impute(df, "key", ["a", "b", "c", "d"], 3)
    assert "CartesianProduct" not in out._jdf.queryExecution().toString()
    got = [tuple(r)[:5] for r in out.collect()]
    tidy = lambda rs: sorted([tuple(None if x is None else round(x, 9) for x in r) for r in rs], key=repr)
    assert tidy(got) == tidy(plain_knn(rows, 4, 3)) and out.columns == df.columns


def test_knn_by_text_keys_one_column_and_empty_tables(spark):
    df = table(spark, [("b", None, 1.0), ("a", 2.0, 1.0), ("a", 4.0, 1.0), ("c", 9.0, 1.0)], "key string, a double, z double")
    assert [r.a for r in selection.knn_impute(df, "key", ["a", "z"], 2).filter("key = 'b'").collect()] == [3.0]
    alone = selection.knn_impute(df, "key", ["a"], 2)
    assert sorted(r.a for r in alone.collect()) == [2.0, 4.0, 5.0, 9.0]
    assert selection.knn_impute(df.limit(0), "key", ["a", "z"]).collect() == []


def test_synthetic_rows_of_repeated_keys(spark):
    rows = [(7, 1.0, 0.0, 1), (7, 2.0, 0.0, 1), *((20 + i, 1.5 + i, 0.0, 0) for i in range(4))]
    made = models.adasyn(table(spark, rows, "id long, a double, b double, y int"), "id", ["a", "b"], "y").collect()
    assert len(made) == 2 and all(1 <= r.a <= 2 and r.y == 1 and r.source == 7 for r in made)
    lone = [(1, 0.0, 0.0, 1), (2, 1.0, 0.0, 0), (3, 2.0, 0.0, 0)]
    assert models.adasyn(table(spark, lone, "id long, a double, b double, y int"), "id", ["a", "b"], "y").collect() == []


def two_sided(spark, rng):
    """Four subjects; of the left sensor ``good`` tells the label, of the right one ``fair`` a little."""
    rows = []
    for s in "abcd":
        for i in range(40):
            y = int(i % 4 == 0)
            rows.append((s, i, y * 2 + rng.gauss(0, 0.3), rng.gauss(0, 1), y + rng.gauss(0, 1) if i % 9 else None, rng.gauss(0, 1), y))
    return table(spark, rows, "subject string, id int, l_good double, l_noise double, r_fair double, r_noise double, y int")


def SIDES():
    return F.substring("column", 1, 1)


COLUMNS = ["l_good", "l_noise", "r_fair", "r_noise"]


def test_sensor_selector_takes_the_best_of_each(spark):
    df = two_sided(spark, random.Random(1))
    selector = tuning.SensorKBest(COLUMNS, "y", SIDES(), 1)
    model = selector.fit(df)
    assert model.columns == ["l_good", "r_fair"] and set(model.medians) == {"l_good", "r_fair"}
    assert selector.copy({selector.k: 2}).fit(df).columns == COLUMNS
    assert [m.columns for _, m in selector.fitMultiple(df, [{selector.k: 2}, {}])] == [COLUMNS, ["l_good", "r_fair"]]
    out = model.transform(df)
    assert len(out.first().features) == 2 and out.filter("r_fair IS NULL").count() == 0
    with pytest.raises(ValueError):
        tuning.SensorKBest(["x"], "y").fit(table(spark, [(1.0, 0), (1.0, 1)], "x double, y int")).transform(df)


def test_selectors_never_see_the_rows_held_out(spark, monkeypatch):
    df = training.inner_folds(two_sided(spark, random.Random(2)), "subject")
    seen = []
    ranking = tuning.SensorKBest._ranking
    monkeypatch.setattr(tuning.SensorKBest, "_ranking", lambda self, rows: seen.append({(r.subject, r.inner) for r in rows.select("subject", "inner").distinct().collect()}) or ranking(self, rows))
    found = tuning.search(df, "inner", tuning.SensorKBest(COLUMNS, "y", SIDES()), lambda seed, c: models.logistic(100, c, 5), {"c": [0.001, 10.0]}, [1, 2], 20)
    every = {(r.subject, r.inner) for r in df.select("subject", "inner").distinct().collect()}
    folds = sorted({f for _, f in every})
    tidy = lambda sets: sorted(sorted(x) for x in sets)
    assert tidy(seen) == tidy({x for x in every if x[1] != f} for f in folds)  # folds run side by side
    assert len(found.settings) == 4 and all(len(x) == len(folds) and all(0 <= v <= 1 for v in x) for x in found.f1)
    assert found.best is not None and found.mean(found.settings.index(found.best)) == max(found.mean(i) for i in range(4)) > 0.8


def test_a_setting_that_cannot_be_fitted_loses(spark):
    df = training.inner_folds(two_sided(spark, random.Random(3)), "subject")

    def make(seed, c):
        if c > 1:
            raise ValueError("too large")
        return models.logistic(100, c, 3)

    found = tuning.search(df, "inner", tuning.SensorKBest(COLUMNS, "y"), make, {"c": [1.0, 5.0]}, [2])
    assert found.best == {"k": 2, "c": 1.0} and sum(math.isnan(found.mean(i)) for i in range(2)) == 1
    assert tuning.search(df, "inner", tuning.SensorKBest(COLUMNS, "y"), make, {"c": [5.0]}, [2]).best is None


def test_choice_of_k(spark):
    df = two_sided(spark, random.Random(4))
    best, scores = tuning.choose_k(df, "id", tuning.SensorKBest(COLUMNS, "y", SIDES()), lambda seed: models.forest(5, 4, seed), [2, 1], 3)
    rows = scores.collect()
    assert [(r.k, r.n_columns) for r in rows] == [(1, 2), (2, 4)] and all(r.f1_mean > 0.7 and 0 <= r.f1_std < 0.3 and 0.7 < r.bal_mean <= 1 for r in rows)
    assert best == max(rows, key=lambda r: (r.f1_mean, -r.k)).k and tuning.around(5) == [3, 5, 10] and tuning.around(3) == [3, 8]


def test_settings_that_win_in_most_folds(spark):
    report = training.Report(best={("m", "a"): {"k": 3, "c": 1}, ("m", "b"): {"k": 3, "c": 0.1}, ("m", "c"): {"k": 5, "c": 1}, ("n", "a"): {"k": 5}})
    got = {(r.classifier, r.parameter): (r.value, r.folds) for r in report.settings(spark).collect()}
    assert got == {("m", "k"): ("3", 2), ("m", "c"): ("1", 2), ("n", "k"): ("5", 1)}


def test_p_values_of_two_and_three_classes(spark):
    # Upper tails of the F distribution, from tables.
    assert models.f_survival(4.965, 1, 10) == pytest.approx(0.05, abs=2e-4) and models.f_survival(3.885, 2, 12) == pytest.approx(0.05, abs=2e-4)
    rows = [(float(i % 3) + (i // 3) * 0.1, float((i * 7) % 5), i % 3) for i in range(30)]
    df = table(spark, rows, "a double, b double, y int")
    p = {r["column"]: r.p for r in models.with_p_values(selection.anova(df, ["a", "b"], "y"), df, "y").collect()}
    assert p["a"] < 1e-6 and p["b"] > 0.05


@pytest.mark.parametrize("stretches", [1, 3, 256])
@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_in_stretches(spark, stretches, descending):
    rng = random.Random(stretches)
    rows = [(rng.choice("ab") if i % 9 else None, None if i == 0 else float(i), rng.randrange(10)) for i in range(120)]
    got = running_sums(table(spark, rows, "g string, x double, n long"), "x", ["n"], ["g"], descending, stretches).collect()
    want = []
    for g in ("a", "b", None):
        total = 0
        for _, x, n in sorted((r for r in rows if r[0] == g), key=lambda r: (-np.inf if r[1] is None else r[1]), reverse=descending):
            total += n
            want.append((g, x, total))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("size", [1_000_000, 7])
def test_dealt_ranks_number_each_group_once(spark, size):
    df = table(spark, [(i, None if i % 10 == 0 else i % 3) for i in range(100)], "id int, g int")
    rows = dealt_rank(df, "g", "id", "n", rows_per_bucket=size).collect()
    assert len(rows) == 100 and rows[0].asDict().keys() == {"id", "g", "n"}
    for g in (None, 0, 1, 2):
        own = sorted(r.n for r in rows if r.g == g)
        assert own == list(range(len(own)))


@pytest.mark.parametrize("stretch", [1, 3, 16, 40, 1000])
def test_long_recordings_in_stretches_equal_whole_ones(spark, stretch):
    rng = random.Random(stretch)
    rows = [(s, float(t) if t % 11 else None, rng.choice([0, 1, 1, 1, 2, 2, None]), rng.random()) for s, n in (("a", 137), (None, 45), ("b", 1)) for t in range(n)]
    rng.shuffle(rows)
    df = table(spark, [(i, *row) for i, row in enumerate(rows)], "id int, s string, t double, annotation int, x double").repartition(3)
    keys, order = ["s"], ["t", "id"]
    whole, cut = labels.with_ordinal(df, keys, order), labels.with_ordinal(df, keys, order, stretch=stretch)
    assert set(cut.columns) == set(whole.columns)
    same = lambda a, b: sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(b.columns)).collect()))
    assert same(whole, cut)
    for lead in (0, 2, 50):
        a, b = labels.with_labels(whole, keys, ["pos"], lead=lead), labels.with_labels(cut, keys, ["pos"], lead=lead, stretch=stretch)
        assert same(a, b), lead
    for geometry in (windows.Geometry(16, 8), windows.Geometry(16, 16), windows.Geometry(7, 3), windows.Geometry(3, 5)):
        a, b = (windows.sliding(d, geometry, keys, ["x"], ["binary_label"], stretch=n) for d, n in ((a, None), (b, stretch)))
        assert same(a, b), geometry
        a, b = labels.with_labels(whole, keys, ["pos"], lead=2), labels.with_labels(cut, keys, ["pos"], lead=2, stretch=stretch)


def test_no_task_holds_a_long_recording(spark):
    df = spark.range(20_000).select(F.lit("one").alias("s"), "id", (F.col("id") % 3).cast("int").alias("annotation"), F.col("id").cast("double").alias("x"))
    numbered = labels.with_ordinal(df, ["s"], ["id"], stretch=2_000)
    held = numbered.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert held <= 5_000 and numbered.filter("pos <> id").count() == 0
    w = windows.sliding(labels.with_labels(numbered, ["s"], ["pos"], stretch=2_000), windows.Geometry(64, 32), ["s"], ["x"], ["binary_label"], stretch=2_000)
    assert w.count() == windows.Geometry(64, 32).count(20_000)


def test_context_is_clamped(spark):
    df = table(spark, [("s", i, i / 4.0, 1 if i == 2 else 0) for i in range(30)], "subject string, pos long, t double, y int")
    out = windows.context(df, ["subject"], F.col("y") == 1, 5, time="t").orderBy("pos").collect()
    assert [r.pos for r in out] == list(range(7)) and out[0].rel_time == 0.0 and math.isclose(out[-1].rel_time, 1.5)


def test_training_queries_take_every_subject_and_row(spark, monkeypatch):
    from stridelab.plans import signals

    folds, taken = [], []
    prepared, adasyn = training.prepared, models.adasyn
    monkeypatch.setattr(training, "prepared", lambda train, test, columns, subject: folds.extend(r[0] for r in test.select(subject).distinct().collect()) or prepared(train.limit(0), test, columns, subject))
    monkeypatch.setattr(models, "adasyn", lambda rows, *a: taken.append(rows) or adasyn(rows, *a))
    sf = "/root/testdata/sf0.001"
    with pytest.raises(AttributeError):  # no rows to train on, so there are no results to pool
        signals.loso_training(spark, sf)
    assert sorted(folds) == list(range(7))
    signals.adasyn_rows(spark, sf)
    counts = {r.y: r["count"] for r in taken[0].groupBy("y").count().collect()}
    assert sum(counts.values()) == spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert 0 < counts[1] < 0.8 * counts[0]


@pytest.mark.parametrize("sent", [1 << 20, 10])
def test_many_folds_meet_rows_in_lists(spark, monkeypatch, sent):
    monkeypatch.setattr(windows, "SENT_FOLDS", sent, raising=False)
    monkeypatch.setattr(windows, "TAGGED", 10_000, raising=False)
    train = spark.range(0, 10_010, 5).select(F.col("id").alias("subject"), (F.col("id") * 10).alias("k")).filter("subject < 30 OR subject > 10003")
    test = spark.range(10_005).select(F.col("id").alias("subject"), F.lit(0).cast("long").alias("k")).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS subject, CAST(1 AS BIGINT) AS k"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where tables are large
    try:
        out = windows.leave_one_out(train, test)
        assert "Cartesian" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    rows = out.filter("role = 'train'").groupBy("subject", "k").agg(F.count("*").alias("n"), F.count_distinct("fold").alias("folds"), F.max((F.col("fold") == F.col("subject")).cast("int")).alias("own")).collect()
    assert {(r.subject, r.k, r.n, r.folds, r.own) for r in rows} == {(s, 10 * s, 10_004, 10_004, 0) for s in range(0, 30, 5)} | {(10_005, 100_050, 10_005, 10_005, 0)}
    assert out.filter("role = 'test'").count() == 10_006


@pytest.mark.parametrize("leaves", [4096, 5])
def test_nearest_rows_without_gaps_meet_few_blocks(spark, monkeypatch, leaves):
    """By leaves, as by blocks: with copies, more rows in a place than a block has, and a column that is constant."""
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    monkeypatch.setattr(neighbours, "LEAF", 16, raising=False)
    monkeypatch.setattr(neighbours, "LEAVES", leaves, raising=False)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(400, 2)), np.round(rng.normal(size=(200, 2)), 1), np.tile([[0.5, -0.5]], (150, 1)), [[50.0, 0.0], [51.0, 0.0]]])
    number = rng.permutation(len(x))
    df = spark.createDataFrame([(int(n), int(n) % 50, float(a), float(b), 1.0, float(n % 3)) for n, (a, b) in zip(number, x, strict=True)], "n long, t int, a double, b double, c double, v double")
    asked = df.filter("n % 4 = 0")
    seen = spark.sparkContext.accumulator(0)
    block = neighbours._block

    def counted(left, right, *rest):
        seen.add(left.num_rows * right.num_rows)
        return block(left, right, *rest)

    monkeypatch.setattr(neighbours, "_block", counted)
    got = {(r.query, r.nth): (r.row, r.d, r.value) for r in neighbours.nearest(asked, df, ["a", "b", "c"], "n", "t", 3, "v").collect()}
    want = {}
    for i in np.flatnonzero(number % 4 == 0):
        d = np.sqrt(((x[i] - x) ** 2).sum(axis=1))
        best = [j for j in np.lexsort((number, number % 3, number % 50, d)) if j != i][:3]
        want |= {(int(number[i]), nth): (int(number[j]), pytest.approx(float(d[j]), abs=1e-12), float(number[j] % 3)) for nth, j in enumerate(best, 1)}
    assert got == want
    assert leaves < 10 or 0 < seen.value < 0.75 * len(number) ** 2 / 4

"""Goldens and independent transcriptions for the signal functions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridelab.functions import columns, extract, nonlinear, spectral, time_domain, wavelet
from stridelab.operators import cleaning, labels, models, windows

I64 = np.arange(64)
SIGNALS = {
    "ramp": I64.astype(float),
    "sin4": np.sin(2 * np.pi * 4 * I64 / 64),
    "mix": np.sin(2 * np.pi * 2 * I64 / 64) + 0.5 * np.sin(2 * np.pi * 6 * I64 / 64),
    "lcg": ((I64 * 37 + 11) % 64) / 64 - 0.5,
}
# mean std rms iqr | peak energy centroid loco freeze index | energies, entropy | sampen apen higuchi
GOLDEN = {
    "ramp": ([31.5, 18.473, 36.5171, 31.5], [1, 82.1178, 1.05283, 42.9118, 0.172728, 0.00402518], [123245, 40.3205, 4.12632, 0.0128462, 0.00333174], [-0.0157316, -0.0154626, 0]),
    "sin4": ([0, 0.707107, 0.707107, 1.41421], [4, 0.5, 4, 0.0416667, 0.458333, 11], [28.4204, 29.6541, 1.42604, 0.00650057, 0.790434], [0.296243, 0.174178, 0.286729]),
    "mix": ([0, 0.790569, 0.790569, 1.52112], [2, 0.625, 2.8, 0.416667, 0.166667, 0.4], [52.7699, 12.2642, 2.72808, 0.019351, 0.63587], [0.418667, 0.315521, 0.402593]),
    "lcg": ([-0.0078125, 0.28864, 0.288746, 0.492188], [27, 0.0833064, 21.9151, 0.00110381, 0.00285692, 2.58824], [0.126338, 0.340203, 1.41704, 4.24455, 0.833499], [0.026928, 0.026317, 1.162]),
}


def near(got, want, rel=2e-5, floor=1e-9):
    for g, w in zip(got, want, strict=True):
        assert g == pytest.approx(w, rel=rel, abs=floor), (got, want)


@pytest.mark.parametrize("name", SIGNALS)
def test_goldens(name):
    x = SIGNALS[name]
    _, freq, wave, non = GOLDEN[name]
    near(spectral.features(x[None])[0][:6], freq)
    near(wavelet.features(x[None])[0][:5], wave)
    near([nonlinear.sample_entropy(x), nonlinear.approx_entropy(x), nonlinear.higuchi(x)], non, floor=1e-6)


@pytest.mark.parametrize("name", SIGNALS)
def test_time_features_in_rows_and_in_the_row_agree_with_goldens(spark, name):
    x = [float(v) for v in SIGNALS[name]]
    df = spark.createDataFrame([(1, x)], "w int, x array<double>")
    long = time_domain.time_features(time_domain.samples(df, ["w"], "x"), ["w"]).first()
    wide = extract.feature_table(df, ["w"], ["x"], families=["time"]).first()
    near([long[c] for c in ("mean", "std", "rms", "iqr")], GOLDEN[name][0], floor=1e-6)
    for c in time_domain.NAMES:
        assert wide[f"ch0_{c}"] == pytest.approx(long[c], abs=1e-9)
    if name == "lcg":
        assert long["zero_crossing_rate"] == 54 / 64


def test_constant_signal(spark):
    df = spark.createDataFrame([(1, [1.0] * 64)], "w int, x array<double>")
    r = extract.feature_table(df, ["w"], ["x"]).first()
    assert (r["ch0_std"], r["ch0_iqr"], r["ch0_zero_crossing_rate"], r["ch0_skew"], r["ch0_freezing_index"], r["ch0_locomotion_band_index"]) == (0, 0, 0, None, None, 0)
    assert r["ch0_sample_entropy"] == pytest.approx(0) and r["ch0_approx_entropy"] == pytest.approx(0) and r["ch0_higuchi_fd"] is None


def test_wavelet_lengths_and_energy():
    bands = wavelet.decompose(np.random.default_rng(1).normal(size=(2, 256)))
    assert [b.shape[1] for b in bands] == [38, 38, 69, 131]
    assert wavelet.LOW.sum() == pytest.approx(math.sqrt(2)) and (wavelet.LOW**2).sum() == pytest.approx(1)
    assert all(abs((np.arange(8) ** k * wavelet.HIGH).sum()) < 1e-7 for k in range(4))  # four vanishing moments


@pytest.mark.parametrize(("n", "rate"), [(64, 64), (256, 64), (512, 128), (800, 200), (257, 64), (5, 64), (1, 64)])
def test_welch_against_plain_sums(n, rate):
    x = np.random.default_rng(n).normal(size=n)
    size = min(256, n)
    hop = size - size // 2
    w = np.array([0.5 - 0.5 * math.cos(2 * math.pi * i / size) for i in range(size)])
    parts = []
    for s in range(0, n - size + 1, hop):
        part = x[s : s + size] - np.mean(x[s : s + size])
        row = []
        for j in range(size // 2 + 1):
            z = sum(part[i] * w[i] * complex(math.cos(2 * math.pi * i * j / size), -math.sin(2 * math.pi * i * j / size)) for i in range(size)) if n < 300 else np.dot(part * w, np.exp(-2j * np.pi * np.arange(size) * j / size))
            row.append(abs(z) ** 2 / (rate * (w**2).sum() or 1) * (1 if j == 0 or (size % 2 == 0 and j == size // 2) else 2))
        parts.append(row)
    if (w**2).sum() > 0:
        np.testing.assert_allclose(spectral.welch(x, rate)[1][0], np.mean(parts, axis=0), atol=1e-9)


def test_peaks():
    assert time_domain.peaks(np.array([0, 1, 0, 2, 0, 1, 0.0]), 1).tolist() == [1, 3, 5]
    assert time_domain.peaks(np.array([0, 1, 0, 2, 0, 1, 0.0]), 3).tolist() == [3]
    assert time_domain.peaks(np.array([0, 3, 3, 3, 0.0]), 1).tolist() == [2]  # a plateau's middle
    assert time_domain.peaks(np.array([5, 1, 0, 1, 5.0]), 1).tolist() == []  # edges are none
    assert time_domain.peaks(np.array([0, 1, 0, 1, 0.0]), 3).tolist() == [3]  # of equal heights the later


def test_cleaning_goldens():
    x = np.array([1, 2, 3, 4, 100, 6, 7, 8.0])
    assert cleaning.outlier_mask(x).tolist() == [False] * 4 + [True] + [False] * 3
    assert cleaning.fill_outliers(x)[4] == pytest.approx(5.0)
    gap = x.copy()
    gap[0] = np.nan
    assert not cleaning.outlier_mask(gap).any()
    good = np.arange(1, 8)
    assert cleaning.fill_missing(gap)[0] == pytest.approx(np.polyval(np.polyfit(good, x[1:], 3), 0), rel=1e-6)
    assert cleaning.fill_missing(np.array([np.nan, 3, np.nan])).tolist() == [3, 3, 3]
    assert cleaning.fill_missing(np.array([np.nan, np.nan])).tolist() == [0, 0]
    assert not cleaning.outlier_mask(np.ones(9)).any()


def test_cleaning_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0, 100.0, 6.0, 7.0, 8.0]), (2, [None, 3.0, None]), (3, None)], "w int, x array<double>")
    out = {r.w: r.x for r in cleaning.clean_windows(df, ["x"]).collect()}
    assert out[1][4] == pytest.approx(5.0) and out[2] == [3.0, 3.0, 3.0] and out[3] is None


def test_long_windows_stay_well_conditioned():
    t = np.arange(800.0)
    curve = 1e-6 * t**3 - 2e-3 * t**2 + t - 5
    x = curve.copy()
    x[::37] = np.nan
    np.testing.assert_allclose(cleaning.fill_missing(x), curve, rtol=1e-6, atol=1e-6)


def annotated(spark, values, subject="a"):
    return spark.createDataFrame([(subject, i, v) for i, v in enumerate(values)], "subject string, pos long, annotation int")


@pytest.mark.parametrize(("values", "onsets"), [([1, 1, 2, 2, 1, 2], [2, 5]), ([2, 2, 1, 2], [3]), ([], []), ([1, None, 2], [])])
def test_onsets(spark, values, onsets):
    df = annotated(spark, values)
    out = df.withColumn("o", labels.onset(F.col("annotation"), labels.in_order(["subject"], ["pos"])))
    assert [r.pos for r in out.filter("o = 1").orderBy("pos").collect()] == onsets


@pytest.mark.parametrize(("values", "lead", "want"), [([1, 1, 1, 2, 2, 1, 2], 2, [0, 2, 2, 1, 1, 2, 1]), ([1, 1, 2], 5, [2, 2, 1]), ([1, 2, 1], 0, [0, 1, 0])])
def test_lead_in(spark, values, lead, want):
    out = labels.with_labels(annotated(spark, values), ["subject"], ["pos"], lead=lead).orderBy("pos").collect()
    assert [r.multiclass_label for r in out] == want and "__onset" not in out[0].asDict()


def test_geometry():
    g = windows.Geometry.of()
    assert (g.size, g.step) == (256, 128)
    assert [g.count(n) for n in (256, 255, 384, 511, 512)] == [1, 0, 2, 2, 3]
    assert windows.Geometry.of(4.0, 0.0, 200).step == 800 and g.info(64)["window_seconds"] == 4.0
    with pytest.raises(ValueError):
        windows.Geometry.of(overlap=1.0)


def test_windows_never_cross_recordings_and_votes_take_the_smallest(spark):
    rng = random.Random(3)
    rows = [(s, p, float(rng.random()), rng.randrange(3)) for s, n in (("a", 21), ("b", 7), ("c", 8)) for p in range(n)]
    df = spark.createDataFrame(rows, "subject string, pos long, x double, y int").repartition(5)
    g = windows.Geometry(8, 3)
    got = {(r.subject, r.k): (r.x, r.y) for r in windows.sliding(df, g, ["subject"], ["x"], ["y"]).collect()}
    want = {}
    for s, n in (("a", 21), ("b", 7), ("c", 8)):
        own = [r for r in rows if r[0] == s]
        for k in range(g.count(n)):
            part = own[k * 3 : k * 3 + 8]
            counts = np.bincount([r[3] for r in part])
            want[s, k] = ([r[2] for r in part], int(counts.argmax()))
    assert got == want


def test_scalars(spark):
    df = spark.createDataFrame([(1, 0, 0.5), (None, 1, float("nan")), (0, None, float("inf"))], "a int, b int, x double")
    out = df.select(columns.any_flag(F.col("a"), F.col("b")).alias("f"), columns.finite(F.col("x")).alias("x"), columns.mapped(F.col("a"), {0: "no", 1: "yes"}).alias("m"), columns.nan_to_null(F.col("x")).alias("n")).collect()
    assert [r.f for r in out] == [1, 1, 0] and [r.x for r in out] == [0.5, None, None] and [r.m for r in out] == ["yes", None, "no"] and out[1].n is None
    sensors = columns.sensor_of(F.col("v"), {0: "ankle", 3: "thigh"}, ["acc_ankle_"])
    names = ["ch0_mean", "ch3_rms", "ch9_rms", "acc_ankle_mag_std", "cadence"]
    got = spark.createDataFrame([(n,) for n in names], "v string").select(sensors.alias("s")).collect()
    assert [r.s for r in got] == ["ankle", "thigh", "Global", "acc_ankle", "Global"]


def test_feature_names_and_counts():
    groups = {"acc_ankle": [0, 1, 2], "acc_thigh": [3, 4, 5], "acc_trunk": [6, 7, 8]}
    assert len(extract.feature_names(9, groups)) == 337
    assert len(extract.feature_names(12, {f"g{i}": [] for i in range(4)})) == 449
    assert len(extract.feature_names(6, {"acc": [], "gyr": []})) == 225
    assert extract.feature_names(1)[-1] == "cadence" and extract.feature_names(1)[28] == "mag_mean"
    assert extract.cadence_group({"gyr": [], "acc_x": []}) == "acc_x" and extract.cadence_group({"gyr": []}) == "gyr"


def test_table_has_the_named_features(spark):
    df = spark.createDataFrame([(1, [float(v) for v in SIGNALS["lcg"]], [float(v) for v in SIGNALS["mix"]])], "w int, a array<double>, b array<double>")
    groups = {"acc": [0, 1]}
    table = extract.feature_table(df, ["w"], ["a", "b"], groups)
    assert table.columns == ["w", *extract.feature_names(2, groups)]
    row = table.first()
    assert row["ch0_spectral_centroid"] == pytest.approx(21.9151, rel=1e-4) and row["ch1_wavelet_entropy"] == pytest.approx(0.63587, rel=1e-4)
    norm = np.sqrt(SIGNALS["lcg"] ** 2 + SIGNALS["mix"] ** 2)
    assert row["acc_mag_mean"] == pytest.approx(norm.mean()) and row["cadence"] == pytest.approx(len(time_domain.peaks(norm, 19)) / (1 / 60))


@pytest.mark.parametrize(("f", "a", "b", "p"), [(4.0, 1, 10, 0.07338803), (1.0, 5, 5, 0.5), (3.0, 2, 30, 0.0650), (0.0, 1, 5, 1.0)])
def test_f_survival(f, a, b, p):
    assert models.f_survival(f, a, b) == pytest.approx(p, abs=1e-4)

"""Registered queries: cleaning, signal features, model inputs, models, evaluation, streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import extract, nonlinear, spectral, time_domain, wavelet
from ..operators import cleaning, evaluation, information, kendall, models, selection, statistics, training, tuning, windows
from ..session import scratch_folder
from ..streaming import windows as streams
from . import adapters as A
from .adapters import HALF, WHOLE, table
from .relational import CURVE_SQL, EV, EVF, LAB, LI, SCORE_SQL, query, r, scores, win

R = C.rounded

# --- cleaning --------------------------------------------------------------------------------

_GAPPY_SQL = "CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 23 = 0 THEN x * 50 ELSE x END"
_SPIKY_SQL = "CASE WHEN event_id % 23 = 0 THEN x * 50 ELSE x END"


def _rows_sql(signal: str, name: str = "rw") -> str:
    """Complete half-overlapping windows of a signal in long form."""
    return f"""{EV}, sg AS (SELECT subject, event_id, {signal} AS v, row_number() OVER (PARTITION BY subject ORDER BY ts, event_id) - 1 AS pos FROM ev),
        sn AS (SELECT subject, count(*) AS n FROM sg GROUP BY 1), sk AS (SELECT subject, unnest(range(0, greatest(0, (n - 16) // 8 + 1))) AS k FROM sn WHERE n >= 16),
        {name} AS (SELECT sk.subject, sk.k, sg.pos - sk.k * 8 AS i, sg.v FROM sk JOIN sg ON sg.subject = sk.subject AND sg.pos >= sk.k * 8 AND sg.pos < sk.k * 8 + 16)"""


def _windows_of(spark, sf_dir, signal) -> DataFrame:
    from ..operators import labels

    rows = labels.with_ordinal(A.events(spark, sf_dir), ["subject"], ["ts", "event_id"]).withColumn("v", signal)
    return windows.sliding(rows, HALF, ["subject"], ["v"])


def _spiky():
    return F.when(F.col("event_id") % 23 == 0, F.col("x") * 50).otherwise(F.col("x"))


_MAD_SQL = """m1 AS (SELECT subject, k, i, v, median(v) OVER w AS med, stddev_pop(v) OVER w AS sd, max(CASE WHEN v IS NULL THEN 1 ELSE 0 END) OVER w AS gaps FROM rw WINDOW w AS (PARTITION BY subject, k)),
        m2 AS (SELECT *, abs(v - med) AS away, median(abs(v - med)) OVER (PARTITION BY subject, k) AS mad FROM m1),
        mad AS (SELECT subject, k, i, v, coalesce(gaps = 0 AND away > 3.0 * 1.4826 * CASE WHEN mad <> 0 THEN mad WHEN sd > 0 THEN sd ELSE 1.0 END, false) AS bad FROM m2)"""

# A cubic over the good places by its normal equations, with places scaled to (i - 7.5) / 16, solved by elimination.
_T = "((i - 7.5) / 16.0)"


def _cubic_sql(good: str, src: str) -> str:
    sums = ", ".join(f"sum(CASE WHEN {good} THEN pow({_T}, {p}) END) AS s{p}" for p in range(7)) + ", " + ", ".join(f"sum(CASE WHEN {good} THEN pow({_T}, {p}) * v END) AS b{p}" for p in range(4))
    steps = [f"q0 AS (SELECT subject, k, {', '.join(f's{i + j} AS a{i}{j}' for i in range(4) for j in range(4))}, b0, b1, b2, b3 FROM qs)"]
    for c in range(4):
        keep = [f"a{i}{j}" for i in range(c + 1) for j in range(4)] + [f"b{i}" for i in range(c + 1)]
        new = [f"a{i}{j} - a{i}{c} / a{c}{c} * a{c}{j} AS a{i}{j}" for i in range(c + 1, 4) for j in range(4)] + [f"b{i} - a{i}{c} / a{c}{c} * b{c} AS b{i}" for i in range(c + 1, 4)]
        steps.append(f"q{c + 1} AS (SELECT subject, k, {', '.join(keep + new)} FROM q{c})")
    steps += [
        "x3 AS (SELECT *, b3 / a33 AS c3 FROM q4)",
        "x2 AS (SELECT *, (b2 - a23 * c3) / a22 AS c2 FROM x3)",
        "x1 AS (SELECT *, (b1 - a12 * c2 - a13 * c3) / a11 AS c1 FROM x2)",
        "x0 AS (SELECT *, (b0 - a01 * c1 - a02 * c2 - a03 * c3) / a00 AS c0 FROM x1)",
    ]
    return f"qs AS (SELECT subject, k, {sums} FROM {src} GROUP BY 1, 2), " + ", ".join(steps)


_FIT = f"(c0 + c1 * {_T} + c2 * {_T} * {_T} + c3 * {_T} * {_T} * {_T})"


@query(f"WITH {_rows_sql(_GAPPY_SQL)}, {_MAD_SQL} SELECT subject, k, CAST(i AS INTEGER) AS i FROM mad WHERE bad")
def mad_outliers(spark, sf_dir):
    rows = _windows_of(spark, sf_dir, A.gappy()).select("subject", "k", F.posexplode("v").alias("i", "x"))
    return cleaning.outlier_rows(rows, ["subject", "k"]).filter("is_outlier").select("subject", "k", "i")


@query(f"WITH {_rows_sql(_SPIKY_SQL)}, {_MAD_SQL}, {_cubic_sql('NOT bad', 'mad')} SELECT subject, k, CAST(i AS INTEGER) AS i, {r(f'CASE WHEN bad THEN {_FIT} ELSE v END', 4)} AS x FROM mad JOIN x0 USING (subject, k)")
def poly_fill_outliers(spark, sf_dir):
    w = _windows_of(spark, sf_dir, _spiky())
    return w.select("subject", "k", F.posexplode(cleaning.outliers_filled(F.col("v"))).alias("i", "x")).withColumn("x", R(F.col("x"), 4))


@query(f"WITH {_rows_sql(_GAPPY_SQL)}, {_cubic_sql('v IS NOT NULL', 'rw')} SELECT subject, k, CAST(i AS INTEGER) AS i, {r(f'coalesce(v, {_FIT})', 4)} AS x FROM rw JOIN x0 USING (subject, k)")
def poly_fill_missing(spark, sf_dir):
    w = _windows_of(spark, sf_dir, A.gappy())
    return w.select("subject", "k", F.posexplode(cleaning.missing_filled(F.col("v"))).alias("i", "x")).withColumn("x", R(F.col("x"), 4))


@query(f"""WITH {_rows_sql(_GAPPY_SQL)}, {_MAD_SQL}, fl AS (SELECT *, bad OR v IS NULL AS hole FROM mad), {_cubic_sql('NOT hole', 'fl')}
        SELECT subject, k, CAST(i AS INTEGER) AS i, {r(f'CASE WHEN hole THEN {_FIT} ELSE v END', 4)} AS x FROM fl JOIN x0 USING (subject, k)""")
def clean_windows(spark, sf_dir):
    w = cleaning.clean_windows(_windows_of(spark, sf_dir, A.gappy()), ["v"])
    return w.select("subject", "k", F.posexplode("v").alias("i", "x")).withColumn("x", R(F.col("x"), 4))


# --- features ------------------------------------------------------------------------------------

EM = "em AS (SELECT vec_id, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
_TIME_SQL = f"""WITH {EM}, c AS (SELECT vec_id, i, x, CASE WHEN sign(x) <> sign(lag(x) OVER (PARTITION BY vec_id ORDER BY i)) THEN 1 ELSE 0 END AS cr, avg(x) OVER (PARTITION BY vec_id) AS mu FROM em)
        SELECT vec_id, {r('avg(x)')} AS mean, {r('stddev_pop(x)')} AS std, {r('avg(pow(x - mu, 3)) / pow(avg(pow(x - mu, 2)), 1.5)')} AS skew, {r('avg(pow(x - mu, 4)) / pow(avg(pow(x - mu, 2)), 2) - 3')} AS kurt,
          {r('median(x)')} AS median, {r('quantile_cont(x, 0.75) - quantile_cont(x, 0.25)')} AS iqr, {r('sqrt(avg(x * x))')} AS rms, {r('max(x) - min(x)')} AS peak_to_peak, {r('sum(cr) / 64.0')} AS zero_crossing_rate FROM c GROUP BY 1"""


def _rounded(df: DataFrame, keys: list[str], names: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keys, *(R(F.col(n), digits).alias(n) for n in names))


@query(_TIME_SQL)
def feat_time(spark, sf_dir):
    rows = time_domain.samples(A.vectors(spark, sf_dir), ["vec_id"], "x")
    return _rounded(time_domain.time_features(rows, ["vec_id"]), ["vec_id"], time_domain.NAMES)


@query(f"""WITH {EM}, n AS (SELECT *, lag(x) OVER w AS a, lead(x) OVER w AS b FROM em WINDOW w AS (PARTITION BY vec_id ORDER BY i)) SELECT vec_id, CAST(i AS INTEGER) AS i, {r('x')} AS x FROM n WHERE x > a AND x > b""")
def local_maxima(spark, sf_dir):
    rows = time_domain.samples(A.vectors(spark, sf_dir), ["vec_id"], "x")
    return time_domain.local_maxima(rows, ["vec_id"]).select("vec_id", "i", R(F.col("x")).alias("x"))


@query(f"""WITH RECURSIVE {EM}, n AS (SELECT *, lag(x) OVER w AS a, lead(x) OVER w AS b FROM em WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
        pk AS (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i DESC) AS nth FROM n WHERE x > a AND x > b),
        g AS (SELECT vec_id, CAST(0 AS BIGINT) AS nth, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT vec_id FROM em)
          UNION ALL SELECT g.vec_id, pk.nth, CASE WHEN len(list_filter(g.kept, lambda t: abs(t - pk.i) < 4)) > 0 THEN g.kept ELSE list_append(g.kept, pk.i) END FROM g JOIN pk ON pk.vec_id = g.vec_id AND pk.nth = g.nth + 1)
        SELECT vec_id, {r('max(len(kept)) / (64 / 16.0 / 60)')} AS cadence FROM g GROUP BY 1""")
def feat_cadence(spark, sf_dir):
    return A.vectors(spark, sf_dir).select("vec_id", R(time_domain.cadence(F.col("x"), rate=16, min_seconds=0.25)).alias("cadence"))


# One segment of 64 samples at 64 Hz: bin j is j Hz, and the window's squares sum to 24.
_PSD = f"""{EM}, ce AS (SELECT vec_id, i, (x - avg(x) OVER (PARTITION BY vec_id)) * (0.5 - 0.5 * cos(2 * pi() * i / 64)) AS w FROM em),
        fb AS (SELECT vec_id, j, sum(w * cos(2 * pi() * ((i * j) % 64) / 64)) AS re, sum(w * sin(2 * pi() * ((i * j) % 64) / 64)) AS im FROM ce, range(33) b(j) GROUP BY 1, 2),
        psd AS (SELECT vec_id, j, (re * re + im * im) / (64 * 24.0) * CASE WHEN j IN (0, 32) THEN 1 ELSE 2 END AS p FROM fb)"""


@query(f"WITH {_PSD} SELECT vec_id, CAST(j AS INTEGER) AS j, {r('p', 9)} AS p FROM psd")
def welch_psd(spark, sf_dir):
    v = A.vectors(spark, sf_dir).select("vec_id", F.posexplode(spectral.density(F.col("x"))).alias("j", "p"))
    return v.withColumn("p", R(F.col("p"), 9))


_BANDS = """ba AS (SELECT vec_id, sum((p + n) / 2) AS total, sum((p + n) / 2) FILTER (j >= 1 AND j + 1 <= 3) AS loco, sum((p + n) / 2) FILTER (j >= 3 AND j + 1 <= 8) AS frz
          FROM (SELECT vec_id, j, p, lead(p) OVER (PARTITION BY vec_id ORDER BY j) AS n FROM psd) WHERE n IS NOT NULL GROUP BY 1)"""


@query(f"""WITH {_PSD}, {_BANDS}, pe AS (SELECT vec_id, CAST(arg_max(j, p) AS DOUBLE) AS peak, sum(j * p) / sum(p) AS centroid FROM psd GROUP BY 1)
        SELECT vec_id, {r('peak')} AS psd_peak_freq, {r('total')} AS psd_total_energy, {r('centroid')} AS spectral_centroid, {r('loco')} AS power_loco_band, {r('frz')} AS power_freeze_band,
          {r('frz / loco')} AS freezing_index, {r('loco / total')} AS locomotion_band_index FROM ba JOIN pe USING (vec_id)""")
def feat_freq(spark, sf_dir):
    v = A.vectors(spark, sf_dir).select("vec_id", spectral.frequency_features(F.col("x")).alias("f")).select("vec_id", "f.*")
    return _rounded(v, ["vec_id"], spectral.NAMES)


@query(f"""WITH {EM}, n AS (SELECT vec_id, x, lead(x) OVER (PARTITION BY vec_id ORDER BY i) AS y FROM em) SELECT vec_id, {r('sum((x + y) / 2 / 64.0)')} AS area FROM n GROUP BY 1""")
def trapz(spark, sf_dir):
    """The trapezoid integral of each window at 64 Hz, in the row."""
    pairs = F.zip_with(F.slice("x", 1, F.size("x") - 1), F.slice("x", 2, F.size("x") - 1), lambda a, b: (a + b) / 2 / 64.0)
    return A.vectors(spark, sf_dir).select("vec_id", R(F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)).alias("area"))


_LOW_SQL = "[" + ", ".join(repr(float(x)) for x in wavelet.LOW) + "]"
_HIGH_SQL = "[" + ", ".join(repr(float(x)) for x in wavelet.HIGH) + "]"


def _dwt_level(src: str, n: int, out: str) -> str:
    """Approximation and detail of a level, as a join of places with the mirrored samples under each tap."""
    place = f"(2 * k + 1 - j)"
    mirrored = f"CASE WHEN {place} < 0 THEN -{place} - 1 WHEN {place} >= {n} THEN {2 * n} - 1 - {place} ELSE {place} END"
    m = (n + 7) // 2
    return f"""{out}_t AS (SELECT k, j, {mirrored} AS i, list_extract({_LOW_SQL}::DOUBLE[], CAST(j + 1 AS INT)) AS lo, list_extract({_HIGH_SQL}::DOUBLE[], CAST(j + 1 AS INT)) AS hi FROM range({m}) a(k), range(8) b(j)),
        {out} AS (SELECT vec_id, k AS i, sum(x * lo) AS x, sum(x * hi) AS d FROM {src} JOIN {out}_t USING (i) GROUP BY 1, 2)"""


_DWT = f"""{EM}, {_dwt_level('em', 64, 'l1')}, {_dwt_level('l1', 35, 'l2')}, {_dwt_level('l2', 21, 'l3')},
        dw AS (SELECT vec_id, 0 AS band, i, x AS c FROM l3 UNION ALL SELECT vec_id, 1, i, d FROM l3 UNION ALL SELECT vec_id, 2, i, d FROM l2 UNION ALL SELECT vec_id, 3, i, d FROM l1)"""


@query(f"WITH {_DWT} SELECT vec_id, CAST(band AS INTEGER) AS band, CAST(i AS INTEGER) AS i, {r('c')} AS c FROM dw")
def dwt_coeffs(spark, sf_dir):
    v = A.vectors(spark, sf_dir).select("vec_id", F.posexplode(wavelet.coefficients(F.col("x"))).alias("band", "cs"))
    return v.select("vec_id", "band", F.posexplode("cs").alias("i", "c")).withColumn("c", R(F.col("c")))


@query(f"""WITH {_DWT}, en AS (SELECT vec_id, band, sum(c * c) AS e, var_pop(c) AS v FROM dw GROUP BY 1, 2), tt AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM en)
        SELECT vec_id, {', '.join(f"{r(f'max(e) FILTER (band = {b})')} AS wavelet_energy_{b}" for b in range(4))}, {r('-sum(p * ln(p))')} AS wavelet_entropy, {', '.join(f"{r(f'max(v) FILTER (band = {b})')} AS wavelet_var_{b}" for b in range(4))} FROM tt GROUP BY 1""")
def feat_wavelet(spark, sf_dir):
    v = A.vectors(spark, sf_dir).select("vec_id", wavelet.wavelet_features(F.col("x")).alias("f")).select("vec_id", "f.*")
    return _rounded(v, ["vec_id"], wavelet.NAMES)


_TEMPLATES = f"""{EM}, sd AS (SELECT vec_id, 0.2 * stddev_pop(x) AS r FROM em GROUP BY 1), tp AS (SELECT vec_id, i, x AS a, lead(x, 1) OVER w AS b, lead(x, 2) OVER w AS c FROM em WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
        pa AS (SELECT p.vec_id, p.i, count(*) FILTER (abs(p.a - q.a) <= r AND abs(p.b - q.b) <= r) AS m2, count(*) FILTER (abs(p.a - q.a) <= r AND abs(p.b - q.b) <= r AND abs(p.c - q.c) <= r) AS m3 FROM tp p JOIN tp q USING (vec_id) JOIN sd USING (vec_id) GROUP BY 1, 2)"""


def _nonlinear(spark, sf_dir, name):
    f = nonlinear.nonlinear_features(F.col("x"), names=[name])
    return _rounded(A.vectors(spark, sf_dir).select("vec_id", f.alias("f")).select("vec_id", "f.*"), ["vec_id"], [name])


@query(f"""WITH {_TEMPLATES}, s AS (SELECT vec_id, (sum(m2) - 63) / (63.0 * 62) AS p2, (sum(m3) - 62) / (62.0 * 61) AS p3 FROM pa GROUP BY 1)
        SELECT vec_id, {r('CASE WHEN p2 > 0 AND p3 > 0 THEN -ln(p3 / p2) END')} AS sample_entropy FROM s""")
def sample_entropy(spark, sf_dir):
    return _nonlinear(spark, sf_dir, "sample_entropy")


@query(f"WITH {_TEMPLATES} SELECT vec_id, {r('avg(CASE WHEN i < 63 THEN ln(m2 / 63.0) END) - avg(CASE WHEN i < 62 THEN ln(m3 / 62.0) END)')} AS approx_entropy FROM pa GROUP BY 1")
def approx_entropy(spark, sf_dir):
    return _nonlinear(spark, sf_dir, "approx_entropy")


@query(f"""WITH {EM}, hg AS (SELECT vec_id, k, i % k AS m, abs(x - lag(x, CAST(k AS INT)) OVER (PARTITION BY vec_id, k ORDER BY i)) AS d FROM em, range(1, 11) g(k)),
        hl AS (SELECT vec_id, k, m, sum(d) * 63 / ((count(*) - 1) * k) AS lm FROM hg GROUP BY 1, 2, 3), hk AS (SELECT vec_id, k, ln(sum(lm) / k) AS y, ln(k) AS z FROM hl GROUP BY 1, 2)
        SELECT vec_id, {r('-regr_slope(y, z)')} AS higuchi_fd FROM hk GROUP BY 1""")
def higuchi_fd(spark, sf_dir):
    return _nonlinear(spark, sf_dir, "higuchi_fd")


@query(f"WITH li AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_tax FROM lineitem) SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, {r('sqrt(l_quantity * l_quantity + l_discount * l_discount + l_tax * l_tax)')} AS magnitude FROM li")
def group_magnitude(spark, sf_dir):
    m = extract.magnitude([F.array("l_quantity"), F.array("l_discount"), F.array("l_tax")])[0]
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", R(m).alias("magnitude"))


_TABLE_FEATURES = ["ch0_mean", "ch0_std", "ch0_median", "ch0_iqr", "ch0_psd_total_energy", "ch1_rms", "acc_mag_mean", "acc_mag_peak_to_peak", "cadence"]


@query(f"""WITH {LI}, n AS (SELECT subject, trial, count(*) AS n FROM li GROUP BY 1, 2), k AS (SELECT subject, trial, unnest(range(0, n // 64)) AS k FROM n),
        w AS (SELECT k.subject, k.trial, k.k, li.pos - k.k * 64 AS i, l_quantity AS q, l_extendedprice / 1000.0 AS e, sqrt(l_quantity * l_quantity + (l_extendedprice / 1000.0) * (l_extendedprice / 1000.0)) AS m
          FROM k JOIN li ON li.subject = k.subject AND li.trial = k.trial AND li.pos >= k.k * 64 AND li.pos < k.k * 64 + 64)
        SELECT subject, trial, k, {r('avg(q)')} AS ch0_mean, {r('stddev_pop(q)')} AS ch0_std, {r('median(q)')} AS ch0_median, {r('quantile_cont(q, 0.75) - quantile_cont(q, 0.25)')} AS ch0_iqr, {r('sqrt(avg(e * e))')} AS ch1_rms,
          {r('avg(m)')} AS acc_mag_mean, {r('max(m) - min(m)')} AS acc_mag_peak_to_peak FROM w GROUP BY 1, 2, 3""")
def feature_table(spark, sf_dir):
    """Time features of tumbling windows with two channels and their magnitude (all families: ``feature_table_all``)."""
    w = windows.sliding(A.items(spark, sf_dir).withColumn("price", F.col("l_extendedprice") / 1000.0), A.ITEM_WHOLE, ["subject", "trial"], ["l_quantity", "price"])
    t = extract.feature_table(w, ["subject", "trial", "k"], ["l_quantity", "price"], {"acc": [0, 1]}, families=["time"])
    return _rounded(t, ["subject", "trial", "k"], [n for n in _TABLE_FEATURES if n not in ("ch0_psd_total_energy", "cadence")])


@query()
def feature_table_all(spark, sf_dir):
    """All 28 features of each signal: two channels are made of each vector's window."""
    v = A.vectors(spark, sf_dir)
    return extract.feature_table(v.select("vec_id", F.col("x").alias("a"), F.reverse("x").alias("b")), ["vec_id"], ["a", "b"], {"acc": [0, 1]})


# --- model inputs ---------------------------------------------------------------------------------

_N = 4
_VC = [f"e{i}" for i in range(_N)]
_LEFT = _VC[: _N // 2]
VC_SQL = "vc AS (SELECT vec_id, CAST(vec_id % 7 AS INT) AS subject, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(_N)) + " FROM embeddings)"


@query(f"""WITH n AS (SELECT p_partkey AS i, p_retailprice AS x, p_size AS y FROM part), p AS (SELECT sign(a.x - b.x) * sign(a.y - b.y) AS s, a.x <> b.x AS dx, a.y <> b.y AS dy FROM n a JOIN n b ON a.i < b.i)
        SELECT 'p_retailprice' AS a, 'p_size' AS b, {r('sum(s) / sqrt(CAST(count(*) FILTER (dx) AS DOUBLE) * count(*) FILTER (dy))')} AS tau FROM p""")
def kendall_tau(spark, sf_dir):
    return _rounded(kendall.kendall(table(spark, sf_dir, "part"), "p_retailprice", "p_size"), ["a", "b"], ["tau"])


def feature_rows(spark, sf_dir) -> DataFrame:
    """A small feature table: four features, seven subjects, a binary label."""
    v = A.vectors(spark, sf_dir)
    return v.select("vec_id", (F.col("vec_id") % 7).cast("int").alias("subject"), "y", *(F.col("x")[i].alias(f"e{i}") for i in range(_N)))


@query(f"WITH {VC_SQL} SELECT vec_id, subject, {', '.join(r(f'({c} - avg({c}) OVER w) / (stddev_pop({c}) OVER w + 1e-8)') + f' AS {c}' for c in _VC)} FROM vc WHERE subject <> 3 WINDOW w AS (PARTITION BY subject)")
def normalize_train(spark, sf_dir):
    train = feature_rows(spark, sf_dir).filter("subject <> 3")
    return _rounded(selection.normalise_train(train, _VC), ["vec_id", "subject"], _VC)


@query(f"""WITH {VC_SQL}, o AS (SELECT subject, count(*) AS n, {', '.join(f'avg({c}) AS {c}_m, stddev_pop({c}) + 1e-8 AS {c}_s' for c in _VC)} FROM vc WHERE subject <> 3 GROUP BY 1),
        t AS (SELECT {', '.join(f'sum({c}_m * n) / sum(n) AS {c}_m, sum({c}_s * n) / sum(n) AS {c}_s' for c in _VC)} FROM o)
        SELECT vec_id, {', '.join(r(f'({c} - {c}_m) / {c}_s') + f' AS {c}' for c in _VC)} FROM vc, t WHERE subject = 3""")
def normalize_test(spark, sf_dir):
    rows = feature_rows(spark, sf_dir)
    return _rounded(selection.normalise_test(rows.filter("subject = 3"), rows.filter("subject <> 3"), _VC), ["vec_id"], _VC)


def _anova_sql(c: str) -> str:
    return f"""(SELECT '{c}' AS "column", (sum(n * pow(m - mu, 2)) / (count(*) - 1)) / (sum(ss) / (sum(n) - count(*))) AS f FROM (SELECT y, count(*) AS n, avg({c}) AS m, var_pop({c}) * count(*) AS ss FROM vc GROUP BY 1), (SELECT avg({c}) AS mu FROM vc))"""


_ANOVA = f"an AS ({' UNION ALL '.join(_anova_sql(c) for c in _VC)})"


@query(f'WITH {VC_SQL}, {_ANOVA} SELECT "column", {r("f")} AS f FROM an')
def anova_f(spark, sf_dir):
    return _rounded(selection.anova(feature_rows(spark, sf_dir), _VC, "y"), ["column"], ["f"])


@query(f"""WITH {VC_SQL}, {_ANOVA}, rk AS (SELECT CASE WHEN "column" IN {tuple(_LEFT)} THEN 'left' ELSE 'right' END AS sensor, "column", f, row_number() OVER (PARTITION BY CASE WHEN "column" IN {tuple(_LEFT)} THEN 'left' ELSE 'right' END ORDER BY f DESC, "column") AS rank FROM an)
        SELECT sensor, "column", {r("f")} AS f, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 1""")
def select_k_per_group(spark, sf_dir):
    f = selection.anova(feature_rows(spark, sf_dir), _VC, "y")
    chosen = selection.select_per_group(f, _side(), 1)
    return chosen.select("sensor", "column", R(F.col("f")).alias("f"), "rank")


@query(f"""WITH {VC_SQL}, b AS (SELECT y, (e0 > (SELECT quantile_cont(e0, 0.125) FROM vc))::INT + {' + '.join(f'(e0 > (SELECT quantile_cont(e0, {k / 8}) FROM vc))::INT' for k in range(2, 8))} AS b FROM vc),
        j AS (SELECT b, y, count(*) AS n FROM b GROUP BY 1, 2), s AS (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER (PARTITION BY y) AS ny FROM j)
        SELECT {r('sum(CAST(n AS DOUBLE) / t * ln(CAST(n AS DOUBLE) * t / (CAST(nb AS DOUBLE) * ny)))')} AS mi FROM s""")
def mutual_info_binned(spark, sf_dir):
    return _rounded(selection.binned_information(feature_rows(spark, sf_dir), "e0", "y"), [], ["mi"])


@query(f"""WITH {VC_SQL}, n AS (SELECT y, count(*) AS own FROM vc GROUP BY 1),
        ds AS (SELECT a.vec_id, a.y, abs(a.e0 - b.e0) AS d, a.y = b.y AND a.vec_id <> b.vec_id AS mine FROM vc a JOIN vc b ON true),
        rd AS (SELECT vec_id, d AS r FROM (SELECT vec_id, d, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS nth FROM ds WHERE mine) WHERE nth = 3),
        ms AS (SELECT vec_id, y, count(*) FILTER (d < r OR d = 0) AS m FROM ds JOIN rd USING (vec_id) GROUP BY 1, 2),
        ps AS (SELECT avg(list_sum(list_transform(range(1, m), lambda j: 1.0 / j))) AS pm, avg(list_sum(list_transform(range(1, own), lambda j: 1.0 / j))) AS po, list_sum(list_transform(range(1, CAST(count(*) AS BIGINT)), lambda j: 1.0 / j)) AS pn FROM (SELECT CAST(m AS BIGINT) AS m, own FROM ms JOIN n USING (y)))
        SELECT {r('greatest(0, pn + 1.5 - po - pm)')} AS mi FROM ps""")
def mutual_info(spark, sf_dir):
    """The nearest-neighbour estimate, with three neighbours."""
    return _rounded(information.neighbour_information(feature_rows(spark, sf_dir), "e0", "y"), [], ["mi"])


_HOLES = "ho AS (SELECT vec_id, subject, CASE WHEN vec_id % 19 <> 0 THEN e0 END AS e0, CASE WHEN vec_id % 23 <> 0 THEN e1 END AS e1, e2 FROM vc)"


def _holes(spark, sf_dir):
    v = F.col("vec_id")
    return feature_rows(spark, sf_dir).select("vec_id", "subject", F.when(v % 19 != 0, F.col("e0")).alias("e0"), F.when(v % 23 != 0, F.col("e1")).alias("e1"), "e2")


_BOTH = "(CASE WHEN a.e0 IS NOT NULL AND b.e0 IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN a.e1 IS NOT NULL AND b.e1 IS NOT NULL THEN 1 ELSE 0 END + 1)"
_DIST = f"sqrt((coalesce(pow(a.e0 - b.e0, 2), 0) + coalesce(pow(a.e1 - b.e1, 2), 0) + pow(a.e2 - b.e2, 2)) * 3 / {_BOTH})"


@query(f"""WITH {VC_SQL}, {_HOLES}, pr AS (SELECT a.vec_id, b.vec_id AS other, b.e0, b.e1, a.e0 IS NULL AS h0, a.e1 IS NULL AS h1, {_DIST} AS d FROM ho a JOIN ho b ON a.vec_id <> b.vec_id WHERE a.e0 IS NULL OR a.e1 IS NULL),
        k0 AS (SELECT vec_id, avg(e0) AS v FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, other) AS nth FROM pr WHERE h0 AND e0 IS NOT NULL) WHERE nth <= 5 GROUP BY 1),
        k1 AS (SELECT vec_id, avg(e1) AS v FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, other) AS nth FROM pr WHERE h1 AND e1 IS NOT NULL) WHERE nth <= 5 GROUP BY 1)
        SELECT ho.vec_id, {r('coalesce(ho.e0, k0.v)')} AS e0, {r('coalesce(ho.e1, k1.v)')} AS e1 FROM ho LEFT JOIN k0 USING (vec_id) LEFT JOIN k1 USING (vec_id)""")
def knn_impute(spark, sf_dir):
    return _rounded(selection.knn_impute(_holes(spark, sf_dir), "vec_id", ["e0", "e1", "e2"]), ["vec_id"], ["e0", "e1"])


@query(f"WITH {VC_SQL}, {_HOLES} SELECT vec_id, {r('coalesce(e0, (SELECT median(e0) FROM ho))')} AS e0, {r('coalesce(e1, (SELECT median(e1) FROM ho))')} AS e1 FROM ho")
def impute_median(spark, sf_dir):
    h = _holes(spark, sf_dir)
    return _rounded(selection.fill_with(h, selection.medians(h, ["e0", "e1"])), ["vec_id"], ["e0", "e1"])


@query("WITH n AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1) SELECT toxic, (SELECT max(n) FROM n) AS n FROM n")
def oversample_counts(spark, sf_dir):
    return selection.oversample(table(spark, sf_dir, "labels"), "toxic", "doc_id").groupBy("toxic").agg(F.count("*").alias("n"))


@query(f"WITH n AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1) SELECT toxic, n, {r('sum(n) OVER () / (count(*) OVER () * n)')} AS weight FROM n")
def class_weights(spark, sf_dir):
    return _rounded(selection.class_weights(table(spark, sf_dir, "labels"), "toxic"), ["toxic", "n"], ["weight"])


@query("""WITH RECURSIVE n AS (SELECT c_nationkey, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, c_nationkey) AS nth FROM customer GROUP BY 1),
          g AS (SELECT CAST(0 AS BIGINT) AS nth, NULL::INTEGER AS c_nationkey, CAST(0 AS BIGINT) AS n, CAST(0 AS INTEGER) AS fold, [0, 0, 0]::BIGINT[] AS loads
            UNION ALL SELECT n.nth, n.c_nationkey, n.n, CAST(list_position(g.loads, list_min(g.loads)) - 1 AS INTEGER), list_transform(g.loads, lambda x, i: CASE WHEN i = list_position(g.loads, list_min(g.loads)) THEN x + n.n ELSE x END) FROM g JOIN n ON n.nth = g.nth + 1)
          SELECT c_nationkey, n, fold FROM g WHERE nth > 0""")
def group_kfold(spark, sf_dir):
    return selection.group_folds(table(spark, sf_dir, "customer"), "c_nationkey", 3)


@query("SELECT toxic, CAST(f AS INTEGER) AS fold, n // 5 + CASE WHEN f < n % 5 THEN 1 ELSE 0 END AS n FROM (SELECT toxic, count(*) AS n FROM labels GROUP BY 1), range(5) r(f) WHERE n // 5 + CASE WHEN f < n % 5 THEN 1 ELSE 0 END > 0")
def stratified_kfold(spark, sf_dir):
    folds = selection.stratified_folds(table(spark, sf_dir, "labels"), "toxic", "doc_id", 5)
    return folds.groupBy("toxic", "fold").agg(F.count("*").alias("n"))


# --- evaluation ------------------------------------------------------------------------------------

_F1 = "2 * precision * recall / (precision + recall + 1e-9)"


@query(f"WITH {CURVE_SQL}, f AS (SELECT threshold, round({_F1}, 12) AS f1 FROM pr) SELECT CAST(greatest(0.05, least(0.95, min(threshold))) AS DOUBLE) AS threshold FROM f WHERE f1 = (SELECT max(f1) FROM f)")
def pr_threshold(spark, sf_dir):
    return evaluation.best_threshold(evaluation.curve(scores(spark, sf_dir), F.col("y"), F.col("score")))


CM_SQL = f"""{SCORE_SQL}, pd AS (SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS p FROM sc),
        cm AS (SELECT fold, CAST(sum((y = 0 AND p = 0)::INT) AS BIGINT) AS tn, CAST(sum((y = 0 AND p = 1)::INT) AS BIGINT) AS fp, CAST(sum((y = 1 AND p = 0)::INT) AS BIGINT) AS fn, CAST(sum((y = 1 AND p = 1)::INT) AS BIGINT) AS tp FROM pd GROUP BY 1)"""
_METRIC_SQL = {
    "accuracy": "CAST(tp + tn AS DOUBLE) / (tn + fp + fn + tp)",
    "balanced_acc": "(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) + coalesce(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 0)) / 2",
    "precision": "coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0)",
    "recall": "coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0)",
    "f1": "coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)",
}
MET_SQL = f"{CM_SQL}, me AS (SELECT *, {', '.join(f'{x} AS {n}' for n, x in _METRIC_SQL.items())} FROM cm)"


def _per_fold(spark, sf_dir):
    p = scores(spark, sf_dir).withColumn("p", (F.col("score") >= 0.5).cast("int"))
    return evaluation.with_metrics(evaluation.confusion(p, ["fold"], F.col("y"), F.col("p")))


@query(f"WITH {MET_SQL} SELECT fold, tn, fp, fn, tp, {', '.join(r(n) + f' AS {n}' for n in _METRIC_SQL)} FROM me")
def confusion_metrics(spark, sf_dir):
    return _rounded(_per_fold(spark, sf_dir), ["fold", "tn", "fp", "fn", "tp"], evaluation.METRICS)


_POOLED_STD = ", ".join(f"stddev_samp({m}) AS {m}_std" for m in _METRIC_SQL)
_POOLED_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("tn", "fp", "fn", "tp"))


@query(f"WITH {MET_SQL}, po AS (SELECT {_POOLED_SUMS}, {_POOLED_STD} FROM me) SELECT tn, fp, fn, tp, {', '.join(r(x) + f' AS {n}' for n, x in _METRIC_SQL.items())}, {', '.join(r(f'{n}_std') + f' AS {n}_std' for n in _METRIC_SQL)} FROM po")
def pooled_metrics(spark, sf_dir):
    p = evaluation.pooled(_per_fold(spark, sf_dir))
    return _rounded(p, ["tn", "fp", "fn", "tp"], [*evaluation.METRICS, *(f"{m}_std" for m in evaluation.METRICS)])


@query(f"WITH {MET_SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS metric, {r(f'avg({n})')} AS mean, {r(f'stddev_samp({n})')} AS std, {r(f'min({n})')} AS min, {r(f'max({n})')} AS max FROM me" for n in _METRIC_SQL))
def metric_stats(spark, sf_dir):
    return _rounded(evaluation.metric_statistics(_per_fold(spark, sf_dir)), ["metric"], ["mean", "std", "min", "max"])


@query(f"""WITH {CM_SQL}, t AS (SELECT {_POOLED_SUMS} FROM cm), c AS (SELECT 0 AS actual, 0 AS predicted, tn AS n FROM t UNION ALL SELECT 0, 1, fp FROM t UNION ALL SELECT 1, 0, fn FROM t UNION ALL SELECT 1, 1, tp FROM t)
        SELECT actual, predicted, n, {r('CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY actual)')} AS share FROM c""")
def cm_normalized(spark, sf_dir):
    sums = _per_fold(spark, sf_dir).agg(*(F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")))
    return _rounded(evaluation.normalised(sums), ["actual", "predicted", "n"], ["share"])


@query(f"SELECT p_brand, count(*) AS n, {r('count(*) / 60.0')} AS share FROM part WHERE p_size > 25 GROUP BY 1")
def selection_frequency(spark, sf_dir):
    return _rounded(evaluation.selection_frequency(table(spark, sf_dir, "part").filter("p_size > 25"), "p_brand", 60), ["p_brand", "n"], ["share"])


# --- models (rows only: their values depend on the library's solvers) ----------------------------------------


def _model_rows(spark, sf_dir):
    rows = models.assembled(feature_rows(spark, sf_dir), _VC, "y").withColumn("fold", (F.col("subject") % 3).cast("int"))
    return rows.filter("subject <> 3"), rows.filter("subject = 3")


def _fitted(estimator, spark, sf_dir, fold_rows=None):
    train, test = fold_rows or _model_rows(spark, sf_dir)
    return models.scored(estimator.fit(train), test).select("vec_id", "y", R(F.col("score"), 9).alias("score"))


@query()
def model_logistic(spark, sf_dir):
    train, test = _model_rows(spark, sf_dir)
    return _fitted(models.logistic(train.count()), spark, sf_dir, (train, test))


@query()
def model_forest(spark, sf_dir):
    return _fitted(models.forest(10, 4), spark, sf_dir)


@query()
def model_boosted(spark, sf_dir):
    return _fitted(models.boosted(4, 3), spark, sf_dir)


@query()
def model_perceptron(spark, sf_dir):
    return _fitted(models.perceptron(_N, (8, 4)), spark, sf_dir)


@query()
def model_adaboost(spark, sf_dir):
    train, test = _model_rows(spark, sf_dir)
    return models.Boosting(4).fit(train).scores(test).select("vec_id", "y", R(F.col("score"), 9).alias("score"))


@query()
def model_kernel_machine(spark, sf_dir):
    rows = models.fourier(models.assembled(feature_rows(spark, sf_dir), _VC, "y").drop("features"), _VC, 16)
    return _fitted(models.Calibrated(models.kernel_machine(), 3), spark, sf_dir, (rows.filter("subject <> 3"), rows.filter("subject = 3")))


@query()
def model_search(spark, sf_dir):
    """The best of a small randomised search over subject folds, on the held-out subject."""
    train, test = _model_rows(spark, sf_dir)
    lr = models.logistic(train.count())
    best = models.search(lr, train, {lr.regParam: [0.01, 0.1, 1.0], lr.elasticNetParam: [0.0, 0.5]}, "fold", 3, n=2)
    return models.scored(best.bestModel, test).select("vec_id", "y", R(F.col("score"), 9).alias("score"))


def _logistic(seed: int, c: float = 1.0):
    return models.logistic(500, c, iterations=10)


#: Inverse penalties that are searched.
_PENALTIES = [0.01, 1, 100]


def _side():
    return F.when(F.col("column").isin(*_LEFT), "left").otherwise("right")


@query()
def loso_training(spark, sf_dir):
    """Every subject left out in turn, pooled over the folds; the penalty and the columns of each side are searched inside each.

    With the values that win in most folds.
    """
    classifiers = {"logistic": training.Classifier(_logistic, {"c": _PENALTIES})}
    report = training.leave_one_subject_out(feature_rows(spark, sf_dir), _VC, "y", classifiers, _side(), [1, 2])
    won = report.settings(spark).groupBy("classifier").pivot("parameter", ["k", "c"]).agg(F.first("value"))
    return evaluation.pooled(report.results, ["classifier"]).join(won.select("classifier", F.col("k").alias("best_k"), F.col("c").alias("best_c")), "classifier")


@query()
def choose_k(spark, sf_dir):
    """Mean scores of each number of columns over stratified folds, with synthetic rows in the training parts."""
    selector = tuning.SensorKBest(_VC, "y", _side())
    return tuning.choose_k(feature_rows(spark, sf_dir), "vec_id", selector, lambda seed: models.forest(10, 5, seed), [1, 2], 3)[1]


@query()
def rf_importance(spark, sf_dir):
    return models.importances(feature_rows(spark, sf_dir), _VC, 5, label="y")


_HARD = f"""WITH {VC_SQL}, ad AS (SELECT vc.* EXCLUDE (y), CASE WHEN label >= 7 THEN 1 ELSE 0 END AS y FROM vc JOIN embeddings USING (vec_id)),
        pr AS (SELECT a.vec_id, b.vec_id AS other, b.y, {' + '.join(f'(a.{c} - b.{c}) * (a.{c} - b.{c})' for c in _VC)} AS d FROM ad a JOIN ad b ON a.vec_id <> b.vec_id WHERE a.y = 1),
        hd AS (SELECT vec_id, avg(1.0 - y) AS r FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, other) AS nth FROM pr) WHERE nth <= 5 GROUP BY 1),
        pl AS (SELECT vec_id, CAST(round(r / (SELECT sum(r) FROM hd) * (SELECT count(*) FILTER (y = 0) - count(*) FILTER (y = 1) FROM ad)) AS INTEGER) AS times FROM hd),
        ow AS (SELECT vec_id, other, row_number() OVER (PARTITION BY vec_id ORDER BY d, other) - 1 AS nth FROM pr WHERE y = 1 QUALIFY nth < 5),
        mn AS (SELECT vec_id, unnest(range(1, times + 1)) AS t FROM pl),
        dr AS (SELECT *, CAST('0x' || md5('42:' || vec_id || ':' || t)[1:8] AS BIGINT) % 5 AS nth, CAST('0x' || md5('43:' || vec_id || ':' || t)[1:8] AS BIGINT) % 1000 / 1000.0 AS part FROM mn)"""


@query(f"{_HARD} SELECT dr.vec_id AS source, CAST(t AS INTEGER) AS t, {', '.join(r(f'a.{c} + (b.{c} - a.{c}) * part') + f' AS {c}' for c in _VC)}, 1 AS y FROM dr JOIN ow USING (vec_id, nth) JOIN ad a ON a.vec_id = dr.vec_id JOIN ad b ON b.vec_id = ow.other")
def adasyn_rows(spark, sf_dir):
    """All rows; a higher cut of the label makes the classes uneven."""
    cut = A.vectors(spark, sf_dir).select("vec_id", (F.col("label") >= 7).cast("int").alias("y"))
    rows = feature_rows(spark, sf_dir).drop("y").join(cut, "vec_id")
    return _rounded(models.adasyn(rows, "vec_id", _VC, "y"), ["source", "t", "y"], _VC)


@query()
def anova_p_values(spark, sf_dir):
    """F and its p-value, of one row per feature, over the ten values of the label."""
    rows = feature_rows(spark, sf_dir).join(A.vectors(spark, sf_dir).select("vec_id", "label"), "vec_id")
    return models.with_p_values(selection.anova(rows, _VC, "label"), rows, "label")


# --- streaming extension -------------------------------------------------------------------------------------


def _drained(stream: DataFrame, mode: str) -> DataFrame:
    """A bounded stream's whole result, read back from the shared folder that it is written to."""
    spark = stream.sparkSession
    path = scratch_folder(spark, "stream")
    q = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/rows")
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def _event_stream(spark, sf_dir):
    # A stream reads folders, so the table's file is picked from its folder by name.
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query(f"""WITH {EV}, p AS (SELECT subject, x, row_number() OVER (PARTITION BY subject ORDER BY ts) - 1 AS pos FROM ev), n AS (SELECT subject, count(*) AS n FROM p GROUP BY 1), k AS (SELECT subject, unnest(range(0, (n - 16) // 8 + 1)) AS k FROM n WHERE n >= 16)
        SELECT p.subject AS user_id, k, {r('avg(x)')} AS mean FROM k JOIN p ON p.subject = k.subject AND pos >= k * 8 AND pos < k * 8 + 16 GROUP BY 1, 2""")
def stream_count_windows(spark, sf_dir):
    out = _drained(streams.count_windows(_event_stream(spark, sf_dir), "user_id", "ts", "value", HALF), "append")
    return out.withColumn("mean", R(F.col("mean")))


@query(f"""SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n, {r('sum(value)', 4)} AS total FROM events
        WHERE time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events) GROUP BY 1, 2""")
def stream_event_windows(spark, sf_dir):
    """Daily counts by type of the days that the watermark has closed."""
    w = streams.event_windows(_event_stream(spark, sf_dir), "ts", ["event_type"], "1 day", None, "1 hour", [F.count("*").alias("n"), F.sum("value").alias("total")])
    out = _drained(w, "append")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", R(F.col("total"), 4).alias("total"))

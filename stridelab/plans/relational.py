"""Registered queries: scans, projections, joins, set operations, summaries, ordering, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import evaluation, labels, selection, statistics, windows
from ..session import scratch_folder
from ..sources import readers, sinks
from . import adapters as A
from .adapters import HALF, WHOLE, table

R = C.rounded
RUNS = 3

# SQL fragments that the DuckDB statements share.
EV = """ev AS (SELECT user_id AS subject, ts, event_id, event_type, value AS x,
          CASE event_type WHEN 'error' THEN 2 WHEN 'signup' THEN 0 ELSE 1 END AS annotation FROM events)"""
EVF = EV + """, evf AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY ts, event_id) - 1 AS pos FROM ev WHERE annotation <> 0)"""
LAB = EVF + """, ons AS (SELECT *, CASE WHEN annotation = 2 THEN 1 ELSE 0 END AS binary_label,
          CASE WHEN annotation = 2 AND lag(annotation) OVER (PARTITION BY subject ORDER BY pos) <> 2 THEN 1 ELSE 0 END AS onset FROM evf),
        lab AS (SELECT o.*, CASE WHEN binary_label = 0 AND EXISTS (SELECT 1 FROM ons n WHERE n.subject = o.subject AND n.onset = 1 AND n.pos BETWEEN o.pos + 1 AND o.pos + 2)
          THEN 2 ELSE binary_label END AS multiclass_label FROM ons o)"""


def win(step: int, size: int = 16, name: str = "win", src: str = "lab") -> str:
    """Complete windows by joining rows to a generated list of windows."""
    return f"""{name}_n AS (SELECT subject, count(*) AS n FROM {src} GROUP BY subject),
        {name}_k AS (SELECT subject, unnest(range(0, greatest(0, (n - {size}) // {step} + 1))) AS k FROM {name}_n WHERE n >= {size}),
        {name}_r AS (SELECT w.k, l.* FROM {name}_k w JOIN {src} l ON l.subject = w.subject AND l.pos >= w.k * {step} AND l.pos < w.k * {step} + {size}),
        {name}_b AS (SELECT subject, k, arg_min(binary_label, -100 * c + binary_label) AS binary_label FROM (SELECT subject, k, binary_label, count(*) AS c FROM {name}_r GROUP BY ALL) GROUP BY ALL),
        {name}_m AS (SELECT subject, k, arg_min(multiclass_label, -100 * c + multiclass_label) AS multiclass_label FROM (SELECT subject, k, multiclass_label, count(*) AS c FROM {name}_r GROUP BY ALL) GROUP BY ALL),
        {name} AS (SELECT * FROM {name}_b JOIN {name}_m USING (subject, k))"""


def r(x: str, digits: int = 6) -> str:
    return f"(round(CAST({x} AS DOUBLE), {digits}) + 0)"


LI = """li AS (SELECT l_suppkey AS subject, l_returnflag AS trial, l_quantity, l_extendedprice, l_discount, l_tax, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS label,
          row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS pos FROM lineitem)"""

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its DuckDB statement if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- scans and sinks ------------------------------------------------------------------


@query("SELECT event_id, user_id, event_type, value FROM events")
def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_dataset(spark, f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'error'")
def sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sinks.save_dataset(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), scratch_folder(spark, "roundtrip"), "parquet")
    return readers.read_dataset(spark, path).filter("event_type = 'error'").drop("event_type")


# --- projections and filters --------------------------------------------------------------


@query("""SELECT page_id, split_part(url, '://', 1) AS scheme, split_part(split_part(url, '://', 2), '/', 1) AS host, split_part(split_part(url, '://', 2), '/', 2) AS section,
          TRY_CAST(nullif(regexp_extract(url, '/(\\d+)', 1), '') AS BIGINT) AS number FROM pages""")
def parse_path(spark, sf_dir):
    rest = F.split_part("url", F.lit("://"), F.lit(2))
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.split_part("url", F.lit("://"), F.lit(1)).alias("scheme"),
        F.split_part(rest, F.lit("/"), F.lit(1)).alias("host"),
        F.split_part(rest, F.lit("/"), F.lit(2)).alias("section"),
        F.regexp_extract("url", r"/(\d+)", 1).try_cast("long").alias("number"),
    )


@query(f"SELECT event_id, {r('value / 1000.0', 9)} AS value_k FROM events")
def project_arith(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", R(F.col("value") / 1000.0, 9).alias("value_k"))


@query("SELECT doc_id, toxic, CASE toxic WHEN 0 THEN 'No FoG' WHEN 1 THEN 'FoG' END AS name FROM labels")
def map_labels(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", "toxic", C.mapped(F.col("toxic"), labels.BINARY_NAMES).alias("name"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 1 OR (event_id % 3 <> 0 AND event_id % 5 = 1) THEN 1 ELSE 0 END AS fog_any FROM events")
def flag_or(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    gap = F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 5)  # null for every third row
    return e.select("event_id", C.any_flag(F.col("event_id") % 7, gap).alias("fog_any"))


@query(f"WITH {EV} SELECT event_id, annotation, CASE WHEN annotation = 2 THEN 1 ELSE 0 END AS binary_label FROM ev")
def label_binary(spark, sf_dir):
    return A.events(spark, sf_dir).select("event_id", "annotation", C.equals_flag(F.col("annotation"), 2).alias("binary_label"))


@query("SELECT c_custkey, printf('S%02d', c_nationkey) AS subject, printf('R%02d', c_custkey % 7) AS run, 'T' || (c_custkey % 7) AS trial FROM customer")
def format_ids(spark, sf_dir):
    part = F.col("c_custkey") % 7
    return table(spark, sf_dir, "customer").select("c_custkey", C.code("S", F.col("c_nationkey"), 2).alias("subject"), C.code("R", part, 2).alias("run"), C.code("T", part).alias("trial"))


@query(f"WITH {EVF} SELECT subject, event_id, pos FROM evf")
def filter_renumber(spark, sf_dir):
    return A.samples(spark, sf_dir).select("subject", "event_id", "pos")


@query(f"WITH {EV} SELECT event_id, x FROM ev WHERE subject = 7 AND annotation = 1")
def filter_subject(spark, sf_dir):
    return A.events(spark, sf_dir).filter((F.col("subject") == 7) & (F.col("annotation") == 1)).select("event_id", "x")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2)")
def semi_join_subjects(spark, sf_dir):
    kept = table(spark, sf_dir, "nation").filter("n_regionkey <> 2")
    c = table(spark, sf_dir, "customer")
    return c.join(kept, c.c_nationkey == kept.n_nationkey, "left_semi").select("c_custkey", "c_nationkey")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def anti_join_subject(spark, sf_dir):
    gone = table(spark, sf_dir, "nation").filter("n_regionkey = 1")
    c = table(spark, sf_dir, "customer")
    return c.join(gone, c.c_nationkey == gone.n_nationkey, "left_anti").select("c_custkey", "c_nationkey")


@query("SELECT event_id, CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 OR event_id % 19 = 0 THEN NULL ELSE value END AS x FROM events")
def clean_inf(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    odd = F.when(i % 11 == 0, F.lit(float("inf"))).when(i % 13 == 0, F.lit(float("-inf"))).when(i % 19 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return e.select("event_id", C.finite(odd).alias("x"))


@query("""WITH g AS (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS x FROM events)
          SELECT event_id, coalesce(x, (SELECT median(x) FROM g)) AS x FROM g""")
def fill_median(spark, sf_dir):
    g = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("x"))
    return selection.fill_with(g, selection.medians(g, ["x"]))


FEATURE_SQL = """f AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'ch' || (doc_id % 12) || '_mean' WHEN 1 THEN 'acc_ankle_mag_std' WHEN 2 THEN 'cadence' ELSE 'ch' || (doc_id % 12) || '_rms' END AS feature FROM documents)"""
SENSORS = {i: ("ankle", "thigh", "trunk")[i // 3] for i in range(9)}


def _features(spark, sf_dir):
    n = (F.col("doc_id") % 12).cast("string")
    k = F.col("doc_id") % 4
    name = F.when(k == 0, F.concat(F.lit("ch"), n, F.lit("_mean"))).when(k == 1, "acc_ankle_mag_std").when(k == 2, "cadence").otherwise(F.concat(F.lit("ch"), n, F.lit("_rms")))
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("feature"))


@query(f"""WITH {FEATURE_SQL} SELECT doc_id, feature, CASE WHEN feature LIKE 'ch%' THEN CASE CAST(regexp_extract(feature, '^ch(\\d+)_', 1) AS INT) // 3 WHEN 0 THEN 'ankle' WHEN 1 THEN 'thigh' WHEN 2 THEN 'trunk' ELSE 'Global' END
          WHEN feature LIKE 'acc_ankle%' THEN 'acc_ankle' ELSE 'Global' END AS sensor FROM f""")
def sensor_of_feature(spark, sf_dir):
    return _features(spark, sf_dir).withColumn("sensor", C.sensor_of(F.col("feature"), SENSORS, ["acc_ankle_"]))


@query("SELECT DISTINCT printf('S%02d', user_id) AS subject FROM events")
def distinct_subjects(spark, sf_dir):
    return table(spark, sf_dir, "events").select(C.code("S", F.col("user_id"), 2).alias("subject")).distinct().orderBy("subject")


# --- joins and set operations -------------------------------------------------------------------


@query(f"""WITH {LI}, l AS (SELECT subject, trial, pos, l_quantity AS left_x FROM li), r AS (SELECT subject, trial, pos, l_discount AS right_x FROM li WHERE pos > 0 OR subject % 5 > 0),
        n AS (SELECT subject, trial, count(*) AS n FROM l GROUP BY ALL INTERSECT SELECT subject, trial, count(*) AS n FROM r GROUP BY ALL)
        SELECT subject, trial, pos, left_x, right_x FROM l JOIN r USING (subject, trial, pos) SEMI JOIN n USING (subject, trial)""")
def zip_join(spark, sf_dir):
    """Two sets of channels of each whole recording; every fifth subject's second set lacks its first row, so it goes."""
    li = A.items(spark, sf_dir)
    left = li.select("subject", "trial", "pos", F.col("l_quantity").alias("left_x"))
    right = li.filter("pos > 0 OR subject % 5 > 0").select("subject", "trial", "pos", F.col("l_discount").alias("right_x"))
    return readers.zip_join(left, right, ["subject", "trial"])


@query(f"""WITH {LAB}, {win(8, name='tr')}, {win(16, name='te')}, folds AS (SELECT DISTINCT subject AS fold FROM te)
        SELECT fold, 'train' AS role, subject, k, binary_label FROM tr JOIN folds ON subject <> fold
        UNION ALL SELECT subject, 'test', subject, k, binary_label FROM te""")
def loso_assign(spark, sf_dir):
    lab = A.labelled(spark, sf_dir)
    train, test = (windows.sliding(lab, g, ["subject"], labels=["binary_label"]) for g in (HALF, WHOLE))
    return windows.leave_one_out(train, test).select("fold", "role", "subject", "k", "binary_label")


@query(f"WITH {FEATURE_SQL} SELECT doc_id, feature, coalesce(s.score, 0) AS score FROM f LEFT JOIN (SELECT 'ch' || p_partkey || '_mean' AS feature, p_size AS score FROM part) s USING (feature)")
def score_lookup(spark, sf_dir):
    scores = table(spark, sf_dir, "part").select(F.concat(F.lit("ch"), F.col("p_partkey").cast("string"), F.lit("_mean")).alias("feature"), F.col("p_size").alias("score"))
    return _features(spark, sf_dir).join(scores, "feature", "left").select("doc_id", "feature", F.coalesce("score", F.lit(0)).alias("score"))


@query("""SELECT c_custkey AS id, c_acctbal AS bal, c_mktsegment AS segment, NULL::INTEGER AS nation FROM customer
          UNION ALL SELECT s_suppkey, s_acctbal, NULL, s_nationkey FROM supplier""")
def union_by_name(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"), F.col("s_nationkey").alias("nation"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT DISTINCT user_id AS subject FROM events EXCEPT SELECT 3 AS subject")
def except_subjects(spark, sf_dir):
    every = table(spark, sf_dir, "events").select(F.col("user_id").alias("subject"))
    return every.exceptAll(every.filter("subject = 3")).distinct()


@query("SELECT DISTINCT l_suppkey AS subject, l_returnflag AS trial FROM lineitem")
def distinct_trials(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("subject"), F.col("l_returnflag").alias("trial")).distinct()


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_nations(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"))
    return a.intersect(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")))


# --- summaries -----------------------------------------------------------------------------------------

SHARE = "round(CAST(fog_count AS DOUBLE) / total_samples * 100, 2) AS fog_percentage"


@query(f"""WITH {EV}, s AS (SELECT subject, CAST(sum(CASE WHEN annotation = 2 THEN 1 ELSE 0 END) AS BIGINT) AS fog_count, count(*) AS total_samples, count(DISTINCT event_type) AS n_files FROM ev GROUP BY 1)
        SELECT *, {SHARE} FROM s""")
def summary_by_subject(spark, sf_dir):
    return statistics.summary(A.events(spark, sf_dir), ["subject"], F.col("annotation") == 2, {"n_files": F.count_distinct("event_type")})


@query(f"""WITH {EVF}, s AS (SELECT subject, CAST(sum(CASE WHEN annotation = 2 THEN 1 ELSE 0 END) AS BIGINT) AS fog_count, count(*) AS total_samples, count(DISTINCT event_type) AS num_runs, {r('max(pos) / 4.0')} AS duration_s FROM evf GROUP BY 1)
        SELECT *, {SHARE} FROM s""")
def summary_conditional(spark, sf_dir):
    return statistics.summary(A.samples(spark, sf_dir), ["subject"], F.col("annotation") == 2, {"num_runs": F.count_distinct("event_type"), "duration_s": R(F.max("pos") / A.RATE)})


@query(f"""WITH {LI}, s AS (SELECT trial, CAST(sum(label) AS BIGINT) AS fog_count, count(*) AS total_samples, count(DISTINCT subject) AS n_subjects FROM li GROUP BY 1) SELECT *, {SHARE} FROM s""")
def summary_by_trial(spark, sf_dir):
    return statistics.summary(A.items(spark, sf_dir), ["trial"], F.col("label") == 1, {"n_subjects": F.count_distinct("subject")})


@query(f"""WITH {EV}, s AS (SELECT event_type, CAST(sum(CASE WHEN x > 20 THEN 1 ELSE 0 END) AS BIGINT) AS fog_count, count(*) AS total_samples, count(DISTINCT subject) AS n_subjects FROM ev GROUP BY 1) SELECT *, {SHARE} FROM s""")
def summary_by_type(spark, sf_dir):
    return statistics.summary(A.events(spark, sf_dir), ["event_type"], F.col("x") > 20, {"n_subjects": F.count_distinct("subject")})


@query("""SELECT user_id AS file_id, CAST(sum((event_type = 'error')::INT) AS BIGINT) AS start_hesitation, CAST(sum((event_type = 'click')::INT) AS BIGINT) AS turn, CAST(sum((event_type = 'view')::INT) AS BIGINT) AS walking,
          min(event_type) AS dataset_type, count(*) AS total_samples FROM events GROUP BY 1""")
def summary_by_file(spark, sf_dir):
    n = lambda t: F.sum((F.col("event_type") == t).cast("long"))
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("file_id")).agg(
        n("error").alias("start_hesitation"), n("click").alias("turn"), n("view").alias("walking"), F.min("event_type").alias("dataset_type"), F.count("*").alias("total_samples")
    )


@query(f"""WITH c AS (SELECT count(*) AS n, sum((event_type = 'error')::INT) AS a, sum((event_type = 'click')::INT) AS b, sum((value > 20)::INT) AS c, sum((event_type IN ('error', 'click') OR value > 20)::INT) AS d FROM events)
        SELECT event_type, CAST(count AS BIGINT) AS count, {r('100.0 * count / n')} AS percentage FROM (
          SELECT 'StartHesitation' AS event_type, a AS count, n FROM c UNION ALL SELECT 'Turn', b, n FROM c UNION ALL SELECT 'Walking', c, n FROM c
          UNION ALL SELECT 'Any', d, n FROM c UNION ALL SELECT 'None', n - d, n FROM c)""")
def summary_unpivot(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("event_type") == "error").cast("int").alias("a"), (F.col("event_type") == "click").cast("int").alias("b"), (F.col("value") > 20).cast("int").alias("c"))
    out = statistics.flag_summary(e, {"a": "StartHesitation", "b": "Turn", "c": "Walking"})
    return out.withColumn("percentage", R(F.col("percentage")))


@query("SELECT count(*) AS total_rows, CAST(6 AS INTEGER) AS n_columns, count(DISTINCT user_id) AS n_subjects, count(DISTINCT event_type) AS n_files FROM events")
def basic_info(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.agg(F.count("*").alias("total_rows"), F.lit(len(e.columns)).alias("n_columns"), F.count_distinct("user_id").alias("n_subjects"), F.count_distinct("event_type").alias("n_files"))


@query(f"WITH {EV} SELECT CAST(sum((annotation = 2)::INT) AS BIGINT) AS events, count(*) AS total, {r('100.0 * sum((annotation = 2)::INT) / count(*)')} AS share, {r('100.0 - 100.0 * sum((annotation = 2)::INT) / count(*)')} AS rest FROM ev")
def event_share(spark, sf_dir):
    n = F.sum((F.col("annotation") == 2).cast("long"))
    share = n * 100.0 / F.count("*")
    return A.events(spark, sf_dir).agg(n.alias("events"), F.count("*").alias("total"), R(share).alias("share"), R(100.0 - share).alias("rest"))


@query(f"""WITH {LAB}, c AS (SELECT multiclass_label AS label, count(*) AS count FROM lab GROUP BY 1)
        SELECT label, count, round(CAST(count AS DOUBLE) / sum(count) OVER () * 100, 2) AS percentage, CASE label WHEN 0 THEN 'No FoG' WHEN 1 THEN 'FoG' WHEN 2 THEN 'Pre-FoG' END AS label_name FROM c""")
def label_distribution(spark, sf_dir):
    return labels.label_distribution(A.labelled(spark, sf_dir), "multiclass_label").orderBy("label")


@query("SELECT event_type, count(*) AS count FROM events GROUP BY 1")
def value_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").count().orderBy("event_type")


@query(f"WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT {r('max(n) * 1.0 / min(n)')} AS imbalance_ratio FROM c")
def imbalance_ratio(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").count().agg(R(F.max("count") / F.min("count")).alias("imbalance_ratio"))


@query(f"WITH {LI} SELECT label, {r('avg(l_quantity)')} AS l_quantity, {r('avg(l_extendedprice)', 3)} AS l_extendedprice, {r('avg(l_discount)')} AS l_discount FROM li GROUP BY 1")
def class_means(spark, sf_dir):
    return A.items(spark, sf_dir).groupBy("label").agg(R(F.avg("l_quantity")).alias("l_quantity"), R(F.avg("l_extendedprice"), 3).alias("l_extendedprice"), R(F.avg("l_discount")).alias("l_discount"))


_DESCRIBED = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, {r(f'avg({c})', 4)} AS mean, {r(f'stddev_samp({c})', 4)} AS std, {r(f'min({c})', 4)} AS min, {r(f'quantile_cont({c}, 0.25)', 4)} AS q25, {r(f'quantile_cont({c}, 0.5)', 4)} AS q50, {r(f'quantile_cont({c}, 0.75)', 4)} AS q75, {r(f'max({c})', 4)} AS max FROM lineitem"""
    for c in ("l_quantity", "l_extendedprice", "l_discount")
)


@query(_DESCRIBED)
def describe(spark, sf_dir):
    out = statistics.describe(table(spark, sf_dir, "lineitem"), A.ITEM_CHANNELS)
    return out.select("column", "count", *(R(F.col(c), 4).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")))


@query("SELECT 'x' AS \"column\", CAST(sum((event_id % 17 = 0)::INT) AS BIGINT) AS nulls FROM events UNION ALL SELECT 'user_id', CAST(sum((user_id IS NULL)::INT) AS BIGINT) FROM events")
def null_counts(spark, sf_dir):
    return statistics.null_counts(table(spark, sf_dir, "events").withColumn("x", A.gappy("value")), ["x", "user_id"])


@query(f"""WITH {LAB}, {win(8, name='tr')}, {win(16, name='te')}, folds AS (SELECT DISTINCT subject AS fold FROM te),
        a AS (SELECT fold, 'train' AS role, binary_label AS y FROM tr JOIN folds ON subject <> fold UNION ALL SELECT subject, 'test', binary_label FROM te)
        SELECT fold, role, CAST(sum((y = 0)::INT) AS BIGINT) AS class_0, CAST(sum((y = 1)::INT) AS BIGINT) AS class_1 FROM a GROUP BY 1, 2""")
def fold_distribution(spark, sf_dir):
    lab = A.labelled(spark, sf_dir)
    train, test = (windows.sliding(lab, g, ["subject"], labels=["binary_label"]) for g in (HALF, WHOLE))
    return windows.fold_counts(train, test, "binary_label", [0, 1])


@query(f"""WITH {LAB}, {win(16, name='te')}, c AS (SELECT subject AS fold, sum((multiclass_label = 0)::INT) AS a, sum((multiclass_label = 2)::INT) AS b FROM te GROUP BY 1) SELECT fold FROM c WHERE least(a, b) > 0""")
def evaluable_folds(spark, sf_dir):
    test = A.event_windows(spark, sf_dir, WHOLE)
    return windows.evaluable(windows.fold_counts(test, test, "multiclass_label", [0, 2]), (0, 2))


@query("SELECT 'one' AS \"column\" UNION ALL SELECT 'gap'")
def constant_columns(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("value", F.lit(1).alias("one"), F.lit(None).cast("double").alias("gap"), F.when(F.col("event_id") % 2 == 0, 1).alias("half"))
    return statistics.constant_columns(e, e.columns)


@query(f"""SELECT "column", {r('v', 4)} AS variance FROM (SELECT 'l_quantity' AS "column", var_samp(l_quantity) AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', var_samp(l_extendedprice) FROM lineitem
          UNION ALL SELECT 'l_discount', var_samp(l_discount) FROM lineitem UNION ALL SELECT 'l_tax', var_samp(l_tax) FROM lineitem) ORDER BY v DESC LIMIT 3""")
def top_variance(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").withColumns({c: F.col(c) for c in ("l_tax",)})
    return statistics.top_variance(t, [*A.ITEM_CHANNELS, "l_tax"], 3).withColumn("variance", R(F.col("variance"), 4))


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem" for i, a in enumerate(_CORR) for b in _CORR[i + 1 :])


_RANKED = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in ("l_quantity", "l_extendedprice", "l_discount"))


@query(f"""WITH ranked AS (SELECT {_RANKED} FROM lineitem)
        SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, {r('corr(l_quantity, l_extendedprice)')} AS r FROM ranked
        UNION ALL SELECT 'l_quantity', 'l_discount', {r('corr(l_quantity, l_discount)')} FROM ranked
        UNION ALL SELECT 'l_extendedprice', 'l_discount', {r('corr(l_extendedprice, l_discount)')} FROM ranked""")
def spearman(spark, sf_dir):
    columns = ["l_quantity", "l_extendedprice", "l_discount"]
    ranked = statistics.rank_columns(table(spark, sf_dir, "lineitem").select(*columns), columns)
    return statistics.correlations(ranked, columns).select("a", "b", R(F.col("r")).alias("r"))


@query(f"SELECT a, b, {r('r')} AS r FROM ({_PAIRS})")
def corr_matrix(spark, sf_dir):
    return statistics.correlations(table(spark, sf_dir, "lineitem"), _CORR).withColumn("r", R(F.col("r")))


_DIMS = range(6)
_EM_SUMS = "em AS (SELECT vec_id, label, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}, CAST(embedding[{i + 1}] AS DOUBLE) * 2 + CAST(embedding[{i + 2}] AS DOUBLE) * 0.1 AS d{i}" for i in _DIMS) + " FROM embeddings)"
_EM_COLUMNS = [f"{k}{i}" for k in "ed" for i in _DIMS]


def _vector_columns(spark, sf_dir):
    x = lambda i: F.col("x")[i]
    return A.vectors(spark, sf_dir).select("vec_id", "label", "y", *(x(i).alias(f"e{i}") for i in _DIMS), *((x(i) * 2 + x(i + 1) * 0.1).alias(f"d{i}") for i in _DIMS))


@query(f"""WITH {_EM_SUMS}, c AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM em" for i, a in enumerate(_EM_COLUMNS) for b in _EM_COLUMNS[i + 1:])})
        SELECT a, b, {r('r')} AS r FROM c WHERE abs(r) > 0.9 ORDER BY abs(r) DESC, a, b LIMIT 10""")
def high_corr_pairs(spark, sf_dir):
    found = statistics.correlations(_vector_columns(spark, sf_dir), _EM_COLUMNS)
    return statistics.high_pairs(found).withColumn("r", R(F.col("r")))


@query(f"""WITH {LI}, s AS (SELECT 1 AS one, {', '.join(f'avg({c}) FILTER (label = {k}) AS {c}_m{k}, var_samp({c}) FILTER (label = {k}) AS {c}_v{k}, count({c}) FILTER (label = {k}) AS {c}_n{k}' for c in A.ITEM_CHANNELS for k in (0, 1))} FROM li)
        {' UNION ALL '.join(f"SELECT '{c}' AS \"column\", {r(f'abs({c}_m1 - {c}_m0) / sqrt((({c}_n0 - 1) * {c}_v0 + ({c}_n1 - 1) * {c}_v1) / ({c}_n0 + {c}_n1 - 2))')} AS d, 'Negligible' AS size FROM s" for c in A.ITEM_CHANNELS)}""")
def cohens_d(spark, sf_dir):
    out = statistics.cohens_d(A.items(spark, sf_dir), A.ITEM_CHANNELS, F.col("label"))
    return out.select("column", R(F.col("d")).alias("d"), C.effect_size_name(F.col("d")).alias("size"))


@query("""WITH m AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1), t AS (SELECT min(c_nationkey) AS mode FROM m WHERE n = (SELECT max(n) FROM m)) SELECT mode, n AS count FROM t JOIN m ON c_nationkey = mode""")
def mode_smallest(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    best = c.agg(F.mode("c_nationkey", True).alias("mode"))
    return c.join(F.broadcast(best), F.col("c_nationkey") == F.col("mode")).groupBy("mode").agg(F.count("*").alias("count"))  # one row


@query("""WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events), b AS (SELECT least(CAST(floor((value - lo) / ((hi - lo) / 50)) AS INT), 49) AS bin, count(*) AS count FROM events, e GROUP BY 1)
          SELECT CAST(i AS INT) AS bin, coalesce(count, 0) AS count FROM range(50) r(i) LEFT JOIN b ON bin = i""")
def histogram(spark, sf_dir):
    return statistics.histogram(table(spark, sf_dir, "events"), "value", 50)


# --- window functions, ordering -----------------------------------------------------------------------------


@query(f"WITH {LI} SELECT subject, trial, pos, l_quantity FROM li")
def row_ordinal(spark, sf_dir):
    return A.items(spark, sf_dir).select("subject", "trial", "pos", "l_quantity")


@query(f"WITH {LAB} SELECT subject, pos FROM ons WHERE onset = 1")
def episode_onsets(spark, sf_dir):
    within = labels.in_order(["subject"], ["pos"])
    return A.samples(spark, sf_dir).withColumn("onset", labels.onset(F.col("annotation"), within)).filter("onset = 1").select("subject", "pos")


@query(f"WITH {LAB} SELECT subject, pos, multiclass_label FROM lab")
def label_multiclass(spark, sf_dir):
    return A.labelled(spark, sf_dir).select("subject", "pos", "multiclass_label")


@query(f"WITH {LAB} SELECT subject, pos, annotation, binary_label, multiclass_label FROM lab")
def label_all(spark, sf_dir):
    return A.labelled(spark, sf_dir).select("subject", "pos", "annotation", "binary_label", "multiclass_label")


@query("""WITH s AS (SELECT p_brand, sum(p_retailprice) AS imp FROM part GROUP BY 1), c AS (SELECT sum(imp) OVER (ORDER BY imp DESC, p_brand) / (SELECT sum(imp) FROM s) AS cum FROM s)
          SELECT count(*) FILTER (cum <= 0.9) + 1 AS k90, count(*) FILTER (cum <= 0.95) + 1 AS k95 FROM c""")
def cumulative_k(spark, sf_dir):
    s = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sum("p_retailprice").alias("imp"))
    return statistics.cumulative_count(s, "imp", "p_brand", [0.9, 0.95])


@query("""SELECT p_brand, p_partkey, p_retailprice, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 15""")
def topk_per_group(spark, sf_dir):
    return statistics.top_per_group(table(spark, sf_dir, "part"), "p_brand", "p_retailprice", "p_partkey", 15).select("p_brand", "p_partkey", "p_retailprice", "rank")


@query(f"""WITH {EVF}, c AS (SELECT subject, min(pos) AS center FROM evf WHERE annotation = 2 GROUP BY 1), s AS (SELECT e.*, e.pos / 4.0 AS time_s FROM evf e JOIN c USING (subject) WHERE pos >= center - 10 AND pos < center + 10)
        SELECT subject, pos, {r('time_s - min(time_s) OVER (PARTITION BY subject)')} AS rel_time FROM s""")
def context_slice(spark, sf_dir):
    s = A.samples(spark, sf_dir).withColumn("time_s", F.col("pos") / A.RATE)
    return windows.context(s, ["subject"], F.col("annotation") == 2, 10, time="time_s").select("subject", "pos", R(F.col("rel_time")).alias("rel_time"))


SCORE_SQL = "sc AS (SELECT vec_id, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y, (vec_id * 37 + 11) % 64 / 64.0 AS score, vec_id % 5 AS fold FROM embeddings)"
CURVE_SQL = f"""{SCORE_SQL}, g AS (SELECT score AS threshold, sum(y) AS p, count(*) AS n FROM sc GROUP BY 1),
        cu AS (SELECT threshold, sum(p) OVER w AS tp, sum(n) OVER w AS flagged, (SELECT sum(y) FROM sc) AS pos FROM g WINDOW w AS (ORDER BY threshold DESC)),
        pr AS (SELECT threshold, CAST(tp AS DOUBLE) / flagged AS precision, CAST(tp AS DOUBLE) / pos AS recall FROM cu)"""


def scores(spark, sf_dir):
    return A.vectors(spark, sf_dir).select("vec_id", "y", (F.pmod(F.col("vec_id") * 37 + 11, F.lit(64)) / 64.0).alias("score"), (F.col("vec_id") % 5).alias("fold"))


@query(f"WITH {CURVE_SQL} SELECT CAST(threshold AS DOUBLE) AS threshold, {r('precision')} AS precision, {r('recall')} AS recall FROM pr")
def pr_curve(spark, sf_dir):
    return evaluation.curve(scores(spark, sf_dir), F.col("y"), F.col("score")).select("threshold", R(F.col("precision")).alias("precision"), R(F.col("recall")).alias("recall"))


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey")
def sort_desc(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_n(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


# --- sliding windows --------------------------------------------------------------------------------------------


@query(f"""WITH {LAB}, {win(8)} SELECT subject, k, {r('avg(x)')} AS mean, {r('stddev_pop(x)')} AS std, {r('sqrt(avg(x * x))')} AS rms FROM win_r GROUP BY 1, 2""")
def sliding_windows(spark, sf_dir):
    x = F.col("x")
    return windows.sliding(A.samples(spark, sf_dir), HALF, ["subject"], aggregates=[R(F.avg(x)).alias("mean"), R(F.stddev_pop(x)).alias("std"), R(F.sqrt(F.avg(x * x))).alias("rms")])


@query(f"WITH {LAB}, {win(8)} SELECT subject, k, binary_label FROM win")
def window_majority(spark, sf_dir):
    return A.event_windows(spark, sf_dir).select("subject", "k", "binary_label")


@query(f"""WITH {LI}, n AS (SELECT subject, trial, count(*) AS n FROM li GROUP BY 1, 2), k AS (SELECT subject, trial, unnest(range(0, (n - 64) // 32 + 1)) AS k FROM n WHERE n >= 64)
        SELECT k.subject, k.trial, k.k, {r('avg(l_quantity)')} AS q_mean, {r('max(l_extendedprice)')} AS price_max, CAST(CASE WHEN sum(label) * 2 > 64 THEN 1 ELSE 0 END AS INTEGER) AS label
        FROM k JOIN li ON li.subject = k.subject AND li.trial = k.trial AND li.pos >= k.k * 32 AND li.pos < k.k * 32 + 64 GROUP BY 1, 2, 3""")
def windows_per_subject(spark, sf_dir):
    return windows.sliding(A.items(spark, sf_dir), A.ITEM_HALF, ["subject", "trial"], labels=["label"], aggregates=[R(F.avg("l_quantity")).alias("q_mean"), R(F.max("l_extendedprice")).alias("price_max")])


@query(f"WITH {LAB}, {win(8)} SELECT subject, k, binary_label, multiclass_label FROM win")
def windows_two_labels(spark, sf_dir):
    return A.event_windows(spark, sf_dir).select("subject", "k", "binary_label", "multiclass_label")


@query(f"WITH {LAB}, {win(16)} SELECT subject, k, binary_label, multiclass_label FROM win")
def tumbling_windows(spark, sf_dir):
    return A.event_windows(spark, sf_dir, WHOLE).select("subject", "k", "binary_label", "multiclass_label")


#: Places of a stretch where all events are one recording.
STRETCH = 4096


def _one_recording(spark, sf_dir) -> DataFrame:
    """All events as one recording, numbered and labelled in stretches."""
    kept = A.events(spark, sf_dir).filter(F.col("annotation") != labels.NOT_IN_EXPERIMENT).withColumn("subject", F.lit(1))
    numbered = labels.with_ordinal(kept, ["subject"], ["ts", "event_id"], stretch=STRETCH)
    return labels.with_labels(numbered, ["subject"], ["pos"], lead=A.LEAD, stretch=STRETCH)


_ONE = f"""{EV.replace("user_id AS subject", "1 AS subject")}, evf AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM ev WHERE annotation <> 0),
        ons AS (SELECT *, CASE WHEN annotation = 2 THEN 1 ELSE 0 END AS binary_label, CASE WHEN annotation = 2 AND lag(annotation) OVER (ORDER BY pos) <> 2 THEN 1 ELSE 0 END AS onset FROM evf),
        lab AS (SELECT *, CASE WHEN binary_label = 0 AND max(onset) OVER (ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) = 1 THEN 2 ELSE binary_label END AS multiclass_label FROM ons)"""


@query(f"WITH {_ONE} SELECT event_id, pos, binary_label, multiclass_label FROM lab")
def long_recording_labels(spark, sf_dir):
    return _one_recording(spark, sf_dir).select("event_id", "pos", "binary_label", "multiclass_label")


@query(f"""WITH {_ONE}, n AS (SELECT count(*) AS n FROM lab), k AS (SELECT unnest(range(0, (n - 16) // 8 + 1)) AS k FROM n),
        w AS (SELECT k.k, l.* FROM k JOIN lab l ON l.pos >= k.k * 8 AND l.pos < k.k * 8 + 16), v AS (SELECT k, arg_min(multiclass_label, -100 * c + multiclass_label) AS multiclass_label FROM (SELECT k, multiclass_label, count(*) AS c FROM w GROUP BY ALL) GROUP BY 1)
        SELECT k, multiclass_label, mean, std FROM v JOIN (SELECT k, {r('avg(x)')} AS mean, {r('stddev_pop(x)')} AS std FROM w GROUP BY 1) USING (k)""")
def long_recording_windows(spark, sf_dir):
    x = F.col("x")
    w = windows.sliding(_one_recording(spark, sf_dir), HALF, ["subject"], labels=["multiclass_label"], aggregates=[R(F.avg(x)).alias("mean"), R(F.stddev_pop(x)).alias("std")], stretch=STRETCH)
    return w.drop("subject")


@query(f"WITH {LAB}, {win(8)}, f AS (SELECT subject, k, avg(x) AS m, stddev_pop(x) AS s, sqrt(avg(x * x)) AS q FROM win_r GROUP BY 1, 2) SELECT multiclass_label, count(*) AS n_windows, {r('avg(m)')} AS mean, {r('avg(s)')} AS std, {r('avg(q)')} AS rms FROM win JOIN f USING (subject, k) GROUP BY 1")
def flagship(spark, sf_dir):
    """Labels, windows, votes and three features per window, summarised by label."""
    x = F.col("x")
    w = windows.sliding(A.labelled(spark, sf_dir), HALF, ["subject"], labels=["multiclass_label"], aggregates=[F.avg(x).alias("m"), F.stddev_pop(x).alias("s"), F.sqrt(F.avg(x * x)).alias("q")])
    return w.groupBy("multiclass_label").agg(F.count("*").alias("n_windows"), R(F.avg("m")).alias("mean"), R(F.avg("s")).alias("std"), R(F.avg("q")).alias("rms"))

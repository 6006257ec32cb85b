"""Registered queries of the readers and writers: the driver's events as raw files of each layout, read back.

Spark writes the files; only their names are given on the driver, one by one,
for a writer of Spark names its files itself.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import rounded as R
from ..operators import labels
from ..session import scratch_folder
from ..sources import readers, sinks
from ..sources.schemas import LOWER_BACK, ONE_FOOT
from .adapters import table
from .relational import query, r


def written_files(spark: SparkSession, lines: DataFrame, header: str | Column | None = None) -> str:
    """A folder with ``lines`` (file, pos, line) as text files, in the order of ``pos``; ``header`` goes before.

    The header is written with a file's first line: rows of its own would come by a union, whose sides adaptive
    execution may deal differently, so that a file comes in two parts.
    """
    folder = scratch_folder(spark, "raw")
    nth = F.row_number().over(labels.in_order(["file"], ["pos"]))  # by this, a file is in one task
    ordered = lines.select("file", "pos", "line", nth.alias("nth"))
    if header is not None:
        head = F.lit(header) if isinstance(header, str) else header
        ordered = ordered.withColumn("line", F.when(F.col("nth") == 1, F.concat_ws("\n", head, "line")).otherwise(F.col("line")))
    # Comparing keeps the window, which else goes as a column that nothing needs.
    ordered.filter("nth > 0").sortWithinPartitions("file", "pos").select("file", "line").write.partitionBy("file").text(f"{folder}/parts")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for part in fs.globStatus(path(f"{folder}/parts/file=*/part-*")):
        source = part.getPath()
        target = path(f"{folder}/raw/{unquote(source.getParent().getName().removeprefix('file='))}")
        fs.mkdirs(target.getParent())
        if fs.exists(target) or not fs.rename(source, target):
            raise OSError(f"cannot name {target}")
    return f"{folder}/raw"


def _events(spark, sf_dir, file: Column) -> DataFrame:
    """Events with their file and their place in it."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.coalesce("value", F.lit(0.0)).alias("x"))
    return labels.with_ordinal(e.withColumn("file", file), ["file"], ["event_id"])


def _line(separator: str, *values: Column) -> Column:
    return F.concat_ws(separator, *(v.cast("string") for v in values))


def _times(n: int) -> list[Column]:
    return [F.col("x") * k for k in range(n)]


_POS = "CAST(row_number() OVER (PARTITION BY {} ORDER BY event_id) - 1 AS BIGINT) AS pos"


@query(f"""SELECT CAST(user_id % 3 + 1 AS INTEGER) AS subject_id, CAST(user_id % 2 + 1 AS INTEGER) AS run_id, {_POS.format('user_id % 3, user_id % 2')}, CAST(event_id AS INTEGER) AS time_ms, {r('event_id / 1000.0')} AS time_s,
          {r('coalesce(value, 0) * 2')} AS acc_lateral_ankle, {r('coalesce(value, 0) * 8')} AS acc_lateral_trunk, CAST(event_id % 3 AS INTEGER) AS label FROM events""")
def raw_whitespace(spark, sf_dir):
    e = _events(spark, sf_dir, F.format_string("S%02dR%02d.txt", F.col("user_id") % 3 + 1, F.col("user_id") % 2 + 1))
    root = written_files(spark, e.withColumn("line", _line("  ", F.col("event_id"), *_times(9), F.col("event_id") % 3)))
    d = readers.load_dataset(spark, "ankle_thigh_trunk", root)
    return d.select("subject_id", "run_id", "pos", "time_ms", R(F.col("time_s")).alias("time_s"), R(F.col("acc_lateral_ankle")).alias("acc_lateral_ankle"), R(F.col("acc_lateral_trunk")).alias("acc_lateral_trunk"), "label")


@query(f"""WITH e AS (SELECT *, user_id % 7 = 0 AS still FROM events)
        SELECT CAST(user_id % 4 + 1 AS INTEGER) AS subject_id, CAST(CASE WHEN still THEN 0 ELSE user_id % 2 + 1 END AS INTEGER) AS session_id, CASE WHEN still THEN 'standing' ELSE 'walking' END AS trial_type,
          {_POS.format('user_id % 4, CASE WHEN still THEN -1 ELSE user_id % 2 END')}, event_id AS frame, {r('coalesce(value, 0) * 3')} AS gyr_ml_lower_back, CASE WHEN event_id % 2 = 1 THEN 'Freeze' ELSE 'No Freeze' END AS freezing_label FROM e""")
def raw_tab(spark, sf_dir):
    who = F.col("user_id") % 4 + 1
    file = F.when(F.col("user_id") % 7 == 0, F.format_string("SUB%02d_standing.txt", who)).otherwise(F.format_string("SUB%02d_%d.txt", who, F.col("user_id") % 2 + 1))
    e = _events(spark, sf_dir, file)
    root = written_files(spark, e.withColumn("line", _line("\t", F.col("event_id"), F.col("pos") / 128, *_times(6), F.col("event_id") % 2)), "\t".join(LOWER_BACK))
    d = readers.load_dataset(spark, "lower_back", root)
    return d.select("subject_id", "session_id", "trial_type", "pos", "frame", R(F.col("gyr_ml_lower_back")).alias("gyr_ml_lower_back"), "freezing_label")


@query(f"""SELECT CAST(user_id % 5 + 1 AS INTEGER) AS subject_id, CAST(user_id % 2 + 1 AS INTEGER) AS trial_id, {_POS.format('user_id % 5, user_id % 2')}, {r('coalesce(value, 0) * 5')} AS gyr_z_left_foot, {r('coalesce(value, 0) * 50')} AS gyr_z_right_foot,
          CASE WHEN event_id % 2 = 1 THEN 'FoG Active' ELSE 'No FoG' END AS fog_label_text FROM events WHERE user_id % 5 <> 4""")
def raw_feet(spark, sf_dir):
    """The fifth subject's right files are shorter than the left ones, so those trials go."""
    who, trial = F.col("user_id") % 5 + 1, F.col("user_id") % 2 + 1
    line = lambda scale: _line(",", F.col("pos") / 200, *(v * scale for v in _times(6)), F.col("event_id") % 2)
    sides = []
    for side, scale in (("left", 1), ("right", 10)):
        e = _events(spark, sf_dir, F.format_string(f"S%d/S%d_{side}_foot_trial_%d.csv", who, who, trial)).withColumn("line", line(scale))
        sides.append(e if side == "left" else e.filter((F.col("user_id") % 5 != 4) | (F.col("pos") % 2 == 1)))
    root = written_files(spark, sides[0].unionByName(sides[1]), ",".join(f"column {c}" for c in ONE_FOOT))
    d = readers.load_dataset(spark, "both_feet", root)
    return d.select("subject_id", "trial_id", "pos", R(F.col("gyr_z_left_foot")).alias("gyr_z_left_foot"), R(F.col("gyr_z_right_foot")).alias("gyr_z_right_foot"), "fog_label_text")


@query(f"""SELECT CAST(user_id % 6 AS INTEGER) AS subject_id, CAST(user_id % 2 + 1 AS INTEGER) AS task_id, {_POS.format('user_id % 6, user_id % 2')}, event_id AS frame_id, {r('coalesce(value, 0) * 23')} AS sensor_24, {r('coalesce(value, 0) * 56')} AS raw_33, CAST(event_id % 2 AS INTEGER) AS fog_label FROM events""")
def raw_headerless(spark, sf_dir):
    e = _events(spark, sf_dir, F.format_string("%03d/task_%d.txt", F.col("user_id") % 6, F.col("user_id") % 2 + 1))
    root = written_files(spark, e.withColumn("line", _line(",", F.col("event_id"), F.lit("12:00"), *_times(57), F.col("event_id") % 2)))
    d = readers.load_dataset(spark, "multimodal", root)
    return d.select("subject_id", "task_id", "pos", "frame_id", R(F.col("sensor_24")).alias("sensor_24"), R(F.col("raw_33")).alias("raw_33"), "fog_label")


def _named(spark, sf_dir) -> str:
    """Files with two different headers; those of one have no column AccV, those of the other no Valid."""
    first = F.col("user_id") % 2 == 0
    file = F.when(first, F.format_string("train/a/f%d.csv", F.col("user_id") % 4)).otherwise(F.format_string("test/b/g%d.csv", F.col("user_id") % 6))
    e = _events(spark, sf_dir, file)
    flag = (F.col("event_id") % 5 == 0).cast("int")
    line = F.when(first, _line(",", F.col("event_id"), F.col("x"), F.lit(0), flag, F.lit(0))).otherwise(_line(",", flag, F.col("event_id"), F.lit(0), F.lit(0), F.lit(1)))
    head = F.when(F.col("file").startswith("train"), "Time,AccV,StartHesitation,Turn,Walking").otherwise("Turn,Time,StartHesitation,Walking,Valid")
    return written_files(spark, e.withColumn("line", line), head)


_NAMED = f"""SELECT CASE WHEN user_id % 2 = 0 THEN 'f' || (user_id % 4) ELSE 'g' || (user_id % 6) END AS file_id, CASE WHEN user_id % 2 = 0 THEN 'train' ELSE 'test' END AS subset, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS dataset_type,
          {_POS.format('user_id % 2, CASE WHEN user_id % 2 = 0 THEN user_id % 4 ELSE user_id % 6 END')}, CAST(event_id AS DOUBLE) AS "Time", CASE WHEN user_id % 2 = 0 THEN {r('coalesce(value, 0)')} END AS "AccV", CASE WHEN user_id % 2 = 1 THEN CAST(1 AS DOUBLE) END AS "Valid", CAST(event_id % 5 = 0 AS INTEGER) AS fog_any FROM events"""


def _named_columns(d: DataFrame) -> DataFrame:
    return d.select("file_id", "subset", "dataset_type", "pos", "Time", R(F.col("AccV")).alias("AccV"), "Valid", "fog_any")


@query(_NAMED)
def raw_named(spark, sf_dir):
    return _named_columns(readers.load_dataset(spark, "competition", _named(spark, sf_dir)))


@query(f"SELECT file_id, pos, \"Time\", fog_any FROM ({_NAMED}) WHERE file_id = 'g3'")
def raw_file_by_id(spark, sf_dir):
    return readers.competition_file(spark, _named(spark, sf_dir), "g3").select("file_id", "pos", "Time", "fog_any")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey")
def raw_metadata(spark, sf_dir):
    """An optional table of all strings, joined to the rows that it describes."""
    n = table(spark, sf_dir, "nation").select(F.lit("nations.csv").alias("file"), F.col("n_nationkey").cast("long").alias("pos"), _line(",", F.col("n_nationkey"), F.col("n_name")).alias("line"))
    found = readers.metadata(spark, written_files(spark, n, "n_nationkey,n_name"), "nations.csv")
    c = table(spark, sf_dir, "customer")
    return c.join(found, c.c_nationkey.cast("string") == found.n_nationkey).select("n_nationkey", "n_name", "c_custkey")


# --- writers ------------------------------------------------------------------------------------


@query(f"SELECT event_id, user_id, event_type, {r('value')} AS value FROM events")
def sink_csv(spark, sf_dir):
    path = sinks.save_dataset(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), scratch_folder(spark, "saved"), "csv")
    e = table(spark, sf_dir, "events").schema
    read = readers.read_dataset(spark, path)
    return read.select(*(F.col(c).cast(e[c].dataType).alias(c) for c in ("event_id", "user_id", "event_type")), R(F.col("value")).alias("value"))


@query(f"SELECT vec_id % 7 AS fold, 'test' AS role, vec_id, {r('embedding[1]')} AS e0 FROM embeddings WHERE vec_id % 7 = 2 UNION ALL SELECT 2, 'train', vec_id, {r('embedding[1]')} FROM embeddings WHERE vec_id % 7 <> 2")
def sink_folds(spark, sf_dir):
    """Features of all folds in one table, of which one fold is read."""
    from ..operators import windows

    rows = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 7).alias("subject"), F.col("embedding")[0].cast("double").alias("e0"))
    path = scratch_folder(spark, "folds")
    sinks.save_folds(windows.leave_one_out(rows, rows).drop("subject"), path)
    one = spark.read.parquet(path).filter("fold = 2")
    return one.select(F.col("fold").cast("long").alias("fold"), "role", "vec_id", R(F.col("e0")).alias("e0"))


@query(f"SELECT event_type AS classifier, count(*) AS n, {r('avg(value)', 4)} AS mean FROM events GROUP BY 1")
def sink_results(spark, sf_dir):
    out = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("classifier")).agg(F.count("*").alias("n"), R(F.avg("value"), 4).alias("mean"))
    path = scratch_folder(spark, "results")
    sinks.save_results(out, path)
    return spark.read.option("header", True).schema("n long, mean double, classifier string").csv(path)

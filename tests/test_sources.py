"""Readers and writers on generated files."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from stridelab.sources import readers, sinks
from stridelab.sources.schemas import LOWER_BACK, MULTIMODAL


def put(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")


@pytest.fixture
def whitespace_files(tmp_path):
    for subject in (1, 2):
        for run in (1, 2):
            put(tmp_path / f"S{subject:02d}R{run:02d}.txt", [f"{15 * i}  {' '.join(str(i * c) for c in range(9))} {i % 3}" for i in range(50)])
    return tmp_path


def test_whitespace_text(spark, whitespace_files):
    df = readers.load_dataset(spark, "Ankle_Thigh_Trunk", str(whitespace_files))
    rows = df.filter("subject_id = 2 AND run_id = 1").orderBy("pos").collect()
    assert df.count() == 200 and [r.pos for r in rows] == list(range(50))
    r = rows[7]
    assert (r.time_ms, r.acc_lateral_trunk, r.annotation, r.label, r.time_s, r.filename) == (105, 56.0, 1, 1, 0.105, "S02R01.txt")
    assert readers.ankle_thigh_trunk(spark, str(whitespace_files), subject="01").select("subject_id").distinct().count() == 1
    assert readers.label_column(df) == "annotation"


def test_a_bad_file_ends_the_load_or_goes(spark, whitespace_files):
    put(whitespace_files / "S03R01.txt", ["1 2 3", "oops"])
    with pytest.raises(Exception, match="does not fit the layout"):
        readers.ankle_thigh_trunk(spark, str(whitespace_files)).count()
    assert readers.ankle_thigh_trunk(spark, str(whitespace_files), fail_fast=False).count() == 200


def test_tab_text_with_a_header(spark, tmp_path):
    line = lambda i: "\t".join([str(i), str(i / 128), *["0.5"] * 5, "", str(i % 2)])
    for name in ("SUB01_1.txt", "SUB01_standing.txt", "SUB12_2.txt"):
        put(tmp_path / name, ["\t".join(LOWER_BACK), *(line(i) for i in range(20))])
    df = readers.lower_back(spark, str(tmp_path))
    assert {(r.subject_id, r.session_id, r.trial_type) for r in df.collect()} == {(1, 1, "walking"), (1, 0, "standing"), (12, 2, "walking")}
    r = df.filter("pos = 3 AND subject_id = 12").first()
    assert (r.frame, r.gyr_si_lower_back, r.freezing_flag, r.freezing_label) == (3, None, 1, "Freeze")
    assert readers.lower_back(spark, str(tmp_path), trial_type="standing").count() == 20
    with pytest.raises(readers.NoData):
        readers.lower_back(spark, str(tmp_path), subject="12", trial_type="standing")


def test_feet_are_zipped_and_unequal_pairs_go(spark, tmp_path):
    def foot(name, n, first):
        put(tmp_path / name, ["a,b,c,d,e,f,g,h", *(f"{i / 200},{first + i},1,2,3,4,5,{i % 2}" for i in range(n))])

    foot("S1/S1_left_foot_trial_1.csv", 30, 0)
    foot("S1/S1_right_foot_trial_1.csv", 30, 100)
    foot("S1/S1_left_foot_trial_2.csv", 30, 0)
    foot("S1/S1_right_foot_trial_2.csv", 29, 0)
    df = readers.both_feet(spark, str(tmp_path))
    assert df.count() == 30 and df.select("trial_id").distinct().collect()[0][0] == 1
    r = df.filter("pos = 5").first()
    assert (r.acc_x_left_foot, r.acc_x_right_foot, r.time_s, r.fog_label_text) == (5.0, 105.0, 0.025, "FoG Active")


def test_headerless_csv(spark, tmp_path):
    put(tmp_path / "001/task_1.txt", [",".join([str(i), "12:00", *["1.5"] * 57, "1"]) for i in range(10)])
    put(tmp_path / "002/task_3.txt", ["too,short"])
    df = readers.multimodal(spark, str(tmp_path))
    r = df.filter("pos = 4").first()
    assert df.count() == 10 and len(MULTIMODAL) == 60
    assert (r.subject_id, r.task_id, r.frame_id, r.raw_33, r.fog_label, r.fog_label_text) == (1, 1, 4, 1.5, 1, "FoG Active")


def test_csv_that_names_its_columns(spark, tmp_path):
    put(tmp_path / "train/a/x1.csv", ["Time,AccV,StartHesitation,Turn,Walking", "0,1.5,0,0,0", "1,2.5,1,0,0"])
    put(tmp_path / "train/b/x2.csv", ["Time,AccV,StartHesitation,Turn,Walking,Valid", "0,3.5,0,0,1,1"])
    put(tmp_path / "test/a/x3.csv", ["Time,AccV", "0,1"])
    df = readers.competition(spark, str(tmp_path))
    got = {(r.file_id, r.subset, r.dataset_type, int(r.Time)): (r.fog_any, r.Valid) for r in df.collect()}
    assert got == {("x1", "train", "a", 0): (0, None), ("x1", "train", "a", 1): (1, None), ("x2", "train", "b", 0): (1, 1.0)}
    assert readers.competition_file(spark, str(tmp_path), "x2").count() == 1
    with pytest.raises(readers.NoData):
        readers.competition_file(spark, str(tmp_path), "nope")
    with pytest.raises(ValueError):
        readers.competition(spark, str(tmp_path), fail_fast=True)


def test_names_and_missing_files(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown dataset"):
        readers.load_dataset(spark, "other", str(tmp_path))
    with pytest.raises(readers.NoData):
        readers.multimodal(spark, str(tmp_path))
    assert readers.metadata(spark, str(tmp_path), "subjects.csv") is None
    put(tmp_path / "subjects.csv", ["id,age", "1,70"])
    assert readers.metadata(spark, str(tmp_path), "subjects.csv").first().age == "70"
    readers.register("Mine", readers.multimodal)
    assert "mine" in readers.READERS
    with pytest.raises(ValueError):
        readers.label_column(spark.range(1))


def test_saved_datasets(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    for kind in ("csv", "parquet"):
        path = sinks.save_dataset(df, str(tmp_path / "out"), kind)
        assert path.endswith(kind) and sorted(r.id for r in readers.read_dataset(spark, path).collect()) == [1, 2]
    for bad in ("x.pkl", "x.xlsx"):
        with pytest.raises(ValueError):
            readers.read_dataset(spark, bad)
    with pytest.raises(ValueError):
        sinks.save_dataset(df, str(tmp_path / "x"), "pickle")


def test_folds_are_partitions(spark, tmp_path):
    df = spark.createDataFrame([("s1", "train", 1), ("s1", "test", 2), ("s2", "test", 3)], "fold string, role string, x int")
    sinks.save_folds(df, str(tmp_path / "folds"))
    one = spark.read.parquet(str(tmp_path / "folds")).filter("fold = 's1' AND role = 'test'")
    assert [r.x for r in one.collect()] == [2]
    assert "PartitionFilters: [isnotnull(fold" in one._jdf.queryExecution().toString()
    sinks.save_results(df.withColumnRenamed("fold", "classifier"), str(tmp_path / "results"))
    assert (tmp_path / "results" / "classifier=s2").is_dir()


@pytest.fixture
def small_splits(spark):
    """Files are cut every 400 bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "400b", "spark.sql.files.openCostInBytes": "100b"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def test_files_split_and_places_stay(spark, small_splits, tmp_path):
    put(tmp_path / "S01R01.txt", [f"{15 * i}  {' '.join(str(i * c) for c in range(9))} {i % 3}" for i in range(300)])
    put(tmp_path / "S01R02.txt", [f"{i} 0 0 0 0 0 0 0 0 0 1" for i in range(5)])
    lines = readers._lines(spark, readers.list_files(spark, str(tmp_path), "S*.txt"))
    assert lines.select("path", "pos").distinct().count() == 305
    df = readers.ankle_thigh_trunk(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() > 10
    got = {(r.run_id, r.pos): r.time_ms for r in df.collect()}
    assert got == {(1, i): 15 * i for i in range(300)} | {(2, i): i for i in range(5)}


def test_split_files_with_headers_and_blank_lines(spark, small_splits, tmp_path):
    head = ["Time,AccV,StartHesitation,Turn,Walking", "Turn,Time,StartHesitation,Walking"]
    put(tmp_path / "train/a/x1.csv", [head[0], *(f"{i},{i}.5,0,{i % 2},0" for i in range(200)), "", " "])
    put(tmp_path / "train/a/x2.csv", [head[1], *(f"1,{i},0,0" for i in range(90))])
    put(tmp_path / "train/b/x3.csv", [head[1], *(f"1,{i},0,0" for i in range(90)), "not,enough"])
    rows = readers.competition(spark, str(tmp_path)).collect()
    assert {(r.file_id, r.pos): (r.Time, r.AccV, r.fog_any) for r in rows} == {("x1", i): (i, i + 0.5, i % 2) for i in range(200)} | {("x2", i): (i, None, 1) for i in range(90)}


def test_a_file_cut_otherwise_is_an_error(spark, small_splits, tmp_path):
    put(tmp_path / "S01R01.txt", [f"{i} 0 0 0 0 0 0 0 0 0 1" for i in range(200)])
    lines = readers._lines(spark, readers.list_files(spark, str(tmp_path), "S*.txt"))
    assert "raise_error" in lines._jdf.queryExecution().optimizedPlan().toString()


def test_written_files_have_one_part_and_their_header_first(spark):
    """More rows than fit one shuffle partition, whose sides are dealt differently by adaptive execution."""
    from stridelab.operators import labels
    from stridelab.plans.raw import written_files

    small = {"spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.shuffle.partitions": "16"}
    kept = {c: spark.conf.get(c, None) for c in small}
    try:
        for c, value in small.items():
            spark.conf.set(c, value)
        rows = spark.range(20_000).select(F.concat(F.lit("f"), F.col("id") % 7).alias("file"), F.col("id").alias("at"), F.sha2(F.col("id").cast("string"), 256).alias("line"))
        rows = labels.with_ordinal(rows, ["file"], ["at"])
        root = written_files(spark, rows, F.concat(F.lit("head of "), F.col("file")))
    finally:
        for c, value in kept.items():
            spark.conf.set(c, value) if value is not None else spark.conf.unset(c)
    want = {r["file"]: [f"head of {r['file']}", *r["lines"]] for r in rows.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"]).alias("lines")).collect()}
    files = readers.list_files(spark, root, "*")
    assert {f.rsplit("/", 1)[-1]: spark.sparkContext.textFile(f, 1).collect() for f in files} == want


def test_a_line_is_cut_into_fields_once_to_be_checked(spark, tmp_path):
    put(tmp_path / "001/task_1.txt", [",".join([str(i), "12:00", *["1.5"] * 57, "1"]) for i in range(10)])
    put(tmp_path / "001/task_2.txt", [",".join([str(i), "12:00", *["1.5"] * 56, "x" if i == 9 else " NaN ", ""]) for i in range(10)])
    put(tmp_path / "001/task_3.txt", [",".join([str(i), "12:00", *["1.5"] * 56, " NaN ", ""]) for i in range(10)])
    df = readers.multimodal(spark, str(tmp_path)).select("task_id", "pos", "raw_33", "fog_label")
    cut = re.findall(r"split\(\w+#", df._jdf.queryExecution().optimizedPlan().toString())
    assert 1 <= len(cut) <= 4
    assert {(r.task_id, r.raw_33, r.fog_label) for r in df.collect()} == {(1, 1.5, 1), (3, None, None)} and df.count() == 20

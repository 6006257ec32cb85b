"""Readers of the raw layouts, as lazy plans with explicit keys and ordinals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import any_flag, mapped, nan_to_null
from ..session import checkpointed, ship_package
from .schemas import EVENT_FLAGS, FEET_TEXT, FOOT_CHANNELS, FREEZE_TEXT, LAYOUTS, MULTIMODAL_TEXT, Layout, struct


class NoData(ValueError):
    """No file matched, or none could be used."""


def list_files(spark: SparkSession, root: str, pattern: str) -> list[str]:
    """Files that match a pattern, sorted, through Hadoop's file systems (any store Spark reads)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{pattern}")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    names = sorted(s.getPath().toString() for s in found) if found else []
    if not names:
        raise NoData(f"no file matches {pattern} under {root}")
    return names


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


@F.arrow_udf(T.LongType())
def _nth(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The place of each row in its run of equal values, from 0; runs go on from batch to batch of a task."""
    last, done = None, 0
    for batch in batches:
        block = batch.to_numpy(zero_copy_only=False)
        if not len(block):
            yield pa.array([], type=pa.int64())
            continue
        starts = np.r_[0, np.flatnonzero(block[1:] != block[:-1]) + 1]
        nth = np.arange(len(block)) - np.repeat(starts, np.diff(np.r_[starts, len(block)]))
        if last is not None and block[0] == last:
            nth[: starts[1] if len(starts) > 1 else len(block)] += done
        last, done = block[-1], int(nth[-1]) + 1
        yield pa.array(nth)


#: Files up to which a table of files or splits is sent to every task.
SENT = 100_000


def _split_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """(path, block, nth, line): ``nth`` is a line's place in its split, from 0, counted as the split is read."""
    ship_package(spark)
    block = F.col("_metadata.file_block_start")
    lines = spark.read.text(files).select(F.col("_metadata.file_path").alias("path"), block.alias("block"), F.col("value").alias("line"))
    return lines.withColumn("nth", _nth.asNondeterministic()(F.xxhash64("path", "block")))


def _sent(df: DataFrame, files: list[str]) -> DataFrame:
    return F.broadcast(df) if len(files) <= SENT else df


def _placed(lines: DataFrame, files: list[str], fits: Column, header: bool, fail_fast: bool) -> DataFrame:
    """(path, pos, line and further columns) of every line that is not empty, nor a header, of the files that fit.

    ``pos`` is a line's place in its file, from 0. A file is read by as many
    tasks as it has splits. A first read counts the lines of each split and
    tells whether all fit (a row for each split); in the second, a line's place
    is its place in its split behind the lines of the splits before. The count
    before a byte of a file does not depend on where the others were cut;
    should the second read cut at a byte that the first did not, it stops with
    an error. Bad files raise, or go as a whole.
    """
    head = (F.col("block") == 0) & (F.col("nth") == 0) if header else F.lit(False)
    text = F.trim("line") != ""
    counts = lines.groupBy("path", "block").agg(F.count("*").alias("n"), F.max(text & ~head & ~fits).alias("bad"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    bad = F.max("bad").over(Window.partitionBy("path"))
    bases = counts.select(F.col("path").alias("__path"), F.col("block").alias("__block"), F.coalesce(before, F.lit(0)).alias("__base"), bad.alias("__bad"))
    placed = lines.join(_sent(bases, files), (F.col("path") == F.col("__path")) & (F.col("block") == F.col("__block")), "left")
    base = F.when(F.col("__base").isNull(), F.raise_error(F.lit("a file was cut otherwise when it was read again")).cast("long")).otherwise(F.col("__base"))
    problem = F.raise_error(F.concat(F.lit("a line does not fit the layout: "), F.col("path"))).cast("boolean") if fail_fast else F.lit(False)
    kept = placed.withColumn("pos", (F.col("nth") + base - int(header)).cast("long")).filter("pos >= 0").filter(text)
    return kept.filter(F.when(F.col("__bad"), problem).otherwise(True)).drop("block", "nth", "__path", "__block", "__base", "__bad")


def _lines(spark: SparkSession, files: list[str], fits: Column | None = None, header: bool = False, fail_fast: bool = False) -> DataFrame:
    """``_placed`` lines of files."""
    return _placed(_split_lines(spark, files), files, F.lit(True) if fits is None else fits, header, fail_fast)


def _value(text: Column, kind: str) -> Column:
    """A field as its type; blanks are null."""
    return nan_to_null(text.try_cast("double")) if kind == "double" else text.try_cast(kind)


def _reads(text: Column, kind: str) -> Column:
    """Whether a field is blank or reads as its type."""
    return _value(text, kind).isNotNull() | text.isNull() | (F.trim(text) == "") | F.lower(F.trim(text)).isin("nan", "na", "null")


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``x``, which is computed once however often ``f`` names it."""
    return F.transform(F.array(x), f)[0]


def _recordings(spark: SparkSession, files: list[str], layout: Layout, fail_fast: bool | None) -> DataFrame:
    """Typed columns of the delimited lines of files, with path and pos; bad files by the layout's policy."""
    schema = struct(layout.names)
    parts = F.split(F.trim("line") if layout.separator == r"\s+" else F.col("line"), layout.separator)

    def fits_as(p: Column, kind: str) -> Callable[[Column], Column]:
        return lambda i: _reads(F.get(p, i), kind)

    def fit(p: Column) -> Column:
        """The width fits and every number reads."""
        good = F.size(p) == len(schema)
        for kind in dict.fromkeys(f.dataType.simpleString() for f in schema if f.dataType != T.StringType()):
            places = [i for i, f in enumerate(schema) if f.dataType.simpleString() == kind]
            good = good & F.forall(F.array(*map(F.lit, places)), fits_as(p, kind))
        return good

    lines = _lines(spark, files, _once(parts, fit), layout.header, layout.fail_fast if fail_fast is None else fail_fast)
    return lines.withColumn("__p", parts).select("path", "pos", *(_value(F.get("__p", F.lit(i)), f.dataType.simpleString()).alias(f.name) for i, f in enumerate(schema)))


def _name() -> Column:
    return F.element_at(F.split("path", "/"), -1)


def _parent(n: int = 2) -> Column:
    return F.element_at(F.split("path", "/"), -n)


def ankle_thigh_trunk(spark: SparkSession, root: str, fail_fast: bool | None = None, subject: str | None = None) -> DataFrame:
    layout = LAYOUTS["ankle_thigh_trunk"]
    files = list_files(spark, root, f"S{subject}R*.txt" if subject else layout.pattern)
    df = _recordings(spark, files, layout, fail_fast)
    return df.withColumns(
        {
            "subject_id": F.substring(_name(), 2, 2).cast("int"),
            "run_id": F.substring(_name(), 5, 2).cast("int"),
            "filename": _name(),
            "label": F.col("annotation"),
            "time_s": F.col("time_ms") / 1000.0,
        }
    ).drop("path")


def lower_back(spark: SparkSession, root: str, fail_fast: bool | None = None, subject: str | None = None, trial_type: str | None = None) -> DataFrame:
    """``trial_type``: walking or standing; files of the other are not read."""
    layout = LAYOUTS["lower_back"]
    files = list_files(spark, root, f"SUB{subject}*.txt" if subject else layout.pattern)
    standing = lambda f: f.rsplit("/", 1)[-1].lower().endswith("_standing.txt")
    if trial_type:
        files = [f for f in files if standing(f) == (trial_type == "standing")]
        if not files:
            raise NoData(f"no {trial_type} file under {root}")
    df = _recordings(spark, files, layout, fail_fast)
    still = F.lower(_name()).endswith("_standing.txt")
    return df.withColumns(
        {
            "subject_id": F.regexp_extract(_name(), r"^SUB(\d+)_", 1).cast("int"),
            "session_id": F.when(still, 0).otherwise(F.regexp_extract(_name(), r"_(\d+)\.txt$", 1).try_cast("int")),
            "trial_type": F.when(still, "standing").otherwise("walking"),
            "filename": _name(),
            "freezing_label": mapped(F.col("freezing_flag"), FREEZE_TEXT),
        }
    ).drop("path")


def zip_join(left: DataFrame, right: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """Left and right joined by place; recordings whose lengths differ, or that lack a side, go.

    ``right`` has, besides keys and place, only the columns to add.
    """
    n = lambda df, c: df.groupBy(*keys).agg(F.count("*").alias(c))
    equal = n(left, "__l").join(n(right, "__r"), keys).filter("__l = __r").select(*keys)
    return left.join(equal, keys, "left_semi").join(right, [*keys, pos])


def both_feet(spark: SparkSession, root: str, fail_fast: bool | None = None, subject: str | None = None) -> DataFrame:
    """Twelve channels; time and label are the left foot's."""
    layout = LAYOUTS["both_feet"]
    files = list_files(spark, root, f"S{subject}/*_foot_trial_*.csv" if subject else layout.pattern)
    df = _recordings(spark, files, layout, fail_fast)
    parts = F.split(F.regexp_replace(_name(), r"\.csv$", ""), "_")
    df = df.withColumns({"subject_id": F.substring(parts[0], 2, 10).cast("int"), "foot": parts[1], "trial_id": parts[4].cast("int")})
    keys = ["subject_id", "trial_id"]
    left = df.filter("foot = 'left'").select(*keys, "pos", "time_s", "fog_label", *(F.col(c).alias(f"{c}_left_foot") for c in FOOT_CHANNELS))
    right = df.filter("foot = 'right'").select(*keys, "pos", *(F.col(c).alias(f"{c}_right_foot") for c in FOOT_CHANNELS))
    out = zip_join(left, right, keys)
    name = F.format_string("S%d_trial_%d", "subject_id", "trial_id")
    return out.withColumns({"filename": name, "fog_label_text": mapped(F.col("fog_label"), FEET_TEXT)})


def multimodal(spark: SparkSession, root: str, fail_fast: bool | None = None, subject: str | None = None) -> DataFrame:
    layout = LAYOUTS["multimodal"]
    files = list_files(spark, root, f"{subject}/task_*.txt" if subject else layout.pattern)
    df = _recordings(spark, files, layout, fail_fast)
    return df.withColumns(
        {
            "subject_id": _parent().try_cast("int"),
            "task_id": F.regexp_extract(_name(), r"task_(\d+)", 1).cast("int"),
            "filename": _name(),
            "fog_label_text": mapped(F.col("fog_label"), MULTIMODAL_TEXT),
        }
    ).drop("path")


def competition(spark: SparkSession, root: str, fail_fast: bool | None = None, subset: str | None = None, dataset_type: str | None = None) -> DataFrame:
    """Files name their own columns and are read together, aligned by name.

    A file without the three event flags is left out (or raises, if failing fast).
    """
    files = list_files(spark, root, f"{subset or '*'}/{dataset_type or '*'}/*.csv")
    lines = _split_lines(spark, files)
    headed = checkpointed(lines.filter("block = 0 AND nth = 0").filter(F.trim("line") != "").select(F.col("path").alias("__of"), F.col("line").alias("__head")))  # a row for each file
    heads = {r[0]: [n.strip() for n in r[0].split(",")] for r in headed.select("__head").distinct().orderBy("__head").collect()}  # a few
    lacking = [names for names in heads.values() if not set(EVENT_FLAGS) <= set(names)]
    if lacking and fail_fast:
        raise ValueError(f"a file lacks the event flags; it has {lacking[0]}")
    whole = {head: names for head, names in heads.items() if names not in lacking}
    if not whole:
        raise NoData(f"no file under {root} has the columns {EVENT_FLAGS}")
    every = list(dict.fromkeys(n for names in whole.values() for n in names))
    body = lines.join(_sent(headed.filter(F.col("__head").isin(*whole)), files), F.col("path") == F.col("__of")).drop("__of")

    def place(name: str) -> Column:
        """Where a file has the column, by its header; null if it has not."""
        found = F.lit(None).cast("int")
        for head, names in whole.items():
            if name in names:
                found = F.when(F.col("__head") == head, F.lit(names.index(name))).otherwise(found)
        return found

    width = F.element_at(F.create_map(*(F.lit(x) for head, names in whole.items() for x in (head, len(names)))), F.col("__head"))
    schema = struct(every)

    def fit(p: Column) -> Column:
        good = F.size(p) == width
        for f in schema:
            good = good & _reads(F.get(p, place(f.name)), f.dataType.simpleString())
        return good

    parts = F.split("line", ",")
    read = _placed(body, files, _once(parts, fit), True, LAYOUTS["competition"].fail_fast if fail_fast is None else fail_fast).withColumn("__p", parts)
    out = read.select("path", "pos", *(_value(F.get("__p", place(f.name)), f.dataType.simpleString()).alias(f.name) for f in schema))
    return out.withColumns(
        {
            "file_id": F.regexp_replace(_name(), r"\.csv$", ""),
            "dataset_type": _parent(2),
            "subset": _parent(3),
            "filename": _name(),
            "fog_any": any_flag(*(F.col(c) for c in EVENT_FLAGS)),
        }
    ).drop("path")


def competition_file(spark: SparkSession, root: str, file_id: str) -> DataFrame:
    """One file by its id; of several subsets train counts before test and unlabeled."""
    for subset in ("train", "test", "unlabeled"):
        try:
            found = list_files(spark, root, f"{subset}/*/{file_id}.csv")
        except NoData:
            continue
        kind = found[0].rsplit("/", 2)[-2]
        return competition(spark, root, subset=subset, dataset_type=kind).filter(F.col("file_id") == file_id)
    raise NoData(f"no file {file_id} under {root}")


#: Readers by layout, lower case. Further names are added with ``register``.
READERS: dict[str, Callable[..., DataFrame]] = {
    "ankle_thigh_trunk": ankle_thigh_trunk,
    "lower_back": lower_back,
    "both_feet": both_feet,
    "multimodal": multimodal,
    "competition": competition,
}


def register(name: str, reader: Callable[..., DataFrame]) -> None:
    """Make a reader (or an existing one under another name) known to ``load_dataset``."""
    READERS[name.lower()] = reader


def load_dataset(spark: SparkSession, kind: str, root: str, **options) -> DataFrame:
    """A dataset by name, in any case."""
    reader = READERS.get(kind.lower())
    if reader is None:
        raise ValueError(f"unknown dataset {kind!r}; known: {sorted(READERS)}")
    return reader(spark, root, **options)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A saved dataset by its extension (csv with a header, or parquet)."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "csv":
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    if kind in ("pkl", "pickle"):
        raise ValueError("pickled frames have no distributed reader; save the dataset as parquet")
    raise ValueError(f"cannot read {path!r}: use .csv or .parquet")


def metadata(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """An optional metadata table (csv with a header), all strings; None if the file is missing."""
    path = f"{root.rstrip('/')}/{name}"
    return spark.read.option("header", True).csv(path) if exists(spark, path) else None


#: Label columns, by priority.
LABEL_COLUMNS = ["fog_label", "freezing_flag", "annotation", "fog_any"]


def label_column(df: DataFrame) -> str:
    for c in LABEL_COLUMNS:
        if c in df.columns:
            return c
    raise ValueError(f"none of {LABEL_COLUMNS} is a column")

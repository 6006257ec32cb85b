"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed, ensure_checkpoint_dir

__all__ = ["checkpointed", "ensure_checkpoint_dir", "free_name", "give_back", "id_bucket", "parts_for", "read", "written"]

#: Narrow rows that make a partition of their own.
ROWS_A_PART = 100_000


def parts_for(rows: int, a_part: int = ROWS_A_PART) -> int:
    """Partitions that so many rows are worth; for ``coalesce``, so large tables stay as they are."""
    return 1 + rows // a_part


def written(df: DataFrame, a_part: int = ROWS_A_PART) -> DataFrame:
    """``df`` checkpointed, in no more partitions than its rows are worth.

    For tables that many small shuffles follow: a shuffle from n partitions
    into m leaves files for each of the n and reads m times n stretches of them.
    """
    out = checkpointed(df)
    return out.coalesce(parts_for(out.count(), a_part))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_bucket(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids give null."""
    return F.crc32(F.col(doc_id).cast("string")) % F.lit(folds)


def give_back() -> None:
    """Give memory that a task has freed back to the machine.

    Python workers outlive their tasks: what their allocators keep of one
    stage's peak adds to the next one's.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that does not clash (case-insensitively) with those of ``df``."""
    taken = {c.lower() for c in df.columns}
    name = wanted
    while name.lower() in taken:
        name += "_"
    return name

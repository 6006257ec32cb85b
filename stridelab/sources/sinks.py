"""Writers. Everything between stages is Parquet, partitioned where it is pruned."""

from __future__ import annotations

from pyspark.sql import DataFrame


def save_dataset(df: DataFrame, path: str, kind: str = "csv", mode: str = "overwrite") -> str:
    """Save as csv or parquet; the path gets the extension it lacks."""
    if kind not in ("csv", "parquet"):
        raise ValueError(f"unknown format {kind!r}: use csv or parquet")
    target = path if path.endswith(f".{kind}") else f"{path}.{kind}"
    writer = df.write.mode(mode)
    if kind == "csv":
        writer.option("header", True).csv(target)
    else:
        writer.parquet(target)
    return target


def save_folds(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Windows or features of all folds in one table; a reader of one fold reads only that fold's files."""
    df.write.mode(mode).partitionBy("fold", "role").parquet(path)


def save_results(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Results, one folder per classifier."""
    df.write.mode(mode).partitionBy("classifier").option("header", True).csv(path)

"""All registered queries and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package
from . import raw, relational, signals  # noqa: F401 - importing registers their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def shipped(query):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return query(spark, sf_dir)

        return run

    return {name: shipped(q) for name, q in relational.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(relational.ORACLES)

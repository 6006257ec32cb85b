"""Every registered query against its DuckDB statement; the rest for rows and range."""

from __future__ import annotations

import pytest

from stridelab.plans import queries as core
from tests.oracle import compare, connect

QUERIES, ORACLES = core.queries(), core.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_its_sql(spark, sf_dir, con, name):
    assert compare(QUERIES[name](spark, sf_dir), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    assert rows
    if name.startswith("model_"):
        assert {r.y for r in rows} == {0, 1} and all(r.score is not None for r in rows)
        assert all(0 <= r.score <= 1 for r in rows)


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["multiclass_label", "n_windows", "mean", "std", "rms"] and df.count() > 0


def test_registration_is_consistent():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(QUERIES) <= set(__spark_entry__.queries())

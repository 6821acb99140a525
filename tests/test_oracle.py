"""Every registered query with a SQL oracle matches DuckDB on the driver tables."""

import pytest

import __spark_entry__ as E
from evenkeel.plans.compare import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, name):
    ok, rows, detail = compare(spark, name, E.queries()[name], E.oracle_sql()[name], SF)
    assert ok, detail


def test_every_oracle_has_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "dpd" in df.columns

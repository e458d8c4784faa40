"""Every registered query on the smallest tables against its SQL, run by DuckDB."""

import pytest

import __spark_entry__ as entry
from oracle import connect, difference, duck_result, spark_result

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, name):
    got = spark_result(entry.queries()[name](spark, SF_DIR))
    assert got[1]
    assert difference(got, duck_result(duck, entry.oracle_sql()[name])) is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    df = entry.queries()[name](spark, SF_DIR)
    assert df.columns and df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0

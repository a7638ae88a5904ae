"""Every query with SQL equals DuckDB, row for row."""

import sys

import __spark_entry__
import pytest

sys.path.insert(0, __file__.rpartition("/")[0])
import oracle  # noqa: E402

SQL = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.duck(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert oracle.differences(spark, sf_dir, __spark_entry__.queries()[name], SQL[name], con) is None


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0

"""Every registered query against its SQL in DuckDB."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in SQL:
        assert compare(con, df, SQL[name]) is None
    else:
        assert df.count() > 0


def test_entry_is_lazy_and_stable(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "doc_id" and "markdown" in df.columns
    assert df.count() == 50

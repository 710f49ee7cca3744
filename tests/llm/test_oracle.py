"""The registered queries of this folder that SQL can express, against DuckDB."""

import pytest

from folioweave.llm import queries
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in queries.QUERIES.items() if sql))
def test_query(spark, name):
    fn, sql = queries.QUERIES[name]
    assert compare(connect(SF), fn(spark, SF), sql) is None

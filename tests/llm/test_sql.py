import pytest

from lignum.llm import queries
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_agrees_with_sql(spark, name):
    assert compare(spark, "/root/testdata/sf0.01", name, queries.QUERIES[name], queries.ORACLE_SQL[name]) > 0

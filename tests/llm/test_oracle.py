import pytest

from tests.oracle import compare
from yieldloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_rows_equal_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_queries_without_sql_run(spark, name):
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.count() > 0

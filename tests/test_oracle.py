import pytest

from tests.oracle import compare
from yieldloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_rows_equal_sql(spark, name):
    compare(spark, registry.QUERIES[name], registry.ORACLE[name])

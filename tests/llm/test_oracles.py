import pytest

from sagaframe.llm import registry
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    compare(registry.queries()[name](spark, sf_dir), connect(sf_dir), registry.oracle_sql()[name])

import pytest

import __spark_entry__ as entry
from sagaframe import plans

from .oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, con, name):
    compare(plans.queries()[name](spark, sf_dir), con, plans.oracle_sql()[name])
    assert not name.startswith("tool_") or con.sql(plans.oracle_sql()[name]).fetchall(), "an empty result proves nothing"


@pytest.mark.parametrize("name", sorted(plans.queries().keys() - plans.oracle_sql().keys()))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert plans.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

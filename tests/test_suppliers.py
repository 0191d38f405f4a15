"""Suppliers on two sides of a nation, of whom there are as many pairs as the square of their number."""

import datetime
import itertools

import pytest

from sagaframe import storage
from sagaframe.operators import graph as G
from sagaframe.plans import graph_queries
from sagaframe.plans import model as M


@pytest.fixture
def odd_tables(spark, tmp_path, sf_dir):
    """Suppliers of few nations, with nulls and a key that comes twice, and items with nulls; the other tables are the small ones."""
    for t in "region nation customer part orders".split():
        M.table(spark, sf_dir, t).write.parquet(f"file://{tmp_path}/{t}.parquet")
    nan = float("nan")
    rows = [(k, f"s{k}", nation, money) for k, (nation, money) in enumerate(itertools.product((1, 2, None), (-3.0, 0.0, 5.0, None, nan, -1.0)))]
    rows += [(3, "again", 1, -8.0), (None, "none", 1, -8.0), (30, "alone", 7, -1.0), (31, "one", 8, 1.0), (32, "two", 8, 2.0), (40, "low", 9, -1.0), (41, "high", 9, 1.0)]
    spark.createDataFrame(rows, "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"file://{tmp_path}/supplier.parquet")
    day = datetime.datetime(1995, 3, 1)
    sold = [(1, p, s, 1.0, day) for p, s in ((1, 2), (1, 2), (2, 40), (None, 41), (3, None), (4, 99))]
    spark.createDataFrame(sold, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double, l_shipdate timestamp").write.parquet(f"file://{tmp_path}/lineitem.parquet")
    return rows, f"file://{tmp_path}"


def test_suppliers_on_two_sides_are_paired_in_tasks_by_pairs(spark, odd_tables, monkeypatch):
    rows, d = odd_tables
    monkeypatch.setattr(storage, "TASK_ROWS", 1)
    found = M.edges(spark, d).filter("rel_type = 'OPPOSED_TO'").select("src", "tgt")
    want = [(f"S:{a[0]}", f"S:{b[0]}") for a in rows for b in rows if None not in (a[0], b[0], a[2], b[2], a[3], b[3]) and a[2] == b[2] and a[0] < b[0] and (a[3] < 0) != (b[3] < 0)]
    assert len(want) > 15 and sorted(map(tuple, found.collect())) == sorted(want)
    assert found.rdd.getNumPartitions() >= len(want)


def test_types_of_the_suppliers_edges_are_found_without_the_edges(spark, odd_tables):
    d = odd_tables[1]
    found = M.relations_of_suppliers(spark, d)
    want = G.undirected(M.edges(spark, d)).filter("src LIKE 'S:%'").select("src", "rel_type").distinct()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    text = graph_queries.compare_rel_types(spark, d)._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" not in text and "CartesianProduct" not in text

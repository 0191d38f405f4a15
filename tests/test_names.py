"""Edges bound by sets of names that are broadcast."""

import pytest

from sagaframe import storage
from sagaframe.operators import graph as G

ODD = ["", "a", "7", "0", "00", "07", "a0", "a00", "a07", "a7", "a 7", "a7 ", "a7\n", "x9223372036854775807", "x9223372036854775808", "x-5", "x5", "x٣", "é12", "a63", "a64", "a4095", "a4096", "12a12", "a1.5", "a+5"]
TYPES = "src string, rel_type string, tgt string, chapter int"


@pytest.fixture
def labels(monkeypatch):
    """Labels of all tables that graph operators write."""
    found = []
    monkeypatch.setattr(G, "written", lambda df, label: found.append(label) or storage.written(df, label))
    return found


def test_names_with_numbers_are_bits_in_blocks(spark, monkeypatch):
    have = {*ODD[::2], *(f"n{k}" for k in range(0, 9000, 3))}
    asked = [*ODD, *(x + "0" for x in ODD), *("0" + x for x in ODD), *(f"n{k}" for k in range(9100)), None]
    names = storage.written(spark.createDataFrame([(x,) for x in [*have, *have, None]], "name string"), "names")
    rows = storage.written(spark.createDataFrame(list(enumerate(asked)), "k int, name string"), "rows")
    monkeypatch.setattr(storage, "BROADCAST_NAMES", 1000)
    few = storage.name_set(names)
    assert few.columns != ["_name"] and few.count() < 30
    want = {k for k, x in enumerate(asked) if x in have}
    assert sorted(r.k for r in storage.having(rows, "name", names, 1).collect()) == sorted(want)
    assert sorted(r.k for r in storage.having(rows, "name", names, 1, "left_anti").collect()) == sorted(set(range(len(asked))) - want)
    monkeypatch.setattr(storage, "BROADCAST_NAMES", 100)
    assert storage.name_set(names) is None  # too many blocks by then


def test_edges_are_bound_without_being_written_or_shuffled(spark, monkeypatch, labels):
    edges = spark.createDataFrame([(f"a{k}", "R", f"b{k % 7}", 1) for k in range(6000)] + [(None, "R", "a1", 1), ("c", "R", "a2", None)], TYPES)
    nodes = spark.createDataFrame([(f"a{k}",) for k in range(5000)] * 2 + [(f"b{k}",) for k in range(6)], "name string")
    want = [sorted(map(repr, f(edges, nodes).collect())) for f in (G.bind, G.dangling)]
    assert len(want[0]) == 5000 - 714 and len(want[1]) == 1000 + 857 + 2
    monkeypatch.setattr(storage, "BROADCAST_NAMES", 1000)
    for f, w in zip((G.bind, G.dangling), want):
        found = f(edges, nodes)
        assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(repr, found.collect())) == w
    assert "edges" not in labels

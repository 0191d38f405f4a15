"""What must not grow with the square of the input, or in one task: rows of levels, partitions of shuffles."""

import random

import pytest

from sagaframe import storage
from sagaframe.operators import bm25
from sagaframe.operators import graph as G
from sagaframe.plans import graph_queries, ledger_queries
from sagaframe.plans import model as M
from sagaframe.streaming import changes

HUB = [(f"c{k:03}", "M", "hub", None) for k in range(300)] + [("hub", "R", "end", None)]
TYPES = "src string, rel_type string, tgt string, chapter int"


@pytest.fixture
def rows_of_levels(monkeypatch):
    """Row counts of all levels that are written."""
    found = []

    def written(df, label):
        out = storage.written(df, label)
        if label == "level":
            found.append(out.count())
        return out

    monkeypatch.setattr(G, "written", written)
    return found


def test_paths_over_a_hub_do_not_pair_starts_with_its_neighbours(spark, rows_of_levels):
    pairs = spark.createDataFrame([(f"c{k:03}", "c299") for k in range(50)] + [("c000", "end")], "start string, end string")
    found = {(r.start, r.end): r.path for r in G.shortest_paths(spark.createDataFrame(HUB, TYPES), pairs, 4).collect()}
    assert found == {(f"c{k:03}", "c299"): [f"c{k:03}", "M", "hub", "M", "c299"] for k in range(50)} | {("c000", "end"): ["c000", "M", "hub", "R", "end"]}
    assert max(rows_of_levels) <= 700  # two ends with the hub's 301 neighbours; 50 starts with each were 15,000


def test_neighbours_over_a_hub_follow_a_few_of_them(spark, rows_of_levels):
    starts = spark.createDataFrame([(f"c{k:03}",) for k in range(50)], "start string")
    found = G.neighbours(spark.createDataFrame(HUB, TYPES), starts, 3, 5).orderBy("start", "rank").collect()
    assert [r.end for r in found if r.start == "c001"] == ["hub", "c000", "c002", "c003", "c004"]
    assert max(rows_of_levels) <= 50 * 6


def test_nearest_is_the_head_of_reach(spark):
    dice = random.Random(5)
    rows = [(f"n{dice.randrange(25)}", dice.choice("PQ"), f"n{dice.randrange(25) if dice.random() < 0.8 else 0}", None) for _ in range(60)]
    edges = storage.written(spark.createDataFrame(rows, TYPES).select("src", "rel_type", "tgt"), "edges")
    starts = spark.createDataFrame([(f"n{k}",) for k in range(25)], "start string")
    every = [tuple(r) for r in G.reach(edges, starts, 3).select("start", "hops", "node", "path").collect()]
    for limit in (1, 4):
        want = {s: sorted(r for r in every if r[0] == s)[: limit + 1] for s in {r[0] for r in every}}
        got = [tuple(r) for r in G.nearest(edges, starts, 3, limit).select("start", "hops", "node", "path").collect()]
        assert sorted(got) == sorted(r for rows in want.values() for r in rows)


def test_shuffles_of_the_model_have_tasks_by_rows(spark, sf_dir, monkeypatch):
    before = M.edges(spark, sf_dir).filter("rel_type = 'MOTIVATED_BY'").rdd.getNumPartitions()
    monkeypatch.setattr(storage, "TASK_ROWS", 200)
    assert M.edges(spark, sf_dir).filter("rel_type = 'MOTIVATED_BY'").rdd.getNumPartitions() >= max(20, before + 1)


def test_causal_pairs_are_made_of_single_rows(spark, sf_dir):
    plans = []
    keep = G.shortest_paths
    try:
        G.shortest_paths = lambda edges, pairs, hops: plans.append(pairs) or keep(edges, pairs, hops)
        graph_queries.causal_path(spark, sf_dir)
    finally:
        G.shortest_paths = keep
    text = plans[0]._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Aggregate [tgt") == 1, text  # the last character of each motive comes before the join


def test_ends_of_edges_are_looked_up_in_tasks_by_rows(spark, monkeypatch):
    edges = spark.createDataFrame([(f"a{k}", "R", f"b{k % 7}", 1) for k in range(100)] + [(None, "R", "a1", 1)], TYPES)
    nodes = spark.createDataFrame([(f"a{k}",) for k in range(99)] * 2 + [(f"b{k}",) for k in range(6)], "name string")
    want = [sorted(map(repr, f(edges, nodes).collect())) for f in (G.bind, G.dangling)]
    assert len(want[0]) == 99 - 14 and len(want[1]) == 1 + 1 + 14
    monkeypatch.setattr(storage, "BROADCAST_NAMES", 3)
    monkeypatch.setattr(storage, "TASK_ROWS", 5)
    assert [sorted(map(repr, f(edges, nodes).collect())) for f in (G.bind, G.dangling)] == want
    assert G.bind(edges, nodes).rdd.getNumPartitions() == 21


def test_postings_and_scores_have_tasks_by_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"all word{k} word{k} more{k % 3}") for k in range(40)], "id int, text string")
    asked = spark.createDataFrame([(0, "all word7"), (1, "more1")], "id int, text string")

    def found():
        return [s for s in bm25.search(bm25.index(docs, "id", "text"), asked, "id", "text")]

    want = [sorted((r.q, r.id, round(r.score, 9)) for r in s.collect()) for s in found()]
    monkeypatch.setattr(storage, "TASK_ROWS", 5)
    both = found()
    assert [sorted((r.q, r.id, round(r.score, 9)) for r in s.collect()) for s in both] == want
    assert all(s.rdd.getNumPartitions() >= 11 for s in both)


def test_a_folder_of_files_is_few_folders_and_is_listed_once(spark, tmp_path):
    root = f"file://{tmp_path}/files"
    rows = spark.range(300).selectExpr("concat(id, '/chapter1_dialogue.txt') AS file_path", "string(id) AS task_id", "concat('text ', id) AS content")
    for some in (rows, rows.filter("id < 200")):
        ledger_queries._write_files(some, root)
        there = [p for p in (tmp_path / "files").rglob("*") if p.is_file() and not p.name.startswith(".")]
        assert len(there) == some.count() and len({p.parent for p in there}) <= ledger_queries._FOLDERS
    assert sorted(p.read_text() for p in there) == sorted(f"text {k}\n" for k in range(200))
    found = changes.found_in(spark, root, "*.txt")
    assert {r.file_path for r in changes.listing(found, ledger_queries._NAMED).collect()} == {f"{k}/chapter1_dialogue.txt" for k in range(200)}
    next(p for p in there if p.name.startswith("7~")).unlink()  # gone between the listing and the reading
    assert found.select("content").filter("content IS NOT NULL").count() == 199

"""The query tools, asked about one entity over the whole graph and all chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents
from ..tools import Memory
from . import model as M
from .graph_queries import _CAUSAL, _CHAIN, _paths_sql
from .registry import query

A, B = "C:100", "C:50"


def memory(spark, d):
    return Memory(M.nodes(spark, d), M.edges(spark, d), M.aliases(spark))


@query("tool_lookup_knowledge", f"""SELECT src, rel_type, tgt, target_label, direction FROM (SELECT u.src, u.rel_type, u.tgt, n.label AS target_label, u.direction, row_number() OVER (ORDER BY u.rel_type, u.tgt, u.direction, u.chapter NULLS LAST) AS r
    FROM undirected u JOIN node n ON u.tgt = n.name WHERE u.src = '{A}') WHERE r <= 25 UNION ALL SELECT * FROM (SELECT name, NULL, NULL, label, NULL FROM node WHERE name = '{A}' ORDER BY label LIMIT 1)""", "undirected", "node")  # fmt: skip
def tool_lookup_knowledge(spark, d):
    return memory(spark, d).lookup_knowledge(A).select("src", "rel_type", "tgt", "target_label", "direction")


_PAIR = f"SELECT '{A}' AS start, '{B}' AS \"end\""


@query("tool_find_connection", _paths_sql(_PAIR, "edge", 4) + f" SELECT p.start, p.\"end\", {_CHAIN} AS chain, hops FROM p JOIN reached r ON p.start = r.start AND p.\"end\" = r.node", "edge")
def tool_find_connection(spark, d):
    return memory(spark, d).find_connection(A, B).select("start", "end", "chain", "hops")


@query("tool_get_timeline", f"SELECT src AS entity, tgt AS item, rel_type, n.chapter FROM edge JOIN node n ON tgt = n.name AND n.label = 'Event' WHERE src = '{A}' AND rel_type = 'INVOLVED_IN' UNION ALL SELECT src, tgt, rel_type, chapter FROM edge WHERE src = '{A}' AND chapter IS NOT NULL AND NOT EXISTS (SELECT 1 FROM edge e WHERE e.src = '{A}' AND e.rel_type = 'INVOLVED_IN')", "edge", "node")
def tool_get_timeline(spark, d):
    return memory(spark, d).get_timeline(A).select("entity", "item", "rel_type", "chapter")


@query("tool_trace_causality", _paths_sql(f"SELECT '{A}' AS start", _CAUSAL, 3) + f" SELECT start, node AS \"end\", {_CHAIN} AS chain, hops FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY hops, node) AS k FROM reached WHERE hops > 0) WHERE k <= 15", "edge")
def tool_trace_causality(spark, d):
    return memory(spark, d).trace_causality(A).select("start", "end", "chain", "hops")


@query("tool_compare_entities", f"""WITH v AS (SELECT name, unnest(['label', 'description', 'chapter']) AS key, unnest([label, description, chapter::VARCHAR]) AS value, 'property' AS kind FROM node WHERE name IN ('{A}', '{B}')
      UNION ALL SELECT DISTINCT src, rel_type, 'yes', 'relation' FROM undirected WHERE src IN ('{A}', '{B}')),
    w AS (SELECT kind, key, max(substr(value, 1, 50)) FILTER (WHERE name = '{A}') AS l, max(substr(value, 1, 50)) FILTER (WHERE name = '{B}') AS r FROM v WHERE value IS NOT NULL GROUP BY kind, key)
    SELECT kind, key, coalesce(l, '-') AS left_value, coalesce(r, '-') AS right_value, CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN 'shared' WHEN r IS NULL THEN 'only_a' ELSE 'only_b' END AS side FROM w""", "node", "undirected")  # fmt: skip
def tool_compare_entities(spark, d):
    return memory(spark, d).compare_entities(A, B)


@query("tool_explore_subgraph", _paths_sql(f"SELECT '{A}' AS start", "(SELECT * FROM edge WHERE rel_type IN ('MEMBER_OF', 'INVOLVED_IN'))", 2) + " SELECT start, node, hops::INT AS dist FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY hops, node) AS k FROM reached) WHERE k <= 20", "edge")
def tool_explore_subgraph(spark, d):
    return memory(spark, d).explore_subgraph(A, 2, 20, "MEMBER_OF, INVOLVED_IN")[0]


@query("tool_search_memory")
def tool_search_memory(spark, d):
    """A question to all chunks, of those that mention the asker; tests hold it against a plain search."""
    chunks = documents.enrich(documents.order_chunks(documents.split_scenes(M.dialogues(spark, d))), M.aliases(spark))
    found = Memory(M.nodes(spark, d), M.edges(spark, d), M.aliases(spark), chunks).search_memory("what is the and of this", ["asker"], "time", 10)
    return found.select("id", F.round("score", 6).alias("score"), "event_order")

"""Queries over the typed graph: building it by merges, and asking it."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import stored_graph as SG
from ..sources import files
from ..sources.versions import Store
from ..storage import shared_dir, written
from . import model as M
from .registry import ORACLES, query


def _starts(spark, d):
    """The entities that traversals start from: every customer whose key is divisible by 100."""
    return M.table(spark, d, "customer").filter("c_custkey % 100 = 0").select(F.concat(F.lit("C:"), F.col("c_custkey").cast("string")).alias("start"))


_STARTS = "SELECT 'C:' || c_custkey AS start FROM customer WHERE c_custkey % 100 = 0"


@query("entity_lookup", "SELECT label, name, description FROM node WHERE name IN (SELECT 'N:' || n_nationkey FROM nation UNION ALL SELECT 'C:' || c_custkey FROM customer WHERE c_custkey % 100 = 0)", "node")
def entity_lookup(spark, d):
    wanted = _starts(spark, d).select(F.col("start").alias("name")).unionByName(M.table(spark, d, "nation").select(F.concat(F.lit("N:"), F.col("n_nationkey").cast("string")).alias("name")))
    return M.nodes(spark, d).join(wanted, "name", "left_semi").select("label", "name", "description")


@query("entity_info", "SELECT name, min(label) AS label, arg_min(description, label) AS description FROM node GROUP BY name", "node")
def entity_info(spark, d):
    return M.nodes(spark, d).groupBy("name").agg(F.min("label").alias("label"), F.min_by("description", "label").alias("description"))


@query("all_relations", "SELECT u.src, u.rel_type, u.tgt, u.direction, n.label AS target_label FROM undirected u JOIN node n ON u.tgt = n.name WHERE u.rel_type IN ('MEMBER_OF', 'LOCATED_AT', 'OPPOSED_TO')", "undirected", "node")
def all_relations(spark, d):
    some = G.undirected(M.edges(spark, d)).filter(F.col("rel_type").isin("MEMBER_OF", "LOCATED_AT", "OPPOSED_TO"))
    return some.join(M.nodes(spark, d).select(F.col("name").alias("tgt"), F.col("label").alias("target_label")), "tgt").select("src", "rel_type", "tgt", "direction", "target_label")


@query("relations_of", f"SELECT * EXCLUDE (r) FROM (SELECT u.src, u.rel_type, u.tgt, n.label AS target_label, u.direction, u.chapter, row_number() OVER (PARTITION BY u.src ORDER BY u.rel_type, u.tgt, u.direction, u.chapter NULLS LAST) AS r FROM undirected u JOIN node n ON u.tgt = n.name WHERE u.src IN ({_STARTS})) WHERE r <= 20", "undirected", "node")
def relations_of(spark, d):
    return G.relations_of(M.edges(spark, d), M.nodes(spark, d), _starts(spark, d)).drop("rank")


@query("render_relations", "SELECT src, count(*) AS n, string_agg(DISTINCT CASE rel_type WHEN 'MEMBER_OF' THEN '成员' WHEN 'LOCATED_AT' THEN '所在地' WHEN 'MOTIVATED_BY' THEN '信仰/动机' WHEN 'INVOLVED_IN' THEN '参与' ELSE rel_type END, '、' ORDER BY CASE rel_type WHEN 'MEMBER_OF' THEN '成员' WHEN 'LOCATED_AT' THEN '所在地' WHEN 'MOTIVATED_BY' THEN '信仰/动机' WHEN 'INVOLVED_IN' THEN '参与' ELSE rel_type END) AS labels FROM edge WHERE starts_with(src, 'C:') GROUP BY src", "edge")
def render_relations(spark, d):
    texts = F.create_map(*[F.lit(x) for pair in G.RELATION_TEXT.items() for x in pair])
    named = M.edges(spark, d).filter(F.col("src").startswith("C:")).withColumn("t", F.coalesce(texts[F.col("rel_type")], F.col("rel_type")))
    return named.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("t")), "、").alias("labels"))


@query("history", "SELECT src, rel_type, tgt, chapter, r FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY chapter NULLS LAST, rel_type, tgt) AS r FROM edge WHERE starts_with(src, 'C:')) WHERE r <= 10", "edge")
def history(spark, d):
    """The first ten outgoing edges of every character by chapter, those without one last."""
    order = Window.partitionBy("src").orderBy(F.asc_nulls_last("chapter"), "rel_type", "tgt")
    return M.edges(spark, d).filter(F.col("src").startswith("C:")).withColumn("r", F.row_number().over(order).cast("bigint")).filter("r <= 10")


@query("faction_members", "SELECT tgt AS faction, count(*) AS members, min(src) AS first_member FROM edge JOIN node ON tgt = name AND label = 'Faction' WHERE rel_type = 'MEMBER_OF' GROUP BY tgt", "edge", "node")
def faction_members(spark, d):
    factions = M.nodes(spark, d).filter("label = 'Faction'").select(F.col("name").alias("tgt"))
    return M.edges(spark, d).filter("rel_type = 'MEMBER_OF'").join(factions, "tgt").groupBy(F.col("tgt").alias("faction")).agg(F.count(F.lit(1)).alias("members"), F.min("src").alias("first_member"))


@query("entity_faction", "SELECT src AS entity, tgt AS faction FROM edge WHERE rel_type = 'MEMBER_OF'", "edge")
def entity_faction(spark, d):
    return M.edges(spark, d).filter("rel_type = 'MEMBER_OF'").select(F.col("src").alias("entity"), F.col("tgt").alias("faction"))


# the model drops nothing, so every tenth supplier is taken for unknown here
_KNOWN = "(SELECT name FROM node WHERE NOT (starts_with(name, 'S:') AND coalesce(try_cast(substr(name, 3) AS BIGINT), 1) % 10 = 0))"


def _known(spark, d):
    name = F.col("name")
    return M.nodes(spark, d).filter(~(name.startswith("S:") & (F.substring_index(name, ":", -1).try_cast("bigint") % 10 == 0)) | ~name.startswith("S:"))


@query("edge_bind", f"SELECT rel_type, count(*) AS n FROM edge WHERE src IN {_KNOWN} AND tgt IN {_KNOWN} GROUP BY rel_type", "edge", "node")
def edge_bind(spark, d):
    return G.counts_by(G.bind(M.edges(spark, d), _known(spark, d)), "rel_type")


@query("dangling_edges", f"SELECT missing, rel_type, count(*) AS n FROM (SELECT 'src' AS missing, rel_type FROM edge WHERE src NOT IN {_KNOWN} UNION ALL SELECT 'tgt', rel_type FROM edge WHERE tgt NOT IN {_KNOWN}) GROUP BY ALL", "edge", "node")
def dangling_edges(spark, d):
    return G.dangling(M.edges(spark, d), _known(spark, d)).groupBy("missing", "rel_type").agg(F.count(F.lit(1)).alias("n"))


def _paths_sql(pairs: str, edges: str, hops: int) -> str:
    """Level by level, with one least path for each start and node."""
    out = [f"p AS ({pairs}), s AS (SELECT DISTINCT src, rel_type, tgt FROM (SELECT src, rel_type, tgt FROM {edges} UNION ALL SELECT tgt, rel_type, src FROM {edges} WHERE src <> tgt))", 'l0 AS (SELECT DISTINCT start, start AS node, [start] AS path FROM p)']
    for k in range(1, hops + 1):
        seen = " UNION ALL ".join(f"SELECT start, node FROM l{j}" for j in range(k))
        out.append(f"l{k} AS MATERIALIZED (SELECT l.start, s.tgt AS node, min(list_concat(l.path, [s.rel_type, s.tgt])) AS path FROM l{k - 1} l JOIN s ON l.node = s.src WHERE (l.start, s.tgt) NOT IN ({seen}) GROUP BY l.start, s.tgt)")
    every = " UNION ALL ".join(f"SELECT *, {k}::BIGINT AS hops FROM l{k}" for k in range(hops + 1))
    return "WITH " + ", ".join(out) + f", reached AS ({every})"


_CHAIN = "array_to_string(list_transform(path, lambda x, i: CASE WHEN i % 2 = 0 THEN '-[' || x || ']->' ELSE x END), ' ')"


@query("shortest_path", _paths_sql("SELECT 'C:' || c_custkey AS start, 'S:' || (c_custkey // 100 % 10 + 1) AS \"end\" FROM customer WHERE c_custkey % 100 = 0", "edge", 3) + f" SELECT p.start, p.\"end\", {_CHAIN} AS chain, hops FROM p JOIN reached r ON p.start = r.start AND p.\"end\" = r.node", "edge")
def shortest_path(spark, d):
    return G.shortest_paths(M.edges(spark, d), _pairs(spark, d), 3).select("start", "end", G.chain_text(F.col("path")).alias("chain"), "hops")


def _pairs(spark, d):
    shop = F.floor(F.col("c_custkey") / 100) % 10 + 1
    return M.table(spark, d, "customer").filter("c_custkey % 100 = 0").select(F.concat(F.lit("C:"), F.col("c_custkey").cast("string")).alias("start"), F.concat(F.lit("S:"), shop.cast("string")).alias("end"))


_NO_PLACES = "(SELECT * FROM edge WHERE src NOT IN (SELECT name FROM node WHERE label = 'Place') AND tgt NOT IN (SELECT name FROM node WHERE label = 'Place'))"


@query("shortest_path_without_places", _paths_sql("SELECT 'C:' || c_custkey AS start, 'S:' || (c_custkey // 100 % 10 + 1) AS \"end\" FROM customer WHERE c_custkey % 100 = 0", _NO_PLACES, 3) + f" SELECT p.start, p.\"end\", {_CHAIN} AS chain, hops FROM p JOIN reached r ON p.start = r.start AND p.\"end\" = r.node", "edge", "node")
def shortest_path_without_places(spark, d):
    """No node of a path may be a place."""
    places = M.nodes(spark, d).filter("label = 'Place'")
    return G.shortest_paths(M.edges(spark, d), _pairs(spark, d), 3, places).select("start", "end", G.chain_text(F.col("path")).alias("chain"), "hops")


_CAUSAL = "(SELECT * FROM edge WHERE rel_type IN ('LEADS_TO', 'MOTIVATED_BY'))"
_BRAND_PAIRS = "SELECT a.src AS start, max(b.src) AS \"end\" FROM edge a JOIN edge b ON a.tgt = b.tgt WHERE a.rel_type = 'MOTIVATED_BY' AND b.rel_type = 'MOTIVATED_BY' AND a.src IN (STARTS) GROUP BY a.src".replace("STARTS", _STARTS)


def _causal(spark, d):
    return M.edges(spark, d).filter(F.col("rel_type").isin("LEADS_TO", "MOTIVATED_BY"))


@query("causal_path", _paths_sql(_BRAND_PAIRS, _CAUSAL, 4) + f" SELECT p.start, p.\"end\", {_CHAIN} AS chain, hops FROM p JOIN reached r ON p.start = r.start AND p.\"end\" = r.node", "edge")
def causal_path(spark, d):
    """From characters to the last one with the same motive."""
    causal = written(_causal(spark, d), "causal")
    m = causal.filter("rel_type = 'MOTIVATED_BY'").select("src", "tgt")
    some = m.join(_starts(spark, d), F.col("src") == F.col("start")).select("start", "tgt")
    last = m.groupBy("tgt").agg(F.max("src").alias("end"))  # of each motive, so that no pairs of characters are made
    pairs = some.join(last, "tgt").groupBy("start").agg(F.max("end").alias("end"))
    return G.shortest_paths(causal, pairs, 4).select("start", "end", G.chain_text(F.col("path")).alias("chain"), "hops")


@query("causal_neighbors", _paths_sql(_STARTS, _CAUSAL, 3) + f" SELECT start, node AS \"end\", {_CHAIN} AS chain, hops FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY hops, node) AS k FROM reached WHERE hops > 0) WHERE k <= 15", "edge")
def causal_neighbors(spark, d):
    return G.neighbours(_causal(spark, d), _starts(spark, d)).select("start", "end", G.chain_text(F.col("path")).alias("chain"), "hops")


@query("render_path", _paths_sql("SELECT src AS start, tgt AS \"end\" FROM edge WHERE rel_type = 'MOTIVATED_BY'", "(SELECT * FROM edge WHERE rel_type = 'MOTIVATED_BY')", 1) + f" SELECT p.start, {_CHAIN} AS chain FROM p JOIN reached r ON p.start = r.start AND p.\"end\" = r.node", "edge")
def render_path(spark, d):
    m = M.edges(spark, d).filter("rel_type = 'MOTIVATED_BY'")
    return G.shortest_paths(m, m.select(F.col("src").alias("start"), F.col("tgt").alias("end")), 1).select("start", G.chain_text(F.col("path")).alias("chain"))


_SUB = "(SELECT * FROM edge WHERE rel_type IN ('INVOLVED_IN', 'TEMPORAL_BEFORE', 'LEADS_TO'))"
_DIST = _paths_sql(_STARTS, _SUB, 2) + ", near AS (SELECT start, node, hops FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY hops, node) AS k FROM reached) WHERE k <= 20)"


def _subgraph(spark, d):
    some = M.edges(spark, d).filter(F.col("rel_type").isin("INVOLVED_IN", "TEMPORAL_BEFORE", "LEADS_TO"))
    return G.subgraph(some, _starts(spark, d), 2, 20)


@query("subgraph_nodes", _DIST + " SELECT start, node, hops::INT AS dist FROM near", "edge")
def subgraph_nodes(spark, d):
    return _subgraph(spark, d)[0]


@query("subgraph_edges", _DIST + f" SELECT DISTINCT a.start, e.src, e.rel_type, e.tgt FROM {_SUB} e JOIN near a ON e.src = a.node JOIN near b ON e.tgt = b.node AND a.start = b.start WHERE least(a.hops, b.hops) <= 1", "edge")
def subgraph_edges(spark, d):
    return _subgraph(spark, d)[1]


@query("subgraph_by_type", _DIST + " SELECT start, label, count(*) AS n, string_agg(node, ',' ORDER BY node) AS names FROM near JOIN node x ON node = x.name GROUP BY start, label", "edge", "node")
def subgraph_by_type(spark, d):
    labels = M.nodes(spark, d).select(F.col("name").alias("node"), "label")
    return _subgraph(spark, d)[0].join(labels, "node").groupBy("start", "label").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("node")), ",").alias("names"))


_TIME = """WITH ent AS (SELECT src AS entity FROM edge WHERE rel_type = 'MEMBER_OF' UNION SELECT 'O:' || o_orderkey FROM orders UNION SELECT 'S:' || s_suppkey FROM supplier),
    tb AS (SELECT src, tgt FROM edge WHERE rel_type = 'TEMPORAL_BEFORE'),
    walk AS (SELECT entity, entity AS item, 0 AS step FROM ent JOIN node ON entity = name WHERE label = 'Event' UNION ALL SELECT entity, tgt, step + 1 FROM walk JOIN tb ON item = src WHERE step < 5),
    l AS (SELECT entity, 1 AS layer, 'events' AS source, tgt AS item, rel_type, n.chapter, 0 AS step FROM ent JOIN edge ON entity = src JOIN node n ON tgt = n.name AND n.label = 'Event' WHERE rel_type = 'INVOLVED_IN'
      UNION ALL SELECT DISTINCT entity, 2, 'temporal', item, 'TEMPORAL_BEFORE', n.chapter, step FROM walk JOIN node n ON item = n.name WHERE entity IN (SELECT entity FROM walk WHERE step = 1)
      UNION ALL SELECT entity, 3, 'outgoing', tgt, rel_type, chapter, 0 FROM ent JOIN edge ON entity = src WHERE chapter IS NOT NULL
      UNION ALL SELECT entity, 4, 'incoming', src, rel_type, chapter, 0 FROM ent JOIN edge ON entity = tgt WHERE chapter IS NOT NULL),
    t AS (SELECT * FROM (SELECT *, min(layer) OVER (PARTITION BY entity) AS first FROM l) WHERE layer = first)"""


def _timeline(spark, d):
    e = M.edges(spark, d).filter("rel_type = 'MEMBER_OF'").select(F.col("src").alias("entity"))
    o = M.table(spark, d, "orders").select(F.concat(F.lit("O:"), F.col("o_orderkey").cast("string")).alias("entity"))
    s = M.table(spark, d, "supplier").select(F.concat(F.lit("S:"), F.col("s_suppkey").cast("string")).alias("entity"))
    return G.timeline(M.edges(spark, d), M.nodes(spark, d), e.unionByName(o).unionByName(s).distinct())


@query("timeline", _TIME + " SELECT entity, layer::INT AS layer, source, item, rel_type, chapter, step::INT AS step FROM t", "edge", "node")
def timeline(spark, d):
    return _timeline(spark, d)


@query("timeline_fallback", _TIME + " SELECT source, count(DISTINCT entity) AS entities, count(*) AS n FROM t GROUP BY source", "edge", "node")
def timeline_fallback(spark, d):
    return _timeline(spark, d).groupBy("source").agg(F.countDistinct("entity").alias("entities"), F.count(F.lit(1)).alias("n"))


@query("timeline_render", _TIME + " SELECT entity, item, chapter, chapter IS DISTINCT FROM lag(chapter) OVER (PARTITION BY entity ORDER BY chapter NULLS LAST, step, item) AS header FROM t WHERE source = 'events'", "edge", "node")
def timeline_render(spark, d):
    order = Window.partitionBy("entity").orderBy(F.asc_nulls_last("chapter"), "step", "item")
    return _timeline(spark, d).filter("source = 'events'").select("entity", "item", "chapter", (~F.col("chapter").eqNullSafe(F.lag("chapter").over(order))).alias("header"))


# -- comparing -------------------------------------------------------------------------------

_PROPS = "(SELECT c_custkey AS k, unnest(['name', 'nation', 'balance', 'segment']) AS prop, unnest([c_name, c_nationkey::VARCHAR, CASE WHEN c_acctbal > 0 THEN 'positive' END, c_mktsegment]) AS v FROM customer)"


@query("compare_props", f"""SELECT a.k, coalesce(a.prop, b.prop) AS prop, coalesce(substr(a.v, 1, 50), '-') AS left_value, coalesce(substr(b.v, 1, 50), '-') AS right_value
    FROM (SELECT * FROM {_PROPS} WHERE v IS NOT NULL AND k % 2 = 1) a FULL JOIN (SELECT k - 1 AS k, prop, v FROM {_PROPS} WHERE v IS NOT NULL AND k % 2 = 0) b ON a.k = b.k AND a.prop = b.prop WHERE a.k IS NOT NULL""")  # fmt: skip
def compare_props(spark, d):
    """Side by side: each odd customer with the next one."""
    c = M.table(spark, d, "customer")
    props = F.map_filter(F.create_map(F.lit("name"), F.col("c_name"), F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("balance"), F.when(F.col("c_acctbal") > 0, "positive"), F.lit("segment"), F.col("c_mktsegment")), lambda k, v: v.isNotNull())
    rows = c.select(F.col("c_custkey").alias("k"), F.explode(props).alias("prop", "v"))
    a = rows.filter("k % 2 = 1").select("k", "prop", F.col("v").alias("l"))
    b = rows.filter("k % 2 = 0").select((F.col("k") - 1).alias("k"), "prop", F.col("v").alias("r"))
    cut = lambda x: F.coalesce(F.substring(x, 1, 50), F.lit("-"))
    return a.join(b, ["k", "prop"], "full").filter("l IS NOT NULL").select("k", "prop", cut("l").alias("left_value"), cut("r").alias("right_value"))


@query("compare_rel_types", """WITH t AS (SELECT DISTINCT src, rel_type FROM undirected WHERE starts_with(src, 'S:')), a AS (SELECT src, list_sort(list(rel_type)) AS r FROM t GROUP BY src)
    SELECT x.src AS a, y.src AS b, array_to_string(list_sort(list_intersect(x.r, y.r)), ',') AS shared, array_to_string(list_sort(list_filter(x.r, lambda e: NOT list_contains(y.r, e))), ',') AS only_a,
    array_to_string(list_sort(list_filter(y.r, lambda e: NOT list_contains(x.r, e))), ',') AS only_b FROM a x JOIN a y ON substr(y.src, 3)::BIGINT = substr(x.src, 3)::BIGINT + 1""", "undirected")  # fmt: skip
def compare_rel_types(spark, d):
    """Relation types of each faction and the next one."""
    kinds = M.relations_of_suppliers(spark, d).groupBy("src").agg(F.collect_set("rel_type").alias("r")).withColumn("n", F.substring_index("src", ":", -1).cast("bigint"))
    a, b = kinds.select(F.col("src").alias("a"), F.col("r").alias("ra"), (F.col("n") + 1).alias("n")), kinds.select(F.col("src").alias("b"), F.col("r").alias("rb"), "n")
    text = lambda c: F.array_join(F.array_sort(c), ",")
    return a.join(b, "n").select("a", "b", text(F.array_intersect("ra", "rb")).alias("shared"), text(F.array_except("ra", "rb")).alias("only_a"), text(F.array_except("rb", "ra")).alias("only_b"))


# -- merge writes ------------------------------------------------------------------------------
# The writes are line items in the order of all their columns: parts as entities, part and
# supplier as edges. A third of the descriptions is null, and types are partly unknown.

_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
_SEQ = "(" + ", ".join(_ORDER) + ")"
_WRITES = """(SELECT *, CASE WHEN l_partkey % 11 = 0 THEN 'Gadget' ELSE 'Item' END AS kind, 'P' || l_partkey AS name, CASE WHEN l_orderkey % 3 <> 0 THEN 'order ' || l_orderkey END AS description,
    CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS flag, 'S' || l_suppkey AS tgt, CASE WHEN l_suppkey % 7 = 0 THEN 'LIKES' ELSE 'CREATED_BY' END AS rel_type, (year(l_shipdate) * 12 + month(l_shipdate))::INT AS chapter FROM lineitem)"""


def writes(spark, d):
    t = M.table(spark, d, "lineitem")
    return t.select(
        "*", F.when(F.col("l_partkey") % 11 == 0, "Gadget").otherwise("Item").alias("kind"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("name"),
        F.when(F.col("l_orderkey") % 3 != 0, F.concat(F.lit("order "), F.col("l_orderkey").cast("string"))).alias("description"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("tgt"), F.when(F.col("l_suppkey") % 7 == 0, "LIKES").otherwise("CREATED_BY").alias("rel_type"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("int").alias("chapter"),
    )


@query("merge_entities", f"SELECT CASE WHEN kind = 'Item' THEN 'Item' ELSE 'Character' END AS label, name, arg_max_null(description, {_SEQ}) AS description, arg_max(flag, {_SEQ}) FILTER (WHERE flag IS NOT NULL) AS flag, arg_min_null(l_orderkey, {_SEQ}) AS first_order FROM {_WRITES} GROUP BY ALL")
def merge_entities(spark, d):
    rows = writes(spark, d).withColumn("label", G.safe_label(F.col("kind"))).withColumn("first_order", F.col("l_orderkey"))
    return G.last_write(rows, ["label", "name"], _ORDER, ["description"], ["flag"], ["first_order"])


@query("first_appearance", f"SELECT name, arg_min(l_orderkey, {_SEQ}) AS task, arg_min(chapter, {_SEQ}) AS chapter FROM {_WRITES} WHERE l_partkey > 10 GROUP BY name")
def first_appearance(spark, d):
    """Created once, never overwritten; the first ten parts are seeds and left out."""
    seeds = M.table(spark, d, "part").filter("p_partkey <= 10").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("name"))
    rows = writes(spark, d).join(F.broadcast(seeds), "name", "left_anti").withColumn("task", F.col("l_orderkey"))
    return G.last_write(rows, ["name"], _ORDER, [], first=["task", "chapter"])


@query("merge_edges_by_chapter", f"SELECT name AS src, rel_type, tgt, chapter, arg_max_null(description, {_SEQ}) AS description FROM {_WRITES} GROUP BY ALL")
def merge_edges_by_chapter(spark, d):
    rows = writes(spark, d).withColumnRenamed("name", "src")
    return G.last_write(rows, ["src", "rel_type", "tgt", "chapter"], _ORDER, ["description"])


@query("merge_edges", f"SELECT name AS src, rel_type, tgt, arg_max(chapter, {_SEQ}) AS chapter, arg_max_null(description, {_SEQ}) AS description FROM {_WRITES} WHERE rel_type <> 'LIKES' GROUP BY ALL")
def merge_edges(spark, d):
    rows = writes(spark, d).withColumnRenamed("name", "src").filter(F.col("rel_type").isin(G.RELATIONS))
    return G.last_write(rows, ["src", "rel_type", "tgt"], _ORDER, ["chapter", "description"])


ENTITIES = SG.Kind("entities", "label string, name string, description string, flag string, first_order bigint", ["label", "name"], ["description"], ["flag"], ["first_order"])
RELATIONS = SG.Kind("relations", "src string, rel_type string, tgt string, chapter int, description string", ["src", "rel_type", "tgt"], ["chapter", "description"])


def stored_graph(spark, d):
    """Line items, in three batches by order, merged into stored entities and relations, one commit a batch."""
    store = Store(spark, f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}")
    rows = writes(spark, d).withColumn("label", G.safe_label(F.col("kind"))).withColumn("first_order", F.col("l_orderkey")).withColumn("src", F.col("name"))
    last = M.table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0] or 0
    for k in range(3):
        batch = rows.filter((F.col("l_orderkey") > (k * last // 3 if k else -1)) & (F.col("l_orderkey") <= (k + 1) * last // 3))
        SG.merge_graph(store, [(ENTITIES, batch, _ORDER), (RELATIONS, batch.filter(F.col("rel_type").isin(G.RELATIONS)), _ORDER)])
    return store


@query("merge_entities_in_batches", ORACLES["merge_entities"])
def merge_entities_in_batches(spark, d):
    return stored_graph(spark, d).read("entities", ENTITIES.types)


@query("merge_edges_in_batches", ORACLES["merge_edges"])
def merge_edges_in_batches(spark, d):
    return stored_graph(spark, d).read("relations", RELATIONS.types)


@query("table_commits", f"""SELECT k::INT AS version, count(DISTINCT name) AS entities, count(DISTINCT CASE WHEN rel_type <> 'LIKES' THEN name || rel_type || tgt END) AS relations
    FROM {_WRITES}, range(1, 4) r(k), (SELECT max(o_orderkey) AS last FROM orders) WHERE l_orderkey <= k * last // 3 GROUP BY k""")  # fmt: skip
def table_commits(spark, d):
    """What each commit of the stored graph holds: readers of an older one are not disturbed by the next."""
    store, out = stored_graph(spark, d), None
    for v in store.versions():
        sizes = [store.read(k.name, k.types, v).agg(F.count(F.lit(1)).alias(k.name)) for k in (ENTITIES, RELATIONS)]
        row = sizes[0].crossJoin(sizes[1]).select(F.lit(v).alias("version"), "entities", "relations")  # two single rows
        out = row if out is None else out.unionByName(row)
    return out


@query("dedup_edges", f"SELECT name AS src, rel_type, tgt, chapter, arg_min_null(description, {_SEQ}) AS description FROM {_WRITES} GROUP BY ALL")
def dedup_edges(spark, d):
    rows = writes(spark, d).withColumnRenamed("name", "src")
    return G.last_write(rows, ["src", "rel_type", "tgt", "chapter"], _ORDER, [], first=["description"])


@query("write_stats", f"SELECT count(DISTINCT name) AS entities, count(DISTINCT CASE WHEN rel_type <> 'LIKES' THEN name || rel_type || tgt END) AS relations, count(*) AS writes, count(*) FILTER (WHERE rel_type = 'LIKES') AS rejected FROM {_WRITES}")
def write_stats(spark, d):
    good = F.col("rel_type").isin(G.RELATIONS)
    return writes(spark, d).agg(F.countDistinct("name").alias("entities"), F.countDistinct(F.when(good, F.concat("name", "rel_type", "tgt"))).alias("relations"), F.count(F.lit(1)).alias("writes"), F.count_if(~good).alias("rejected"))


@query("attrs_nonnull", f"SELECT name, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, (description IS NOT NULL)::INT::BIGINT + (flag IS NOT NULL)::INT AS n FROM {_WRITES}")
def attrs_nonnull(spark, d):
    attrs = F.map_filter(F.create_map(F.lit("description"), F.col("description"), F.lit("flag"), F.col("flag")), lambda k, v: v.isNotNull())
    return writes(spark, d).select("name", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", F.size(attrs).cast("bigint").alias("n"))


# -- events: an order with its customer, clerk and parts as characters -------------------------

_EVENTS = """(SELECT o_orderkey, chapter, CASE o_orderstatus WHEN 'F' THEN 'conflict' WHEN 'O' THEN 'encounter' ELSE 'milestone' END AS event_type, o_totalprice,
    CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'S' || o_custkey % 10 ELSE 'C' || o_custkey END AS primary_character FROM ord)"""


def events(spark, d):
    """Extracted events: ``(o_orderkey, chapter, event_type, characters, o_totalprice)``; some have
    no subject, some no characters at all, and some no type."""
    o = M.table(spark, d, "orders").withColumn("chapter", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("int"))
    who = lambda name, role: F.struct(name.alias("name"), F.lit(role).cast("string").alias("role"))
    cust, shop = F.concat(F.lit("C"), F.col("o_custkey").cast("string")), F.concat(F.lit("S"), (F.col("o_custkey") % 10).cast("string"))
    cast = F.when(F.col("o_orderkey") % 9 == 0, F.array().cast("array<struct<name:string,role:string>>")).when(F.col("o_orderkey") % 5 == 0, F.array(who(shop, None), who(cust, "object"))).otherwise(F.array(who(shop, "witness"), who(cust, "subject")))
    kind = F.when(F.col("o_orderstatus") == "F", "conflict").when(F.col("o_orderstatus") == "O", "encounter")
    return o.select("o_orderkey", "chapter", F.coalesce(kind, F.lit("milestone")).alias("event_type"), cast.alias("characters"), "o_totalprice")


@query("ingest_events", f"SELECT o_orderkey, chapter, event_type, primary_character FROM {_EVENTS} WHERE primary_character IS NOT NULL", "ord")
def ingest_events(spark, d):
    return events(spark, d).withColumn("primary_character", G.primary_of(F.col("characters"))).filter("primary_character IS NOT NULL").select("o_orderkey", "chapter", "event_type", "primary_character")


@query("merge_major_events", f"SELECT chapter, event_type, primary_character, arg_max(o_totalprice, o_orderkey) AS price, min(o_orderkey) AS task_id FROM {_EVENTS} WHERE primary_character IS NOT NULL GROUP BY ALL", "ord")
def merge_major_events(spark, d):
    rows = events(spark, d).withColumn("primary_character", G.primary_of(F.col("characters"))).filter("primary_character IS NOT NULL").withColumn("price", F.col("o_totalprice")).withColumn("task_id", F.col("o_orderkey"))
    return G.last_write(rows, ["chapter", "event_type", "primary_character"], ["o_orderkey"], ["price"], first=["task_id"])


_CAST = "(SELECT o_orderkey, chapter, event_type, unnest(CASE WHEN o_orderkey % 9 = 0 THEN [] WHEN o_orderkey % 5 = 0 THEN ['S' || o_custkey % 10 || '/witness', 'C' || o_custkey || '/object'] ELSE ['S' || o_custkey % 10 || '/witness', 'C' || o_custkey || '/subject'] END) AS x, primary_character FROM (SELECT e.*, o_custkey FROM EV e JOIN orders USING (o_orderkey)))".replace("EV", _EVENTS)


@query("experiences", f"SELECT DISTINCT split_part(x, '/', 1) AS name, chapter, event_type, primary_character, split_part(x, '/', 2) AS role FROM {_CAST} WHERE primary_character IS NOT NULL", "ord")
def experiences(spark, d):
    rows = events(spark, d).withColumn("primary_character", G.primary_of(F.col("characters"))).filter("primary_character IS NOT NULL")
    return rows.select(F.explode("characters").alias("c"), "chapter", "event_type", "primary_character").select(F.col("c.name").alias("name"), "chapter", "event_type", "primary_character", F.coalesce("c.role", F.lit("witness")).alias("role")).distinct()


@query("major_events", f"SELECT name, chapter, event_type, r FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY chapter, event_type) AS r FROM (SELECT DISTINCT split_part(x, '/', 1) AS name, chapter, event_type FROM {_CAST})) WHERE r <= 10", "ord")
def major_events(spark, d):
    rows = events(spark, d).select(F.explode("characters").alias("c"), "chapter", "event_type").select("c.name", "chapter", "event_type").distinct()
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy("chapter", "event_type")).cast("bigint")).filter("r <= 10")


@query("events_by_type", f"SELECT o_orderkey, chapter FROM {_EVENTS} WHERE event_type = 'conflict'", "ord")
def events_by_type(spark, d):
    return events(spark, d).filter("event_type = 'conflict'").select("o_orderkey", "chapter")


@query("primary_characters", f"SELECT DISTINCT split_part(x, '/', 1) AS name FROM {_CAST} WHERE split_part(x, '/', 2) = 'subject'", "ord")
def primary_characters(spark, d):
    return events(spark, d).select(F.explode("characters").alias("c")).filter("c.role = 'subject'").select("c.name").distinct()


@query("write_event_stats", f"SELECT count(*) AS total, count(primary_character) AS written, count(DISTINCT CASE WHEN primary_character IS NOT NULL THEN (chapter, event_type, primary_character) END) AS merged FROM {_EVENTS}", "ord")
def write_event_stats(spark, d):
    rows = events(spark, d).withColumn("p", G.primary_of(F.col("characters")))
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count("p").alias("written"), F.countDistinct(F.when(F.col("p").isNotNull(), F.struct("chapter", "event_type", "p"))).alias("merged"))


# -- figures and snapshots ---------------------------------------------------------------------


@query("unique_check", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_check(spark, d):
    return M.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("graph_stats", "SELECT l AS label, count(name) AS n FROM (SELECT unnest(['Character', 'Faction', 'Place', 'Item', 'Concept', 'Event', 'Chunk']) AS l) LEFT JOIN node ON l = label GROUP BY l", "node")
def graph_stats(spark, d):
    return G.counts_by(M.nodes(spark, d), "label", [*G.LABELS, "Chunk"])


@query("rel_type_stats", "SELECT rel_type, count(*) AS n FROM edge GROUP BY rel_type", "edge")
def rel_type_stats(spark, d):
    return G.counts_by(M.edges(spark, d), "rel_type").orderBy(F.desc("n"), "rel_type")


@query("type_histogram", f"SELECT 'entity' AS kind, label AS value, count(*) AS n FROM node GROUP BY label UNION ALL SELECT 'relation', rel_type, count(*) FROM edge GROUP BY rel_type UNION ALL SELECT 'event', event_type, count(*) FROM {_EVENTS} GROUP BY event_type", "node", "edge", "ord")
def type_histogram(spark, d):
    part = lambda df, c, k: df.groupBy(F.lit(k).alias("kind"), F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return part(M.nodes(spark, d), "label", "entity").unionByName(part(M.edges(spark, d), "rel_type", "relation")).unionByName(part(events(spark, d), "event_type", "event"))


@query("snapshot_manifest", "SELECT (SELECT count(*) FROM node) AS nodes, (SELECT count(*) FROM edge) AS relationships, (SELECT count(*) FROM embeddings) AS points", "node", "edge")
def snapshot_manifest(spark, d):
    """The manifest of a snapshot that is written here."""
    path = f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    files.export_snapshot(M.nodes(spark, d), M.edges(spark, d), M.table(spark, d, "embeddings"), path)
    manifest = files.import_snapshot(spark, path, {})["manifest"]
    return manifest.agg(*[F.max(F.when(F.col("part") == part, F.col("n"))).alias(part) for part in ("nodes", "relationships", "points")])


@query("snapshot_import", f"SELECT rel_type, count(*) AS kept FROM edge WHERE src IN {_KNOWN} AND tgt IN {_KNOWN} GROUP BY rel_type", "edge", "node")
def snapshot_import(spark, d):
    """Edges written to a snapshot and read back, bound to the nodes that exist."""
    path = f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    nodes, edges = _known(spark, d), M.edges(spark, d)
    files.export_snapshot(nodes, edges, M.table(spark, d, "embeddings"), path)
    back = files.import_snapshot(spark, path, {"nodes": nodes.schema, "relationships": edges.schema})
    rows = back["manifest"].filter("part = 'relationships'").first()["n"]
    return G.bind(back["relationships"], back["nodes"], rows).groupBy("rel_type").agg(F.count(F.lit(1)).alias("kept"))

"""The typed graph: patterns, bounded traversal, and merge writes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import among, broadcast_checked, having, marked, name_set, written

LABELS = ["Character", "Faction", "Place", "Item", "Concept", "Event"]
RELATIONS = ["MOTIVATED_BY", "MEMBER_OF", "OPPOSED_TO", "ORIGINATES_FROM", "LOCATED_AT", "INVOLVED_IN", "LEADS_TO", "CREATED_BY", "TEMPORAL_BEFORE"]
#: Labels for rendering (fixed values).
RELATION_TEXT = {
    "MOTIVATED_BY": "信仰/动机", "MEMBER_OF": "成员", "OPPOSED_TO": "对立", "ORIGINATES_FROM": "起源/来源", "LOCATED_AT": "所在地",
    "INVOLVED_IN": "参与", "LEADS_TO": "导致/引发", "CREATED_BY": "创造者", "TEMPORAL_BEFORE": "时间先于",
}


def undirected(edges: DataFrame) -> DataFrame:
    """Edges from both ends with their direction; a self-loop once."""
    out = edges.withColumn("direction", F.lit("out"))
    turned = [F.col({"src": "tgt", "tgt": "src"}.get(c, c)).alias(c) for c in edges.columns]
    return out.unionByName(edges.filter("src <> tgt").select(*turned).withColumn("direction", F.lit("in")))


def relations_of(edges: DataFrame, nodes: DataFrame, entities: DataFrame, relation: str | None = None, limit: int = 20) -> DataFrame:
    """Edges of each of ``entities(start)``, seen from it, with the other end's label; the first
    ``limit`` of each by type and name."""
    mine = undirected(edges).join(broadcast_checked(entities.select(F.col("start").alias("src")).distinct()), "src")
    mine = mine.filter(F.col("rel_type") == relation) if relation else mine
    named = mine.join(nodes.select(F.col("name").alias("tgt"), F.col("label").alias("target_label")), "tgt")
    order = Window.partitionBy("src").orderBy("rel_type", "tgt", "direction", F.asc_nulls_last("chapter"))
    return named.select("src", "rel_type", "tgt", "target_label", "direction", "chapter").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def bind(edges: DataFrame, nodes: DataFrame, rows: int | None = None) -> DataFrame:
    """Edges both of whose ends exist.

    Where the names can be broadcast the edges only pass by. Else they are shuffled; edges that are not read from files are written
    first, for their number, and others come with their ``rows``."""
    names, columns = written(nodes.select("name"), "names"), edges.columns
    few = name_set(names)
    if few is None and rows is None:
        edges = written(edges, "edges")
        rows = edges.count()
    for end in ("src", "tgt"):
        edges = among(edges, end, names, few, rows)
    return edges.select(*columns)


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges an end of which does not exist, and which."""
    names, columns, ends = written(nodes.select("name"), "names"), edges.columns, ("src", "tgt")
    few = name_set(names)
    if few is not None:
        for end in ends:
            edges = marked(edges, end, few, f"_{end}")
        missing = F.array(*[F.when(~F.col(f"_{end}"), F.lit(end)) for end in ends])
        return edges.select(*columns, F.explode(F.array_compact(missing)).alias("missing"))
    edges = written(edges, "edges")
    rows = edges.count()
    src, tgt = (among(edges, end, names, few, rows, "left_anti").select(*columns).withColumn("missing", F.lit(end)) for end in ends)
    return src.unionByName(tgt)


def _origin(starts: DataFrame) -> DataFrame:
    """``starts(start)`` as the level of a traversal that has gone no step."""
    return written(starts.select("start").distinct().select("start", F.col("start").alias("node"), F.array("start").alias("path"), F.lit(0).alias("hops")), "level")


def _steps(edges: DataFrame, level: DataFrame, to: DataFrame | None = None) -> DataFrame:
    """``(src, rel_type, tgt)``, from both ends, of the written edges that lead away from a level's nodes, or from these to nodes of ``to``."""
    rows, out = edges.count(), None
    for a, b in (("src", "tgt"), ("tgt", "src")):
        part = edges.filter("src <> tgt").select(F.col(a).alias("src"), "rel_type", F.col(b).alias("tgt"))
        part = part if to is None else having(part, "tgt", to.select("node"), rows)
        part = having(part, "src", level.select("node"), rows).select("src", "rel_type", "tgt")
        out = part if out is None else out.unionByName(part)
    return out


def _grow(steps: DataFrame, level: DataFrame, seen: DataFrame, hops: int, backward: bool = False) -> DataFrame:
    """The next level: nodes that no level before has, with the least of the paths to each."""
    path = F.concat(F.array("tgt", "rel_type"), "path") if backward else F.concat("path", F.array("rel_type", "tgt"))
    grown = steps.join(broadcast_checked(level), F.col("node") == F.col("src")).select("start", F.col("tgt").alias("node"), path.alias("path"))
    new = grown.join(broadcast_checked(seen.select("start", "node")), ["start", "node"], "left_anti")
    return written(new.groupBy("start", "node").agg(F.min("path").alias("path")).withColumn("hops", F.lit(hops)), "level")


def reach(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """``(start, node, path, hops)`` of every node within ``hops`` steps of a start, over written edges.

    ``path`` alternates names and relation types. Of the shortest paths the least in that order
    is taken: level by level one path is kept for each start and node, as the least path's
    parts are the least to their nodes. Every level is written once, so it costs one join
    whatever came before it.
    """
    level = seen = _origin(starts)
    for k in range(1, hops + 1):
        level = _grow(_steps(edges, level), level, seen, k)
        seen = seen.unionByName(level)
    return seen


def nearest(edges: DataFrame, starts: DataFrame, hops: int, limit: int) -> DataFrame:
    """As ``reach``, but of each start only the ``limit`` nearest nodes, ties by name, beside itself.

    A start that has its nodes goes no further. Of a node's neighbours the first ``limit`` + 1 by name are
    followed: others cannot be among a start's nearest, as those, unless seen before, come first. So the hubs of a
    graph add no more rows than other nodes."""
    level = seen = _origin(starts)
    for k in range(1, hops + 1):
        # a dense rank, as a neighbour may come by several relations
        first = Window.partitionBy("src").orderBy("tgt")
        steps = _steps(edges, level).withColumn("_r", F.dense_rank().over(first)).filter(F.col("_r") <= limit + 1).drop("_r")
        level = _grow(steps, level, seen, k)
        seen = seen.unionByName(level)
        full = seen.groupBy("start").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
        if k < hops:
            level = written(level.join(full, "start", "left_anti"), "level")
    order = Window.partitionBy("start").orderBy("hops", "node")
    return seen.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= limit + 1).drop("_r")


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_hops: int = 4, banned: DataFrame | None = None) -> DataFrame:
    """``(start, end, path, hops)`` of each pair that a path of at most ``max_hops`` edges links.

    Edges count in both directions. ``banned(name)`` are nodes that no path may touch. The search
    goes a step at a time, from the side whose last level has fewer rows. Where the last levels of both
    sides meet, a pair has its fewest hops; the least path wins, and the pair is done. The last step goes only to nodes
    at which the other side waits.
    """
    if banned is not None:
        banned = broadcast_checked(banned.select("name").distinct())
        for col in ("src", "tgt"):
            edges = edges.join(banned.withColumnRenamed("name", col), col, "left_anti")
        for col in ("start", "end"):
            pairs = pairs.join(banned.withColumnRenamed("name", col), col, "left_anti")
    left = written(pairs.select("start", "end").distinct(), "pairs")
    edges, found = written(edges.select("src", "rel_type", "tgt"), "edges"), []
    ends = ("start", "end")
    levels = [_origin(left.select(F.col(c).alias("start"))) for c in ends]
    seen, gone = list(levels), [0, 0]
    for hops in range(max_hops + 1):
        if hops:
            levels = [written(level.join(left.select(F.col(c).alias("start")).distinct(), "start", "left_semi"), "level") for level, c in zip(levels, ends)]
            k = 0 if levels[0].count() <= levels[1].count() else 1
            gone[k] += 1
            steps = _steps(edges, levels[k], levels[1 - k] if hops == max_hops else None)
            levels[k] = _grow(steps, levels[k], seen[k], gone[k], k == 1)
            seen[k] = seen[k].unionByName(levels[k])
        back = levels[1].select(F.col("start").alias("end"), "node", F.col("path").alias("rest"))
        met = left.join(levels[0].select("start", "node", "path"), "start").join(back, ["end", "node"])
        path = F.concat("path", F.slice("rest", 2, F.size("rest")))
        met = met.select("start", "end", path.alias("path")).groupBy("start", "end").agg(F.min("path").alias("path"))
        found.append(written(met.withColumn("hops", F.lit(hops).cast("bigint")), "met"))
        left = written(left.join(found[-1], ["start", "end"], "left_anti"), "pairs")
        if left.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def neighbours(edges: DataFrame, starts: DataFrame, max_hops: int = 3, limit: int = 15) -> DataFrame:
    """The nearest nodes of each start, with one least shortest chain to each."""
    order = Window.partitionBy("start").orderBy("hops", "end")
    near = nearest(written(edges.select("src", "rel_type", "tgt"), "edges"), starts, max_hops, limit).filter("hops > 0").select("start", F.col("node").alias("end"), "path", F.col("hops").cast("bigint").alias("hops"))
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def subgraph(edges: DataFrame, start: DataFrame, depth: int = 1, max_nodes: int | None = 20) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all paths of at most ``depth`` edges from the start. With ``max_nodes``
    the nearest nodes stay, and the edges between them."""
    edges = written(edges.select("src", "rel_type", "tgt"), "edges")
    near = reach(edges, start, depth) if max_nodes is None else nearest(edges, start, depth, max_nodes - 1)
    near = written(near.select("start", "node", F.col("hops").alias("dist")), "near")
    a = near.select("start", F.col("node").alias("src"), F.col("dist").alias("da"))
    b = near.select("start", F.col("node").alias("tgt"), F.col("dist").alias("db"))
    rows, some = edges.count(), edges
    for end in ("src", "tgt"):
        some = having(some, end, near.select("node"), rows)
    inside = some.select("src", "rel_type", "tgt").distinct().join(a, "src").join(b, ["start", "tgt"])
    return near, inside.filter(F.least("da", "db") <= depth - 1).select("start", "src", "rel_type", "tgt")


def chain_text(path: Column) -> Column:
    """``A -[R]-> B`` of an alternating path."""
    return F.array_join(F.transform(path, lambda x, i: F.when(i % 2 == 1, F.concat(F.lit("-["), x, F.lit("]->"))).otherwise(x)), " ")


def timeline(edges: DataFrame, nodes: DataFrame, entities: DataFrame, hops: int = 5) -> DataFrame:
    """``(entity, layer, source, item, rel_type, chapter, step)`` of the first layer that has rows.

    1: the events an entity is involved in; 2: for an event, itself and up to ``hops`` events
    after it, if there are any; 3: its outgoing edges with a chapter, or, without those, the
    incoming ones (as layer 4).
    """
    e, edges = written(entities.select("entity").distinct(), "entities"), written(edges, "edges")
    events = written(nodes.filter("label = 'Event'").select(F.col("name").alias("item"), F.col("chapter").alias("at")), "events")
    row = lambda layer, source, item, rel, chapter, step: ["entity", F.lit(layer).alias("layer"), F.lit(source).alias("source"), F.col(item).alias("item"), rel.alias("rel_type"), F.col(chapter).alias("chapter"), step.alias("step")]
    zero, rel = F.lit(0), F.col("rel_type")
    involved = edges.filter("rel_type = 'INVOLVED_IN'").join(e, F.col("src") == F.col("entity")).join(events, F.col("tgt") == F.col("item"))
    found = [written(involved.select(*row(1, "events", "tgt", rel, "at", zero)), "layer")]
    # each layer is computed only for the entities that those before left without rows
    e = written(e.join(found[0].select("entity").distinct(), "entity", "left_anti"), "entities")
    after = written(edges.filter("rel_type = 'TEMPORAL_BEFORE'").select("src", "tgt").distinct(), "after")
    level = e.join(events, F.col("entity") == F.col("item")).select("entity", "item")
    chain = [level]
    for _ in range(hops):
        level = written(level.join(after, level.item == after.src).select("entity", F.col("tgt").alias("item")).distinct(), "level")
        chain.append(level)
    steps = reduce(DataFrame.unionByName, [c.withColumn("step", F.lit(k)) for k, c in enumerate(chain)])
    temporal = steps.join(chain[1].select("entity").distinct(), "entity", "left_semi").join(events, "item")
    found.append(temporal.select(*row(2, "temporal", "item", F.lit("TEMPORAL_BEFORE"), "at", F.col("step"))))
    e = written(e.join(chain[1].select("entity").distinct(), "entity", "left_anti"), "entities")
    dated = edges.filter("chapter IS NOT NULL")
    out = written(dated.join(e, F.col("src") == F.col("entity")).select(*row(3, "outgoing", "tgt", rel, "chapter", zero)), "layer")
    e = e.join(out.select("entity").distinct(), "entity", "left_anti")
    found += [out, dated.join(e, F.col("tgt") == F.col("entity")).select(*row(4, "incoming", "src", rel, "chapter", zero))]
    return reduce(DataFrame.unionByName, found)


def last_write(df: DataFrame, keys: list[str], order: list[str], overwrite: list[str], keep: list[str] = (), first: list[str] = ()) -> DataFrame:
    """Merge rows by key in the order written: ``overwrite`` takes the last value, null too,
    ``keep`` the last that is not null, ``first`` the first."""
    seq = F.struct(*order)
    aggs = [F.max_by(F.struct(c), seq)[c].alias(c) for c in overwrite]
    aggs += [F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), seq)).alias(c) for c in keep]
    aggs += [F.min_by(F.struct(c), seq)[c].alias(c) for c in first]
    return df.groupBy(*keys).agg(*aggs)


def safe_label(label: Column) -> Column:
    """An unknown label counts as Character."""
    return F.when(label.isin(LABELS), label).otherwise(F.lit("Character"))


def primary_of(characters: Column) -> Column:
    """The first subject among ``array<struct<name, role>>``, else the first character."""
    subject = F.get(F.filter(characters, lambda c: c["role"] == "subject"), F.lit(0))
    return F.coalesce(subject["name"], F.get(characters, F.lit(0))["name"])


def counts_by(df: DataFrame, col: str, fixed: list[str] | None = None) -> DataFrame:
    """``(col, n)``; with a fixed list, its values only, zeros included."""
    found = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    if fixed is None:
        return found
    keys = df.sparkSession.createDataFrame([(k,) for k in fixed], f"{col} string")
    return keys.join(found, col, "left").select(col, F.coalesce("n", F.lit(0)).alias("n"))

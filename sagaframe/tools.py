"""The query tools over a graph and a chunk index. Each returns a DataFrame; ``render`` makes text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as T
from .operators import aliases as A
from .operators import bm25, vectors
from .operators import graph as G
from .storage import written


@dataclass
class Memory:
    """What the tools ask: nodes, edges and aliases, and chunks ``(id, text, characters, entities,
    event_order)``, optionally with a dense channel: points and a function from query to vector."""

    nodes: DataFrame
    edges: DataFrame
    aliases: DataFrame
    chunks: DataFrame | None = None
    points: DataFrame | None = None
    embed: object = None

    def _canonical(self, name: str) -> str:
        asked = self.nodes.sparkSession.createDataFrame([(name,)], "name string")
        return A.resolve(asked, self.aliases, fold_case=True).first()["canonical"]

    def _start(self, name: str) -> DataFrame:
        return self.nodes.sparkSession.createDataFrame([(self._canonical(name),)], "start string")

    def lookup_knowledge(self, entity: str, relation: str | None = None, limit: int = 25) -> DataFrame:
        """The entity's own row and its relations; no rows for an unknown entity."""
        name = self._canonical(entity)
        own = self.nodes.filter(F.col("name") == name).orderBy("label").limit(1)
        rel = G.relations_of(self.edges, self.nodes, self._start(entity), relation, limit).drop("rank")
        none = lambda *c: [F.lit(None).cast("string").alias(x) for x in c]
        head = own.select(F.col("name").alias("src"), *none("rel_type", "tgt"), F.col("label").alias("target_label"), *none("direction"), "chapter", "description")
        return head.unionByName(rel.withColumn("description", F.lit(None).cast("string")))

    def find_connection(self, a: str, b: str, max_hops: int = 4) -> DataFrame:
        if not 1 <= max_hops <= 6:
            raise ValueError("max_hops must be 1 to 6")
        pair = self.nodes.sparkSession.createDataFrame([(self._canonical(a), self._canonical(b))], "start string, end string")
        return G.shortest_paths(self.edges, pair, max_hops).withColumn("chain", G.chain_text(F.col("path")))

    def get_timeline(self, entity: str) -> DataFrame:
        who = self._start(entity).withColumnRenamed("start", "entity")
        return G.timeline(self.edges, self.nodes, who).orderBy(F.asc_nulls_last("chapter"), "step", "item")

    def trace_causality(self, start: str, end: str | None = None, hops: int = 4) -> DataFrame:
        causal = self.edges.filter(F.col("rel_type").isin("LEADS_TO", "MOTIVATED_BY"))
        if end is None:
            return G.neighbours(causal, self._start(start), min(hops, 3)).withColumn("chain", G.chain_text(F.col("path")))
        pair = self.nodes.sparkSession.createDataFrame([(self._canonical(start), self._canonical(end))], "start string, end string")
        return G.shortest_paths(causal, pair, hops).withColumn("chain", G.chain_text(F.col("path")))

    def compare_entities(self, a: str, b: str) -> DataFrame:
        """Side by side ``(kind, key, left_value, right_value, side)``: properties that either has, cut
        to 50 characters, and the relation types that both have or only one of them. An entity that
        is not found has ``-`` everywhere; no rows if neither is."""
        left, right = self._canonical(a), self._canonical(b)
        own = self.nodes.filter(F.col("name").isin(left, right)).groupBy("name").agg(F.min(F.struct("label", "description", F.col("chapter").cast("string").alias("chapter"))).alias("p"))
        props = F.map_filter(F.create_map(*[x for c in ("label", "description", "chapter") for x in (F.lit(c), F.col(f"p.{c}"))]), lambda k, v: v.isNotNull())
        rows = own.select("name", F.lit("property").alias("kind"), F.explode(props).alias("key", "value"))
        kinds = G.undirected(self.edges).filter(F.col("src").isin(left, right)).select(F.col("src").alias("name"), F.lit("relation").alias("kind"), F.col("rel_type").alias("key"), F.lit("yes").alias("value")).distinct()
        value = lambda n: F.max(F.when(F.col("name") == n, F.substring("value", 1, 50)))
        both = rows.unionByName(kinds).groupBy("kind", "key").agg(value(left).alias("l"), value(right).alias("r"))
        side = F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), "shared").when(F.col("r").isNull(), "only_a").otherwise("only_b")
        cell = lambda c: F.coalesce(F.col(c), F.lit("-"))
        return both.select("kind", "key", cell("l").alias("left_value"), cell("r").alias("right_value"), side.alias("side")).orderBy("kind", "key")

    def explore_subgraph(self, entity: str, depth: int = 1, max_nodes: int = 20, edge_types: str | None = None) -> tuple[DataFrame, DataFrame]:
        if not 1 <= depth <= 3 or max_nodes < 1:
            raise ValueError("depth must be 1 to 3 and max_nodes at least 1")
        kinds = [k.strip() for k in (edge_types or "").split(",") if k.strip()]
        edges = self.edges.filter(F.col("rel_type").isin(kinds)) if kinds else self.edges
        return G.subgraph(edges, self._start(entity), depth, max_nodes)

    def _candidates(self, index: bm25.Index, pool: DataFrame, text: str, most: int) -> DataFrame:
        """``(q, id)`` of the chunks of ``pool`` that are among a channel's best."""
        spark = pool.sparkSession
        sparse, lexical = bm25.search(index, spark.createDataFrame([(0, text)], "id int, text string"), "id", "text", pool)
        found = [("bm25", sparse), ("lexical", lexical)]
        if self.points is not None and self.embed is not None:
            probe = spark.createDataFrame([(0, self.embed(text))], "q int, embedding array<float>")
            found.insert(0, ("dense", vectors.dense_topk(probe, self.points.join(pool.select("id"), "id", "left_semi"), most).select("q", "id", "score")))
        return vectors.best_per_id(vectors.fuse(found, [most] * len(found))).select("q", "id")

    def search_memory(self, query: str, characters: list[str] | None = None, sort_by: str = "relevance", limit: int = 5, candidates: int = 6) -> DataFrame:
        """Chunks by the fused channels, reranked. With characters, chunks that mention one of them by any of its
        names; if that finds nothing, chunks in which they speak; if that finds nothing, all chunks, asked with the
        characters' names put before the query. The reranker always compares with the query itself."""
        if not 1 <= limit <= 20 or sort_by not in ("relevance", "time"):
            raise ValueError("limit must be 1 to 20 and sort_by relevance or time")
        asked = [(self.chunks, query)]
        if characters:
            known = [self._canonical(c) for c in characters]
            told = A.all_names(self.aliases).filter(F.col("canonical").isin(known)).select(F.explode("names")).collect()  # of the names asked for
            names = F.array(*[F.lit(n) for n in dict.fromkeys([*characters, *known, *(r[0] for r in told)])])
            pools = [self.chunks.filter(F.arrays_overlap(F.col(c), names)) for c in ("entities", "characters")]
            asked = [*((p, query) for p in pools), (self.chunks, " ".join([*known, query]))]
        index = bm25.index(self.chunks, "id", "text")
        for pool, text in asked:
            best = written(self._candidates(index, pool, text, candidates), "candidates")
            if not best.isEmpty():
                break
        texts = best.join(pool, "id").withColumn("score", vectors.overlap_score(T.tokens(F.lit(query)), T.tokens(F.col("text"))))
        top = vectors.top_k(texts, limit)
        return top.orderBy("event_order", "id") if sort_by == "time" else top.orderBy("rank")


def render(df: DataFrame, most: int = 50) -> str:
    """A Markdown table of a result's first rows, with a line that says so if there are more."""
    rows = df.limit(most + 1).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    lines = [head, *("| " + " | ".join("-" if v is None else str(v) for v in r) + " |" for r in rows[:most])]
    return "\n".join(lines + [f"(the first {most} rows)"] * (len(rows) > most))

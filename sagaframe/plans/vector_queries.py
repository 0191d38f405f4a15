"""Queries over embeddings and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bm25, vectors
from ..storage import written
from . import model as M
from .registry import query
from .text_queries import _BM25, _QUESTION, docs, index


def points(spark, d):
    """Points of the dense channel, with payload; ids are the vectors' own, so they are stable."""
    return M.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def probes(spark, d):
    """The queries: every vector whose id is divisible by 100."""
    return points(spark, d).filter("id % 100 = 0").select(F.col("id").alias("q"), "embedding")


_DENSE = "(SELECT a.vec_id AS q, b.vec_id AS id, b.label, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)"
_TOP = "(SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS r FROM {t})"


@query("dense_topk", f"SELECT q, id, score FROM {_TOP.format(t=_DENSE)} WHERE r <= 20")
def dense_topk(spark, d):
    return vectors.dense_topk(probes(spark, d), points(spark, d), 20).select("q", "id", "score")


@query("dense_topk_filtered", f"SELECT q, id, score FROM {_TOP.format(t=_DENSE.replace('% 100 = 0)', '% 100 = 0 AND b.label IN (1, 3))'))} WHERE r <= 20")
def dense_topk_filtered(spark, d):
    """The same among points that a payload filter lets through."""
    some = vectors.payload_filter(points(spark, d), {"label": [1, 3]})
    return vectors.dense_topk(probes(spark, d), some, 20).select("q", "id", "score")


@query("dense_topk_time", f"SELECT q, id, score, label FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY label, id) AS k FROM {_TOP.format(t=_DENSE)} WHERE r <= 20) WHERE k <= 10")
def dense_topk_time(spark, d):
    """Twice as many by score, of which the first by time (the label) stay."""
    top = vectors.dense_topk(probes(spark, d), points(spark, d), 20).join(points(spark, d).select("id", "label"), "id")
    order = Window.partitionBy("q").orderBy("label", "id")
    return top.withColumn("k", F.row_number().over(order)).filter("k <= 10").select("q", "id", "score", "label")


@query("vector_roundtrip", "SELECT vec_id AS id, len(embedding)::BIGINT AS n, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def vector_roundtrip(spark, d):
    """Named vectors to JSON and back."""
    kind = "struct<dense: array<float>>"
    packed = points(spark, d).select("id", F.to_json(F.struct(F.col("embedding").alias("dense"))).alias("j"))
    v = F.from_json("j", kind)["dense"]
    return packed.select("id", F.size(v).cast("bigint").alias("n"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@query("upsert_chunks", "SELECT id, label FROM (SELECT vec_id AS id, label FROM embeddings WHERE vec_id % 3 <> 0 UNION ALL SELECT vec_id, label + 100 FROM embeddings WHERE vec_id % 3 = 0)")
def upsert_chunks(spark, d):
    """Every third point is written again; of the writes, those without a vector are dropped."""
    old = points(spark, d)
    again = old.filter("id % 3 = 0").withColumn("label", F.col("label") + 100)
    lost = old.filter("id % 3 = 1").withColumn("embedding", F.lit(None).cast("array<float>"))
    return vectors.upsert(old, again.unionByName(lost), required="embedding").select("id", "label")


@query("collection_info", "SELECT count(*) AS points, count(DISTINCT label) AS labels, min(len(embedding))::BIGINT AS dimension FROM embeddings")
def collection_info(spark, d):
    return points(spark, d).agg(F.count(F.lit(1)).alias("points"), F.countDistinct("label").alias("labels"), F.min(F.size("embedding")).cast("bigint").alias("dimension"))


# -- hybrid: the embedding with a document's number stands for it; item k asks with vector k ---

QUOTAS = [6, 6, 6]


def channels(spark, d):
    items = M.table(spark, d, "benchmark")
    asked = items.select(F.col("item_id").alias("id")).join(points(spark, d), "id").select(F.col("id").alias("q"), "embedding")
    near = vectors.dense_topk(asked, points(spark, d), QUOTAS[0]).select("q", "id", "score")
    sparse, lexical = (s.withColumn("score", F.round("score", 6)) for s in bm25.search(index(spark, d, True), items, "item_id", "text"))
    return [("dense", near), ("bm25", sparse), ("lexical", lexical)]


def candidates(spark, d):
    """Each channel's best, written once."""
    return written(vectors.fuse(channels(spark, d), QUOTAS), "candidates")


_LEX = """(SELECT x.q, t.doc_id AS id, round(sum(t.w * x.w), 6) AS score FROM
    (SELECT doc_id, term, (1 + ln(tf)) / sqrt(sum((1 + ln(tf)) * (1 + ln(tf))) OVER (PARTITION BY doc_id)) AS w FROM tf) t JOIN
    (SELECT q, term, (1 + ln(n)) / sqrt(sum((1 + ln(n)) * (1 + ln(n))) OVER (PARTITION BY q)) AS w FROM
        (SELECT item_id AS q, term, count(*) AS n FROM (SELECT item_id, unnest(TOKENS) AS term FROM benchmark) GROUP BY 1, 2)) x
    ON t.term = x.term GROUP BY x.q, t.doc_id)""".replace("TOKENS", M.sql_tokens("text"))
_ASKED = "(SELECT a.vec_id AS q, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id IN (SELECT item_id FROM benchmark))"
_CANDIDATES = " UNION ALL ".join(
    f"SELECT q, id, score, '{name}' AS channel, {no}::INT AS channel_no FROM {_TOP.format(t=t)} WHERE r <= 6"
    for no, (name, t) in enumerate((("dense", _ASKED), ("bm25", f"(SELECT q, id, round(score, 6) AS score FROM {_BM25})"), ("lexical", _LEX)))
)


@query("hybrid_candidates", f"SELECT * FROM ({_CANDIDATES})", "weight")
def hybrid_candidates(spark, d):
    return candidates(spark, d)


_BEST = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, id ORDER BY score DESC, channel_no) AS b FROM ({_CANDIDATES})) WHERE b = 1)"


@query("hybrid_dedup", f"SELECT q, id, score, channel FROM {_BEST}", "weight")
def hybrid_dedup(spark, d):
    return vectors.best_per_id(candidates(spark, d)).select("q", "id", "score", "channel")


@query("hybrid_search", f"SELECT q, id, score, channel FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS k FROM {_BEST}) WHERE k <= 5", "weight")
def hybrid_search(spark, d):
    return vectors.top_k(vectors.best_per_id(candidates(spark, d)), 5).select("q", "id", "score", "channel")


def reranked(spark, d, candidates, k: int = 5):
    """Candidates by the default reranker: the share of the question's terms in the document."""
    asked = M.table(spark, d, "benchmark").select(F.col("item_id").alias("q"), T.tokens(F.col("text")).alias("qt"))
    texts = docs(spark, d).select(F.col("doc_id").alias("id"), T.tokens(F.col("text")).alias("dt"))
    rows = candidates.select("q", "id").join(asked, "q").join(texts, "id")
    return vectors.top_k(rows.select("q", "id", F.round(vectors.overlap_score(F.col("qt"), F.col("dt")), 6).alias("score")), k)


_SHARED, _ASK = f"list_distinct({M.sql_tokens('x.text')})", f"list_distinct({M.sql_tokens('b.text')})"
_OVERLAP = f"(SELECT c.q, c.id, round(len(list_intersect({_ASK}, {_SHARED})) / greatest(len({_ASK}), 1), 6) AS score FROM CAND c JOIN benchmark b ON c.q = b.item_id JOIN documents x ON c.id = x.doc_id)"


@query("rerank", f"SELECT q, id, score FROM {_TOP.format(t=_OVERLAP.replace('CAND', _BEST))} WHERE r <= 5", "weight")
def rerank(spark, d):
    found = vectors.best_per_id(candidates(spark, d))
    return reranked(spark, d, found).select("q", "id", "score")


_CASCADE = f"""WITH c AS (SELECT k.q, k.id, score, x.lang, x.source, CASE WHEN x.lang = CASE WHEN q % 3 = 0 THEN 'none' ELSE 'en' END AND x.source = 'src' || (q % 20) THEN 1 WHEN x.source = 'src' || (q % 25) THEN 2 ELSE 3 END AS stage
        FROM (SELECT q, doc_id AS id, round(sum(weight.w * y.w), 6) AS score FROM weight JOIN QUESTION y ON weight.term = y.term GROUP BY q, doc_id) k JOIN documents x ON k.id = x.doc_id),
    f AS (SELECT * FROM (SELECT *, min(stage) OVER (PARTITION BY q) AS first FROM c) WHERE stage = first),
    top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS r FROM f) WHERE r <= 10),
    again AS (SELECT c.q, c.id, c.stage, c.lang, c.source, round(len(list_intersect({_ASK}, {_SHARED})) / greatest(len({_ASK}), 1), 6) AS score FROM top c JOIN benchmark b ON c.q = b.item_id JOIN documents x ON c.id = x.doc_id)
    SELECT q, id, stage::INT AS stage, score, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS k FROM again) WHERE k <= 5"""


@query("search_cascade", _CASCADE.replace("QUESTION", _QUESTION), "weight")
def search_cascade(spark, d):
    """Three filters, each looser than the one before; of the first that lets a hit through, twice as
    many hits as asked for are reranked, and the best come with their payload."""
    hits = bm25.search(index(spark, d), M.table(spark, d, "benchmark"), "item_id", "text")[0].withColumn("score", F.round("score", 6))
    payload = M.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    src = lambda n: F.concat(F.lit("src"), (F.col("q") % n).cast("string"))
    tight = (F.col("lang") == F.when(F.col("q") % 3 == 0, "none").otherwise("en")) & (F.col("source") == src(20))
    staged = written(hits.join(payload, "id").withColumn("stage", F.when(tight, 1).when(F.col("source") == src(25), 2).otherwise(3)), "staged")
    first = staged.groupBy("q").agg(F.min("stage").alias("stage"))
    top = vectors.top_k(staged.join(first, ["q", "stage"]), 10).drop("score", "rank")
    best = reranked(spark, d, top, 5)
    return best.join(top, ["q", "id"]).select("q", "id", "stage", "score", "lang", "source")

"""Sparse retrieval: BM25 with term strings as keys and document frequencies over the whole corpus.

A corpus is tokenised once into a written table, with each document's length and norm computed in
its own row. Whatever asks for some terms takes these only, before anything is counted or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import broadcast_checked, spread, written

K1, B = 1.2, 0.75


def _norm(sorted_terms: Column) -> Column:
    """Length of the vector of 1 + ln tf, from a document's terms in order: runs of equal terms are counted."""
    add = lambda a: F.when(a["run"] > 0, (1 + F.ln(a["run"])) * (1 + F.ln(a["run"]))).otherwise(F.lit(0.0))
    start = F.struct(F.lit("").alias("term"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))

    def step(a: Column, x: Column) -> Column:
        same = a["term"] == x
        return F.struct(x.alias("term"), F.when(same, a["run"] + 1).otherwise(F.lit(1.0)).alias("run"), F.when(same, a["sum"]).otherwise(a["sum"] + add(a)).alias("sum"))

    return F.aggregate(sorted_terms, start, step, lambda a: F.sqrt(a["sum"] + add(a)))


#: From rows ``(id, text)`` to ``(id, terms)``: another tokenizer than ``functions.text.tokens``.
Cut = Callable[[DataFrame], DataFrame]


def tokenised(docs: DataFrame, id_col: str, text_col: str, norm: bool = True, cut: Cut | None = None) -> DataFrame:
    """``(id, t, dl, norm)``: a document's terms in order, their number and the norm of their lexical weights (null without ``norm``)."""
    if cut is None:
        found = docs.select(F.col(id_col).alias("id"), F.sort_array(T.tokens(F.col(text_col))).alias("t"))
    else:
        found = cut(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select("id", F.sort_array("terms").alias("t"))
    return found.select("id", "t", F.size("t").cast("long").alias("dl"), (_norm(F.col("t")) if norm else F.lit(None).cast("double")).alias("norm"))


def counted(rows: DataFrame, among: DataFrame | None = None, uses: int | None = None) -> DataFrame:
    """Postings ``(id, term, tf, dl, norm)`` of tokenised documents, with ``among(term)`` of these terms only.

    A document's terms are counted in its own task; the shuffle moves a row for each distinct one. With the number of
    ``uses`` of all terms, documents are dealt over as many tasks as these need, and the shuffle moves a row for each use."""
    each = rows.select("id", "dl", "norm", F.explode("t").alias("term"))
    if among is not None:
        each = each.join(broadcast_checked(among.select("term").distinct()), "term", "left_semi")
    if uses is not None:
        each = spread(each, uses, "id")
    return each.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"), F.first("norm").alias("norm"))


@dataclass
class Index:
    """Tokenised documents, the one-row table ``(n_docs, avg_dl)`` and the tokenizer, which queries need too."""

    docs: DataFrame
    size: DataFrame
    cut: Cut | None = None

    def postings(self, among: DataFrame | None = None) -> DataFrame:
        uses = self.docs.agg(F.sum("dl")).first()[0] or 0
        return written(counted(self.docs, among, uses), "postings")


def index(docs: DataFrame, id_col: str, text_col: str, norm: bool = True, cut: Cut | None = None) -> Index:
    """An index; without ``norm`` for BM25 alone."""
    rows = written(tokenised(docs, id_col, text_col, norm, cut), "tokenised")
    return Index(rows, rows.agg(F.count(F.lit(1)).alias("n_docs"), (F.sum("dl") / F.count(F.lit(1))).alias("avg_dl")), cut)


def fit(postings: DataFrame, size: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Term table ``(term, df, idf)`` of the postings' terms in a corpus of the given size."""
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = F.col("n_docs") - F.col("df")
    # the second side is a single row
    return df.join(F.broadcast(size)).select("term", "df", F.ln((n + 0.5) / (F.col("df") + 0.5) + 1).alias("idf")), size


def save(model: tuple[DataFrame, DataFrame], path: str) -> None:
    model[0].write.mode("overwrite").parquet(f"{path}/terms")
    model[1].write.mode("overwrite").parquet(f"{path}/size")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/size")


def vocabulary(known: DataFrame) -> DataFrame:
    """Number the terms from 0, the most frequent first: sorted by range, counted by partition."""
    lines = written(known.orderBy(F.desc("df"), "term").withColumn("_m", F.monotonically_increasing_id()), "vocabulary")
    part = F.shiftright("_m", 33).alias("_part")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = lines.groupBy(part).agg(F.count(F.lit(1)).alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    numbered = lines.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return numbered.select("term", "df", (F.col("_before") + F.col("_m").bitwiseAND((1 << 33) - 1)).alias("idx"))


def pack(postings: DataFrame, numbers: DataFrame) -> DataFrame:
    """Sparse vectors ``(id, indices, values)``: term numbers in order, with their counts."""
    entry = F.sort_array(F.collect_list(F.struct("idx", "tf")))
    rows = postings.join(numbers.select("term", "idx"), "term").groupBy("id").agg(entry.alias("e"))
    return rows.select("id", F.transform("e", lambda x: x["idx"]).alias("indices"), F.transform("e", lambda x: x["tf"]).alias("values"))


def weights(postings: DataFrame, model: tuple[DataFrame, DataFrame], k1: float = K1, b: float = B) -> DataFrame:
    """``(id, term, w)``; terms the model does not know are left out."""
    known, size = model
    tf = F.col("tf")
    w = F.col("idf") * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))
    return postings.join(known, "term").join(F.broadcast(size)).select("id", "term", w.alias("w"))


def lexical(postings: DataFrame) -> DataFrame:
    """Stand-in for learned term weights: 1 + ln tf, normalised to unit length per document."""
    return postings.select("id", "term", ((1 + F.ln("tf")) / F.col("norm")).alias("w"))


def score(queries: DataFrame, postings: DataFrame, rows: int) -> DataFrame:
    """``(q, id, score)``: sparse dot products of queries ``(id, term, w)`` with postings, of which there are ``rows``.

    Postings are laid out by document first: they are fewer than the pairs, which are then summed where they are made, in
    as many tasks as the postings need."""
    q = broadcast_checked(queries.select(F.col("id").alias("q"), "term", F.col("w").alias("qw")))
    return spread(postings, rows, "id").join(q, "term").groupBy("q", "id").agg(F.sum(F.col("w") * F.col("qw")).alias("score"))


def search(ix: Index, queries: DataFrame, id_col: str, text_col: str, pool: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """BM25 and lexical scores ``(q, id, score)`` of the documents for query texts, those in ``pool(id)`` only if given.

    Terms are weighted by the whole corpus; lexical scores are null if the index has no norms. Only postings of the queries' terms are weighted and joined."""
    asked = written(counted(tokenised(queries, id_col, text_col, cut=ix.cut)), "asked")
    hits = ix.postings(asked)
    model = fit(hits, ix.size)
    found = hits if pool is None else hits.join(pool.select("id").distinct(), "id", "left_semi")
    rows = hits.count()
    return score(weights(asked, model), weights(found, model), rows), score(lexical(asked), lexical(found), rows)

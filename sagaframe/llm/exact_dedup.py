"""Exact duplicates by skew-safe combining.

Three combining stages, each of which groups by the digest *and* the whole text, so two
texts that share a digest never meet:

1. local: the map side of the first aggregation collapses copies within a task;
2. salted: the partial groups meet under (digest, salt, text), the salt being a block of
   ``BLOCK_ROWS`` rows of an input partition, so that a text held by a third of all rows is
   spread over many tasks. A salted group keeps its rows but for the text, at most
   ``BLOCK_ROWS``, and gets a number when it is written;
3. global: the salted groups, without their rows, meet under (digest, text).

The verdict goes back to each salted group by its number, so no digest decides anything and the
rows of a text that is held very often are never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: Rows of an input partition that share a salt: 2 to this power.
BLOCK_BITS = 16
BLOCK_ROWS = 1 << BLOCK_BITS


def salted_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bits: int = BLOCK_BITS, digest=None) -> DataFrame:
    """Stages 1 and 2: ``(__uid, __key, __sha, __text, __best, __n, __rows)``, a row per text and salt, written once."""
    key = (digest or (lambda c: F.sha2(c, 256)))(F.col("__text"))
    others = F.struct(F.struct(*[F.col(c) for c in docs.columns if c != text_col]).alias("of"), F.col(text_col).isNull().alias("null"))
    salt = F.shiftrightunsigned(F.monotonically_increasing_id(), block_bits)
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"), others.alias("__row"), salt.alias("__salt"))
    salted = rows.withColumn("__key", key).groupBy("__key", "__salt", "__text").agg(F.max("__id").alias("__best"), F.count(F.lit(1)).alias("__n"), F.collect_list("__row").alias("__rows"))
    sha = F.sha2("__text", 256) if digest else F.col("__key")
    return materialize(salted.select(F.monotonically_increasing_id().alias("__uid"), "__key", sha.alias("__sha"), "__text", "__best", "__n", "__rows"), "salted")


def verdicts(salted: DataFrame) -> DataFrame:
    """Stage 3: ``(__uid, __keep, __size)`` of every salted group, whole texts compared."""
    groups = salted.groupBy("__key", "__text").agg(F.max("__best").alias("__keep"), F.sum("__n").alias("__size"), F.collect_list("__uid").alias("__uids"))
    return groups.select("__keep", "__size", F.explode("__uids").alias("__uid"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bits: int = BLOCK_BITS, digest=None, only_kept: bool = False) -> DataFrame:
    """Add ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` to every row of ``docs``.

    Texts are equal when their bytes are, however long; a null text counts as empty. Of equal
    texts the row with the largest id stays. A null id never wins over a number; where all ids
    of a group are null, ``keep_id`` is null and all its rows stay. Rows that repeat id and text
    count in ``group_size`` and share the verdict. Columns of the input are kept, those with
    the names of the added columns are replaced. An empty table gives an empty result. With
    ``only_kept`` only the rows that stay are returned.
    """
    added = ("keep_id", "group_size", "kept", "text_sha256")
    salted = salted_groups(docs, id_col, text_col, block_bits, digest)
    told = salted.drop("__key", "__n").join(verdicts(salted), "__uid")
    if only_kept:
        told = told.filter(F.col("__best").eqNullSafe(F.col("__keep")))
    rows = told.select("__sha", "__text", "__keep", "__size", F.explode("__rows").alias("__row"))
    stays = F.col("__keep").eqNullSafe(F.col("__row.of")[id_col])
    if only_kept:
        rows = rows.filter(stays)
    own = [(F.when(~F.col("__row.null"), F.col("__text")) if c == text_col else F.col("__row.of")[c]).alias(c) for c in docs.columns if c not in added]
    return rows.select(*own, F.col("__keep").alias("keep_id"), F.col("__size").alias("group_size"), stays.alias("kept"), F.col("__sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``; nulls, repeats and empty tables as in ``exact_dedup``."""
    renamed = docs.select(F.col(id_col).alias("__i"), F.col(text_col).alias("__t"), F.struct(*[c for c in docs.columns if c != text_col]).alias("__o"))
    kept = exact_dedup(renamed, "__i", "__t", only_kept=True)
    return kept.select(*[(F.col("__t") if c == text_col else F.col("__o")[c]).alias(c) for c in docs.columns])


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {"op8_exact_dedup": op8_exact_dedup}

ORACLES = {
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """
}

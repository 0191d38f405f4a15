"""A corpus pipeline over ``documents``: each stage works on all that its predecessor kept.

Stages are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.
Every stage but the last returns the columns of ``documents``. ``run`` writes each stage's
result as Parquet in the shared folder and reads it back for the next one.

In every stage a null text counts as an empty one, a text may be of any length, further columns
go along whatever their names, and an empty table gives an empty one. Rows without an id stay in
all stages, but where they repeat a text that a row with an id has. Rows that repeat an id and
text are copies of each other that no stage tells apart: they stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sagaframe.llm import bpe, exact_dedup, mixing, simhash, toxicity
from sagaframe.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. The model learns from the labelled rows of the input table."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group of near copies the document with the smallest id stays."""
    return simhash.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat, or go, so that sources have their target weights; rows come shuffled."""
    return mixing.mix_sources(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document that is left, a row for each of its copies."""
    return bpe.encode_documents(docs, full=False)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash_near_dedup", drop_near_copies), ("poisson_mixing", mix), ("bpe_codec", encode)]

#: The stages' classifier, fingerprints and tokenizer are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

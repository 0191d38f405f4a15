"""Finding many fixed strings in texts, and pairing similar names, without comparing all with all."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns in one automaton; a larger dictionary is searched for in several passes.
SHARD = 200_000

_automata: dict[int, object] = {}


def _automaton(shared):
    """The automaton of a broadcast list of patterns, built once by a worker."""
    import ahocorasick

    if shared.value[0] not in _automata:
        _automata.clear()
        found = ahocorasick.Automaton()
        for p in shared.value[1]:
            found.add_word(p, p)
        found.make_automaton()
        _automata[shared.value[0]] = found
    return _automata[shared.value[0]]


def containing(rows: DataFrame, patterns: DataFrame, id_col: str = "id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """``(id, pattern)``: which of the strings ``patterns(pattern)`` are in a row's text, each once a row.

    An Aho-Corasick automaton reads a text once, however many patterns there are. An automaton has at most
    ``shard`` patterns, which is what the driver and a broadcast hold; beyond that, patterns are dealt into
    shards by a hash and the texts are read once for each. The empty string is in every text; a null
    text holds nothing, and a null pattern is none."""
    spark, kind = rows.sparkSession, rows.schema[id_col].dataType.simpleString()
    distinct = patterns.select("pattern").filter("pattern IS NOT NULL").distinct()
    shards = max(1, -(-distinct.count() // (shard * 3 // 4)))  # a quarter is left, as a hash deals unevenly
    texts = rows.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(shared)
            for batch in batches:
                at, found = [], []
                for k, text in enumerate(batch.column(1).to_pylist()):
                    hits = sorted({p for _, p in automaton.iter(text)})
                    at += [k] * len(hits)
                    found += hits
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], names=["id", "pattern"])

        return run

    parts = [texts.join(F.broadcast(distinct.filter("pattern = ''")), how="inner").select("id", "pattern")]  # one row at most
    for k in range(shards):
        some = [r.pattern for r in distinct.filter("pattern <> ''").filter(F.pmod(F.xxhash64("pattern"), F.lit(shards)) == k).collect()]
        if some:
            shared = spark.sparkContext.broadcast((hash((k, shards, len(some), some[0], some[-1])), some))
            parts.append(texts.mapInArrow(search(shared), f"id {kind}, pattern string"))
    return reduce(DataFrame.unionByName, parts)


def _letters(name: Column) -> Column:
    """A name's letters, each with its count so far, so that multisets are sets."""
    sorted_ = F.array_sort(F.filter(F.split(name, ""), lambda x: x != ""))
    return F.transform(sorted_, lambda x, i: F.concat(x, (i - F.array_position(sorted_, x)).cast("string")))


def similar_pairs(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """Pairs ``(name, other)`` of the names ``left(name)`` and ``right(other)`` that share at least ``cutoff`` of their
    letters: twice the letters in common (as a multiset), over the sum of both lengths.

    Prefix filtering: a pair that is similar enough shares a letter among the rarest of each side, as many
    as a name can miss and one, so pairs come from an equi-join on those, and no pair is lost. Empty and null names have no pair."""
    a = left.select(F.col("name")).filter("name <> ''").distinct().select("name", _letters(F.col("name")).alias("letters"))
    b = right.select(F.col("other").alias("name")).filter("name <> ''").distinct().select("name", _letters(F.col("name")).alias("letters"))
    often = b.select(F.explode("letters").alias("letter")).groupBy("letter").agg(F.count(F.lit(1)).alias("n"))

    def rarest(side: DataFrame, label: str) -> DataFrame:
        each = side.select("name", F.size("letters").alias("size"), "letters", F.explode("letters").alias("letter")).join(often, "letter", "left")
        order = Window.partitionBy("name").orderBy(F.coalesce("n", F.lit(0)), "letter")
        # of n letters at least n * cutoff / (2 - cutoff) are shared; a hair less guards against rounding
        miss = F.col("size") - F.ceil(F.col("size") * F.lit(cutoff / (2 - cutoff)) - 1e-9)
        kept = each.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= miss + 1)
        return kept.select("letter", *[F.col(c).alias(f"{label}_{c}") for c in ("name", "size", "letters")])

    x, y = rarest(a, "a"), rarest(b, "b")
    n, m = F.col("a_size"), F.col("b_size")
    met = x.join(y, "letter").filter(2 * F.least(n, m) >= cutoff * (n + m) - 1e-9)
    met = met.groupBy("a_name", "b_name").agg(*[F.first(c).alias(c) for c in ("a_size", "b_size", "a_letters", "b_letters")])
    shared = F.size(F.array_intersect("a_letters", "b_letters"))
    return met.filter(2 * shared >= cutoff * (n + m) - 1e-9).select(F.col("a_name").alias("name"), F.col("b_name").alias("other"))

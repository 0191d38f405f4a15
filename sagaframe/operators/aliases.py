"""Alias dictionaries: merging, checking, and resolving names with them."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import broadcast_checked
from .patterns import similar_pairs

TYPES = ["Character", "Faction", "Place", "Item", "Concept", "Event"]
FUZZY_CUTOFF = 0.7


def duplicate_keys(entries: DataFrame) -> DataFrame:
    """Keys that more than one scope or type file holds."""
    return entries.groupBy("key").agg(F.countDistinct("scope", "entity_type").alias("n")).filter("n > 1")


def merge(parts: list[DataFrame]) -> DataFrame:
    """Union of dictionaries; a key that several of them hold raises when the result is read."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    held = Window.partitionBy("key")
    n = F.size(F.collect_set(F.concat_ws("/", "scope", "entity_type")).over(held))
    return out.withColumn("key", F.when(n > 1, F.raise_error(F.concat(F.lit("duplicate alias key "), F.col("key"))).cast("string")).otherwise(F.col("key")))


def write_split(entries: DataFrame, path: str) -> None:
    """One folder for each scope and type."""
    entries.write.mode("overwrite").partitionBy("scope", "entity_type").json(path)


def read_split(spark, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def lint(entries: DataFrame) -> DataFrame:
    """``(key, fault)``: no canonical name, no type, a type unknown, a key held twice."""
    rows = entries.select("scope", "key", "canonical", "entity_type").distinct()
    faults = [
        rows.filter("canonical IS NULL OR canonical = ''").select("key", F.lit("missing_canonical").alias("fault")),
        rows.filter("entity_type IS NULL OR entity_type = ''").select("key", F.lit("missing_type").alias("fault")),
        rows.filter(~F.col("entity_type").isin(TYPES)).select("key", F.lit("wrong_type").alias("fault")),
        duplicate_keys(rows).select("key", F.lit("duplicate_key").alias("fault")),
    ]
    out = faults[0]
    for f in faults[1:]:
        out = out.unionByName(f)
    return out.distinct()


def resolve(names: DataFrame, entries: DataFrame, name_col: str = "name", fold_case: bool = False, told: bool = False) -> DataFrame:
    """Add ``canonical``: of the alias that equals the name, else, with ``fold_case``, of one that
    equals it in small letters, else the name itself. ``told`` adds whether an alias was found."""
    exact = entries.groupBy("alias").agg(F.min("canonical").alias("_exact"))
    out = names.join(broadcast_checked(exact), F.col(name_col) == F.col("alias"), "left").drop("alias")
    found = [F.col("_exact")]
    if fold_case:
        loose = entries.groupBy(F.lower("alias").alias("_low")).agg(F.min("canonical").alias("_loose"))
        out = out.join(broadcast_checked(loose), F.lower(name_col) == F.col("_low"), "left")
        found.append(F.col("_loose"))
    hit = F.coalesce(*found) if len(found) > 1 else found[0]
    out = out.withColumn("canonical", F.coalesce(hit, F.col(name_col)))
    return (out.withColumn("told", hit.isNotNull()) if told else out).drop("_exact", "_low", "_loose")


def _likeness(name: pd.Series, other: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, b, a).ratio() for a, b in zip(name, other)])


def resolve_fuzzy(names: DataFrame, entries: DataFrame, name_col: str = "name", type_col: str | None = None, cutoff: float = FUZZY_CUTOFF) -> DataFrame:
    """As ``resolve`` with ``fold_case``; a name without an alias goes to the closest canonical name,
    among those of its type if there are any.

    Each distinct name is compared once, and only with names that share enough letters: two strings
    cannot be more alike than the letters they share."""
    known = resolve(names, entries, name_col, True, told=True).withColumn("_kind", F.col(type_col) if type_col else F.lit(None).cast("string"))
    dictionary = entries.select("canonical", "entity_type").distinct()
    kinds = dictionary.select(F.col("entity_type").alias("_kind"), F.lit(True).alias("_typed")).distinct()
    rest = known.filter("NOT told").select(F.col(name_col).alias("_name"), "_kind").distinct().join(broadcast_checked(kinds), "_kind", "left")
    close = similar_pairs(rest.select(F.col("_name").alias("name")), dictionary.select(F.col("canonical").alias("other")), cutoff)
    pairs = rest.join(close, F.col("_name") == F.col("name")).join(dictionary, F.col("other") == F.col("canonical"))
    pairs = pairs.filter(F.col("_typed").isNull() | (F.col("_kind") == F.col("entity_type"))).select("_name", "_kind", "canonical").distinct()
    scored = pairs.withColumn("r", F.pandas_udf(_likeness, "double")("_name", "canonical")).filter(F.col("r") >= cutoff)
    best = scored.groupBy("_name", "_kind").agg(F.max_by("canonical", F.struct("r", "canonical")).alias("_close"))
    joined = known.join(broadcast_checked(best), (F.col(name_col) == F.col("_name")) & known["_kind"].eqNullSafe(best["_kind"]), "left")
    canonical = F.when(F.col("told"), F.col("canonical")).otherwise(F.coalesce("_close", F.col("canonical"))).alias("canonical")
    return joined.select(*names.columns, canonical)


def all_names(entries: DataFrame) -> DataFrame:
    """Each canonical name with the sorted list of its names, itself included."""
    return entries.select("canonical", F.explode(F.array("canonical", "alias")).alias("n")).groupBy("canonical").agg(F.array_sort(F.collect_set("n")).alias("names"))


def additions(entries: DataFrame, new: DataFrame) -> DataFrame:
    """New entries whose key no file holds yet."""
    return new.join(entries.select("key").distinct(), "key", "left_anti")

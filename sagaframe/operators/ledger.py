"""Change detection and the content-addressed cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed(files: DataFrame, tracking: DataFrame) -> DataFrame:
    """Files that are new or whose hash differs, with the reason."""
    old = tracking.select("file_path", F.col("content_hash").alias("_old"))
    joined = files.join(old, "file_path", "left").filter(~F.col("_old").eqNullSafe(F.col("content_hash")))
    return joined.withColumn("reason", F.when(F.col("_old").isNull(), "new").otherwise("changed")).drop("_old")


def usable(cache: DataFrame) -> DataFrame:
    """Entries in the present form; older ones are misses."""
    return cache.filter("raw").select("content_hash", "payload")


def actions(files: DataFrame, tracking: DataFrame, cache: DataFrame, force: bool = False) -> DataFrame:
    """What an extraction run does with each file: skip, retrack or extract."""
    seen = tracking.select("file_path", F.col("content_hash").alias("_old"))
    hits = usable(cache).select("content_hash", F.lit(True).alias("_hit"))
    joined = files.join(seen, "file_path", "left").join(hits, "content_hash", "left")
    hit, same = F.coalesce("_hit", F.lit(False)), F.col("_old").eqNullSafe(F.col("content_hash"))
    action = F.when(F.lit(force) | ~hit, "extract").when(same, "skip").otherwise("retrack")
    return joined.withColumn("action", action).drop("_old", "_hit")


def orphans(cache: DataFrame, files: DataFrame) -> DataFrame:
    """Cache entries that no file refers to."""
    return cache.join(files.select("content_hash").distinct(), "content_hash", "left_anti")


def track(tracking: DataFrame, done: DataFrame) -> DataFrame:
    """The ledger after a run: rows of the files that were done replace their old ones."""
    return tracking.join(done.select("file_path"), "file_path", "left_anti").unionByName(done)

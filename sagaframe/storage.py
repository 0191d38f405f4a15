"""Intermediate tables in the folder that all executors share, and joins of checked size."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join is broadcast.
BROADCAST_ROWS = 20_000
#: Names up to which a set of them, one column, is broadcast.
BROADCAST_NAMES = 1_500_000
#: Names that a block of 4096 numbers takes the place of in a broadcast, by its size.
BLOCK_NAMES = 16
#: Rows of a large table that one task takes from a shuffle.
TASK_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, or the directory set by ``setCheckpointDir``.

    Where neither is set, a session within one process gets a temporary folder; a cluster has no
    folder that could stand in, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get()


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet and read back: computed once, and safe from lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_checked(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``small``, marked for broadcast only if a count (of at most ``rows`` and one) shows it small."""
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by its keys over as many tasks as ``rows`` need, so that a task's memory does not grow with the table."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys)


def _numbered(df: DataFrame, col: str) -> DataFrame:
    """``df`` with the place of a name in a set of blocks: ``_head`` and ``_block``, and the bit ``_bit`` of the block's ``_word``.

    A name is what stands before its number, and the number without leading zeros; any other name is a block of its own (-1), and
    null is nowhere (-2). No place is null, as Spark would else ask each part for null before a join, and work it out anew for that."""
    tail = F.substring(col, F.length("_head") + 1, F.length(col))
    number = F.when((F.length("_tail") == 1) | ~F.col("_tail").startswith("0"), F.col("_tail").try_cast("bigint"))
    df = df.withColumn("_head", F.rtrim(col, F.lit("0123456789"))).withColumn("_tail", tail).withColumn("_number", number)
    n = F.col("_number")
    place = {"_head": F.coalesce(F.when(n.isNull(), F.col(col)).otherwise(F.col("_head")), F.lit(""))}
    place["_block"] = F.coalesce(F.shiftright(n, 12), F.when(F.col(col).isNull(), -2).otherwise(-1).cast("bigint"))
    place |= {"_word": F.coalesce((F.shiftright(n, 6) % 64).cast("int"), F.lit(0)), "_bit": F.coalesce((n % 64).cast("int"), F.lit(0))}
    return df.withColumns(place).drop("_tail", "_number")


def name_set(names: DataFrame) -> DataFrame | None:
    """The one column of ``names``, a written table, in a form that is broadcast, or nothing if it is too large for that.

    Few names are a set of strings. Names that end in numbers, however many, are bits in blocks of 4096 numbers."""
    names = names.toDF("_name")
    if names.count() <= BROADCAST_NAMES:
        return names.distinct()
    placed = _numbered(names.filter("_name IS NOT NULL"), "_name")
    most = BROADCAST_NAMES // BLOCK_NAMES
    if placed.select("_head", "_block").distinct().limit(most + 1).count() <= most:
        words = placed.groupBy("_head", "_block", "_word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_bit"))).alias("_bits"))
        return written(words.groupBy("_head", "_block").agg(F.map_from_entries(F.collect_list(F.struct("_word", "_bits"))).alias("_words")), "blocks")
    names = names.distinct()
    return names if names.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES else None


def marked(df: DataFrame, col: str, few: DataFrame, mark: str) -> DataFrame:
    """``df`` with a column ``mark``: whether ``col`` is in a set of names that ``name_set`` gave. Nothing is shuffled."""
    if few.columns == ["_name"]:
        return df.join(F.broadcast(few), F.col(col) == F.col("_name"), "left").withColumn(mark, F.col("_name").isNotNull()).drop("_name")
    held = F.broadcast(few.toDF("_head_of", "_block_of", "_words"))
    bit = F.call_function("getbit", F.col("_words")[F.col("_word")], F.col("_bit")) == 1
    on = (F.col("_head") == F.col("_head_of")) & (F.col("_block") == F.col("_block_of")) & bit
    return _numbered(df, col).join(held, on, "left").withColumn(mark, F.col("_head_of").isNotNull()).select(*df.columns, mark)


def among(df: DataFrame, col: str, names: DataFrame, few: DataFrame | None, rows: int, how: str = "left_semi") -> DataFrame:
    """As ``having``, for a caller that has ``few`` from ``name_set``; where that gave nothing both sides are dealt over tasks."""
    if few is None:
        return spread(df, rows, col).join(spread(names.toDF(col), rows, col), col, how)
    return marked(df, col, few, "_in").filter("_in" if how == "left_semi" else "NOT _in").drop("_in")


def having(df: DataFrame, col: str, names: DataFrame, rows: int, how: str = "left_semi") -> DataFrame:
    """The rows of ``df``, of which there are ``rows``, whose ``col`` is among the one column of ``names`` (with ``left_anti``: is not).

    A set of names that can be broadcast is; with others the rows are dealt over tasks by their number."""
    return among(df, col, names, name_set(names), rows, how)

"""Reading dialogue files and keeping ledgers and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHAPTERS, STORIES = "chapter*_dialogue.txt", "story.txt"
#: Task and name in a file's path.
LAYOUT = r"([^/]+)/([^/]+)$"


def files_of(raw: DataFrame, layout: str = LAYOUT, *more: Column) -> DataFrame:
    """``(file_path, task_id, content)`` of whole texts ``value`` with their ``_metadata``, and ``more`` columns.

    ``layout`` takes the task and the file's name from the path. A byte-order mark and carriage
    returns are dropped; this holds for a batch and for a stream alike, so hashes agree."""
    path = F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B"))
    task = F.regexp_extract(path, layout, 1)
    content = F.regexp_replace(F.regexp_replace("value", "^\ufeff", ""), "\r\n?", "\n")
    return raw.select(F.concat_ws("/", task, F.regexp_extract(path, layout, 2)).alias("file_path"), task.alias("task_id"), content.alias("content"), *more)


def scan(spark: SparkSession, path: str, pattern: str = CHAPTERS, recursive: bool = True, layout: str = LAYOUT, blank: bool = False) -> DataFrame:
    """``(file_path, task_id, content)`` of all files below ``path`` that match, one row a file.

    ``task_id`` is the file's folder. Without ``recursive`` only the files right in ``path`` are
    read. Blank files are left out unless ``blank`` asks for them; a file of no bytes gives no row."""
    found = files_of(spark.read.text(path, wholetext=True, recursiveFileLookup=recursive, pathGlobFilter=pattern), layout)
    return found if blank else found.filter(F.trim(F.regexp_replace("content", "\\s", "")) != "")


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table; a missing one counts as empty."""
    where = _path(spark, path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def export_snapshot(nodes: DataFrame, edges: DataFrame, points: DataFrame, path: str) -> None:
    """Nodes, edges and points as gzipped JSON lines, and a manifest with their counts, which are taken while the rows are written."""
    counts = []
    for name, df in {"nodes": nodes, "relationships": edges, "points": points}.items():
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(f"{path}/{name}", compression="gzip")
        counts.append((name, seen.get["n"]))
    nodes.sparkSession.createDataFrame(counts, "part string, n bigint").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def import_snapshot(spark: SparkSession, path: str, schemas: dict) -> dict[str, DataFrame]:
    """The parts of a snapshot by name, and its manifest."""
    out = {name: spark.read.schema(kind).json(f"{path}/{name}") for name, kind in schemas.items()}
    out["manifest"] = spark.read.schema("part string, n bigint").json(f"{path}/manifest")
    return out


def replace_table(df: DataFrame, path: str) -> None:
    """Write beside the old table, set the old one aside, and put the new one in its place.

    An empty table replaces nothing (ValueError). At any time one whole table is there: after a
    crash it is at ``path`` or, set aside, at ``path``.old."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(path + ".new")
    new, old, aside = (_path(spark, path + end) for end in (".new", "", ".old"))
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if spark.read.schema(df.schema).parquet(path + ".new").isEmpty():
        fs.delete(new, True)
        raise ValueError(f"an empty table cannot replace {path}")
    fs.delete(aside, True)
    if fs.exists(old) and not fs.rename(old, aside):
        raise OSError(f"{path} cannot be set aside")
    if not fs.rename(new, old):
        fs.rename(aside, old)
        raise OSError(f"{path}.new cannot take the place of {path}")
    fs.delete(aside, True)


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Write the partitions that occur in ``df``; the table's other partitions are not touched."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)

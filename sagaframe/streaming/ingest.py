"""Incremental ingest as a stream of new files.

The file source sees new paths, not edits, so every micro-batch goes through the ledger: files
whose hash is known are passed over, and what was done is tracked after it is written. Both
tables are partitioned by task, and a run rewrites only the partitions of tasks that have a
changed file. A run that fails between the two writes is made good by the next one: its files
are still untracked, and their chunks are written again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import documents, ledger
from ..sources.files import LAYOUT, files_of, read_or_empty, replace_partitions
from ..storage import broadcast_checked, written

TRACKING = "file_path string, content_hash string, last_processed timestamp, chunks bigint, task_id string"
CHUNKS = "file_path string, pos bigint, title string, text string, chapter int, scene_order int, chunk_order int, id string, event_order bigint"
ENRICHED = ", entities array<string>, characters array<string>, has_choice boolean"


def ingest_batch(
    files: DataFrame, tracking_path: str, chunks_path: str, aliases: DataFrame | None = None, embed: Callable[[DataFrame], DataFrame] | None = None, dry_run: bool = False
) -> DataFrame | None:
    """Chunk the changed files of ``(file_path, task_id, content)``, replace their chunks, track them.

    Gives ``(file_path, task_id, content_hash, chunks)`` of the changed files, None if there are
    none. A file without chunks is tracked with 0, and loses the chunks it had; a path that comes
    twice in one batch counts once, with the greater hash. With ``aliases`` chunks are enriched; ``embed`` adds
    a ``vector`` to them. A dry run writes neither chunks nor ledger."""
    spark = files.sparkSession
    tracking = read_or_empty(spark, tracking_path, TRACKING)
    one = files.withColumn("content_hash", F.md5("content")).groupBy("file_path").agg(F.max_by(F.struct("task_id", "content", "content_hash"), "content_hash").alias("f"))
    todo = ledger.changed(one.select("file_path", "f.*"), tracking).select("file_path", "task_id", "content", "content_hash")
    todo = written(todo, "changed")
    if todo.isEmpty():
        return None
    pieces = documents.order_chunks(documents.chunk_documents(documents.split_scenes(todo)))
    schema = CHUNKS
    if aliases is not None:
        pieces, schema = documents.enrich(pieces, aliases), schema + ENRICHED
    if embed is not None:
        pieces, schema = embed(pieces), schema + ", vector array<float>"
    schema += ", task_id string"
    pieces = written(pieces, "chunks")
    counts = pieces.groupBy("file_path").agg(F.count(F.lit(1)).alias("chunks"))
    done = todo.join(counts, "file_path", "left").select("file_path", "task_id", "content_hash", F.coalesce("chunks", F.lit(0)).alias("chunks"))
    if dry_run:
        return done
    touched = broadcast_checked(todo.select("task_id").distinct())
    old = read_or_empty(spark, chunks_path, schema).join(touched, "task_id", "left_semi")
    kept = old.join(todo.select("file_path"), "file_path", "left_anti")
    columns = [c for c in read_or_empty(spark, chunks_path, schema).columns if c != "task_id"]
    # a task that has lost its last chunk keeps a partition without rows of files: one empty row
    hollow = touched.join(pieces.select("task_id").unionByName(kept.select("task_id")).distinct(), "task_id", "left_anti")
    nothing = hollow.select(*[F.lit(None).alias(c) for c in columns], "task_id")
    replace_partitions(kept.select(*columns, "task_id").unionByName(pieces.select(*columns, "task_id")).unionByName(nothing), chunks_path, "task_id")
    rows = done.select("file_path", "content_hash", F.current_timestamp().alias("last_processed"), "chunks", "task_id")
    replace_partitions(ledger.track(tracking.join(touched, "task_id", "left_semi").select(*rows.columns), rows), tracking_path, "task_id")
    return done


def ingested(spark: SparkSession, chunks_path: str, enriched: bool = False, vectors: bool = False) -> DataFrame:
    """The chunks that ``ingest_batch`` has written."""
    schema = CHUNKS + (ENRICHED if enriched else "") + (", vector array<float>" if vectors else "") + ", task_id string"
    return read_or_empty(spark, chunks_path, schema).filter("file_path IS NOT NULL")


def ingest_stream(
    spark: SparkSession, source: str, pattern: str, tracking_path: str, chunks_path: str, checkpoint: str, layout: str = LAYOUT, **options
) -> StreamingQuery:
    """Take in all files that are there now, then stop; ``options`` are those of ``ingest_batch``."""
    reader = spark.readStream.schema("value string").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    stream = files_of(reader.text(source, wholetext=True), layout)

    def take(df: DataFrame, _: int) -> None:
        ingest_batch(df, tracking_path, chunks_path, **options)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

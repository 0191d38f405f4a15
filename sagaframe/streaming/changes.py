"""Incremental ingest by what has changed in a folder: new, edited and deleted files.

A run compares the listing of the folder (path, size, time of change; Spark lists it without
opening a file) with the ledger of the last commit. Files whose size or time differ are read and
hashed, the others are not opened: no file older than the oldest of them is. Chunks and
ledger, which holds the listing, are tables of one store, and a run is one commit of both, so a
run that stops leaves the old state and the next one does the same work. Only buckets with a
changed file are written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents
from ..sources.files import CHAPTERS, LAYOUT, files_of
from ..sources.versions import Store, Transaction
from ..storage import written
from .ingest import CHUNKS, ENRICHED

LEDGER = "file_path string, task_id string, size bigint, modified timestamp, content_hash string, chunks bigint, last_processed timestamp"
PIECES = CHUNKS + ", task_id string"


def found_in(spark: SparkSession, source: str, pattern: str = CHAPTERS, recursive: bool = True) -> DataFrame:
    """The files below ``source``, listed once, whatever is then asked of them. One that is gone when it is read is passed over."""
    return spark.read.format("binaryFile").options(recursiveFileLookup=recursive, pathGlobFilter=pattern, ignoreMissingFiles=True).load(source)


def listing(found: DataFrame, layout: str = LAYOUT) -> DataFrame:
    """``(file_path, task_id, size, modified)`` of the files of ``found_in``. Of files
    with one name in the layout the latest counts. Spark lists no file without bytes."""
    meta = found.select("_metadata", F.lit("").alias("value"))
    named = files_of(meta, layout, F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified"))
    last = F.max_by(F.struct("task_id", "size", "modified"), F.struct("modified", "size"))
    return named.groupBy("file_path").agg(last.alias("f")).select("file_path", "f.*")


def differences(now: DataFrame, ledger: DataFrame, full: bool = False) -> DataFrame:
    """Files whose listing differs from the ledger's, with ``seen``: new, touched or deleted. ``full`` takes all that are there."""
    old = ledger.select("file_path", F.col("size").alias("_size"), F.col("modified").alias("_modified"), F.col("content_hash").alias("_hash"), F.col("task_id").alias("_task"), F.lit(True).alias("_known"))
    both = now.withColumn("_there", F.lit(True)).join(old, "file_path", "full_outer")
    seen = F.when(F.col("_there").isNull(), "deleted").when(F.col("_known").isNull(), "new").when(F.lit(full) | ~F.col("size").eqNullSafe(F.col("_size")) | ~F.col("modified").eqNullSafe(F.col("_modified")), "touched")
    told = both.withColumn("seen", seen).filter("seen IS NOT NULL")
    return told.select("file_path", F.coalesce("task_id", "_task").alias("task_id"), "size", "modified", "_hash", "seen")


def ingest_changes(
    spark: SparkSession, source: str, store: Store, pattern: str = CHAPTERS, layout: str = LAYOUT, recursive: bool = True, full: bool = False, aliases: DataFrame | None = None,
    embed: Callable[[DataFrame], DataFrame] | None = None, dry_run: bool = False,
) -> DataFrame:
    """Bring the store's ``chunks`` and ``ledger`` up to date with the folder, in one commit.

    Gives ``(file_path, task_id, action, chunks)``: added, changed, deleted, or touched (listed anew
    with the same content; only the ledger is brought up to date). An edit that keeps both size and
    time is found by ``full`` only, which reads all files. A blank file has no chunks and is
    tracked with 0; one that has no byte left counts as deleted. With ``aliases`` chunks are enriched; ``embed`` adds a ``vector``. A dry
    run commits nothing. No change gives no rows."""
    schema = PIECES + (ENRICHED if aliases is not None else "") + (", vector array<float>" if embed is not None else "")

    def work(tx: Transaction) -> DataFrame:
        ledger = tx.read("ledger", LEDGER)
        found = found_in(spark, source, pattern, recursive)
        todo = written(differences(listing(found, layout), ledger, full), "differences")
        since = todo.agg(F.min("modified")).first()[0]
        raw = found.select("_metadata", F.col("content").cast("string").alias("value"))
        if since is not None:
            raw = raw.filter(F.col("_metadata.file_modification_time") >= F.lit(since))
        live = todo.filter("seen <> 'deleted'")
        bodies = files_of(raw, layout, F.col("_metadata.file_modification_time").alias("modified")).select("file_path", "modified", "content")
        bodies = bodies.join(live.select("file_path", "modified"), ["file_path", "modified"], "left_semi").groupBy("file_path").agg(F.max("content").alias("content"))
        read = live.join(bodies, "file_path", "left").withColumn("content", F.coalesce("content", F.lit(""))).withColumn("content_hash", F.md5("content"))
        same = F.col("content_hash").eqNullSafe(F.col("_hash"))
        read = written(read.withColumn("action", F.when(same, "touched").when(F.col("seen") == "new", "added").otherwise("changed")).drop("_hash", "seen"), "read")
        fresh = read.filter("action <> 'touched'")
        pieces = documents.order_chunks(documents.chunk_documents(documents.split_scenes(fresh.select("file_path", "task_id", "content"))))
        if aliases is not None:
            pieces = documents.enrich(pieces, aliases)
        if embed is not None:
            pieces = embed(pieces)
        old_ledger = ledger.select("file_path", F.col("chunks").alias("_chunks"))
        columns = [f.split()[0] for f in PIECES.split(", ")] + [c for c in pieces.columns if c in ("entities", "characters", "has_choice", "vector")]
        pieces = written(pieces.select(*columns), "pieces")
        counts = pieces.groupBy("file_path").agg(F.count(F.lit(1)).alias("_n"))
        rows = read.drop("content").join(counts, "file_path", "left").join(old_ledger, "file_path", "left")
        rows = written(rows.withColumn("chunks", F.when(F.col("action") == "touched", F.col("_chunks")).otherwise(F.coalesce("_n", F.lit(0)))).drop("_n", "_chunks"), "done")
        gone = todo.filter("seen = 'deleted'").select("file_path", "task_id")
        done = rows.select("file_path", "task_id", "action", "chunks").unionByName(gone.withColumn("action", F.lit("deleted")).withColumn("chunks", F.lit(0).cast("long")))
        if dry_run:
            return done
        keys = ["file_path"]
        stale = written(fresh.select("file_path").unionByName(gone.select("file_path")), "stale")
        if moved := tx.touched(keys, stale):
            kept = tx.read("chunks", schema, moved).join(stale, "file_path", "left_anti")
            tx.write("chunks", kept.select(*columns).unionByName(pieces), keys, moved)
        if listed := tx.touched(keys, todo):
            kept = ledger.filter(tx.bucket(*keys).isin(listed)).join(todo.select("file_path"), "file_path", "left_anti")
            now = rows.select("file_path", "task_id", "size", "modified", "content_hash", "chunks", F.current_timestamp().alias("last_processed"))
            tx.write("ledger", kept.select(*now.columns).unionByName(now), keys, listed)
        return done

    return store.run(work)

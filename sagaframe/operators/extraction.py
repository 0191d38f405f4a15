"""An extraction run with a content-addressed cache.

The extractor is a seam: a function from ``(content_hash, content)`` to ``(content_hash, payload)``, a
model call, say. It is asked once for each distinct content that has no usable entry, however many
files hold it. Entries are raw results; names are resolved when they are read. The cache is saved
bucket by bucket as it grows, so a run that stops goes on where it was, and what another run has
saved meanwhile is not asked for again. The ledger is saved when all of the run's entries are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.versions import Store, Transaction
from ..storage import written
from . import ledger

CACHE = "content_hash string, raw boolean, payload string"
LEDGER = "file_path string, content_hash string, task_id string, last_processed timestamp"


def _fill(tx: Transaction, contents: DataFrame, bucket: int, extract: Callable[[DataFrame], DataFrame], force: bool) -> None:
    held = tx.read("cache", CACHE, [bucket])
    mine = contents.filter(tx.bucket("content_hash") == bucket)
    if not force:
        mine = mine.join(ledger.usable(held).select("content_hash"), "content_hash", "left_anti")
    mine = written(mine, "contents")
    if mine.isEmpty():
        return
    new = written(extract(mine).select("content_hash", F.lit(True).alias("raw"), "payload"), "extracted")
    tx.write("cache", held.join(new.select("content_hash"), "content_hash", "left_anti").select(*new.columns).unionByName(new), ["content_hash"], [bucket])


def extract_run(store: Store, files: DataFrame, extract: Callable[[DataFrame], DataFrame], force: bool = False) -> DataFrame:
    """Extract from ``files(file_path, task_id, content)`` what the store's ``cache`` lacks, and bring its ``ledger`` up to date.

    Gives ``(file_path, task_id, content_hash, action, payload)``: skip (known and cached), retrack (cached, but
    the file is new or changed) or extract. Entries in the old form count as missing. ``force`` asks for
    every content anew. Null contents count as empty; of rows that repeat a path the greatest hash counts."""
    hashed = files.withColumn("content", F.coalesce("content", F.lit(""))).withColumn("content_hash", F.md5("content"))
    one = hashed.groupBy("file_path").agg(F.max_by(F.struct("task_id", "content_hash"), "content_hash").alias("f")).select("file_path", "f.*")
    told = written(ledger.actions(one, store.read("ledger", LEDGER), store.read("cache", CACHE), force), "actions")
    asked = told.filter("action = 'extract'").select("content_hash").distinct()
    contents = written(hashed.join(asked, "content_hash", "left_semi").groupBy("content_hash").agg(F.first("content").alias("content")), "asked")
    for bucket in Transaction(store).touched(["content_hash"], contents):  # as many rounds as there are buckets
        store.run(lambda tx, b=bucket: _fill(tx, contents, b, extract, force))
    done = told.filter("action <> 'skip'").select("file_path", "content_hash", "task_id", F.current_timestamp().alias("last_processed"))

    def track(tx: Transaction) -> None:
        if only := tx.touched(["file_path"], done):
            old = tx.read("ledger", LEDGER, only).select(*done.columns)
            tx.write("ledger", ledger.track(old, done), ["file_path"], only)

    store.run(track)
    return told.join(ledger.usable(store.read("cache", CACHE)), "content_hash").select("file_path", "task_id", "content_hash", "action", "payload")

"""Queries over change detection, the extraction cache, evaluation and traces."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aliases as A
from ..operators import documents, evaluation, extraction, ledger
from ..sources.files import read_or_empty, replace_table
from ..sources.versions import Store
from ..storage import broadcast_checked, shared_dir
from ..streaming import changes, traces
from . import model as M
from .registry import query

_CHANGED = "(SELECT f.*, CASE WHEN t.content_hash IS NULL THEN 'new' ELSE 'changed' END AS reason FROM file f LEFT JOIN tracking t ON f.file_path = t.file_path WHERE t.content_hash IS DISTINCT FROM f.content_hash)"


@query("changed_files", f"SELECT file_path, reason FROM {_CHANGED}", "file", "tracking")
def changed_files(spark, d):
    return ledger.changed(M.files(spark, d), M.tracking(spark, d)).select("file_path", "reason")


@query("incremental_plan", f"WITH todo AS {_CHANGED}, piece AS (SELECT file_path, 1::BIGINT AS pos, NULL::VARCHAR AS title, text FROM todo JOIN documents ON seq = doc_id), {M.sql_chunks('piece', 'c')} SELECT task_id, reason, count(*) AS files, sum(n)::BIGINT AS chunks FROM todo JOIN (SELECT file_path, count(*) AS n FROM c GROUP BY file_path) k ON todo.file_path = k.file_path GROUP BY task_id, reason", "file", "tracking")
def incremental_plan(spark, d):
    """A dry run: what would be chunked again, and into how many chunks, by task."""
    todo = ledger.changed(M.files(spark, d), M.tracking(spark, d)).select(F.col("seq").alias("doc_id"), "file_path", "task_id", "reason")
    one = F.lit(1).cast("bigint").alias("pos"), F.lit(None).cast("string").alias("title")
    pieces = todo.join(M.table(spark, d, "documents").select("doc_id", "text"), "doc_id").select("file_path", "task_id", *one, "text")
    sizes = documents.chunk_documents(pieces).groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
    return todo.join(sizes, "file_path").groupBy("task_id", "reason").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("chunks"))


_AGAIN = "(SELECT file_path, task_id, content || CASE WHEN regexp_extract(task_id, '^\\d+')::INT % 3 = 0 THEN chr(10) || '## edit' || chr(10) || 'user：edited' || chr(10) ELSE chr(10) END AS content FROM dialogue)"
_AGAIN_SCENE = [M.CTE[t][1].replace("FROM dialogue)", f"FROM {_AGAIN})").replace("FROM line)", "FROM again_line)") for t in ("line", "scene")]


_NAMED = r"([^/~]+)~([^/]+)$"
#: Folders over which the files are dealt: Spark lists each in one task.
_FOLDERS = 64


def _write_files(dialogues, path):
    """The folder ``path`` anew, each dialogue a file in it that keeps its name. Tasks write them as they come: Spark's text
    writer would make and commit a folder for each."""
    folder, name = F.pmod(F.xxhash64("file_path"), F.lit(_FOLDERS)).cast("string"), F.concat("task_id", F.lit("~"), F.substring_index("file_path", "/", -1))

    def write(batches):
        fs, root = pa.fs.FileSystem.from_uri(path)
        n = 0
        for batch in batches:
            for where, text in zip(*(c.to_pylist() for c in batch.columns)):
                with fs.open_output_stream(f"{root}/{where}") as out:
                    out.write((text or "").encode() + b"\n")
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    fs, root = pa.fs.FileSystem.from_uri(path)
    fs.create_dir(root)
    fs.delete_dir_contents(root)
    for k in range(_FOLDERS):
        fs.create_dir(f"{root}/{k}")
    dialogues.select(F.concat_ws("/", folder, name).alias("where"), F.col("content").alias("text")).mapInArrow(write, "n bigint").agg(F.sum("n")).first()


def _ingested(spark, d, left: int):
    """Dialogues as files, taken in; then the folder is written anew: a third edited, the others as they were
    (of three kinds by number, ``left`` are still there). What has changed is taken in; gives the store."""
    root = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    store, number = Store(spark, f"{root}/store"), F.regexp_extract("task_id", r"^\d+", 0).cast("int")
    first = M.dialogues(spark, d)
    again = first.filter(number % 3 < left).withColumn("content", F.when(number % 3 == 0, F.concat("content", F.lit("\n## edit\nuser：edited"))).otherwise(F.col("content")))
    for some in (first, again):
        _write_files(some, f"{root}/files")
        changes.ingest_changes(spark, f"{root}/files", store, "*.txt", _NAMED)
    return store


@query("ingest_run", f"WITH again_line AS ({_AGAIN_SCENE[0]}), again_scene AS ({_AGAIN_SCENE[1]}), {M.sql_chunks('again_scene', 'c')} SELECT c.file_path, pos, title, md5(text) AS text_hash, md5(content) AS content_hash FROM c JOIN {_AGAIN} a ON c.file_path = a.file_path", "dialogue")
def ingest_run(spark, d):
    """Dialogues as files, taken in; then a third is edited in place, and what has changed is taken in."""
    store = _ingested(spark, d, 3)
    tracked = store.read("ledger", changes.LEDGER).select("file_path", "content_hash")
    return store.read("chunks", changes.PIECES).join(tracked, "file_path").select("file_path", "pos", "title", F.md5("text").alias("text_hash"), "content_hash")


@query("ingest_deletions", f"WITH again_line AS ({_AGAIN_SCENE[0]}), again_scene AS ({_AGAIN_SCENE[1]}), {M.sql_chunks('again_scene', 'c')} SELECT a.file_path, md5(a.content) AS content_hash, count(*) AS chunks FROM c JOIN {_AGAIN} a ON c.file_path = a.file_path WHERE regexp_extract(a.task_id, '^\\d+')::INT % 3 < 2 GROUP BY ALL", "dialogue")
def ingest_deletions(spark, d):
    """As ``ingest_run``, with a third of the files deleted: the ledger, held against the chunks that are left."""
    store = _ingested(spark, d, 2)
    counts = store.read("chunks", changes.PIECES).groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
    ledger = store.read("ledger", changes.LEDGER).join(counts, "file_path", "full_outer")
    return ledger.select("file_path", "content_hash", F.when(F.col("n") == F.col("chunks"), F.col("n")).alias("chunks"))


@query("tracking_roundtrip", f"SELECT file_path, content_hash FROM tracking WHERE file_path NOT IN (SELECT file_path FROM {_CHANGED}) UNION ALL SELECT file_path, content_hash FROM {_CHANGED}", "file", "tracking")
def tracking_roundtrip(spark, d):
    """The ledger, written, brought up to date by a run over the changed files, and read back."""
    path, kind = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}", "file_path string, content_hash string"
    replace_table(M.tracking(spark, d).select("file_path", "content_hash"), path)
    old = read_or_empty(spark, path, kind)
    done = ledger.changed(M.files(spark, d), old).select("file_path", "content_hash")
    replace_table(ledger.track(old, done), path)
    return read_or_empty(spark, path, kind)


@query("tracking_status", "SELECT count(*) AS files, sum(entities)::BIGINT AS entities, sum(relations)::BIGINT AS relations, count(DISTINCT task_id) AS tasks FROM tracking", "tracking")
def tracking_status(spark, d):
    return M.tracking(spark, d).agg(F.count(F.lit(1)).alias("files"), F.sum("entities").alias("entities"), F.sum("relations").alias("relations"), F.countDistinct("task_id").alias("tasks"))


@query("cache_lookup", "SELECT file_path, payload FROM file f JOIN cached c ON f.content_hash = c.content_hash WHERE raw", "file", "cached")
def cache_lookup(spark, d):
    return M.files(spark, d).join(ledger.usable(M.cache(spark, d)), "content_hash").select("file_path", "payload")


@query("cache_stats", "SELECT count(*) AS entries, count(*) FILTER (WHERE raw) AS usable FROM cached", "cached")
def cache_stats(spark, d):
    return M.cache(spark, d).agg(F.count(F.lit(1)).alias("entries"), F.count_if("raw").alias("usable"))


@query("orphan_cache", "SELECT content_hash FROM cached WHERE content_hash NOT IN (SELECT content_hash FROM file)", "file", "cached")
def orphan_cache(spark, d):
    return ledger.orphans(M.cache(spark, d), M.files(spark, d)).select("content_hash")


_ACTIONS = "(SELECT f.file_path, CASE WHEN NOT coalesce(c.raw, false) THEN 'extract' WHEN t.content_hash IS NOT DISTINCT FROM f.content_hash THEN 'skip' ELSE 'retrack' END AS action FROM file f LEFT JOIN tracking t ON f.file_path = t.file_path LEFT JOIN (SELECT * FROM cached WHERE raw) c ON f.content_hash = c.content_hash)"


@query("extract_actions", f"SELECT file_path, action FROM {_ACTIONS}", "file", "tracking", "cached")
def extract_actions(spark, d):
    return ledger.actions(M.files(spark, d), M.tracking(spark, d), M.cache(spark, d)).select("file_path", "action")


@query("extract_run", f"""SELECT f.file_path, a.action, f.content_hash, coalesce(c.payload, 'found ' || length(d.text)) AS payload
    FROM file f JOIN {_ACTIONS} a ON f.file_path = a.file_path JOIN documents d ON f.seq = d.doc_id LEFT JOIN (SELECT * FROM cached WHERE raw) c ON f.content_hash = c.content_hash""", "file", "tracking", "cached")  # fmt: skip
def extract_run(spark, d):
    """A run over all files: what the cache lacks is extracted, once for each content, and cached; then the ledger is brought up to date."""
    store = Store(spark, f"{shared_dir(spark)}/extraction-{uuid.uuid4().hex}", 4)
    store.replace("cache", M.cache(spark, d), ["content_hash"])
    store.replace("ledger", M.tracking(spark, d).select("file_path", "content_hash", "task_id", F.current_timestamp().alias("last_processed")), ["file_path"])
    files = M.files(spark, d).join(M.table(spark, d, "documents").select(F.col("doc_id").alias("seq"), "text"), "seq").select("file_path", "task_id", F.col("text").alias("content"))
    done = extraction.extract_run(store, files, lambda c: c.select("content_hash", F.concat(F.lit("found "), F.length("content").cast("string")).alias("payload")))
    now = store.read("ledger", extraction.LEDGER).select("file_path", "content_hash")
    return done.join(now, ["file_path", "content_hash"]).select("file_path", "action", "content_hash", "payload")


@query("rebuild_tracking", f"SELECT action, count(*) AS n FROM {_ACTIONS} GROUP BY action", "file", "tracking", "cached")
def rebuild_tracking(spark, d):
    return ledger.actions(M.files(spark, d), M.tracking(spark, d), M.cache(spark, d)).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("renormalize", "SELECT file_path, coalesce(a.c, name) AS canonical FROM (SELECT file_path, split_part(text, ' ', 1) AS name FROM file f JOIN documents ON seq = doc_id JOIN cached c ON f.content_hash = c.content_hash WHERE raw) LEFT JOIN (SELECT alias, min(canonical) AS c FROM alias GROUP BY alias) a ON name = alias", "file", "cached", "alias")
def renormalize(spark, d):
    """Cached results under the present aliases, without extracting anything again."""
    first = M.table(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.get(F.split("text", " "), F.lit(0)).alias("name"))
    hits = M.files(spark, d).join(ledger.usable(M.cache(spark, d)), "content_hash").join(first, "seq")
    return A.resolve(hits.select("file_path", "name"), M.aliases(spark)).select("file_path", "canonical")


# -- evaluation: labels as grades, benchmark items as questions ----------------------------------


@query("testsets", "SELECT name, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS ids FROM (SELECT item_id, unnest(['full', CASE WHEN item_id % 3 = 1 THEN 'basic' END, CASE WHEN item_id IN (0, 1, 2) THEN 'smoke' END]) AS name FROM benchmark) WHERE name IS NOT NULL GROUP BY name")
def testsets(spark, d):
    k = F.col("item_id")
    sets = F.array(F.lit("full"), F.when(k % 3 == 1, "basic"), F.when(k.isin(0, 1, 2), "smoke"))
    rows = M.table(spark, d, "benchmark").select("item_id", F.explode(sets).alias("name")).filter("name IS NOT NULL")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("item_id")), lambda x: x.cast("string")), ",")
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), ids.alias("ids"))


@query("load_questions", "SELECT pos, b.item_id, text FROM (SELECT item_id, (row_number() OVER (ORDER BY item_id DESC) - 1)::INT AS pos FROM benchmark WHERE item_id % 3 = 0) s JOIN benchmark b ON s.item_id = b.item_id")
def load_questions(spark, d):
    """The questions of a list of ids, in its order; unknown ids are passed over."""
    items = M.table(spark, d, "benchmark")
    ids = F.sort_array(F.collect_list("item_id"), asc=False)  # a test set is a list of a file
    listed = items.filter("item_id % 3 = 0").agg(F.concat(ids, F.array(F.lit(-1).cast("bigint"))).alias("ids")).select(F.posexplode("ids").alias("pos", "item_id"))
    return items.join(broadcast_checked(listed), "item_id").select("pos", "item_id", "text")


_GRADE = "(SELECT doc_id, quality::DOUBLE AS f, toxic::DOUBLE AS c, CASE WHEN doc_id % 10 = 0 THEN 1.0 ELSE round((quality + toxic) / 2.0, 4) END AS total FROM labels)"


def grades(spark, d):
    rows = M.table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("f"), F.col("toxic").cast("double").alias("c"), F.when(F.col("doc_id") % 10 != 0, "golden").alias("golden"))
    return rows.withColumn("total", evaluation.total_grade(F.col("f"), F.col("c"), F.col("golden")))


@query("grade_total", f"SELECT doc_id, total, total >= 0.7 AS passed FROM {_GRADE}")
def grade_total(spark, d):
    return grades(spark, d).select("doc_id", "total", (F.col("total") >= evaluation.PASS_MARK).alias("passed"))


@query("eval_summary", f"SELECT count(*) AS n, round(coalesce(avg(total), 0), 6) AS mean_total, count(*) FILTER (WHERE total >= 0.7) AS passed FROM {_GRADE}")
def eval_summary(spark, d):
    return grades(spark, d).agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.avg("total"), F.lit(0.0)), 6).alias("mean_total"), F.count_if(F.col("total") >= evaluation.PASS_MARK).alias("passed"))


@query("eval_results", f"SELECT doc_id, total, 'labels' AS label, (SELECT count(*) FROM labels) AS n FROM {_GRADE}")
def eval_results(spark, d):
    """Grades, written with their summary and read back."""
    rows = grades(spark, d).select("doc_id", "total")
    folder = evaluation.write_results(rows, "labels", f"{shared_dir(spark)}/results-{uuid.uuid4().hex}", "20240101-000000")
    back, summary = evaluation.read_results(rows, folder)
    return back.crossJoin(F.broadcast(summary.select("label", F.col("count").alias("n"))))  # the summary is a single row


# -- traces: events as tool calls, users as runs --------------------------------------------------

_ITER = "(SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY day)::INT AS iteration, calls FROM (SELECT user_id, ts::DATE AS day, count(*) AS calls FROM events GROUP BY user_id, ts::DATE))"


def iterations(spark, d):
    days = M.table(spark, d, "events").groupBy(F.col("user_id").alias("run"), F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("calls"))
    return days.select("run", F.row_number().over(Window.partitionBy("run").orderBy("day")).alias("iteration"), "calls")


@query("trace_stats", "SELECT user_id AS run, count(*) AS calls, count(DISTINCT event_type) AS tools, sum(length(props))::BIGINT AS output_chars, round(sum(value), 4) AS duration FROM events GROUP BY user_id")
def trace_stats(spark, d):
    return M.table(spark, d, "events").groupBy(F.col("user_id").alias("run")).agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("event_type").alias("tools"), F.sum(F.length("props").cast("bigint")).alias("output_chars"), F.round(F.sum("value"), 4).alias("duration"))


@query("trace_flatten", "SELECT event_id, user_id AS run, event_type AS tool, round(value, 6) AS duration FROM events")
def trace_flatten(spark, d):
    """Nested traces, one a run, to JSON and flat again."""
    call = F.struct("event_id", F.col("event_type").alias("tool"), F.col("value").alias("duration"))
    nested = M.table(spark, d, "events").groupBy(F.col("user_id").alias("run"), (F.col("event_id") % 64).alias("part")).agg(F.collect_list(call).alias("calls"))
    kind = "struct<run: bigint, calls: array<struct<event_id: bigint, tool: string, duration: double>>>"
    back = nested.select(F.to_json(F.struct("run", "calls")).alias("j")).select(F.from_json("j", kind).alias("t"))
    return back.select("t.run", F.explode("t.calls").alias("c")).select("c.event_id", "run", "c.tool", F.round("c.duration", 6).alias("duration"))


@query("trace_stream", f"""WITH e AS (SELECT *, epoch_ms(ts) AS ms FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
    m AS (SELECT *, CASE WHEN lag(event_type) OVER w = 'purchase' OR ms - lag(ms) OVER w > {traces.GAP} THEN 1 ELSE 0 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM m),
    t AS (SELECT user_id AS run, no, arg_min(event_id, (ts, event_id)) AS first_event, count(*) AS calls, sum(least(length(props), 6000))::BIGINT AS output_chars, round(sum(value), 4) AS duration,
                 max(CASE WHEN event_type = 'purchase' THEN substr(props, 1, 2000) END) AS answer, bool_or(event_type = 'purchase') AS done, max(ms) AS last, no = max(no) OVER (PARTITION BY user_id) AS newest FROM k GROUP BY user_id, no)
    SELECT run, first_event, calls, output_chars, duration, answer, CASE WHEN done THEN 'done' ELSE 'in_progress' END AS status
    FROM t WHERE done OR NOT newest OR last + {traces.GAP} < (SELECT max(ms) FROM e) - 3600000""")
def trace_stream(spark, d):
    """Traces that a purchase ends, from events that come in three parts; the stream is started anew for each."""
    root, events = f"{shared_dir(spark)}/traces-{uuid.uuid4().hex}", M.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    first, last = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    for k in range(3):
        low, high = (first + (last - first) * x // 3 for x in (k, k + 1))
        at = F.unix_micros("ts")
        events.filter((at >= low if not k else at > low) & (at <= high)).write.mode("append").parquet(f"{root}/events")
        run = traces.trace_stream(spark.readStream.schema(events.schema).parquet(f"{root}/events"), "purchase", f"{root}/traces", f"{root}/state")
        run.awaitTermination()
    return spark.read.schema(traces.TRACE).parquet(f"{root}/traces").select("run", "first_event", "calls", "output_chars", F.round("duration", 4).alias("duration"), "answer", "status")


@query("agent_routing", f"""SELECT run, iteration, ran, skipped, total_calls, CASE WHEN calls = 0 THEN 'answer' WHEN total_calls >= 20 OR iteration >= 6 THEN 'force_answer' ELSE 'continue' END AS route
    FROM (SELECT *, least(calls, 5) AS ran, calls - least(calls, 5) AS skipped, sum(least(calls, 5)) OVER (PARTITION BY run ORDER BY iteration)::BIGINT AS total_calls FROM {_ITER})""")  # fmt: skip
def agent_routing(spark, d):
    return evaluation.routing(iterations(spark, d)).select("run", "iteration", "ran", "skipped", "total_calls", "route")

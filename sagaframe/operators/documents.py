"""Dialogue documents: headers, bodies, scenes, chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .patterns import containing

#: Header forms (fixed values).
TITLE = r"^#\s*(.+?)\s*-\s*第(\d+)章[：:](.+)$"
SERIES = r"^#\s*(.+(?:序幕|第[一二三四五六七八九十\d]+幕|序奏|幕间).*)$"
SOURCE = r"^#\s*来源[：:]\s*(.+)$"
SUMMARY = r"^##?\s*剧情简介"
STORY_TITLE = "角色故事"
FILE_CHAPTER = r"chapter(\d+)_dialogue\.txt"
HEADER_LINES, STORY_LINES = 15, 5

MAX_CHUNK, OVERLAP = 1500, 100


def _last(lines, pattern: str, group: int):
    """The group of the last line that matches, null if none does."""
    hit = F.filter(lines, lambda x: x.rlike(pattern))
    return F.when(F.size(hit) > 0, T.strip(F.regexp_extract(F.element_at(hit, -1), pattern, group)))


def parse_headers(docs: DataFrame) -> DataFrame:
    """Add task_name, chapter_number, chapter_title, series_name, source_url and summary to
    ``(file_path, task_id, content)``. The last matching header line wins; without a title the
    chapter comes from the file's name."""
    head = F.transform(F.slice(T.lines(F.regexp_replace("content", "^﻿", "")), 1, HEADER_LINES), T.strip)
    step = docs.withColumn("_h", head)
    h = F.col("_h")
    marks = F.transform(h, lambda x, i: F.struct(i.alias("i"), x.alias("x"), x.rlike(SUMMARY).alias("on"), (x.startswith("---") | (x.startswith("##") & ~x.rlike(SUMMARY))).alias("off"), (x.rlike(TITLE) | x.rlike(SERIES) | x.rlike(SOURCE)).alias("skip")))
    # inside a summary: the last switch before the line is its beginning
    state = F.aggregate(
        marks,
        F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("out")),
        lambda a, m: F.struct(
            F.when(m["skip"], a["on"]).when(m["on"], F.lit(True)).when(m["off"], F.lit(False)).otherwise(a["on"]).alias("on"),
            F.when(a["on"] & ~m["skip"] & ~m["on"] & ~m["off"] & (m["x"] != ""), F.concat(a["out"], F.array(m["x"]))).otherwise(a["out"]).alias("out"),
        ),
    )["out"]
    plain = F.filter(h, lambda x: ~x.rlike(TITLE))
    named = F.regexp_extract("file_path", FILE_CHAPTER, 1)
    return step.withColumn("_s", state).select(
        *docs.columns,
        F.coalesce(_last(h, TITLE, 1), F.lit("Unknown")).alias("task_name"),
        F.coalesce(_last(h, TITLE, 2).cast("int"), F.when(named != "", named.cast("int")), F.lit(0)).alias("chapter_number"),
        F.coalesce(_last(h, TITLE, 3), F.lit("Unknown")).alias("chapter_title"),
        _last(plain, SERIES, 1).alias("series_name"),
        _last(F.filter(plain, lambda x: ~x.rlike(SERIES)), SOURCE, 1).alias("source_url"),
        F.when(F.size("_s") > 0, F.array_join("_s", "\n")).alias("summary"),
    )


def parse_stories(docs: DataFrame, title: str = r"^#\s*(.+?)\s*-") -> DataFrame:
    """Name and source of character stories, from their first lines; they have no chapters."""
    head = F.transform(F.slice(T.lines(F.col("content")), 1, STORY_LINES), T.strip)
    return docs.withColumn("_h", head).select(
        *docs.columns, F.coalesce(_last(F.col("_h"), title, 1), F.lit("Unknown")).alias("task_name"), F.lit(0).alias("chapter_number"),
        F.lit(STORY_TITLE).alias("chapter_title"), _last(F.col("_h"), SOURCE, 1).alias("source_url"),
    )


def extract_body(content):
    """From the first line that starts with ---, or with ## and is no summary mark; else all."""
    ls = T.lines(content)
    starts = F.transform(F.transform(ls, T.strip), lambda x: x.startswith("---") | (x.startswith("## ") & ~x.rlike(SUMMARY)))
    at = F.array_position(starts, True)
    return F.when(at > 0, F.array_join(F.slice(ls, at.cast("int"), F.size(ls)), "\n")).otherwise(content)


def split_scenes(docs: DataFrame) -> DataFrame:
    """``(file_path, task_id, pos, title, text)``: text between scene marks, blank scenes left out.

    A heading starts a titled scene, a rule an untitled one. Lines are counted per file, so only
    a file's lines meet in a task."""
    rows = docs.select("file_path", "task_id", F.posexplode(T.lines(F.col("content"))).alias("line_no", "line"))
    s = T.strip(F.col("line"))
    rows = rows.withColumn("title", F.when(s.rlike(r"^##\s+."), F.regexp_replace(s, r"^##\s+", ""))).withColumn("mark", F.col("title").isNotNull() | s.rlike(r"^---\s*$"))
    by_line = Window.partitionBy("file_path").orderBy("line_no")
    rows = rows.withColumn("k", F.sum(F.col("mark").cast("int")).over(by_line))
    kept = F.sort_array(F.collect_list(F.when(~F.col("mark"), F.struct("line_no", "line"))))
    scenes = rows.groupBy("file_path", "k").agg(F.first("task_id").alias("task_id"), F.max("title").alias("title"), T.strip(F.array_join(F.transform(kept, lambda x: x["line"]), "\n")).alias("text"))
    order = Window.partitionBy("file_path").orderBy("k")
    return scenes.filter("text <> ''").select("file_path", "task_id", F.row_number().over(order).cast("bigint").alias("pos"), "title", "text")


def fold_chunks(pieces: list[tuple[str | None, str]], most: int = MAX_CHUNK, overlap: int = OVERLAP, merge: bool = True) -> list[tuple[str | None, str]]:
    """Cut scenes that are too long at lines of dialogue, and join neighbours of one title that fit.

    A cut is made once the next line would overflow, if it begins a turn or the chunk is over
    four fifths full; whole lines up to ``overlap`` characters are carried on. Chunks of one
    title are joined by a blank line as long as both and one more fit.
    """
    cut: list[tuple[str | None, str]] = []
    for title, text in pieces:
        if len(text) <= most:
            cut.append((title, text))
            continue
        held: list[str] = []
        size = 0
        for line in text.split("\n"):
            s = line.strip()
            if held and size + len(line) + 1 > most and (s.find("：", 1) > 0 and s.index("：") < len(s) - 1 and not s.startswith("：") or size > 0.8 * most):
                cut.append((title, "\n".join(held).strip()))
                tail, left = len(held), overlap
                while tail and (left := left - len(held[tail - 1]) - 1) >= 0:
                    tail -= 1
                held = held[tail:]
                size = sum(map(len, held)) + len(held)
            held.append(line)
            size += len(line) + 1
        cut.append((title, "\n".join(held).strip()))
    cut = [c for c in cut if c[1]]
    if not merge:
        return cut
    out: list[tuple[str | None, str]] = []
    for title, text in cut:
        if out and out[-1][0] == title and len(out[-1][1]) + len(text) + 1 <= most:
            out[-1] = (title, out[-1][1] + "\n\n" + text)
        else:
            out.append((title, text))
    return [(title, text.strip()) for title, text in out]


def chunk_documents(scenes: DataFrame, most: int = MAX_CHUNK, overlap: int = OVERLAP, merge: bool = True) -> DataFrame:
    """``(file_path, task_id, pos, title, text)`` of chunks, folded file by file."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, task, found in zip(batch["file_path"], batch["task_id"], batch["scenes"]):
                pieces = [(s["title"], s["text"]) for s in found]
                rows += [(path, task, k + 1, *c) for k, c in enumerate(fold_chunks(pieces, most, overlap, merge))]
            yield pd.DataFrame(rows, columns=["file_path", "task_id", "pos", "title", "text"])

    files = scenes.groupBy("file_path").agg(F.first("task_id").alias("task_id"), F.sort_array(F.collect_list(F.struct("pos", "title", "text"))).alias("scenes"))
    return files.mapInPandas(fold, "file_path string, task_id string, pos bigint, title string, text string")


def order_chunks(chunks: DataFrame) -> DataFrame:
    """Add chapter, scene_order, chunk_order, id and event_order to a file's chunks.

    A scene begins where the title changes; before the first titled chunk it is scene 0, whose
    chunks count from 1. Ids hold the chunk's place in its file, so they are stable."""
    by_pos = Window.partitionBy("file_path").orderBy("pos")
    change = ~F.col("title").eqNullSafe(F.lag("title").over(by_pos))
    named = F.regexp_extract("file_path", r"chapter(\d+)_", 1)
    step = chunks.withColumn("chapter", F.when(named != "", named.cast("int")).otherwise(F.lit(0))).withColumn("_c", change.cast("int")).withColumn("scene_order", F.sum("_c").over(by_pos).cast("int")).drop("_c")
    in_scene = Window.partitionBy("file_path", "scene_order").orderBy("pos")
    step = step.withColumn("chunk_order", (F.row_number().over(in_scene) - 1 + (F.col("scene_order") == 0).cast("int")).cast("int"))
    ident = F.concat_ws("_", "task_id", *[F.col(c).cast("string") for c in ("chapter", "scene_order", "chunk_order", "pos")])
    return step.withColumn("id", ident).withColumn("event_order", T.event_order(F.col("task_id"), F.col("chapter"), F.col("scene_order"), F.col("chunk_order")))


def mentions(chunks: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(id, canonical)``: entities of which an alias is in the chunk's text."""
    found = containing(chunks, aliases.select(F.col("alias").alias("pattern"))).withColumnRenamed("pattern", "alias")
    return found.join(aliases.select("alias", "canonical").distinct(), "alias").select("id", "canonical").distinct()


def enrich(chunks: DataFrame, aliases: DataFrame) -> DataFrame:
    """Ordered chunks with speakers, mentioned entities and the choice flag."""
    found = mentions(chunks, aliases).groupBy("id").agg(F.array_sort(F.collect_set("canonical")).alias("entities"))
    return chunks.join(found, "id", "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<string>"))).withColumn("characters", T.speakers(F.col("text"))).withColumn("has_choice", T.has_choice(F.col("text")))


def chunk_faults(chunks: DataFrame) -> DataFrame:
    """``(id, fault)``: empty, short or long chunks, and, besides, chunks that nobody speaks in."""
    size = F.length(T.strip(F.col("text")))
    sized = F.when(size == 0, "empty").when(F.length("text") < 100, "short").when(F.length("text") > 2000, "long")
    silent = F.when(F.size("characters") == 0, "no_characters")
    return chunks.select("id", F.explode(F.filter(F.array(sized, silent), lambda x: x.isNotNull())).alias("fault"))

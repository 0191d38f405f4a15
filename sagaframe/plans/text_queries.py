"""Queries over dialogue text: parsing, chunking, enrichment, names, aliases, retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aliases as A
from ..operators import bm25, documents, segmentation, vectors
from ..operators.patterns import containing, similar_pairs
from ..storage import shared_dir, written
from . import model as M
from .registry import query

LONG, INT = "bigint", "int"


def chunks(spark, d):
    return documents.order_chunks(documents.split_scenes(M.dialogues(spark, d)))


@query("scan_documents", "SELECT file_path, task_id, length(content)::BIGINT AS n_chars, md5(content) AS content_hash FROM dialogue", "dialogue")
def scan_documents(spark, d):
    return M.dialogues(spark, d).select("file_path", "task_id", F.length("content").cast(LONG).alias("n_chars"), F.md5("content").alias("content_hash"))


@query("parse_header", """SELECT file_path, 'Story ' || regexp_extract(task_id, '^\\d+') AS task_name, regexp_extract(file_path, 'chapter(\\d+)_', 1)::INT AS chapter_number,
    'Part ' || regexp_extract(task_id, '^\\d+') AS chapter_title, 'Saga 第' || regexp_extract(file_path, 'chapter(\\d+)_', 1) || '幕' AS series_name,
    'conv/' || regexp_extract(task_id, '^\\d+') AS source_url, 'summary of ' || regexp_extract(task_id, '^\\d+') AS summary FROM dialogue""", "dialogue")  # fmt: skip
def parse_header(spark, d):
    return documents.parse_headers(M.dialogues(spark, d)).drop("task_id", "content")


@query("parse_story", "SELECT file_path, 'Story ' || regexp_extract(task_id, '^\\d+') AS task_name, 0::INT AS chapter_number, '角色故事' AS chapter_title, 'conv/' || regexp_extract(task_id, '^\\d+') AS source_url FROM dialogue", "dialogue")
def parse_story(spark, d):
    return documents.parse_stories(M.dialogues(spark, d)).drop("task_id", "content")


@query("extract_body", """WITH start AS (SELECT file_path, min(pos) AS p FROM line WHERE starts_with(s, '---') OR (starts_with(s, '## ') AND NOT regexp_matches(s, '^##?\\s*剧情简介')) GROUP BY file_path)
    SELECT line.file_path, md5(string_agg(line, chr(10) ORDER BY pos)) AS body_hash, count(*) AS n_lines FROM line LEFT JOIN start ON line.file_path = start.file_path WHERE pos >= coalesce(p, 0) GROUP BY line.file_path""", "line")  # fmt: skip
def extract_body(spark, d):
    body = documents.extract_body(F.col("content"))
    return M.dialogues(spark, d).withColumn("body", body).select("file_path", F.md5("body").alias("body_hash"), F.size(T.lines(F.col("body"))).cast(LONG).alias("n_lines"))


@query("count_sources", "SELECT count(DISTINCT task_id) AS tasks, count(*) AS chapters, 0::BIGINT AS stories FROM dialogue", "dialogue")
def count_sources(spark, d):
    path = F.col("file_path")
    return M.dialogues(spark, d).agg(F.countDistinct(F.regexp_extract(path, "^(.*)/", 1)).alias("tasks"), F.count_if(path.rlike("chapter.*_dialogue")).alias("chapters"), F.count_if(path.endswith("story.txt")).alias("stories"))


@query("split_scenes", "SELECT file_path, pos, title, md5(text) AS text_hash FROM scene", "scene")
def split_scenes(spark, d):
    return documents.split_scenes(M.dialogues(spark, d)).select("file_path", "pos", "title", F.md5("text").alias("text_hash"))


@query("scene_order", "SELECT file_path, pos, scene_order, chunk_order FROM chunk", "chunk")
def scene_order(spark, d):
    return chunks(spark, d).select("file_path", "pos", "scene_order", "chunk_order")


@query("chunk_ids", "SELECT id, file_path, pos FROM chunk", "chunk")
def chunk_ids(spark, d):
    return chunks(spark, d).select("id", "file_path", "pos")


@query("event_order", "SELECT id, event_order FROM chunk", "chunk")
def event_order(spark, d):
    return chunks(spark, d).select("id", "event_order")


@query("global_chapter", "SELECT file_path, coalesce(try_cast(task_id AS BIGINT) * 100 + c, c) AS chapter FROM (SELECT *, regexp_extract(file_path, 'chapter(\\d+)_', 1)::BIGINT AS c FROM dialogue)", "dialogue")
def global_chapter(spark, d):
    chapter = F.regexp_extract("file_path", r"chapter(\d+)_", 1).cast("int")
    return M.dialogues(spark, d).select("file_path", T.global_chapter(F.col("task_id"), chapter).alias("chapter"))


@query("content_hash", "SELECT doc_id, md5(text) AS content_hash FROM documents")
def content_hash(spark, d):
    return M.table(spark, d, "documents").select("doc_id", F.md5("text").alias("content_hash"))


_DOC_PIECES = "SELECT doc_id::VARCHAR AS file_path, 1::BIGINT AS pos, NULL::VARCHAR AS title, text FROM documents"


@query("split_large", f"WITH piece AS ({_DOC_PIECES}), {M.sql_chunks('piece', 'c', merge=False)} SELECT file_path, pos, length(text)::INT AS n_chars, md5(text) AS text_hash FROM c", "nothing")
def split_large(spark, d):
    docs = M.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file_path"), F.lit("docs").alias("task_id"), F.lit(1).cast(LONG).alias("pos"), F.lit(None).cast("string").alias("title"), "text")
    return documents.chunk_documents(docs, merge=False).select("file_path", "pos", F.length("text").alias("n_chars"), F.md5("text").alias("text_hash"))


@query("merge_chunks", f"WITH {M.sql_chunks('scene', 'c')} SELECT file_path, pos, title, length(text)::INT AS n_chars, md5(text) AS text_hash FROM c", "scene")
def merge_chunks(spark, d):
    scenes = documents.split_scenes(M.dialogues(spark, d))
    return documents.chunk_documents(scenes).select("file_path", "pos", "title", F.length("text").alias("n_chars"), F.md5("text").alias("text_hash"))


_SPEAKERS = """(SELECT id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '(?m)^([^：\\n]+)：', 1), lambda x: trim(x)),
    lambda x: x <> '' AND x NOT IN ('？？？', '选项', '---', '黑雾诅咒', '小机器人', '受伤的绒翼龙') AND NOT starts_with(x, '选项')))) AS c, text, event_order, pos, file_path FROM chunk)"""


@query("speakers", f"SELECT id, array_to_string(c, ',') AS speakers FROM {_SPEAKERS}", "chunk")
def speakers(spark, d):
    return chunks(spark, d).select("id", F.array_join(T.speakers(F.col("text")), ",").alias("speakers"))


@query("speakers_heuristic", """SELECT file_path, coalesce(string_agg(DISTINCT n, ',' ORDER BY n), '') AS speakers FROM
    (SELECT file_path, CASE WHEN contains(line, '：') AND NOT starts_with(line, '#') THEN trim(split_part(line, '：', 1)) END AS n FROM line)
    WHERE n IS NULL OR (n <> '' AND length(n) < 20 AND NOT starts_with(n, '（') AND n NOT IN ('选项', '---', '？？？')) GROUP BY file_path""", "line")  # fmt: skip
def speakers_heuristic(spark, d):
    return M.dialogues(spark, d).select("file_path", F.array_join(T.speakers_heuristic(F.col("content")), ",").alias("speakers"))


@query("has_choice", "SELECT id, regexp_matches(text, '(?m)^##?\\s*选项|^-\\s+.+$') AS has_choice FROM chunk", "chunk")
def has_choice(spark, d):
    return chunks(spark, d).select("id", T.has_choice(F.col("text")).alias("has_choice"))


_MENTIONS = "SELECT DISTINCT id, canonical FROM chunk JOIN alias ON contains(text, alias)"


@query("entities_mentioned", _MENTIONS, "chunk", "alias")
def entities_mentioned(spark, d):
    return documents.mentions(chunks(spark, d), M.aliases(spark))


@query("benchmark_word_mentions", """WITH word AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[^A-Za-zÀ-ÿ]+')) AS w FROM benchmark)
    SELECT doc_id, count(*) AS words FROM documents JOIN (SELECT w FROM word WHERE length(w) >= 6) ON contains(text, w) GROUP BY doc_id""")
def benchmark_word_mentions(spark, d):
    """Documents against a large dictionary: how many of the long words of all benchmark texts are in each."""
    words = M.table(spark, d, "benchmark").select(F.explode(F.split("text", "[^A-Za-zÀ-ÿ]+")).alias("pattern")).filter(F.length("pattern") >= 6)
    return containing(M.table(spark, d, "documents"), words, "doc_id").groupBy(F.col("id").alias("doc_id")).agg(F.count(F.lit(1)).alias("words"))


@query("similar_parts", """WITH c AS (SELECT p_partkey, p_name, list_filter(string_split(p_name, ''), lambda x: x <> '') AS l FROM part WHERE p_partkey % 100 = 0),
    p AS (SELECT DISTINCT p_name AS other, list_filter(string_split(p_name, ''), lambda x: x <> '') AS m FROM part),
    a AS (SELECT name, list_sort(list(x || '-' || k)) AS la, count(*) AS n FROM (SELECT name, x, row_number() OVER (PARTITION BY name, x) AS k FROM (SELECT DISTINCT p_name AS name, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM c)) GROUP BY name),
    b AS (SELECT name AS other, list(x || '-' || k) AS lb, count(*) AS n FROM (SELECT name, x, row_number() OVER (PARTITION BY name, x) AS k FROM (SELECT other AS name, unnest(m) AS x, generate_subscripts(m, 1) AS i FROM p)) GROUP BY name)
    SELECT name, other FROM a JOIN b ON 2 * len(list_intersect(la, lb)) >= 0.9 * (a.n + b.n)""")
def similar_parts(spark, d):
    """Of every hundredth part, the parts whose names share nine tenths of their letters."""
    parts = M.table(spark, d, "part")
    return similar_pairs(parts.filter("p_partkey % 100 = 0").select(F.col("p_name").alias("name")), parts.select(F.col("p_name").alias("other")), 0.9)


@query("enrich_chunks", f"""WITH m AS ({_MENTIONS}), e AS (SELECT id, string_agg(canonical, ',' ORDER BY canonical) AS e FROM m GROUP BY id)
    SELECT s.id, event_order, array_to_string(c, ',') AS characters, coalesce(e, '') AS entities, regexp_matches(text, '(?m)^##?\\s*选项|^-\\s+.+$') AS has_choice, length(text)::BIGINT AS n_chars
    FROM {_SPEAKERS} s LEFT JOIN e ON s.id = e.id""", "chunk", "alias")  # fmt: skip
def enrich_chunks(spark, d):
    out = documents.enrich(chunks(spark, d), M.aliases(spark))
    return out.select("id", "event_order", F.array_join("characters", ",").alias("characters"), F.array_join("entities", ",").alias("entities"), "has_choice", F.length("text").cast(LONG).alias("n_chars"))


@query("validate_chunks", f"""SELECT id, fault FROM (SELECT id, unnest([CASE WHEN length(trim(text)) = 0 THEN 'empty' WHEN length(text) < 100 THEN 'short' WHEN length(text) > 2000 THEN 'long' END,
    CASE WHEN len(c) = 0 THEN 'no_characters' END]) AS fault FROM {_SPEAKERS}) WHERE fault IS NOT NULL""", "chunk")  # fmt: skip
def validate_chunks(spark, d):
    return documents.chunk_faults(chunks(spark, d).withColumn("characters", T.speakers(F.col("text"))))


@query("chunk_size_stats", "SELECT min(length(text))::BIGINT AS least, max(length(text))::BIGINT AS most, (sum(length(text)) // count(*))::BIGINT AS mean FROM chunk", "chunk")
def chunk_size_stats(spark, d):
    n = F.length("text").cast(LONG)
    return chunks(spark, d).agg(F.min(n).alias("least"), F.max(n).alias("most"), F.floor(F.sum(n) / F.count(n)).alias("mean"))


@query("pipeline_stats", "SELECT (SELECT count(*) FROM dialogue) AS docs, count(*) AS chunks, count(*) FILTER (WHERE length(text) < 100) AS short_chunks, (SELECT count(*) FROM dialogue) - count(DISTINCT file_path) AS failed FROM chunk", "chunk", "dialogue")
def pipeline_stats(spark, d):
    docs = M.dialogues(spark, d).select("file_path")
    per = chunks(spark, d).groupBy("file_path").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length("text") < 100).alias("s"))
    return docs.join(per, "file_path", "left").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("chunks"), F.sum("s").alias("short_chunks"), F.count_if(F.col("n").isNull()).alias("failed"))


_CHARS = f"(SELECT id, unnest(c) AS name, event_order FROM {_SPEAKERS})"


@query("character_chunks", f"SELECT name, id, event_order FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY event_order, id) AS r FROM {_CHARS}) WHERE r <= 50", "chunk")
def character_chunks(spark, d):
    rows = chunks(spark, d).select("id", "event_order", F.explode(T.speakers(F.col("text"))).alias("name"))
    order = Window.partitionBy("name").orderBy("event_order", "id")
    return rows.withColumn("r", F.row_number().over(order)).filter("r <= 50").select("name", "id", "event_order")


@query("chunk_characters", f"SELECT id, string_agg(name, ',' ORDER BY name) AS names, count(*) AS n FROM {_CHARS} GROUP BY id", "chunk")
def chunk_characters(spark, d):
    rows = chunks(spark, d).select("id", F.explode(T.speakers(F.col("text"))).alias("name"))
    return rows.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"), F.count(F.lit(1)).alias("n"))


@query("link_chunks", f"SELECT name, id FROM {_CHARS} WHERE name IN (SELECT alias FROM alias WHERE entity_type = 'Character')", "chunk", "alias")
def link_chunks(spark, d):
    rows = chunks(spark, d).select("id", F.explode(T.speakers(F.col("text"))).alias("name"))
    known = M.aliases(spark).filter("entity_type = 'Character'").select(F.col("alias").alias("name")).distinct()
    return rows.join(F.broadcast(known), "name", "left_semi").select("name", "id")


@query("payload_filter", f"SELECT id FROM {_SPEAKERS} WHERE list_contains(c, 'user') AND regexp_extract(file_path, 'chapter(\\d+)_', 1)::INT IN (1, 2)", "chunk")
def payload_filter(spark, d):
    rows = chunks(spark, d).withColumn("characters", T.speakers(F.col("text")))
    return vectors.payload_filter(rows, {"characters": "user", "chapter": [1, 2]}).select("id")


def raw_names(spark, d):
    """Speaker names of many kinds, made from customers."""
    k = F.col("c_custkey").cast("string")
    kinds = [F.lit("  "), F.lit("？？？"), F.concat(F.lit("【系统】"), k), F.concat(F.lit("A"), k, F.lit("&B"), k), F.concat(F.lit("N"), k, F.lit("。")), F.lit("选项1"), F.concat(F.lit("众人"), k),
             F.concat(F.lit("X"), k, F.lit("告示")), F.concat(F.lit("LongCharacterName"), F.substring(k, 1, 2)), F.concat(F.lit("L"), k, F.lit("（旁注）")), F.concat(F.lit("你一二三四五六"), k), F.concat(F.lit("选择"), k),
             F.concat(F.lit("来自"), k, F.lit("的声音")), F.concat(F.lit("Name"), k)]
    return M.table(spark, d, "customer").select("c_custkey", F.get(F.array(*kinds), (F.col("c_custkey") % 14).cast("int")).alias("name"))


_NAMES = """(SELECT c_custkey, k, ['  ', '？？？', '【系统】' || k, 'A' || k || '&B' || k, 'N' || k || '。', '选项1', '众人' || k, 'X' || k || '告示', 'LongCharacterName' || substr(k, 1, 2), 'L' || k || '（旁注）',
    '你一二三四五六' || k, '选择' || k, '来自' || k || '的声音', 'Name' || k][c_custkey % 14 + 1] AS name FROM (SELECT c_custkey, c_custkey::VARCHAR AS k FROM customer))"""
_FAULT = """CASE WHEN trim(name) = '' THEN 'empty'
    WHEN name IN ('？？？', '???', '---', '选项', '黑雾诅咒', '小机器人', '受伤的绒翼龙', '「木偶」', 'Saurian companion', '奇怪的鸟', '某个声音', '系统', '旁白', '画外音', '致敬', '深渊低语') THEN 'blacklisted'
    WHEN regexp_matches(name, '^\\[|^【|^（|^\\(|^开始条件|^结束条件|^查看$|^调查$|^触发$|^任务') THEN 'system_text'
    WHEN contains(name, '&') THEN 'combined_speaker'
    WHEN regexp_matches(name, '。|，.*，|、.*、|！.*。|？.*。|……|.{20,}|^你[^，。]{5,}|回想起.+的话$') THEN 'narrative_text'
    WHEN regexp_matches(name, '^选项\\d*$|^玩家选项$|^选择\\d*$|^分支\\d*$|^对话选项$') THEN 'ui_element'
    WHEN regexp_matches(name, '^众人|的人$|的声音$|^嘈杂|^远处|^某|^有人$|^旁人$|^路人|^神秘|^来自.+的') THEN 'generic_reference'
    WHEN regexp_matches(name, '通讯仪$|公告板$|告示$|信件$|留言$|^长翎|回忆）$|机仆$|情报$') THEN 'object_or_thing'
    WHEN length(name) > 15 THEN 'too_long' ELSE 'valid' END"""


@query("validate_names", f"SELECT c_custkey, {_FAULT} AS verdict, regexp_replace(trim(name), '^(.+?)（[^）]+）$', '\\1') AS clean FROM {_NAMES}")
def validate_names(spark, d):
    return raw_names(spark, d).select("c_custkey", F.coalesce(T.name_fault(F.col("name")), F.lit("valid")).alias("verdict"), T.without_note(F.col("name")).alias("clean"))


@query("validate_names_summary", f"SELECT verdict, count(*) AS n FROM (SELECT {_FAULT} AS verdict FROM {_NAMES}) GROUP BY verdict")
def validate_names_summary(spark, d):
    return raw_names(spark, d).groupBy(F.coalesce(T.name_fault(F.col("name")), F.lit("valid")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("strip_note", f"SELECT c_custkey, regexp_replace(trim(name), '^(.+?)（[^）]+）$', '\\1') AS clean FROM {_NAMES}")
def strip_note(spark, d):
    return raw_names(spark, d).select("c_custkey", T.without_note(F.col("name")).alias("clean"))


@query("split_speakers", f"SELECT c_custkey, string_agg(part, '|' ORDER BY part) AS parts FROM (SELECT c_custkey, unnest(string_split(name, '&')) AS part FROM {_NAMES} WHERE contains(name, '&')) GROUP BY c_custkey")
def split_speakers(spark, d):
    return raw_names(spark, d).filter(F.col("name").contains("&")).select("c_custkey", F.array_join(T.split_speakers(F.col("name")), "|").alias("parts"))


@query("truncate_output", "SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS cut FROM documents")
def truncate_output(spark, d):
    return M.table(spark, d, "documents").select("doc_id", T.shorten(F.col("text"), 100).alias("cut"))


@query("message_text", "SELECT conv_id, string_agg(text, '' ORDER BY turn) FILTER (WHERE role <> 'system') AS text FROM conversations GROUP BY conv_id")
def message_text(spark, d):
    block = F.struct("turn", F.when(F.col("role") == "system", "tool").otherwise("text").alias("type"), "text")
    blocks = M.table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(block)).alias("b"))
    text = F.filter("b", lambda x: x["type"] == "text")
    return blocks.select("conv_id", F.when(F.size(text) > 0, F.array_join(F.transform(text, lambda x: x["text"]), "")).alias("text"))


# -- aliases ---------------------------------------------------------------------------------


def name_uses(spark, d):
    """Names as they are used: roles of turns, and first words of documents."""
    roles = M.table(spark, d, "conversations").select(F.col("role").alias("name"))
    first = M.table(spark, d, "documents").select(F.get(F.split("text", " "), F.lit(0)).alias("name"))
    return roles.unionByName(first).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


_USES = "(SELECT name, count(*) AS n FROM (SELECT role AS name FROM conversations UNION ALL SELECT split_part(text, ' ', 1) FROM documents) GROUP BY name)"
_EXACT = f"(SELECT u.name, n, coalesce(a.c, u.name) AS canonical, a.c IS NOT NULL AS known FROM {_USES} u LEFT JOIN (SELECT alias, min(canonical) AS c FROM alias GROUP BY alias) a ON u.name = a.alias)"


@query("resolve_alias", f"SELECT name, n, canonical FROM {_EXACT}", "alias")
def resolve_alias(spark, d):
    return A.resolve(name_uses(spark, d), M.aliases(spark)).select("name", "n", "canonical")


@query("known_entities", f"SELECT name FROM {_EXACT} WHERE known", "alias")
def known_entities(spark, d):
    return name_uses(spark, d).join(F.broadcast(M.aliases(spark).select(F.col("alias").alias("name")).distinct()), "name", "left_semi").select("name")


@query("normalize_exact", f"""SELECT name, coalesce(CASE WHEN known THEN canonical END, (SELECT min(canonical) FROM alias WHERE lower(alias) = lower(name)), name) AS canonical FROM {_EXACT}""", "alias")
def normalize_exact(spark, d):
    return A.resolve(name_uses(spark, d), M.aliases(spark), fold_case=True).select("name", "canonical")


@query("normalize_fuzzy")
def normalize_fuzzy(spark, d):
    return A.resolve_fuzzy(name_uses(spark, d), M.aliases(spark)).select("name", "canonical")


@query("resolve_fulltext", """WITH use AS (SELECT DISTINCT name, unnest(TOKENS_OF_NAME) AS term FROM (SELECT n_name || ' of ' || r_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey)),
    word AS (SELECT name AS node, unnest(TOKENS_OF_DESCRIPTION) AS term FROM node WHERE label IN ('Place', 'Item')),
    hit AS (SELECT u.name, node, count(DISTINCT u.term) AS score FROM use u JOIN word ON u.term = word.term GROUP BY u.name, node)
    SELECT name, arg_min(node, (-score, node)) AS node, max(score) AS score FROM hit GROUP BY name""".replace("TOKENS_OF_NAME", M.sql_tokens("name")).replace("TOKENS_OF_DESCRIPTION", M.sql_tokens("description")), "node")
def resolve_fulltext(spark, d):
    """Each name goes to the graph node whose description shares most of its terms."""
    nodes = M.nodes(spark, d).filter("label IN ('Place', 'Item')").select(F.col("name").alias("node"), F.explode(T.tokens(F.col("description"))).alias("term"))
    named = M.table(spark, d, "nation").join(M.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat("n_name", F.lit(" of "), "r_name").alias("name"))
    uses = named.select("name", F.explode(T.tokens(F.col("name"))).alias("term")).distinct()
    hits = uses.join(nodes, "term").groupBy("name", "node").agg(F.countDistinct("term").alias("score"))
    return hits.groupBy("name").agg(F.min_by("node", F.struct(-F.col("score"), F.col("node"))).alias("node"), F.max("score").alias("score"))


@query("normalize_kg", "SELECT conv_id, turn, coalesce(a.c, role) AS entity, coalesce(a.t, 'Unknown') AS entity_type FROM conversations LEFT JOIN (SELECT alias, min(canonical) AS c, min(entity_type) AS t FROM alias GROUP BY alias) a ON role = alias", "alias")
def normalize_kg(spark, d):
    rows = M.table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("name"))
    known = M.aliases(spark).groupBy("alias").agg(F.min("entity_type").alias("t"))
    typed = rows.join(F.broadcast(known), F.col("name") == F.col("alias"), "left").drop("alias")
    return A.resolve(typed, M.aliases(spark)).select("conv_id", "turn", F.col("canonical").alias("entity"), F.coalesce("t", F.lit("Unknown")).alias("entity_type"))


@query("all_names", """WITH n AS (SELECT DISTINCT canonical, unnest([canonical, alias]) AS x FROM alias), m AS (SELECT canonical, string_agg(x, ',' ORDER BY x) AS names FROM n GROUP BY canonical)
    SELECT m.canonical, names, (SELECT count(*) FROM documents WHERE contains(text, lower(m.canonical))) AS docs FROM m""", "alias")
def all_names_query(spark, d):
    found = A.all_names(M.aliases(spark)).select("canonical", F.array_join("names", ",").alias("names"))
    docs = M.table(spark, d, "documents").select("text")
    hits = docs.join(F.broadcast(found.select("canonical")), F.col("text").contains(F.lower("canonical"))).groupBy("canonical").agg(F.count(F.lit(1)).alias("docs"))
    return found.join(hits, "canonical", "left").select("canonical", "names", F.coalesce("docs", F.lit(0)).alias("docs"))


def _entries(spark, d):
    """A dictionary made of the customers' segments and nations: its keys repeat across scopes."""
    c = M.table(spark, d, "customer").join(M.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    key, kind = F.concat(F.lit("k"), (F.col("c_custkey") % 97).cast("string")), F.when(F.col("c_custkey") % 13 == 0, "Person").otherwise("Character")
    return c.select(F.col("n_name").alias("scope"), key.alias("key"), F.when(F.col("c_custkey") % 17 != 0, F.col("c_name")).alias("canonical"), kind.alias("entity_type"), F.col("c_mktsegment").alias("alias"))


_ENTRIES = "(SELECT n_name AS scope, 'k' || (c_custkey % 97) AS key, CASE WHEN c_custkey % 17 <> 0 THEN c_name END AS canonical, CASE WHEN c_custkey % 13 = 0 THEN 'Person' ELSE 'Character' END AS entity_type, c_mktsegment AS alias FROM customer JOIN nation ON c_nationkey = n_nationkey)"


@query("alias_lint", f"""SELECT DISTINCT key, fault FROM (SELECT key, 'missing_canonical' AS fault FROM {_ENTRIES} WHERE canonical IS NULL UNION ALL SELECT key, 'wrong_type' FROM {_ENTRIES} WHERE entity_type = 'Person'
    UNION ALL SELECT key, 'duplicate_key' FROM {_ENTRIES} GROUP BY key HAVING count(DISTINCT (scope, entity_type)) > 1)""")  # fmt: skip
def alias_lint(spark, d):
    return A.lint(_entries(spark, d))


@query("alias_merge", "SELECT scope, 'C:' || c_custkey AS key, c_name AS canonical FROM (SELECT *, n_name AS scope FROM customer JOIN nation ON c_nationkey = n_nationkey)")
def alias_merge(spark, d):
    c = M.table(spark, d, "customer").join(M.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("scope"), F.concat(F.lit("C:"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_name").alias("canonical"), F.lit("Character").alias("entity_type"))
    return A.merge([c.filter("scope < 'J'"), c.filter("scope >= 'J'")]).select("scope", "key", "canonical")


@query("alias_split", f"SELECT scope, entity_type, count(*) AS n, count(DISTINCT key) AS keys FROM {_ENTRIES} GROUP BY scope, entity_type")
def alias_split(spark, d):
    """The dictionary, split by scope and type, read back from its folders."""
    path = f"{shared_dir(spark)}/aliases-{uuid.uuid4().hex}"
    A.write_split(_entries(spark, d), path)
    back = A.read_split(spark, path, "key string, canonical string, alias string, scope string, entity_type string")
    return back.groupBy("scope", "entity_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("keys"))


@query("alias_add", "SELECT 'k' || p_partkey AS key, p_name AS canonical FROM part WHERE p_partkey >= 97")
def alias_add(spark, d):
    new = M.table(spark, d, "part").select(F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_name").alias("canonical"))
    return A.additions(_entries(spark, d), new)


@query("user_dict", f"SELECT DISTINCT x || ' 999999 nr' AS entry FROM (SELECT unnest([canonical, alias]) AS x FROM {_ENTRIES}) WHERE length(x) >= 2")
def user_dict(spark, d):
    names = _entries(spark, d).select(F.explode(F.array("canonical", "alias")).alias("x")).filter(F.length("x") >= 2).distinct()
    return names.select(F.concat("x", F.lit(" 999999 nr")).alias("entry"))


_REVIEW = "(SELECT doc_id, '| ' || split_part(text, ' ', 1) || ' | Character | pending |' AS row FROM documents WHERE NOT contains(split_part(text, ' ', 1), '|') AND NOT contains(split_part(text, ' ', 1), chr(10)))"


def review_rows(spark, d):
    """A review table in Markdown, a line for each document's first word."""
    first = F.get(F.split("text", " "), F.lit(0))
    rows = M.table(spark, d, "documents").withColumn("f", first).filter(~F.col("f").contains("|") & ~F.col("f").contains("\n"))
    return rows.select("doc_id", F.concat(F.lit("| "), "f", F.lit(" | Character | pending |")).alias("row"))


def parsed_review(spark, d):
    cells = F.transform(F.split("row", r"\|"), T.strip)
    return review_rows(spark, d).withColumn("c", cells).filter(F.get("c", F.lit(3)) == "pending").select("doc_id", F.get("c", F.lit(1)).alias("name"), F.get("c", F.lit(2)).alias("entity_type"))


@query("parse_review", f"SELECT doc_id, trim(split_part(row, '|', 2)) AS name, trim(split_part(row, '|', 3)) AS entity_type FROM {_REVIEW}")
def parse_review(spark, d):
    return parsed_review(spark, d)


@query("alias_from_review", f"SELECT DISTINCT trim(split_part(row, '|', 2)) AS name, CASE WHEN toxic = 1 THEN 'skip' ELSE 'add' END AS decision FROM {_REVIEW} r JOIN labels l ON r.doc_id = l.doc_id")
def alias_from_review(spark, d):
    decisions = M.table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "skip").otherwise("add").alias("decision"))
    return parsed_review(spark, d).join(decisions, "doc_id").select("name", "decision").distinct()


@query("review_report", f"SELECT count(*) AS names, sum(known::INT)::BIGINT AS known, (100 * sum(known::INT) // greatest(count(*), 1))::BIGINT AS hit_percent FROM {_EXACT}", "alias")
def review_report(spark, d):
    known = F.broadcast(M.aliases(spark).select(F.col("alias").alias("name"), F.lit(1).alias("k")).distinct())
    rows = name_uses(spark, d).join(known, "name", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    return rows.agg(F.count(F.lit(1)).alias("names"), F.sum("k").alias("known"), F.floor(100 * F.sum("k") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("hit_percent"))


# -- sparse retrieval ------------------------------------------------------------------------


def docs(spark, d):
    return M.table(spark, d, "documents").select("doc_id", "text")


@query("tokenize", "SELECT doc_id, count(*) AS n, count(DISTINCT term) AS distinct_terms FROM token GROUP BY doc_id", "token")
def tokenize(spark, d):
    t = T.tokens(F.col("text"))
    return docs(spark, d).select("doc_id", F.size(t).cast(LONG).alias("n"), F.size(F.array_distinct(t)).cast(LONG).alias("distinct_terms")).filter("n > 0")


def index(spark, d, norm=False):
    return bm25.index(docs(spark, d), "doc_id", "text", norm)


def fitted(spark, d):
    """All postings and the model fitted on them."""
    ix = index(spark, d)
    postings = ix.postings()
    return postings, bm25.fit(postings, ix.size)


@query("bm25_tf", "SELECT doc_id, term, tf FROM tf", "tf")
def bm25_tf(spark, d):
    return bm25.counted(bm25.tokenised(docs(spark, d), "doc_id", "text", False)).select(F.col("id").alias("doc_id"), "term", "tf")


@query("bm25_fit", "SELECT term, df, round(idf, 6) AS idf FROM df", "df")
def bm25_fit(spark, d):
    return fitted(spark, d)[1][0].select("term", "df", F.round("idf", 6).alias("idf"))


@query("bm25_vocab", "SELECT term, row_number() OVER (ORDER BY df DESC, term) - 1 AS idx FROM df", "df")
def bm25_vocab(spark, d):
    return bm25.vocabulary(fitted(spark, d)[1][0]).select("term", "idx")


@query("bm25_weights", "SELECT doc_id, term, round(w, 6) AS w FROM weight", "weight")
def bm25_weights(spark, d):
    return bm25.weights(*fitted(spark, d)).select(F.col("id").alias("doc_id"), "term", F.round("w", 6).alias("w"))


@query("bm25_roundtrip", "SELECT term, df, round(idf, 6) AS idf, n_docs, round(avg_dl, 6) AS avg_dl FROM df CROSS JOIN stats", "df", "stats")
def bm25_roundtrip(spark, d):
    """The fitted model, saved and loaded again."""
    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    bm25.save(fitted(spark, d)[1], path)
    known, size = bm25.load(spark, path)
    return known.join(F.broadcast(size)).select("term", "df", F.round("idf", 6).alias("idf"), "n_docs", F.round("avg_dl", 6).alias("avg_dl"))


@query("sparse_pack", "SELECT doc_id, string_agg(idx, ' ' ORDER BY idx) AS indices, string_agg(tf, ' ' ORDER BY idx) AS tfs FROM tf JOIN (SELECT term, row_number() OVER (ORDER BY df DESC, term) - 1 AS idx FROM df) v ON tf.term = v.term GROUP BY doc_id", "df")
def sparse_pack(spark, d):
    postings, (known, _) = fitted(spark, d)
    packed = bm25.pack(postings, bm25.vocabulary(known))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return packed.select(F.col("id").alias("doc_id"), text("indices").alias("indices"), text("values").alias("tfs"))


_QUESTION = """(SELECT q, t.term, idf * (n * 2.2) / (n + 1.2 * (1 - 0.75 + 0.75 * l / avg_dl)) AS w FROM (SELECT item_id AS q, term, count(*) AS n FROM (SELECT item_id, unnest(TOKENS) AS term FROM benchmark) GROUP BY 1, 2) t
    JOIN (SELECT item_id, len(TOKENS) AS l FROM benchmark) s ON t.q = s.item_id JOIN df ON t.term = df.term CROSS JOIN stats)""".replace("TOKENS", M.sql_tokens("text"))
_BM25 = f"(SELECT q, doc_id AS id, sum(weight.w * x.w) AS score FROM weight JOIN {_QUESTION} x ON weight.term = x.term GROUP BY q, doc_id)"


@query("sparse_topk", f"SELECT q, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, id) AS r FROM {_BM25}) WHERE r <= 5", "weight")
def sparse_topk(spark, d):
    scored = bm25.search(index(spark, d), M.table(spark, d, "benchmark"), "item_id", "text")[0]
    return vectors.top_k(scored.withColumn("score", F.round("score", 6)), 5).select("q", "id", "score")


# -- texts without blanks ----------------------------------------------------------------------


def _unbroken(table):
    """A table's texts in small letters with the blanks taken out, so that words have to be found."""
    return table.withColumn("text", F.regexp_replace(F.lower("text"), "[ \t]+", ""))


_LETTERS = r"\p{L}"
_GRAMS = r"""run AS (SELECT unnest(regexp_extract_all(regexp_replace(lower(text), '[ \t]+', '', 'g'), '[\p{L}]+')) AS r FROM documents),
    gram AS (SELECT substr(r, i, k) AS gram, count(*) AS n FROM (SELECT r, unnest(range(1, length(r) + 1)) AS i FROM run), (SELECT unnest(range(1, 7)) AS k) WHERE i + k - 1 <= length(r) GROUP BY 1),
    word AS (SELECT gram, n FROM gram WHERE n >= 20 AND length(gram) BETWEEN 2 AND 5)"""
_BESIDE = """SELECT word.gram, ln(any_value(word.n)) - (coalesce(sum(x.n * ln(x.n)), 0) + CASE WHEN any_value(word.n) > coalesce(sum(x.n), 0) THEN (any_value(word.n) - coalesce(sum(x.n), 0)) * ln(any_value(word.n) - coalesce(sum(x.n), 0)) ELSE 0 END) / any_value(word.n) AS h
    FROM word LEFT JOIN (SELECT CUT AS core, n FROM gram WHERE length(gram) > 1) x ON core = word.gram GROUP BY word.gram"""


def learned_words(spark, d):
    return segmentation.learn_words(_unbroken(docs(spark, d)), letters=_LETTERS, longest=5, min_count=20)


@query("learn_words", f"""WITH {_GRAMS}, cuts AS (SELECT gram, n, unnest(range(1, length(gram))) AS k FROM word), cohesion AS (SELECT cuts.gram, min(cuts.n * t.every::DOUBLE / (a.n::DOUBLE * b.n)) AS c FROM cuts
    JOIN gram a ON a.gram = substr(cuts.gram, 1, k) JOIN gram b ON b.gram = substr(cuts.gram, k + 1) CROSS JOIN (SELECT sum(n) AS every FROM gram WHERE length(gram) = 1) t GROUP BY cuts.gram)
    SELECT word.gram AS word, n, round(c, 4) AS cohesion, CASE WHEN l.h < 5e-7 THEN 0 ELSE round(l.h, 6) END AS "left", CASE WHEN r.h < 5e-7 THEN 0 ELSE round(r.h, 6) END AS "right" FROM word JOIN cohesion ON word.gram = cohesion.gram
    JOIN ({_BESIDE.replace("CUT", "substr(gram, 2)")}) l ON word.gram = l.gram JOIN ({_BESIDE.replace("CUT", "substr(gram, 1, length(gram) - 1)")}) r ON word.gram = r.gram""")  # fmt: skip
def learn_words(spark, d):
    """Every string of two to five letters that the documents, their blanks taken out, hold twenty times: how it holds together."""
    plain = lambda h: F.when(F.col(h) < 5e-7, 0.0).otherwise(F.round(h, 6)).alias(h)  # noqa: E731  (no zero with a sign)
    return learned_words(spark, d).select("word", "n", F.round("cohesion", 4).alias("cohesion"), plain("left"), plain("right"))


def _dictionary(spark, d):
    """Likely words of the documents and those of the exported user dictionary."""
    return written(segmentation.dictionary(segmentation.user_words(user_dict(spark, d)), segmentation.likely_words(learned_words(spark, d))), "dictionary")


@query("tokenize_dict")
def tokenize_dict(spark, d):
    """The documents' terms, found again after their blanks were taken out."""
    terms = segmentation.segment(_unbroken(docs(spark, d)), _dictionary(spark, d), "doc_id", letters=_LETTERS)
    return terms.select(F.col("id").alias("doc_id"), F.size("terms").cast(LONG).alias("n"), F.md5(F.array_join("terms", " ")).alias("terms_md5"))


@query("segmented_topk")
def segmented_topk(spark, d):
    """BM25 over segmented texts: the five best documents for every question, both without blanks."""
    ix = bm25.index(_unbroken(docs(spark, d)), "doc_id", "text", False, segmentation.cutter(_dictionary(spark, d), _LETTERS))
    scored = bm25.search(ix, _unbroken(M.table(spark, d, "benchmark")), "item_id", "text")[0]
    return vectors.top_k(scored.withColumn("score", F.round("score", 6)), 5).select("q", "id", "score")

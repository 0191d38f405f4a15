"""Column functions for dialogue text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Speakers that are no characters, and the mark of a choice (fixed values).
SYSTEM_SPEAKERS = ["？？？", "选项", "---", "黑雾诅咒", "小机器人", "受伤的绒翼龙"]
CHOICE = "选项"
#: Names that the line heuristic leaves out (fixed values).
HEURISTIC_SKIPS = ["选项", "---", "？？？"]

#: Names that are never characters (fixed values).
BLACKLIST = ["？？？", "???", "---", "选项", "黑雾诅咒", "小机器人", "受伤的绒翼龙", "「木偶」", "Saurian companion", "奇怪的鸟", "某个声音", "系统", "旁白", "画外音", "致敬", "深渊低语"]
#: Patterns of names that are no characters, by reason, in the order of testing (fixed values).
NAME_RULES = [
    ("system_text", [r"^\[", "^【", "^（", r"^\(", "^开始条件", "^结束条件", "^查看$", "^调查$", "^触发$", "^任务"]),
    ("combined_speaker", ["&"]),
    ("narrative_text", ["。", "，.*，", "、.*、", "！.*。", "？.*。", "……", ".{20,}", "^你[^，。]{5,}", "回想起.+的话$"]),
    ("ui_element", [r"^选项\d*$", "^玩家选项$", r"^选择\d*$", r"^分支\d*$", "^对话选项$"]),
    ("generic_reference", ["^众人", "的人$", "的声音$", "^嘈杂", "^远处", "^某", "^有人$", "^旁人$", "^路人", "^神秘", "^来自.+的"]),
    ("object_or_thing", ["通讯仪$", "公告板$", "告示$", "信件$", "留言$", "^长翎", "回忆）$", "机仆$", "情报$"]),
]
LONGEST_NAME = 15

TOKEN = r"[\p{L}\p{N}]{2,}"
HAN = r"\p{IsHan}"
#: Code points among which all Han characters are: a test of plain ranges, which is quick.
MAY_BE_HAN = r"[\x{2E80}-\x{FAFF}\x{16FE0}-\x{3FFFF}]"


def strip(text: Column) -> Column:
    """Without blanks at either end, the ideographic space and the byte-order mark among them."""
    return F.regexp_replace(text, r"^[\s　﻿]+|[\s　﻿]+$", "")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def tokens(text: Column) -> Column:
    """Terms in small letters: runs of two or more letters or digits, and for a run of Han
    characters, which has no blanks between words, each two neighbours."""
    low = F.lower(text)
    plain = lambda x: F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(HAN + "{2,}"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.when(text.rlike(MAY_BE_HAN), F.concat(plain(F.regexp_replace(low, HAN, " ")), pairs)).otherwise(plain(low))


def speakers(text: Column) -> Column:
    """Names before a full-width colon at line starts: distinct, sorted, without system names and choices."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(?md)^([^：\n]+)："), F.lit(1)), strip)
    named = F.filter(found, lambda x: (x != "") & ~x.isin(SYSTEM_SPEAKERS) & ~x.startswith(CHOICE))
    return F.array_sort(F.array_distinct(named))


def speakers_heuristic(text: Column) -> Column:
    """The looser variant for extraction: any line with a colon that is no heading."""
    said = F.filter(lines(text), lambda x: x.contains("：") & ~x.startswith("#"))
    names = F.transform(said, lambda x: strip(F.substring_index(x, "：", 1)))
    return F.array_sort(F.array_distinct(F.filter(names, lambda x: (x != "") & (F.length(x) < 20) & ~x.startswith("（") & ~x.isin(HEURISTIC_SKIPS))))


def has_choice(text: Column) -> Column:
    return text.rlike(r"(?md)^##?\s*选项|^-\s+.+$")


def event_order(task: Column, chapter: Column, scene: Column, chunk: Column) -> Column:
    """Task, chapter, scene and chunk in one number; a task that is no number counts as 0."""
    return F.coalesce(task.try_cast("bigint"), F.lit(0)) * 10000 + chapter * 1000 + scene * 10 + chunk


def global_chapter(task: Column, chapter: Column) -> Column:
    return F.coalesce(task.try_cast("bigint") * 100 + chapter, chapter.cast("bigint"))


def without_note(name: Column) -> Column:
    """``X（note）`` becomes ``X``."""
    return F.when(name.rlike("^.+?（[^）]+）$"), strip(F.regexp_extract(name, "^(.+?)（[^）]+）$", 1))).otherwise(strip(name))


def name_fault(name: Column, extra: list[str] | None = None) -> Column:
    """The first reason for which a name is no character's; null for a good name."""
    s = strip(name)
    out = F.when(s == "", "empty").when(s.isin(BLACKLIST + (extra or [])), "blacklisted")
    for reason, patterns in NAME_RULES:
        out = out.when(s.rlike("|".join(f"(?:{p})" for p in patterns)), reason)
    return out.when(F.length(s) > LONGEST_NAME, "too_long")


def split_speakers(name: Column) -> Column:
    """Parts of a combined speaker that are good names, without their notes."""
    parts = F.when(name.contains("&"), F.filter(F.transform(F.split(name, "&"), strip), lambda x: x != "")).otherwise(F.array(name))
    return F.transform(F.filter(parts, lambda x: name_fault(x).isNull()), without_note)


def shorten(text: Column, most: int) -> Column:
    """At most ``most`` characters, and three dots where something was cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)

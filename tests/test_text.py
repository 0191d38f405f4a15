from pyspark.sql import functions as F

from sagaframe.functions import text as T
from sagaframe.operators import documents as D


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


def test_strip_knows_the_ideographic_space(spark):
    assert one(spark, "　 a b　\n", T.strip) == "a b"


def test_speakers(spark):
    text = "派蒙：你好\n旅行者 ：嗯\n？？？：谁\n选项一：x\n## 选项\n派蒙：again\nno colon"
    assert one(spark, text, T.speakers) == ["旅行者", "派蒙"]
    assert one(spark, "# a：b\n（旁白）：x\n甲：y", T.speakers_heuristic) == ["甲"]


def test_choice(spark):
    assert one(spark, "a\n- go\nb", T.has_choice) is True
    assert one(spark, "a\n-go", T.has_choice) is False


def test_orders(spark):
    df = spark.createDataFrame([("12", 3), ("x1", 3)], "t string, c int")
    rows = df.select(T.event_order(F.col("t"), F.col("c"), F.lit(2), F.lit(1)), T.global_chapter(F.col("t"), F.col("c"))).collect()
    assert [tuple(r) for r in rows] == [(123021, 1203), (3021, 3)]


def test_name_rules(spark):
    names = {"": "empty", "系统": "blacklisted", "【x": "system_text", "a&b": "combined_speaker", "他说。": "narrative_text", "选择3": "ui_element", "受伤的人": "generic_reference", "战场情报": "object_or_thing", "a" * 16: "too_long", "丽莎（回忆）": "object_or_thing", "丽莎（梦）": None}
    for name, want in names.items():
        assert one(spark, name, T.name_fault) == want, name
    assert one(spark, "丽莎（梦）", T.without_note) == "丽莎"
    assert one(spark, "丽莎&系统& 派蒙（梦）", T.split_speakers) == ["丽莎", "派蒙"]


def test_headers(spark):
    content = "﻿# 任务甲 - 第3章：开端\n# 系列 第二幕\n# 来源：http://x\n## 剧情简介\n第一行\n\n第二行\n---\n## 场景\n甲：乙"
    docs = spark.createDataFrame([("7/chapter9_dialogue.txt", "7", content), ("8/chapter4_dialogue.txt", "8", "plain")], "file_path string, task_id string, content string")
    a, b = D.parse_headers(docs).orderBy("task_id").collect()
    assert (a.task_name, a.chapter_number, a.chapter_title, a.series_name, a.source_url, a.summary) == ("任务甲", 3, "开端", "系列 第二幕", "http://x", "第一行\n第二行")
    assert (b.task_name, b.chapter_number, b.chapter_title, b.series_name, b.summary) == ("Unknown", 4, "Unknown", None, None)
    assert one(spark, content, D.extract_body).startswith("---")
    assert one(spark, "x\ny", D.extract_body) == "x\ny"


def test_scenes_and_orders(spark):
    content = "lead\n## A\none\n## 选项\n- pick\n---\ntail\n##  \n"
    docs = spark.createDataFrame([("1/chapter2_dialogue.txt", "1", content)], "file_path string, task_id string, content string")
    scenes = D.split_scenes(docs).orderBy("pos").collect()
    assert [(s.title, s.text) for s in scenes] == [(None, "lead"), ("A", "one"), ("选项", "- pick"), (None, "tail\n##")]
    titles = [None, None, "A", "A", None, "A"]
    chunks = spark.createDataFrame([("1/chapter2_dialogue.txt", "1", k, t, "x") for k, t in enumerate(titles)], "file_path string, task_id string, pos bigint, title string, text string")
    rows = D.order_chunks(chunks).orderBy("pos").collect()
    assert [(r.scene_order, r.chunk_order) for r in rows] == [(0, 1), (0, 2), (1, 0), (1, 1), (2, 0), (3, 0)]
    assert rows[0].id == "1_2_0_1_0" and rows[2].event_order == 12010


def test_folding():
    line = "甲：" + "字" * 100
    long = "\n".join([line] * 40)
    parts = D.fold_chunks([("A", long)], merge=False)
    assert all(len(t) <= 1500 for _, t in parts) and len(parts) > 2
    assert D.fold_chunks([("A", "x" * 1500)]) == [("A", "x" * 1500)]
    assert D.fold_chunks([("A", "x" * 1501)]) == [("A", "x" * 1501)]
    small = [("A", "x" * 749), ("A", "y" * 750), ("B", "z")]
    assert [len(t) for _, t in D.fold_chunks(small)] == [1501, 1]
    tail = D.fold_chunks([(None, "\n".join(["a" * 40] * 60))], merge=False)
    assert tail[0][1][-81:] == tail[1][1][:81]  # whole lines up to the overlap are carried on
    assert D.fold_chunks([]) == []


def test_terms_of_han_text(spark):
    from pyspark.sql import functions as F

    from sagaframe.functions import text as T
    from sagaframe.plans.model import sql_tokens
    from tests.oracle import duckdb

    texts = ["白云山 said: hello小河x9", "风", "ab 风起地 c", "Ünïcode ok", "", "东西南东西"]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(T.tokens(F.col("t"))).collect()]
    assert got[0] == ["said", "hello", "x9", "白云", "云山", "小河"] and got[2] == ["ab", "风起", "起地"] and got[1] == got[4] == []
    con = duckdb.connect()
    assert [con.execute(f"SELECT {sql_tokens('?::VARCHAR')}", [t, t]).fetchone()[0] for t in texts] == got


def test_fuzzy_names_match_brute_force(spark, sf_dir):
    import difflib

    from sagaframe.operators import aliases as A
    from sagaframe.plans import model as M
    from sagaframe.plans import text_queries as Q

    entries = M.aliases(spark)
    rows = entries.collect()
    names = [r.name for r in Q.name_uses(spark, sf_dir).collect()] + ["Usr", "asistant", "Tionn", "HEIT", "menté", "Eau", "hands", "x", "Syst em", "Onse"]
    exact, loose = {}, {}
    for r in rows:
        exact[r.alias] = min(r.canonical, exact.get(r.alias, r.canonical))
        loose[r.alias.lower()] = min(r.canonical, loose.get(r.alias.lower(), r.canonical))

    def plain(name, kind=None):
        if name in exact or name.lower() in loose:
            return exact.get(name, loose.get(name.lower()))
        same = sorted({r.canonical for r in rows if r.entity_type == kind})
        close = difflib.get_close_matches(name, same or sorted({r.canonical for r in rows}), n=1, cutoff=0.7) if name else []
        return close[0] if close else name

    typed = spark.createDataFrame([(n, k) for n in dict.fromkeys(names) for k in (None, "Place", "Event", "Odd")], "name string, kind string")
    got = {(r.name, r.kind): r.canonical for r in A.resolve_fuzzy(typed, entries, type_col="kind").collect()}
    assert got == {(r.name, r.kind): plain(r.name, r.kind) for r in typed.collect()} and len(set(got.values()) - set(names)) > 3
    assert {r.canonical for r in A.resolve_fuzzy(spark.createDataFrame([("Usr",)], "name string"), entries).collect()} == {plain("Usr")}


def test_dense_topk_by_blocks(spark):
    import numpy as np

    from sagaframe.operators import vectors

    rng = np.random.default_rng(1)
    v = rng.integers(-3, 4, (60, 4)).astype(float)
    v[0] = [1, 0, 0, 0]
    points = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v) if x.any()] + [(99, None)], "id long, embedding array<float>").repartition(3)
    asked = points.filter("id % 10 = 0").selectExpr("id AS q", "embedding")
    got = {(r.q, r.id): r.score for r in vectors.dense_topk(asked, points, 5, block=7).collect()}
    unit = {k: x / np.linalg.norm(x) for k, x in enumerate(v) if x.any()}
    want = {}
    for q in [k for k in unit if k % 10 == 0]:
        s = {k: round(float(unit[q] @ x), 6) for k, x in unit.items()}
        want |= {(q, k): s[k] for k in sorted(s, key=lambda k: (-s[k], k))[:5]}
    assert got == want


def test_vocabulary_numbers(spark):
    from sagaframe.operators import bm25

    known = spark.createDataFrame([(f"t{k}", k % 7) for k in range(500)], "term string, df long").repartition(6)
    got = [(r.term, r.df) for r in bm25.vocabulary(known).orderBy("idx").collect()]
    assert got == sorted(got, key=lambda x: (-x[1], x[0])) and {r.idx for r in bm25.vocabulary(known).collect()} == set(range(500))


def test_many_patterns(spark):
    """Overlapping, nested, repeated, empty and null patterns, in one automaton and in several."""
    from sagaframe.operators.patterns import containing

    texts = [(1, "she sells 白云山 shells"), (2, ""), (3, None), (4, "hers"), (4, "usher"), (None, "he")]
    words = ["he", "she", "hers", "her", "白云", "云山", "", None, "x", "sells", "sell", "he"]
    rows, patterns = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(w,) for w in words], "pattern string")
    want = sorted(((i, w) for i, t in texts for w in {*words} if t is not None and w is not None and w in t), key=repr)
    for shard in (200_000, 4):
        found = containing(rows, patterns, shard=shard)
        assert sorted(map(tuple, found.collect()), key=repr) == want
    assert containing(rows, patterns.filter("false")).count() == 0


def test_similar_pairs_match_brute_force(spark):
    import random
    from collections import Counter

    from sagaframe.operators.patterns import similar_pairs

    rng = random.Random(6)
    some = lambda n: ["".join(rng.choice("abcdeé云") for _ in range(rng.randrange(0, 9))) for _ in range(n)]
    a, b = [*some(80), None, "", "aaaa"], [*some(120), None, "", "aaa", "aaaa"]
    left, right = spark.createDataFrame([(x,) for x in a], "name string"), spark.createDataFrame([(x,) for x in b], "other string")
    for cutoff in (0.5, 0.7, 0.9, 1.0):
        want = {(x, y) for x in a for y in b if x and y and 2 * (Counter(x) & Counter(y)).total() >= cutoff * (len(x) + len(y)) - 1e-9}
        got = similar_pairs(left, right, cutoff)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan

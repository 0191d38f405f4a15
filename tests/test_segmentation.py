import math
import random
import tracemalloc
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import functions as F

from sagaframe.operators import bm25
from sagaframe.operators import segmentation as S
from sagaframe.plans import text_queries as Q


def words(spark, **counts):
    return spark.createDataFrame(list(counts.items()), "word string, n bigint")


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "id int, text string")


def all_paths(text, known, letters):
    """Every way to cut a block into units and known words, as lists."""
    units = regex.findall(rf"[{letters}]|[^{letters}]+", text)
    if not units:
        return [[]]
    found = []
    for k in range(1, len(units) + 1):
        first = "".join(units[:k])
        if k == 1 or first in known:
            found += [[first, *rest] for rest in all_paths("".join(units[k:]), known, letters)]
    return found


def brute(text, known, letters, shortest=2):
    total = sum(known.values())
    weight = lambda w: max(math.log(known[w] / total) if w in known else -math.inf, -math.log(total) if len(regex.findall(rf"[{letters}]|[^{letters}]+", w)) == 1 else -math.inf)
    out = []
    for block in regex.findall(rf"[{letters}\p{{L}}\p{{N}}]+", text.lower()):
        # of equal paths the one with longer words, seen from the end
        best = max(all_paths(block, known, letters), key=lambda p: (round(sum(map(weight, p)), 9), [len(w) for w in reversed(p)]))
        out += [w for w in best if len(w) >= shortest]
    return out


def test_best_paths_equal_brute_force_in_one_shard_and_in_many(spark):
    draw = random.Random(5)
    known = {"天地": 7, "地玄": 11, "天地玄": 2, "玄黄": 5, "黄a1": 3, "a1": 2, "宇": 4, "地玄黄": 6, "b": 1, "a": 9}
    rows = ["".join(draw.choice("天地玄黄宇a1b ，") for _ in range(draw.randrange(14))) for _ in range(150)]
    table = spark.createDataFrame(list(known.items()), "word string, n bigint")
    for shard in (200_000, 4):
        got = {r.id: r.terms for r in S.segment(texts(spark, *rows), table, shard=shard).collect()}
        assert [got[k] for k in range(len(rows))] == [brute(t, known, S.HAN) for t in rows]


def test_odd_rows_keep_their_place(spark):
    rows = texts(spark, None, "", " ，\n", "Plain words 42x", "天" * 200_000, "天地天地").union(spark.createDataFrame([(None, "天地")], "id int, text string"))
    got = {r.id: r.terms for r in S.segment(rows, words(spark, 天地=3)).collect()}
    assert got == {0: [], 1: [], 2: [], 3: ["plain", "words", "42x"], 4: [], 5: ["天地", "天地"], None: ["天地"]}
    none = spark.createDataFrame([], "word string, n bigint")
    assert [r.terms for r in S.segment(texts(spark, "天地 ab"), none).collect()] == [["ab"]]
    assert S.segment(texts(spark, "x").limit(0), words(spark, 天地=3)).count() == 0
    assert S.learn_words(texts(spark, None, "", "abc")).count() == 0


def test_other_units_are_not_cut(spark):
    got = S.segment(texts(spark, "catalog 天cat地 abcat"), words(spark, cat=1000, 天cat=10)).first().terms
    assert got == ["catalog", "天cat", "abcat"]


def test_learned_words_equal_counts_by_hand(spark):
    draw = random.Random(9)
    rows = ["".join(draw.choice(["葡萄", "美酒", "夜光", "杯", "我", "他"]) for _ in range(draw.randrange(30))) for _ in range(60)]
    longest, least = 3, 4
    grams = Counter(t[i : i + k] for t in rows for k in range(1, longest + 2) for i in range(len(t) - k + 1))
    every = sum(n for g, n in grams.items() if len(g) == 1)

    def entropy(w, before):
        beside = Counter()
        for t in rows:
            for m in regex.finditer(w, t, overlapped=True):
                at = m.start() - 1 if before else m.end()
                beside[t[at] if 0 <= at < len(t) else ""] += 1
        return -sum(n / grams[w] * math.log(n / grams[w]) for n in beside.values())

    want = {w: (n, min(n * every / (grams[w[:k]] * grams[w[k:]]) for k in range(1, len(w))), entropy(w, True), entropy(w, False)) for w, n in grams.items() if 2 <= len(w) <= longest and n >= least}
    learned = S.learn_words(texts(spark, *rows), longest=longest, min_count=least)
    got = {r.word: r[1:] for r in learned.collect()}
    assert got.keys() == want.keys() and len(want) > 20
    assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for w in want for a, b in zip(got[w], want[w]))
    assert {r.word for r in S.likely_words(learned, 4.0, 1.0).collect()} == {"葡萄", "美酒", "夜光"}


def test_counts_do_not_depend_on_when_a_task_hands_them_on(spark, monkeypatch):
    rows = texts(spark, "天地玄黄" * 50, "宇宙洪荒" * 30)
    whole = sorted(map(tuple, S.gram_counts(rows, longest=3).collect()))
    monkeypatch.setattr(S, "COUNTED", 3)
    monkeypatch.setattr(S, "STRETCH", 7)
    few = S.gram_counts(rows, longest=3)
    assert sorted(map(tuple, few.collect())) == whole


def test_a_sorting_counts_strings_of_every_length_for_small_and_large_alphabets():
    draw = random.Random(7)
    for alphabet, longest in ((3, 6), (40, 6), (5000, 5), (5000, 9), (70_000, 7), (1, 70)):
        text = "".join(chr(0x10000 + draw.randrange(alphabet)) if draw.random() < 0.97 else "\n" for _ in range(3000)) * 2
        codes = S._letters(text)
        codes[codes == 10] = 0
        got = Counter()
        for grams, n in S._prefixes(codes, S.np.flatnonzero(codes), longest):
            assert len(set(grams.tolist())) == len(grams)
            got.update(dict(zip(grams.tolist(), n.tolist())))
        assert got == Counter(t[i : i + k] for t in text.split("\n") for k in range(1, longest + 1) for i in range(len(t) - k + 1))


def test_a_task_hands_on_a_row_for_each_string_of_a_lot(spark):
    plan = S.gram_counts(texts(spark, "天地玄黄" * 50), longest=3)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan, plan  # a text is one row for Python, not one for each run


def test_user_words_of_an_exported_dictionary(spark):
    lines = spark.createDataFrame([("丽莎 999999 nr",), ("Sir Bob 12 nr",), ("broken",), ("x 99999999999999999999999 nr",), (None,)], "entry string")
    assert sorted(map(tuple, S.user_words(lines).collect())) == [("sir bob", 12), ("丽莎", 999999)]
    both = S.dictionary(S.user_words(lines), words(spark, 丽莎=5, 玛丽=3))
    assert sorted(map(tuple, both.collect())) == [("sir bob", 12), ("丽莎", 999999), ("玛丽", 3)]


def test_a_planted_word_is_one_term_and_is_found(spark):
    rows = texts(spark, "昨天蒙德城的图书管理员来了", "蒙德的城里没有图书", "管理员去了别处")
    name = "蒙德城"
    known = S.user_words(spark.createDataFrame([(f"{name} 999999 nr",)], "entry string"))
    assert name in S.segment(rows, known).filter("id = 0").first().terms
    ix = bm25.index(rows, "id", "text", False, S.cutter(known))
    hits = bm25.search(ix, texts(spark, f"去{name}吗"), "id", "text")[0].collect()
    assert [r.id for r in hits] == [0] and hits[0].score > 0


def test_words_that_no_block_holds_are_in_no_trie_but_are_uses(spark, monkeypatch):
    tries, keep = [], S._trie
    monkeypatch.setattr(S, "_trie", lambda names, weights: tries.append(sorted(names)) or keep(names, weights))
    signs = spark.range(300).selectExpr("concat('customer#', id) AS word", "9L AS n")
    known = words(spark, 天地=7, 地玄黄=3).union(signs)
    got = S.segment(texts(spark, "天地玄黄 customer#7"), known, shard=100).first().terms
    assert got == brute("天地玄黄 customer#7", {"天地": 7, "地玄黄": 3, "customer#": 2700}, S.HAN)
    assert tries == [["地玄黄", "天地"]]


def test_shards_follow_one_another_in_stages_of_their_own(spark):
    known = words(spark, 天地=7, 地玄=11, 天地玄=2, 玄黄=5, 宇宙=4, 洪荒=2)
    plan = S.segment(texts(spark, "天地玄黄宇宙洪荒"), known, shard=4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1, plan  # chained, each shard's trie would be held beside the others'


def test_an_index_by_many_shards_finds_the_same_and_holds_one_trie_at_a_time(spark, monkeypatch):
    labels, keep = [], S.written
    monkeypatch.setattr(S, "written", lambda df, label: labels.append(label) or keep(df, label))
    known, rows = words(spark, 天地=7, 地玄=11, 玄黄=5, 宇宙=4, 洪荒=2), texts(spark, "天地玄黄", "宇宙洪荒", "地玄宇宙")

    def hits(shard):
        ix = bm25.index(rows, "id", "text", False, S.cutter(known, shard=shard))
        return sorted((r.q, r.id, round(r.score, 9)) for r in bm25.search(ix, rows, "id", "text")[0].collect())

    want = hits(1000)
    assert len(want) == 5 and not labels
    assert hits(4) == want and labels == ["lattice"] * 2  # of the documents and of the questions


def steps_of(monkeypatch, rows, known, shard=S.WORDS):
    """The steps that ``segment`` gives to tasks, as one function from a text to its terms."""
    steps, keep = [], type(rows).mapInArrow
    with monkeypatch.context() as m:
        m.setattr(type(rows), "mapInArrow", lambda self, f, schema: steps.append(f) or keep(self, f, schema))
        S.segment(rows, known, shard=shard)
    none = [pa.array([[]], pa.list_(t)) for t in (pa.int32(), pa.int32(), pa.float64())]

    def terms(text):
        batches = [pa.RecordBatch.from_arrays([pa.array([7]), pa.array([text]), *none], names=["id", "s", "ends", "sizes", "weights"])]
        for f in steps:
            batches = list(f(iter(batches)))
        return batches[0].column(1)[0]

    return terms


def test_a_long_text_goes_in_pieces_and_has_the_same_terms(spark, monkeypatch):
    draw = random.Random(11)
    known = words(spark, 天地=7, 地玄=11, 天地玄=2, 玄黄=5, 黄a1=3, 宇=4, 地玄黄=6)
    one, many = (steps_of(monkeypatch, texts(spark, "x"), known, shard) for shard in (1000, 4))
    for text in ("", "\n", "天地玄黄", *["".join(draw.choice("天地玄黄宇a1b" + "\n" * (k % 4)) for _ in range(300)) for k in range(12)]):
        want = one(text).as_py()
        assert want == [t for b in text.split("\n") for t in one(b).as_py()]
        with monkeypatch.context() as m:
            m.setattr(S, "STRETCH", 20)
            assert one(text).as_py() == many(text).as_py() == want
            pieces = list(S._pieces(text))
        assert "".join(p for _, p in pieces) == text and all(text[b:].startswith(p) for b, p in pieces)
        assert all(len(p) <= 20 or "\n" not in p[:-1] for _, p in pieces)


def test_what_a_task_holds_does_not_grow_with_a_text(spark, monkeypatch):
    draw = random.Random(12)
    block = "".join(draw.choice("天地玄黄宇宙") for _ in range(999)) + "\n"
    one = steps_of(monkeypatch, texts(spark, "x"), words(spark, 天地=7, 地玄=11, 玄黄=5, 宇宙=4))
    one(block)

    def most(blocks):
        tracemalloc.start()
        one(block * blocks)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return peak

    assert most(160) < 2 * most(20)


def test_trie_holds_its_words_in_two_arrays():
    draw = random.Random(3)
    known = {"".join(draw.choice("ab天\U0001f600") for _ in range(draw.randrange(1, 7))): draw.random() for _ in range(300)}
    trie = S._trie(list(known), S.np.array(list(known.values())))
    text = "".join(draw.choice("ab天\U0001f600c") for _ in range(25_000))
    got = sorted((int(e), int(k), float(w)) for part in S._met(text, *trie) for e, k, w in zip(*part))
    assert got == sorted((i + k, k, known[text[i : i + k]]) for i in range(len(text)) for k in range(1, 7) if text[i : i + k] in known and i + k <= len(text))
    assert sum(a.nbytes for a in trie) <= 16 * len({w[:k] for w in known for k in range(1, 7)})


def test_query_equals_brute_force(spark, sf_dir):
    """The query's segmentation of whole documents, against a plain search over positions from the end."""
    known = {r.word: r.n for r in Q._dictionary(spark, sf_dir).collect()}
    total, longest = sum(known.values()), max(map(len, known))
    floor = -math.log(total)

    def cut(block):
        best = [(0.0, 0)]  # sum, length of the last word
        for e in range(1, len(block) + 1):
            options = [(best[e - k][0] + math.log(known[w] / total), k) for k in range(1, min(e, longest) + 1) if (w := block[e - k : e]) in known]
            best.append(max([*options, (best[e - 1][0] + floor, 1)]))
        out, e = [], len(block)
        while e:
            out.append(block[e - best[e][1] : e])
            e -= best[e][1]
        return out[::-1]

    got = {r.id: r.terms for r in S.segment(Q._unbroken(Q.docs(spark, sf_dir)), Q._dictionary(spark, sf_dir), "doc_id", letters=Q._LETTERS).collect()}
    rows = Q._unbroken(Q.docs(spark, sf_dir)).collect()
    assert len(got) == len(rows) and sum(map(len, got.values())) > 1000
    for r in rows:
        units = [u for b in regex.findall(r"[\p{L}\p{N}]+", r.text or "") for u in regex.findall(r"\p{L}+|[^\p{L}]+", b)]
        want = [w for u in units for w in (cut(u) if u[0].isalpha() else [u]) if len(w) >= 2]
        assert got[r.doc_id] == want, r.doc_id
    assert Q.tokenize_dict(spark, sf_dir).agg(F.sum("n")).first()[0] == sum(map(len, got.values()))

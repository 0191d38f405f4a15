import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from sagaframe.llm import host_rules as H
from sagaframe.llm import mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


TEXTS = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x x x x", "l1 a\n\nl1 a\nl1 a \n", "#*$ %&|<> é 😀", "w " * 60, " ".join(map(str, range(70))), "\x0b\x0c a\r\nb\r\n a\r\n"]


def test_counts(spark):
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice("abcd") for _ in range(rng.randrange(80))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in H.document_counts(docs).collect()}
    assert got == {k: plain_counts(t) for k, t in enumerate(texts)}


def test_hosts(spark):
    good = " ".join(map(str, range(60)))
    rows = [(k, "bad", good if k < 3 else "x") for k in range(30)] + [(100 + k, "fine", good if k else "x") for k in range(30)] + [(200, None, good), (201, "", good)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r.kept for r in H.quality_rules(docs).collect()}
    assert not any(got[k] for k in range(30))
    assert [got[100 + k] for k in range(30)] == [False] + [True] * 29
    assert got[200] and got[201]
    assert H.quality_rules(docs.filter("false")).count() == 0
    clash = docs.withColumn("host_rate", F.lit("x")).withColumn("n_words", F.lit(None))
    assert {r.doc_id: r.kept for r in H.quality_rules(clash).collect()} == got


def test_host_rate_is_shrunk(spark):
    checked = spark.createDataFrame([("a", True)] + [("b", k < 5) for k in range(10)] + [("c", k < 1) for k in range(10)], "source string, base_failed boolean")
    rates = {r.source: r.host_rate for r in H.host_verdicts(checked, "source").collect()}
    assert rates["a"] < 1 and abs(rates["b"] - 0.5) < 0.1 and rates["c"] > 0.1


def plain_copies(rate, u):
    term, total, k = math.exp(-rate), math.exp(-rate), 0
    while total < u and k < 10_000:
        k += 1
        term *= rate / k
        total += term
    return k


def test_mixing_matches_brute_force(spark):
    rng = random.Random(5)
    rows = [(k, "big" if k % 3 == 0 else f"s{k % 7}", "x" * rng.randrange(1, 200)) for k in range(400)] + [(500, None, None), (None, "s1", "abc"), (7, "s0", "again")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    size = {}
    for _, s, t in rows:
        size[s] = size.get(s, 0) + len(t or "") + 1
    for weights in (None, {"big": 1.0, "s1": 3.0}):
        w = {s: (v**0.7 if weights is None else weights.get(s, 0.0)) for s, v in size.items()}
        rate = {s: w[s] * sum(size.values()) / sum(w.values()) / size[s] for s in size}
        want = {}
        for k, s, t in rows:
            u = (int(hashlib.md5(f"17:{'null' if k is None else k}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            n = plain_copies(rate[s], u) if rate[s] > 0 else 0
            for c in range(1, n + 1):
                want[k, s, t, c] = want.get((k, s, t, c), 0) + 1
        got = {}
        for r in M.mix_sources(docs, weights=weights).collect():
            key = r.doc_id, r.source, r.text, r.copy
            got[key] = got.get(key, 0) + 1
        assert got == want


def test_mixing_reaches_its_weights_and_large_means(spark):
    rows = [(k, "a" if k % 4 else "b", "xxxx") for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mixed = M.mix_sources(docs, weights={"a": 1.0, "b": 1.0}).groupBy("source").count().collect()
    share = {r["source"]: r["count"] for r in mixed}
    assert abs(share["a"] - 2000) < 200 and abs(share["b"] - 2000) < 200
    few = spark.createDataFrame([(1, "small", "x")] + [(k, "large", "x" * 99) for k in range(2, 102)], "doc_id long, source string, text string")
    n = M.mix_sources(few, weights={"small": 1.0}).count()
    assert abs(n - 5001) < 500  # the first term of this distribution underflows
    assert M.mix_sources(docs.filter("false")).count() == 0

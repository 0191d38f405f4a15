import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sagaframe.llm import exact_dedup as X
from sagaframe.llm import substring_dedup as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_exact_query_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    groups = {}
    for r in docs:
        groups.setdefault(r.text, []).append(r.doc_id)
    want = {(r.doc_id, max(g := groups[r.text]), len(g), r.doc_id == max(g), hashlib.sha256(r.text.encode()).hexdigest()) for r in docs}
    got = X.op8_exact_dedup(spark, sf_dir).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(docs)


@pytest.mark.parametrize("digest", [None, lambda c: F.length(c).cast("string"), lambda c: F.lit("same")])
def test_texts_are_compared_whatever_the_digest(spark, digest):
    rng = random.Random(2)
    rows = [(k, "".join(rng.choice("ab") for _ in range(rng.randrange(4)))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    keep = {}
    for k, t in rows:
        keep[t] = max(keep.get(t, -1), k)
    got = X.exact_dedup(docs, block_bits=3, digest=digest).collect()
    assert {(r.doc_id, r.keep_id) for r in got} == {(k, keep[t]) for k, t in rows}
    assert all(r.group_size == sum(t == r.text for _, t in rows) for r in got)


def test_exact_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 6), (None, "x", 7), (None, "x", 7), (3, "x ", 8), (4, "y" * 200_000, 9), (5, "y" * 200_000, 1), (5, "y" * 200_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_id int")
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in X.exact_dedup(docs).collect()), key=repr)
    assert got == sorted([(1, 2, 2, False), (2, 2, 2, True), (None, None, 2, True), (None, None, 2, True), (3, 3, 1, True), (4, 5, 3, False), (5, 5, 3, True), (5, 5, 3, True)], key=repr)
    kept = X.drop_copies(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([2, None, None, 3, 5, 5], key=repr)
    assert X.exact_dedup(docs.filter("false")).count() == 0


def test_hot_text_is_spread_over_salts(spark):
    rows = spark.range(0, 60_000, 1, 6).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 5000)).alias("text"))
    salted = X.salted_groups(rows, block_bits=10)
    assert salted.filter("__text = 'hot'").count() >= 60 and salted.agg(F.max(F.size("__rows"))).first()[0] <= 1024
    got = X.exact_dedup(rows, block_bits=10)
    assert got.count() == 60_000 and got.filter("text = 'hot'").select("keep_id", "group_size").distinct().collect() == [(59_997, 20_000)]
    assert X.drop_copies(rows).count() == got.filter("kept").count() == 1 + rows.filter("text <> 'hot'").select("text").distinct().count()


def plain_cut(rows, window):
    """rows: (id, text), judged on the input in order of id."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for p in range(len(words) - window + 1):
            g = tuple(words[p : p + window])
            if g in seen:
                gone[p : p + window] = [True] * window
            seen.add(g)
        out[i] = " ".join(w for w, x in zip(words, gone) if not x), len(words), sum(gone)
    return out


def test_substring_matches_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    passages = [[rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(rng.randrange(5, 60))] for _ in range(8)]
    rows = []
    for k in range(150):
        words = []
        for _ in range(rng.randrange(0, 6)):
            words += rng.choice(passages) if rng.random() < 0.5 else [rng.choice("xyz") + str(rng.randrange(400)) for _ in range(rng.randrange(30))]
        rows.append((k, rng.choice([" ", "\n", "\t "]).join(words)))
    rows += [(200, "z " * 300), (201, "z " * 25), (202, "a b " * 60)]
    monkeypatch.setattr(S, "CHUNK_WORDS", 50)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for window, seed in ((20, 5), (6, 2), (5, 5)):
        want = plain_cut(rows, window)
        got = {r.doc_id: (r.kept, r.n_words, r.n_removed) for r in S.remove_repeats(docs, window=window, seed=seed).collect()}
        assert got == want


def test_spans_are_maximal(spark):
    a = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(1, " ".join(a)), (2, "x y " + " ".join(a[10:50]) + " q")], "doc_id long, text string")
    spans = S.repeated_spans(S.repeated_paths(docs)).collect()
    assert [(r.doc, r.start, r.end, r.src_doc, r.src_start) for r in spans] == [(2, 2, 42, 1, 10)]


def test_substring_query_and_odd_rows(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = plain_cut(docs, 20)
    got = S.op3_substring_dedup(spark, sf_dir).collect()
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got} == {(i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, (t, n, m) in want.items()}
    text = " ".join(f"w{k}" for k in range(30))
    rows = spark.createDataFrame([(None, text, 1), (1, text, 2), (1, text, 2), (2, None, 3), (3, "", 4), (4, "one", 5)], "doc_id long, text string, start int")
    out = sorted(((r.doc_id, r.n_words, r.n_removed) for r in S.remove_repeats(rows).collect()), key=repr)
    assert out == sorted([(None, 30, 0), (1, 30, 0), (1, 30, 0), (2, 0, 0), (3, 0, 0), (4, 1, 0)], key=repr)
    assert S.remove_repeats(rows.filter("false")).count() == 0


def hashes(words):
    return np.array([xxhash.xxh3_64_intdigest(w.encode()) for w in words], dtype=np.uint64)


def windows_that_collide():
    """Two windows that differ in words, with one seed at one offset and 40 equal bits of the window's hash."""
    rng = random.Random(5)
    phrase = min(([f"p{rng.randrange(10**6)}" for _ in range(S.SEED)] for _ in range(4000)), key=lambda p: int(S._run_hashes(hashes(p), S.SEED, 0)[0]))
    start = [f"s{k}" for k in range(S.WINDOW - S.SEED - 2)] + phrase
    n = 2500
    left, right = [f"a{k}" for k in range(n)], [f"b{k}" for k in range(n)]
    m = S._MULTIPLIERS[S.SEED : S.SEED + S.WINDOW]
    base = (hashes(start) * m[: S.WINDOW - 2]).sum(dtype=np.uint64)
    acc = (base + hashes(left) * m[-2])[:, None] + (hashes(right) * m[-1])[None, :]
    acc ^= acc >> np.uint64(32)
    acc *= np.uint64(0x9E3779B97F4A7C15)
    low = ((acc ^ (acc >> np.uint64(29))) & np.uint64(2**40 - 1)).ravel()
    order = np.argsort(low)
    for k in np.flatnonzero(low[order[1:]] == low[order[:-1]]):
        a, b = (start + [left[x // n], right[x % n]] for x in (int(order[k]), int(order[k + 1])))
        found = [S.super_edges(hashes(w), np.array([S.WINDOW]), S.WINDOW, S.SEED, None, 5) for w in (a, b)]
        if a != b and found[0][0][0] == found[1][0][0] and bytes(found[0][5][:6]) == bytes(found[1][5][:6]):
            return a, b
    raise AssertionError("no collision found")


def test_windows_of_one_hash_are_told_apart(spark):
    a, b = windows_that_collide()
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(["x", *b, "y"])), (4, " ".join(["z", *a]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.kept, r.n_words, r.n_removed) for r in S.remove_repeats(docs, hash_bytes=5).collect()}
    assert got == plain_cut(rows, S.WINDOW) and got[2][2] == 0 and got[3][2] == S.WINDOW


@pytest.mark.parametrize("hash_bytes", [1, 2])
def test_weak_hashes_change_no_result(spark, hash_bytes):
    """By 8 or 16 bits many windows with one seed are taken for equal; their words tell them apart."""
    rng = random.Random(11)
    phrases = [[f"p{rng.randrange(10**6)}" for _ in range(6)] for _ in range(3)]
    rows = [(k, " ".join([f"a{rng.randrange(4)}" for _ in range(20)] + rng.choice(phrases) + [f"b{rng.randrange(40)}" for _ in range(20)])) for k in range(60)]
    rows += [(k + 100, rows[rng.randrange(60)][1] + " end") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.kept, r.n_words, r.n_removed) for r in S.remove_repeats(docs, hash_bytes=hash_bytes).collect()}
    assert got == plain_cut(rows, S.WINDOW)


def test_ids_must_be_integers(spark):
    with pytest.raises(TypeError):
        S.remove_repeats(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_look_up_in_several_passes(spark):
    rows = [(k, " ".join(f"w{j}" for j in range(k % 3, 40 + k % 3))) for k in range(6)]
    raw = spark.createDataFrame(rows, "__id long, __text string").selectExpr("__id", "cast(__text AS binary) AS __text")
    every = spark.createDataFrame([(k, 0, 40) for k in range(6)], "doc long, start int, end int")
    seen, want = set(), set()
    for k, t in rows:
        words = t.split()
        for p in range(21):
            g = tuple(words[p : p + 20])
            want |= {(k, p, p + 20)} if g in seen else set()
            seen.add(g)
    assert {(r.doc, r.start, r.end) for r in S.looked_up(every, raw, 20, 5, at_once=7).collect()} == want


def test_hot_seeds_are_split(spark):
    rng = random.Random(7)
    phrase = min(([f"p{rng.randrange(10**6)}" for _ in range(S.SEED)] for _ in range(4000)), key=lambda p: int(S._run_hashes(hashes(p), S.SEED, 0)[0]))
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = [(k, " ".join([word() for _ in range(30)] + phrase + [word() for _ in range(30)])) for k in range(300)]
    rows += [(k + 300, " ".join(["x"] + rows[k][1].split()[10:50] + ["y"])) for k in range(0, 300, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    raw = docs.selectExpr("doc_id", "cast(text AS binary) AS text")
    most = lambda paths: paths.filter(F.substring("path", 1, 1) != F.unhex(F.lit("FF"))).groupBy("seed").agg(F.sum((F.length("path") - 1) / S.HASH_BYTES).alias("n")).agg(F.max("n")).first()[0]
    assert most(S.edge_paths(raw, 20, 5)) > 100  # some seed keeps its edges together
    assert most(S.edge_paths(raw, 20, 5, hot_edges=50, counted=1)) < 50
    want = plain_cut(rows, 20)
    gone = lambda paths: {(r.doc, p) for r in paths.collect() for p in range(r.start, r.end)}
    split = gone(S.repeated_paths(docs, hot_edges=50, counted=1))
    assert split == gone(S.repeated_paths(docs)) and len(split) == sum(n for _, _, n in want.values())

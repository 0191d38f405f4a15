import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from sagaframe.llm import simhash as S
from sagaframe.llm.components import components


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(rows):
    """rows: (id, fingerprint) -> {id: smallest id reachable}."""
    up = {f: f for _, f in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    fps = sorted(up)
    arr = np.array(fps, dtype=np.uint64)
    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= 4):
            up[find(f)] = find(fps[i + 1 + int(j)])
    least = {}
    for i, f in rows:
        r = find(f)
        least[r] = min(least.get(r, i), i)
    return {i: least[find(f)] for i, f in rows}


def test_fingerprint_matches_the_plain_one():
    rng = random.Random(1)
    texts = ["", " \t\n", "One", "a b c", "ÄB Äb\x0bx y z", "a b c d e f g", "x " * 3000]
    texts += [" ".join(rng.choice(["The", "of", "ä", "x1"]) for _ in range(rng.randrange(1, 700))) for _ in range(15)]
    assert [S.fingerprint(t.encode()) for t in texts] == [plain_fingerprint(t) for t in texts]
    assert S.fingerprint(None) == 0


def test_budgets_follow_the_blocks():
    for r in range(5):
        b = S.budgets(r)
        assert len(b) == 65 and b[64] == 4 and b[S.BLOCKS[r]] == 0 and b == sorted(b)


def clustered(n, seed):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        base = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            base ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 6)))
            out.add(base)
    return sorted(out)


def roots(spark, fps, max_node):
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    links = S.hamming_links(spark.createDataFrame(signed, "fp long"), max_node)
    return {r.node: r.root for r in components(links).collect()}


def test_trie_join_finds_what_brute_force_finds(spark):
    fps = clustered(600, 3) + [0, 2**64 - 1]
    fps += [0x1234567890ABCDEF ^ m for m in range(1, 200)]  # one crowded node
    for max_node in (S.MAX_NODE, 40, 7):
        got = roots(spark, sorted(set(fps)), max_node)
        want = plain_components([(f, f) for f in set(fps)])
        signed = lambda f: f - 2**64 if f >= 2**63 else f
        mine, theirs = {}, {}
        for f in set(fps):
            mine.setdefault(got.get(signed(f), signed(f)), set()).add(f)
            theirs.setdefault(want[f], set()).add(f)
        assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_query_matches_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    fps = [(i, plain_fingerprint(t)) for i, t in docs]
    want = plain_components(fps)
    got = S.op2_simhash_near_dedup(spark, sf_dir).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{f:016x}", want[i]) for i, f in fps}
    assert len(got) == len(docs)


def test_odd_rows(spark):
    rows = [(3, None, 1), (1, "", 2), (None, " ", 3), (7, "word", 4), (7, "word", 4), (None, "other words here", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(docs).collect()), key=repr)
    zero = "0" * 16
    assert [x for x in got if x[1] == zero] == sorted([(1, zero, 1), (3, zero, 1), (None, zero, 1)], key=repr)
    assert sum(x[0] == 7 and x[2] == 7 for x in got) == 2
    assert [x[2] for x in got if x[0] is None and x[1] != zero] == [None]
    kept = S.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 7, 7, None, None], key=repr)
    assert S.near_duplicates(docs.filter("false")).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in components(edges).collect()} == {0}
    assert components(edges.filter("false")).count() == 0

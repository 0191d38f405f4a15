import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sagaframe.llm import minhash as N

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))) if words else frozenset()


def plain_components(rows):
    """rows: (id, text), all ids given; for each row its (id, size, component, kept)."""
    sets = {}
    for ident, text in rows:
        sets.setdefault(plain_set(text), []).append(ident)
    classes = [s for s in sets if s]
    parent = {s: s for s in classes}

    def find(s):
        while parent[s] is not s:
            s = parent[s]
        return s

    classes.sort(key=len)
    for k, a in enumerate(classes):
        for b in classes[k + 1 :]:
            if 85 * len(b) > 100 * len(a):
                break
            i = len(a & b)
            if 100 * i >= 85 * (len(a) + len(b) - i):
                parent[find(a)] = find(b)
    least = {}
    for s in classes:
        least[find(s)] = min(least.get(find(s), sets[s][0]), *sets[s])
    out = []
    for ident, text in rows:
        s = plain_set(text)
        root = least[find(s)] if s else ident
        out.append((ident, len(s), root, root == ident))
    return sorted(out)


def test_minhash_query_matches_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in N.op11_minhash_near_dedup(spark, sf_dir).collect())
    assert got == plain_components(rows)
    assert any(not r[3] and r[1] for r in got)


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize(("small", "block"), [(32, 2048), (3, 2)])
def test_groups_passages_and_chains(spark, small, block):
    """A star of near copies, chains that only their neighbours link, a passage that many documents share, and borderline pairs."""
    rng = random.Random(small)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = []
    base = [word() for _ in range(120)]
    texts += [base] + [changed(rng, base, rng.randrange(1, 6)) for _ in range(60)]
    link = [word() for _ in range(100)]
    for _ in range(25):
        texts.append(link)
        link = changed(rng, link, 2)
    passage = [word() for _ in range(150)]
    texts += [passage + [word() for _ in range(rng.randrange(20, 60))] for _ in range(90)]
    for n in (7, 8, 20, 60):
        own = [word() for _ in range(n)]
        texts += [own, own[:-1], own + [word()], own[:-2] + [word()], own + own]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in N.near_duplicates(docs, small=small, block=block).collect())
    assert got == plain_components(rows)


def test_odd_rows(spark):
    """Nulls, empty and one-word texts, letters beyond ASCII, a very long text, repeated rows and ids, clashing columns, an empty table."""
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(120_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE\ttwo"), (8, "É é"), (9, "é é"), (10, long), (11, long + " End"), (12, "a b c a b c a"), (13, "a b c\x0ba\x0cb c"), (0, "a b c d"), (14, "a b c d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("cid", "key", "n", "m", "root", "digest", "kept", "component_id", "__id", "__text", "node", "rows"):
        docs = docs.withColumn(name, F.lit("x"))
    got = sorted(tuple(r) for r in N.near_duplicates(docs).collect())
    assert got == plain_components(rows) and got[11][2] == 10
    more = [(None, "one"), (None, long), (20, "one"), (20, "one"), (20, "p q r s"), (20, "p q r s")]
    both = spark.createDataFrame(rows + more, "doc_id long, text string")
    told = [tuple(r) for r in N.near_duplicates(both).collect()]
    assert len(told) == len(rows) + len(more)
    assert [r for r in told if r[0] is None and r[2] is None and r[3]] and sum(r[0] is None for r in told) == 2
    assert sorted(r for r in told if r[0] == 20) == [(20, 1, 4, False)] * 2 + [(20, 2, 20, True)] * 2
    assert N.near_duplicates(docs.filter("false")).count() == 0


def test_sketches_estimate_similarity():
    """Every coordinate is filled, few elements or many; agreements are the similarity, with a small spread."""
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 100, 5000):
        assert (N.sketch(rng.integers(0, 2**63, n, dtype=np.uint64)) != N._EMPTY).all()
    for n, extra in ((6, 1), (200, 30), (3000, 450)):
        agreed = []
        for _ in range(60):
            h = rng.integers(0, 2**63, n + extra, dtype=np.uint64)
            agreed.append((N.sketch(h) == N.sketch(h[:n])).mean())
        assert abs(np.mean(agreed) - n / (n + extra)) < 0.03 and np.std(agreed) < 0.05
    small, large = rng.integers(0, 2**63, 850, dtype=np.uint64), rng.integers(0, 2**63, 75, dtype=np.uint64)
    other = rng.integers(0, 2**63, 75, dtype=np.uint64)
    a, b = (np.frombuffer(N.fine_bits(np.concatenate((small, x))), dtype=np.uint64) for x in (large, other))
    assert N.LEAST_FINE < N._equal_bits(a, b) < 0.96 * N.FINE  # of a similarity of 0.85
    one, block = rng.integers(0, 2**63, 300, dtype=np.uint64), N.CHUNK_HASHES
    want = N.sketch(one)
    try:
        N.CHUNK_HASHES = 0  # round by round
        assert (N.sketch(one) == want).all()
    finally:
        N.CHUNK_HASHES = block

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sagaframe.llm import manifest as M


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def plain_tree(digests, fan):
    """The root, and for each leaf its siblings from the lowest level up as (before, after)."""
    paths, at, nodes = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = i // fan * fan
            paths[k].append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + fan])))
        nodes, at = [H(*nodes[i : i + fan]) for i in range(0, len(nodes), fan)], [i // fan for i in at]
    return nodes[0], paths


def plain_manifest(rows, fan=8, seen=lambda row: None):
    """rows: (doc_id, source, lang, n_chars, text)."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r))) for g in langs}
    trees = {g: plain_tree([plain_leaf(r) for r in groups[g]], fan) for g in langs}
    root, tops = plain_tree([trees[g][0] for g in langs], fan)
    out = []
    for k, g in enumerate(langs):
        for row, path in zip(groups[g], trees[g][1]):
            acc = seen(row) or plain_leaf(row)
            for before, after in path + tops[k]:
                acc = H(before, acc, after)
            out.append((row[0], plain_leaf(row), trees[g][0], root, H(*[x for p in path + tops[k] for x in p]), acc, acc == root))
    return sorted(out, key=repr)


def lowered(row):
    if row[0] is None or zlib.crc32(str(row[0]).encode()) % 3:
        return None
    return plain_leaf((*row[:4], row[4] and "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])))


KIND = "doc_id long, source string, lang string, n_chars long, text string"


def test_manifest_query_matches_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(*M.FIELDS).collect()]
    got = sorted((tuple(r) for r in M.op13_merkle_manifest(spark, sf_dir).collect()), key=repr)
    assert got == plain_manifest(rows, seen=lowered)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize(("sizes", "fan"), [([1], 8), ([8, 9, 1, 64, 65], 8), ([9, 1, 2, 3, 4, 5], 2)])
def test_trees_of_all_sizes(spark, sizes, fan):
    rng = random.Random(sum(sizes))
    rows = [(k, None, f"l{g:02}", k, f"Text {k}") for k, g in enumerate(g for g, n in enumerate(sizes) for _ in range(n))]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, KIND).repartition(3)
    got = M.manifest(docs, fan=fan).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_manifest(rows, fan) and all(r.verified for r in got)


def test_a_change_shows_in_its_row_alone(spark):
    rows = [(k, "s", "x", 1, "t") for k in range(70)]
    docs = spark.createDataFrame(rows, KIND)
    got = M.manifest(docs, seen=F.when(F.col("doc_id") == 13, F.sha2(F.lit("other"), 256))).collect()
    assert {r.doc_id for r in got if not r.verified} == {13}


def test_odd_rows(spark):
    """Null fields, repeated rows and ids, null ids, an empty and a very long text, langs that differ only after ASCII, clashing columns."""
    rows = [(1, None, None, None, None), (1, None, None, None, None), (1, "a", None, 0, ""), (None, "", "é", 2, "A"), (None, "", "é", 3, "A"), (2, "s", "z", 1, "Ab " * 700_000), (3, "s", "", 1, "x"), (0, "s", "-", 1, "é")]
    docs = spark.createDataFrame(rows, KIND)
    want = plain_manifest(rows)
    assert sorted((tuple(r) for r in M.manifest(docs).collect()), key=repr) == want
    for name in ("tree", "id", "digest", "seen", "lo", "hi", "n", "path", "leaf", "root", "children", "bucket", "own", "__at", "name", "size"):
        docs = docs.withColumn(name, F.lit(1))
    assert sorted((tuple(r) for r in M.manifest(docs).collect()), key=repr) == want
    empty = M.manifest(docs.filter("false"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

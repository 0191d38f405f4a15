import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sagaframe.llm import resampling as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, longest=1):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain_resample(rows, target, percent=10, min_words=20, buckets=10_000, longest=1):
    """rows: (id, text); ids are unique."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, (x for _, x in rows)), (t, target)):
        for text in texts:
            for f in plain_features(text, longest)[1]:
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (sum(s) + 10_000.0) / ((s[b] + 1.0) * (sum(t) + 10_000.0)))) for b in range(buckets)]
    out, able = {}, []
    for ident, text in rows:
        words, found = plain_features(text, longest)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'null' if ident is None else ident}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[ident] = [len(found), weight, score, None]
        if len(words) >= min_words:
            able.append((-score, ident is not None, ident))
    for k, (_, _, ident) in enumerate(sorted(able)[: len(able) * percent // 100]):
        out[ident][3] = k + 1
    return out


def told(df):
    rows = df.collect()
    return {r[0]: list(r[1:]) for r in rows}, len(rows)


def test_resampling_query_matches_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got, n = told(R.op12_importance_resampling(spark, sf_dir))
    assert got == plain_resample(docs, target) and n == len(docs)
    assert sum(v[3] is not None for v in got.values()) > 5


def test_runs_of_words_ties_and_odd_rows(spark):
    """Null and empty texts and ids, texts without a word, a very long text, letters beyond ASCII, clashing columns."""
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(["Ab", "c-d", "É", "x9", "語", "e"]) for _ in range(rng.randrange(40)))) for k in range(60)]
    rows += [(None, "a " * 30), (100, None), (101, ""), (102, "--- \x00 ?"), (103, "Wörd A1 " * 120_000), (-5, "b " * 25)]
    target = ["c d É é", None, "x9 x9"]
    docs, aim = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string")
    for name in ("id", "score", "weight", "rank", "at", "digit", "block", "row", "key0", "n", "n_words", "n_features"):
        docs = docs.withColumn(name, F.lit("x"))
    for longest in (1, 3):
        got, _ = told(R.resample(docs, aim, percent=60, longest=longest, buckets=97))
        assert got == plain_resample(rows, target, percent=60, longest=longest, buckets=97)
    empty = R.resample(docs.filter("false"), aim)
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    twice = R.resample(docs.unionByName(docs), aim.filter("false"), percent=100, buckets=97)
    ranks = [r["rank"] for r in twice.filter("rank IS NOT NULL").collect()]
    assert twice.count() == 2 * len(rows) and sorted(ranks) == list(range(1, len(ranks) + 1))


@pytest.mark.parametrize("bits", [3, 12])
def test_radix_ranks(spark, bits):
    rng = random.Random(bits)
    rows = [(rng.choice([None, *range(-40, 41)]), rng.choice([None, 0, 5, 2**40, -(2**40)]), k) for k in range(500)]
    df = spark.createDataFrame(rows, "a long, b long, k int").repartition(7)
    got = R.radix_ranks(df, [("a", True), ("b", False)], digit_bits=bits).orderBy("rank").collect()
    order = lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or 0)
    assert [order(r) for r in got] == sorted(order(r) for r in rows)
    assert [r["rank"] for r in got] == list(range(1, 501)) and sorted(r.k for r in got) == list(range(500))


def test_a_pass_is_stable(spark):
    rows = spark.range(200_000).select((F.col("id") % 7).alias("d"), F.col("id").alias("at"), F.col("id").alias("old"))
    got = R._pass(rows, F.col("d")).orderBy("at").collect()
    assert [r.at for r in got] == list(range(200_000))
    assert [r.old for r in got] == sorted(range(200_000), key=lambda x: x % 7)

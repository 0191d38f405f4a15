"""Importance resampling towards a target distribution.

Word runs fall into hashed buckets. The buckets' counts over the corpus and over the target texts
give an array of gains, one for each bucket, which is as long as a parameter says; a document's
weight is the mean of its features' gains. Gumbel noise that a hash of the id gives makes the
highest scores a sample without replacement.

Scores are ranked by a distributed LSD radix sort. The composite key (score falling, id rising)
is cut into digits. A pass counts the rows by digit and block (a block being the next
``BLOCK_BITS`` bits' worth of places); sums over the digits below, and over the blocks before
within a digit, tell where each block's rows of a digit go, and a row's place is that offset and
its place among those rows. Passes run from the last digit to the first, each is stable, and the
places after the last one are the ranks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc32_sql, materialize, table

BUCKETS, LONGEST, SMOOTHING, SEED = 10_000, 1, 10_000, 2024
MIN_WORDS, PERCENT = 20, 10
#: Bits of a digit at most, and of the places in a block.
DIGIT_BITS, BLOCK_BITS = 12, 15
#: Words whose checksums are remembered, and words that are taken at a time.
KNOWN_WORDS, WORDS_AT_ONCE = 300_000, 100_000

#: Small letters for A-Z, and a blank for every other ASCII character that is no letter or digit.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


class _Checksums(dict):
    """CRC-32 of words, forgotten all at once when they are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = zlib.crc32(word)
        return value


_checksums = _Checksums()


def features(raw: bytes | None, buckets: int = BUCKETS, longest: int = LONGEST) -> Iterator[tuple[int, np.ndarray]]:
    """Numbers of words of a UTF-8 text, some at a time, with the buckets of all runs of 1 to ``longest`` words that begin there."""
    words = (raw or b"").translate(_FOLD).split()
    for k in range(0, len(words), WORDS_AT_ONCE):
        part = words[k : k + WORDS_AT_ONCE]
        sums = [_checksums[w] for w in part]
        out = [np.array(sums, dtype=np.int64)]
        for size in range(2, longest + 1):
            run = words[k + size - 1 : k + size - 1 + WORDS_AT_ONCE]
            sums = [zlib.crc32(w, zlib.crc32(b" ", s)) for s, w in zip(sums, run)]
            out.append(np.array(sums, dtype=np.int64))
        yield len(part), np.concatenate(out) % buckets


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """``(bucket, n)`` over all texts; a task sends one row for each bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for raw in batch.column(0):
                for _, part in features(raw.as_py(), buckets, longest):
                    total += np.bincount(part, minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["bucket", "n"])

    return texts.select(F.col(text_col).cast("binary")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS, smoothing: int = SMOOTHING) -> np.ndarray:
    """Each bucket's gain, floor(1000 ln) of how much likelier it is in the target, from two tables ``(bucket, n)``."""
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    both = materialize(both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "counts")
    whole_s, whole_t = (float(x or 0) for x in both.agg(F.sum("s"), F.sum("t")).first())
    s, t = F.coalesce("s", F.lit(0)).cast("double"), F.coalesce("t", F.lit(0)).cast("double")
    ratio = (t + 1) * F.lit(whole_s + smoothing) / ((s + 1) * F.lit(whole_t + smoothing))
    rows = corpus.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(both, "bucket", "left").select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))
    out = np.zeros(buckets, dtype=np.int64)  # as many rows as the parameter says, whatever the input
    for bucket, gain in rows.collect():
        out[bucket] = gain
    return out


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str, longest: int = LONGEST) -> DataFrame:
    """``(id, n_words, n_features, weight)`` for every row; the weight is the mean gain, floored, and 0 without a feature."""
    shared, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = shared.value
        for batch in batches:
            rows = []
            for raw in batch.column(1):
                words = n = total = 0
                for some, part in features(raw.as_py(), buckets, longest):
                    words += some
                    n += len(part)
                    total += int(told[part].sum())
                rows.append((words, n, total // n if n else 0))
            columns = zip(*rows) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["id", "n_words", "n_features", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")


def _pass(rows: DataFrame, digit: Column) -> DataFrame:
    """One stable counting pass: ``at`` becomes each row's place in the order of ``digit``."""
    dealt = rows.withColumn("block", F.shiftright("at", BLOCK_BITS)).withColumn("digit", digit)
    counts = materialize(dealt.groupBy("block", "digit").agg(F.count(F.lit(1)).alias("n")), "histogram")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    digits = counts.groupBy("digit").agg(F.sum("n").alias("n"))  # a row for each value of a digit at most
    below = digits.select("digit", before(Window.orderBy("digit")).alias("below"))
    offsets = counts.withColumn("ahead", before(Window.partitionBy("digit").orderBy("block"))).join(F.broadcast(below), "digit")
    offsets = offsets.select("block", "digit", (F.col("below") + F.col("ahead")).alias("offset"))
    among = F.row_number().over(Window.partitionBy("block", "digit").orderBy("at")) - 1
    placed = dealt.withColumn("among", among).join(offsets, ["block", "digit"])
    return placed.select(*[c for c in rows.columns if c != "at"], (F.col("offset") + F.col("among")).alias("at"))


def radix_ranks(rows: DataFrame, keys: list[tuple[str, bool]], digit_bits: int = DIGIT_BITS) -> DataFrame:
    """Add ``rank``, from 1, in the order of integer columns ``keys`` (name, falling), the first one leading.

    Nulls come first where a key rises and last where it falls. Rows equal in all keys are ranked
    in the order in which they are read. Keys take as many passes as their range has digits."""
    ends = rows.agg(*[f(name).cast("decimal(20,0)") for name, _ in keys for f in (F.min, F.max)]).first()
    ends = [int(x or 0) for x in ends]
    lows, highs = ends[::2], ends[1::2]
    spans = [high - low + 1 for low, high in zip(lows, highs)]  # the key runs from 0, where null is, to this
    if max(spans) >= 2**62:
        raise ValueError("the keys' range is too wide")
    told = [(F.lit(high) - F.col(name) if falling else F.col(name) - F.lit(low) + 1) for (name, falling), low, high in zip(keys, lows, highs)]
    told = [F.coalesce(t, F.lit(span if falling else 0)).cast("long").alias(f"key{k}") for k, (t, span, (_, falling)) in enumerate(zip(told, spans, keys))]
    names = rows.columns
    laid = rows.select(F.struct(*names).alias("row"), *told, F.monotonically_increasing_id().alias("at"))
    laid = materialize(laid, "radix")
    for k in reversed(range(len(keys))):
        bits = spans[k].bit_length()
        passes = -(-bits // digit_bits)
        width = -(-bits // passes)
        for j in range(passes):
            laid = materialize(_pass(laid, F.shiftrightunsigned(f"key{k}", j * width).bitwiseAND(F.lit((1 << width) - 1))), "radix")
    return laid.select("row.*", (F.col("at") + 1).alias("rank"))


def noise(ident: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, floored, from the first 32 bits of a SHA-256."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), ident), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED
) -> DataFrame:
    """``(id, n_features, weight, score, rank)`` for every row of ``docs``; the rank is null where it is not drawn.

    Of the rows with at least ``min_words`` words, ``percent`` in a hundred (floored) are drawn, those
    of the highest scores, equal scores by the smaller id. Ids are integers. A null or empty text has
    no feature, the weight 0 and no rank; a null id is hashed as the word null and comes before
    other ids; rows that repeat an id and its score are ranked in any order among themselves. Texts
    may be of any length, further columns are ignored, an empty table gives no rows, and an empty
    target gives gains by the corpus alone.
    """
    corpus = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    gain = gains(bucket_counts(corpus, "text", buckets, longest), bucket_counts(target, target_col, buckets, longest), buckets)
    scored = weigh(corpus, gain, "id", "text", longest).withColumn("score", F.col("weight") + noise(F.coalesce(F.col("id").cast("string"), F.lit("null")), seed))
    scored = materialize(scored, "scored")
    able = scored.filter(F.col("n_words") >= min_words)
    drawn = able.count() * percent // 100
    ranked = radix_ranks(able.drop("n_words"), [("score", True), ("id", False)])
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.filter(F.col("n_words") < min_words).drop("n_words").withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op12_importance_resampling": op12_importance_resampling}

_CRC = crc32_sql("w")

ORACLES = {
    "op12_importance_resampling": rf"""
        WITH crc AS ({_CRC[0]}),
        lowered AS (SELECT doc_id, 0 AS which, text FROM documents UNION ALL SELECT item_id, 1, text FROM benchmark),
        word AS (SELECT doc_id, which, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS w FROM lowered),
        hashed AS (SELECT w, {_CRC[1]} % 10000 AS b FROM (SELECT DISTINCT w FROM word), crc),
        feature AS (SELECT doc_id, which, b FROM word JOIN hashed USING (w)),
        whole AS (SELECT count(*) FILTER (WHERE which = 0)::DOUBLE AS s_all, count(*) FILTER (WHERE which = 1)::DOUBLE AS t_all FROM feature),
        gain AS (SELECT b, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS g
                 FROM (SELECT b, count(*) FILTER (WHERE which = 0)::DOUBLE AS s, count(*) FILTER (WHERE which = 1)::DOUBLE AS t FROM feature GROUP BY b), whole),
        mean AS (SELECT doc_id, count(*) AS n, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM feature JOIN gain USING (b) WHERE which = 0 GROUP BY doc_id),
        scored AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
                          coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5) / 4294967296.0)))::BIGINT AS score
                   FROM documents d LEFT JOIN mean USING (doc_id)),
        ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
        SELECT s.doc_id, n_features, weight, score, r AS rank FROM scored s LEFT JOIN ranked k ON s.doc_id = k.doc_id AND r <= floor(10 * n / 100)
    """
}

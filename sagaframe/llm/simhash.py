"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are 64-bit majorities over the XXH64 values of word shingles. Links are pairs
of fingerprints that differ in at most ``MAX_BITS`` bits. They are found in a binary trie
that is joined with itself: a pair of nodes goes down together, the bits in which the two
paths differ add up, and the pair is dropped as soon as they exceed its budget.

The budget is staggered over five blocks of the fingerprint. Of four differing bits spread
over five cyclic blocks there is always a block to start from such that the first l blocks
together hold at most floor(4l/5) of them, for every l. So the trie is built five times,
each time with another block first, and the budget is 0 in the first block, then 1, 2, 3
and 4. The first block is what Spark partitions by; a node with more members than
``MAX_NODE`` is split at the second block (the node itself and its thirteen one-bit
neighbours), and what is still too large is split into blocks of rows that meet pairwise.

A task emits a spanning forest of the links of its nodes, not all pairs, so a group of n
near copies costs n rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_checked, join_spread, materialize, table
from .components import components

MAX_BITS = 4
BLOCKS = (13, 13, 13, 13, 12)
MAX_NODE = 50_000
#: Node pairs that are advanced together, and rows that are read before a join begins.
CHUNK_PAIRS, CHUNK_ROWS = 500_000, 100_000
#: Shingles hashed at a time, so that long texts need little memory.
CHUNK_SHINGLES = 255 * 200

_LANES = np.uint64(0x0101010101010101)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set: sums of 255 values fit a byte lane."""
    padded = np.zeros(-(-len(hashes) // 255) * 255, dtype=np.uint64)
    padded[: len(hashes)] = hashes
    rows = padded.reshape(-1, 255)
    counts = np.zeros(64, dtype=np.int64)
    for s in range(8):
        lanes = ((rows >> np.uint64(s)) & _LANES).sum(axis=1, dtype=np.uint64)
        counts[s::8] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return counts


def fingerprint(raw: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """Fingerprint of a UTF-8 text as an unsigned number; 0 if it has no word."""
    words = (raw or b"").lower().split()  # bytes: A-Z only, and exactly the six ASCII blanks
    if not words:
        return 0
    joined, n = b" ".join(words), max(len(words) - shingle + 1, 1)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    starts = starts[:n].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for k in range(0, n, CHUNK_SHINGLES):
        part = [digest(joined[a:b], seed) for a, b in zip(starts[k : k + CHUNK_SHINGLES], ends[k : k + CHUNK_SHINGLES])]
        counts += _bit_counts(np.array(part, dtype=np.uint64))
    return int(np.packbits((2 * counts > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(x.as_py()) for x in batch.column(1)], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["__id", "fp"])


def forest(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest reachable index of each of ``n`` nodes under the links (a, b), on top of ``label``."""
    label = np.arange(n) if label is None else label
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return label
        np.minimum.at(label, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while not np.array_equal(up := label[label], label):
            label = up


def budgets(rotation: int) -> list[int]:
    """Bits that may differ within the first d bits, for d = 0 to 64, in a rotation's order."""
    out = [0]
    for k in range(len(BLOCKS)):
        out += [MAX_BITS * (k + 1) // len(BLOCKS)] * BLOCKS[(rotation + k) % len(BLOCKS)]
    return out


def traverse(v: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int, differ: np.ndarray, budget: list[int]) -> np.ndarray:
    """Join trie nodes pairwise; the label of each value's component among the links found.

    ``v`` holds the values, sorted within each node; ``a`` and ``b`` are (pairs, 2) arrays of
    index ranges, equal where a node meets itself. All pairs agree in their first ``depth``
    bits but for ``differ`` of them.
    """
    label, ones = np.arange(len(v)), {}
    stack = [(depth, a[:, 0], a[:, 1], b[:, 0], b[:, 1], differ)]
    while stack:
        d, al, ah, bl, bh, df = stack.pop()
        if len(al) > CHUNK_PAIRS:
            stack += [(d, *(x[k : k + CHUNK_PAIRS] for x in (al, ah, bl, bh, df))) for k in range(0, len(al), CHUNK_PAIRS)]
            continue
        single = (ah - al == 1) & (bh - bl == 1) if d < 64 else np.ones(len(al), dtype=bool)
        if single.any():
            x, y = al[single], bl[single]
            near = np.bitwise_count(v[x] ^ v[y]) <= MAX_BITS
            label = forest(len(v), x[near], y[near], label)
            al, ah, bl, bh, df = (z[~single] for z in (al, ah, bl, bh, df))
        if not len(al):
            continue
        if d not in ones:
            bit = ((v >> np.uint64(63 - d)) & np.uint64(1)).astype(np.int32)
            ones[d] = np.concatenate(([0], np.cumsum(bit, dtype=np.int32)))
        am, bm = ah - (ones[d][ah] - ones[d][al]), bh - (ones[d][bh] - ones[d][bl])
        other = al != bl
        children = [(al, am, bl, bm, df), (am, ah, bm, bh, df), (al, am, bm, bh, df + 1), tuple(z[other] for z in (am, ah, bl, bm, df + 1))]
        cl, ch, dl, dh, df = (np.concatenate(z) for z in zip(*children))
        live = (ch > cl) & (dh > dl) & (df <= budget[d + 1])
        live &= (cl != dl) | (ch - cl > 1)
        if live.any():
            stack.append((d + 1, *(z[live] for z in (cl, ch, dl, dh, df))))
    return label


def _rotate(v: np.ndarray, k: int) -> np.ndarray:
    k %= 64
    return v if not k else (v << np.uint64(k)) | (v >> np.uint64(64 - k))


def _join_nodes(rot: np.ndarray, keys: np.ndarray, side: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """Links within whole nodes; rows come sorted by (rot, key, side, value)."""
    out = []
    for r in np.unique(rot):
        pick = rot == r
        k, s, x = keys[pick], side[pick], v[pick]
        cut = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]).any(axis=1) | (s[1:] != s[:-1]), [True])))
        lo, hi, kk, ss = cut[:-1], cut[1:], k[cut[:-1]], s[cut[:-1]]
        spans = np.stack((lo, hi), axis=1)
        paired = np.zeros(len(lo), dtype=bool)  # a side 0 that is followed by its side 1
        paired[:-1] = (ss[:-1] == 0) & (ss[1:] == 1) & (kk[1:] == kk[:-1]).all(axis=1)
        alone = (ss == 0) & (kk[:, 4] == 0)
        a = np.concatenate((spans[alone], spans[paired]))
        b = np.concatenate((spans[alone], spans[np.flatnonzero(paired) + 1]))
        if not len(a):
            continue
        first, second = BLOCKS[r], BLOCKS[(r + 1) % len(BLOCKS)]
        deep = kk[0, 0] == 1  # all rows of a call are of one level
        nodes = np.concatenate((kk[alone], kk[paired]))
        differ = np.bitwise_count((nodes[:, 1] ^ nodes[:, 2]).astype(np.uint64)).astype(np.int64)
        label = traverse(x, a, b, first + second * bool(deep), differ, budgets(int(r)))
        moved = label != np.arange(len(x))
        back = 64 - sum(BLOCKS[:r])
        out.append((_rotate(x[moved], back), _rotate(x[label[moved]], back)))
    ends = [np.concatenate([o[k] for o in out]) if out else np.zeros(0, dtype=np.uint64) for k in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array(e.view(np.int64)) for e in ends], names=["a", "b"])


def _trie_joins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Take rows sorted by node; join whole nodes, holding back the node that may go on."""
    held: list[np.ndarray] = []
    rows = 0

    def columns(batch: pa.RecordBatch) -> np.ndarray:
        return np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])

    def joined(m: np.ndarray) -> pa.RecordBatch:
        return _join_nodes(m[0], m[1:6].T, m[6], m[7].view(np.uint64))

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(columns(batch))
        rows += batch.num_rows
        if rows < CHUNK_ROWS:
            continue
        m = np.concatenate(held, axis=1)
        same = (m[:6] == m[:6, -1:]).all(axis=0)
        whole = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if whole:
            yield joined(m[:, :whole])
        held, rows = [m[:, whole:]], m.shape[1] - whole
    if rows:
        yield joined(np.concatenate(held, axis=1))


_NODE = ["rot", "level", "lo", "hi", "split", "cross", "side"]


def _links(rows: DataFrame) -> DataFrame:
    """Run the trie joins on rows of (rot, level, lo, hi, split, cross, side, v)."""
    # v sorts as an unsigned number
    laid = rows.repartition(*_NODE[:-1]).sortWithinPartitions(*_NODE, F.col("v").bitwiseXOR(F.lit(-(2**63))))
    return laid.select(*_NODE, "v").mapInArrow(_trie_joins, "a long, b long")


def hamming_links(fps: DataFrame, max_node: int = MAX_NODE) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct fingerprints ``fp`` within MAX_BITS bits.

    Not every pair is a row: the rows of each node span its links.
    """
    turned, at = [], 0
    for r, size in enumerate(BLOCKS):
        fp = F.col("fp")
        v = fp if not at else F.shiftleft(fp, at).bitwiseOR(F.shiftrightunsigned(fp, 64 - at))
        turned.append(F.struct(F.lit(r).alias("rot"), v.alias("v"), F.shiftrightunsigned(v, 64 - size).alias("lo"), F.shiftrightunsigned(v, 64 - size - BLOCKS[(r + 1) % len(BLOCKS)]).alias("deep")))
        at += size
    rows = fps.select(F.explode(F.array(*turned)).alias("x")).select("x.*")
    zero = F.lit(0)
    sizes = rows.groupBy("rot", "lo").agg(F.count(F.lit(1)).alias("n"))
    hot = materialize(sizes.filter(F.col("n") > max_node).select("rot", "lo", F.lit(True).alias("hot")), "hot")
    plain = rows
    if some := not hot.isEmpty():
        marked = materialize(join_checked(rows, hot, ["rot", "lo"], "left"), "turned")
        plain, rows = marked.filter("hot IS NULL"), marked.filter("hot")
    links = _links(plain.select("rot", zero.alias("level"), "lo", F.col("lo").alias("hi"), zero.alias("split"), zero.alias("cross"), zero.alias("side"), "v"))
    if not some:
        return links
    # the second block: the node itself, and each neighbour that one bit tells apart
    second = F.element_at(F.array(*[F.lit(BLOCKS[(r + 1) % len(BLOCKS)]) for r in range(len(BLOCKS))]), F.col("rot") + 1)
    flips = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), second - 1), lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)))
    near = rows.select("rot", "v", "deep", F.explode(flips).alias("flip")).select("rot", "v", "deep", F.col("deep").bitwiseXOR(F.col("flip")).alias("other"))
    near = near.select("rot", F.least("deep", "other").alias("lo"), F.greatest("deep", "other").alias("hi"), (F.col("deep") > F.col("other")).cast("int").alias("side"), "v")
    pieces = materialize(near.groupBy("rot", "lo", "hi").agg(F.ceil(F.count(F.lit(1)) / max_node).cast("int").alias("pieces")).filter("pieces > 1"), "pieces")
    near = join_checked(near, pieces, ["rot", "lo", "hi"], "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    near = near.withColumn("own", F.pmod(F.xxhash64("v"), F.col("pieces")).cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    # of a node with itself: pieces i <= j; of two nodes: piece i of one side, j of the other
    lone, low = F.col("lo") == F.col("hi"), F.least("own", "piece")
    high = F.greatest("own", "piece")
    i = F.when(lone, low).when(F.col("side") == 0, F.col("own")).otherwise(F.col("piece"))
    j = F.when(lone, high).when(F.col("side") == 0, F.col("piece")).otherwise(F.col("own"))
    side = F.when(lone, (F.col("own") > F.col("piece")).cast("int")).otherwise(F.col("side"))
    cross = F.when(lone & (low == high), 0).otherwise(1)
    split = i * F.lit(2**20) + j
    return links.unionByName(_links(near.select("rot", F.lit(1).alias("level"), "lo", "hi", split.alias("split"), cross.alias("cross"), side.alias("side"), "v")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_node: int = MAX_NODE) -> DataFrame:
    """``(id, fingerprint, component_id)`` for every row of ``docs``.

    A null text counts as empty; texts without a word have fingerprint 0 and are linked by
    it like any other; of a long text all shingles are hashed. Rows that repeat an id or a text are all returned. ``component_id`` is
    the smallest id of the component, ignoring null ids (null where all are). An empty table
    gives an empty result; further columns of the input are ignored.
    """
    raw = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("binary").alias("__text"))
    kind = docs.schema[id_col].dataType.simpleString()
    marked = materialize(raw.mapInArrow(_fingerprints, f"__id {kind}, fp long"), "fingerprints")
    classes = materialize(marked.groupBy("fp").agg(F.min("__id").alias("least"), F.count(F.lit(1)).alias("n")), "classes")
    links = materialize(hamming_links(classes.select("fp"), max_node), "links")
    roots = components(links).select(F.col("node").alias("fp"), "root")
    rooted = classes.join(roots, "fp", "left").select("fp", "least", F.col("n").alias("rows"), F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    least = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "least")
    n_classes, n_rows = rooted.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    # a component of very many fingerprints, or a text of very many rows, does not meet in one task
    named = join_spread(rooted, least, "root", ["component_id"], n_classes).select("fp", "component_id", F.col("rows").alias("n"))
    told = join_spread(marked, materialize(named, "named"), "fp", ["component_id"], n_rows)
    return told.select(F.col("__id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row with each component's smallest id stays; rows without an id all stay.

    Rows that repeat an id are one document and stay or go together.
    """
    found = near_duplicates(docs, id_col, text_col)
    stays = found.filter(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    kept = docs.join(stays, id_col, "left_semi").select(*docs.columns)
    return kept.unionByName(docs.filter(F.col(id_col).isNull()))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op2_simhash_near_dedup": op2_simhash_near_dedup}

ORACLES: dict[str, str] = {}

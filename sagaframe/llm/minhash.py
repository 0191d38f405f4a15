"""MinHash near-duplicates by fast similarity sketching.

A sketch has ``SIZE`` coordinates. In round i every shingle is hashed to a bin and puts i and its
hash there if that is less than what the bin holds, so earlier rounds win. Rounds go on until
all bins are filled; from round ``SIZE`` on, round i fills bin i - ``SIZE`` whatever the hashes are, so
every coordinate is filled after twice ``SIZE`` rounds at the latest. A text of n shingles takes time
in proportion to n + ``SIZE`` log ``SIZE``, two coordinates agree with the Jaccard similarity as their
chance, and sums of agreements are concentrated as if coordinates were independent.

Documents with equal shingle sets are one class. Classes whose sketches agree in one of the bands
are candidates: at similarity 0.85 a pair shares no band of ``BANDS`` with a chance below 1e-10. A
band's members are never paired all with all:

1. every member is compared with the band's pivot, the member that meets most others in its bands;
2. where members of one band are still in different components, those pairs are left that lie in
   different components. Small bands emit these. In a crowded one the members outside of its
   largest component meet all others in blocks, and pairs whose sketches agree too little for
   the similarity are passed over (a pair that is linked does so with a chance below 1e-10);
3. if too many are outside of it (documents that share a passage), crowded bands are joined two by two
   into finer ones first: a linked pair that is in no band but crowded ones is in two of them.

All candidates are confirmed on the full shingle sets of the texts, by 128-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_checked, join_spread, materialize, table
from .components import components

SHINGLE, PERCENT = 3, 85
SIZE, BAND = 128, 4
BANDS = SIZE // BAND
#: Bits of a fine sketch, and those that are looked at first. At a similarity of 0.85 a bit is equal with a
#: chance of 0.925; fewer equal bits than the mean less 6.6 standard deviations pass a pair over.
FINE, FIRST = 4096, 512
LEAST_FINE, LEAST_FIRST = 3677, 434
#: Members of a small band, members of a block, and partners of a held text that meet in one place.
SMALL, BLOCK, PARTNERS = 32, 8192, 512
#: Hashes for each coordinate that are computed together, and shingles that are hashed together.
CHUNK_HASHES, CHUNK_SHINGLES = 16, 50_000
#: Pairs that are compared or sent together.
CHUNK_PAIRS = 50_000

_SEEDS = np.random.default_rng(11).integers(0, 2**63, 2 * FINE, dtype=np.uint64)
_EMPTY = np.uint64(2**64 - 1)


def shingle_hashes(raw: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """128-bit hashes of the distinct shingles of a UTF-8 text, as sorted rows of two numbers; no row without a word."""
    words = (raw or b"").lower().split()  # bytes: A-Z only, and exactly the six ASCII blanks
    if not words:
        return np.zeros((0, 2), dtype=np.uint64)
    joined, n = b" ".join(words), max(len(words) - shingle + 1, 1)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n]
    ends, digest, out = ends[min(shingle, len(words)) - 1 :], xxhash.xxh3_128_digest, np.zeros((0, 2), dtype=np.uint64)
    for k in range(0, n, CHUNK_SHINGLES):
        part = b"".join([digest(joined[a:b]) for a, b in zip(starts[k : k + CHUNK_SHINGLES].tolist(), ends[k : k + CHUNK_SHINGLES].tolist())])
        out = distinct(np.concatenate((out, np.frombuffer(part, dtype=np.uint64).reshape(-1, 2))))
    return out


def distinct(rows: np.ndarray) -> np.ndarray:
    """Rows of two numbers, sorted, each once."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    return rows[np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1)))] if len(rows) else rows


def _mixed(h: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """One hash of every value for every seed."""
    x = h[None, :] ^ seeds[:, None]
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def sketch(h: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Sketch of a set of 64-bit hashes; ``size`` is a power of two. A value tells its round in the first bits."""
    out, i, top = np.full(size, _EMPTY), 0, np.uint64(64 - size.bit_length())
    low = (np.uint64(1) << top) - np.uint64(1)
    while i < size and (out == _EMPTY).any():
        rounds = min(size - i, max(1, CHUNK_HASHES * size // len(h)))  # a round too many changes nothing
        x = _mixed(h, _SEEDS[i : i + rounds])
        value = (x & low) + (np.arange(i, i + rounds, dtype=np.uint64) << top)[:, None]
        np.minimum.at(out, (x >> (top + np.uint64(1))).astype(np.int64).ravel(), value.ravel())
        i += rounds
    rest = np.flatnonzero(out == _EMPTY)  # only if there are few hashes
    if len(rest):
        out[rest] = (rest + size).astype(np.uint64) * (low + np.uint64(1)) + (_mixed(h, _SEEDS[size + rest]) & low).min(axis=1)
    return out


def fine_bits(h: np.ndarray) -> bytes:
    """One bit of each of the ``FINE`` coordinates."""
    return np.packbits((sketch(h, FINE) & np.uint64(1)).astype(np.uint8)).tobytes()


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests, keys = [], [], []
        for raw in batch.column(1):
            h = shingle_hashes(raw.as_py())
            sizes.append(len(h))
            if not len(h):
                digests.append(None)
                keys.append([])
                continue
            s = sketch(h[:, 0])
            digests.append(xxhash.xxh3_128_digest(h.tobytes()))
            keys.append([xxhash.xxh3_64_intdigest(s[k * BAND : (k + 1) * BAND].tobytes(), k) - 2**63 for k in range(BANDS)])
        columns = [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["__id", "n_shingles", "digest", "keys"])


def _of_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (node, digest, text) those whose text has that digest, with their fine sketches."""
    for batch in batches:
        nodes, texts, bits = [], [], []
        for node, digest, text in zip(*batch.columns):
            h = shingle_hashes(text.as_py())
            if xxhash.xxh3_128_digest(h.tobytes()) == digest.as_py():
                nodes.append(node.as_py())
                texts.append(text.as_py())
                bits.append(fine_bits(h[:, 0]))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(texts, pa.binary()), pa.array(bits, pa.binary())], names=["node", "text", "bits"])


def _may_link(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _confirmed(percent: int):
    """Take rows (held, salt, role, node, text), a held text before its partners; give the pairs that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = None, None
        for batch in batches:
            a, b = [], []
            for name, role, node, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)):
                h = shingle_hashes(raw.as_py())
                if role == 0:
                    held, own = name, h
                elif held == name:
                    union = len(distinct(np.concatenate((own, h))))
                    if 100 * (len(own) + len(h) - union) >= percent * union:
                        a.append(node), b.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that are linked, by their whole texts ``(node, text)``.

    The text of ``b`` is held and those of its partners pass by; partners beyond ``PARTNERS`` meet a
    copy of it elsewhere, so no task gets all of them."""
    held = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("copies"))
    partner = pairs.join(held, "b").select(F.col("b").alias("held"), F.pmod(F.xxhash64("a"), F.col("copies")).cast("int").alias("salt"), F.lit(1).alias("role"), F.col("a").alias("node"))
    holder = held.select(F.col("b").alias("held"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("b").alias("node"))
    rows = partner.unionByName(holder).join(texts, "node").select("held", "salt", "role", "node", "text")
    laid = rows.repartition("held", "salt").sortWithinPartitions("held", "salt", "role", "node")
    return materialize(laid.mapInArrow(_confirmed(percent), "a long, b long"), "confirmed")


def _pivots(met: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of every member with its band's pivot, each once."""
    weight = met.groupBy("cid").agg(F.sum(F.log("m")).alias("w"))
    weighed = met.join(weight, "cid")
    pivots = weighed.groupBy("key").agg(F.max_by(F.struct("cid", "n"), F.struct("w", -F.col("cid"))).alias("p"))
    pairs = met.join(pivots, "key").filter(F.col("cid") != F.col("p.cid")).filter(_may_link(F.col("n"), F.col("p.n"), percent))
    return pairs.select(F.col("cid").alias("a"), F.col("p.cid").alias("b")).distinct()


def _small_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components in small bands."""
    other = rows.select("key", *[F.col(c).alias(f"{c}2") for c in ("cid", "n", "root")])
    pairs = rows.join(other, "key").filter("cid < cid2 AND root <> root2").filter(_may_link(F.col("n"), F.col("n2"), percent))
    return pairs.select(F.col("cid").alias("a"), F.col("cid2").alias("b"))


def _equal_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.shape[-1] * 64 - np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _near(rows: np.ndarray, bits: np.ndarray, others: np.ndarray, held: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``rows`` and ``others`` (node, size, root) of pairs in different components whose bits are equal enough."""
    first = FIRST // 64
    step = max(1, 4 * CHUNK_PAIRS // len(others))
    for k in range(0, len(rows), step):
        x = rows[k : k + step]
        live = (x[:, None, 2] != others[None, :, 2]) & (100 * np.minimum(x[:, None, 1], others[None, :, 1]) >= percent * np.maximum(x[:, None, 1], others[None, :, 1]))
        live &= _equal_bits(bits[k : k + step, None, :first], held[None, :, :first]) >= LEAST_FIRST
        p, q = np.nonzero(live)
        for at in range(0, len(p), CHUNK_PAIRS):
            i, j = p[at : at + CHUNK_PAIRS], q[at : at + CHUNK_PAIRS]
            same = _equal_bits(bits[k + i], held[j]) >= LEAST_FINE
            yield k + i[same], j[same]


def _agreeing(percent: int):
    """Take rows (key, i, j, role, cid, n, root, bits, bands), the outer members of a block first; give pairs that agree enough.

    ``bands`` are a member's keys by band, 0 where it is in no crowded one. A pair that shares several is given in the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, outer = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            meta = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(7)], axis=1)
            told = np.frombuffer(b"".join(batch.column(7).to_pylist()), dtype=np.uint64).reshape(-1, FINE // 64)
            bands = batch.column(8).flatten().to_numpy().reshape(len(meta), -1)
            cuts = np.concatenate(([0], 1 + np.flatnonzero((meta[1:, :4] != meta[:-1, :4]).any(axis=1)), [len(meta)]))
            for a, b in zip(cuts[:-1], cuts[1:]):
                rows, bits, keys = meta[a:b, 4:], told[a:b], bands[a:b]  # of one block and role
                if place != (now := tuple(meta[a, :3])):
                    place, outer = now, []
                if meta[a, 3] == 0:
                    outer.append((rows, bits, keys))
                    continue
                if len(outer) > 1:
                    outer = [tuple(np.concatenate(c) for c in zip(*outer))]
                for others, held, theirs in outer:
                    for x, y in _near(rows, bits, others, held, percent):
                        if keys.shape[1]:
                            shared = (keys[x] == theirs[y]) & (keys[x] != 0)
                            first = keys[x, shared.argmax(axis=1)] == meta[a, 0]
                            x, y = x[first], y[first]
                        pairs = np.sort(np.stack((rows[x, 0], others[y, 0]), axis=1), axis=1)
                        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def _crowded_pairs(rows: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components in crowded bands: members outside of the largest component meet all, in blocks."""
    rows = rows.withColumn("is", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("js", F.ceil(F.col("outside") / BLOCK).cast("int"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    columns = ["key", "i", "j", "role", "cid", "n", "root"]
    of = F.map_from_entries(F.collect_list(F.when(F.col("band") >= 0, F.struct("band", "key"))))  # as many as there are bands
    held = rows.groupBy("cid").agg(of.alias("of"))
    by_band = F.when(F.size("of") > 0, F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.coalesce(F.element_at("of", b), F.lit(0).cast("long")))).otherwise(F.array().cast("array<long>"))
    told = bits.join(held.select("cid", by_band.alias("bands")), "cid")
    inner = rows.withColumn("i", own("is")).withColumn("j", spread("js")).withColumn("role", F.lit(1))
    outer = rows.filter("root <> major").withColumn("j", own("js")).withColumn("i", spread("is")).withColumn("role", F.lit(0))
    placed = inner.select(*columns).unionByName(outer.select(*columns)).join(told, "cid").select(*columns, "bits", "bands")
    laid = placed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "role")
    return laid.mapInArrow(_agreeing(percent), "a long, b long")


def _open(met: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of bands that still hold more than one component, with ``root``, the band's largest one and how many are outside of it."""
    rooted = materialize(met.join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid")), "rooted")
    shares = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("k"))
    bands = shares.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max_by("root", F.struct("k", "root")).alias("major"), (F.sum("k") - F.max("k")).alias("outside"))
    return materialize(join_checked(rooted, materialize(bands.filter("parts > 1").drop("parts"), "bands"), "key", "inner"), "open")


def _finer(rows: DataFrame) -> DataFrame:
    """Bands joined two by two; they have no place among the bands."""
    held = rows.groupBy("cid", "n").agg(F.array_sort(F.collect_list("key")).alias("keys"))  # as many as there are bands
    two = F.flatten(F.transform("keys", lambda x, i: F.transform(F.slice("keys", i + 2, F.size("keys")), lambda y: F.xxhash64(x, y))))
    return held.select(F.lit(-1).alias("band"), F.explode(two).alias("key"), "cid", "n")


def _met(rows: DataFrame) -> DataFrame:
    """Rows ``(band, key, cid, n)`` of bands that hold more than one member, with their number ``m``."""
    sizes = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "sizes")
    return materialize(rows.join(sizes, "key"), "met")


def class_links(classes: DataFrame, texts, percent: int = PERCENT, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """``(node, root)`` of the classes ``(cid, n, keys)`` that are linked to others.

    ``texts`` gives the ``(node, text, bits)`` of a table of ``cid``."""
    met = _met(classes.select(F.posexplode("keys").alias("band", "key"), "cid", "n"))
    found = materialize(texts(met.select("cid").distinct()), "bodies")
    bodies, bits = found.select("node", "text"), found.select(F.col("node").alias("cid"), "bits")
    tried, links, later = None, None, []
    for level in (1, 2):
        pairs = materialize(_pivots(met, percent), "pivots")
        found = confirm(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), bodies, percent)
        tried, links = (pairs, found) if tried is None else (tried.unionByName(pairs), links.unionByName(found))
        roots = components(links).withColumnRenamed("node", "cid")
        rows = _open(met, roots)
        dense = (F.col("m") > small) & (F.col("outside") > block) if level == 1 else F.lit(False)
        later.append(_small_pairs(rows.filter(F.col("m") <= small), percent))
        later.append(_crowded_pairs(rows.filter((F.col("m") > small) & ~dense), bits, percent))
        if level == 2 or (crowd := rows.filter(dense)).isEmpty():
            break
        met = _met(_finer(crowd))
    left = later[0]
    for more in later[1:]:
        left = left.unionByName(more)
    either = tried.unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left = materialize(left.distinct().join(either, ["a", "b"], "left_anti"), "left")
    return components(links.unionByName(confirm(left, bodies, percent)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` for every row of ``docs``.

    A null text counts as empty; texts without a word have no shingles and are linked with nothing.
    Texts may be of any length, all their shingles count. Rows that repeat an id are linked by
    their own texts; of equal sets all rows are in one component. ``component_id`` is the smallest
    id of the component. A row without an id has no component, links nothing and is kept. An empty
    table gives no rows; further columns are ignored. ``percent`` is at least 85, for which sketches are made.
    """
    if percent < PERCENT:
        raise ValueError("sketches are made for similarities of 85 in 100 and more")
    kind = docs.schema[id_col].dataType.simpleString()
    raw = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("binary").alias("__text"))
    marked = materialize(raw.mapInArrow(_sketched, f"__id {kind}, n_shingles long, digest binary, keys array<long>"), "sketched")
    able = marked.filter("__id IS NOT NULL AND n_shingles > 0")
    classes = able.groupBy("digest").agg(F.min("__id").alias("least"), F.count(F.lit(1)).alias("rows"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("cid"), "*"), "classes")

    def texts(wanted: DataFrame) -> DataFrame:
        ids = classes.join(wanted, "cid", "left_semi").select(F.col("cid").alias("node"), "digest", F.col("least").alias("__id"))
        rows = raw.join(ids, "__id").select("node", "digest", "__text")
        # rows that repeat an id may have other texts, or the same again
        return rows.mapInArrow(_of_digest, "node long, text binary, bits binary").groupBy("node").agg(F.first("text").alias("text"), F.first("bits").alias("bits"))

    roots = class_links(classes.select("cid", "n", "keys"), texts, percent, small, block).select(F.col("node").alias("cid"), "root")
    rooted = materialize(classes.select("cid", "digest", "least", "rows").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid")), "rooted")
    least = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "least")
    n_classes, n_rows = rooted.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    named = join_spread(rooted, least, "root", ["component_id"], n_classes).select("digest", "component_id", F.col("rows").alias("n"))
    told = join_spread(able.select("__id", "n_shingles", "digest"), materialize(named, "named"), "digest", ["component_id"], n_rows).drop("digest")
    alone = marked.filter("__id IS NULL OR n_shingles = 0").select("__id", "n_shingles", F.col("__id").alias("component_id"))
    out = told.select("__id", "n_shingles", "component_id").unionByName(alone)
    return out.select(F.col("__id").alias(id_col), "n_shingles", "component_id", (F.col("__id").eqNullSafe(F.col("component_id"))).alias("kept"))


def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op11_minhash_near_dedup": op11_minhash_near_dedup}

ORACLES = {
    "op11_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
        s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
                     ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END)) AS g FROM w),
        class AS (SELECT g, len(g) AS n, min(doc_id) AS c FROM s WHERE len(g) > 0 GROUP BY g),
        post AS (SELECT c, n, unnest(g) AS x FROM class),
        df AS (SELECT x, count(*) AS d FROM post GROUP BY x),
        prefix AS (SELECT c, n, x FROM (SELECT c, n, post.x AS x, row_number() OVER (PARTITION BY c ORDER BY d, post.x) AS r FROM post JOIN df ON post.x = df.x) WHERE r <= n - (85 * n + 99) // 100 + 1),
        candidate AS (SELECT DISTINCT p.c AS a, q.c AS b FROM prefix p JOIN prefix q ON p.x = q.x AND p.c < q.c AND 100 * least(p.n, q.n) >= 85 * greatest(p.n, q.n)),
        shared AS (SELECT a, b, p.n + q.n AS total, len(list_intersect(p.g, q.g)) AS i FROM candidate JOIN class p ON a = p.c JOIN class q ON b = q.c),
        link AS (SELECT unnest([a, b]) AS a, unnest([b, a]) AS b FROM shared WHERE 100 * i >= 85 * (total - i)),
        reach AS (SELECT c AS a, c AS b FROM class UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
        root AS (SELECT a, min(b) AS root FROM reach GROUP BY a)
        SELECT s.doc_id, len(s.g) AS n_shingles, coalesce(root, s.doc_id) AS component_id, coalesce(root, s.doc_id) = s.doc_id AS kept
        FROM s LEFT JOIN class ON s.g = class.g LEFT JOIN root ON class.c = root.a
    """
}

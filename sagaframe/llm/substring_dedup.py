"""Substring dedup on a de Bruijn graph of token windows.

Every window of ``WINDOW`` words is an edge of the graph, from its first to its last
``WINDOW - 1`` words. The graph is never laid out edge by edge:

* Edges are partitioned by their minimizer, the least-hashed ``SEED``-word run inside the
  window. Consecutive edges with the same minimizer travel as one row (a short path), so the
  graph moves in about one row for nine edges, and equal edges always meet under one seed.
* Paths that a task has met before are settled where they are read. A seed with very many edges
  left is split: each of its edges travels alone, keyed by seed, offset and window hash, so equal
  edges still meet and no task holds the seed. The rest pass seed by seed in order of their
  coordinates (document, position). The first
  coordinate of an edge is its source; every later edge with the same words points to it.
* Edges that follow their source along one diagonal (same source document, same distance) form
  nonbranching paths. A join of the nodes where short paths end with the nodes where short paths
  of the same diagonal begin tells which nodes are passed through: they compact away. What is
  left are the first and last nodes of maximal spans, joined in order of their place.
* The source coordinates of a span lead to the words it repeats, and a join with the documents
  compares both before it cuts the span.

Edges are first compared by a 64-bit hash of the seed with a 64-bit hash of the whole window,
at the same offset from the seed. This misses no repeat but may join windows that differ, so
no span is cut before a 128-bit digest of its words equals that of its source's words. The
windows of a span that fails are looked up in all documents by their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

WINDOW, SEED = 20, 5
#: Bytes of a window's hash that travel.
HASH_BYTES = 8
#: Words that are hashed together, and words whose hashes are remembered.
CHUNK_WORDS, KNOWN_WORDS = 200_000, 300_000
#: Hashes of windows of failed spans that are looked up in one pass over the documents.
LOOKUP_HASHES = 1_000_000
#: Edges from which a seed is split, the share of paths by which they are counted, and seeds split at most.
HOT_EDGES, COUNTED_SHARE, HOT_SEEDS = 100_000, 16, 100_000

_MULTIPLIERS = np.random.default_rng(20).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: A path whose source is known: marker (no path's first byte is that large), edges, source.
SETTLED = 255
_SETTLED = np.dtype([("mark", "u1"), ("edges", "<i4"), ("doc", "<i8"), ("pos", "<i4")])
SETTLED_BYTES = _SETTLED.itemsize


class _Hashes(dict):
    """Word hashes, forgotten all at once when they are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()


def _run_hashes(h: np.ndarray, size: int, start: int) -> np.ndarray:
    """Hash of each run of ``size`` words."""
    n = len(h) - size + 1
    acc = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        acc += h[j : j + n] * _MULTIPLIERS[start + j]
    acc ^= acc >> np.uint64(32)
    acc *= np.uint64(0x9E3779B97F4A7C15)
    return acc ^ (acc >> np.uint64(29))


def _minimizers(grams: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost least value of each run of ``width`` values."""
    at, span = np.arange(len(grams)), 1
    while span < width:
        step = min(span, width - span)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(grams[left] <= grams[right], left, right)
        span += step
    return at


def _edge_keys(seeds: np.ndarray, offset: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Keys by which single edges are laid out: equal for equal edges."""
    key = seeds * _MULTIPLIERS[2] + offset.astype(np.uint64) * _MULTIPLIERS[3] + whole * _MULTIPLIERS[4]
    key ^= key >> np.uint64(32)
    return key * np.uint64(0x9E3779B97F4A7C15)


def super_edges(h: np.ndarray, lengths: np.ndarray, window: int, seed: int, hot: np.ndarray | None = None, hash_bytes: int = HASH_BYTES) -> tuple:
    """Paths of edges with one minimizer: (seed, text, position, content hash, payload offsets, payload).

    ``h`` holds the word hashes of several texts one after another. A payload is a byte, the
    seed's distance from the first window, then ``hash_bytes`` for each window. Edges of the
    seeds in ``hot`` (sorted) make a path each, with a key in which offset and hash are mixed.
    """
    begins = np.concatenate(([0], np.cumsum(lengths)))
    if len(h) < window:
        return None
    text = np.repeat(np.arange(len(lengths)), lengths)
    valid = text[: len(h) - window + 1] == text[window - 1 :]
    grams = _run_hashes(h, seed, 0)
    at = _minimizers(grams, window - seed + 1)
    whole = _run_hashes(h, window, seed)
    first = np.flatnonzero(valid)
    if not len(first):
        return None
    at, whole, text = at[first], whole[first], text[first]
    fresh = np.concatenate(([True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])))
    key = grams[at]
    if hot is not None and len(hot):
        split = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
        fresh |= split
        key = np.where(split, _edge_keys(key, at - first, whole), key)
    head = np.flatnonzero(fresh)
    header = hash_bytes * head + np.arange(len(head))
    payload = np.empty(hash_bytes * len(first) + len(head), dtype=np.uint8)
    body = np.ones(len(payload), dtype=bool)
    body[header] = False
    payload[header] = (at[head] - first[head]).astype(np.uint8)
    payload[body] = whole.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :hash_bytes].ravel()
    step = np.arange(len(first)) - np.repeat(head, np.diff(np.append(head, len(first))))
    same = np.add.reduceat(whole * _MULTIPLIERS[step], head) + payload[header]
    return key[head], text[head], first[head] - begins[text[head]], same, np.append(header, len(payload)), payload


def _settle(seeds: np.ndarray, doc: np.ndarray, pos: np.ndarray, same: np.ndarray, offsets: np.ndarray, payload: np.ndarray, hash_bytes: int = HASH_BYTES) -> tuple:
    """Pre-aggregate: a path that an earlier one of the batch equals needs no comparison.

    Such a row keeps, in place of its hashes, the marker SETTLED, its number of edges and its
    source's coordinates, and gets a key of its own, so a path that very many documents hold
    does not gather under its seed.
    """
    order = np.lexsort((pos, doc, same, seeds))
    lead = np.concatenate(([True], (seeds[order[1:]] != seeds[order[:-1]]) | (same[order[1:]] != same[order[:-1]])))
    source = np.empty(len(seeds), dtype=np.int64)
    source[order] = order[np.maximum.accumulate(np.where(lead, np.arange(len(seeds)), 0))]
    done = (doc != doc[source]) | (pos != pos[source])
    old = np.diff(offsets)
    size = np.where(done, SETTLED_BYTES, old)
    fresh = np.concatenate(([0], np.cumsum(size)))
    out = np.empty(int(fresh[-1]), dtype=np.uint8)
    kept = np.flatnonzero(~done)
    shift = np.repeat(offsets[:-1][kept] - fresh[:-1][kept], old[kept])
    into = np.arange(len(shift)) + np.repeat(fresh[:-1][kept] - (np.cumsum(old[kept]) - old[kept]), old[kept])
    out[into] = payload[into + shift]
    told = np.flatnonzero(done)
    record = np.zeros(len(told), dtype=_SETTLED)
    record["mark"], record["edges"] = SETTLED, (old[told] - 1) // hash_bytes
    record["doc"], record["pos"] = doc[source[told]], pos[source[told]]
    out[fresh[:-1][told][:, None] + np.arange(SETTLED_BYTES)] = record.view(np.uint8).reshape(len(told), SETTLED_BYTES)
    own = doc.astype(np.uint64) * _MULTIPLIERS[0] + pos.astype(np.uint64) * _MULTIPLIERS[1]
    return np.where(done, own, seeds), fresh.astype(np.int32), out


def _edges_of(window: int, seed: int, hot: np.ndarray | None = None, counted: int = 0, hash_bytes: int = HASH_BYTES):
    """Give the settled and unsettled paths, or with ``counted`` the edges of one unsettled path in so many, by seed."""
    names = ["seed", "doc", "pos", "path"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            h = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
            found = super_edges(h, np.array([len(p) for p in parts], dtype=np.int64), window, seed, hot, hash_bytes)
            if found:
                seeds, text, pos, same, offsets, payload = found
                doc = np.array(ids, dtype=np.int64)[text]
                seeds, offsets, payload = _settle(seeds, doc, pos, same, offsets, payload, hash_bytes)
                if counted:
                    drawn = (doc.astype(np.uint64) * _MULTIPLIERS[5] + pos.astype(np.uint64) * _MULTIPLIERS[6]) >> np.uint64(40)
                    pick = (drawn % np.uint64(counted) == 0) & (payload[offsets[:-1]] != SETTLED)
                    edges = (np.diff(offsets)[pick].astype(np.int64) - 1) // hash_bytes
                    yield pa.RecordBatch.from_arrays([pa.array(seeds[pick].view(np.int64)), pa.array(edges)], names=["seed", "edges"])
                    return
                path = pa.Array.from_buffers(pa.binary(), len(seeds), [None, pa.py_buffer(offsets), pa.py_buffer(payload)])
                yield pa.RecordBatch.from_arrays([pa.array(seeds.view(np.int64)), pa.array(doc), pa.array(pos.astype(np.int32)), path], names=names)

        parts, ids, held = [], [], 0
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = raw.as_py().split()
                parts.append(np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words)))
                ids.append(i)
                held += len(words)
                if held >= CHUNK_WORDS:
                    yield from flush()
                    parts, ids, held = [], [], 0
        yield from flush()

    return run


def _sources(window: int, hash_bytes: int = HASH_BYTES):
    """Rows come in order of (seed, doc, pos). Give the runs of edges that have an earlier source."""
    names = ["doc", "start", "end", "src_doc", "src_start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # edges of the last seed seen, with their sources: seed, offset, hash, doc, pos
        known = tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.uint64, np.int64, np.int64))
        for batch in batches:
            if not batch.num_rows:
                continue
            seed, doc, pos = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:3])
            path = batch.column(3)
            offsets = np.frombuffer(path.buffers()[1], dtype=np.int32)[path.offset : path.offset + len(path) + 1].astype(np.int64)
            data = np.frombuffer(path.buffers()[2], dtype=np.uint8)
            begin, stop = offsets[:-1], offsets[1:]
            done = data[begin] == SETTLED
            if done.any():
                raw = data[begin[done][:, None] + np.arange(SETTLED_BYTES)]
                told = np.ascontiguousarray(raw).view(_SETTLED).ravel()
                columns = (doc[done], pos[done], (pos[done] + told["edges"] + window - 1).astype(np.int32), told["doc"].astype(np.int64), told["pos"].astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)
                seed, doc, pos, begin, stop = (x[~done] for x in (seed, doc, pos, begin, stop))
                if not len(seed):
                    continue
            # rows whose seed is alone hold nothing to compare
            twin = np.concatenate(([False], seed[1:] == seed[:-1]))
            many = twin | np.concatenate((twin[1:], [True])) | (seed == known[0][-1] if len(known[0]) else False)
            rows = np.flatnonzero(many)
            counts = (stop[rows] - begin[rows] - 1) // hash_bytes
            row = np.repeat(rows, counts)
            step = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            wide = np.zeros((len(row), 8), dtype=np.uint8)
            base = begin[row] + 1 + hash_bytes * step
            for k in range(hash_bytes):
                wide[:, k] = data[base + k]
            hashed = wide.view("<u8").ravel()
            offset = data[begin[row]].astype(np.int64) - step
            p = pos[row].astype(np.int64) + step
            old = len(known[0])
            s, o, e, d, q = (np.concatenate(x) for x in zip(known, (seed[row], offset, hashed, doc[row], p)))
            order = np.lexsort((q, d, e, o, s))  # among equal edges the source comes first
            lead = np.concatenate(([True], (s[order[1:]] != s[order[:-1]]) | (o[order[1:]] != o[order[:-1]]) | (e[order[1:]] != e[order[:-1]])))
            source = np.empty(len(s), dtype=np.int64)
            source[order] = order[np.maximum.accumulate(np.where(lead, np.arange(len(s)), 0))]
            last = order[lead & (s[order] == seed[-1])]
            later = np.flatnonzero(((d != d[source]) | (q != q[source]))[old:])
            if len(later):
                r, at = row[later], later + old
                src_doc, src_pos, here = d[source[at]], q[source[at]], q[at]
                fresh = np.concatenate(([True], (r[1:] != r[:-1]) | (here[1:] != here[:-1] + 1) | (src_doc[1:] != src_doc[:-1]) | (src_pos[1:] != src_pos[:-1] + 1)))
                head = np.flatnonzero(fresh)
                tail = np.append(head[1:], len(later)) - 1
                columns = (doc[r[head]], here[head].astype(np.int32), (here[tail] + window).astype(np.int32), src_doc[head], src_pos[head].astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)
            known = tuple(x[last] for x in (s, o, e, d, q))

    return run


def hot_seeds(raw: DataFrame, window: int, seed: int, hot_edges: int = HOT_EDGES, counted: int = COUNTED_SHARE, hash_bytes: int = HASH_BYTES) -> np.ndarray:
    """Seeds with about ``hot_edges`` unsettled edges or more, the largest HOT_SEEDS of them.

    The count is of one path in ``counted``. It decides only how edges are laid out, so that an
    error in it changes no result.
    """
    counts = raw.mapInArrow(_edges_of(window, seed, None, counted, hash_bytes), "seed long, edges long").groupBy("seed").agg(F.sum("edges").alias("edges"))
    most = counts.filter(F.col("edges") * counted >= hot_edges).orderBy(F.desc("edges"), "seed").limit(HOT_SEEDS)
    return np.sort(np.array([r.seed for r in most.collect()], dtype=np.int64).view(np.uint64))


def edge_paths(raw: DataFrame, window: int, seed: int, hot_edges: int = HOT_EDGES, counted: int = COUNTED_SHARE, hash_bytes: int = HASH_BYTES) -> DataFrame:
    """All paths ``(seed, doc, pos, path)``, those of hot seeds split into their edges."""
    hot = hot_seeds(raw, window, seed, hot_edges, counted, hash_bytes)
    return raw.mapInArrow(_edges_of(window, seed, hot, 0, hash_bytes), "seed long, doc long, pos int, path binary")


def repeated_paths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED, hot_edges: int = HOT_EDGES, counted: int = COUNTED_SHARE, hash_bytes: int = HASH_BYTES) -> DataFrame:
    """Short paths ``(doc, start, end, src_doc, src_start)`` of edges that also start earlier."""
    raw = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col).cast("binary"))
    edges = edge_paths(raw, window, seed, hot_edges, counted, hash_bytes)
    laid = edges.repartition("seed").sortWithinPartitions("seed", "doc", "pos")
    return laid.mapInArrow(_sources(window, hash_bytes), "doc long, start int, end int, src_doc long, src_start int")


def repeated_spans(paths: DataFrame, window: int = WINDOW) -> DataFrame:
    """Compact short paths along their diagonal: maximal spans ``(doc, start, end, src_doc, src_start)``.

    A node that as many paths of the diagonal enter as leave is within a span. Of the others, those
    that more paths leave begin spans and those that more enter end them; the n-th beginning of a
    diagonal belongs to its n-th end.
    """
    diagonal = ["doc", "src_doc", "shift"]
    rows = paths.select("doc", "src_doc", (F.col("start") - F.col("src_start")).alias("shift"), "start", (F.col("end") - (window - 1)).alias("stop"))
    leave = rows.groupBy(*diagonal, F.col("start").alias("node")).agg(F.count(F.lit(1)).alias("leave"))
    enter = rows.groupBy(*diagonal, F.col("stop").alias("node")).agg(F.count(F.lit(1)).alias("enter"))
    joined = leave.join(enter, [*diagonal, "node"], "full").withColumn("more", F.coalesce("leave", F.lit(0)) - F.coalesce("enter", F.lit(0))).filter("more <> 0")
    ends = materialize(joined.select(*diagonal, "node", (F.col("more") > 0).alias("begins"), F.explode(F.sequence(F.lit(1), F.abs("more")))).drop("col"), "nodes")
    place = F.row_number().over(Window.partitionBy(*diagonal).orderBy("node")).alias("place")
    first = ends.filter("begins").select(*diagonal, F.col("node").alias("start"), place)
    last = ends.filter("NOT begins").select(*diagonal, (F.col("node") + (window - 1)).alias("end"), place)
    return first.join(last, [*diagonal, "place"]).select("doc", "start", "end", "src_doc", (F.col("start") - F.col("shift")).alias("src_start"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest the words of each wanted slice; a slice that a row does not have is left out."""
    for batch in batches:
        out: list[tuple] = []
        for i, raw, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            words = raw.as_py().split()
            for x in wanted.as_py():
                if x["start"] + x["n"] <= len(words):
                    found = hashlib.blake2b(b" ".join(words[x["start"] : x["start"] + x["n"]]), digest_size=16).digest()
                    out.append((i, x["start"], x["n"], x["src_doc"], x["src_start"], found))
        columns = list(zip(*out)) or [()] * 6
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc", "start", "n", "src_doc", "src_start", "digest"])


def compared_spans(spans: DataFrame, raw: DataFrame) -> DataFrame:
    """``(doc, start, end, equal)``: whether a row of the span's document has the words of a row of its source.

    ``raw`` has the documents as (__id, __text). Of a source's slice only one digest travels.
    """
    n = (F.col("end") - F.col("start")).alias("n")
    slices = spans.select(F.col("src_doc").alias("doc"), F.col("src_start").alias("start"), n).distinct()
    kind = "long", "int"
    sources = slices.select("doc", "start", "n", *(F.lit(None).cast(k).alias(c) for c, k in zip(("src_doc", "src_start"), kind)))
    wanted = spans.select("doc", "start", n, "src_doc", "src_start").unionByName(sources)
    wanted = wanted.groupBy("doc").agg(F.collect_list(F.struct("start", "n", "src_doc", "src_start")).alias("wanted"))
    asked = raw.join(wanted, F.col("__id") == F.col("doc")).select("__id", "__text", "wanted")
    found = materialize(asked.mapInArrow(_digests, "doc long, start int, n int, src_doc long, src_start int, digest binary"), "digests")
    own = found.filter("src_doc IS NOT NULL")
    theirs = found.filter("src_doc IS NULL").select(F.col("doc").alias("src_doc"), F.col("start").alias("src_start"), "n", "digest").distinct().withColumn("equal", F.lit(True))
    told = own.join(theirs, ["src_doc", "src_start", "n", "digest"], "left").select("doc", "start", (F.col("start") + F.col("n")).alias("end"), F.coalesce("equal", F.lit(False)).alias("equal"))
    sure = told.groupBy("doc", "start", "end").agg(F.max("equal").alias("equal"))
    # a span that no single row holds has no digest at all
    return spans.select("doc", "start", "end").join(sure, ["doc", "start", "end"], "left").withColumn("equal", F.coalesce("equal", F.lit(False)))


def _windows(window: int, seed: int, wanted: np.ndarray | None):
    """Windows ``(doc, pos, hash, words)``: those in given spans, or those with a wanted hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                words = batch.column(1)[row].as_py().split()
                if len(words) < window:
                    continue
                hashed = _run_hashes(np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words)), window, seed).view(np.int64)
                if wanted is None:
                    pick = np.zeros(len(hashed), dtype=bool)
                    for x in batch.column(2)[row].as_py():
                        pick[x["start"] : x["end"] - window + 1] = True
                else:
                    pick = wanted[np.minimum(np.searchsorted(wanted, hashed), len(wanted) - 1)] == hashed
                found = np.flatnonzero(pick)
                for k in range(0, len(found), 10_000):
                    at = found[k : k + 10_000]
                    texts = pa.array([b" ".join(words[p : p + window]) for p in at.tolist()], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[row].as_py()] * len(at), pa.int64()), pa.array(at.astype(np.int32)), pa.array(hashed[at]), texts], names=["doc", "pos", "hash", "words"])

    return run


def looked_up(failed: DataFrame, raw: DataFrame, window: int, seed: int, at_once: int = LOOKUP_HASHES) -> DataFrame:
    """Windows ``(doc, start, end)`` of failed spans whose words do occur earlier, found by the words themselves.

    The documents are read once for each ``at_once`` distinct hashes of such windows.
    """
    kind = "doc long, pos int, hash long, words binary"
    grouped = failed.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    asked = raw.join(grouped, F.col("__id") == F.col("doc")).select("__id", "__text", "spans")
    suspects = materialize(asked.mapInArrow(_windows(window, seed, None), kind), "suspects")
    out, rest = None, suspects
    while True:
        hashes = np.array([r.hash for r in rest.select("hash").distinct().orderBy("hash").limit(at_once).collect()], dtype=np.int64)
        if not len(hashes):
            return out if out is not None else failed.select("doc", "start", "end").limit(0)
        first = raw.mapInArrow(_windows(window, seed, hashes), kind).groupBy("words").agg(F.min(F.struct("doc", "pos")).alias("first"))
        here = rest.filter(F.col("hash") <= int(hashes[-1])).join(first, "words").filter(F.struct("doc", "pos") > F.col("first"))
        part = materialize(here.select("doc", F.col("pos").alias("start"), (F.col("pos") + window).alias("end")).distinct(), "looked_up")
        out = part if out is None else out.unionByName(part)
        rest = rest.filter(F.col("hash") > int(hashes[-1]))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, kept_text = [], [], []
        for raw, spans in zip(batch.column(1), batch.column(2)):
            words = (raw.as_py() or b"").split()
            keep = np.ones(len(words), dtype=bool)
            for x in spans.as_py() or ():
                keep[x["start"] : x["end"]] = False
            left = int(keep.sum())
            n_words.append(len(words))
            n_removed.append(len(words) - left)
            kept_text.append(b" ".join(words if left == len(words) else [words[k] for k in np.flatnonzero(keep)]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_text, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in kept_text])],
            names=["__id", "n_words", "n_removed", "kept", "kept_sha256"],
        )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED, hash_bytes: int = HASH_BYTES) -> DataFrame:
    """``(id, n_words, n_removed, kept, kept_sha256)`` for every row of ``docs``.

    ``kept`` holds the words that no later copy of a window covers, joined by one space.
    Ids are integers (TypeError for others): of two documents the one with the smaller id comes
    first. A null text has no words, and a text may be of any length. Rows without an id are neither searched nor cut. Rows that
    repeat an id count as one document: windows at the same position are one window, and each
    row is cut alike. Texts shorter than a window are never cut. Empty tables give no rows.
    """
    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} must be an integer column")
    texts = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("binary").alias("__text"))
    paths = materialize(repeated_paths(docs, id_col, text_col, window, seed, hash_bytes=hash_bytes), "paths")
    spans = materialize(repeated_spans(paths, window), "spans")
    compared = materialize(compared_spans(spans, texts), "compared")
    sure, failed = compared.filter("equal").drop("equal"), compared.filter("NOT equal").drop("equal")
    if not failed.isEmpty():
        sure = sure.unionByName(looked_up(failed, texts, window, seed))
    # one cover per document: spans that overlap need no further merging to be cut
    cover = sure.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    raw = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("binary").alias("__text"))
    kind = docs.schema[id_col].dataType.simpleString()
    joined = raw.join(cover, F.col("__id") == F.col("doc"), "left").select("__id", "__text", "spans")
    cut = joined.mapInArrow(_cut, f"__id {kind}, n_words long, n_removed long, kept binary, kept_sha256 string")
    return cut.select(F.col("__id").alias(id_col), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"), "kept_sha256")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES = {"op3_substring_dedup": op3_substring_dedup}

ORACLES = {
    "op3_substring_dedup": r"""
        WITH d AS (
          SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        win AS (SELECT doc_id, p, array_to_string(w[p : p + 19], ' ') AS g
                FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d)),
        later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS r FROM win) WHERE r > 1),
        gone AS (SELECT DISTINCT doc_id, p + k AS p FROM later, (SELECT unnest(range(0, 20)) AS k)),
        word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
        kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n
                 FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY word.doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
    """
}

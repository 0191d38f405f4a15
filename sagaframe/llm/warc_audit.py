"""Fixity audit of WARC replicas by Merkle trees.

Leaves are the hashes of a file's records, at their offsets. A range is a run of records in
order of offset; it begins at a record whose own hash says so (one of ``FANOUT`` on average), so
a record that is lost or longer in one replica moves the offsets of all that follow but not the
ranges they belong to. Records of a file that repeat one before are told apart by their count. A
node of level 0 is the hash of the hashes of a range's records, in order, a node of the
next level that of a run of ranges that is cut in the same way, and so on up to the file's root. Two
replicas are compared at their roots; only below nodes that differ does the comparison go on, and
it ends at the records that are changed, missing or extra.

A run begins at one key in ``FANOUT`` whatever the records are, so runs are short (a thousand rows come
with a chance below 1e-27) and are gathered whole. They are cut block by block (``BLOCK`` bytes of a
file) with what the blocks before leave over. Only lengths and hashes are shuffled, never records.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import shared_dir
from .common import join_checked, materialize, table

#: Records (or nodes) in a run on average, and bytes of a file whose records are put in order by one task.
FANOUT_BITS, BLOCK = 4, 64 << 20
#: Pages in a file of the query's replicas, and the date in their headers.
PAGES_PER_FILE, DATE = 500, "2024-01-01T00:00:00Z"
LEAF = "path string, offset long, uri string, record_id string, length long, hash string"


def page_uuid(ident: Column) -> Column:
    h = F.md5(F.coalesce(ident.cast("string"), F.lit("")))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def warc_record(ident: Column, url: Column, body: Column) -> Column:
    """A WARC resource record of a page, without the two line ends that close it."""
    body = F.coalesce(body, F.lit(""))
    lines = (
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), page_uuid(ident), F.lit(">\r\nWARC-Date: " + DATE + "\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body,
    )
    return F.concat(*lines)


def write_warc(records: DataFrame, path: str, by: list[str], record_col: str = "record") -> None:
    """Write records as gzipped WARC files, one in each folder of ``by``, in the order of the rows.

    All rows of a folder must be in one partition. A record's closing line ends are the text
    sink's separator; a binary record is written byte by byte."""
    rows = records.select(F.col(record_col).cast("string").alias("value"), *by)
    rows.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").partitionBy(*by).text(path)


def _inflated(data: bytes) -> bytes:
    """A gzip file of one or many members, as far as it can be read; other data as it is."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        member, at = zlib.decompressobj(31), 0
        try:
            while at < len(data) and not member.eof:
                out.append(member.decompress(data[at : at + (1 << 20)]))
                at += 1 << 20
        except zlib.error:
            break
        data = member.unused_data + data[at:]
    return b"".join(out)


def split_warc(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header fields and bytes of each record, closing line ends left off.

    Records end where their Content-Length says. One that does not end there (it was cut, or its
    header is damaged) goes on to the next record's start, or to the end of the file."""
    at, mark = 0, b"\r\n\r\n"
    while at < len(data):
        if not data.startswith(b"WARC/", at):  # no record begins here
            end = data.find(b"WARC/1.", at)
            end = end if end >= 0 else len(data)
            yield at, {}, data[at:end]
            at = end
            continue
        head = data.find(mark, at)
        lines = data[at : head if head >= 0 else len(data)].split(b"\r\n")
        fields = {k.strip().lower().decode("utf-8", "replace"): v.strip().decode("utf-8", "replace") for k, colon, v in (x.partition(b":") for x in lines[1:]) if colon}
        size = fields.get("content-length", "")
        end = head + 4 + int(size) if head >= 0 and size.isdecimal() else -1
        if end < 0 or not (data[end : end + 4] == mark and (end + 4 == len(data) or data.startswith(b"WARC/", end + 4))):
            end = data.find(mark + b"WARC/1.", at)
            end = end if end >= 0 else len(data) - 4 * data.endswith(mark)
            end = max(end, at)
        yield at, fields, data[at:end]
        at = end + 4


def read_warc(spark: SparkSession, path: str, bodies: bool = False) -> DataFrame:
    """Records of the WARC files below ``path``, gzipped or not: path, offset (in the inflated file),
    uri, record_id, length and sha256 of the record, with ``bodies`` also the ``body`` as bytes.

    A file is read whole by one task, so it must fit into its memory (and in 2 GB); an empty file
    has no records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, held = [], 0
                for at, fields, record in split_warc(_inflated(content.as_py())):
                    ident = fields.get("warc-record-id", "").strip("<>").removeprefix("urn:uuid:")
                    rows.append((where, at, fields.get("warc-target-uri", ""), ident, len(record), hashlib.sha256(record).hexdigest(), *([record.partition(b"\r\n\r\n")[2]] if bodies else [])))
                    held += len(record) if bodies else 0
                    if len(rows) == 10_000 or held > 32 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = ["path", "offset", "uri", "record_id", "length", "hash", "body"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names[: len(rows[0])])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter("length > 0").select("path", "content")
    return files.mapInArrow(run, LEAF + (", body binary" if bodies else ""))


def lay_out(records: DataFrame, file_col: str, id_col: str, order_cols: list[str], record_col: str = "record") -> DataFrame:
    """``(file, record_id, offset, length, hash)`` of records that lie in files in the given order,
    closing line ends counted. Lengths and hashes are taken first, so no record is shuffled. Records
    that tie in the order are put in order of their hashes."""
    keys = [F.col(c).alias(f"__{k}") for k, c in enumerate(order_cols)]
    small = records.select(F.col(file_col).alias("file"), F.col(id_col).alias("record_id"), *keys, F.octet_length(record_col).cast("long").alias("length"), F.sha2(record_col, 256).alias("hash"))
    before = Window.partitionBy("file").orderBy(*[f"__{k}" for k in range(len(keys))], "hash").rowsBetween(Window.unboundedPreceding, -1)
    return small.select("file", "record_id", F.coalesce(F.sum(F.col("length") + 4).over(before), F.lit(0).cast("long")).alias("offset"), "length", "hash")


def _digest() -> list[Column]:
    """Hash of a run's hashes in order, and its place."""
    run = F.sort_array(F.collect_list(F.struct("offset", "hash")))
    return [F.min("offset").alias("offset"), F.sha2(F.concat_ws(":", F.transform(run, lambda x: x["hash"])), 256).alias("hash")]


def _cut(rows: DataFrame, level: int, block: int) -> DataFrame:
    """Add ``run``, the key of the last row at or before this one that begins a run, to rows ``(replica, file, offset, key, hash)``."""
    rows = rows.withColumn("block", F.floor(F.col("offset") / (block << FANOUT_BITS * level)))
    begins = F.shiftrightunsigned("key", FANOUT_BITS * level).bitwiseAND((1 << FANOUT_BITS) - 1) == 0
    place = ["replica", "file", "block"]
    within = Window.partitionBy(*place).orderBy("offset", "hash", "key").rowsBetween(Window.unboundedPreceding, 0)
    inner = rows.withColumn("_run", F.last(F.when(begins, F.col("key")), True).over(within))
    ends = inner.groupBy(*place).agg(F.max_by("_run", F.struct("offset", "hash", "key")).alias("r"))
    over = Window.partitionBy("replica", "file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    joined = inner.join(ends.select(*place, F.last("r", True).over(over).alias("_r")), place)
    return joined.select(*[c for c in rows.columns if c != "block"], F.coalesce("_run", "_r", F.lit(0)).alias("run"))


def trees(leaves: DataFrame, block: int = BLOCK) -> list[DataFrame]:
    """The leaves and the nodes of each level, ``(replica, file, key, hash, run, …)``; ``run`` is a row's node one level up.

    Keys are unique in a file, so runs that begin with the same record stay apart and keep their order."""
    same = Window.partitionBy("replica", "file", "record_id", "hash").orderBy("offset")
    leaves = materialize(leaves.withColumn("key", F.xxhash64("record_id", "hash", F.row_number().over(same))), "leaves")  # read once, used twice
    out = [materialize(_cut(leaves, 0, block), "leaves")]
    for level in range(1, 60 // FANOUT_BITS):
        nodes = out[-1].groupBy("replica", "file", F.col("run").alias("key")).agg(*_digest())
        out.append(materialize(_cut(nodes, level, block), "merkle"))
        most = out[-1].groupBy("replica", "file").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= 1 << FANOUT_BITS:
            break
    return out


def _differing(nodes: DataFrame, *key: str) -> DataFrame:
    """Keys whose hashes differ between the replicas, or that one of them lacks."""
    side = lambda r: F.max(F.when(F.col("replica") == r, F.col("hash")))
    return nodes.groupBy(*key).agg(side("a").alias("a"), side("b").alias("b")).filter(~F.col("a").eqNullSafe(F.col("b"))).select(*key)


def suspects(levels: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Files whose roots differ, and the leaves of the ranges in which they do."""
    roots = levels[-1].groupBy("replica", "file").agg(*_digest())
    files = materialize(_differing(roots, "file"), "differing")
    bad = levels[-1].join(files, "file", "left_semi")
    for below in reversed(levels[:-1]):
        ranges = materialize(_differing(bad, "file", "key").withColumnRenamed("key", "run"), "differing")
        bad = below.join(ranges, ["file", "run"], "left_semi")
    return files, bad


def audit(a: DataFrame, b: DataFrame, block: int = BLOCK) -> DataFrame:
    """Records in which replica ``b`` differs from ``a``: ``(file, offset, offset_b, record_id, kind, …)``.

    ``a`` and ``b`` are leaves ``(file, offset, record_id, length, hash)``, as ``lay_out`` and
    ``read_warc`` give them; further columns are ignored. ``kind`` is changed, missing (only in a)
    or extra (only in b), with the offsets, lengths and hashes of both sides (-1 and empty where a
    side lacks them). One lost record is one row, however far it shifts the others. Records of a
    file and id are compared as a multiset; equal ones that are lost together are one row. A file
    with the same records in another order is one row of kind reordered. A null hash (of a null
    record) is one of its own; a null id is an id. Records without a file or an offset cannot be
    placed and are left out. Equal or empty replicas give no rows.
    """
    side = lambda df, r: df.filter("file IS NOT NULL AND offset IS NOT NULL").select(F.lit(r).alias("replica"), "file", "offset", "record_id", F.coalesce("length", F.lit(-1)).cast("long").alias("length"), F.coalesce("hash", F.lit("")).alias("hash"))
    files, bad = suspects(trees(side(a, "a").unionByName(side(b, "b")), block))
    count = lambda r: F.count_if(F.col("replica") == r)
    first = lambda r: F.min(F.when(F.col("replica") == r, F.col("offset")))
    counts = bad.groupBy("file", "record_id", "hash", "length").agg(count("a").alias("na"), count("b").alias("nb"), first("a").alias("at_a"), first("b").alias("at_b")).filter("na <> nb")
    told = counts.select("file", "record_id", (F.col("na") > F.col("nb")).alias("mine"), F.when(F.col("na") > F.col("nb"), F.col("at_a")).otherwise(F.col("at_b")).alias("at"), "length", "hash")
    told = told.withColumn("k", F.row_number().over(Window.partitionBy("file", "record_id", "mine").orderBy("at", "hash")))
    one = F.struct("at", "length", "hash")
    pairs = told.groupBy("file", "record_id", "k").agg(F.max(F.when(F.col("mine"), one)).alias("a"), F.max(F.when(~F.col("mine"), one)).alias("b"))
    number = lambda c: F.coalesce(c, F.lit(-1)).cast("long")
    kind = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("changed")
    rows = pairs.select(
        "file", number(F.coalesce("a.at", "b.at")).alias("offset"), number(F.col("b.at")).alias("offset_b"), "record_id", kind.alias("kind"),
        number(F.col("a.length")).alias("length_a"), number(F.col("b.length")).alias("length_b"), F.coalesce("a.hash", F.lit("")).alias("sha256_a"), F.coalesce("b.hash", F.lit("")).alias("sha256_b"),
    )
    rows = materialize(rows, "audit")
    same = files.join(rows.select("file").distinct(), "file", "left_anti")
    blank = {c: F.lit(None).cast(t) for c, t in rows.dtypes} | {c: F.lit(-1).cast("long") for c in ("offset", "offset_b", "length_a", "length_b")} | {"kind": F.lit("reordered"), "sha256_a": F.lit(""), "sha256_b": F.lit("")}
    return rows.unionByName(same.select(*[F.col(c) if c == "file" else blank[c].alias(c) for c in rows.columns]))


def replicas(pages: DataFrame) -> DataFrame:
    """``(replica, file, page_id, record)``: WARC records of pages, and those of a replica in which
    a hash of the id decides on harm: of 101 pages one is changed, one cut short and one lost."""
    text, body = F.col("record"), F.coalesce("html", F.lit(""))
    fate = F.conv(F.substring(F.md5(F.col("page_id").cast("string")), 1, 6), 16, 10).cast("int") % 101
    changed = F.when(F.length(body) == 0, F.replace(text, F.lit("2024-01-01T"), F.lit("2024-01-02T"))).otherwise(F.concat(F.expr("left(record, length(record) - 1)"), F.when(F.expr("right(record, 1) = '!'"), "?").otherwise("!")))
    harmed = F.when(fate == 0, changed).when(fate == 1, F.expr("left(record, length(record) - 7)")).when(fate != 2, text)
    pages = pages.filter("page_id IS NOT NULL").select("page_id", "url", "html", F.floor(F.col("page_id") / PAGES_PER_FILE).alias("file"))
    rows = pages.repartition("file").withColumn("record", warc_record(F.col("page_id"), F.col("url"), F.col("html")))
    both = F.explode(F.array(F.struct(F.lit("a").alias("replica"), text.alias("record")), F.struct(F.lit("b").alias("replica"), harmed.alias("record"))))
    return rows.select("file", "page_id", both.alias("x")).select("x.replica", "file", "page_id", "x.record").filter("record IS NOT NULL")


def op7_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write two replicas of all pages as WARC files, read them back and audit them."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    root = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(replicas(pages).sortWithinPartitions("replica", "file", "page_id", F.xxhash64("record")), root, ["replica", "file"])
    sides = [read_warc(spark, f"{root}/replica={r}").withColumn("file", F.regexp_extract("path", r"/file=(\d+)/", 1).cast("long")) for r in "ab"]
    found = materialize(audit(*sides), "found")
    ids = pages.filter("page_id IS NOT NULL").select("page_id", page_uuid(F.col("page_id")).alias("record_id")).distinct()
    named = join_checked(ids, found, "record_id", "inner")
    return named.select("file", "offset", "offset_b", F.col("page_id").alias("record_id"), "kind", "length_a", "length_b", "sha256_a", "sha256_b")


QUERIES = {"op7_warc_audit": op7_warc_audit}

ORACLES = {
    "op7_warc_audit": r"""
        WITH p AS (
          SELECT page_id, page_id // 500 AS file, md5(page_id::VARCHAR) AS h, coalesce(url, '') AS url, coalesce(html, '') AS body FROM pages WHERE page_id IS NOT NULL),
        r AS (
          SELECT page_id, file, body, ('0x' || substr(h, 1, 6))::INT % 101 AS fate,
                 concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10), 'WARC-Record-ID: <urn:uuid:',
                        substr(h, 1, 8), '-', substr(h, 9, 4), '-', substr(h, 13, 4), '-', substr(h, 17, 4), '-', substr(h, 21, 12),
                        '>', chr(13), chr(10), 'WARC-Date: 2024-01-01T00:00:00Z', chr(13), chr(10), 'WARC-Target-URI: ', url, chr(13), chr(10),
                        'Content-Type: text/html', chr(13), chr(10), 'Content-Length: ', strlen(body), chr(13), chr(10), chr(13), chr(10), body) AS record
          FROM p),
        h AS (SELECT *, CASE WHEN fate = 0 AND body = '' THEN replace(record, '2024-01-01T', '2024-01-02T')
                             WHEN fate = 0 THEN left(record, length(record) - 1) || CASE WHEN right(record, 1) = '!' THEN '?' ELSE '!' END
                             WHEN fate = 1 THEN left(record, length(record) - 7) WHEN fate <> 2 THEN record END AS other FROM r),
        o AS (SELECT *, coalesce(sum(strlen(record) + 4) OVER w, 0)::BIGINT AS pos, coalesce(sum(strlen(other) + 4) OVER w, 0)::BIGINT AS pos_b
              FROM h WINDOW w AS (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT file, pos AS "offset", CASE WHEN fate = 2 THEN -1 ELSE pos_b END::BIGINT AS offset_b, page_id AS record_id, CASE WHEN fate = 2 THEN 'missing' ELSE 'changed' END AS kind,
               strlen(record)::BIGINT AS length_a, coalesce(strlen(other), -1)::BIGINT AS length_b, sha256(record) AS sha256_a, coalesce(sha256(other), '') AS sha256_b
        FROM o WHERE fate < 3
    """
}

"""A Merkle manifest of a dataset, with nested-interval labels.

Every row is a leaf with a rank in its tree (the rows of one language, say). A node carries the
interval of leaf ranks that it covers, and ``FAN`` consecutive nodes of a level, a run, become
one node of the next. Intervals nest, so the ancestor of a node at a level is the one node there
whose interval contains the node's own. As a level's intervals begin at multiples of a power of
``FAN``, such a containment join has that multiple as its bucket. Ancestors are attached level
by level from the top, and what a parent's interval has beyond a node's own are its siblings,
whose digests are the node's part of the proof. The trees' roots are the leaves of one more
tree, built and walked by the same code.

Ranks come from a range partitioning and counts by partition, so no tree is gathered; a run has
``FAN`` nodes at most, and every bucket holds one node and its run.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import crc32_sql, join_checked, materialize, table

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<before:string,after:string>>"


def digest_of(*fields: Column) -> Column:
    """SHA-256 of fields, each ``-`` if null, else its length in bytes, a colon and the value."""
    told = (f.cast("string") for f in fields)
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in told]), 256)


def _ranked(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Add ``lo`` (the rank within ``tree``, from 0) and ``n`` (the tree's leaves)."""
    laid = leaves.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    laid = materialize(laid.withColumn("__at", F.monotonically_increasing_id()), "leaves")
    part = F.shiftright("__at", 33).alias("__part")
    counts = laid.groupBy("tree", part).agg(F.count(F.lit(1)).alias("k"), F.min("__at").alias("first"))
    before = Window.partitionBy("tree").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("tree")
    offsets = counts.select("tree", "__part", (F.coalesce(F.sum("k").over(before), F.lit(0)) - F.col("first")).alias("__off"), F.sum("k").over(whole).alias("n"))
    placed = join_checked(laid.withColumn("__part", part), materialize(offsets, "offsets"), ["tree", "__part"], "inner")
    return placed.withColumn("lo", F.col("__at") + F.col("__off")).drop("__at", "__part", "__off")


def _runs(nodes: DataFrame, level: int, fan: int, carried: list[str]) -> DataFrame:
    """Nodes of ``level`` from those below: ``(tree, n, lo, hi, digest, children)``, children in order."""
    children = F.sort_array(F.collect_list(F.struct("lo", "hi", "digest", *carried)))
    runs = nodes.groupBy("tree", "n", F.floor(F.col("lo") / F.lit(fan**level)).alias("bucket")).agg(children.alias("children"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    digest = F.sha2(F.concat_ws("", F.transform("children", lambda c: c["digest"])), 256)
    return runs.select("tree", "n", "lo", "hi", digest.alias("digest"), "children")


def build(leaves: DataFrame, fan: int = FAN, carried: list[str] | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """The roots ``(tree, n, digest)`` of ranked leaves ``(tree, n, lo, digest, …)``, and the runs of each level.

    The list holds the runs of levels 1, 2 and so on, each with its children; of the leaves the
    ``carried`` columns go along. A tree of one leaf has that leaf as its root and no runs."""
    carried = carried or []
    level, nodes, levels, roots = 0, leaves.withColumn("hi", F.col("lo")), [], []
    most = leaves.agg(F.max("n")).first()[0] or 0
    while True:
        roots.append(nodes.filter(F.col("n") <= fan**level).filter(F.col("n") > fan ** (level - 1) if level else F.lit(True)).select("tree", "n", "digest"))
        if most <= fan**level:
            return reduce(DataFrame.unionByName, roots), levels
        below = nodes.filter(F.col("n") > fan**level).select("tree", "n", "lo", "hi", "digest", *(carried if not level else []))
        level += 1
        levels.append(materialize(_runs(below, level, fan, carried if level == 1 else []), f"level{level}"))
        nodes = levels[-1].drop("children")


def _siblings(run: Column, own: Column) -> Column:
    """What the run's interval has beyond the node's own, as the digests before it and those after it."""
    joined = lambda keep: F.array_join(F.transform(F.filter(run, keep), lambda c: c["digest"]), "")
    return F.struct(joined(lambda c: c["hi"] < own["lo"]).alias("before"), joined(lambda c: c["lo"] > own["hi"]).alias("after"))


def attach(roots: DataFrame, leaves: DataFrame, levels: list[DataFrame], fan: int = FAN, carried: list[str] | None = None) -> DataFrame:
    """``(tree, digest, path, …)`` for every leaf: its siblings at each level, from its own up to ``path`` of its root.

    ``roots`` is ``(tree, n, path, …)``; its further columns and the leaves' ``carried`` ones go along."""
    carried, told = carried or [], [c for c in roots.columns if c not in ("tree", "n", "path")]
    here = None  # nodes of a level with all that is above them
    for level in range(len(levels), 0, -1):
        runs = levels[level - 1].drop("digest")
        top = roots.filter((F.col("n") <= fan**level) & (F.col("n") > fan ** (level - 1)))
        top = top.select("tree", F.lit(0).cast("long").alias("a_lo"), (F.col("n") - 1).alias("a_hi"), "path", *told)
        above = top if here is None else top.unionByName(here.select("tree", F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"), "path", *told))
        bucket = lambda c: F.floor(F.col(c) / F.lit(fan**level))  # noqa: E731, B023
        above, runs = above.withColumn("bucket", bucket("a_lo")), runs.withColumn("bucket", bucket("lo"))
        inside = above.join(runs, ["tree", "bucket"]).filter((F.col("a_lo") <= F.col("lo")) & (F.col("hi") <= F.col("a_hi")))
        own = inside.select("tree", "n", "path", "children", *told, F.explode("children").alias("own"))
        columns = [F.col("own")[c].alias(c) for c in ("lo", "hi", "digest", *(carried if level == 1 else []))]
        here = own.select("tree", "n", F.concat(F.array(_siblings(F.col("children"), F.col("own"))), "path").alias("path"), *told, *columns)
    lone = roots.filter("n = 1").select("tree", "path", *told).join(leaves.filter("n = 1").select("tree", "digest", *carried), "tree")
    columns = ["tree", "digest", "path", *told, *carried]
    return lone.select(*columns) if here is None else here.select(*columns).unionByName(lone.select(*columns))


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf digest and the siblings on its path make."""
    return F.aggregate(path, digest, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))


def manifest(docs: DataFrame, id_col: str = "doc_id", tree_col: str = "lang", fields: tuple[str, ...] = FIELDS, fan: int = FAN, seen: Column | None = None) -> DataFrame:
    """``(id, leaf, subroot, root, proof_sha256, folded_root, verified)`` for every row of ``docs``.

    A leaf is the digest of ``fields``; the leaves of a ``tree_col`` value ascend by id (null
    ids first, equal ids by their leaves) and make a subtree, and the subtrees' roots, by that
    value, make the tree. ``seen`` is a digest that replaces a row's leaf when it is verified (null: as it
    was), such as that of a copy to be audited. Null fields and empty ones have different digests,
    and null is a tree of its own. Rows may repeat, texts may be of any length, and further
    columns are ignored. An empty table has no root and gives no rows.
    """
    kind = docs.schema[id_col].dataType
    tree = F.coalesce(F.concat(F.lit("="), F.col(tree_col).cast("string")), F.lit("-"))  # null sorts first
    leaves = docs.select(tree.alias("tree"), F.col(id_col).alias("id"), digest_of(*[F.col(f) for f in fields]).alias("digest"), (F.lit(None).cast("string") if seen is None else seen).alias("seen"))
    leaves = _ranked(materialize(leaves, "digests"), ["id", "digest"])  # the range partitioning reads them twice
    carried = ["id", "seen"]
    subroots, levels = build(leaves, fan, carried)
    tops = _ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("n").alias("size"), "digest"), ["name"])
    root, top_levels = build(tops, fan, ["name", "size"])
    root = materialize(root.select("tree", "n", F.array().cast(_PATH).alias("path"), F.col("digest").alias("root")), "root")
    named = attach(root, tops, top_levels, fan, ["name", "size"])
    paths = materialize(named.select(F.col("name").alias("tree"), F.col("size").alias("n"), "path", F.col("digest").alias("subroot"), "root"), "subroots")
    out = attach(paths, leaves, levels, fan, carried)
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), ""), 256)
    out = out.select(F.col("id").cast(kind).alias(id_col), F.col("digest").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded(F.coalesce("seen", "digest"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


@F.arrow_udf(StringType())
def _lowered(text: pa.Array) -> pa.Array:
    """A-Z in small letters."""
    return pc.ascii_lower(text)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    changed = digest_of(*[_lowered(F.when(tampered, F.col("text"))) if f == "text" else F.col(f) for f in FIELDS])
    return manifest(docs, seen=F.when(tampered, changed))


QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}


def _sql(levels: int = 8, top_levels: int = 3, fan: int = FAN) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    field = lambda e: f"coalesce(strlen({e}) || ':' || {e}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(e) for e in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"
    parts = [
        f"crc AS ({crc32_sql()[0]})",
        f"leaf AS (SELECT doc_id, lang, h, seen, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM (SELECT doc_id, lang, {leaf('text')} AS h,"
        f" CASE WHEN {crc32_sql('doc_id::VARCHAR')[1]} % 3 = 0 THEN {leaf(f"translate(text, '{upper}', '{lower}')")} END AS seen FROM documents, crc))",
        "n0 AS (SELECT lang AS g, pos, h, n FROM leaf)",
    ]

    def climb(n: str, r: str, count: int) -> None:
        for k in range(count):
            parts.append(f"{r}{k} AS (SELECT g, pos // {fan} AS pos, n, list(h ORDER BY pos) AS hs FROM {n}{k} GROUP BY ALL)")
            parts.append(f"{n}{k + 1} AS (SELECT g, pos, CASE WHEN n > {fan**k} THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h, n FROM {r}{k})")

    def walk(f: str, r: str, count: int, key: str) -> None:
        for k in range(count):
            at = f"(f.{key} // {fan**k}) % {fan}"
            before, after = f"array_to_string(r.hs[1:{at}], '')", f"array_to_string(r.hs[{at} + 2:], '')"
            on = f"r.g IS NOT DISTINCT FROM f.{'lang' if key == 'pos' else 'one'} AND r.pos = f.{key} // {fan ** (k + 1)}"
            size = "n" if key == "pos" else "m"
            parts.append(
                f"{f}{k + 1} AS (SELECT f.* EXCLUDE (fold, proof), CASE WHEN f.{size} > {fan**k} THEN sha256({before} || fold || {after}) ELSE fold END AS fold,"
                f" CASE WHEN f.{size} > {fan**k} THEN proof || {before} || {after} ELSE proof END AS proof FROM {f}{k} f JOIN {r}{k} r ON {on})"
            )

    climb("n", "r", levels)
    parts.append(f"sub AS (SELECT g AS lang, h AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS rank, count(*) OVER () AS m FROM n{levels})")
    parts.append("t0 AS (SELECT 1 AS g, rank AS pos, subroot AS h, m AS n FROM sub)")
    climb("t", "q", top_levels)
    parts.append("f0 AS (SELECT l.doc_id, l.lang, l.pos, l.n, l.h AS leaf, s.subroot, s.rank, s.m, 1 AS one, coalesce(seen, h) AS fold, '' AS proof FROM leaf l JOIN sub s ON l.lang IS NOT DISTINCT FROM s.lang)")
    walk("f", "r", levels, "pos")
    parts.append(f"e0 AS (SELECT * FROM f{levels})")
    walk("e", "q", top_levels, "rank")
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = t.h AS verified FROM e{top_levels}, t{top_levels} t"


ORACLES = {"op13_merkle_manifest": _sql()}

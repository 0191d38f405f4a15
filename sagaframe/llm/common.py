"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import written

#: A word is a run of characters other than space, \t, \n, \v, \f and \r.
WORD_BREAK = r"[\x20\x09-\x0D]+"

#: Rows up to which an aggregated side of a join may be broadcast (checked by a count).
BROADCAST_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs a read and not a recomputation, and
    lets several consumers share one costly computation.
    """
    return written(df, label)


def join_checked(big: DataFrame, small: DataFrame, on: list[str] | str, how: str = "left") -> DataFrame:
    """Join a materialised aggregate to a large table; broadcast it only if a count shows it small."""
    if small.count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    return big.join(small, on, how)


#: A key with more rows than this, and than a thousandth of all, is a hub.
HUB = 1000


def join_spread(rows: DataFrame, told: DataFrame, key: str, values: list[str], total: int) -> DataFrame:
    """Join ``values`` of ``told(key, values, n)``, one row a key, to ``rows``, of which ``n`` have the key and ``total`` any.

    The rows of a hub are not brought together: there can be a thousand hubs at most, whatever
    ``total`` is, so what is told of them is broadcast. Only the rows of other keys are shuffled."""
    hub = F.col("n") > max(HUB, total // HUB)
    hubs = told.filter(hub).select(key, F.struct(*values).alias("__hub"))
    marked = rows.join(F.broadcast(hubs), key, "left")
    near = marked.filter("__hub IS NULL").drop("__hub").join(told.filter(~hub).select(key, *values), key)
    far = marked.filter("__hub IS NOT NULL").select(*rows.columns, *[F.col("__hub")[v].alias(v) for v in values])
    return near.select(*far.columns).unionByName(far)


def words_of(text: Column) -> Column:
    """Words of a text, in order; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda x: x != "")


def crc32_sql(text: str = "x") -> tuple[str, str]:
    """For oracle SQL, which has no CRC-32: a query of one row, the table ``t`` of its 256 values, and the checksum of ``text`` by it."""
    values = "SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) AS v FROM range(256) r(n))"
    octets = f"list_transform(range(1, strlen({text}) + 1), lambda i: ('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::BIGINT)"
    return values, f"xor(list_reduce({octets}, lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295)"

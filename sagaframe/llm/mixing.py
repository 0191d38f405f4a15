"""Mixing sources to target weights by Poisson replication.

A source's target share of the mixture gives its mean repetition rate. Each document's number
of copies is the inverse of a Poisson distribution with that mean at a number in (0, 1) that
a seeded hash of its id gives, so it is random but always the same. Documents are exploded by
their counts, and all copies are dealt out by a hash of document and copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize, table

ALPHA, SEED = 0.7, 17


def source_rates(docs: DataFrame, source_col: str = "source", text_col: str = "text", weights: dict | None = None, alpha: float = ALPHA) -> DataFrame:
    """``(src, rate, cdf)``, one row a source; ``cdf[k]`` is the chance of at most k copies.

    A source's size is the number of its characters, and one more for each document. Weights
    are given by source (missing sources get 0), or else are the size to the power ``alpha``;
    the mixture is as large as the input. The distribution reaches ten standard deviations
    and forty counts beyond its mean, where nothing of it is left in double precision.
    """
    size = F.sum(F.coalesce(F.length(text_col), F.lit(0)).cast("long") + 1)
    sizes = materialize(docs.groupBy(F.col(source_col).alias("src")).agg(size.alias("size")), "sources")
    if weights is None:
        weight: Column = F.pow(F.col("size").cast("double"), F.lit(alpha))
    else:
        given = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else None
        weight = F.coalesce(given[F.col("src")].cast("double"), F.lit(0.0)) if given is not None else F.lit(0.0)
    weighed = sizes.withColumn("weight", weight)
    total, whole = weighed.agg(F.sum("size"), F.sum("weight")).first()
    rate = F.col("weight") * F.lit(float(total or 0)) / F.lit(float(whole or 1.0)) / F.col("size")
    rated = weighed.withColumn("rate", rate)
    most = F.ceil(F.col("rate") + 10 * F.sqrt("rate") + 40).cast("int")
    # terms in logarithms, as the first underflows for large means
    start = F.struct((-F.col("rate")).alias("term"), F.exp(-F.col("rate")).alias("sum"), F.array(F.exp(-F.col("rate"))).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] + F.ln("rate") - F.ln(k.cast("double"))
        total = acc["sum"] + F.exp(term)
        return F.struct(term.alias("term"), total.alias("sum"), F.concat(acc["all"], F.array(total)).alias("all"))

    cdf = F.when(F.col("rate") > 0, F.aggregate(F.sequence(F.lit(1), most), start, step)["all"]).otherwise(F.array(F.lit(1.0)))
    return materialize(rated.select("src", "rate", cdf.alias("cdf")), "rates")


def _hashed(*parts: Column) -> Column:
    """52 bits of a seeded hash, as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: dict | None = None, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as its count says, with ``copy``, ``rate`` and ``shuffle_key``.

    Rows come dealt over the shuffle partitions by ``shuffle_key`` and sorted by it, which is
    a random order of the mixture. Rows that repeat an id get the same count; a null id is
    hashed as the word null; null sources are one source; a null text has no characters.
    Columns named like the added ones are replaced, others stay whatever their names. Texts may be of
    any length; one is repeated as a whole. An empty table gives no rows.
    """
    added = ("copy", "rate", "shuffle_key")
    rates = source_rates(docs, source_col, text_col, weights, alpha)
    if rates.count() <= BROADCAST_ROWS:
        rates = F.broadcast(rates)
    kept = [c for c in docs.columns if c not in added]
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = docs.select(F.struct(*kept).alias("__row"), F.col(source_col).alias("__src"), F.col(id_col).alias("__id"), ident.alias("__ident"))
    u = (_hashed(F.lit(str(seed)), F.col("__ident")) + 0.5) / F.lit(float(2**52))
    rated = rows.join(rates, F.col("__src").eqNullSafe(F.col("src"))).withColumn("__n", F.size(F.filter("cdf", lambda c: c < u)))
    copies = rated.filter("__n > 0").select("__row", "__id", "__ident", "rate", F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("copy"))
    keyed = copies.withColumn("shuffle_key", _hashed(F.lit(str(seed)), F.col("__ident"), F.col("copy").cast("string")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition(parts, "shuffle_key").sortWithinPartitions("shuffle_key", "__id", "copy")
    return dealt.select(*[F.col("__row")[c].alias(c) for c in kept], "rate", "copy", "shuffle_key")


def op6_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


QUERIES = {"op6_poisson_mixing": op6_poisson_mixing}

ORACLES = {
    "op6_poisson_mixing": """
        WITH size AS (SELECT source, sum(coalesce(length(text), 0) + 1)::DOUBLE AS s FROM documents GROUP BY source),
        rates AS (SELECT source, pow(s, 0.7) * (SELECT sum(s) FROM size) / (SELECT sum(pow(s, 0.7)) FROM size) / s AS rate FROM size),
        terms AS (SELECT source, rate, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p
                  FROM (SELECT source, rate, unnest(range(0, ceil(rate + 10 * sqrt(rate) + 40)::INT + 1)) AS k FROM rates)),
        cdf AS (SELECT source, rate, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
        docs AS (SELECT *, (('0x' || substr(md5('17:' || doc_id), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u FROM documents),
        counted AS (SELECT d.doc_id, d.source, d.text, any_value(rate) AS rate, count(*) FILTER (WHERE c < u) AS n
                    FROM docs d JOIN cdf ON d.source = cdf.source GROUP BY d.doc_id, d.source, d.text)
        SELECT doc_id, source, text, rate, copy::INT AS copy, ('0x' || substr(md5('17:' || doc_id || ':' || copy), 1, 13))::BIGINT AS shuffle_key
        FROM (SELECT *, unnest(range(1, n + 1)) AS copy FROM counted WHERE n > 0)
    """
}

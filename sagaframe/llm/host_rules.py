"""Quality rules with host-level verdicts, in DataFrame functions only.

Each document gets its counts and a base verdict. Base failures are summed by host, each
host's failure rate is shrunk towards a beta prior that is fitted to all hosts (method of
moments), and the host's verdict is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_checked, materialize, table, words_of

#: Characters that count as symbols (fixed by the contract).
SYMBOLS = "#*$%&|<>"

#: Columns that ``document_counts`` adds, and those that the verdicts add.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
VERDICTS = ("host_docs", "host_fails", "host_rate", "host_failed", "kept")

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _repeat_words(words: Column, n: Column) -> Column:
    """Words that lie in three-word windows found at least twice in the text."""
    hashes = F.when(
        n >= 3,
        F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))),
    )
    return F.sort_array(hashes)


def document_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Replace the text by n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Windows are compared by a 64-bit hash of their three words within one document. Other columns
    stay, whatever their names, but for those with the names of the added ones.
    """
    others = [c for c in docs.columns if c != text_col and c not in COUNTS]
    row = (F.struct(*others) if others else F.lit(None)).alias("__row")
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = docs.select(
        row,
        words_of(F.col(text_col)).alias("__w"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
    )
    w = F.col("__w")
    step = step.withColumn("__s", _repeat_words(w, F.size(w)))
    s = F.col("__s")
    same = lambda x, i: F.coalesce(x["h"] == F.get(s, i)["h"], F.lit(False))
    twice = F.filter(s, lambda x, i: same(x, i + 1) | same(x, i - 1))
    step = step.withColumn("__p", F.sort_array(F.transform(twice, lambda x: x["i"])))
    p = F.col("__p")
    covered = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    out = step.select(
        "__row",
        F.size(w).cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.select(*[F.col("__row")[c].alias(c) for c in others], *COUNTS[:-1], failed.alias("base_failed"))


def host_verdicts(checked: DataFrame, host_col: str, max_fail_rate: float = 0.5, weak_prior: float = 2.0) -> DataFrame:
    """Per host: documents, failures, the shrunk failure rate and ``host_failed``.

    The prior's strength is m(1-m)/v - 1 with the mean m and the variance v of the hosts'
    rates; where the rates do not vary, or vary more than a beta distribution can,
    ``weak_prior`` pseudo-documents stand in.
    """
    hosts = materialize(
        checked.filter(F.col(host_col).isNotNull()).groupBy(host_col).agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_fails")),
        "hosts",
    )
    rate = F.col("host_fails") / F.col("host_docs")
    k, mean, var = hosts.agg(F.count(F.lit(1)), F.avg(rate), F.var_pop(rate)).first()
    strength = weak_prior
    if k and var and 0 < var < mean * (1 - mean):
        strength = mean * (1 - mean) / var - 1
    posterior = (F.col("host_fails") + F.lit(float(strength * (mean or 0.0)))) / (F.col("host_docs") + F.lit(float(strength)))
    return hosts.withColumn("host_rate", posterior).withColumn("host_failed", F.col("host_rate") > max_fail_rate)


def quality_rules(docs: DataFrame, host_col: str = "source", text_col: str = "text", max_fail_rate: float = 0.5) -> DataFrame:
    """Counts, base verdict, host figures and ``kept`` for every document.

    A null text has no words and fails the base rule; a text may be of any length, and is counted
    within its row; an empty table gives no rows. Documents without a host have no host
    verdict: the base verdict alone decides. Copies and repeated rows are judged like any
    other row and count in their host. Columns of the input stay, but for the text and those
    with the names of the added columns.
    """
    if host_col in (*COUNTS, *VERDICTS):
        raise ValueError(f"{host_col} is the name of an added column")
    source = docs.select(*[c for c in docs.columns if c not in VERDICTS or c == text_col])
    checked = materialize(document_counts(source, text_col), "quality")
    verdicts = host_verdicts(checked, host_col, max_fail_rate)
    joined = join_checked(checked, verdicts, host_col, "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False)))


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op4_host_rules": op4_host_rules}

ORACLES = {
    "op4_host_rules": r"""
        WITH w AS (
          SELECT doc_id, source, coalesce(text, '') AS text,
                 list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
                 list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
          FROM documents),
        win AS (SELECT doc_id, i, struct_pack(a := words[i], b := words[i + 1], c := words[i + 2]) AS g
                FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
        rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
        cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
        base AS (
          SELECT w.doc_id, source, len(words)::BIGINT AS n_words,
                 length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
                 length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                 (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
                 coalesce(cov.n, 0)::BIGINT AS n_repeat_words
          FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
        judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
        host AS (SELECT source, count(*) AS d, sum(base_failed::INT)::DOUBLE AS f FROM judged WHERE source IS NOT NULL GROUP BY source),
        prior AS (SELECT avg(f / d) AS m, CASE WHEN var_pop(f / d) > 0 AND var_pop(f / d) < avg(f / d) * (1 - avg(f / d))
                         THEN avg(f / d) * (1 - avg(f / d)) / var_pop(f / d) - 1 ELSE 2.0 END AS s FROM host)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND NOT coalesce((f + s * m) / (d + s) > 0.5, false) AS kept
        FROM judged LEFT JOIN host ON judged.source = host.source CROSS JOIN prior
    """
}

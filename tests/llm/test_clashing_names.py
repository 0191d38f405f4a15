"""Every operator and stage on a table whose further columns bear the names that the operators use and add."""

import ast
import inspect

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sagaframe.llm import bpe, chat_format, exact_dedup, host_rules, html_text, manifest, minhash, mixing, resampling, simhash, substring_dedup, toxicity, warc_audit

BASE = ("doc_id", "text", "lang", "source", "n_chars")
MODULES = (bpe, exact_dedup, host_rules, manifest, minhash, mixing, resampling, simhash, substring_dedup, toxicity)
PLAIN = set(__import__("builtins").__dict__) | set(BASE)


def names():
    """Every string of a module that could be a column."""
    found = {n.value for m in MODULES for n in ast.walk(ast.parse(inspect.getsource(m))) if isinstance(n, ast.Constant) and isinstance(n.value, str)}
    return sorted({x.lower(): x for x in found if x.isidentifier() and x.lower() not in PLAIN}.values())


@pytest.fixture(scope="module")
def both(spark):
    rows = [(k, f"Some words {k % 5} that are repeated here and there", "en", f"s{k % 2}", k) for k in range(12)]
    rows += [(20, None, None, None, None), (None, "", "en", "s1", 0), (7, "twice", "en", "s0", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2)
    return docs, docs.select(*BASE, *[F.lit("x").alias(n) for n in names() if n not in BASE])


OPERATORS = {
    "simhash": simhash.near_duplicates,
    "minhash": minhash.near_duplicates,
    "host_rules": host_rules.quality_rules,
    "mixing": mixing.mix_sources,
    "exact_dedup": exact_dedup.exact_dedup,
    "bpe": bpe.encode_documents,
    "manifest": manifest.manifest,
    "resampling": lambda docs: resampling.resample(docs, docs),
    "toxicity": lambda docs: toxicity.score_toxicity(docs, toxicity.Model()),
    "substring": lambda docs: substring_dedup.remove_repeats(docs.filter("doc_id IS NOT NULL")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operators_do_not_mind_names(both, name):
    plain, odd = both
    assert len(odd.columns) > 100
    want = OPERATORS[name](plain)
    got = OPERATORS[name](odd).select(*want.columns)
    order = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert order(got) == order(want)


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES[1:]])
def test_stages_do_not_mind_names(spark, both, stage):
    plain, odd = both
    f = dict(corpus_pipeline.STAGES)[stage]
    want, got = f(spark, plain, None), f(spark, odd, None)
    if stage != "bpe_codec":
        assert got.columns == odd.columns
    order = lambda df: sorted(map(tuple, df.select(*want.columns).collect()), key=repr)
    assert order(got) == order(want)


def test_replicas_and_chats_do_not_mind_names(spark):
    odd = [F.lit("x").alias(n) for n in ("__id", "key", "run", "block", "replica", "hash2", "file2", "turns", "record", "n")]
    leaves = spark.createDataFrame([(0, k * 10, f"r{k}", 5, f"h{k}") for k in range(40)], "file int, offset long, record_id string, length long, hash string")
    other = leaves.filter("offset <> 50")
    got = warc_audit.audit(leaves.select("*", *odd), other.select("*", *odd)).collect()
    assert [(r.record_id, r.kind) for r in got] == [("r5", "missing")]
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "ho")], "conv_id long, turn int, role string, text string")
    assert chat_format.format_chats(turns.select("*", *odd)).count() == 1
    pages = spark.createDataFrame([(1, "u", "<p>a<p>b")], "page_id long, url string, html string")
    assert html_text.extract_text(pages.select("*", *odd)).count() == 1

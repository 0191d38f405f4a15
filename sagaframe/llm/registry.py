"""Queries and oracle SQL of the corpus operators."""

from __future__ import annotations

from . import bpe, chat_format, exact_dedup, host_rules, html_text, manifest, minhash, mixing, resampling, simhash, substring_dedup, toxicity, warc_audit

MODULES = (html_text, simhash, substring_dedup, host_rules, toxicity, mixing, warc_audit, exact_dedup, bpe, chat_format, minhash, resampling, manifest)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}

"""Registered queries of the engine, with the SQL that checks them."""

from . import graph_queries, ledger_queries, text_queries, tool_queries, vector_queries  # noqa: F401
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)

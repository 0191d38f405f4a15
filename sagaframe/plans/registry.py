"""Named queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from .model import oracle

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *tables: str) -> Callable:
    """Register a function of (spark, sf_dir); ``sql`` may use the model's ``tables``."""

    def register(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = oracle(sql, *tables)
        return f

    return register

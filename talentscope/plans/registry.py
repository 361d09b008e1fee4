"""Registry of named queries: key → (Spark callable, optional DuckDB oracle)."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    """Decorator: ``fn(spark, sf_dir) -> DataFrame`` registered under ``key``."""
    def wrap(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn
    return wrap

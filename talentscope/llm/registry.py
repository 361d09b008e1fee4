"""Registry of this folder's queries and their DuckDB oracles."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn
    return wrap

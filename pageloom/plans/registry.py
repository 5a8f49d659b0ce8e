"""Queries and their SQL by name; a name is taken once."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    if name in QUERIES:
        raise ValueError(f"a query {name} exists")

    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add

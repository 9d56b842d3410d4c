"""The registry that the query modules of this folder fill; catalog imports them all."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function under a name, with its DuckDB oracle where SQL can express it."""

    def put(function):
        assert name not in QUERIES, name
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return put

"""Registration of queries and of the DuckDB text that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from orrery.sources.tables import CTE

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
#: Survey ids that each query covers.
COVERS: dict[str, tuple[str, ...]] = {}


def with_(*names: str) -> str:
    """The encoded relations as common table expressions; what follows may add more after a comma."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({CTE[n]})" for n in names) + " "


def query(name: str, *covers: str, sql: str | None = None):
    """Register ``f(spark, sf_dir)``; ``sql`` is None where SQL can't express it."""

    def put(f):
        assert name not in QUERIES, name
        QUERIES[name], COVERS[name] = f, covers
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put

"""All registered queries and their SQL."""

from __future__ import annotations

from importlib import import_module

from .register import COVERS, ORACLES, QUERIES

for _module in ("graph", "text", "joins", "linkers", "closures", "logs", "coverage", "clusters", "flows", "ingest"):
    import_module(f"orrery.plans.{_module}")

__all__ = ["COVERS", "ORACLES", "QUERIES"]

"""The registered queries, by topic."""

from __future__ import annotations

from importlib import import_module

from quillon.registry import ORACLES, QUERIES, QueryFn

MODULES = ("tpch", "relational", "text", "aggregates", "windows", "api")


def load() -> tuple[dict[str, QueryFn], dict[str, str]]:
    """Import every module of queries; gives the queries and their SQL."""
    for m in MODULES:
        import_module(f"{__name__}.{m}")
    return QUERIES, ORACLES

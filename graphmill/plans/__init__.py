"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per name, and SQL for each that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: Modules of this package that hold ``QUERIES`` and ``SQL``.
MODULES = ("keys", "graph_queries", "text_queries")


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        merged |= getattr(import_module(f"{__name__}.{name}"), attribute)
    return merged


def all_queries() -> dict:
    return _merged("QUERIES")


def all_sql() -> dict:
    return _merged("SQL")

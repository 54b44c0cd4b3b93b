"""Registered narration queries: name -> (callable, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_MODULES: tuple[str, ...] = ("text_queries", "timing_queries", "document_queries", "script_queries", "reply_queries", "catalog_queries", "workdir_queries", "bookkeeping_queries", "artifact_queries", "delivery_queries", "report_queries")


def _entries() -> dict[str, tuple[Query, str | None]]:
    from importlib import import_module

    found: dict[str, tuple[Query, str | None]] = {}
    for name in _MODULES:
        found |= import_module(f"lectern.plans.{name}").QUERIES
    return found


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _entries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _entries().items() if sql}

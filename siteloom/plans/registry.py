"""Name -> query and name -> checking SQL, filled by the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siteloom.plans.tables import with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query; ``oracle`` may refer to landed and derived tables as ``{name}``."""
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = with_tables(oracle)
        return fn
    return add


def load_all() -> None:
    """Import every module that registers queries."""
    from siteloom.plans import (  # noqa: F401
        audit_queries, capture_queries, content_queries, export_queries, history_queries, keyword_queries, link_queries, search_queries, site_queries,
        small_queries, stream_queries)

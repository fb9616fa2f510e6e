"""Name -> query and name -> checking SQL of this folder; ``load_all`` imports the modules that register them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query over the tables of a folder."""
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add


def load_all() -> None:
    from siteloom.llm import queries  # noqa: F401


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One landed table, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Keyed merge with a policy per column."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def merge_upsert(base: DataFrame, updates: DataFrame, keys: list[str], policy: dict[str, str], order: str) -> DataFrame:
    """Fold ``updates`` (in ``order``) into ``base``; one union and one aggregate, no join.

    Policies: add (sum), keep (last value that is not null), first (first value that is not null), overwrite (last row).
    """
    cols = [*keys, *policy]
    old = base.select(*cols, F.lit(0).alias("__late"), F.lit(None).cast(updates.schema[order].dataType).alias("__at"))
    new = updates.select(*cols, F.lit(1).alias("__late"), F.col(order).alias("__at"))
    at = F.struct("__late", "__at")
    fold = {
        "add": lambda n: F.sum(n), "keep": lambda n: F.max_by(n, F.when(F.col(n).isNotNull(), at)),
        "first": lambda n: F.min_by(n, F.when(F.col(n).isNotNull(), at)), "overwrite": lambda n: F.max_by(n, at),
    }
    return old.unionByName(new).groupBy(*keys).agg(*[fold[p](n).alias(n) for n, p in policy.items()])

"""Row numbers over a whole table in a given order, without gathering it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from siteloom.session import stage


def numbered(df: DataFrame, order: list[str], extra: Callable | None = None, extra_schema: str = "") -> DataFrame:
    """``df`` with ``__n``, its place (from 0) in the order of the columns ``order``; staged.

    Rows are dealt out by ranges of ``order``; a group of equal leading values spreads over as many ranges as it needs, as
    long as the later columns tell its rows apart. Each task numbers its rows; the numbers before each range come from a
    table of one row a partition. ``extra`` adds columns to a record batch within the task.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    names = df.columns

    def count(batches):
        at = 0
        for batch in batches:
            more = extra(batch) if extra else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(at, at + len(batch))), *[a for _, a in more]],
                                             names=[*names, "__part", "__row", *[k for k, _ in more]])
            at += len(batch)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    rows = stage(ranged.mapInArrow(count, f"{schema}, __part int, __row long" + (f", {extra_schema}" if extra_schema else "")))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    parts = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__many"))
    base = parts.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__many").over(before), F.lit(0)).alias("__base"))
    return rows.join(base, F.col("__part") == F.col("__p")).withColumn("__n", F.col("__base") + F.col("__row")).drop("__part", "__p", "__base", "__row")

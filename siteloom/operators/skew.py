"""Ranks and neighbours inside groups of any size.

A window over a hot group runs in one task. These helpers cut every group into ordered buckets first: the window then
runs per (group, bucket), and a second, tiny window over one row per bucket supplies the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def bucketed_rank(df: DataFrame, keys: list[str], bucket: Column, order: list, out: str = "rank") -> DataFrame:
    """Exact row_number per ``keys``; ``bucket`` must rise with ``order`` (e.g. the leading sort key, coarsened)."""
    tagged = df.withColumn("__bucket", bucket)
    sizes = tagged.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*keys).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    local = W.partitionBy(*keys, "__bucket").orderBy(*order)
    joined = tagged.withColumn("__local", F.row_number().over(local)).join(
        offsets.withColumnsRenamed({k: f"__k_{k}" for k in keys} | {"__bucket": "__b"}),
        on=[F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys] + [F.col("__bucket").eqNullSafe(F.col("__b"))])
    return (joined.withColumn(out, (F.col("__offset") + F.col("__local")).cast("long"))
                  .drop("__bucket", "__b", "__local", "__offset", *[f"__k_{k}" for k in keys]))


def bucketed_lag(df: DataFrame, keys: list[str], bucket: Column, order: list[str], value: Column,
                 out: str = "previous") -> DataFrame:
    """Value of the preceding row per ``keys``; the last row of the nearest earlier bucket serves a bucket's first row."""
    tagged = df.withColumn("__bucket", bucket).withColumn("__value", value)
    lasts = tagged.groupBy(*keys, "__bucket").agg(F.max_by("__value", F.struct(*order)).alias("__last"))
    prior = lasts.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__bucket").alias("__b"),
                         F.lag("__last").over(W.partitionBy(*keys).orderBy("__bucket")).alias("__carry"))
    local = W.partitionBy(*keys, "__bucket").orderBy(*order)
    joined = tagged.withColumn("__local", F.lag("__value").over(local)).join(
        prior, on=[F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys] + [F.col("__bucket").eqNullSafe(F.col("__b"))])
    return (joined.withColumn(out, F.coalesce("__local", "__carry"))
                  .drop("__bucket", "__b", "__value", "__local", "__carry", *[f"__k_{k}" for k in keys]))


def group_hashed(df: DataFrame, *keys: str):
    """groupBy whose leading key is a hash of all keys.

    Aggregates over strings or structs are sort-based in Spark; with a 64-bit leading key that sort is a radix sort, not
    a comparison of long texts with common beginnings. Drop ``__h`` afterwards.
    """
    return df.withColumn("__h", F.xxhash64(*keys)).groupBy("__h", *keys)


def core_parts(df: DataFrame) -> int:
    """Partitions that keep all cores busy, for few bytes that cost much work a row; Spark would merge them by their bytes."""
    spark = df.sparkSession
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by a hash of ``keys`` over all cores, for few bytes that cost much work a row.

    Spark reads small partitions in one task, and leaves out a repartition by columns that its input is already dealt by.
    """
    return df.repartition(core_parts(df), F.xxhash64(*keys))


def top_per_key(df: DataFrame, keys: list[str], order: list, k: int, rank: str | None = None) -> DataFrame:
    """First ``k`` rows per key. A literal limit lets Spark prune every map task to ``k`` rows before the shuffle."""
    name = rank or "__rank"
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)
    return ranked if rank else ranked.drop(name)


def first_per_key(df: DataFrame, keys: list[str], bucket: Column, order: list, k: int | Column, out: str) -> DataFrame:
    """First ``k`` rows per key with their rank, for a ``k`` too large for ``top_per_key`` to prune.

    The rows of each ordered bucket are counted map-side; buckets that begin beyond the k-th row go before anything is
    sorted, and the bucket that holds it is cut by a window of its own. ``bucket`` must rise with ``order``; ``k`` may depend on ``keys``.
    """
    limit = F.lit(k) if isinstance(k, int) else k
    tagged = df.withColumn("__bucket", bucket).withColumn("__k", limit)
    sizes = tagged.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"), F.first("__k").alias("__limit"))
    before = W.partitionBy(*keys).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0))).filter(F.col("__offset") < F.col("__limit"))
    near = offsets.select(*[F.col(x).alias(f"__k_{x}") for x in keys], F.col("__bucket").alias("__b"), "__offset")
    held = tagged.join(near, on=[F.col(x).eqNullSafe(F.col(f"__k_{x}")) for x in keys] + [F.col("__bucket").eqNullSafe(F.col("__b"))])
    local = W.partitionBy(*keys, "__bucket").orderBy(*order)
    ranked = held.withColumn(out, (F.col("__offset") + F.row_number().over(local)).cast("long")).filter(F.col(out) <= F.col("__k"))
    return ranked.drop("__bucket", "__b", "__offset", "__k", *[f"__k_{x}" for x in keys])


def bucketed_sum(df: DataFrame, keys: list[str], bucket: Column, order: list, amount: Column, out: str) -> DataFrame:
    """Exact running sum per ``keys`` (current row included)."""
    tagged = df.withColumn("__bucket", bucket).withColumn("__amount", amount)
    totals = tagged.groupBy(*keys, "__bucket").agg(F.sum("__amount").alias("__n"))
    before = W.partitionBy(*keys).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__bucket").alias("__b"),
                            F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    local = W.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    joined = tagged.withColumn("__local", F.sum("__amount").over(local)).join(
        offsets, on=[F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys] + [F.col("__bucket").eqNullSafe(F.col("__b"))])
    return (joined.withColumn(out, F.col("__offset") + F.col("__local"))
                  .drop("__bucket", "__amount", "__b", "__local", "__offset", *[f"__k_{k}" for k in keys]))

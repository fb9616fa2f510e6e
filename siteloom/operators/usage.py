"""Rate windows, monthly usage and quota admission over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siteloom.functions import constants as K
from siteloom.functions.text import lookup
from siteloom.operators.skew import bucketed_rank, bucketed_sum, first_per_key


def window_start(ts: Column, seconds: int) -> Column:
    """Start of the fixed window holding a timestamp."""
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / seconds) * seconds)


def rate_window_counts(events: DataFrame, key: str, limit: int, seconds: int = 3600) -> DataFrame:
    """Running count of each call in its (key, window) and whether it is allowed; rejected calls count too.

    Ranks are taken per second and offset by the counts of the earlier seconds, so one busy key is many small groups.
    """
    staged = events.withColumn("window_start", window_start(F.col("ts"), seconds))
    ranked = bucketed_rank(staged, [key, "window_start"], F.date_trunc("second", "ts"), ["ts", "event_id"], "count")
    return ranked.withColumn("allowed", F.col("count") <= limit)


def usage_by_month(events: DataFrame) -> DataFrame:
    """The four usage counters per owner and month."""
    return events.groupBy("owner_key", F.date_format("ts", "yyyy-MM").alias("period")).agg(
        *[F.sum(F.when(F.col("metric") == m, F.col("amount")).otherwise(0)).alias(m) for m in K.USAGE_LIMITS])


def usage_quota(events: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """Admission per (owner, month, metric) in time order: an amount that would pass the limit is rejected and not added.

    Everything up to the first overshoot follows from a running sum. After it fewer than ``limit`` units remain, so per
    amount v only the earliest left/v later events can be admitted: that bounds what is walked in order, for any key.
    """
    limits = limits or K.USAGE_LIMITS
    keys = ["owner_key", "period", "metric"]
    rows = events.withColumn("period", F.date_format("ts", "yyyy-MM")).withColumn(
        "amount", F.greatest(F.lit(1), F.floor("amount")).cast("int")).withColumn(
        "quota", lookup(F.col("metric"), limits).cast("long"))
    summed = bucketed_sum(rows, keys, F.date_trunc("hour", "ts"), ["ts", "event_id"], F.col("amount"), "running")
    summed = summed.withColumn("fits", F.col("running") <= F.col("quota"))
    used = summed.groupBy(*keys).agg(F.max(F.when(F.col("fits"), F.col("running"))).alias("used"))
    tail = (summed.filter("not fits").join(used, keys)
            .withColumn("left", F.col("quota") - F.coalesce("used", F.lit(0))).filter("amount <= left"))
    # what is left depends on the key, which is among the keys of the ranking
    candidates = first_per_key(tail, [*keys, "amount"], F.date_trunc("hour", "ts"), ["ts", "event_id"],
                               F.floor(F.col("left") / F.col("amount")), "nth")
    queued = candidates.groupBy(*keys).agg(F.max("left").alias("left"), F.array_sort(F.collect_list(
        F.struct("ts", "event_id", F.col("amount").cast("long").alias("amount")))).alias("queue"))
    walked = F.aggregate("queue", F.struct(F.col("left"), F.array().cast("array<bigint>").alias("ids")),
                         lambda s, e: F.when(e["amount"] <= s["left"], F.struct(
                             (s["left"] - e["amount"]).alias("left"),
                             F.array_append(s["ids"], e["event_id"]).alias("ids"))).otherwise(s))
    late = queued.select(F.explode(walked["ids"]).alias("event_id")).withColumn("late", F.lit(True))
    return (summed.join(late, "event_id", "left")
                  .select("event_id", *keys, "amount", (F.col("fits") | F.coalesce("late", F.lit(False))).alias("admitted")))


def expired_windows(windows: DataFrame, now: Column) -> DataFrame:
    """Rate windows that are still worth keeping."""
    return windows.filter(F.col("expires_at") >= now)

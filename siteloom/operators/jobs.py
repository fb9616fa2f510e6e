"""Audit job state folded from its events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siteloom.functions import constants as K
from siteloom.functions.text import clamp, js_round


def job_progress(pages: Column, max_pages: Column, phase: Column) -> Column:
    """5 while discovering, 95 while finalizing, else 8..92 by the share of crawled pages."""
    share = F.greatest(F.lit(0), pages) / F.greatest(F.lit(1), max_pages)
    return (F.when(phase == "discovering", 5).when(phase == "finalizing", 95)
             .otherwise(clamp(js_round(share * 84) + 8, 8, 92))).cast("int")


def job_state(events: DataFrame) -> DataFrame:
    """Latest state per job."""
    return events.groupBy("job_id").agg(F.max(F.struct("seq", "ts", "status", "attempts")).alias("s"),
                                        F.count(F.lit(1)).alias("n_events")).select(
        "job_id", F.col("s.status").alias("status"), F.col("s.ts").alias("updated_at"),
        F.col("s.attempts").alias("attempts"), "n_events")


def stale_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """Running jobs without an update for five minutes."""
    return jobs.filter((F.col("status") == "running")
                       & (F.col("updated_at") < now - F.expr(f"interval {K.STALE_MINUTES} minutes")))


def recover_stale(jobs: DataFrame, now: Column) -> DataFrame:
    """Stale running jobs marked as failed."""
    stale = (F.col("status") == "running") & (F.col("updated_at") < now - F.expr(f"interval {K.STALE_MINUTES} minutes"))
    return (jobs.withColumn("error", F.when(stale, K.STALE_MESSAGE))
                .withColumn("status", F.when(stale, "failed").otherwise(F.col("status"))))


def retryable_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.filter((F.col("status") == "failed") & (F.col("attempts") < K.MAX_ATTEMPTS))


def oldest_queued_jobs(jobs: DataFrame, k: int = 4) -> DataFrame:
    queued = jobs.filter((F.col("status") == "queued") & (F.col("attempts") < K.MAX_ATTEMPTS))
    return queued.orderBy("created_at", "job_id").limit(k)

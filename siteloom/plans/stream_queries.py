"""Registered queries that run the streaming forms over files of the event tables and return what they wrote.

The files overlap: each event lies up to half an hour from its place, within the watermark's hour. A few events arrive with
the last file, long after their time.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from siteloom.plans.history_queries import _STATUS, _STOP, _TIGHT, ORACLE_ALERTS
from siteloom.plans.registry import query
from siteloom.plans.tables import table
from siteloom.session import stage, staging_dir
from siteloom.streaming import streams

FILES = 5
#: Every so many events, one arrives late, unless it lies within the last two days.
LATE_EVERY, LATE_OFF = 37, 5


def _events_in_files(spark: SparkSession, rows: DataFrame, late: str | None = None) -> DataFrame:
    """A stream over ``rows`` (with ts, event_id) landed in ``FILES`` files one after the other, the rows of ``late`` in the last.

    A final file holds a tick without a key, past all events, so that the watermark passes them.
    """
    base = f"{staging_dir(spark).rstrip('/')}/siteloom-{uuid.uuid4().hex}"
    ends = rows.agg(F.min("ts").alias("first"), F.max("ts").alias("last")).first()
    if ends["first"] is None:
        rows.write.parquet(f"{base}/in")
    else:
        seconds = F.unix_timestamp("ts") + F.pmod(F.xxhash64("event_id"), F.lit(1800)) - F.unix_timestamp(F.lit(ends["first"]))
        width = ((ends["last"] - ends["first"]).total_seconds() + 1801) / FILES
        place = F.floor(seconds / width)
        held = stage(rows.withColumn("__file", F.when(F.expr(late or "false"), FILES - 1).otherwise(place)))
        for i in range(FILES):
            held.filter(F.col("__file") == i).select(*rows.columns).coalesce(1).write.mode("append").parquet(f"{base}/in")
            time.sleep(0.05)  # the source takes files in the order of their times
        tick = rows.limit(1).select(*[F.lit(ends["last"]).cast("timestamp").alias(c) + F.expr("interval 1 day") if c == "ts" else
                                      F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns]).toDF(*rows.columns)
        tick.write.mode("append").parquet(f"{base}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")


def _drain(result: DataFrame, mode: str) -> DataFrame:
    """Run a stream until its input is used up and read back the rows of every batch."""
    spark = result.sparkSession
    base = f"{staging_dir(spark).rstrip('/')}/siteloom-{uuid.uuid4().hex}"
    written = streams.BatchTable(spark, f"{base}/rows", result.schema)
    (result.writeStream.outputMode(mode).foreachBatch(written.replace).option("checkpointLocation", f"{base}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())
    return written.read()


_IS_LATE = f"event_id % {LATE_EVERY} = {LATE_OFF} AND ts < (SELECT max(ts) FROM {{fx_usage}}) - INTERVAL 10 DAY"


def _usage_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "fx_usage").withColumn("ts", F.col("ts").cast("timestamp"))
    last = rows.agg(F.max("ts").alias("last")).first()["last"]
    return _events_in_files(spark, rows, f"event_id % {LATE_EVERY} = {LATE_OFF} AND ts < timestamp'{last}' - INTERVAL 10 DAY")


@query("stream_rate_windows", f"""WITH e AS (SELECT *, {_IS_LATE} AS late FROM {{fx_usage}})
 SELECT owner_key, CAST(floor(epoch(date_trunc('hour', ts))) AS BIGINT) AS window_epoch, count(*) FILTER (WHERE NOT late) AS count,
   count(*) FILTER (WHERE late) AS late_count, least(count(*) FILTER (WHERE NOT late), 3) AS allowed FROM e GROUP BY owner_key, date_trunc('hour', ts)""")
def q_stream_rate(spark, sf_dir):
    """Calls per owner and hour over several files; late ones counted aside."""
    written = _drain(streams.rate_limit_stream(_usage_stream(spark, sf_dir), "owner_key"), "update")
    return streams.rate_windows(written, "owner_key", 3).select(
        "owner_key", F.unix_timestamp("window_start").alias("window_epoch"), "count", "late_count", "allowed")


@query("stream_usage_quota", f"""WITH e AS (SELECT *, strftime(ts, '%Y-%m') AS period, {_IS_LATE} AS late FROM {{fx_usage}})
 SELECT event_id, owner_key, period, metric, late, CASE WHEN NOT late THEN row_number() OVER (PARTITION BY owner_key, period, metric, late
   ORDER BY ts, event_id) <= CASE metric WHEN 'audit_jobs' THEN 4 WHEN 'ai_fixes' THEN 6 WHEN 'gsc_syncs' THEN 3 ELSE 25 END END AS admitted FROM e""")
def q_stream_quota(spark, sf_dir):
    """Admission in time order over several files; late events without a verdict."""
    events = _usage_stream(spark, sf_dir).withColumn("amount", F.lit(1))
    return _drain(streams.usage_quota_stream(events, _TIGHT), "append").select("event_id", "owner_key", "period", "metric", "late", "admitted")


@query("stream_job_state", """WITH l AS (SELECT job_id, arg_max({'status': status, 'ts': ts, 'attempts': attempts}, seq) AS s FROM {fx_job_events} GROUP BY job_id),
 j AS (SELECT job_id, l.s.status AS status, l.s.attempts AS attempts, epoch_us(l.s.ts) AS updated_us FROM l)
 SELECT job_id, CASE WHEN status = 'running' THEN 'failed' ELSE status END AS status, attempts, updated_us,
   CASE WHEN status = 'running' THEN 'The background Worker stopped before completion. Retry this audit job.' END AS error FROM j""")
def q_stream_jobs(spark, sf_dir):
    """The state of every job after all files; the closing tick lies past every running job's patience."""
    rows = table(spark, sf_dir, "fx_job_events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("event_id", F.col("seq"))
    written = _drain(streams.job_state_stream(_events_in_files(spark, rows)), "update")
    return streams.latest_jobs(written).select("job_id", "status", "attempts", F.unix_micros("updated_at").alias("updated_us"), "error")


@query("stream_alerts", ORACLE_ALERTS)
def q_stream_alerts(spark, sf_dir):
    """Alerts of all finished audits, delivered in several files."""
    audits = table(spark, sf_dir, "fx_audits").withColumn("created_at", F.col("created_at").cast("timestamp"))
    audits = stage(audits.withColumn("stopped_reason", F.expr(_STOP)).withColumn("previous_status", F.expr(_STATUS)))
    issues = stage(table(spark, sf_dir, "fx_issues"))
    base = f"{staging_dir(spark).rstrip('/')}/siteloom-{uuid.uuid4().hex}"
    done = streams.BatchTable(spark, f"{base}/done", T.StructType([audits.schema["audit_id"]]))
    alerts = streams.BatchTable(spark, f"{base}/alerts", "audit_id long, severity string, kind string, title string, message string")
    for i in range(3):  # some audits are delivered twice
        audits.filter((F.pmod(F.xxhash64("audit_id"), F.lit(3)) == i) | (F.lit(i > 0) & (F.col("audit_id") % 13 == 0))).select("audit_id").coalesce(
            1).write.mode("append").parquet(f"{base}/in")
        time.sleep(0.05)
    finished = spark.readStream.schema(T.StructType([audits.schema["audit_id"]])).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    (streams.audit_alert_stream(finished, lambda: (audits, issues), done, alerts, f"{base}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())
    return alerts.read().drop("batch")


@query("stream_open_windows", """SELECT owner_key, CAST(floor(epoch(date_trunc('hour', ts))) AS BIGINT) AS window_epoch, count(*) AS count
 FROM {fx_usage} GROUP BY owner_key, date_trunc('hour', ts)""")
def q_stream_retention(spark, sf_dir):
    rows = table(spark, sf_dir, "fx_usage").withColumn("ts", F.col("ts").cast("timestamp"))
    counted = _drain(streams.retention_stream(_events_in_files(spark, rows), "owner_key"), "update").filter("owner_key is not null")
    last = counted.groupBy("owner_key", "window_start").agg(F.max("count").alias("count"))
    return last.select("owner_key", F.unix_timestamp("window_start").alias("window_epoch"), "count")

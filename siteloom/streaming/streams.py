"""Structured Streaming forms of the windowed counters, quotas, job states and alerts.

Event time is the event's own timestamp, the watermark follows it by one hour. The keyed forms read the watermark themselves
instead of letting Spark drop what lies behind it: a late row comes out marked as such, so that results and the late rows
together hold every input row, whatever the order of the files. State leaves by timers. A row without a key is a tick: it
moves the watermark and does nothing else.

The keyed forms need the RocksDB state store; ``keyed_state`` sets it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from siteloom.functions import constants as K
from siteloom.operators import history, monitoring
from siteloom.session import stage

LATENESS = "1 hour"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def timed(events: DataFrame, *columns: str | Column) -> DataFrame:
    """``columns`` of the events, with ``at`` in place of ``ts`` (microseconds); Spark drops no row of it as late.

    A row without a time lies before all others, so it is always late."""
    return events.withWatermark("ts", LATENESS).select(*columns, F.coalesce(F.unix_micros("ts"), F.lit(-1)).alias("at"))


def ms(at: int) -> int:
    return at // 1000


def bucket_of(buckets: int, *keys: str) -> Column:
    """The bucket of a key. Every group costs a batch some calls to the state, so many small keys share one."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")


class RateWindows(StatefulProcessor):
    """Calls per key in one window of one share; the window leaves the state when the watermark passes its end."""

    def __init__(self, width_ms: int) -> None:
        self.width = width_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "key array<string>, count array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        share, start, seen = int(key[0]), int(key[1]), {}
        for pdf in rows:
            for name, n in pdf["key"].value_counts().items():  # without null keys
                seen[name] = seen.get(name, 0) + int(n)
        if not seen:
            return
        late = start + self.width <= timerValues.getCurrentWatermarkInMs()
        if not late:
            held = dict(zip(*self.counts.get())) if self.counts.exists() else {}
            if not held:
                self.handle.registerTimer(start + self.width)
            seen = {name: n + held.get(name, 0) for name, n in seen.items()}
            held |= seen
            self.counts.update((list(held), list(held.values())))
        yield pd.DataFrame({"key": list(seen), "share": share, "start": start, "count": list(seen.values()), "late": late})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.counts.clear()
        return iter([])

    def close(self) -> None:
        pass


def rate_limit_stream(events: DataFrame, key: str, width_ms: int = 3_600_000, shares: int = 16) -> DataFrame:
    """Running counts: key, share, window_start, count, late. ``events``: event_id, ``key``, ts.

    A key's calls are dealt out over ``shares`` by event, so that a hot key is many small groups; counts of the shares add up
    (``rate_windows``). All keys of a share and window are one group. Calls of a window already closed come out as late, with their
    number in the batch.
    """
    keyed_state(events.sparkSession)
    rows = timed(events, F.col(key).cast("string").alias("key"), F.pmod(F.xxhash64("event_id"), F.lit(shares)).cast("int").alias("share"))
    rows = rows.withColumn("start", F.expr(f"(at - pmod(at, {width_ms * 1000}L)) div 1000"))
    out = rows.groupBy("share", "start").transformWithStateInPandas(
        RateWindows(width_ms), "key string, share int, start long, count long, late boolean", "Update", "EventTime")
    return out.select(F.col("key").alias(key), "share", F.timestamp_millis("start").alias("window_start"), "count", "late")


def rate_windows(written: DataFrame, key: str, limit: int) -> DataFrame:
    """What the stream has counted per (key, window): calls in time, how many of them the limit lets through, late calls.

    ``written``: the rows of every batch with its number in ``batch``.
    """
    keys = [key, "window_start"]
    last = written.filter("not late").groupBy(*keys, "share").agg(F.max_by("count", "batch").alias("count"))
    late = written.filter("late").select(*keys, F.lit(0).cast("long").alias("count"), F.col("count").alias("late_count"))
    both = last.select(*keys, "count", F.lit(0).cast("long").alias("late_count")).unionByName(late)
    return both.groupBy(*keys).agg(F.sum("count").alias("count"), F.sum("late_count").alias("late_count")).withColumn(
        "allowed", F.least("count", F.lit(limit)))


WAITING = "at array<long>, event_id array<long>, owner_key array<string>, metric array<string>, amount array<int>"


class QuotaAdmission(StatefulProcessor):
    """Events of one (month, bucket of owners and metrics) wait until the watermark has passed them, then are admitted in time order."""

    FIELDS = ["at", "event_id", "owner_key", "metric", "amount"]

    def __init__(self, limits: dict[str, int]) -> None:
        self.limits = limits

    def init(self, handle) -> None:
        self.handle = handle
        self.used = handle.getValueState("used", "owner_key array<string>, metric array<string>, used array<long>")
        self.waiting = handle.getListState("waiting", WAITING)

    def rows(self, key, held: list, verdicts: list, late: bool) -> pd.DataFrame:
        _, event_id, owner, metric, amount = zip(*held)
        return pd.DataFrame({"event_id": pd.array(event_id, dtype="Int64"), "owner_key": owner, "period": key[0], "metric": metric, "amount": amount,
                             "admitted": pd.array(verdicts, dtype="boolean"), "late": late})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark, least = timerValues.getCurrentWatermarkInMs(), None
        for pdf in rows:
            late, held = [], []
            for row in zip(*(present(pdf[name]) for name in self.FIELDS)):
                if row[2] is not None:
                    (late if ms(row[0]) < watermark else held).append(row)
            if held:
                self.waiting.appendValue(tuple(map(list, zip(*held))))
                least = min(r[0] for r in held) if least is None else min(least, min(r[0] for r in held))
            if late:
                yield self.rows(key, late, [None] * len(late), True)
        if least is not None:
            self.handle.registerTimer(ms(least) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        held = [row for chunk in self.waiting.get() for row in zip(*chunk)] if self.waiting.exists() else []
        # by time and number, events without a number first
        ripe = sorted((r for r in held if ms(r[0]) < watermark), key=lambda r: (r[0], r[1] is not None, r[1] or 0))
        rest = [r for r in held if ms(r[0]) >= watermark]
        if rest and ripe:
            self.waiting.put([tuple(map(list, zip(*rest)))])
            self.handle.registerTimer(ms(min(r[0] for r in rest)) + 1)
        elif ripe:
            self.waiting.clear()
        if not held and watermark >= month_end_ms(key[0]):
            self.used.clear()  # nothing of this month can be in time any more
        if not ripe:
            return
        used, verdicts = {}, []
        if self.used.exists():
            owners, metrics, sums = self.used.get()
            used = dict(zip(zip(owners, metrics), sums))
        for _, _, owner, metric, amount in ripe:
            fits = used.setdefault((owner, metric), 0) + amount <= self.limits[metric]
            used[owner, metric] += amount if fits else 0
            verdicts.append(fits)
        self.used.update(([k[0] for k in used], [k[1] for k in used], list(used.values())))
        self.handle.registerTimer(month_end_ms(key[0]))
        yield self.rows(key, ripe, verdicts, False)

    def close(self) -> None:
        pass


def present(values: pd.Series) -> list:
    """Values as a list, missing ones as None; a column of numbers with gaps comes as fractions."""
    out = values.tolist()
    if values.hasnans:
        return [None if pd.isna(v) else int(v) if isinstance(v, float) else v for v in out]
    return out


def month_end_ms(period: str) -> int:
    return int((pd.Timestamp(f"{period}-01", tz="UTC") + pd.DateOffset(months=1)).timestamp() * 1000)


def usage_quota_stream(events: DataFrame, limits: dict[str, int] | None = None, buckets: int = 256) -> DataFrame:
    """Admission of each event against its (owner, month, metric) quota, in time order behind the watermark.

    ``events``: event_id, owner_key, metric, amount, ts. Returns event_id, owner_key, period, metric, amount, admitted, late. A late
    row has no verdict and uses up nothing. The state of a key is what waits (an hour of events) and one sum until its month is over;
    the keys of a bucket are kept together.
    """
    keyed_state(events.sparkSession)
    amount = F.greatest(F.lit(1), F.floor("amount")).cast("int")
    rows = timed(events, "event_id", "owner_key", F.date_format("ts", "yyyy-MM").alias("period"), "metric", amount.alias("amount"))
    rows = rows.select("*", bucket_of(buckets, "owner_key", "metric"))
    return rows.groupBy("period", "bucket").transformWithStateInPandas(
        QuotaAdmission(dict(limits or K.USAGE_LIMITS)),
        "event_id long, owner_key string, period string, metric string, amount int, admitted boolean, late boolean", "Append", "EventTime")


class JobFold(StatefulProcessor):
    """The newest event of each job of a bucket. A running job that stays silent fails; a finished one leaves when no event can be older."""

    FIELDS = ["job_id", "seq", "status", "attempts", "at"]

    def __init__(self, stale_ms: int) -> None:
        self.stale = stale_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState(
            "state", "job_id array<long>, seq array<long>, status array<string>, attempts array<int>, at array<long>")

    def held(self) -> dict[int, tuple]:
        return {row[0]: row for row in zip(*self.state.get())} if self.state.exists() else {}

    def due(self, row: tuple) -> int | None:
        """When the watermark ends the wait for a job: a running one fails, a finished one leaves."""
        if row[2] == "running":
            return ms(row[4]) + self.stale + 1
        return ms(row[4]) + 1 if row[2] in ("completed", "failed") else None

    def keep(self, held: dict[int, tuple]) -> None:
        """Store the jobs and one timer, for the first that is due."""
        if held:
            self.state.update(tuple(map(list, zip(*held.values()))))
        else:
            self.state.clear()
        first = min((at for at in map(self.due, held.values()) if at is not None), default=None)
        for timer in list(self.handle.listTimers()):
            if timer != first:
                self.handle.deleteTimer(timer)
        if first is not None:
            self.handle.registerTimer(first)

    def rows(self, found: list[tuple], error: str | None = None, late: list | bool = False) -> pd.DataFrame:
        jobs, seq, status, attempts, at = zip(*found)
        return pd.DataFrame({"job_id": jobs, "status": status, "attempts": pd.array(attempts, dtype="Int32"), "seq": seq, "at": at,
                             "error": error, "late": late})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = {}
        for pdf in rows:
            for row in zip(*(present(pdf[name]) for name in self.FIELDS)):
                if row[0] is not None and (row[0] not in newest or row[1] > newest[row[0]][1]):
                    newest[row[0]] = row
        if not newest:
            return
        watermark, held, found, late = timerValues.getCurrentWatermarkInMs(), self.held(), [], []
        for job, row in newest.items():
            if job in held and row[1] <= held[job][1]:
                continue
            late.append(job not in held and ms(row[4]) < watermark)
            found.append(row)
            if not late[-1]:
                held[job] = row
        if not all(late):
            self.keep(held)
        if found:
            yield self.rows(found, late=late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark, held = timerValues.getCurrentWatermarkInMs(), self.held()
        over = [row for row in held.values() if (self.due(row) or watermark + 1) <= watermark]
        for row in over:
            del held[row[0]]
        if over:
            self.keep(held)
        silent = [(job, seq, "failed", attempts, at) for job, seq, status, attempts, at in over if status == "running"]
        if silent:
            yield self.rows(silent, K.STALE_MESSAGE)

    def close(self) -> None:
        pass


def job_state_stream(events: DataFrame, stale_ms: int = K.STALE_MINUTES * 60_000, buckets: int = 256) -> DataFrame:
    """The state of each job whenever it changes: job_id, status, attempts, seq, updated_at, error, late.

    ``events``: job_id, seq, status, attempts, ts. A running job whose last event lies more than ``stale_ms`` behind the watermark
    turns into a failed one. Finished and failed jobs leave the state once the watermark has passed them; an event that is
    late by then comes out as such and changes nothing. The jobs of a bucket are kept together.
    """
    keyed_state(events.sparkSession)
    rows = timed(events, "job_id", "seq", "status", "attempts", bucket_of(buckets, "job_id"))
    out = rows.groupBy("bucket").transformWithStateInPandas(
        JobFold(stale_ms), "job_id long, status string, attempts int, seq long, at long, error string, late boolean", "Update", "EventTime")
    return out.select("job_id", "status", "attempts", "seq", F.timestamp_micros("at").alias("updated_at"), "error", "late")


def latest_jobs(written: DataFrame) -> DataFrame:
    """The last state of every job that the stream has written; ``written`` has the number of the batch in ``batch``."""
    last = written.filter("not late").groupBy("job_id").agg(
        F.max_by(F.struct("status", "attempts", "updated_at", "error"), F.struct("seq", F.col("error").isNotNull(), "batch")).alias("r"))
    return last.select("job_id", "r.*")


class BatchTable:
    """Rows of a stream in one folder a batch: a batch that runs again replaces its own rows and nothing else."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)

    def replace(self, rows: DataFrame, batch: int) -> None:
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def read(self) -> DataFrame:
        """All rows with the number of their batch."""
        found = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())]))
        return found.option("basePath", self.path).parquet(f"{self.path}/batch=*")

    def before(self, batch: int) -> DataFrame:
        """Rows of earlier batches; none while there are none."""
        if batch == 0:
            return self.spark.createDataFrame([], self.schema)
        return self.read().filter(F.col("batch") < batch).drop("batch")


def audit_alert_batch(read_history: Callable[[], tuple[DataFrame, DataFrame]],
                      done: BatchTable, alerts: BatchTable) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: compare each finished audit of the batch with the stored one before it, write its alerts.

    ``read_history`` returns (audits, issues) including the batch's audits; only audits of the batch raise alerts, and only
    those that no earlier batch has treated. ``done`` (audit_id) and ``alerts`` hold a folder a batch, so that each audit's alerts
    are there once, whether a batch runs again or an audit is delivered again.
    """
    def run(batch: DataFrame, number: int) -> None:
        fresh = batch.select("audit_id").distinct().join(done.before(number), "audit_id", "left_anti")
        done.replace(fresh, number)
        fresh = done.read().filter(F.col("batch") == number).select("audit_id")
        audits, issues = read_history()
        # only owners that have an audit in the batch: trends compare audits of one owner
        owners = audits.join(fresh, "audit_id", "left_semi").select("owner").distinct()
        audits = audits.join(owners, "owner", "left_semi")
        # every step below starts from these pairs, so they are worked out once
        pairs = stage(history.audit_trend(audits).join(fresh, "audit_id", "left_semi"))
        needed = pairs.select(F.explode(F.array("audit_id", "previous_audit_id")).alias("audit_id")).filter(
            "audit_id is not null").distinct()
        diff = history.issue_diff(issues.join(needed, "audit_id", "left_semi"), pairs.select("audit_id", "previous_audit_id"))
        alerts.replace(monitoring.monitoring_alerts(pairs, diff), number)
    return run


def audit_alert_stream(finished: DataFrame, read_history: Callable, done: BatchTable, alerts: BatchTable, checkpoint: str):
    """Start the alert stream over finished audits; returns the writer, ready to be started."""
    return finished.writeStream.foreachBatch(audit_alert_batch(read_history, done, alerts)).option("checkpointLocation", checkpoint)


def retention_stream(events: DataFrame, key: str, width: str = "1 hour") -> DataFrame:
    """Counters of windows that are still open; the watermark removes expired ones from the state."""
    counted = events.withWatermark("ts", LATENESS).groupBy(key, F.window("ts", width)).agg(F.count(F.lit(1)).alias("count"))
    return counted.select(key, F.col("window.start").alias("window_start"), F.col("window.end").alias("expires_at"), "count")

"""Monitors and the alerts derived from finished audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siteloom.functions import constants as K
from siteloom.operators.skew import top_per_key
from siteloom.session import stage


def valid_cadence(c: Column) -> Column:
    return c.isin(K.CADENCES)


def next_run_at(cadence: Column, at: Column) -> Column:
    """A day, a week or a calendar month later; a month that is too short overflows into the next one."""
    clock = at - F.date_trunc("day", at)
    first = F.add_months(F.trunc(at, "month"), 1)
    month = F.date_add(first, F.dayofmonth(at) - 1).cast("timestamp") + clock
    return (F.when(cadence == "daily", at + F.expr("interval 1 day"))
             .when(cadence == "weekly", at + F.expr("interval 7 days")).when(cadence == "monthly", month))


def monitoring_alerts(audits: DataFrame, diff: DataFrame) -> DataFrame:
    """Alert rows of finished audits.

    ``audits``: audit_id, score, pages_scanned, stopped_reason, score_delta (null without comparison), previous_status.
    ``diff``: issue_diff rows. The new severe ones are written once and used twice: counts combine map-side, titles are a
    top-4 per (audit, severity).
    """
    fresh = stage(diff.filter((F.col("status") == "new") & F.col("severity").isin("critical", "high")).select(
        "audit_id", "severity", "seq", "fingerprint", "title"))
    counts = fresh.groupBy("audit_id").agg(F.count_if(F.col("severity") == "critical").alias("n_critical"),
                                           F.count_if(F.col("severity") == "high").alias("n_high"))
    first = top_per_key(fresh.select("audit_id", "severity", "seq", "fingerprint", "title"), ["audit_id", "severity"],
                        ["seq", "fingerprint"], 4)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "fingerprint", "title"))),
                                      lambda x: x["title"]), "; ")
    titles = first.groupBy("audit_id", "severity").agg(listed.alias("titles"))
    named = titles.groupBy("audit_id").agg(
        F.max(F.when(F.col("severity") == "critical", F.col("titles"))).alias("critical_titles"),
        F.max(F.when(F.col("severity") == "high", F.col("titles"))).alias("high_titles"))
    c = F.col
    rows = audits.join(counts.join(named, "audit_id"), "audit_id", "left")
    stopped = c("stopped_reason").isNotNull() | (c("pages_scanned") == 0)

    def alert(test: Column, severity, kind: str, title: Column, message: Column) -> Column:
        return F.when(test, F.struct(severity.alias("severity"), F.lit(kind).alias("kind"), title.alias("title"),
                                     message.alias("message")))

    def counted(n: str, label: str) -> Column:
        return F.concat(c(n).cast("string"), F.lit(f" new {label} issue"), F.when(c(n) == 1, "").otherwise("s"))

    candidates = F.array(
        alert(stopped, F.lit("critical"), "crawl_problem", F.lit("Scheduled crawl did not complete normally"),
              F.coalesce(c("stopped_reason"), F.lit("No HTML pages were scanned."))),
        alert(c("score_delta") <= -5, F.when(c("score_delta") <= -15, "critical").otherwise("warning"), "score_drop",
              F.concat(F.lit("SEO score dropped by "), F.abs("score_delta").cast("string"), F.lit(" points")),
              F.concat(F.lit("The score changed from "), (c("score") - c("score_delta")).cast("string"), F.lit(" to "),
                       c("score").cast("string"), F.lit(". Review new regressions before the next run."))),
        alert(c("n_critical") > 0, F.lit("critical"), "new_critical", counted("n_critical", "critical"),
              c("critical_titles")),
        alert(c("n_high") > 0, F.lit("warning"), "new_high", counted("n_high", "high-priority"), c("high_titles")),
        alert((c("previous_status") == "failed") & ~stopped, F.lit("info"), "recovery",
              F.lit("Monitoring crawl recovered"), F.concat(F.lit("The scheduled crawl completed and scanned "),
                                                            c("pages_scanned").cast("string"), F.lit(" pages."))))
    return rows.select("audit_id", F.explode(F.filter(candidates, lambda a: a.isNotNull())).alias("a")).select(
        "audit_id", "a.*")


def failed_run_alerts(runs: DataFrame) -> DataFrame:
    """One critical alert per failed run, message cut at 500 characters."""
    message = F.coalesce(F.substring("error", 1, 500), F.lit("Scheduled crawl failed."))
    return runs.filter("status = 'failed'").select(
        "monitor_id", F.lit("critical").alias("severity"), F.lit("crawl_problem").alias("kind"),
        F.lit("Monitoring crawl failed").alias("title"), message.alias("message"))


def due_monitors(monitors: DataFrame, now: Column, limit: int = 2) -> DataFrame:
    """Enabled monitors whose time has come and that are not running, oldest first, one to three of them."""
    return (monitors.filter(F.col("enabled") & (F.col("next_run_at") <= now) & (F.col("last_status") != "running"))
                    .orderBy("next_run_at", "monitor_id").limit(max(1, min(limit, 3))))


def monitor_run_update(monitors: DataFrame, runs: DataFrame) -> DataFrame:
    """Fold the newest run of each monitor into its row; a run without an audit keeps the last audit."""
    last = runs.groupBy("monitor_id").agg(
        F.max_by(F.struct("finished_at", "audit_id", "status", "error"), F.struct(
            "finished_at", F.col("audit_id").isNull().alias("none"), "audit_id")).alias("r"))
    c, ran = F.col, F.col("r").isNotNull()
    return monitors.join(last, "monitor_id", "left").select(
        *[x for x in monitors.columns if x not in ("last_run_at", "last_audit_id", "last_status", "last_error",
                                                   "next_run_at", "updated_at")],
        F.coalesce("r.finished_at", "last_run_at").alias("last_run_at"),
        F.coalesce("r.audit_id", "last_audit_id").alias("last_audit_id"),
        F.coalesce("r.status", "last_status").alias("last_status"),
        F.when(ran, c("r.error")).otherwise(c("last_error")).alias("last_error"),
        F.when(ran, next_run_at(c("cadence"), c("r.finished_at"))).otherwise(c("next_run_at")).alias("next_run_at"),
        F.coalesce("r.finished_at", "updated_at").alias("updated_at"))


def set_monitor_enabled(monitors: DataFrame, switches: DataFrame, now: Column) -> DataFrame:
    """Apply (monitor_id, enable) switches; enabling makes a monitor due at once."""
    c = F.col
    return monitors.join(switches, "monitor_id", "left").select(
        *[x for x in monitors.columns if x not in ("enabled", "next_run_at", "updated_at")],
        F.coalesce("enable", "enabled").alias("enabled"),
        F.when(c("enable"), now).otherwise(c("next_run_at")).alias("next_run_at"),
        F.when(c("enable").isNotNull(), now).otherwise(c("updated_at")).alias("updated_at"))


def monitor_run_summary(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col("status") == "success").alias("succeeded"),
                    F.count_if(F.col("status") == "failed").alias("failed"))


def unread_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("owner").agg(F.count_if(F.col("read_at").isNull()).alias("unread"))

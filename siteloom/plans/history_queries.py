"""Registered queries over audit history, monitors, usage and job events."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteloom.functions import constants as K
from siteloom.operators import findings, history, jobs, monitoring, usage
from siteloom.plans.registry import query
from siteloom.plans.tables import table

_PREV = """trended AS (SELECT *, score - previous_score AS score_delta FROM (
  SELECT *, lag(audit_id) OVER w AS previous_audit_id, lag(score) OVER w AS previous_score FROM {fx_audits}
  WINDOW w AS (PARTITION BY owner, project_id, CASE WHEN project_id IS NULL THEN root_url ELSE '' END ORDER BY created_at, audit_id)))"""
_TREND = "CASE WHEN score_delta > 0 THEN 'improved' WHEN score_delta < 0 THEN 'declined' WHEN score_delta = 0 THEN 'unchanged' END"
_NORM = r"CASE WHEN u IS NULL THEN 'site-wide' ELSE regexp_replace(u, '^([a-z]+://[^/]*/.*[^/])/+$', '\1') END"
_DIFF = rf"""occ AS (SELECT audit_id, seq, code, severity, title, u AS url, concat(code, '|', {_NORM}) AS fingerprint FROM (
    SELECT *, unnest(CASE WHEN len(us) = 0 THEN [NULL] ELSE us END) AS u FROM (
      SELECT *, list_distinct(list_concat(CASE WHEN url IS NULL THEN [] ELSE [url] END,
        regexp_extract_all(coalesce(evidence, ''), '(?m)^(https?://\S+)$'))) AS us FROM {{fx_issues}}))),
 last AS (SELECT audit_id, fingerprint, max({{'seq': seq, 'code': code, 'severity': severity, 'title': title, 'url': url}}) AS r
          FROM occ GROUP BY ALL),
 pairs AS (SELECT audit_id, previous_audit_id FROM trended WHERE previous_audit_id IS NOT NULL),
 cur AS (SELECT p.audit_id, fingerprint, r FROM last JOIN pairs p ON p.audit_id = last.audit_id),
 prev AS (SELECT p.audit_id, fingerprint, r FROM last JOIN pairs p ON p.previous_audit_id = last.audit_id),
 diff AS (SELECT coalesce(c.audit_id, p.audit_id) AS audit_id, coalesce(c.fingerprint, p.fingerprint) AS fingerprint,
   CASE WHEN p.r IS NULL THEN 'new' WHEN c.r IS NULL THEN 'fixed' ELSE 'persistent' END AS status, coalesce(c.r, p.r) AS r
   FROM cur c FULL JOIN prev p ON c.audit_id = p.audit_id AND c.fingerprint = p.fingerprint)"""


@query("audit_trend", f"WITH {_PREV} SELECT audit_id, owner, previous_audit_id, score, score_delta, {_TREND} AS trend FROM trended")
def q_trend(spark, sf_dir):
    out = history.audit_trend(table(spark, sf_dir, "fx_audits"))
    return out.select("audit_id", "owner", "previous_audit_id", "score", "score_delta", "trend")


@query("audit_history_latest", """SELECT owner, audit_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY owner
 ORDER BY created_at DESC, audit_id DESC) AS INT) AS rank FROM {fx_audits}) WHERE rank <= 50""")
def q_latest(spark, sf_dir):
    out = history.latest_n(table(spark, sf_dir, "fx_audits"), "owner", 50, tie="audit_id", rank="rank")
    return out.select("owner", "audit_id", "score", "rank")


def fixture_pairs(spark, sf_dir):
    """Consecutive audits of the derived history."""
    return history.audit_trend(table(spark, sf_dir, "fx_audits"))


def fixture_diff(spark, sf_dir):
    pairs = fixture_pairs(spark, sf_dir).select("audit_id", "previous_audit_id")
    return history.issue_diff(table(spark, sf_dir, "fx_issues"), pairs)


@query("issue_diff", f"WITH {_PREV}, {_DIFF} SELECT audit_id, fingerprint, status, r.severity AS severity, r.title AS title, r.url AS url FROM diff")
def q_diff(spark, sf_dir):
    return fixture_diff(spark, sf_dir).select("audit_id", "fingerprint", "status", "severity", "title", "url")


@query("audit_comparison", f"""WITH {_PREV}, {_DIFF} SELECT t.audit_id, t.previous_audit_id, score_delta, {_TREND} AS trend,
 count(*) FILTER (WHERE status = 'new') AS new_count, count(*) FILTER (WHERE status = 'fixed') AS fixed_count,
 count(*) FILTER (WHERE status = 'persistent') AS persistent_count FROM trended t LEFT JOIN diff d ON d.audit_id = t.audit_id
 WHERE t.previous_audit_id IS NOT NULL GROUP BY ALL""")
def q_compare(spark, sf_dir):
    return history.compare_audits(table(spark, sf_dir, "fx_audits"), table(spark, sf_dir, "fx_issues"))


_VERSIONS = """SELECT audit_id * 2 + 1 AS audit_id, seq, url, status, title, description, canonical, robots, word_count FROM {fx_pages}
 UNION ALL SELECT audit_id * 2, seq, CASE WHEN page_id % 17 = 3 THEN concat(url, '-old') WHEN page_id % 5 = 1 THEN concat(url, '/') ELSE url END,
   CASE WHEN page_id % 9 = 1 THEN 500 ELSE status END, CASE WHEN page_id % 6 = 1 THEN concat(title, ' old') ELSE title END,
   description, CASE WHEN page_id % 8 = 1 THEN '' ELSE canonical END, robots, word_count FROM {fx_pages}"""


_SAME = " UNION ALL ".join(f"SELECT audit_id, 'duplicate-{k}' AS code, lower(trim({k})) AS val, page FROM n" for k in ("title", "description"))


@query("duplicate_issue_diff", f"""WITH v AS ({_VERSIONS}),
 n AS (SELECT *, CASE WHEN regexp_matches(url, '^https?://[^/]*/+$') THEN regexp_replace(url, '/+$', '/') ELSE regexp_replace(url, '/+$', '') END AS page FROM v),
 s AS ({_SAME}), g AS (SELECT audit_id, code, val FROM s WHERE val <> '' GROUP BY ALL HAVING count(*) > 1),
 m AS (SELECT DISTINCT audit_id, concat(code, '|', page) AS fingerprint FROM s JOIN g USING (audit_id, code, val)),
 c AS (SELECT * FROM m WHERE audit_id % 2 = 1), p AS (SELECT audit_id + 1 AS audit_id, fingerprint FROM m WHERE audit_id % 2 = 0)
 SELECT coalesce(c.audit_id, p.audit_id) AS audit_id, coalesce(c.fingerprint, p.fingerprint) AS fingerprint,
   CASE WHEN p.fingerprint IS NULL THEN 'new' WHEN c.fingerprint IS NULL THEN 'fixed' ELSE 'persistent' END AS status
 FROM c FULL OUTER JOIN p ON c.audit_id = p.audit_id AND c.fingerprint = p.fingerprint""")
def q_duplicate_diff(spark, sf_dir):
    pages = spark.sql(_VERSIONS, fx_pages=table(spark, sf_dir, "fx_pages"))
    issues = findings.duplicate_issues(pages, "title").unionByName(findings.duplicate_issues(pages, "description"))
    pairs = pages.select("audit_id", (F.col("audit_id") - 1).alias("previous_audit_id")).filter("audit_id % 2 = 1").distinct()
    return history.issue_diff(issues, pairs, findings.duplicate_occurrences(pages)).select("audit_id", "fingerprint", "status")


@query("page_diff", f"""WITH v AS ({_VERSIONS}),
 n AS (SELECT *, CASE WHEN regexp_matches(url, '^https?://[^/]*/+$') THEN regexp_replace(url, '/+$', '/') ELSE regexp_replace(url, '/+$', '') END AS page FROM v),
 c AS (SELECT * FROM n WHERE audit_id % 2 = 1), p AS (SELECT * FROM n WHERE audit_id % 2 = 0),
 j AS (SELECT coalesce(c.audit_id, p.audit_id + 1) AS audit_id, coalesce(c.page, p.page) AS page, c.url AS cu, p.url AS pu,
   array_to_string(list_filter([CASE WHEN c.status IS DISTINCT FROM p.status THEN 'status' END, CASE WHEN c.title IS DISTINCT FROM p.title THEN 'title' END,
     CASE WHEN c.description IS DISTINCT FROM p.description THEN 'description' END, CASE WHEN c.canonical IS DISTINCT FROM p.canonical THEN 'canonical' END,
     CASE WHEN c.robots IS DISTINCT FROM p.robots THEN 'robots' END, CASE WHEN c.word_count IS DISTINCT FROM p.word_count THEN 'wordCount' END],
     lambda x: x IS NOT NULL), ',') AS fields
   FROM c FULL JOIN p ON c.audit_id = p.audit_id + 1 AND c.page = p.page)
 SELECT audit_id, CASE WHEN cu IS NOT NULL AND pu IS NOT NULL THEN cu ELSE page END AS url,
   CASE WHEN pu IS NULL THEN 'new' WHEN cu IS NULL THEN 'removed' ELSE 'changed' END AS status,
   CASE WHEN pu IS NULL OR cu IS NULL THEN '' ELSE fields END AS fields FROM j WHERE pu IS NULL OR cu IS NULL OR fields <> ''""")
def q_page_diff(spark, sf_dir):
    versions = spark.sql(_VERSIONS, fx_pages=table(spark, sf_dir, "fx_pages"))
    pairs = versions.select("audit_id").distinct().filter("audit_id % 2 = 1").withColumn(
        "previous_audit_id", F.col("audit_id") - 1)
    return history.page_diff(versions, pairs).withColumn("fields", F.array_join("fields", ","))


_STATUS = "CASE WHEN audit_id % 5 = 0 THEN 'failed' ELSE 'success' END"
_STOP = "CASE WHEN pages_scanned = 25 THEN 'Reached the configured limit of 25 pages.' END"


ORACLE_ALERTS = f"""WITH {_PREV}, {_DIFF},
 fresh AS (SELECT audit_id, r.severity AS severity, r.title AS title, row_number() OVER (PARTITION BY audit_id, r.severity ORDER BY r.seq, fingerprint) AS k
   FROM diff WHERE status = 'new' AND r.severity IN ('critical', 'high')),
 agg AS (SELECT audit_id, count(*) FILTER (WHERE severity = 'critical') AS nc, count(*) FILTER (WHERE severity = 'high') AS nh,
   string_agg(title, '; ' ORDER BY k) FILTER (WHERE severity = 'critical' AND k <= 4) AS tc,
   string_agg(title, '; ' ORDER BY k) FILTER (WHERE severity = 'high' AND k <= 4) AS th FROM fresh GROUP BY audit_id),
 a AS (SELECT t.*, nc, nh, tc, th, {_STOP} AS stopped, {_STATUS} AS prior FROM trended t LEFT JOIN agg USING (audit_id))
 SELECT audit_id, 'critical' AS severity, 'crawl_problem' AS kind, 'Scheduled crawl did not complete normally' AS title,
   coalesce(stopped, 'No HTML pages were scanned.') AS message FROM a WHERE stopped IS NOT NULL OR pages_scanned = 0
 UNION ALL SELECT audit_id, CASE WHEN score_delta <= -15 THEN 'critical' ELSE 'warning' END, 'score_drop', concat('SEO score dropped by ', abs(score_delta), ' points'),
   concat('The score changed from ', score - score_delta, ' to ', score, '. Review new regressions before the next run.') FROM a WHERE score_delta <= -5
 UNION ALL SELECT audit_id, 'critical', 'new_critical', concat(nc, ' new critical issue', CASE WHEN nc = 1 THEN '' ELSE 's' END), tc FROM a WHERE nc > 0
 UNION ALL SELECT audit_id, 'warning', 'new_high', concat(nh, ' new high-priority issue', CASE WHEN nh = 1 THEN '' ELSE 's' END), th FROM a WHERE nh > 0
 UNION ALL SELECT audit_id, 'info', 'recovery', 'Monitoring crawl recovered', concat('The scheduled crawl completed and scanned ', pages_scanned, ' pages.')
   FROM a WHERE prior = 'failed' AND stopped IS NULL AND pages_scanned > 0"""


@query("monitoring_alerts", ORACLE_ALERTS)
def q_alerts(spark, sf_dir):
    audits = fixture_pairs(spark, sf_dir)
    diff = history.issue_diff(table(spark, sf_dir, "fx_issues"), audits.select("audit_id", "previous_audit_id"))
    headers = audits.withColumn("stopped_reason", F.expr(_STOP)).withColumn("previous_status", F.expr(_STATUS))
    return monitoring.monitoring_alerts(headers, diff)


_MONITORS = """SELECT o_custkey AS monitor_id, CASE o_custkey % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' ELSE 'monthly' END AS cadence,
  o_custkey % 4 <> 0 AS enabled, max(o_orderdate) AS next_run_at, min(o_orderdate) AS last_run_at, min(o_orderkey) AS last_audit_id,
  CASE WHEN o_custkey % 10 = 9 THEN 'running' ELSE 'idle' END AS last_status, CAST(NULL AS STRING) AS last_error, min(o_orderdate) AS updated_at
  FROM {orders} GROUP BY o_custkey"""
_RUNS = """SELECT o_custkey AS monitor_id, o_orderdate + make_interval(0, 0, 0, 0, CAST(o_orderkey % 24 AS INT), 0, 0) AS finished_at,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey END AS audit_id, CASE WHEN o_orderkey % 6 = 0 THEN 'failed' ELSE 'success' END AS status,
  CASE WHEN o_orderkey % 6 = 0 THEN concat('fetch failed ', o_orderkey) END AS error FROM {orders}"""
_RUNS_DUCK = _RUNS.replace("make_interval(0, 0, 0, 0, CAST(o_orderkey % 24 AS INT), 0, 0)", "to_hours(CAST(o_orderkey % 24 AS INT))")


def _next_sql(at: str) -> str:
    return (f"CASE cadence WHEN 'daily' THEN {at} + INTERVAL 1 DAY WHEN 'weekly' THEN {at} + INTERVAL 7 DAY ELSE date_trunc('month', {at}) "
            f"+ INTERVAL 1 MONTH + to_days(CAST(day({at}) - 1 AS INT)) + ({at} - date_trunc('day', {at})) END")


@query("monitor_updates", f"""WITH m AS ({_MONITORS}), r AS ({_RUNS_DUCK}),
 l AS (SELECT monitor_id, arg_max({{'finished_at': finished_at, 'audit_id': audit_id, 'status': status, 'error': error}}, (finished_at, audit_id IS NULL, audit_id)) AS r
   FROM r GROUP BY monitor_id)
 SELECT monitor_id, cadence, coalesce(l.r.audit_id, last_audit_id) AS last_audit_id, coalesce(l.r.status, last_status) AS last_status,
   CASE WHEN l.r IS NULL THEN last_error ELSE l.r.error END AS last_error,
   strftime(coalesce({_next_sql('l.r.finished_at')}, next_run_at), '%Y-%m-%d %H:%M:%S') AS next_run_at FROM m LEFT JOIN l USING (monitor_id)""")
def q_monitor_updates(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    out = monitoring.monitor_run_update(spark.sql(_MONITORS, orders=orders), spark.sql(_RUNS, orders=orders))
    return out.select("monitor_id", "cadence", "last_audit_id", "last_status", "last_error",
                      F.date_format("next_run_at", "yyyy-MM-dd HH:mm:ss").alias("next_run_at"))


@query("due_monitors", f"""WITH m AS ({_MONITORS}) SELECT monitor_id, cadence FROM m
 WHERE enabled AND next_run_at <= TIMESTAMP '2000-06-01' AND last_status <> 'running' ORDER BY next_run_at, monitor_id LIMIT 3""")
def q_due(spark, sf_dir):
    monitors = spark.sql(_MONITORS, orders=table(spark, sf_dir, "orders"))
    return monitoring.due_monitors(monitors, F.lit("2000-06-01").cast("timestamp"), 3).select("monitor_id", "cadence")


@query("monitor_run_summary", f"""WITH r AS ({_RUNS_DUCK}) SELECT count(*) AS processed, count(*) FILTER (WHERE status = 'success') AS succeeded,
 count(*) FILTER (WHERE status = 'failed') AS failed FROM r""")
def q_run_summary(spark, sf_dir):
    return monitoring.monitor_run_summary(spark.sql(_RUNS, orders=table(spark, sf_dir, "orders")))


@query("rate_windows", """SELECT event_id, owner_key, CAST(floor(epoch(window_start)) AS BIGINT) AS window_epoch, count, count <= 3 AS allowed FROM (
 SELECT *, row_number() OVER (PARTITION BY owner_key, window_start ORDER BY ts, event_id) AS count
 FROM (SELECT *, date_trunc('hour', ts) AS window_start FROM {fx_usage}))""")
def q_rate(spark, sf_dir):
    out = usage.rate_window_counts(table(spark, sf_dir, "fx_usage"), "owner_key", 3)
    return out.select("event_id", "owner_key", F.unix_timestamp("window_start").alias("window_epoch"), "count", "allowed")


@query("usage_monthly", "SELECT owner_key, strftime(ts, '%Y-%m') AS period, " + ", ".join(
    f"CAST(sum(CASE WHEN metric = '{m}' THEN amount ELSE 0 END) AS BIGINT) AS {m}" for m in K.USAGE_LIMITS)
    + " FROM {fx_usage} GROUP BY ALL")
def q_usage(spark, sf_dir):
    return usage.usage_by_month(table(spark, sf_dir, "fx_usage"))


_TIGHT = {"audit_jobs": 4, "ai_fixes": 6, "gsc_syncs": 3, "pages_crawled": 25}


@query("usage_quota_single", """SELECT event_id, owner_key, period, metric, row_number() OVER (PARTITION BY owner_key, period, metric
 ORDER BY ts, event_id) <= CASE metric WHEN 'audit_jobs' THEN 4 WHEN 'ai_fixes' THEN 6 WHEN 'gsc_syncs' THEN 3 ELSE 25 END AS admitted
 FROM (SELECT *, strftime(ts, '%Y-%m') AS period FROM {fx_usage})""")
def q_quota_single(spark, sf_dir):
    events = table(spark, sf_dir, "fx_usage").withColumn("amount", F.lit(1))
    return usage.usage_quota(events, _TIGHT).select("event_id", "owner_key", "period", "metric", "admitted")


@query("usage_quota")
def q_quota(spark, sf_dir):
    return usage.usage_quota(table(spark, sf_dir, "fx_usage"), _TIGHT)


@query("job_state", """SELECT job_id, arg_max(status, seq) AS status, arg_max(attempts, seq) AS attempts, count(*) AS n_events,
 CAST(floor(epoch(max(ts))) AS BIGINT) AS updated_epoch FROM {fx_job_events} GROUP BY job_id""")
def q_job_state(spark, sf_dir):
    return jobs.job_state(table(spark, sf_dir, "fx_job_events")).select(
        "job_id", "status", "attempts", "n_events", F.unix_timestamp("updated_at").alias("updated_epoch"))


@query("stale_jobs", """SELECT job_id, attempts FROM (SELECT job_id, arg_max(status, seq) AS status, arg_max(attempts, seq) AS attempts, max(ts) AS ts
 FROM {fx_job_events} GROUP BY job_id) WHERE status = 'running' AND ts < TIMESTAMP '2024-01-20' - INTERVAL 5 MINUTE""")
def q_stale(spark, sf_dir):
    state = jobs.job_state(table(spark, sf_dir, "fx_job_events"))
    return jobs.stale_jobs(state, F.lit("2024-01-20").cast("timestamp")).select("job_id", "attempts")


@query("retryable_jobs", """SELECT job_id, attempts FROM (SELECT job_id, arg_max(status, seq) AS status, arg_max(attempts, seq) AS attempts
 FROM {fx_job_events} GROUP BY job_id) WHERE status = 'failed' AND attempts < 3""")
def q_retry(spark, sf_dir):
    return jobs.retryable_jobs(jobs.job_state(table(spark, sf_dir, "fx_job_events"))).select("job_id", "attempts")

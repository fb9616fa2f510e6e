"""Declared schemas of landed tables, as DDL."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(ddl: str) -> T.StructType:
    kinds = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(),
             "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "date": T.DateType(),
             "strings": T.ArrayType(T.StringType()), "floats": T.ArrayType(T.FloatType())}
    pairs = [part.split() for part in ddl.split(",")]
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in pairs])


CAPTURES = _schema("audit_id bigint, seq bigint, url string, final_url string, status int, content_type string, "
                   "load_time_ms int, html string, error string")
SEARCH_API = _schema("snapshot_id string, keys strings, clicks double, impressions double, ctr double, position double")
VECTORS = _schema("audit_id bigint, url string, vector floats")

HISTORY = {
    "projects": _schema("project_id string, owner string, name string, root_url string, created_at timestamp"),
    "audits": _schema("audit_id string, project_id string, owner string, root_url string, score int, pages_scanned int, "
                      "issue_count int, created_at timestamp, previous_audit_id string, score_delta int, "
                      "new_issue_count int, fixed_issue_count int"),
    "rate_limits": _schema("key string, count bigint, expires_at timestamp"),
    "keyword_analyses": _schema("analysis_id string, project_id string, owner string, name string, input_count int, "
                                "unique_count int, cluster_count int, result_json string, created_at timestamp"),
    "content_briefs": _schema("brief_id string, project_id string, owner string, name string, primary_keyword string, "
                              "status string, brief_json string, created_at timestamp, updated_at timestamp"),
    "internal_link_analyses": _schema("analysis_id string, project_id string, owner string, audit_id string, "
                                      "suggestion_count int, orphan_count int, result_json string, created_at timestamp"),
    "monitoring_configs": _schema("monitor_id string, project_id string, owner string, name string, root_url string, "
                                  "max_pages int, cadence string, enabled boolean, next_run_at timestamp, last_run_at timestamp, "
                                  "last_audit_id string, last_status string, last_error string, created_at timestamp, "
                                  "updated_at timestamp"),
    "monitoring_alerts": _schema("alert_id string, monitor_id string, owner string, audit_id string, severity string, "
                                 "kind string, title string, message string, created_at timestamp, read_at timestamp"),
    "audit_jobs": _schema("job_id string, owner_key string, owner string, project_id string, root_url string, max_pages int, "
                          "status string, phase string, current_url string, queued_urls int, progress int, pages_scanned int, "
                          "attempts int, audit_id string, report_key string, result_json string, error string, "
                          "created_at timestamp, updated_at timestamp, started_at timestamp, finished_at timestamp"),
    "search_console_snapshots": _schema("snapshot_id string, project_id string, owner string, site_url string, "
                                        "start_date date, end_date date, row_count int, created_at timestamp"),
    "usage_counters": _schema("owner_key string, period string, audit_jobs bigint, ai_fixes bigint, gsc_syncs bigint, "
                              "pages_crawled bigint, updated_at timestamp"),
}

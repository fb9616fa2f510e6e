"""Registered queries over the small row-wise operators: lookups, checks, escapes, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteloom.functions import constants as K
from siteloom.functions import text as X
from siteloom.functions import urls as U
from siteloom.functions import validation as V
from siteloom.operators import briefs, history, jobs, linkgraph, monitoring, recommendations, scoring
from siteloom.plans.history_queries import _MONITORS
from siteloom.plans.registry import query
from siteloom.plans.tables import table
from siteloom.sinks import writers
from siteloom.sources import readers


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


@query("link_resolution", """SELECT l.audit_id, l.src, l.dst, l.position, p.seq AS dst_seq FROM {fx_links} l
 JOIN {fx_pages} p ON p.audit_id = l.audit_id AND p.url = l.dst""")
def q_resolution(spark, sf_dir):
    out = linkgraph.link_resolution(table(spark, sf_dir, "fx_links"), table(spark, sf_dir, "fx_pages"))
    return out.select("audit_id", "src", "dst", "position", "dst_seq")


@query("owned_audits", """SELECT audit_id, owner, project_id FROM {fx_audits} WHERE project_id % 3 <> 1""")
def q_owned(spark, sf_dir):
    """Audits of every project; one project in three has passed to another owner."""
    audits = table(spark, sf_dir, "fx_audits")
    projects = audits.select(F.when(F.col("project_id") % 3 == 1, F.col("owner") + 1).otherwise(F.col("owner")).alias("owner"), "project_id").distinct()
    return history.owned_by(audits, projects).select("audit_id", "owner", "project_id")


@query("new_issue_flags", f"""WITH i AS (SELECT *, concat(code, '|', coalesce(nullif(url, ''), 'site-wide')) AS k FROM {{fx_issues}}),
 f AS (SELECT DISTINCT audit_id, k FROM i WHERE seq % 3 = 0)
 SELECT i.audit_id, i.seq, i.code, CASE WHEN f.k IS NULL THEN 'existing' ELSE 'new' END AS status FROM i LEFT JOIN f ON f.audit_id = i.audit_id AND f.k = i.k""")
def q_flags(spark, sf_dir):
    issues = table(spark, sf_dir, "fx_issues")
    return history.new_issue_flag(issues, issues.filter("seq % 3 = 0")).select("audit_id", "seq", "code", "status")


_STORED = "SELECT analysis_id, concat('c-', line_no % 7) AS cluster_id, count(*) AS size FROM {fx_keywords} GROUP BY analysis_id, line_no % 7"


@query("brief_sources", f"WITH c AS ({_STORED}) SELECT analysis_id, cluster_id, size FROM c")
def q_brief_source(spark, sf_dir):
    clusters = spark.sql(_STORED, fx_keywords=table(spark, sf_dir, "fx_keywords"))
    requests = table(spark, sf_dir, "fx_keywords").select("analysis_id", F.concat(F.lit("c-"), F.col("line_no") % 7).alias("cluster_id"))
    return briefs.brief_source(requests.distinct(), clusters)


_MENTIONS = """SELECT audit_id, page_id AS issue_id, CASE WHEN page_id % 2 = 0 THEN url END AS url,
 concat('See (', url, '), also https://site', page_id % 10, '.example.com/.') AS evidence FROM {fx_pages}"""


@query("issue_pages", f"""WITH m AS ({_MENTIONS}), u AS (
   SELECT audit_id, issue_id, url FROM m WHERE url IS NOT NULL
   UNION SELECT audit_id, issue_id, regexp_extract(evidence, '\\((.*?)\\)', 1) FROM m
   UNION SELECT audit_id, issue_id, regexp_extract(evidence, 'also (.*)[.]$', 1) FROM m)
 SELECT u.audit_id, u.issue_id, u.url, row_number() OVER (PARTITION BY u.audit_id, u.issue_id ORDER BY p.seq) AS nth
 FROM u JOIN {{fx_pages}} p ON p.audit_id = u.audit_id AND p.url = u.url""")
def q_issue_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "fx_pages")
    out = recommendations.issue_pages(spark.sql(_MENTIONS, fx_pages=pages), pages.select("audit_id", "url", "seq"))
    return out.select("audit_id", "issue_id", "url", F.col("nth").cast("long").alias("nth"))


@query("issue_context", f"""WITH m AS ({_MENTIONS}), u AS (
   SELECT audit_id, issue_id, url FROM m WHERE url IS NOT NULL
   UNION SELECT audit_id, issue_id, regexp_extract(evidence, '\\((.*?)\\)', 1) FROM m
   UNION SELECT audit_id, issue_id, regexp_extract(evidence, 'also (.*)[.]$', 1) FROM m),
 n AS (SELECT u.audit_id, u.issue_id, count(*) AS n, string_agg(p.url, ' ' ORDER BY p.seq) AS urls FROM u JOIN {{fx_pages}} p ON p.audit_id = u.audit_id AND p.url = u.url GROUP BY ALL)
 SELECT m.audit_id, m.issue_id, CAST(coalesce(n, 0) AS INT) AS affected_page_count, coalesce(n, 0) > 1 AS shared, urls FROM m LEFT JOIN n USING (audit_id, issue_id)""")
def q_issue_context(spark, sf_dir):
    pages = table(spark, sf_dir, "fx_pages").withColumns({"h1s": F.array("h1"), "heading_count": F.col("h1_count")})
    out = recommendations.ai_issue_context(spark.sql(_MENTIONS, fx_pages=pages), pages)
    return out.select("audit_id", "issue_id", "affected_page_count", F.col("guidance").startswith("Provide a shared").alias("shared"),
                      F.array_join("affected_pages.url", " ").alias("urls"))


@query("unread_alerts", "SELECT user_id AS owner, count(*) FILTER (WHERE event_type <> 'view') AS unread FROM {events} GROUP BY user_id")
def q_unread(spark, sf_dir):
    alerts = table(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), F.expr("CASE WHEN event_type = 'view' THEN ts END").alias("read_at"))
    return monitoring.unread_alerts(alerts)


@query("oldest_queued_jobs", """SELECT job_id, attempts FROM {fx_job_events} WHERE status = 'queued' AND attempts < """ + str(K.MAX_ATTEMPTS) + " ORDER BY ts, job_id LIMIT 4")
def q_oldest(spark, sf_dir):
    queue = table(spark, sf_dir, "fx_job_events").withColumnRenamed("ts", "created_at")
    return jobs.oldest_queued_jobs(queue).select("job_id", "attempts")


@query("final_url_dedup", """SELECT audit_id, final_url, min(seq) AS seq, arg_min(url, seq) AS url FROM (
 SELECT page_id % 10 AS audit_id, regexp_extract(url, '^[^?#]*') AS final_url, page_id AS seq, url FROM {pages}) GROUP BY ALL""")
def q_final(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("audit_id"), F.regexp_extract("url", "^[^?#]*", 0).alias("final_url"),
                                                 F.col("page_id").alias("seq"), "url")
    return linkgraph.final_url_dedup(pages)


@query("issues_by_severity", "SELECT audit_id, seq, code FROM {fx_issues} WHERE severity = 'high'")
def q_by_severity(spark, sf_dir):
    return scoring.issues_by_severity(table(spark, sf_dir, "fx_issues").withColumn("rule_no", F.lit(0)), "high").select("audit_id", "seq", "code")


_FIELDS = """SELECT p_partkey, p_size, substr(p_name, 1, CAST(p_size % 5 AS INT)) AS name, CASE p_size % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'odd' END AS intent,
 CASE p_size % 4 WHEN 0 THEN 'landing' ELSE p_brand END AS page_type, CASE p_size % 2 WHEN 0 THEN 'draft' ELSE p_type END AS status,
 CASE p_size % 6 WHEN 0 THEN 'critical' WHEN 1 THEN 'HIGH' END AS severity FROM {part}"""


@query("request_checks", f"""WITH f AS ({_FIELDS}) SELECT p_partkey, CAST(CASE WHEN p_size IN (5, 10, 25) THEN p_size ELSE 10 END AS INT) AS page_limit,
 coalesce(length(trim(regexp_replace(name, '\\s+', ' ', 'g'))) BETWEEN 2 AND 80, false) AS name_ok, coalesce(intent IN ({_quoted(K.INTENTS)}), false) AS intent_ok,
 coalesce(page_type IN ({_quoted(K.OUTLINES)}), false) AS page_type_ok, coalesce(status IN ({_quoted(K.BRIEF_STATUSES)}), false) AS status_ok,
 coalesce(severity IN ({_quoted(K.SEVERITIES)}), false) AS severity_ok FROM f""")
def q_checks(spark, sf_dir):
    f, c = spark.sql(_FIELDS, part=table(spark, sf_dir, "part")), F.col
    return f.select("p_partkey", V.page_limit(c("p_size")).cast("int").alias("page_limit"), V.valid_name(c("name")).alias("name_ok"),
                    V.valid_intent(c("intent")).alias("intent_ok"), V.valid_page_type(c("page_type")).alias("page_type_ok"),
                    V.valid_status(c("status")).alias("status_ok"), V.valid_severity(c("severity")).alias("severity_ok"))


_ANCHORS = """SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN concat(h1, ' | Brand') ELSE h1 END AS h1,
 CASE page_id % 2 WHEN 0 THEN '' ELSE concat(title, ' - Site') END AS title FROM {fx_pages}"""


@query("anchor_texts", f"""WITH a AS ({_ANCHORS}) SELECT page_id, substr(trim(regexp_replace(regexp_replace(
 coalesce(nullif(h1, ''), nullif(title, ''), nullif(regexp_extract(url, '^https?://[^/]*/(?:.*/)?([^/]+)/*$', 1), ''), 'Learn more'),
 '\\s*[|—–-]\\s*[^|—–]+$', ''), '\\s+', ' ', 'g')), 1, 90) AS anchor FROM a""")
def q_anchor(spark, sf_dir):
    rows = spark.sql(_ANCHORS, fx_pages=table(spark, sf_dir, "fx_pages"))
    return rows.select("page_id", U.anchor_text(F.col("h1"), F.col("title"), F.col("url")).alias("anchor"))


@query("job_progress", """SELECT page_id, CAST(CASE page_id % 3 WHEN 0 THEN 5 WHEN 1 THEN 95 ELSE
 least(92, greatest(8, floor(greatest(0, load_time_ms % 30 - 2) / 25.0::DOUBLE * 84 + 0.5) + 8)) END AS INT) AS progress FROM {fx_pages}""")
def q_progress(spark, sf_dir):
    phase = F.expr("CASE page_id % 3 WHEN 0 THEN 'discovering' WHEN 1 THEN 'finalizing' ELSE 'crawling' END")
    return table(spark, sf_dir, "fx_pages").select("page_id", jobs.job_progress(F.expr("load_time_ms % 30 - 2"), F.lit(25), phase).alias("progress"))


@query("owner_keys", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN concat('user:u', user_id, '@example.com') ELSE concat('ip:', sha256(concat('10.0.', user_id % 256, '.1'))) END AS owner_key FROM {events}""")
def q_owner(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    email = F.expr("CASE event_id % 3 WHEN 0 THEN concat('u', user_id, '@example.com') WHEN 1 THEN '' END")
    return e.select("event_id", X.owner_key(email, F.expr("concat('10.0.', user_id % 256, '.1')")).alias("owner_key"))


_RAW = "CASE p_partkey % 6 WHEN 0 THEN 'abc' WHEN 1 THEN '-3' WHEN 2 THEN '7.9' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE CAST(p_size AS VARCHAR(10)) END"


@query("positive_limits", "SELECT p_partkey, CAST(CASE p_partkey % 6 WHEN 2 THEN 7 WHEN 5 THEN p_size ELSE 50 END AS BIGINT) AS n FROM {part}")
def q_limits(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.positive_limit(F.expr(_RAW.replace("VARCHAR(10)", "STRING")), 50).alias("n"))


_ODD = """SELECT conv_id, turn, concat(text, CASE conv_id % 4 WHEN 0 THEN ' "q" <b>' WHEN 1 THEN concat(' a', chr(13), chr(10), 'b') WHEN 2 THEN ' & it''s, so' ELSE '' END) AS t
 FROM {conversations}"""


def _cell(c: str) -> str:
    flat = f"regexp_replace(coalesce(CAST({c} AS VARCHAR), ''), '\\r?\\n', ' ', 'g')"
    return f"CASE WHEN regexp_matches({flat}, '[\",\\n]') THEN concat('\"', replace({flat}, '\"', '\"\"'), '\"') ELSE {flat} END"


def _html(c: str) -> str:
    return f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '''', '&#39;'), '\"', '&quot;')"


@query("escaped_texts", f"WITH o AS ({_ODD}) SELECT conv_id, turn, {_cell('t')} AS csv, {_html('t')} AS html FROM o")
def q_escaped(spark, sf_dir):
    o = spark.sql(_ODD, conversations=table(spark, sf_dir, "conversations"))
    return o.select("conv_id", "turn", X.csv_cell(F.col("t")).alias("csv"), X.html_escape(F.col("t")).alias("html"))


@query("monitor_switches", f"""WITH m AS ({_MONITORS}) SELECT monitor_id, CASE WHEN monitor_id % 2 = 0 THEN monitor_id % 3 = 0 ELSE enabled END AS enabled,
 strftime(CASE WHEN monitor_id % 6 = 0 THEN TIMESTAMP '2001-01-01' ELSE next_run_at END, '%Y-%m-%d %H:%M:%S') AS next_run_at FROM m""")
def q_switches(spark, sf_dir):
    monitors = spark.sql(_MONITORS, orders=table(spark, sf_dir, "orders"))
    switches = monitors.filter("monitor_id % 2 = 0").select("monitor_id", F.expr("monitor_id % 3 = 0").alias("enable"))
    out = monitoring.set_monitor_enabled(monitors, switches, F.lit("2001-01-01").cast("timestamp"))
    return out.select("monitor_id", "enabled", F.date_format("next_run_at", "yyyy-MM-dd HH:mm:ss").alias("next_run_at"))


@query("landed_search_rows", """SELECT snapshot_id, query, page, CASE WHEN impressions % 2 = 0 THEN 0 ELSE clicks END AS clicks, impressions FROM {fx_search_rows} WHERE impressions % 5 <> 0""")
def q_search_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "fx_search_rows")
    api = rows.select("snapshot_id", F.expr("array(query, CASE WHEN impressions % 5 = 0 THEN '' ELSE page END)").alias("keys"),
                      F.expr("CASE WHEN impressions % 2 <> 0 THEN clicks END").alias("clicks"), "impressions", "ctr", "position")
    return readers.search_rows(api).select("snapshot_id", "query", "page", "clicks", "impressions")


@query("stored_results", """SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN p_size END AS size, CASE WHEN p_partkey % 4 <> 0 THEN p_name END AS name FROM {part}""")
def q_stored(spark, sf_dir):
    doc = F.expr("""concat('{"size": ', p_size, ', "name": "', p_name, '"', CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '}' END)""")
    rows = readers.read_result_json(table(spark, sf_dir, "part").withColumn("doc", doc), "doc", "size int, name string")
    return rows.select("p_partkey", "result.size", "result.name")


@query("issues_csv", f"""WITH i AS (SELECT *, concat(code, '|', coalesce(nullif(url, ''), 'site-wide')) AS k FROM {{fx_issues}}),
 f AS (SELECT DISTINCT audit_id, k FROM i WHERE seq % 3 = 0),
 s AS (SELECT i.*, CASE WHEN f.k IS NULL THEN 'existing' ELSE 'new' END AS status FROM i LEFT JOIN f ON f.audit_id = i.audit_id AND f.k = i.k)
 SELECT audit_id, seq, {" || ',' || ".join(f"({_cell(c)})" for c in writers.ISSUE_COLUMNS)} AS value FROM s""")
def q_issues_csv(spark, sf_dir):
    issues = table(spark, sf_dir, "fx_issues").withColumn("rule_no", F.lit(0))
    return writers.issues_csv(issues, issues.filter("seq % 3 = 0")).select("audit_id", "seq", "value")


@query("audit_html_rows", f"""SELECT audit_id, seq, concat('<tr><td>', {_html("CASE severity " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.SEVERITY_LABEL.items()) + " END")},
 '</td><td>', {_html('title')}, '</td><td>', {_html("coalesce(url, 'Site-wide')")}, '</td><td>', {_html('recommendation')}, '</td></tr>') AS value FROM {{fx_issues}}""")
def q_html_rows(spark, sf_dir):
    issues = table(spark, sf_dir, "fx_issues").withColumns({"first_seq": F.col("seq"), "first_rule": F.lit(0)})
    return writers.audit_html_rows(issues).select("audit_id", F.col("first_seq").alias("seq"), "value")

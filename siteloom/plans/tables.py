"""Input tables of the registered queries: the landed parquet files and the tables derived from them.

A derivation is one SQL text that both Spark and the checking engine accept; ``{name}`` stands for another table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

LANDED = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]


def _capture_kind(k: str) -> str:
    """What became of capture ``k`` of an audit: 0 left the site, 1 landed on the root, 2 failed, 3 to 5 no page, 6 in a closed folder, else a page."""
    return f"CASE WHEN {k} % 3 = 0 AND {k} > 0 THEN (CAST(floor({k} / 3) AS BIGINT) + audit_id) % 9 ELSE 8 END"


def _capture_url(k: str, kind: str) -> str:
    return (f"concat('https://site', audit_id, '.example.com', CASE WHEN {k} = 0 THEN '/' WHEN {kind} = 6 THEN concat('/blocked/p', {k}) "
            f"ELSE concat('/s', {k} % 4, '/p', {k}) END)")


def _capture_link(j: int) -> str:
    """A link to child ``j`` of a page; the pages of an audit form a tree of three children a page."""
    k = f"(3 * k + {j})"
    path = _capture_url(k, _capture_kind(k)).replace("'https://site', audit_id, '.example.com', ", "")
    return f"""concat('<a href="', {path}, '">c</a>', CASE WHEN k % 3 = 1 THEN concat('<a href="', {path}, '?utm_source=x">again</a>') ELSE '' END)"""


DERIVED = {
    "fx_captures": f"""
SELECT audit_id, k, kind, url, true AS main, page_id AS seq, load_time_ms,
  CASE kind WHEN 0 THEN concat('https://elsewhere.example.org/p', k) WHEN 1 THEN concat('https://site', audit_id, '.example.com/') ELSE url END AS final_url,
  CASE kind WHEN 3 THEN 500 WHEN 4 THEN 404 WHEN 5 THEN 410 ELSE status END AS status,
  CASE kind WHEN 2 THEN NULL WHEN 3 THEN 'application/pdf' WHEN 4 THEN 'text/plain' WHEN 5 THEN 'text/plain' ELSE 'Text/HTML; charset=utf-8' END AS content_type,
  CASE WHEN kind = 2 THEN concat('The fetch of p', k, ' failed.') END AS error,
  replace(replace(replace(
    CASE WHEN page_id % 29 = 6 THEN regexp_replace(body, '<html lang="[a-z]*"', '<html') ELSE body END,
    '</title>', CASE WHEN page_id % 19 = 4 THEN ' with a suffix that takes every title past the limit of sixty-five</title>' ELSE '</title>' END),
    '<head>', concat('<head><meta name="Description" content="', description, '"><link rel="canonical" href="', canonical, '"><meta name="ROBOTS" content="', robots,
      '"><meta property="og:title" content="', CASE WHEN page_id % 2 = 0 THEN 'Shared' ELSE '' END, '"><meta property="og:description" content="', description, '">',
      CASE WHEN page_id % 2 = 0 THEN '<script type="application/ld+json">[]</script>' ELSE '' END)),
    '<nav>', concat('<nav><svg><title>no</title></svg><a href="/">home</a>', {_capture_link(1)}, {_capture_link(2)}, {_capture_link(3)},
      '<a href="https://partner.example.net/x?y=1#z">out</a><img src="a.png" alt="">', CASE WHEN page_id % 4 = 1 THEN '<img src="b.png">' ELSE '' END,
      CASE WHEN page_id % 13 = 4 THEN '<h1>Second heading</h1>' ELSE '' END)) AS html
FROM (
  SELECT *, {_capture_url('k', 'kind')} AS url,
    CASE page_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'https://other.example/x' WHEN 2 THEN concat({_capture_url('k', 'kind')}, '#main')
      WHEN 3 THEN 'ftp://bad/' ELSE {_capture_url('k', 'kind')} END AS canonical
  FROM (SELECT *, {_capture_kind('k')} AS kind FROM (
    SELECT page_id, page_id % 10 AS audit_id, CAST(floor(page_id / 10) AS BIGINT) AS k, CAST((page_id * 37) % 5000 AS INT) AS load_time_ms,
      CASE page_id % 50 WHEN 17 THEN 500 WHEN 18 THEN 404 WHEN 25 THEN 301 ELSE 200 END AS status,
      CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'short text' WHEN 2 THEN repeat('long.', 40)
         WHEN 3 THEN 'Shared description used by several pages of one site so that the duplicate rule has work'
         ELSE concat('Unique description number ', page_id, ' padded to pass the minimum length of seventy characters') END AS description,
      CASE page_id % 11 WHEN 5 THEN 'noindex,follow' WHEN 6 THEN 'NoIndexed' ELSE 'index,follow' END AS robots,
      CASE WHEN page_id % 13 = 3 THEN replace(replace(html, '<h1>', '<h2>'), '</h1>', '</h2>')
           WHEN page_id % 23 = 7 THEN regexp_replace(html, '<title>.*?</title>', '<title> </title>') ELSE html END AS body
    FROM {{pages}}) p) q) r""",
    "fx_all_captures": """
SELECT * FROM {fx_captures}
UNION ALL SELECT audit_id, k, kind, url, false, seq - 1000000000, load_time_ms, url, 200, 'text/html', NULL, '<html><title>An older capture</title></html>'
FROM {fx_captures} WHERE k % 5 = 2
UNION ALL SELECT audit_id, k, kind, concat(url, '?utm_source=zz'), false, seq + 1000000000, load_time_ms, url, 200, 'text/html', NULL, '<html><title>A variant</title></html>'
FROM {fx_captures} WHERE k % 5 = 4""",
    "fx_pages": """
SELECT p.*,
  CASE page_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'https://other.example/x' WHEN 2 THEN concat(url, '#main')
       WHEN 3 THEN 'ftp://bad/' ELSE url END AS canonical,
  CASE WHEN page_id % 2 = 0 THEN title ELSE '' END AS og_title, description AS og_description
FROM (
  SELECT page_id, page_id % 10 AS audit_id, page_id AS seq,
    CASE WHEN page_id < 10 THEN concat('https://site', page_id % 10, '.example.com/')
         ELSE concat('https://site', page_id % 10, '.example.com/s', CAST(floor(page_id / 10) AS INT) % 4, '/p', page_id) END AS url,
    CASE page_id % 50 WHEN 17 THEN 500 WHEN 18 THEN 404 WHEN 19 THEN 301 ELSE 200 END AS status,
    'text/html' AS content_type, CAST((page_id * 37) % 5000 AS INT) AS load_time_ms,
    CASE WHEN page_id % 23 = 7 THEN '' ELSE regexp_extract(html, '<title>(.*?)</title>', 1) END AS title,
    CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'short text' WHEN 2 THEN repeat('long.', 40)
         WHEN 3 THEN 'Shared description used by several pages of one site so that the duplicate rule has work'
         ELSE concat('Unique description number ', page_id, ' padded to pass the minimum length of seventy characters') END AS description,
    CASE page_id % 11 WHEN 5 THEN 'noindex,follow' WHEN 6 THEN 'NoIndexed' ELSE 'index,follow' END AS robots,
    regexp_extract(html, '<html lang="([a-z]*)"', 1) AS lang,
    regexp_extract(html, '<h1>(.*?)</h1>', 1) AS h1,
    CASE page_id % 13 WHEN 3 THEN 0 WHEN 4 THEN 2 ELSE 1 END AS h1_count,
    CAST(floor(length(html) / 12) AS INT) AS word_count,
    CAST(page_id % 4 AS INT) AS image_count,
    CASE WHEN page_id % 3 = 0 THEN CAST(page_id % 4 AS INT) ELSE 0 END AS images_missing_alt
  FROM {pages}) p""",
    "fx_links": """
SELECT s.audit_id, s.page_id AS src_id, s.url AS src, t.url AS dst, k AS position
FROM (SELECT audit_id, page_id, url, k, page_id + 10 * k * (1 + page_id % 3) AS dst_id
      FROM (SELECT audit_id, page_id, url, 1 AS k FROM {fx_pages} UNION ALL SELECT audit_id, page_id, url, 2 FROM {fx_pages}
            UNION ALL SELECT audit_id, page_id, url, 3 FROM {fx_pages}) u) s
JOIN {fx_pages} t ON t.page_id = s.dst_id""",
    "fx_search_rows": """
SELECT CAST(p_size % 5 AS INT) AS snapshot_id, p_name AS query, concat('https://shop.example/', p_brand) AS page,
  CAST(sum(CASE WHEN l_returnflag = 'R' AND l_linenumber > 6 THEN 1 ELSE 0 END) AS DOUBLE) AS clicks,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS impressions,
  CAST(sum(CASE WHEN l_returnflag = 'R' AND l_linenumber > 6 THEN 1 ELSE 0 END) AS DOUBLE) / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS ctr,
  CAST(1 + min(l_partkey) % 30 AS DOUBLE) + 0.5 AS position
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY p_size % 5, p_name, p_brand""",
    "fx_keywords": """
SELECT CAST(p_partkey % 50 AS INT) AS analysis_id, p_partkey AS line_no,
  concat(CASE WHEN p_partkey % 9 = 0 THEN upper(p_name) ELSE p_name END,
    CASE CAST(floor(p_partkey / 50) AS INT) % 8 WHEN 0 THEN '' WHEN 1 THEN ' price' WHEN 2 THEN ' best' WHEN 3 THEN ' guide'
      WHEN 4 THEN ' official website' WHEN 5 THEN ' in kyiv' WHEN 6 THEN ' how to' ELSE ' CHECKLIST' END) AS raw
FROM {part}""",
    "fx_audits": """
SELECT o_orderkey AS audit_id, CAST(o_custkey % 100 AS INT) AS owner, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey END AS project_id,
  concat('https://c', o_custkey % 3, '.example.com/') AS root_url, CAST((o_orderkey * 31) % 101 AS INT) AS score,
  CAST(o_orderkey % 26 AS INT) AS pages_scanned, o_orderdate AS created_at FROM {orders}""",
    "fx_issues": """
SELECT l_orderkey AS audit_id, l_partkey * 100 + l_linenumber AS seq, concat('rule-', l_partkey % 20) AS code,
  CASE l_partkey % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity,
  concat('Rule ', l_partkey % 20) AS title, concat('Fix ', l_partkey % 20) AS recommendation,
  CASE WHEN l_suppkey % 11 = 0 THEN NULL
       ELSE concat('https://c.example.com/p', l_linenumber, CASE WHEN l_suppkey % 2 = 0 THEN '/' ELSE '' END) END AS url,
  CASE WHEN l_suppkey % 5 = 0 THEN concat('Affected URLs:', chr(10), 'https://c.example.com/p', l_partkey % 9) ELSE NULL END AS evidence
FROM {lineitem}""",
    "fx_usage": """
SELECT event_id, concat('user:', user_id) AS owner_key, ts,
  CASE event_type WHEN 'view' THEN 'audit_jobs' WHEN 'purchase' THEN 'ai_fixes' WHEN 'signup' THEN 'gsc_syncs' ELSE 'pages_crawled' END AS metric,
  CAST(1 + event_id % 3 AS INT) AS amount FROM {events}""",
    "fx_recommendations": """
SELECT conv_id, turn, substr(text, 1, 120) AS summary, substr(text, 121, 120) AS why_it_matters, substr(text, 241, 300) AS implementation,
  CASE conv_id % 10 WHEN 0 THEN 'we guarantee rankings' WHEN 1 THEN 'buy backlinks' ELSE '' END AS code, CAST(conv_id % 4 AS INT) AS n_verification
FROM {conversations} WHERE role = 'assistant'""",
    "fx_job_events": """
SELECT CAST(floor(event_id / 4) AS BIGINT) AS job_id, event_id AS seq, ts,
  CASE WHEN event_id % 4 = 0 THEN 'queued' WHEN event_id % 4 < 3 THEN 'running'
       WHEN CAST(floor(event_id / 4) AS BIGINT) % 3 = 0 THEN 'completed' WHEN CAST(floor(event_id / 4) AS BIGINT) % 3 = 1 THEN 'failed' ELSE 'running' END AS status,
  CAST(CAST(floor(event_id / 4) AS BIGINT) % 4 AS INT) AS attempts FROM {events}""",
}
# Same rows as the text above; written with a generator, which reads the pages once.
SPARK_FORM = {
    "fx_links": """
SELECT s.audit_id, s.page_id AS src_id, s.url AS src, t.url AS dst, k AS position
FROM (SELECT audit_id, page_id, url, explode(array(1, 2, 3)) AS k FROM {fx_pages}) s
JOIN {fx_pages} t ON t.page_id = s.page_id + 10 * k * (1 + s.page_id % 3)""",
}
_REF = re.compile(r"\{(\w+)\}")


KEYS = {"lineitem": "l_orderkey", "orders": "o_orderkey", "events": "event_id", "pages": "page_id", "part": "p_partkey",
        "conversations": "conv_id"}


def landed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One landed file. A scan with fewer splits than cores (one row group) is spread by key first.

    Large inputs have far more splits than cores and are left as they are.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in KEYS and cores > 1 and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores, KEYS[name])
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A landed or derived table as a lazy DataFrame."""
    if name in LANDED:
        return landed(spark, sf_dir, name)
    sql = SPARK_FORM.get(name, DERIVED[name])
    inputs = {ref: table(spark, sf_dir, ref) for ref in dict.fromkeys(_REF.findall(sql))}
    return spark.sql(sql, **inputs)


def with_tables(body: str) -> str:
    """SQL for the checking engine: ``{name}`` references become CTEs (derived) or plain view names (landed)."""
    order: list[str] = []

    def visit(sql: str) -> None:
        for ref in dict.fromkeys(_REF.findall(sql)):
            if ref in DERIVED and ref not in order:
                visit(DERIVED[ref])
                order.append(ref)

    visit(body)
    ctes = [f"{n} AS ({_REF.sub(lambda m: m.group(1), DERIVED[n])})" for n in order]
    text = _REF.sub(lambda m: m.group(1), body).strip()
    if not ctes:
        return text
    if text.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(ctes) + ", " + text[len("WITH RECURSIVE"):].strip()
    if text.upper().startswith("WITH "):
        return "WITH " + ", ".join(ctes) + ", " + text[5:].strip()
    return "WITH " + ", ".join(ctes) + " " + text

"""Registered queries over raw captures: page fields from HTML, and the whole audit with robots, sitemaps, errors and redirects."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteloom.functions.html import FEATURES, extract_page_features
from siteloom.plans.audit import audit_captures
from siteloom.plans.audit_queries import ALL_ISSUES_SQL, SCORE_SQL, _N
from siteloom.plans.registry import query
from siteloom.plans.tables import table

BOT = "sitebot"
#: Captures are read without the columns that only the checking SQL uses.
COLUMNS = ["audit_id", "seq", "url", "final_url", "status", "content_type", "load_time_ms", "html", "error"]

# Page fields of the landed markup by regular expressions.
_TEXT = lambda x: f"""replace(replace(replace(replace(replace(replace({x}, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"""
_FLAT = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
_META = lambda key, name: f"""trim(regexp_extract(html, '<meta {key}="{name}" content="(.*?)">', 1))"""
_BARE = """regexp_replace(regexp_replace(regexp_extract(html, '(?s)<body>(.*?)(?:</body>|$)', 1), '(?s)<!--.*?-->|<svg>.*?</svg>|<script.*?</script>|<style>.*?</style>', '', 'g'), '<[^>]*>', '', 'g')"""
_WORDS = f"CAST(len(list_filter(regexp_split_to_array({_TEXT(_BARE)}, '\\s+'), lambda w: w <> '')) AS INT)"
_ESCAPED = "replace(replace(replace(replace(url_encode(h), '%2F', '/'), '%2C', ','), '%3F', '?'), '%3D', '=')"
FIELDS_SQL = f"""SELECT audit_id, url, k, kind, seq, status, content_type, final_url, error, load_time_ms,
  {_FLAT(_TEXT("regexp_extract(html, '<title>(.*?)</title>', 1)"))} AS title, {_META('name', 'Description')} AS description,
  regexp_extract(html, '<link rel="canonical" href="(.*?)">', 1) AS canonical, {_META('name', 'ROBOTS')} AS robots,
  regexp_extract(html, '<html lang="([a-z]*)"', 1) AS lang,
  list_transform(regexp_extract_all(html, '(?s)<h1>(.*?)</h1>', 1), lambda h: {_FLAT(_TEXT("regexp_replace(h, '<[^>]*>', '', 'g')"))}) AS h1,
  CAST(len(regexp_extract_all(html, '<h[1-6]>')) AS INT) AS heading_count, {_WORDS} AS word_count,
  CAST(len(regexp_extract_all(html, '<img ')) AS INT) AS image_count, CAST(len(regexp_extract_all(html, '<img src="b.png">')) AS INT) AS images_missing_alt,
  list_transform(list_filter(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda h: starts_with(h, '/')),
    lambda h: concat('https://site', audit_id, '.example.com', {_ESCAPED})) AS internal,
  CAST(len(regexp_extract_all(html, 'application/ld.json')) AS INT) AS schema_count,
  {_META('property', 'og:title')} AS og_title, {_META('property', 'og:description')} AS og_description, html
  FROM {{fx_captures}}"""
_LISTED = "array_to_string(list_transform(list_filter(list_zip(x, range(1, len(x) + 1)), lambda p: list_position(x, p[1]) = p[2]), lambda p: p[1]), ' ')"


@query("capture_features", f"""WITH f AS ({FIELDS_SQL}), g AS (SELECT *, internal AS x FROM f WHERE kind NOT IN (0, 1))
 SELECT audit_id, url, title, description, canonical, CASE WHEN canonical <> '' THEN canonical END AS canonical_resolved, robots, lang,
   array_to_string(list_filter(h1, lambda h: h <> ''), ' | ') AS h1, heading_count, word_count, image_count, images_missing_alt,
   {_LISTED} AS internal_links, 'https://partner.example.net/x?y=1' AS external_links, schema_count, og_title, og_description FROM g""")
def q_capture_features(spark, sf_dir):
    """All page fields of every captured body."""
    pages = table(spark, sf_dir, "fx_captures").filter("kind not in (0, 1)").select("audit_id", "url", "html")
    lists = {"h1": " | ", "internal_links": " ", "external_links": " "}
    fields = extract_page_features(pages)
    return fields.select("audit_id", "url", *[F.array_join(f.name, lists[f.name]).alias(f.name) if f.name in lists else f.name for f in FEATURES.fields])


def robots_docs(spark, sf_dir):
    """A robots file for two audits in three."""
    audits = table(spark, sf_dir, "fx_captures").filter("k = 0 and audit_id % 3 <> 2").select("audit_id")
    site = F.concat(F.lit("https://site"), "audit_id", F.lit(".example.com"))
    return audits.select("audit_id", F.concat(F.lit("User-agent: *\nDisallow: /blocked/ # closed\nSitemap: "), site, F.lit("/absent.xml")).alias("body"))


def sitemap_docs(spark, sf_dir):
    """Sitemaps of three audits in four: an index of files of fifty URLs that list every capture."""
    rows = table(spark, sf_dir, "fx_captures").filter("audit_id % 4 <> 3").select(
        "audit_id", "k", F.floor(F.col("k") / 50).alias("part"), F.concat(F.lit("<url><loc>"), "url", F.lit("</loc></url>")).alias("loc"))
    site = F.concat(F.lit("https://site"), F.col("audit_id"), F.lit(".example.com"))
    files = rows.groupBy("audit_id", "part").agg(F.array_join(F.array_sort(F.collect_list(F.struct("k", "loc")))["loc"], "").alias("locs"))
    maps = files.select("audit_id", F.concat(site, F.lit("/map-"), "part", F.lit(".xml")).alias("doc_url"),
                        F.concat(F.lit("<urlset>"), "locs", F.lit("</urlset>")).alias("body"))
    entry = F.concat(F.lit("<sitemap><loc>/map-"), "part", F.lit(".xml</loc></sitemap>"))
    index = files.groupBy("audit_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("part", entry.alias("e"))))["e"], "").alias("es"))
    return maps.unionByName(index.select("audit_id", F.concat(site, F.lit("/sitemap.xml")).alias("doc_url"),
                                         F.concat(F.lit("<sitemapindex>"), "es", F.lit("</sitemapindex>")).alias("body")))


def landed_audit(spark, sf_dir):
    captures = table(spark, sf_dir, "fx_all_captures").select(*COLUMNS)
    roots = table(spark, sf_dir, "fx_captures").filter("k = 0").select("audit_id", F.col("url").alias("root_url"))
    return audit_captures(captures, roots, robots_docs(spark, sf_dir), sitemap_docs(spark, sf_dir), BOT, max_pages=1 << 30)


def _response(key: str, where: str, url: str, evidence: str = "NULL", description: str = "r.description") -> str:
    return f"""SELECT c.audit_id, 0 AS seq, r.rule_no, r.code, r.severity, r.title, {description} AS description, r.recommendation, {url} AS url,
      CAST({evidence} AS VARCHAR) AS evidence, CAST(NULL AS BIGINT) AS n_affected FROM reached c JOIN rules r ON r.rule_no = {_N[key]} WHERE {where}"""


_OPEN = "NOT (c.kind = 6 AND c.audit_id % 3 <> 2)"
_RESPONSES = " UNION ALL BY NAME ".join([
    _response("robots-blocked", "c.kind = 6 AND c.audit_id % 3 <> 2", "c.url"),
    _response("external-redirect", "c.kind = 0", "c.url", "c.final_url"),
    _response("crawl-failed", "c.kind = 2", "c.url", description="c.error"),
    _response("other-5xx", "c.kind = 3", "c.url", "concat('HTTP ', c.status)"), _response("other-404", "c.kind = 4", "c.url"),
    _response("other-4xx", "c.kind = 5", "c.url", "concat('HTTP ', c.status)")])
_MISSING = " UNION ALL BY NAME ".join(
    f"""SELECT c.audit_id, 0 AS seq, r.rule_no, r.code, r.severity, r.title, r.description, r.recommendation, c.url, CAST(NULL AS VARCHAR) AS evidence,
      CAST(NULL AS BIGINT) AS n_affected FROM caps c JOIN rules r ON r.rule_no = {_N[key]} WHERE c.k = 0 AND {where}"""
    for key, where in (("robots-missing", "c.audit_id % 3 = 2"), ("sitemap-missing", "c.audit_id % 4 = 3")))
# A page's children are reached when the page is; a sitemap reaches every capture of its audit.
AUDIT_SQL = f"""WITH RECURSIVE caps AS ({FIELDS_SQL}),
walk AS (SELECT audit_id, k FROM caps WHERE k = 0 UNION ALL
  SELECT c.audit_id, c.k FROM walk w JOIN caps p ON p.audit_id = w.audit_id AND p.k = w.k JOIN caps c ON c.audit_id = w.audit_id AND c.k BETWEEN 3 * w.k + 1 AND 3 * w.k + 3
  WHERE p.kind NOT IN (0, 1, 2, 3, 4, 5) AND NOT (p.kind = 6 AND p.audit_id % 3 <> 2)),
reached AS (SELECT c.* FROM caps c LEFT JOIN walk w ON w.audit_id = c.audit_id AND w.k = c.k WHERE c.audit_id % 4 <> 3 OR w.k IS NOT NULL),
cap_pages AS (SELECT *, CAST(len(list_filter(h1, lambda h: h <> '')) AS INT) AS h1_count FROM reached c WHERE c.kind > 5 AND {_OPEN}),
cap_links AS (SELECT p.audit_id, c.url AS dst, unnest(CASE WHEN p.k % 3 = 1 THEN [1, 2] ELSE [1] END) AS again FROM cap_pages p
  JOIN caps c ON c.audit_id = p.audit_id AND c.k BETWEEN 3 * p.k + 1 AND 3 * p.k + 3
  UNION ALL SELECT p.audit_id, c.url, 1 FROM cap_pages p JOIN caps c ON c.audit_id = p.audit_id AND c.k = 0),
{ALL_ISSUES_SQL.replace("{fx_pages}", "cap_pages").replace("{fx_links}", "cap_links").replace("issues AS (SELECT * FROM page_issues UNION", "page_and_site AS (SELECT * FROM page_issues UNION")},
issues AS (SELECT * FROM page_and_site UNION ALL BY NAME {_RESPONSES} UNION ALL BY NAME {_MISSING})"""


@query("capture_issues", f"{AUDIT_SQL} SELECT audit_id, code, severity, description, url, evidence FROM issues")
def q_capture_issues(spark, sf_dir):
    """Every finding of the audit from raw captures."""
    return landed_audit(spark, sf_dir).issues.select("audit_id", "code", "severity", "description", "url", "evidence")


@query("capture_audit", f"{AUDIT_SQL}, sizes AS (SELECT audit_id, pages_scanned FROM roots), {SCORE_SQL}, "
       "grouped AS (SELECT audit_id, count(*) AS issue_count, CAST(sum(n) AS BIGINT) AS finding_count FROM (SELECT audit_id, code, "
       "severity, title, recommendation, count(*) AS n FROM issues GROUP BY ALL) GROUP BY audit_id) "
       "SELECT audit_id, root_url, r.pages_scanned, score, issue_count, finding_count, false AS stopped FROM roots r JOIN scores USING (audit_id) "
       "LEFT JOIN grouped USING (audit_id)")
def q_capture_audit(spark, sf_dir):
    """Headers of the audits from raw captures."""
    return landed_audit(spark, sf_dir).header

"""Registered queries over robots and sitemap files, addresses, targets and crawl order."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteloom.functions.urls import validate_targets
from siteloom.operators import findings, network, sitefiles
from siteloom.plans.crawl import crawl_order
from siteloom.plans.registry import query
from siteloom.plans.tables import table
from siteloom.session import stage

BOT = "sitebot"
#: One of these bodies for each site, by its number modulo four.
ROBOTS = [
    (0, "User-agent: *\nDisallow: /s1/\nAllow: /s1/p1"),
    (1, f"User-agent: *\nDisallow: /\n\nUser-agent: {BOT}\nDisallow: /s2/\nCrawl-delay: 10"),
    (2, "User-agent: *\nDisallow: /*0$"),
    (3, "Disallow: /s0/\nSitemap: https://site.example.com/map.xml"),
]
_PATH = "regexp_extract(url, '^https?://[^/]*(/.*)$', 1)"


@query("robots_filter", f"""SELECT audit_id, url, CASE audit_id % 4 WHEN 0 THEN NOT ({_PATH} LIKE '/s1/%' AND NOT {_PATH} LIKE '/s1/p1%')
 WHEN 1 THEN NOT {_PATH} LIKE '/s2/%' WHEN 2 THEN NOT {_PATH} LIKE '/%0' ELSE true END AS allowed FROM {{fx_pages}}""")
def q_robots(spark, sf_dir):
    pages = table(spark, sf_dir, "fx_pages").select("audit_id", "url")
    bodies = spark.createDataFrame(ROBOTS, "kind bigint, body string")
    docs = pages.select("audit_id", (F.col("audit_id") % len(ROBOTS)).alias("kind")).distinct().join(bodies, "kind").select("audit_id", "body")
    return sitefiles.robots_filter(pages, sitefiles.parse_robots(docs, BOT))


_LOC = """CASE page_id % 9 WHEN 4 THEN concat('<![CDATA[', url, '?y=2&amp;x=1]]>') WHEN 5 THEN concat(url, '?utm_source=map') WHEN 6 THEN concat(url, '.pdf') ELSE url END"""
_NESTED = f"SELECT audit_id, CAST(floor(page_id / 50) AS INT) AS k, page_id, concat('<url><loc>', {_LOC}, '</loc></url>') AS loc FROM {{fx_pages}}"


def sitemap_docs(spark, sf_dir):
    """Sitemap documents that list the derived pages: five pages per nested file, an index of all files."""
    rows = spark.sql(_NESTED, fx_pages=table(spark, sf_dir, "fx_pages"))
    site = F.concat(F.lit("https://site"), F.col("audit_id"), F.lit(".example.com"))
    nested = rows.groupBy("audit_id", "k").agg(F.array_join(F.array_sort(F.collect_list(F.struct("page_id", "loc")))["loc"], "")
                                               .alias("locs"))
    maps = nested.select("audit_id", F.concat(site, F.lit("/map-"), "k", F.lit(".xml")).alias("doc_url"),
                         F.concat(F.lit("<urlset>"), "locs", F.lit("</urlset>")).alias("body"))
    entry = F.concat(F.lit("<sitemap><loc>"), site, F.lit("/map-"), "k", F.lit(".xml</loc></sitemap>"))
    index = nested.groupBy("audit_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("k", entry.alias("e"))))["e"], "")
                                           .alias("es"))
    tops = index.select("audit_id", F.concat(site, F.lit("/sitemap.xml")).alias("doc_url"),
                        F.concat(F.lit("<sitemapindex>"), "es", F.lit("</sitemapindex>")).alias("body"))
    return maps.unionByName(tops)


@query("sitemap_urls", f"""WITH n AS ({_NESTED}), p AS (SELECT n.audit_id, n.k, n.page_id, f.url FROM n JOIN {{fx_pages}} f ON f.page_id = n.page_id),
 docs AS (SELECT *, dense_rank() OVER (PARTITION BY audit_id ORDER BY k) AS d FROM p),
 u AS (SELECT audit_id, k, page_id, CASE WHEN page_id % 9 = 4 THEN concat(url, '?x=1&y=2') ELSE url END AS url FROM docs WHERE page_id % 9 <> 6),
 r AS (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY k, page_id) AS position FROM u)
 SELECT audit_id, url, CAST(position AS INT) AS position FROM r""")
def q_sitemaps(spark, sf_dir):
    roots = findings.audit_roots(table(spark, sf_dir, "fx_pages").select("audit_id", "seq", "url"))
    urls, _ = sitefiles.sitemap_tree(sitemap_docs(spark, sf_dir), roots)
    return urls


@query("query_variants", r"""WITH v AS (SELECT page_id % 7 AS audit_id, page_id AS seq, concat('https://v.example.com/p', page_id % 3, CASE WHEN page_id % 4 = 0 THEN '' ELSE concat('?q=', page_id % 11) END) AS url FROM {pages}),
 f AS (SELECT audit_id, regexp_extract(url, '(/[^?]*)', 1) AS path, split_part(url, '?', 2) AS q, split_part(url, '?', 1) AS b, min(seq) AS s FROM v WHERE contains(url, '?') GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY audit_id, b ORDER BY s) AS n FROM f)
 SELECT v.audit_id, v.seq, v.url FROM v WHERE NOT contains(url, '?') UNION ALL
 SELECT v.audit_id, v.seq, v.url FROM v JOIN k ON k.audit_id = v.audit_id AND v.url = concat(k.b, '?', k.q) WHERE k.n <= 5""")
def q_variants(spark, sf_dir):
    urls = table(spark, sf_dir, "pages").selectExpr(
        "page_id % 7 AS audit_id", "page_id AS seq",
        "concat('https://v.example.com/p', page_id % 3, CASE WHEN page_id % 4 = 0 THEN '' ELSE concat('?q=', page_id % 11) END) AS url")
    return sitefiles.query_variant_guard(urls)


_IP = """SELECT event_id, CASE WHEN event_id % 20 = 0 THEN concat('2001:db8:', event_id % 90, '::1') WHEN event_id % 20 = 1 THEN concat('2606:4700::', event_id % 90)
 WHEN event_id % 20 = 2 THEN 'not-an-address' ELSE concat(user_id % 256, '.', event_id % 256, '.', (event_id * 7) % 256, '.', event_id % 250) END AS ip FROM {events}"""


@query("blocked_addresses", f"""WITH i AS ({_IP}), o AS (SELECT *, contains(ip, '.') AND NOT contains(ip, ':') AS v4 FROM i),
 n AS (SELECT *, CASE WHEN v4 THEN CAST(split_part(ip, '.', 1) AS INT) END AS a, CASE WHEN v4 THEN CAST(split_part(ip, '.', 2) AS INT) END AS b,
  CASE WHEN v4 THEN CAST(split_part(ip, '.', 3) AS INT) END AS c FROM o)
 SELECT event_id, ip, CASE WHEN v4 THEN a IN (0, 10, 127) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31)
  OR (a = 192 AND b IN (0, 168)) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113) OR a >= 224
  WHEN NOT contains(ip, ':') THEN true ELSE starts_with(ip, '2001:db8:') END AS blocked FROM n""")
def q_blocked(spark, sf_dir):
    rows = spark.sql(_IP, events=table(spark, sf_dir, "events"))
    return rows.withColumn("blocked", network.blocked_address(F.col("ip")))


@query("public_targets", f"""WITH i AS ({_IP}), r AS (SELECT concat('h', event_id % 400) AS host, event_id % 3 AS k, ip,
  starts_with(ip, '2001:db8:') OR NOT (contains(ip, '.') OR contains(ip, ':')) OR regexp_matches(ip, '^(0|10|127|22[4-9]|2[34][0-9]|25[0-9])[.]') OR regexp_matches(ip, '^(192[.](0|168)|169[.]254|198[.]1[89]|172[.](1[6-9]|2[0-9]|3[01])|100[.](6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7]))[.]')
  OR starts_with(ip, '198.51.100.') OR starts_with(ip, '203.0.113.') AS bad FROM i)
 SELECT host, bool_and(NOT bad) AS public FROM r GROUP BY host""")
def q_public(spark, sf_dir):
    rows = spark.sql(_IP, events=table(spark, sf_dir, "events")).withColumn("host", F.concat(F.lit("h"), F.col("event_id") % 400))
    return network.public_targets(rows.select("host").distinct(), rows.select("host", "ip"))


_RAW = """SELECT page_id, CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^https?://', '') WHEN 2 THEN concat('http://127.0.0.', page_id % 200)
 WHEN 3 THEN concat('host', page_id, '.local/x') WHEN 4 THEN concat('https://user:pw@h', page_id, '.example.com') WHEN 5 THEN concat('http://h.example.com:', 8000 + page_id)
 WHEN 6 THEN '' ELSE concat('https://', repeat('a', 2100)) END AS raw FROM {pages}"""


@query("validated_targets", f"""WITH r AS ({_RAW}) SELECT page_id, raw, CASE page_id % 8 WHEN 2 THEN 'private-address' WHEN 3 THEN 'private-host' WHEN 4 THEN 'credentials'
 WHEN 5 THEN 'port' WHEN 6 THEN 'empty' WHEN 7 THEN 'too-long' END AS reject_reason,
 CASE WHEN page_id % 8 < 2 THEN regexp_replace(CASE WHEN page_id % 8 = 1 THEN concat('https://', raw) ELSE raw END, '#.*$', '') END AS normalized_url FROM r""")
def q_targets(spark, sf_dir):
    return validate_targets(spark.sql(_RAW, pages=table(spark, sf_dir, "pages")), "raw")


@query("crawl_order", """WITH RECURSIVE roots AS (SELECT audit_id, arg_min(url, seq) AS url FROM {fx_pages} GROUP BY audit_id),
 walk AS (SELECT audit_id, url, 0 AS depth FROM roots UNION SELECT w.audit_id, l.dst, w.depth + 1 FROM walk w JOIN {fx_links} l ON l.audit_id = w.audit_id AND l.src = w.url)
 SELECT audit_id, url, CAST(min(depth) AS INT) AS depth FROM walk GROUP BY ALL""")
def q_crawl(spark, sf_dir):
    pages = table(spark, sf_dir, "fx_pages").select("audit_id", "seq", "url")
    captures = pages.select("audit_id", "url", F.col("url").alias("final_url"), F.lit(True).alias("is_html"), F.lit(True).alias("allowed"))
    links = table(spark, sf_dir, "fx_links").select("audit_id", "src", "dst", "position")
    visited, _ = crawl_order(stage(findings.audit_roots(pages)), stage(links), stage(captures), max_pages=1 << 30)
    return visited.filter("audited").select("audit_id", "url", "depth")

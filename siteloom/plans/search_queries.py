"""Registered queries over search-performance rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteloom.operators import search
from siteloom.plans.registry import query
from siteloom.plans.tables import table

_CAND = """cand AS (
  SELECT snapshot_id, query, page, clicks, impressions, 'striking-distance' AS kind, 35 + log10(impressions + 1) * 16 + greatest(0.0::DOUBLE, 20 - position) * 1.8::DOUBLE AS raw
    FROM {fx_search_rows} WHERE impressions >= 20 AND position BETWEEN 4 AND 20
  UNION ALL SELECT snapshot_id, query, page, clicks, impressions, 'low-ctr', 45 + log10(impressions + 1) * 15 + greatest(0.0::DOUBLE, 2.5::DOUBLE - ctr * 100) * 8
    FROM {fx_search_rows} WHERE impressions >= 20 AND position <= 10 AND ctr * 100 < 2.5::DOUBLE
  UNION ALL SELECT snapshot_id, query, page, clicks, impressions, 'high-impressions', 50 + log10(impressions + 1) * 14 - clicks
    FROM {fx_search_rows} WHERE impressions >= 250 AND clicks < 5),
 best AS (SELECT snapshot_id, kind, query, page, max(CAST(greatest(0, least(100, floor(raw + 0.5))) AS INT)) AS score, max(impressions) AS impressions
   FROM cand GROUP BY ALL)"""


@query("search_opportunities", f"""WITH {_CAND} SELECT snapshot_id, kind, query, page, score, impressions, CAST(rank AS INT) AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY score DESC, kind, query, page) AS rank FROM best) WHERE rank <= 250""")
def q_opportunities(spark, sf_dir):
    out = search.search_opportunities(table(spark, sf_dir, "fx_search_rows"))
    return out.select("snapshot_id", "kind", "query", "page", "score", "impressions", "rank")


@query("search_totals", """SELECT snapshot_id, sum(clicks) AS clicks, sum(impressions) AS impressions, sum(clicks) / sum(impressions) AS ctr,
 sum(position * impressions) / sum(impressions) AS position FROM {fx_search_rows} GROUP BY snapshot_id""")
def q_totals(spark, sf_dir):
    return search.search_totals(table(spark, sf_dir, "fx_search_rows"))


_PROJECTS = "SELECT c_custkey AS project_id, c_nationkey AS owner, concat('https://s', c_custkey % 30, '.example.com/', CASE WHEN c_custkey % 2 = 0 THEN 'shop' ELSE '' END) AS root_url FROM {customer}"
_PROPERTIES = """SELECT s_nationkey AS owner, s_suppkey AS position, CASE s_suppkey % 4 WHEN 0 THEN concat('https://s', s_suppkey % 30, '.example.com/')
  WHEN 1 THEN concat('sc-domain:s', s_suppkey % 30, '.example.com') WHEN 2 THEN concat('https://s', s_suppkey % 30, '.example.com/shop')
  ELSE concat('https://s', s_suppkey % 30, '.example.com/blog/') END AS site_url FROM {supplier}"""


@query("chosen_properties", f"""WITH p AS ({_PROJECTS}), q AS ({_PROPERTIES}),
 j AS (SELECT p.owner, p.project_id, q.site_url, q.position, regexp_extract(root_url, '^(https://[^/]*)', 1) AS o, root_url FROM p LEFT JOIN q USING (owner)),
 r AS (SELECT owner, project_id, site_url, row_number() OVER (PARTITION BY project_id ORDER BY CASE WHEN site_url = concat(o, '/') OR site_url = root_url THEN 0
   WHEN site_url = concat('sc-domain:', substr(o, 9)) THEN 1 WHEN starts_with(site_url, o) THEN 2 ELSE 3 END, position) AS k FROM j)
 SELECT owner, project_id, site_url FROM r WHERE k = 1""")
def q_properties(spark, sf_dir):
    projects = spark.sql(_PROJECTS, customer=table(spark, sf_dir, "customer"))
    return search.choose_property(projects, spark.sql(_PROPERTIES, supplier=table(spark, sf_dir, "supplier")))


@query("sync_date_ranges", """SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) - 3 - (d - 1), '%Y-%m-%d') AS start_date,
 strftime(CAST(o_orderdate AS DATE) - 3, '%Y-%m-%d') AS end_date FROM (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 7 WHEN 1 THEN 90 ELSE 28 END AS d FROM {orders})""")
def q_ranges(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("days", F.expr(
        "CASE o_orderkey % 4 WHEN 0 THEN 7 WHEN 1 THEN 90 WHEN 2 THEN 28 ELSE 14 END"))
    span = search.sync_date_range(F.col("o_orderdate"), F.col("days"))
    return orders.select("o_orderkey", span.alias("r")).select(
        "o_orderkey", F.date_format("r.start_date", "yyyy-MM-dd").alias("start_date"),
        F.date_format("r.end_date", "yyyy-MM-dd").alias("end_date"))

"""Registered queries over page captures: features, findings, duplicates, scores, groups, links."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteloom.functions import constants as K
from siteloom.functions.html import extract_page_features
from siteloom.functions.urls import canonicalize_urls
from siteloom.operators import findings, linkgraph, scoring
from siteloom.plans.audit import audit_pages
from siteloom.plans.registry import query
from siteloom.plans.tables import table


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


RULES_SQL = ("rules(rule_no, code, severity, title, description, recommendation) AS (VALUES "
             + ", ".join(f"({i}, " + ", ".join(_q(v) for v in row[1:]) + ")" for i, row in enumerate(K.FINDINGS)) + ")")
_N = {row[0]: i for i, row in enumerate(K.FINDINGS)}


def _hit(key: str, evidence: str = "NULL") -> str:
    return f"{{'rule_no': {_N[key]}, 'evidence': CAST({evidence} AS VARCHAR)}}"


# page findings in the checking engine: struct literals use doubled braces because the text is a table template
_CANON = "regexp_extract(canonical, '^(https?://[^/]*)', 1)"
PAGE_HITS_SQL = f"""
hits AS (
  SELECT audit_id, seq, url, unnest(list_filter([
    CASE WHEN status >= 500 THEN {_hit('page-5xx', "concat('HTTP ', status)")} WHEN status = 404 THEN {_hit('page-404')}
         WHEN status >= 300 THEN {_hit('page-non-2xx', "concat('HTTP ', status)")} END,
    CASE WHEN title = '' THEN {_hit('title-missing')}
         WHEN length(title) < 20 THEN {_hit('title-short', "concat(length(title), ' characters')")}
         WHEN length(title) > 65 THEN {_hit('title-long', "concat(length(title), ' characters')")} END,
    CASE WHEN description = '' THEN {_hit('description-missing')}
         WHEN length(description) < 70 THEN {_hit('description-short', "concat(length(description), ' characters')")}
         WHEN length(description) > 170 THEN {_hit('description-long', "concat(length(description), ' characters')")} END,
    CASE WHEN h1_count = 0 THEN {_hit('h1-missing')}
         WHEN h1_count > 1 THEN {_hit('h1-multiple', "concat(h1_count, ' H1 elements')")} END,
    CASE WHEN canonical = '' THEN {_hit('canonical-missing')}
         WHEN {_CANON} = '' THEN {_hit('canonical-invalid', 'canonical')}
         WHEN {_CANON} <> regexp_extract(url, '^(https?://[^/]*)', 1) THEN {_hit('canonical-cross-origin', 'canonical')} END,
    CASE WHEN {_CANON} <> '' AND contains(canonical, '#') THEN {_hit('canonical-fragment', 'canonical')} END,
    CASE WHEN regexp_matches(robots, '(?i)\\bnoindex\\b') THEN {_hit('meta-noindex', 'robots')} END,
    CASE WHEN lang = '' THEN {_hit('lang-missing')} END,
    CASE WHEN word_count < 150 THEN {_hit('thin-content', "concat(word_count, ' words')")} END,
    CASE WHEN images_missing_alt > 0 THEN {_hit('image-alt-missing', "concat(images_missing_alt, ' of ', image_count, ' images')")} END,
    CASE WHEN og_title = '' OR og_description = '' THEN {_hit('open-graph-incomplete')} END,
    CASE WHEN load_time_ms > 3000 THEN {_hit('slow-response', "concat(load_time_ms, ' ms')")} END
  ], lambda x: x IS NOT NULL)) AS hit FROM {{fx_pages}}),
page_issues AS (
  SELECT h.audit_id, h.seq, r.rule_no, r.code, r.severity, r.title, r.description, r.recommendation, h.url,
         h.hit.evidence AS evidence, CAST(NULL AS BIGINT) AS n_affected
  FROM hits h JOIN rules r ON r.rule_no = h.hit.rule_no)"""


def _dup_sql(key: str) -> str:
    return f"""SELECT audit_id, lower(trim({key})) AS value, count(*) AS n_pages, min(seq) AS first_seq,
    arg_min(url, seq) AS first_url FROM {{fx_pages}} WHERE trim({key}) <> '' GROUP BY ALL HAVING count(*) >= 2"""


def _dup_issue_sql(key: str, label: str, no: int) -> str:
    return f"""SELECT audit_id, {findings.SITE_SEQ} AS seq, {no} AS rule_no, 'duplicate-{key}' AS code, 'high' AS severity,
    'Duplicate {label}' AS title, concat(CAST(sum(n_pages) AS BIGINT), ' crawled pages participate in duplicate {label} groups.') AS description,
    'Write a unique {label} for each indexable page or consolidate duplicate URLs.' AS recommendation,
    arg_min(first_url, first_seq) AS url, CAST(NULL AS VARCHAR) AS evidence, CAST(sum(n_pages) AS BIGINT) AS n_affected
    FROM dup_{key} GROUP BY audit_id"""


ALL_ISSUES_SQL = f"""{RULES_SQL}, {PAGE_HITS_SQL},
roots AS (SELECT audit_id, arg_min(url, seq) AS root_url, count(*) AS pages_scanned FROM {{fx_pages}} GROUP BY audit_id),
dup_title AS ({_dup_sql('title')}), dup_description AS ({_dup_sql('description')}),
indeg AS (SELECT audit_id, dst, count(*) AS n FROM {{fx_links}} GROUP BY ALL),
orphans AS (
  SELECT p.audit_id, {findings.SITE_SEQ} + p.seq AS seq, r.rule_no, r.code, r.severity, r.title, r.description,
         r.recommendation, p.url, CAST(NULL AS VARCHAR) AS evidence, CAST(NULL AS BIGINT) AS n_affected
  FROM {{fx_pages}} p JOIN roots USING (audit_id) LEFT JOIN indeg i ON i.audit_id = p.audit_id AND i.dst = p.url
  JOIN rules r ON r.rule_no = {_N['orphan-in-crawl']} WHERE i.n IS NULL AND p.url <> root_url),
issues AS (SELECT * FROM page_issues UNION ALL BY NAME {_dup_issue_sql('title', 'title', -2)}
  UNION ALL BY NAME {_dup_issue_sql('description', 'meta description', -1)} UNION ALL BY NAME SELECT * FROM orphans)"""

_CASE = lambda m: "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in m.items()) + " END"
SCORE_SQL = f"""
expanded AS (SELECT audit_id, code, severity, seq, rule_no, n_affected, unnest(CASE WHEN len(us) = 0 THEN [NULL] ELSE us END) AS u,
    FROM (SELECT *, list_distinct(list_concat(CASE WHEN url IS NULL OR url = '' THEN [] ELSE [url] END,
            regexp_extract_all(coalesce(evidence, ''), '(?m)^(https?://\\S+)$'))) AS us FROM issues)),
counts AS (SELECT audit_id, code, severity, count(*) AS n FROM issues GROUP BY ALL),
urls AS (SELECT audit_id, code, severity, count(DISTINCT u) AS urls, coalesce(max(n_affected), 0) AS hint FROM expanded GROUP BY ALL),
rated AS (SELECT *, CAST(greatest(n, urls, hint, 1) AS DOUBLE) AS affected FROM counts JOIN urls USING (audit_id, code, severity)
          JOIN sizes USING (audit_id)),
penal AS (SELECT audit_id, severity, sum(least({_CASE(K.ISSUE_CAP)}, {_CASE(K.SEVERITY_BASE)} *
   (1.0::DOUBLE + least(1.0::DOUBLE, log2(affected + 1) / 4) + least(0.35::DOUBLE, least(1.0::DOUBLE, affected / greatest(1, pages_scanned)) * 0.35::DOUBLE)))) AS penalty
   FROM rated GROUP BY ALL),
scores AS (SELECT s.audit_id, s.pages_scanned, CAST(greatest(0, least(100, floor(100 - coalesce(p.total, 0) + 0.5))) AS INT) AS score
   FROM sizes s LEFT JOIN (SELECT audit_id, sum(least(penalty, {_CASE(K.SEVERITY_CAP)})) AS total FROM penal GROUP BY audit_id) p USING (audit_id))"""


def fixture_audit(spark, sf_dir):
    """The audit job over the derived pages and links."""
    pages = table(spark, sf_dir, "fx_pages")
    return audit_pages(pages, table(spark, sf_dir, "fx_links").select("audit_id", "dst"))


@query("audit_pages", f"WITH {ALL_ISSUES_SQL}, sizes AS (SELECT audit_id, pages_scanned FROM roots), {SCORE_SQL}, "
       "grouped AS (SELECT audit_id, count(*) AS issue_count, CAST(sum(n) AS BIGINT) AS finding_count FROM (SELECT audit_id, code, "
       "severity, title, recommendation, count(*) AS n FROM issues GROUP BY ALL) GROUP BY audit_id) "
       "SELECT audit_id, root_url, r.pages_scanned, score, issue_count, finding_count FROM roots r JOIN scores USING (audit_id) "
       "LEFT JOIN grouped USING (audit_id)")
def q_audit_pages(spark, sf_dir):
    return fixture_audit(spark, sf_dir).header


@query("page_issues", f"WITH {RULES_SQL}, {PAGE_HITS_SQL} SELECT audit_id, seq, code, severity, title, url, evidence FROM page_issues")
def q_page_issues(spark, sf_dir):
    found = findings.detect_page_issues(table(spark, sf_dir, "fx_pages"))
    return found.select("audit_id", "seq", "code", "severity", "title", "url", "evidence")


@query("audit_grouped_issues", f"WITH {ALL_ISSUES_SQL} SELECT audit_id, code, severity, title, count(*) AS n_issues, "
       "count(DISTINCT url) AS n_urls, arg_min(url, (seq, rule_no)) AS url, CASE WHEN count(DISTINCT url) > 1 THEN "
       "concat(count(DISTINCT url), ' crawled pages are affected. ', arg_min(description, (seq, rule_no))) ELSE "
       "arg_min(description, (seq, rule_no)) END AS description FROM issues GROUP BY audit_id, code, severity, title, recommendation")
def q_audit_grouped(spark, sf_dir):
    groups = fixture_audit(spark, sf_dir).groups
    return groups.select("audit_id", "code", "severity", "title", "n_issues", "n_urls", "url", "description")


for _key in ("title", "description"):
    query(f"duplicate_{_key}s", f"SELECT audit_id, value, n_pages, first_seq, first_url FROM ({_dup_sql(_key)})")(
        lambda spark, sf_dir, key=_key: findings.duplicate_groups(table(spark, sf_dir, "fx_pages"), key))


@query("duplicate_members", f"""SELECT p.audit_id, d.first_seq, d.value AS shared, p.seq, p.url
 FROM {{fx_pages}} p JOIN ({_dup_sql('title')}) d ON d.audit_id = p.audit_id AND lower(trim(p.title)) = d.value""")
def q_duplicate_members(spark, sf_dir):
    return findings.duplicate_members(table(spark, sf_dir, "fx_pages"), "title")


@query("incoming_links", """SELECT p.audit_id, p.page_id, p.url, CAST(coalesce(n, 0) AS INT) AS incoming_links FROM {fx_pages} p
 LEFT JOIN (SELECT audit_id, dst, count(*) AS n FROM {fx_links} GROUP BY ALL) i ON i.audit_id = p.audit_id AND i.dst = p.url""")
def q_incoming(spark, sf_dir):
    pages = table(spark, sf_dir, "fx_pages").select("audit_id", "page_id", "url")
    return linkgraph.incoming_link_counts(table(spark, sf_dir, "fx_links").select("audit_id", "dst"), pages)


@query("orphans", f"WITH {ALL_ISSUES_SQL} SELECT audit_id, url FROM orphans")
def q_orphans(spark, sf_dir):
    pages = table(spark, sf_dir, "fx_pages").select("audit_id", "seq", "url")
    linked = linkgraph.incoming_link_counts(table(spark, sf_dir, "fx_links").select("audit_id", "dst"), pages)
    return findings.orphan_issues(linked, findings.audit_roots(pages)).select("audit_id", "url")


_FX_ISSUES = ("issues AS (SELECT audit_id, seq, 0 AS rule_no, code, severity, title, recommendation, url, evidence, "
              "concat(title, ' found.') AS description, CAST(NULL AS BIGINT) AS n_affected FROM {fx_issues})")


def fixture_issues(spark, sf_dir):
    """Derived issue history in the issue row shape."""
    return table(spark, sf_dir, "fx_issues").withColumn("rule_no", F.lit(0)).withColumn(
        "description", F.concat("title", F.lit(" found.")))


@query("audit_scores", f"WITH {_FX_ISSUES}, sizes AS (SELECT audit_id, pages_scanned FROM {{fx_audits}}), {SCORE_SQL} "
       "SELECT audit_id, pages_scanned, score FROM scores")
def q_scores(spark, sf_dir):
    sizes = table(spark, sf_dir, "fx_audits").select("audit_id", "pages_scanned")
    return scoring.audit_score(scoring.issue_url_counts(fixture_issues(spark, sf_dir)), sizes)


_G = "audit_id, code, severity, title, recommendation"
_GROUP_SQL = f"""heads AS (SELECT {_G}, count(*) AS n_issues, count(DISTINCT url) AS n_urls,
  count(DISTINCT trim(evidence)) AS n_evidence, arg_min(url, (seq, url)) FILTER (WHERE url IS NOT NULL) AS url,
  CASE WHEN count(DISTINCT url) > 1 THEN concat(count(DISTINCT url), ' crawled pages are affected. ', title, ' found.')
       ELSE concat(title, ' found.') END AS description
  FROM issues GROUP BY {_G}),
 parts AS (SELECT {_G}, true AS block, trim(evidence) AS v, min((seq, rule_no)) AS o FROM issues WHERE trim(evidence) <> '' GROUP BY {_G}, trim(evidence)
   UNION ALL SELECT {_G}, false, url, min((seq, rule_no)) FROM issues WHERE url <> '' GROUP BY {_G}, url),
 texts AS (SELECT {_G}, string_agg(v, chr(10) || chr(10) ORDER BY o, v) FILTER (WHERE block) AS blocks, CASE WHEN count(*) FILTER (WHERE NOT block) > 1
   THEN concat('Affected URLs:', chr(10), string_agg(v, chr(10) ORDER BY o, v) FILTER (WHERE NOT block)) END AS listed FROM parts GROUP BY {_G})
 SELECT h.audit_id, h.code, h.severity, h.title, n_issues, n_urls, n_evidence, url, description,
   nullif(concat_ws(chr(10) || chr(10), blocks, listed), '') AS evidence
 FROM heads h LEFT JOIN texts t ON {' AND '.join(f'h.{k} IS NOT DISTINCT FROM t.{k}' for k in _G.split(', '))}"""


@query("grouped_issues", f"WITH {_FX_ISSUES}, {_GROUP_SQL}")
def q_grouped(spark, sf_dir):
    groups = scoring.group_issues(scoring.grouped_issue_parts(fixture_issues(spark, sf_dir)))
    return groups.select("audit_id", "code", "severity", "title", "n_issues", "n_urls", "n_evidence", "url", "description", "evidence")


@query("issue_evidence", f"""WITH {_FX_ISSUES},
 e AS (SELECT audit_id, code, severity, title, recommendation, trim(evidence) AS v, min(seq) AS s, floor(min(seq) / 4096) AS chunk
       FROM issues WHERE evidence IS NOT NULL GROUP BY ALL),
 u AS (SELECT audit_id, code, severity, title, recommendation, url AS v, min(seq) AS s, floor(min(seq) / 4096) AS chunk
       FROM issues WHERE url IS NOT NULL GROUP BY ALL),
 eb AS (SELECT audit_id, code, severity, title, chunk, string_agg(v, chr(10) || chr(10) ORDER BY s, v) AS t FROM e GROUP BY ALL),
 ub AS (SELECT audit_id, code, severity, title, chunk, CASE WHEN count(*) > 1 THEN concat('Affected URLs:', chr(10), string_agg(v, chr(10) ORDER BY s, v)) END AS t
        FROM u GROUP BY ALL)
 SELECT audit_id, code, severity, title, CAST(chunk AS BIGINT) AS chunk,
   CASE WHEN eb.t IS NULL THEN coalesce(ub.t, '') WHEN ub.t IS NULL THEN eb.t ELSE concat(eb.t, chr(10), chr(10), ub.t) END AS evidence
 FROM eb FULL OUTER JOIN ub USING (audit_id, code, severity, title, chunk)""")
def q_evidence(spark, sf_dir):
    parts = scoring.grouped_issue_parts(fixture_issues(spark, sf_dir))
    return scoring.evidence_chunks(parts).select("audit_id", "code", "severity", "title", "chunk", "evidence")


@query("issue_severity_counts", """SELECT audit_id, count(*) FILTER (WHERE severity = 'critical') AS n_critical,
 count(*) FILTER (WHERE severity = 'high') AS n_high, count(*) FILTER (WHERE severity = 'medium') AS n_medium,
 count(*) FILTER (WHERE severity = 'low') AS n_low FROM {fx_issues} GROUP BY audit_id""")
def q_severity_counts(spark, sf_dir):
    return scoring.issue_counts(table(spark, sf_dir, "fx_issues"))


@query("issue_occurrences", r"""SELECT audit_id, seq, code, unnest(CASE WHEN len(us) = 0 THEN [NULL] ELSE us END) AS url FROM (
 SELECT *, list_distinct(list_concat(CASE WHEN url IS NULL THEN [] ELSE [url] END,
   regexp_extract_all(coalesce(evidence, ''), '(?m)^(https?://\S+)$'))) AS us FROM {fx_issues})""")
def q_occurrences(spark, sf_dir):
    issues = table(spark, sf_dir, "fx_issues")
    return scoring.expand_issue_occurrences(issues).select("audit_id", "seq", "code", "url")


@query("page_features", r"""SELECT page_id, url, regexp_extract(html, '<title>(.*?)</title>', 1) AS raw_title,
 regexp_extract(html, '<html lang="([a-z]*)"', 1) AS lang,
 CAST(len(regexp_extract_all(html, '<h1>')) AS INT) AS h1_count,
 CAST(len(list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1))) AS INT) AS link_count,
 CAST(len(regexp_extract_all(html, '<h[1-6][ >]')) AS INT) AS heading_count,
 CAST(len(regexp_extract_all(html, '<img[ />]')) AS INT) AS image_count
 FROM {pages}""")
def q_page_features(spark, sf_dir):
    raw = table(spark, sf_dir, "pages")
    full = extract_page_features(raw.withColumn("raw_title", F.regexp_extract("html", "<title>(.*?)</title>", 1)))
    return full.select("page_id", "url", "raw_title", "lang", F.size("h1").alias("h1_count"),
                       (F.size("internal_links") + F.size("external_links")).alias("link_count"), "heading_count",
                       "image_count")


@query("canonical_urls", r"""SELECT page_id, url, concat(regexp_extract(url, '^(https?://[^/?#]*)', 1),
   regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), CASE WHEN regexp_matches(url, '[?&]page=') THEN
   concat('?page=', regexp_extract(url, '[?&]page=([^&#]*)', 1)) ELSE '' END) AS canonical_url FROM {pages}""")
def q_canonical(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return canonicalize_urls(pages, "url", "url", resolved=True)

"""Registered queries over the link graph and page vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteloom.functions import constants as K
from siteloom.functions import urls as U
from siteloom.operators import findings, linkgraph, links, semantic
from siteloom.plans.registry import query
from siteloom.plans.tables import table
from siteloom.session import stage


def linked_pages(spark, sf_dir):
    """Derived pages with in-degrees, link counts and headings as an array."""
    pages = table(spark, sf_dir, "fx_pages")
    edges = table(spark, sf_dir, "fx_links").select("audit_id", "src", "dst")
    out = edges.groupBy("audit_id", F.col("src").alias("url")).agg(F.count("*").alias("n_links"))
    full = linkgraph.incoming_link_counts(edges, pages).join(out, ["audit_id", "url"], "left")
    return full.na.fill({"n_links": 0}).withColumn("h1s", F.array("h1")), edges


def base_links(spark, sf_dir, **kw):
    # several steps read both, and each would go through the bodies again
    pages, edges = map(stage, linked_pages(spark, sf_dir))
    roots = findings.audit_roots(pages.select("audit_id", "url", "seq"))
    return links.internal_links(pages, roots, edges, **kw), pages, roots, edges


_STOP = "[" + ", ".join(f"'{w}'" for w in K.STOP_WORDS) + "]"
PROFILE = r"""
deg AS (SELECT audit_id, dst, count(*) AS n FROM {fx_links} GROUP BY ALL),
outd AS (SELECT audit_id, src, count(*) AS n FROM {fx_links} GROUP BY ALL),
roots AS (SELECT audit_id, arg_min(url, seq) AS root_url FROM {fx_pages} GROUP BY audit_id),
prof AS (SELECT p.audit_id, p.seq, p.url, p.title, p.h1, p.word_count, CAST(coalesce(d.n, 0) AS INT) AS incoming_links,
   list_distinct(list_filter(regexp_extract_all(lower(concat(title, ' ', h1, ' ', regexp_replace(regexp_extract(url, '^https?://[^/]*(/.*)$', 1), '[-_]', ' ', 'g'))), '[\pL\pN]+'),
     lambda t: length(t) > 1 AND NOT list_contains(@STOP@, t))) AS tokens,
   CASE WHEN regexp_matches(url, '^https?://[^/]*/[^/]+/[^/]') THEN regexp_extract(url, '^https?://[^/]*/([^/]+)/', 1) ELSE '' END AS parent,
   CASE WHEN word_count >= 150 THEN 8 ELSE 0 END + CASE WHEN coalesce(o.n, 0) < 20 THEN 5 ELSE 0 END AS bonus, url <> root_url AS inner_page
   FROM {fx_pages} p JOIN roots USING (audit_id) LEFT JOIN deg d ON d.audit_id = p.audit_id AND d.dst = p.url
   LEFT JOIN outd o ON o.audit_id = p.audit_id AND o.src = p.url
   WHERE status BETWEEN 200 AND 299 AND NOT regexp_matches(robots, '(?i)noindex')),
pairs AS (SELECT t.audit_id, t.seq AS target_id, s.seq AS source_id, s.url AS source_url, t.url AS target_url, t.incoming_links, t.word_count AS tw, s.word_count AS sw,
   len(list_intersect(t.tokens, s.tokens)) AS shared, len(t.tokens) AS tn, t.parent <> '' AND t.parent = s.parent AS near, s.bonus
   FROM prof t JOIN prof s ON t.audit_id = s.audit_id AND t.seq <> s.seq WHERE t.inner_page AND t.incoming_links < 3),
scored AS (SELECT *, CASE WHEN shared = 0 THEN 0 ELSE least(100, floor(shared / tn::DOUBLE * 72 + 0.5) + CASE WHEN near THEN 12 ELSE 0 END + bonus) END AS score
   FROM pairs p ANTI JOIN {fx_links} l ON l.audit_id = p.audit_id AND l.src = p.source_url AND l.dst = p.target_url),
ranked AS (SELECT *, row_number() OVER (PARTITION BY audit_id, target_id ORDER BY score DESC, source_url, source_id) AS k FROM scored WHERE score >= 28),
kept AS (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY incoming_links, -tw, target_id, k) AS position FROM ranked
   WHERE k <= CASE WHEN incoming_links = 0 THEN 3 ELSE 2 END),
sugg AS (SELECT *, CASE WHEN score >= 70 THEN 'high' WHEN score >= 45 THEN 'medium' ELSE 'low' END AS confidence FROM kept)""".replace(
    "@STOP@", _STOP)


@query("link_suggestions", f"WITH {PROFILE} SELECT audit_id, source_url, target_url, CAST(score AS INT) AS score, confidence, CAST(position AS INT) AS position FROM sugg")
def q_suggestions(spark, sf_dir):
    (found, _), *_ = base_links(spark, sf_dir)
    return found.select("audit_id", "source_url", "target_url", "score", "confidence", "position")


@query("link_page_report", f"WITH {PROFILE} SELECT audit_id, url, incoming_links = 0 AS orphan, true AS underlinked FROM prof WHERE inner_page AND incoming_links <= 1")
def q_weak(spark, sf_dir):
    pages, _ = linked_pages(spark, sf_dir)
    return links.link_page_report(pages, findings.audit_roots(pages.select("audit_id", "url", "seq")))


@query("link_analysis_summary", f"""WITH {PROFILE}, tg AS (SELECT audit_id, seq AS target_id FROM prof WHERE inner_page AND incoming_links < 3),
 idle AS (SELECT t.audit_id, count(*) AS n FROM tg t ANTI JOIN kept k ON k.audit_id = t.audit_id AND k.target_id = t.target_id GROUP BY ALL)
 SELECT r.audit_id, (SELECT count(*) FROM prof p WHERE p.audit_id = r.audit_id) AS page_count,
  (SELECT count(*) FROM prof p WHERE p.audit_id = r.audit_id AND inner_page AND incoming_links = 0) AS orphan_count,
  (SELECT count(*) FROM prof p WHERE p.audit_id = r.audit_id AND inner_page AND incoming_links <= 1) AS underlinked_count,
  (SELECT count(*) FROM sugg s WHERE s.audit_id = r.audit_id) AS suggestion_count, coalesce(idle.n, 0) AS skipped_count
 FROM roots r LEFT JOIN idle USING (audit_id)""")
def q_summary(spark, sf_dir):
    (found, skipped), pages, roots, _ = base_links(spark, sf_dir)
    return links.link_analysis_summary(pages, roots, found, skipped)


SEMANTIC = f"""{PROFILE}, emb AS (SELECT prof.*, list_transform(e.embedding::DOUBLE[], lambda x: abs(x)) AS v FROM prof JOIN {{embeddings}} e ON e.vec_id = prof.seq),
 enh AS (SELECT s.audit_id, s.source_id, s.target_id, s.source_url, s.target_url, 0 AS added, s.score AS base,
   CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL THEN floor(greatest(0, list_cosine_similarity(a.v, b.v)) * 100 + 0.5) END AS sem FROM sugg s LEFT JOIN emb a ON a.audit_id = s.audit_id AND a.seq = s.source_id
   LEFT JOIN emb b ON b.audit_id = s.audit_id AND b.seq = s.target_id),
 enh2 AS (SELECT audit_id, source_id, target_id, source_url, target_url, added, CASE WHEN sem IS NULL THEN base ELSE least(100, floor(base * 0.58::DOUBLE + sem * 0.42::DOUBLE + 0.5)) END AS score FROM enh),
 cand AS (SELECT t.audit_id, t.seq AS target_id, s.seq AS source_id, s.url AS source_url, t.url AS target_url, t.incoming_links, s.word_count AS sw,
   floor(greatest(0, list_cosine_similarity(s.v, t.v)) * 100 + 0.5) AS sem FROM emb t JOIN emb s ON s.audit_id = t.audit_id AND s.seq <> t.seq
   WHERE t.inner_page AND t.incoming_links <= 1),
 opn AS (SELECT * FROM cand c ANTI JOIN {{fx_links}} l ON l.audit_id = c.audit_id AND l.src = c.source_url AND l.dst = c.target_url WHERE sem >= 48),
 opn2 AS (SELECT * FROM opn c ANTI JOIN sugg l ON l.audit_id = c.audit_id AND l.source_id = c.source_id AND l.target_id = c.target_id),
 top AS (SELECT *, row_number() OVER (PARTITION BY audit_id, target_id ORDER BY sem DESC, source_id) AS k FROM opn2),
 addn AS (SELECT audit_id, source_id, target_id, source_url, target_url, 1 AS added, least(100, floor(sem * 0.88::DOUBLE + CASE WHEN sw >= 150 THEN 8 ELSE 0 END + 0.5)) AS score
   FROM top WHERE k <= CASE WHEN incoming_links = 0 THEN 3 ELSE 2 END),
 allr AS (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY score DESC, source_url, added, target_id) AS position FROM (SELECT * FROM enh2 UNION ALL SELECT * FROM addn))"""


def semantic_results(spark, sf_dir):
    """Suggestions and skipped targets after blending in the vectors."""
    (found, skipped), pages, roots, edges = base_links(spark, sf_dir)
    # Components without their sign: close enough to each other for pairs to be added.
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("seq"), F.transform(
        F.col("embedding").cast("array<double>"), F.abs).alias("vector"))
    placed = pages.select("audit_id", "seq").join(vectors, "seq")
    pages = pages.withColumn("anchor_text", U.anchor_text(F.col("h1"), F.col("title"), F.col("url")))
    return semantic.semantic_links(found, skipped, pages, roots, edges, placed)


@query("semantic_links", f"WITH {SEMANTIC} SELECT audit_id, source_url, target_url, CAST(score AS INT) AS score, added, CAST(position AS INT) AS position FROM allr")
def q_semantic(spark, sf_dir):
    out, _ = semantic_results(spark, sf_dir)
    return out.select("audit_id", "source_url", "target_url", "score", "added", "position")


@query("semantic_skipped", f"""WITH {SEMANTIC} SELECT t.audit_id, t.url AS target_url FROM prof t ANTI JOIN kept k ON k.audit_id = t.audit_id AND k.target_id = t.seq
 ANTI JOIN allr a ON a.audit_id = t.audit_id AND a.target_url = t.url WHERE t.inner_page AND t.incoming_links < 3""".replace("ANTI JOIN allr", "ANTI JOIN (SELECT DISTINCT audit_id, target_url FROM allr)"))
def q_semantic_skipped(spark, sf_dir):
    """Targets that neither tokens nor vectors have found a source for."""
    _, left = semantic_results(spark, sf_dir)
    return left.select("audit_id", "target_url")


@query("page_documents", r"""SELECT audit_id, seq, (concat('title: ', CASE WHEN title = '' THEN 'none' ELSE title END, ' | headings: ', CASE WHEN h1 = '' THEN 'none' ELSE h1 END,
 ' | description: ', CASE WHEN description = '' THEN 'none' ELSE description END, ' | path: ', regexp_replace(regexp_extract(url, '^https?://[^/]*(/.*)$', 1), '[-_]', ' ', 'g'))) AS document FROM {fx_pages}""")
def q_documents(spark, sf_dir):
    pages = table(spark, sf_dir, "fx_pages").withColumn("h1s", F.array("h1"))
    return semantic.page_document(pages).select("audit_id", "seq", "document")

"""The site audit as one job over many audits: findings, in-degrees, score, groups, header."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from siteloom.functions.html import extract_page_features
from siteloom.functions.urls import absolute_url, canonicalize_urls, origin
from siteloom.operators import findings, linkgraph, scoring, sitefiles
from siteloom.plans.crawl import crawl_order
from siteloom.session import stage


@dataclass
class AuditResult:
    """Lazy result tables of the audit job; tables nobody asks for are never planned."""
    pages: DataFrame
    issues: DataFrame
    header: DataFrame

    @cached_property
    def parts(self) -> DataFrame:
        """Distinct URLs and evidence blocks per issue group."""
        return scoring.grouped_issue_parts(self.issues)

    @cached_property
    def members(self) -> DataFrame:
        """Affected URLs of the duplicate findings, for comparisons."""
        return findings.duplicate_occurrences(self.pages)

    @cached_property
    def groups(self) -> DataFrame:
        """Issue groups; the evidence of duplicate findings stands in ``findings.duplicate_evidence``."""
        return scoring.group_issues(self.parts)


def audit_pages(pages: DataFrame, links: DataFrame, robots: DataFrame | None = None, sitemaps: DataFrame | None = None,
                responses: DataFrame | None = None, frontier: DataFrame | None = None) -> AuditResult:
    """Audit every ``audit_id`` of ``pages`` at once.

    ``links``: audit_id, dst (crawl form). ``robots`` / ``sitemaps``: audits with a found file (None: do not check).
    ``responses``: findings of non-page captures. ``frontier``: audits stopped with URLs left over.
    """
    roots = findings.audit_roots(pages)
    linked = linkgraph.incoming_link_counts(links, pages)
    parts = [findings.detect_page_issues(pages), findings.duplicate_issues(pages, "title"),
             findings.duplicate_issues(pages, "description"), findings.orphan_issues(linked, roots)]
    if robots is not None:
        parts.append(findings.missing_file_issues(roots, robots, "robots-missing"))
    if sitemaps is not None:
        parts.append(findings.missing_file_issues(roots, sitemaps, "sitemap-missing"))
    if responses is not None:
        parts.append(responses)
    issues = parts[0]
    for more in parts[1:]:
        issues = issues.unionByName(more)
    counts = scoring.issue_url_counts(issues)
    score = scoring.audit_score(counts, roots)
    header = (roots.join(score.select("audit_id", "score"), "audit_id").join(scoring.group_counts(counts), "audit_id", "left")
              .withColumn("issue_count", F.coalesce("issue_count", F.lit(0)).cast("long"))
              .withColumn("finding_count", F.coalesce("finding_count", F.lit(0)).cast("long")))
    if frontier is not None:
        stopped = frontier.select("audit_id").distinct().withColumn("stopped", F.lit(True))
        header = header.join(stopped, "audit_id", "left").withColumn("stopped", F.coalesce("stopped", F.lit(False)))
    return AuditResult(linked, issues, header)


def parse_captures(captures: DataFrame) -> DataFrame:
    """Every landed capture with its page fields in place of the HTML, and a number ``capture``; staged.

    The one scan that reads bodies: they are parsed where they are read, and nothing that shuffles later holds them. Captures
    that are no HTML page get the fields of an empty one. Relative links resolve against the final URL.
    """
    c = F.col
    page = F.coalesce(c("content_type"), F.lit("")).rlike(findings.HTML_TYPES) & c("error").isNull()
    order = c("seq") if "seq" in captures.columns else F.lit(0)
    rows = captures.select("audit_id", c("url").alias("raw_url"), "final_url", order.cast("long").alias("taken"), "status", "content_type",
                           "load_time_ms", "error", page.alias("is_page"), F.monotonically_increasing_id().alias("capture"),
                           F.coalesce(absolute_url(c("final_url")), c("final_url"), c("url")).alias("url"), F.when(page, c("html")).alias("html"))
    return stage(extract_page_features(rows).drop("url"))


def chosen_captures(parsed: DataFrame, roots: DataFrame) -> DataFrame:
    """One capture for each crawl form of an audit, by its keys only: the first URL of that form, and its last capture."""
    c = F.col
    keys = parsed.select("audit_id", "raw_url", "final_url", "taken", "capture", "status", "content_type", "load_time_ms", "error", "is_page")
    based = keys.join(roots, "audit_id")
    based = canonicalize_urls(canonicalize_urls(based, "raw_url", "root_url", "key", resolved=True), "final_url", "root_url",
                              "final_canonical", resolved=True)
    first = F.struct(c("raw_url"), -c("taken"), -c("capture"))
    fields = ["capture", "raw_url", "final_url", "final_canonical", "status", "content_type", "error", "root_url",
              (c("is_page") & c("final_canonical").isNotNull()).alias("is_html")]
    return based.filter("key is not null").groupBy("audit_id", c("key").alias("url")).agg(F.min_by(F.struct(*fields), first).alias("r")).select(
        "audit_id", "url", "r.*")


def audit_captures(captures: DataFrame, roots: DataFrame, robots_docs: DataFrame, sitemap_docs: DataFrame, bot: str,
                   max_pages: int = 10, max_files: int | None = None, max_urls: int | None = None) -> AuditResult:
    """The whole audit from landed captures: parse, follow the crawl order, collect findings, score.

    ``captures``: audit_id, url, final_url, status, content_type, load_time_ms, html, error, and seq if a URL was captured
    more than once. ``robots_docs``: audit_id, body (found files only). ``sitemap_docs``: audit_id, doc_url, body. A root
    whose capture lands on another origin restarts its audit there. ``max_files`` and ``max_urls`` bound a site's sitemaps.
    """
    c = F.col
    parsed = parse_captures(captures)
    landed = parsed.select("audit_id", c("raw_url").alias("url"), "final_url", "taken", "capture").join(
        roots.select("audit_id", c("root_url").alias("url")), ["audit_id", "url"], "right")
    last = landed.groupBy("audit_id", c("url").alias("old_root")).agg(
        F.max_by(absolute_url(c("final_url")), F.struct("taken", "capture")).alias("moved"))
    roots = stage(last.select("audit_id", F.when(
        c("moved").isNotNull() & (origin(c("moved")) != origin(absolute_url(c("old_root")))), c("moved")).otherwise(
        absolute_url(c("old_root"))).alias("root_url")))
    rules = sitefiles.parse_robots(robots_docs, bot)
    seeds, documents = sitefiles.sitemap_tree(sitemap_docs, roots, sitefiles.declared_sitemaps(robots_docs), max_files, max_urls)
    checked = stage(sitefiles.robots_filter(chosen_captures(parsed, roots), rules))
    held = checked.filter("is_html").select("audit_id", "capture", c("url").alias("src"), "root_url")
    raw_links = parsed.select("audit_id", "capture", F.posexplode("internal_links").alias("position", "link")).join(held, ["audit_id", "capture"])
    links = stage(canonicalize_urls(raw_links, "link", "root_url", "dst", resolved=True).filter("dst is not null").select(
        "audit_id", "src", "dst", "position"))
    landing = checked.select("audit_id", "url", F.coalesce("final_canonical", "url").alias("final_url"), "is_html", "allowed")
    start = checked.select("audit_id", "root_url").distinct()
    visited, stopped = crawl_order(start, links, landing, max_pages, seeds, linked_by="url")
    visited = stage(visited)
    order = visited.filter("audited and is_html").select("audit_id", c("url").alias("src"), c("final_url").alias("url"), "seq")
    at = order.join(checked.select("audit_id", c("url").alias("src"), "capture"), ["audit_id", "src"])
    fields = parsed.drop("raw_url", "final_url", "taken", "is_page", "internal_links", "external_links")
    pages = stage(fields.join(at, ["audit_id", "capture"]).withColumns({"h1_count": F.size("h1"), "h1s": c("h1")}))
    reached = visited.select("audit_id", "url", "seq")
    rest = checked.filter(~c("is_html") | ~c("allowed")).withColumn("robots_allowed", c("allowed")).join(reached, ["audit_id", "url"])
    crawled = links.join(order.select("audit_id", "src"), ["audit_id", "src"], "left_semi")
    return audit_pages(pages, crawled.select("audit_id", "dst"), robots_docs.select("audit_id"),
                       documents.filter("kind is not null").select("audit_id"), findings.response_issues(rest), stopped)

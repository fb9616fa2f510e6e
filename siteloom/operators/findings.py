"""Rule findings of pages, responses and sites.

Issue rows: audit_id, seq, rule_no (order inside the audit is seq, then rule_no), code, severity, title, description,
recommendation, url, evidence, n_affected. ``n_affected`` carries the page count of site-wide findings whose affected
pages live in a child table instead of an evidence text.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from siteloom.functions import constants as K
from siteloom.functions.text import js_length, trim_ws
from siteloom.functions.urls import absolute_url, origin

SITE_SEQ = 1 << 60
ISSUE_COLUMNS = ["audit_id", "seq", "rule_no", "code", "severity", "title", "description", "recommendation", "url",
                 "evidence", "n_affected"]
_NUMBER = {row[0]: i for i, row in enumerate(K.FINDINGS)}
HTML_TYPES = r"(?i)text/html|application/xhtml\+xml"


_NAMES = ["code", "severity", "title", "description", "recommendation"]
_CATALOGUE = json.dumps([dict(zip(_NAMES, row[1:])) for row in K.FINDINGS])


def _catalogue() -> Column:
    """The fixed texts as one constant; the optimizer folds it to an array literal."""
    return F.from_json(F.lit(_CATALOGUE), "array<struct<" + ",".join(f"{n}:string" for n in _NAMES) + ">>")


def with_texts(hits: DataFrame) -> DataFrame:
    """Complete (audit_id, seq, rule_no, url, evidence, n_affected) rows with the fixed texts of their rule."""
    entry = F.element_at(_catalogue(), F.col("rule_no") + 1)
    full = hits.withColumn("__t", entry)
    if "description" in hits.columns:
        text = F.coalesce(F.col("description"), F.col("__t.description"))
    else:
        text = F.col("__t.description")
    title = F.coalesce(F.col("title"), F.col("__t.title")) if "title" in hits.columns else F.col("__t.title")
    advice = (F.coalesce(F.col("recommendation"), F.col("__t.recommendation"))
              if "recommendation" in hits.columns else F.col("__t.recommendation"))
    return full.select("audit_id", F.col("seq").cast("long").alias("seq"), F.col("rule_no").cast("int").alias("rule_no"),
                       F.col("__t.code").alias("code"), F.col("__t.severity").alias("severity"), title.alias("title"),
                       text.alias("description"), advice.alias("recommendation"), "url", "evidence",
                       F.col("n_affected").cast("long").alias("n_affected"))


def _site_hit(df: DataFrame, key: str, *extra: Column) -> DataFrame:
    return with_texts(df.select("audit_id", F.lit(SITE_SEQ).alias("seq"), F.lit(_NUMBER[key]).alias("rule_no"), "url",
                                F.lit(None).cast("string").alias("evidence"),
                                *(extra or [F.lit(None).cast("long").alias("n_affected")])))


def detect_page_issues(pages: DataFrame) -> DataFrame:
    """Rules over one page row, in rule order; one output row per fired rule, no shuffle.

    Needs the page fields plus ``h1_count``; ``canonical_resolved`` is used when present, otherwise absolute canonicals
    are resolved here.
    """
    c = F.col
    target = c("canonical_resolved") if "canonical_resolved" in pages.columns else absolute_url(c("canonical"))
    pages = (pages.withColumns({"__target": target, "__len_t": js_length(c("title")),
                                "__len_d": js_length(c("description"))})
                  .withColumn("__site", F.coalesce(origin(c("__target")), F.lit(""))))
    n_title, n_description, resolved = c("__len_t"), c("__len_d"), c("__target")
    web = c("__site").rlike("^https?://")
    blank = F.lit(None).cast("string")

    def hit(key: str, evidence: Column = blank) -> Column:
        return F.struct(F.lit(_NUMBER[key]).alias("rule_no"), evidence.cast("string").alias("evidence"))

    def sized(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {unit}"))

    http = F.concat(F.lit("HTTP "), c("status").cast("string"))
    fired = [
        F.when(c("status") >= 500, hit("page-5xx", http)).when(c("status") == 404, hit("page-404"))
         .when(c("status") >= 300, hit("page-non-2xx", http)),
        F.when(c("title") == "", hit("title-missing")).when(n_title < 20, hit("title-short", sized(n_title, "characters")))
         .when(n_title > 65, hit("title-long", sized(n_title, "characters"))),
        F.when(c("description") == "", hit("description-missing"))
         .when(n_description < 70, hit("description-short", sized(n_description, "characters")))
         .when(n_description > 170, hit("description-long", sized(n_description, "characters"))),
        F.when(c("h1_count") == 0, hit("h1-missing"))
         .when(c("h1_count") > 1, hit("h1-multiple", sized(c("h1_count"), "H1 elements"))),
        F.when(c("canonical") == "", hit("canonical-missing"))
         .when(~web, hit("canonical-invalid", c("canonical")))
         .when(c("__site") != origin(c("url")), hit("canonical-cross-origin", resolved)),
        F.when((c("canonical") != "") & web & resolved.rlike("#."),
               hit("canonical-fragment", resolved)),
        F.when(c("robots").rlike(r"(?i)\bnoindex\b"), hit("meta-noindex", c("robots"))),
        F.when(c("lang") == "", hit("lang-missing")),
        F.when(c("word_count") < 150, hit("thin-content", sized(c("word_count"), "words"))),
        F.when(c("images_missing_alt") > 0, hit("image-alt-missing", F.concat(
            c("images_missing_alt").cast("string"), F.lit(" of "), c("image_count").cast("string"), F.lit(" images")))),
        F.when((c("og_title") == "") | (c("og_description") == ""), hit("open-graph-incomplete")),
        F.when(c("load_time_ms") > 3000, hit("slow-response", sized(c("load_time_ms"), "ms"))),
    ]
    hits = (pages.select("audit_id", "seq", "url", F.explode(F.filter(F.array(*fired), lambda x: x.isNotNull()))
                         .alias("hit"))
                 .select("audit_id", "seq", "url", "hit.rule_no", "hit.evidence",
                         F.lit(None).cast("long").alias("n_affected")))
    return with_texts(hits)


def response_issues(captures: DataFrame) -> DataFrame:
    """Findings of captures that are not HTML pages: bad status, off-site redirect, failed fetch, robots block.

    Expects audit_id, seq, url, final_canonical, final_url, status, content_type, error, robots_allowed.
    """
    c = F.col
    other = ~F.coalesce(c("content_type"), F.lit("")).rlike(HTML_TYPES)
    number = (F.when(~F.coalesce(c("robots_allowed"), F.lit(True)), _NUMBER["robots-blocked"])
               .when(c("error").isNotNull(), _NUMBER["crawl-failed"])
               .when(c("final_canonical").isNull(), _NUMBER["external-redirect"])
               .when(other & (c("status") >= 500), _NUMBER["other-5xx"])
               .when(other & (c("status") == 404), _NUMBER["other-404"])
               .when(other & (c("status") >= 400), _NUMBER["other-4xx"]))
    evidence = (F.when(number == _NUMBER["external-redirect"], c("final_url"))
                 .when(number.isin(_NUMBER["other-5xx"], _NUMBER["other-4xx"]),
                       F.concat(F.lit("HTTP "), c("status").cast("string"))))
    at = F.when(number.isin(_NUMBER["other-5xx"], _NUMBER["other-404"], _NUMBER["other-4xx"]),
                c("final_canonical")).otherwise(c("url"))
    described = F.when(number == _NUMBER["crawl-failed"], c("error"))
    hits = captures.select("audit_id", "seq", number.alias("rule_no"), at.alias("url"), evidence.alias("evidence"),
                           described.alias("description"), F.lit(None).cast("long").alias("n_affected"))
    return with_texts(hits.filter("rule_no is not null"))


def duplicate_groups(pages: DataFrame, key: str) -> DataFrame:
    """Values shared by two or more pages of an audit: shown value, page count, first page. Combines map-side."""
    value = F.lower(trim_ws(F.col(key)))
    first = F.min_by("url", "seq")
    return (pages.select("audit_id", "seq", "url", value.alias("value")).filter("value <> ''")
                 .groupBy("audit_id", "value").agg(F.count(F.lit(1)).alias("n_pages"), F.min("seq").alias("first_seq"),
                                                   first.alias("first_url"))
                 .filter("n_pages >= 2"))


def duplicate_members(pages: DataFrame, key: str, width: int | None = None) -> DataFrame:
    """Every page of every duplicate group (the evidence lines), shared value first; order by first_seq, seq.

    ``width`` cuts the shown value, as the report's lines do (240)."""
    value = F.lower(trim_ws(F.col(key)))
    groups = duplicate_groups(pages, key).select("audit_id", "value", "first_seq")
    return (pages.select("audit_id", "seq", "url", value.alias("value")).join(groups, ["audit_id", "value"])
                 .select("audit_id", "first_seq", (F.col("value") if width is None else F.substring("value", 1, width)).alias("shared"), "seq", "url"))


def duplicate_occurrences(pages: DataFrame) -> DataFrame:
    """audit_id, code, url: every page that takes part in a duplicate finding, whatever their number."""
    both = [duplicate_members(pages, key).select("audit_id", F.lit(f"duplicate-{key}").alias("code"), "url") for key in ("title", "description")]
    return both[0].unionByName(both[1])


#: How the report names the field of a duplicate finding, and how much of a shared value it shows.
DUPLICATE_LABELS, SHOWN_VALUE = {"title": "title", "description": "meta description"}, 240


def duplicate_evidence(pages: DataFrame, block: int = 4096) -> DataFrame:
    """Evidence of the duplicate findings in bounded pieces: audit_id, code, a, b, joint, evidence, in the order (a, b).

    A group is its shared value, cut to ``SHOWN_VALUE`` characters, and a line for each page; piece b of the group that begins
    at page a holds the pages of ``block`` crawl positions. ``joint`` is what stands between a piece and the one before.
    """
    c = F.col
    found = None
    for key in DUPLICATE_LABELS:
        rows = duplicate_members(pages, key, SHOWN_VALUE).select("audit_id", F.lit(f"duplicate-{key}").alias("code"), "first_seq", "shared", "seq", "url")
        found = rows if found is None else found.unionByName(rows)
    pieces = found.groupBy("audit_id", "code", "first_seq", F.floor(c("seq") / block).alias("b")).agg(
        F.min("shared").alias("shared"), F.min("seq").alias("least"), F.array_sort(F.collect_list(F.struct("seq", "url"))).alias("pages"))
    opens, lines = c("least") == c("first_seq"), F.array_join("pages.url", "\n")
    return pieces.select("audit_id", "code", c("first_seq").cast("long").alias("a"), c("b").cast("long").alias("b"),
                         F.when(opens, "\n\n").otherwise("\n").alias("joint"),
                         F.when(opens, F.concat("shared", F.lit("\n"), lines)).otherwise(lines).alias("evidence"))


def duplicate_issues(pages: DataFrame, key: str) -> DataFrame:
    """One finding per audit with duplicate titles or descriptions."""
    label = DUPLICATE_LABELS[key]
    sites = duplicate_groups(pages, key).groupBy("audit_id").agg(
        F.sum("n_pages").alias("n_affected"), F.min_by("first_url", "first_seq").alias("url"))
    title, advice = f"Duplicate {label}", (f"Write a unique {label} for each indexable page or consolidate duplicate "
                                           f"URLs.")
    text = F.concat(F.col("n_affected").cast("string"), F.lit(f" crawled pages participate in duplicate {label} groups."))
    return sites.select(
        "audit_id", F.lit(SITE_SEQ).alias("seq"), F.lit(-2 if key == "title" else -1).alias("rule_no"),
        F.lit(f"duplicate-{key}").alias("code"), F.lit("high").alias("severity"), F.lit(title).alias("title"),
        text.alias("description"), F.lit(advice).alias("recommendation"), "url",
        F.lit(None).cast("string").alias("evidence"), F.col("n_affected").cast("long").alias("n_affected"))


def audit_roots(pages: DataFrame) -> DataFrame:
    """First crawled page of each audit."""
    return pages.groupBy("audit_id").agg(F.min_by("url", "seq").alias("root_url"),
                                         F.count(F.lit(1)).alias("pages_scanned"))


def orphan_issues(pages_with_links: DataFrame, roots: DataFrame) -> DataFrame:
    """Pages other than the root that no crawled page links to (needs incoming_links)."""
    lonely = (pages_with_links.filter("incoming_links = 0").join(roots.select("audit_id", "root_url"), "audit_id")
              .filter("url <> root_url"))
    hits = lonely.select("audit_id", (F.lit(SITE_SEQ) + F.col("seq")).alias("seq"),
                         F.lit(_NUMBER["orphan-in-crawl"]).alias("rule_no"), "url",
                         F.lit(None).cast("string").alias("evidence"), F.lit(None).cast("long").alias("n_affected"))
    return with_texts(hits)


def missing_file_issues(roots: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Audits whose site has no robots.txt (``robots-missing``) or no valid sitemap (``sitemap-missing``)."""
    absent = roots.join(found.select("audit_id").distinct(), "audit_id", "left_anti")
    late = 2 * SITE_SEQ + (0 if key == "robots-missing" else 1)
    return _site_hit(absent.withColumnRenamed("root_url", "url"), key).withColumn("seq", F.lit(late))

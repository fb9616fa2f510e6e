"""Recommendations: parsing of raw model output, quality gate, context rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siteloom.functions import constants as K
from siteloom.functions import text as X

SCHEMA = ("struct<summary:string,whyItMatters:string,implementation:string,code:string,verification:array<string>>")
#: The product's limits, for callers that want its texts cut.
LIMITS = {"summary": 2_000, "whyItMatters": 4_000, "implementation": 8_000, "code": 12_000}


def parse_recommendations(df: DataFrame, raw: str, limits: dict[str, int] | None = None, steps: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(parsed rows, reject rows with a reason): fences stripped, outermost object taken, required fields checked.

    Texts and verification steps are whole unless ``limits`` (characters a field) and ``steps`` cut them.
    """
    c = F.col
    body = F.regexp_replace(F.regexp_replace(X.trim_ws(c(raw)), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    blob = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    out = df.withColumn("__blob", blob).withColumn("__r", F.from_json("__blob", SCHEMA))
    def missing(n: str) -> Column:
        return c(f"__r.{n}").isNull() | (c(f"__r.{n}") == "")
    empty = missing("summary") & missing("whyItMatters") & missing("implementation") & missing("code")
    reason = (F.when((c("__blob") == "") | c("__r").isNull() | (empty & c("__r.verification").isNull()), "invalid-json")
               .when(missing("summary") | missing("implementation") | missing("whyItMatters"), "missing-fields"))
    out = out.withColumn("reject_reason", reason)
    limits = limits or {}
    texts = [(F.substring(c(f"__r.{n}"), 1, limits[n]) if n in limits else c(f"__r.{n}")).alias(n) for n in LIMITS]
    checks = F.coalesce(c("__r.verification"), F.array().cast("array<string>"))
    good = out.filter("reject_reason is null").select(*df.columns, *texts, (checks if steps is None else F.slice(checks, 1, steps)).alias("verification"))
    return (good.withColumnRenamed("whyItMatters", "why_it_matters"),
            out.filter("reject_reason is not null").select(*df.columns, "reject_reason"))


def recommendation_gate(recs: DataFrame, issue_title: str | None = None) -> DataFrame:
    """Add score, passed and warnings (fixed order). Needs summary, why_it_matters, implementation, code, verification."""
    c = F.col
    code = F.coalesce(c("code"), F.lit(""))
    staged = recs.withColumn("__all", F.concat_ws("\n", "summary", "why_it_matters", "implementation", code))

    def brief(name: str, n: int) -> Column:
        return F.length(X.trim_ws(c(name))) < n

    tests = {
        "summary": brief("summary", 20), "impact": brief("why_it_matters", 30),
        "implementation": brief("implementation", 45), "verification": F.size("verification") < 2,
        "steps": F.exists("verification", lambda s: F.length(X.trim_ws(s)) < 8),
        "guarantee": c("__all").rlike("(?i)" + "|".join(K.GUARANTEE_PATTERNS)),
        "manipulation": c("__all").rlike("(?i)" + "|".join(K.MANIPULATION_PATTERNS)),
        "code": F.length(code) > 12_000,
    }
    if issue_title:
        word = F.element_at(F.split(F.lower(c(issue_title)), rf"{X.WS}+"), 1)
        tests["unrelated"] = c(issue_title).isNotNull() & ~F.lower("__all").contains(word)
    tests = {k: tests[k] for k in K.GATE_WARNINGS if k in tests}
    points = F.lit(100)
    for key, test in tests.items():
        points = points - F.when(test, K.GATE_WARNINGS[key][0]).otherwise(0)
    texts = F.filter(F.array(*[F.when(t, K.GATE_WARNINGS[k][1]) for k, t in tests.items()]), lambda w: w.isNotNull())
    return (staged.withColumn("score", X.clamp(points, 0, 100)).withColumn("warnings", texts)
                  .withColumn("passed", (c("score") >= 65) & ~tests["manipulation"]).drop("__all"))


EVIDENCE_URL = r"""(https?://[^\s<>"']+)"""
PAGE_FIELDS = {"title": 300, "description": 600, "canonical": 1_000, "robots": 300}


def issue_pages(issues: DataFrame, pages: DataFrame, k: int | None = None) -> DataFrame:
    """Crawled pages each issue mentions, by its URL or by any URL inside its evidence, numbered in crawl order; the first ``k``, if given.

    ``issues``: audit_id, issue_id, url, evidence. A top-k is taken per issue with map-side pruning, all pages by blocks of the crawl.
    """
    from siteloom.operators.skew import bucketed_rank, top_per_key
    c = F.col
    loose = F.transform(F.coalesce(F.regexp_extract_all("evidence", F.lit(EVIDENCE_URL)), F.array().cast("array<string>")),
                        lambda u: F.regexp_replace(u, r"[),.;]+$", ""))
    own = F.when(c("url").isNotNull(), F.array("url")).otherwise(F.array().cast("array<string>"))
    wanted = issues.select("audit_id", "issue_id", F.explode(F.array_union(own, loose)).alias("url"))
    met, keys = wanted.join(pages, ["audit_id", "url"]), ["audit_id", "issue_id"]
    if k is None:
        return bucketed_rank(met, keys, F.floor(c("seq") / 4096), ["seq"], "nth")
    return top_per_key(met, keys, ["seq"], k, "nth")


def ai_issue_context(issues: DataFrame, pages: DataFrame, k: int = 12) -> DataFrame:
    """One row per issue: reduced pages, their count, guidance for one or for many pages.

    A context is what one prompt can hold, so it has the first ``k`` pages and shortened fields; ``issue_pages`` has them all.
    """
    c = F.col
    cut = [F.substring(n, 1, k).alias(n) for n, k in PAGE_FIELDS.items()]
    heads = F.transform(F.slice("h1s", 1, 5), lambda h: F.substring(h, 1, 300)).alias("h1")
    small = pages.select("audit_id", "seq", "url", "status", *cut, heads, "lang", "word_count", "heading_count",
                         "image_count", "images_missing_alt")
    fields = [x for x in small.columns if x not in ("audit_id", "seq")]
    met = issue_pages(issues, small, k).groupBy("audit_id", "issue_id").agg(
        F.array_sort(F.collect_list(F.struct("nth", F.struct(*fields).alias("page"))))["page"].alias("affected_pages"))
    out = issues.join(met, ["audit_id", "issue_id"], "left").withColumn(
        "affected_page_count", F.coalesce(F.size("affected_pages"), F.lit(0)))
    return out.withColumn("affected_page_count", F.greatest(c("affected_page_count"), F.lit(0))).withColumn(
        "guidance", F.when(c("affected_page_count") > 1, "Provide a shared template-level remediation and explain where "
                           "values must be generated per page.").otherwise(
            "Provide a concrete remediation for this page."))

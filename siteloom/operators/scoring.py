"""Grouping and scoring of issue rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siteloom.functions import constants as K
from siteloom.functions.text import clamp, js_round, lookup, trim_ws
from siteloom.operators.skew import group_hashed

GROUP = ["audit_id", "code", "severity", "title", "recommendation"]
URL_LINES = r"(?m)^(https?://\S+)$"


def issue_urls(url: Column, evidence: Column) -> Column:
    """Distinct URLs of an issue: its own and the evidence lines that are wholly a URL."""
    lines = F.coalesce(F.regexp_extract_all(evidence, F.lit(URL_LINES)), F.array().cast("array<string>"))
    own = F.when(url.isNotNull() & (url != ""), F.array(url)).otherwise(F.array().cast("array<string>"))
    return F.array_union(own, lines)


def expand_issue_occurrences(issues: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """One row per URL of an issue; issues without any URL stay once with a null URL (site-wide).

    ``members`` (audit_id, code, url) are affected URLs that stand in a table of their own, such as those of duplicate
    groups; an issue's own URL may then come twice.
    """
    rest = [c for c in issues.columns if c != "url"]
    out = issues.select(*rest, F.explode_outer(issue_urls(F.col("url"), F.col("evidence"))).alias("url"))
    if members is None:
        return out
    return out.unionByName(issues.drop("url").join(members, ["audit_id", "code"]).select(*rest, "url"))


def issue_url_counts(issues: DataFrame) -> DataFrame:
    """Issues per (group, URL): the one wide shuffle that scores and group counts share.

    The key holds the URL, so a hot audit or rule is spread over the cluster; later steps see one row per rule.
    """
    hint = F.col("n_affected") if "n_affected" in issues.columns else F.lit(None).cast("long")
    spread = issues.select(*GROUP, hint.alias("hint"),
                           F.posexplode_outer(issue_urls(F.col("url"), F.col("evidence"))).alias("pos", "u"))
    return spread.groupBy(*GROUP, "u").agg(
        F.count_if(F.coalesce(F.col("pos"), F.lit(0)) == 0).alias("n"), F.max("hint").alias("hint"))


def audit_score(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """Score per audit from issue_url_counts and (audit_id, pages_scanned)."""
    per_url = counts.groupBy("audit_id", "code", "severity", "u").agg(F.sum("n").alias("n"), F.max("hint").alias("hint"))
    per_rule = per_url.groupBy("audit_id", "code", "severity").agg(
        F.sum("n").alias("n"), F.count("u").alias("urls"), F.max("hint").alias("hint"))
    rated = per_rule.join(sizes.select("audit_id", "pages_scanned"), "audit_id")
    affected = F.greatest("n", "urls", F.coalesce("hint", F.lit(0)), F.lit(1)).cast("double")
    rated = rated.withColumn("affected", affected)
    share = F.least(F.lit(1.0), F.col("affected") / F.greatest(F.lit(1), F.col("pages_scanned")))
    breadth = (F.lit(1.0) + F.least(F.lit(1.0), F.log2(F.col("affected") + 1) / 4)
               + F.least(F.lit(0.35), share * 0.35))
    severity = F.col("severity")
    penalty = F.least(lookup(severity, K.ISSUE_CAP), lookup(severity, K.SEVERITY_BASE) * breadth)
    per_severity = rated.groupBy("audit_id", "severity").agg(F.sum(penalty).alias("penalty"))
    total = per_severity.groupBy("audit_id").agg(
        F.sum(F.least("penalty", lookup(severity, K.SEVERITY_CAP))).alias("penalty"))
    return sizes.join(total, "audit_id", "left").select(
        "audit_id", "pages_scanned",
        clamp(js_round(100 - F.coalesce("penalty", F.lit(0.0))), 0, 100).cast("int").alias("score"))


def group_counts(counts: DataFrame) -> DataFrame:
    """Issue groups and findings per audit from issue_url_counts."""
    groups = counts.groupBy(*GROUP).agg(F.sum("n").alias("n"))
    return groups.groupBy("audit_id").agg(F.count(F.lit(1)).alias("issue_count"), F.sum("n").alias("finding_count"))


def grouped_issue_parts(issues: DataFrame) -> DataFrame:
    """Child rows of the issue groups: each distinct URL (kind u) and evidence block (kind e) at its first position.

    A group's list of URLs has no bound, so it stays a table instead of one long text. An issue is counted in the row of its URL,
    or in the group's row without a value (kind g) if it has none; these rows bring the description, rows of evidence none.
    """
    url, block = F.nullif(F.col("url"), F.lit("")), F.nullif(trim_ws(F.col("evidence")), F.lit(""))
    pieces = F.array(F.struct(F.when(url.isNull(), "g").otherwise("u").alias("kind"), F.coalesce(url, F.lit("")).alias("value"),
                              F.col("description").alias("description")))
    found = F.struct(F.lit("e").alias("kind"), block.alias("value"), F.lit(None).cast("string").alias("description"))
    pieces = F.when(block.isNull(), pieces).otherwise(F.array_append(pieces, found))
    rows = issues.select(*GROUP, "seq", "rule_no", F.explode(pieces).alias("__piece")).select(
        *GROUP, "seq", "rule_no", *[F.col("__piece")[x].alias(x) for x in ("kind", "value", "description")])
    first = F.min(F.struct("seq", "rule_no", "description")).alias("first")
    return group_hashed(rows, *GROUP, "kind", "value").agg(first, F.count(F.lit(1)).alias("n")).select(
        *GROUP, "kind", "value", F.struct("first.seq", "first.rule_no").alias("first_at"), "first.description", "n")


def group_issues(parts: DataFrame) -> DataFrame:
    """Issue groups from the child rows: issue, URL and evidence counts, representative text and URL, the whole evidence.

    ``evidence`` is the usual text: the distinct blocks, then the list of affected URLs when there is more than one; null without
    either. It is gathered in the aggregation of the counts, and only where it is read.
    """
    is_url, is_block, issue = F.col("kind") == "u", F.col("kind") == "e", F.col("kind") != "e"
    place = F.struct("first_at", "value")
    heads = group_hashed(parts, *GROUP).agg(
        F.sum(F.when(issue, F.col("n"))).alias("n_issues"), F.count_if(is_url).alias("n_urls"),
        F.count_if(is_block).alias("n_evidence"), F.min(F.when(is_url, place)).alias("url"),
        F.min(F.when(issue, F.struct("first_at", "description"))).alias("first"),
        F.array_sort(F.collect_list(F.when(is_block, place))).alias("blocks"),
        F.array_sort(F.collect_list(F.when(is_url, place))).alias("urls"))
    described = F.col("first.description")
    text = F.when(F.col("n_urls") > 1, F.concat(F.col("n_urls").cast("string"), F.lit(" crawled pages are affected. "),
                                                described)).otherwise(described)
    listed = F.when(F.col("n_urls") > 1, F.array(F.concat(F.lit("Affected URLs:\n"), F.array_join("urls.value", "\n")))).otherwise(
        F.array().cast("array<string>"))
    evidence = F.nullif(F.array_join(F.concat("blocks.value", listed), "\n\n"), F.lit(""))
    return heads.select(*GROUP, "n_issues", "n_urls", "n_evidence", F.col("url.value").alias("url"), text.alias("description"),
                        evidence.alias("evidence"), F.col("first.first_at.seq").alias("first_seq"),
                        F.col("first.first_at.rule_no").alias("first_rule"))


def evidence_chunks(parts: DataFrame, width: int = 4096) -> DataFrame:
    """Evidence texts of the groups in bounded pieces.

    Chunk n holds the blocks first seen in crawl positions [n*width, (n+1)*width); a group seen within one chunk gets
    the usual single text: evidence blocks, then the list of affected URLs when there is more than one.
    """
    rows = parts.filter("kind <> 'g'").withColumn("chunk", F.floor(F.col("first_at.seq") / width))
    gathered = rows.groupBy(*GROUP, "chunk").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "e", F.struct("first_at", "value")))).alias("e"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "u", F.struct("first_at", "value")))).alias("u"))
    urls = F.array_join(F.col("u.value"), "\n")
    listed = F.when(F.size("u") > 1, F.array(F.concat(F.lit("Affected URLs:\n"), urls))).otherwise(
        F.array().cast("array<string>"))
    return gathered.select(*GROUP, "chunk", F.array_join(F.concat(F.col("e.value"), listed), "\n\n").alias("evidence"))


def issue_counts(issues: DataFrame) -> DataFrame:
    """Issues per audit and severity with zero fill, one column per severity."""
    return issues.groupBy("audit_id").agg(
        *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in K.SEVERITIES])


def issues_by_severity(issues: DataFrame, severity: str | None = None) -> DataFrame:
    """Optional severity filter, most severe first."""
    rank = F.array_position(F.array(*[F.lit(s) for s in K.SEVERITIES]), F.col("severity"))
    picked = issues if severity is None else issues.filter(F.col("severity") == severity)
    return picked.orderBy("audit_id", rank, "seq", "rule_no")

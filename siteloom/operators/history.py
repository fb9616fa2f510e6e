"""Audit history: latest lists, previous audits, trends, and the differences between consecutive audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siteloom.functions.urls import normalize_issue_url
from siteloom.operators.scoring import expand_issue_occurrences
from siteloom.operators.skew import bucketed_lag, group_hashed, top_per_key

COMPARED = {"status": "status", "title": "title", "description": "description", "canonical": "canonical",
            "robots": "robots", "word_count": "wordCount"}


def latest_n(df: DataFrame, owner: str, n: int, at: str = "created_at", tie: str = "id", rank: str | None = None) -> DataFrame:
    """Newest ``n`` rows per owner (projects 100, audits 50, analyses 30, briefs 50, alerts 100, snapshots 12, ...)."""
    return top_per_key(df, [owner], [F.desc(at), F.desc(tie)], n, rank)


def owned_by(df: DataFrame, projects: DataFrame) -> DataFrame:
    """Rows whose project belongs to their owner."""
    return df.join(projects.select("owner", "project_id").distinct(), ["owner", "project_id"], "left_semi")


def trend(delta: Column) -> Column:
    return F.when(delta > 0, "improved").when(delta < 0, "declined").when(delta == 0, "unchanged")


def previous_audit(audits: DataFrame) -> DataFrame:
    """Add the comparable earlier audit: same owner and project, whatever the root; without a project the same root.

    Runs per calendar month with a carry between months, so an owner with most of the history is not one task.
    """
    scope = F.when(F.col("project_id").isNull(), F.col("root_url")).otherwise("")
    carried = F.struct(F.col("audit_id").alias("previous_audit_id"), F.col("score").alias("previous_score"),
                       F.col("created_at").alias("previous_created_at"))
    keyed = audits.withColumn("scope", scope)
    out = bucketed_lag(keyed, ["owner", "project_id", "scope"], F.trunc("created_at", "month"),
                       ["created_at", "audit_id"], carried, "prev")
    return out.select(*audits.columns, "prev.previous_audit_id", "prev.previous_score", "prev.previous_created_at")


def audit_trend(audits: DataFrame) -> DataFrame:
    """Score delta against the previous comparable audit and its direction (null for a first audit)."""
    out = previous_audit(audits).withColumn("score_delta", F.col("score") - F.col("previous_score"))
    return out.withColumn("trend", trend(F.col("score_delta")))


def _both_sides(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of each audit under its own id (current) and under the id of the audit that follows it (previous).

    Every audit precedes at most one other, so one join at most doubles the rows, whatever the skew.
    """
    pairs = pairs.filter("previous_audit_id is not null").select("audit_id", "previous_audit_id")
    roles = pairs.select(F.explode(F.array(
        F.struct(F.col("audit_id").alias("of"), F.col("audit_id").alias("pair"), F.lit(True).alias("current")),
        F.struct(F.col("previous_audit_id").alias("of"), F.col("audit_id").alias("pair"),
                 F.lit(False).alias("current")))).alias("r")).select("r.*")
    joined = rows.withColumnRenamed("audit_id", "of").join(roles, "of")
    return joined.drop("of").withColumnRenamed("pair", "audit_id")


def issue_diff(issues: DataFrame, pairs: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """New, fixed and persistent issue fingerprints of every (audit_id, previous_audit_id) pair.

    A fingerprint is code|normalised URL over all occurrences; its last row wins. One shuffle on (pair, fingerprint).
    ``members``: affected URLs of duplicate findings (findings.duplicate_occurrences).
    """
    occurrences = expand_issue_occurrences(issues, members).select(
        "audit_id", F.concat_ws("|", "code", normalize_issue_url(F.col("url"))).alias("fingerprint"),
        F.struct("seq", "code", "severity", "title", "url").alias("row"))
    sides = _both_sides(occurrences, pairs)
    folded = group_hashed(sides, "audit_id", "fingerprint").agg(
        F.max(F.when(F.col("current"), F.col("row"))).alias("now"),
        F.max(F.when(~F.col("current"), F.col("row"))).alias("before"))
    status = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "fixed").otherwise("persistent")
    return (folded.withColumn("row", F.coalesce("now", "before"))
                  .select("audit_id", "fingerprint", status.alias("status"), "row.code", "row.severity", "row.title",
                          "row.url", "row.seq"))


def page_diff(pages: DataFrame, pairs: DataFrame) -> DataFrame:
    """New, removed and changed pages of every pair; ``fields`` lists the changed fields in fixed order."""
    rows = pages.select("audit_id", normalize_issue_url(F.col("url")).alias("page"),
                        F.struct("seq", "url", *COMPARED).alias("row"))
    folded = group_hashed(_both_sides(rows, pairs), "audit_id", "page").agg(
        F.max_by("row", F.when(F.col("current"), F.col("row.seq"))).alias("now"),
        F.max_by("row", F.when(~F.col("current"), F.col("row.seq"))).alias("before"))
    changed = F.filter(F.array(*[F.when(~F.col(f"now.{c}").eqNullSafe(F.col(f"before.{c}")), F.lit(name))
                                 for c, name in COMPARED.items()]), lambda x: x.isNotNull())
    both = F.col("now").isNotNull() & F.col("before").isNotNull()
    status = (F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "removed")
               .when(F.size("fields") > 0, "changed"))
    return (folded.withColumn("fields", F.when(both, changed).otherwise(F.array().cast("array<string>")))
                  .withColumn("status", status).filter("status is not null")
                  .select("audit_id", F.when(both, F.col("now.url")).otherwise(F.col("page")).alias("url"), "status",
                          "fields"))


def diff_summary(diff: DataFrame) -> DataFrame:
    """New, fixed and persistent issue counts per audit."""
    return diff.groupBy("audit_id").agg(*[F.count_if(F.col("status") == s).alias(f"{s}_count")
                                          for s in ("new", "fixed", "persistent")])


def compare_audits(audits: DataFrame, issues: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Header of every consecutive comparison: delta, trend and issue counts."""
    trended = audit_trend(audits).filter("previous_audit_id is not null")
    counts = diff_summary(issue_diff(issues, trended.select("audit_id", "previous_audit_id"), members))
    zero = {f"{s}_count": 0 for s in ("new", "fixed", "persistent")}
    return (trended.join(counts, "audit_id", "left").na.fill(zero)
                   .select("audit_id", "previous_audit_id", "score_delta", "trend", *zero))


def new_issue_flag(issues: DataFrame, new_issues: DataFrame) -> DataFrame:
    """status new/existing per issue, matched on code|raw URL."""
    key = F.concat_ws("|", F.col("code"), F.coalesce(F.nullif(F.col("url"), F.lit("")), F.lit("site-wide")))
    fresh = new_issues.select("audit_id", key.alias("issue_key")).distinct().withColumn("fresh", F.lit(True))
    return (issues.withColumn("issue_key", key).join(fresh, ["audit_id", "issue_key"], "left")
                  .withColumn("status", F.when(F.col("fresh"), "new").otherwise("existing")).drop("fresh", "issue_key"))

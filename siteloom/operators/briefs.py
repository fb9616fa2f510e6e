"""Content briefs from keyword clusters, and validated edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siteloom.functions import constants as K
from siteloom.functions import text as X

OUTLINE = "array<struct<level:int,heading:string,purpose:string>>"


def _fill(template: Column, **values: Column) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def _table(key: Column, table: dict[str, list[str]]) -> Column:
    """Fixed list per key."""
    pairs = [x for k, vs in table.items() for x in (F.lit(k), F.array(*[F.lit(v) for v in vs]))]
    return F.coalesce(F.create_map(*pairs)[key], F.array().cast("array<string>"))


def content_briefs(clusters: DataFrame) -> DataFrame:
    """Brief rows; ``clusters``: analysis_id, cluster_id, primary_keyword, intent, page_type, suggested_slug, keywords.

    A cluster's first 100 keywords in list order serve as its supporting ones.
    """
    c = F.col
    p = X.collapse_ws(c("primary_keyword"))
    base = clusters.withColumn("primary_keyword", p).withColumn("h1", X.title_case(c("primary_keyword"))).withColumn(
        "supporting", F.filter(X.unique_strings(c("keywords"), 100, 200),
                               lambda k: F.lower(k) != F.lower(c("primary_keyword"))))
    valid = base.filter(c("intent").isin(K.INTENTS) & c("page_type").isin(list(K.OUTLINES))
                        & (c("primary_keyword") != "") & (F.length("primary_keyword") <= 200))
    suffix = F.coalesce(X.lookup(c("page_type"), K.TITLE_SUFFIX), F.lit(K.DEFAULT_TITLE_SUFFIX))
    names = {t: [h for h, _ in rows] for t, rows in K.OUTLINES.items()}
    aims = {t: [a for _, a in rows] for t, rows in K.OUTLINES.items()}
    outline = F.zip_with(_table(c("page_type"), names), _table(c("page_type"), aims), lambda h, a: F.struct(
        F.lit(2).alias("level"), _fill(h, topic=c("h1"), primary=c("primary_keyword")).alias("heading"), a.alias("purpose")))
    stock = F.concat(F.array(*[F.lit(q) for q in K.BASE_QUESTIONS]), _table(c("intent"), K.INTENT_QUESTIONS))
    asked = F.transform(F.filter("supporting", lambda k: k.rlike(K.QUESTION_START)),
                        lambda k: F.concat(F.regexp_replace(k, r"\?+$", ""), F.lit("?")))
    questions = F.concat(F.transform(stock, lambda q: _fill(q, p=c("primary_keyword"))), asked)
    ideas = F.transform(F.slice("supporting", 1, 8), lambda k: _fill(F.lit(K.LINK_IDEA), k=k))
    return valid.select(
        X.stable_id(c("analysis_id"), c("cluster_id")).alias("brief_id"), "analysis_id", "cluster_id",
        F.concat("h1", F.lit(" content brief")).alias("name"), "primary_keyword", c("supporting").alias("supporting_keywords"),
        "intent", "page_type", "suggested_slug", X.trim_meta(F.concat("h1", F.lit(" — "), suffix), 60).alias("title"),
        X.trim_meta(_fill(F.lit(K.META_DESCRIPTION), p=c("primary_keyword")), 155).alias("meta_description"), "h1",
        _fill(F.lit(K.AUDIENCE), p=c("primary_keyword")).alias("audience"),
        _fill(F.lit(K.INTENT_SUMMARY), label=X.lookup(c("intent"), K.INTENT_LABELS)).alias("search_intent_summary"),
        F.lit(K.ANGLE).alias("angle"), outline.alias("outline"), X.unique_strings(questions, 12, 220).alias("questions"),
        ideas.alias("internal_link_ideas"), _table(c("page_type"), K.SCHEMA_TYPES).alias("schema_types"),
        F.array(*[F.lit(q) for q in K.QUALITY_CHECKLIST]).alias("quality_checklist"), F.lit("draft").alias("status"))


def cluster_keyword_lists(items: DataFrame, profiles: DataFrame, limit: int = 101) -> DataFrame:
    """Clusters with the first keywords of their list (text order): what a brief can use of them."""
    from siteloom.operators.skew import top_per_key
    keys = ["analysis_id", "cluster_id"]
    first = top_per_key(items.select(*keys, "keyword"), keys, ["keyword"], limit)
    lists = first.groupBy(*keys).agg(F.sort_array(F.collect_list("keyword")).alias("keywords"))
    return profiles.join(lists, keys)


TEXT_LIMITS = {"name": 100, "primary_keyword": 200, "suggested_slug": 120, "title": 180, "meta_description": 320, "h1": 180,
               "audience": 500, "search_intent_summary": 700, "angle": 700}
LIST_LIMITS = {"supporting_keywords": (100, 200), "questions": (30, 220), "internal_link_ideas": (30, 300),
               "schema_types": (12, 80), "quality_checklist": (30, 300)}


def merge_brief_edits(briefs: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged briefs, rejected edits with the offending field): a null field keeps its value, ids never change.

    ``edits``: brief_id plus any of the brief's editable columns. An unknown status keeps the old one.
    """
    c = F.col
    texts = [n for n in TEXT_LIMITS if n in edits.columns]
    lists = [n for n in LIST_LIMITS if n in edits.columns]
    checked = edits.withColumns({f"__{n}": X.clean_text(c(n), TEXT_LIMITS[n]) for n in texts})
    bad = F.lit(None).cast("string")
    for n in reversed(texts):
        bad = F.when(c(n).isNotNull() & c(f"__{n}.error").isNotNull(), F.concat(F.lit(f"{n}:"), c(f"__{n}.error"))).otherwise(bad)
    if "outline" in edits.columns:
        broken = F.exists(F.slice("outline", 1, 30), lambda s: X.clean_text(s["heading"], 180)["error"].isNotNull()
                          | X.clean_text(s["purpose"], 500)["error"].isNotNull())
        bad = F.coalesce(bad, F.when(c("outline").isNotNull() & broken, "outline:invalid"))
    checked = checked.withColumn("reject_reason", bad)
    rejects = checked.filter("reject_reason is not null").select("brief_id", "reject_reason")
    good = checked.filter("reject_reason is null")
    values = {n: c(f"__{n}.value") for n in texts}
    values |= {n: F.when(c(n).isNotNull(), X.unique_strings(c(n), *LIST_LIMITS[n])) for n in lists}
    if "outline" in edits.columns:
        values["outline"] = F.transform(F.slice("outline", 1, 30), lambda s: F.struct(
            F.when(s["level"] == 3, 3).otherwise(2).alias("level"), X.collapse_ws(s["heading"]).alias("heading"),
            X.collapse_ws(s["purpose"]).alias("purpose")))
    if "status" in edits.columns:
        values["status"] = F.when(c("status").isin(K.BRIEF_STATUSES), c("status"))
    new = good.select("brief_id", *[v.alias(f"new_{n}") for n, v in values.items()])
    merged = briefs.join(new, "brief_id", "left").select(
        *[F.coalesce(f"new_{n}", n).alias(n) if n in values else c(n) for n in briefs.columns])
    return merged, rejects


def brief_source(requests: DataFrame, clusters: DataFrame) -> DataFrame:
    """Trusted stored cluster of each (analysis_id, cluster_id) request."""
    return requests.join(clusters, ["analysis_id", "cluster_id"])

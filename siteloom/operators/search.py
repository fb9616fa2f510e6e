"""Search-performance rows: totals, opportunities, property choice and sync ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siteloom.functions import constants as K
from siteloom.functions.text import clamp, js_round, lookup, stable_id
from siteloom.functions.urls import origin, url_part
from siteloom.operators.skew import top_per_key


def search_totals(rows: DataFrame) -> DataFrame:
    """Clicks, impressions, click rate and impression-weighted position per snapshot; combines map-side."""
    c = F.col
    sums = rows.groupBy("snapshot_id").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"),
                                           F.sum(c("position") * c("impressions")).alias("weighted"))
    shown = c("impressions") > 0
    return sums.select("snapshot_id", "clicks", "impressions",
                       F.when(shown, c("clicks") / c("impressions")).otherwise(0.0).alias("ctr"),
                       F.when(shown, c("weighted") / c("impressions")).otherwise(0.0).alias("position"))


def opportunity_candidates(rows: DataFrame) -> DataFrame:
    """Up to three scored opportunities per row with at least 20 impressions."""
    c = F.col
    rate, seen = c("ctr") * 100, F.log10(c("impressions") + 1)

    def kind(test: Column, name: str, score: Column) -> Column:
        return F.when(test, F.struct(F.lit(name).alias("kind"), clamp(js_round(score), 0, 100).cast("int").alias("score")))

    found = F.array(
        kind(c("position").between(4, 20), "striking-distance",
             35 + seen * 16 + F.greatest(F.lit(0.0), 20 - c("position")) * 1.8),
        kind((c("position") <= 10) & (rate < 2.5), "low-ctr",
             45 + seen * 15 + F.greatest(F.lit(0.0), 2.5 - rate) * 8),
        kind((c("impressions") >= 250) & (c("clicks") < 5), "high-impressions", 50 + seen * 14 - c("clicks")))
    return (rows.filter("impressions >= 20")
                .select(*rows.columns, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("o"))
                .select(*rows.columns, "o.kind", "o.score"))


def best_opportunities(candidates: DataFrame) -> DataFrame:
    """Highest score per (snapshot, kind, query, page); a tie keeps the row with more impressions."""
    cols = [c for c in candidates.columns if c not in ("snapshot_id", "kind", "query", "page", "score")]
    best = candidates.groupBy("snapshot_id", "kind", "query", "page").agg(
        F.max(F.struct("score", "impressions", *[c for c in cols if c != "impressions"])).alias("b"))
    return best.select("snapshot_id", "kind", "query", "page", "b.score", *[f"b.{c}" for c in cols])


def search_opportunities(rows: DataFrame, k: int = 250) -> DataFrame:
    """The ``k`` best opportunities per snapshot, score descending; ties by kind, query and page."""
    best = best_opportunities(opportunity_candidates(rows))
    top = top_per_key(best, ["snapshot_id"], [F.desc("score"), "kind", "query", "page"], k, "rank")
    return top.withColumn("recommendation", lookup(F.col("kind"), K.OPPORTUNITY_TEXT)).withColumn(
        "id", stable_id(*[F.col(c) for c in ("snapshot_id", "kind", "query", "page")]))


def sync_date_range(now: Column, days: Column) -> Column:
    """struct(start_date, end_date): ends three days ago; 7, 28 or 90 days long, 28 for anything else."""
    span = F.when(days.isin(7, 28, 90), days).otherwise(28)
    end = F.date_sub(now, 3)
    return F.struct(F.date_sub(end, clamp(span - 1, 6, 89).cast("int")).alias("start_date"), end.alias("end_date"))


def choose_property(projects: DataFrame, properties: DataFrame) -> DataFrame:
    """Best search property per project: exact site, then domain, then same-origin prefix, then the first listed.

    ``properties``: owner, position, site_url. Three equi-joins and one first-per-owner, so no owner's
    projects x properties product is built.
    """
    c = F.col
    wanted = projects.withColumns({"origin": origin(c("root_url")), "host": url_part(c("root_url"), "host")})
    listed = properties.select("owner", "position", "site_url")

    def first_match(name: str, key: Column, prop_key: Column) -> DataFrame:
        side = listed.withColumn("k", prop_key).groupBy("owner", "k").agg(F.min_by("site_url", "position").alias(name),
                                                                         F.min("position").alias(f"{name}_at"))
        return wanted.select("project_id", "owner", F.explode(key).alias("k")).join(side, ["owner", "k"]).groupBy(
            "project_id").agg(F.min_by(name, f"{name}_at").alias(name))

    exact = first_match("exact", F.array_distinct(F.array(F.concat("origin", F.lit("/")), "root_url")), c("site_url"))
    domain = first_match("domain", F.array(F.concat(F.lit("sc-domain:"), c("host"))), c("site_url"))
    # startswith(origin): any property whose own text begins with the origin, longer hosts and ports included
    prefixes = F.transform(F.sequence(F.lit(1), F.length("site_url")), lambda n: F.substring(c("site_url"), F.lit(1), n))
    owned = listed.withColumn("k", F.explode(prefixes)).join(
        wanted.select("owner", F.col("origin").alias("k")).distinct(), ["owner", "k"], "left_semi")
    by_prefix = owned.groupBy("owner", "k").agg(F.min_by("site_url", "position").alias("prefix"))
    prefix = wanted.select("project_id", "owner", c("origin").alias("k")).join(by_prefix, ["owner", "k"]).select(
        "project_id", "prefix")
    first = listed.groupBy("owner").agg(F.min_by("site_url", "position").alias("first"))
    return (wanted.join(exact, "project_id", "left").join(domain, "project_id", "left")
            .join(prefix, "project_id", "left").join(first, "owner", "left")
            .select("owner", "project_id", F.coalesce("exact", "domain", "prefix", "first").alias("site_url")))

"""Link graph of an audit: resolution and in-degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def incoming_link_counts(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages with incoming_links: (page, distinct raw link) pairs whose crawl form is the page.

    Links are counted per target before the join, so a hub page that a third of all links point to arrives as one
    partial count per map task. ``links``: audit_id, dst (crawl form), distinct per (src, raw link).
    """
    counts = (links.filter("dst is not null").groupBy("audit_id", F.col("dst").alias("url"))
                   .agg(F.count(F.lit(1)).alias("incoming_links")))
    return (pages.join(counts, ["audit_id", "url"], "left")
                 .withColumn("incoming_links", F.coalesce("incoming_links", F.lit(0)).cast("int")))


def link_resolution(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Links whose crawl form is a crawled page of the same audit."""
    targets = pages.select("audit_id", F.col("url").alias("dst"), F.col("seq").alias("dst_seq"))
    return links.join(targets, ["audit_id", "dst"])


def final_url_dedup(captures: DataFrame) -> DataFrame:
    """First capture per (audit, final URL) in crawl order; combines map-side."""
    cols = [c for c in captures.columns if c not in ("audit_id", "final_url")]
    first = captures.groupBy("audit_id", "final_url").agg(F.min_by(F.struct(*cols), "seq").alias("r"))
    return first.select("audit_id", "final_url", "r.*")

"""robots.txt and sitemap documents: parsing, matching, tree walk."""

from __future__ import annotations

import uuid
from itertools import count

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from siteloom.functions import constants as K
from siteloom.functions import text as X
from siteloom.functions import urls as U
from siteloom.operators.skew import bucketed_rank, top_per_key
from siteloom.session import stage, staging_dir


def robots_lines(docs: DataFrame) -> DataFrame:
    """Directive lines of robots bodies: audit_id, line, field, value. ``docs``: audit_id, body."""
    lines = docs.select("audit_id", F.posexplode(F.split("body", r"\r?\n")).alias("line", "text"))
    bare = X.trim_ws(F.regexp_extract("text", "(?s)^([^#]*)", 1))
    return (lines.withColumn("bare", bare).filter(F.col("bare").contains(":"))
                 .select("audit_id", "line", F.lower(X.trim_ws(F.regexp_extract("bare", "(?s)^([^:]*):", 1))).alias("field"),
                         X.trim_ws(F.regexp_extract("bare", "(?s)^[^:]*:(.*)$", 1)).alias("value")))


def parse_robots(docs: DataFrame, bot: str) -> DataFrame:
    """Rules that apply to ``bot``: audit_id, line, pattern, allow, specificity, crawl_delay_ms.

    Consecutive user-agent lines share a group; a user-agent after a directive opens the next one. Groups naming a
    prefix of the bot win over the ``*`` groups. The window is per document, which is one bounded file.
    """
    c = F.col
    used = robots_lines(docs).filter(c("field").isin("user-agent", "allow", "disallow", "crawl-delay"))
    by_line = W.partitionBy("audit_id").orderBy("line")
    opens = (c("field") == "user-agent") & (F.lag("field").over(by_line) != "user-agent")
    grouped = used.withColumn("opens", F.coalesce(opens, F.lit(False)).cast("int")).withColumn(
        "group", F.sum("opens").over(by_line.rowsBetween(W.unboundedPreceding, 0)))
    agent = F.lower(F.when((c("field") == "user-agent") & (c("value") != ""), c("value")))
    seconds = F.when(c("value") == "", F.lit(0.0)).otherwise(c("value").try_cast("double"))
    delay = F.when((c("field") == "crawl-delay") & (seconds >= 0) & (seconds < float("inf")),
                   F.least(F.lit(K.MAX_CRAWL_DELAY_MS), X.js_round(F.least(seconds, F.lit(1e6)) * 1000)))
    groups = grouped.groupBy("audit_id", "group").agg(
        F.bool_or((agent != "*") & F.lit(bot.lower()).startswith(agent)).alias("mine"), F.bool_or(agent == "*").alias("star"),
        F.max_by(delay, F.when(delay.isNotNull(), c("line"))).alias("delay"))
    groups = groups.na.fill(False, ["mine", "star"])
    named = groups.groupBy("audit_id").agg(F.bool_or("mine").alias("named"))
    chosen = groups.join(named, "audit_id").filter(F.when(c("named"), c("mine")).otherwise(c("star")))
    delays = chosen.groupBy("audit_id").agg(F.coalesce(F.max("delay"), F.lit(0)).alias("crawl_delay_ms"))
    rules = grouped.filter(c("field").isin("allow", "disallow") & (c("value") != ""))
    return (rules.join(chosen.select("audit_id", "group"), ["audit_id", "group"]).join(delays, "audit_id")
                 .select("audit_id", "line", c("value").alias("pattern"), (c("field") == "allow").alias("allow"),
                         F.length(F.regexp_replace("value", r"[*$]", "")).alias("specificity"), "crawl_delay_ms"))


def declared_sitemaps(docs: DataFrame) -> DataFrame:
    """Distinct sitemap URLs that robots bodies declare, first line kept."""
    found = robots_lines(docs).filter((F.col("field") == "sitemap") & (F.col("value") != ""))
    return found.groupBy("audit_id", F.col("value").alias("doc_url")).agg(F.min("line").alias("line"))


def _rule_regex(pattern: Column) -> Column:
    body = F.regexp_replace(F.regexp_replace(pattern, r"\$$", ""), r"([.+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(body, F.lit("*"), F.lit(".*")), F.when(pattern.endswith("$"), "$").otherwise(""))


def robots_filter(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Add ``allowed``: the most specific matching rule decides, allow wins ties, no match means allowed.

    The rules of a site (one file) travel as one array, so a site with a third of all URLs multiplies no rows.
    """
    c = F.col
    plain = ~c("pattern").rlike(r"[*$]")
    packed = rules.groupBy("audit_id").agg(F.collect_list(F.struct(
        "specificity", "allow", plain.alias("plain"), "pattern", _rule_regex(c("pattern")).alias("regex"))).alias("rules"))
    target = F.concat(U.path_of(c(url)), F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1))
    joined = urls.withColumn("__path", target).join(packed, "audit_id", "left")
    hits = F.filter("rules", lambda r: F.when(r["plain"], c("__path").startswith(r["pattern"])).otherwise(
        F.rlike(c("__path"), r["regex"])))
    best = F.array_max(F.transform(hits, lambda r: F.struct(r["specificity"], r["allow"])))
    return joined.withColumn("allowed", F.coalesce(best["allow"], F.lit(True))).drop("rules", "__path")


def sitemap_locations(docs: DataFrame, max_locations: int | None = None) -> DataFrame:
    """One row per location of each sitemap document, in its place: the columns of ``docs`` but body, kind, at, loc.

    ``kind`` is sitemapindex, urlset or null; a document without locations, or of no known kind, is one row without ``loc``.
    ``max_locations`` keeps the first ones of a document.
    """
    c = F.col
    raw = F.regexp_extract_all(c("body"), F.lit(r"(?is)<loc\b[^>]*>(.*?)</loc>"), F.lit(1))
    values = F.transform(raw, lambda v: X.decode_xml(F.regexp_replace(v, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")))
    kind = F.when(c("body").rlike(r"(?i)<sitemapindex\b"), "sitemapindex").when(c("body").rlike(r"(?i)<urlset\b"), "urlset")
    found = F.filter(values, lambda v: v != "")
    if max_locations is not None:
        found = F.slice(found, 1, max_locations)
    keep = [k for k in docs.columns if k != "body"]
    return docs.select(*keep, kind.alias("kind"), F.posexplode_outer(F.when(kind.isNotNull(), found)).alias("at", "loc"))


def _absolute(loc: Column, base: Column) -> Column:
    return F.when(loc.startswith("/"), F.concat(U.origin(base), loc)).otherwise(U.absolute_url(loc))


def sitemap_tree(docs: DataFrame, roots: DataFrame, declared: DataFrame | None = None, max_files: int | None = None,
                 max_urls: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(urls, visited documents) per audit: index files are followed breadth first until no new document turns up.

    ``docs``: audit_id, doc_url, body (fetched documents). ``declared``: audit_id, doc_url, line. One table of visited
    documents grows by a folder a level; a level is one join of the newest folder with the index entries, less all folders.
    ``max_files`` and ``max_urls`` bound an audit's documents and URLs (and a document's locations); no bound by default.
    """
    c = F.col
    spark = docs.sparkSession
    entries = stage(sitemap_locations(docs, max_urls))
    indexed = entries.filter("kind = 'sitemapindex' and loc is not null").select("audit_id", "doc_url", "at", _absolute(c("loc"), c("doc_url")).alias("next"))
    first = roots.select("audit_id", F.concat(U.origin(c("root_url")), F.lit("/sitemap.xml")).alias("doc_url"),
                         F.lit(-1).alias("line"))
    if declared is not None:
        first = first.unionByName(declared.select("audit_id", "doc_url", "line"))
    state = f"{staging_dir(spark).rstrip('/')}/siteloom-{uuid.uuid4().hex}"
    schema = T.StructType([roots.schema["audit_id"], T.StructField("doc_url", T.StringType()), T.StructField("position", T.LongType())])
    visited = spark.createDataFrame([], schema)
    offered = first.groupBy("audit_id", "doc_url").agg(F.min(F.struct(F.lit(0).cast("long").alias("parent"), c("line").alias("at"))).alias("place"))
    for level in count():
        held = visited.groupBy("audit_id").agg(F.max("position").alias("held"))
        # documents of one parent stand side by side in the order, so a parent is a bucket of its audit
        ranked = bucketed_rank(offered, ["audit_id"], c("place.parent"), ["place", "doc_url"], "nth").join(held, "audit_id", "left")
        ranked = ranked.withColumn("position", c("nth") + F.coalesce("held", F.lit(0)))
        if max_files is not None:
            ranked = ranked.filter(c("position") <= max_files)
        ranked.select(schema.names).write.parquet(f"{state}/level={level}")
        newest = spark.read.schema(schema).parquet(f"{state}/level={level}")
        if newest.isEmpty():
            break
        visited = spark.read.schema(schema).parquet(*[f"{state}/level={i}" for i in range(level + 1)])
        nested = newest.join(indexed, ["audit_id", "doc_url"]).select(
            "audit_id", c("next").alias("doc_url"), c("position").alias("parent"), "at").filter("doc_url is not null")
        offered = nested.groupBy("audit_id", "doc_url").agg(F.min(F.struct("parent", "at")).alias("place")).join(
            visited.select("audit_id", "doc_url"), ["audit_id", "doc_url"], "left_anti")
    kinds = entries.groupBy("audit_id", "doc_url").agg(F.max("kind").alias("kind"))
    seen = visited.join(kinds, ["audit_id", "doc_url"], "left")
    listed = (visited.join(entries.filter("kind = 'urlset' and loc is not null"), ["audit_id", "doc_url"])
              .join(roots.select("audit_id", "root_url"), "audit_id")
              .select("audit_id", "position", "root_url", "at", "loc").withColumn("full", _absolute(c("loc"), c("root_url"))))
    crawl = U.canonicalize_urls(listed, "full", "root_url", "url", resolved=True).filter("url is not null")
    distinct = crawl.groupBy("audit_id", "url").agg(F.min(F.struct("position", "at")).alias("place"))
    if max_urls is not None:
        urls = top_per_key(distinct, ["audit_id"], ["place"], max_urls, "position")
    else:
        urls = bucketed_rank(distinct, ["audit_id"], c("place.position"), ["place"], "position")
    return urls.select("audit_id", "url", c("position").cast("int").alias("position")), seen


def query_variant_guard(urls: DataFrame, limit: int = K.MAX_QUERY_VARIANTS) -> DataFrame:
    """Per (audit, path) keep URLs without a query and those with one of the first five distinct query strings.

    ``urls``: audit_id, url, seq (discovery order).
    """
    c = F.col
    staged = urls.withColumns({"__path": U.path_of(c("url")), "__query": F.regexp_extract("url", r"(?s)^[^?#]*\?([^#]+)", 1)})
    keys = ["audit_id", "__path"]
    firsts = staged.filter("__query <> ''").groupBy(*keys, "__query").agg(F.min("seq").alias("first"))
    kept = top_per_key(firsts, keys, ["first"], limit).select(*keys, "__query")
    bare = staged.filter("__query = ''")
    return bare.unionByName(staged.join(kept, [*keys, "__query"], "left_semi").select(*bare.columns)).drop("__path", "__query")

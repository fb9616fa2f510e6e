"""Breadth-first crawl order over landed captures."""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Callable
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siteloom.functions import constants as K
from siteloom.functions import urls as U
from siteloom.operators.skew import bucketed_rank, core_parts, first_per_key, top_per_key
from siteloom.session import stage, staging_dir

#: An audit of at most so many queue starts, captures and links is walked in one task; a larger one takes a round of joins a level.
LOCAL_ROWS = 1 << 19


class Levels:
    """The levels written so far, in few folders: ``width`` folders of one rank are written again as one of the next.

    Reading them is one scan, whatever the depth, and a row is written once a rank.
    """

    def __init__(self, spark: SparkSession, width: int = 8) -> None:
        self.spark, self.width, self.folders, self.schema = spark, width, [], None
        self.base = f"{staging_dir(spark).rstrip('/')}/siteloom-{uuid.uuid4().hex}"

    def read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths)

    def write(self, rows: DataFrame, rank: int) -> DataFrame:
        path = f"{self.base}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        self.folders.append((rank, path))
        return self.read([path])

    def add(self, level: DataFrame) -> DataFrame:
        """Write a level and return it as written."""
        self.schema = level.schema
        written = self.write(level, 0)
        while len(same := [f for f in self.folders if f[0] == self.folders[-1][0]]) == self.width:
            self.folders = self.folders[:-self.width]
            self.write(self.read([path for _, path in same]), same[0][0] + 1)
        return written

    def all(self) -> DataFrame:
        return self.read([path for _, path in self.folders])


def crawl_order(roots: DataFrame, links: DataFrame, captures: DataFrame, max_pages: int = 10, seeds: DataFrame | None = None,
                linked_by: str = "final_url", local_rows: int = LOCAL_ROWS) -> tuple[DataFrame, DataFrame]:
    """(queue entries taken in order, audits stopped with URLs left); ``audited`` marks the first capture of a final URL.

    Every audit advances level by level: links of the pages audited on the last one, in order of page and position, minus
    everything queued before, minus query variants beyond five per path. A capture counts once per final URL; only HTML
    captures use up ``max_pages``. ``links``: audit_id, src (what ``linked_by`` names of a capture), dst (crawl form), position. ``captures``: audit_id, url,
    final_url, is_html, allowed. ``seeds``: audit_id, url, position (sitemap URLs). A root whose capture left the site
    is expected under its new root in ``roots``. Audits of at most ``local_rows`` rows walk all their levels in one task each, side by
    side (``_walk``); larger ones advance together, one round of joins a level (``_rounds``). Both take the same steps.
    """
    c = F.col
    start = roots.select("audit_id", c("root_url").alias("url"), F.lit(-1).cast("long").alias("parent"), F.lit(0).alias("position"))
    if seeds is not None:
        start = start.unionByName(seeds.select("audit_id", "url", F.lit(0).cast("long").alias("parent"), "position"))
    # sites whose URLs carry no query at all skip the variant bookkeeping
    guard = not links.filter(c("dst").contains("?")).isEmpty() or (
        seeds is not None and not seeds.filter(c("url").contains("?")).isEmpty())
    parts = [start, captures, links]
    every = [x.select("audit_id") for x in parts]
    sizes = stage(every[0].unionByName(every[1]).unionByName(every[2]).filter("audit_id is not null").groupBy("audit_id").agg(
        F.count(F.lit(1)).alias("n")))
    small, large = sizes.filter(c("n") <= local_rows), sizes.filter(c("n") > local_rows)
    if large.isEmpty():
        state = stage(_walked(*parts, max_pages, guard, linked_by))
    else:
        state = stage(_walked(*[x.join(small, "audit_id", "left_semi") for x in parts], max_pages, guard, linked_by))
        state = state.unionByName(_rounds(*[stage(x.join(large, "audit_id", "left_semi")) for x in parts], max_pages, guard, linked_by))
    ends = state.groupBy("audit_id").agg(F.max(F.when(c("landed"), c("seq"))).alias("reached"), F.max("seq").alias("offered"),
                                         F.count_if(c("landed") & c("is_html")).alias("done"))
    full = ends.withColumn("full", c("done") >= max_pages)
    walked = state.join(full.select("audit_id", "reached", "full"), "audit_id").filter(~c("full") | (c("seq") <= c("reached")))
    taken = walked.select("audit_id", "url", "final_url", "is_html", "seq", "depth", c("landed").alias("audited"))
    return taken, full.filter(c("full") & (c("offered") > c("reached"))).select("audit_id")


WALK_COLUMNS = ["audit_id", "url", "final_url", "is_html", "seq", "depth", "landed"]


def _query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]+)", 1)


def _walked(start: DataFrame, captures: DataFrame, links: DataFrame, max_pages: int, guard: bool, linked_by: str) -> DataFrame:
    """Queue entries of audits small enough for one task each."""
    c = F.col
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, kind: int, url: Column, to: Column, offered: Column, **values: Column) -> DataFrame:
        query = _query_of(offered) if guard else F.lit("")
        filled = {"flag": F.lit(0), "allowed": F.lit(False), "parent": F.lit(0), "position": F.lit(0)} | values
        return df.filter("audit_id is not null").select(
            "audit_id", F.lit(kind).alias("kind"), url.alias("url"), to.alias("to"), query.alias("query"),
            F.when(query != "", U.path_of(offered)).alias("path"), filled["flag"].cast("int").alias("flag"),
            filled["allowed"].alias("allowed"), filled["parent"].cast("long").alias("parent"),
            # nulls come first, as in an order of structs
            F.coalesce(filled["position"].cast("long"), F.lit(-(1 << 63))).alias("position"))
    begun = rows(start, 0, c("url"), none, c("url"), parent=c("parent"), position=c("position"))
    landed = rows(captures.filter("url is not null"), 1, c("url"), c("final_url"), none, flag=F.coalesce(c("is_html").cast("int"), F.lit(-1)),
                  allowed=F.coalesce("allowed", F.lit(False)))
    linked = rows(links.filter("src is not null and dst is not null"), 2, c("src"), c("dst"), c("dst"), position=c("position"))
    # few audits may be much work, so the partitions are not left to be merged by their bytes
    kind = start.schema["audit_id"].dataType.simpleString()
    walked = begun.unionByName(landed).unionByName(linked).repartition(core_parts(start), "audit_id").groupBy("audit_id").applyInPandas(
        _walk(max_pages, guard, linked_by, K.MAX_QUERY_VARIANTS),
        f"audit_id {kind}, url string, final_url string, flag int, seq long, depth int, landed boolean")
    return walked.withColumn("is_html", F.when(c("flag") >= 0, c("flag") == 1)).select(*WALK_COLUMNS)


def _walk(max_pages: int, guard: bool, linked_by: str, most: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """The levels of one audit, step by step as in ``_enqueue`` and ``_audit_level``; rows of kind 0 begin the queue, 1 are captures, 2 links."""
    def walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        landings, out_links, variant, offered = defaultdict(list), defaultdict(list), {}, {}
        fields = ("kind", "url", "to", "query", "path", "flag", "allowed", "parent", "position")
        for kind, url, to, query, path, flag, allowed, parent, position in zip(*(pdf[x].tolist() for x in fields)):
            if kind == 1:
                landings[url].append((to, flag, allowed))
                continue
            if kind == 2:
                out_links[url].append((position, to))
                url = to
            elif url not in offered or (parent, position) < offered[url]:
                offered[url] = (parent, position)
            if query:
                variant[url] = (path, query)
        seen, finals, known, rows, done, base = set(), set(), defaultdict(set), [], 0, 0
        for depth in count():
            fresh = [(at, url) for url, at in offered.items() if url is None or url not in seen]
            if guard:
                fresh = within_limit([x for x in fresh if x[1] is not None], variant, known)
            if depth and not fresh:
                break
            fresh.sort(key=lambda x: (x[0], x[1] is not None, x[1] or ""))
            queued = [(base + i, url, *landing) for i, (_, url) in enumerate(fresh, 1) for landing in landings.get(url) or [(None, -1, False)]]
            base += len(fresh)
            firsts = {}
            for seq, _, final, flag, allowed in queued:
                if allowed and (not depth or (done < max_pages and (final is None or final not in finals))):
                    firsts[final] = min(firsts.get(final, (seq, flag)), (seq, flag))
            pages = sorted(seq for seq, flag in firsts.values() if flag == 1)
            room = max_pages - done
            last = pages[room - 1] if 1 <= room <= len(pages) else None
            kept = Counter(seq for seq, _ in firsts.values() if last is None or seq <= last)
            offered = {}
            for seq, url, final, flag, _ in queued:
                landed = kept[seq] > 0
                rows += [(key[0], url, final, flag, seq, depth, landed)] * max(1, kept[seq])
                if not landed:
                    continue
                finals.add(final)
                if flag == 1:
                    done += kept[seq]
                    for position, to in out_links.get(url if linked_by == "url" else final, ()):
                        if to not in offered or (seq, position) < offered[to]:
                            offered[to] = (seq, position)
            for _, url in fresh:
                seen.add(url)
                if url in variant:
                    known[variant[url][0]].add(variant[url][1])
        return pd.DataFrame(rows, columns=["audit_id", "url", "final_url", "flag", "seq", "depth", "landed"])

    def within_limit(fresh: list, variant: dict, known: dict) -> list:
        """Entries without a query, or with one of the first distinct queries of their path over all levels."""
        novel = {}
        for at, url in fresh:
            if url in variant and variant[url][1] not in known[variant[url][0]]:
                novel[variant[url]] = min(novel.get(variant[url], at), at)
        taken = {path: set(queries) for path, queries in known.items()}
        for path, query in sorted(novel, key=lambda v: (novel[v], v)):
            if len(taken.setdefault(path, set())) < most:
                taken[path].add(query)
        return [(at, url) for at, url in fresh if url not in variant or variant[url][1] in taken.get(variant[url][0], ())]
    return walk


def _rounds(start: DataFrame, captures: DataFrame, links: DataFrame, max_pages: int, guard: bool, linked_by: str) -> DataFrame:
    """Queue entries of audits of any size, one round of joins a level."""
    c = F.col
    offered = start.groupBy("audit_id", "url").agg(F.min(F.struct("parent", "position")).alias("at"))
    state, levels = None, Levels(start.sparkSession)
    for depth in count():
        queued = stage(_enqueue(offered, state, guard).join(captures, ["audit_id", "url"], "left"))
        if state is not None and queued.isEmpty():
            break
        level = levels.add(_audit_level(queued, state, max_pages).withColumn("depth", F.lit(depth)))
        state = levels.all()
        offered = (level.filter(c("landed") & c("is_html")).select("audit_id", c(linked_by).alias("src"), c("seq").alias("parent"))
                   .join(links, ["audit_id", "src"]).filter("dst is not null")
                   .groupBy("audit_id", c("dst").alias("url")).agg(F.min(F.struct("parent", "position")).alias("at")))
    return state.select(*WALK_COLUMNS)


def _enqueue(offered: DataFrame, state: DataFrame | None, guard: bool) -> DataFrame:
    """New queue entries of a level with their place in the queue; five query variants per path over all levels."""
    c = F.col
    fresh = offered.withColumns({"path": U.path_of(c("url")), "query": _query_of(c("url"))})
    if state is not None:
        fresh = fresh.join(state.select("audit_id", "url"), ["audit_id", "url"], "left_anti")
    kept = _within_variant_limit(fresh, state) if guard else fresh
    # counted in blocks of parents, so that a large site is not one task
    placed = bucketed_rank(kept, ["audit_id"], F.floor(c("at.parent") / 256), ["at", "url"], "nth").withColumn("base", F.lit(0))
    if state is not None:
        ends = state.groupBy("audit_id").agg(F.max("seq").alias("base"))
        placed = placed.drop("base").join(ends, "audit_id", "left")
    return placed.withColumn("seq", (F.coalesce("base", F.lit(0)) + c("nth")).cast("long")).select(
        "audit_id", "url", "path", "query", "seq")


def _within_variant_limit(fresh: DataFrame, state: DataFrame | None) -> DataFrame:
    """Entries without a query, or with one of the first five distinct queries of their path over all levels."""
    c = F.col
    variants = fresh.filter("query <> ''").groupBy("audit_id", "path", "query").agg(F.min("at").alias("first"))
    room = c("nth") <= K.MAX_QUERY_VARIANTS
    if state is not None:
        known = state.filter("query <> ''").select("audit_id", "path", "query").distinct()
        variants = variants.join(known, ["audit_id", "path", "query"], "left_anti")
    ranked = top_per_key(variants, ["audit_id", "path"], ["first"], K.MAX_QUERY_VARIANTS, "nth")
    if state is not None:
        held = known.groupBy("audit_id", "path").agg(F.count("*").alias("held"))
        ranked = ranked.join(held, ["audit_id", "path"], "left")
        room = c("nth") + F.coalesce("held", F.lit(0)) <= K.MAX_QUERY_VARIANTS
    allowed = ranked.filter(room).select("audit_id", "path", "query")
    if state is not None:
        allowed = allowed.unionByName(known)
    return fresh.filter("query = ''").unionByName(
        fresh.filter("query <> ''").join(allowed, ["audit_id", "path", "query"], "left_semi").select(*fresh.columns))


def _audit_level(queued: DataFrame, state: DataFrame | None, max_pages: int) -> DataFrame:
    """Mark the entries that are audited: first capture of a final URL, allowed, within the page limit."""
    c = F.col
    open_rows = queued.filter("allowed").select("audit_id", "final_url", "seq", "is_html")
    if state is not None:
        done = state.groupBy("audit_id").agg(F.count_if(c("landed") & c("is_html")).alias("done"))
        landed = state.filter("landed").select("audit_id", "final_url")
        open_rows = (open_rows.join(done, "audit_id", "left").filter(F.coalesce("done", F.lit(0)) < max_pages)
                     .join(landed, ["audit_id", "final_url"], "left_anti"))
    else:
        open_rows = open_rows.withColumn("done", F.lit(0))
    firsts = open_rows.groupBy("audit_id", "final_url").agg(F.min(F.struct("seq", "is_html", "done")).alias("f")).select(
        "audit_id", "final_url", "f.*")
    # an audit may want any number of pages, so its queue is cut in blocks
    pages = first_per_key(firsts.filter("is_html"), ["audit_id"], F.floor(c("seq") / 4096), ["seq"], max_pages, "nth")
    last = pages.filter(c("nth") + F.coalesce("done", F.lit(0)) == max_pages).select("audit_id", c("seq").alias("last"))
    kept = firsts.join(last, "audit_id", "left").filter(c("last").isNull() | (c("seq") <= c("last"))).select(
        "audit_id", "seq", F.lit(True).alias("landed"))
    return queued.join(kept, ["audit_id", "seq"], "left").withColumn("landed", F.coalesce("landed", F.lit(False)))

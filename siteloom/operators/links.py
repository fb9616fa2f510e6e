"""Internal-link suggestions from shared topic tokens."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from siteloom.functions import constants as K
from siteloom.functions import text as X
from siteloom.functions import urls as U
from siteloom.operators.skew import bucketed_rank, core_parts, spread, top_per_key
from siteloom.session import stage

PAIR = ["audit_id", "target_id"]
MIN_SCORE = 28
#: Stands for a missing page number.
NO_SEQ = -(1 << 63)


def indexable(pages: DataFrame) -> DataFrame:
    """Successful pages without noindex anywhere in their robots value."""
    return pages.filter(F.col("status").between(200, 299)
                        & ~F.coalesce(F.col("robots"), F.lit("")).rlike("(?i)noindex"))


def topic_text(compat: bool = True) -> Column:
    joined = F.concat_ws(" ", "title", F.array_join("h1s", " "), U.decoded_path(F.col("url")))
    return X.nfkc(joined) if compat else joined


def page_profile(pages: DataFrame, compat: bool = True) -> DataFrame:
    """What link scoring needs of an indexable page, each computed once: tokens, normal URL, parent, anchor, bonuses.

    Needs audit_id, seq, url, status, robots, title, h1s (array), word_count, n_links, incoming_links.
    """
    c = F.col
    live = indexable(pages).withColumn("topic", topic_text(compat))
    return live.select(
        "audit_id", "seq", "url", U.normalize_link_url(c("url")).alias("norm"), "word_count", "incoming_links",
        F.array_distinct(X.tokenize(c("topic"))).alias("tokens"), U.path_parent(c("url")).alias("parent"),
        U.anchor_text(F.try_element_at("h1s", F.lit(1)), c("title"), c("url")).alias("anchor"),
        (F.when(c("word_count") >= 150, 8).otherwise(0) + F.when(c("n_links") < 20, 5).otherwise(0)).alias("bonus"))


def link_score(shared: Column, target_tokens: Column, same_parent: Column, bonus: Column) -> Column:
    """72 points for covering the target's tokens, 12 for the same section, plus the source's bonus; at most 100."""
    return F.when(shared == 0, 0).otherwise(F.least(F.lit(100), X.js_round(shared / target_tokens * 72) + F.when(
        same_parent, 12).otherwise(0) + bonus)).cast("int")


def confidence(score: Column, high: int = 70, medium: int = 45) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def _targets(profile: DataFrame, roots: DataFrame) -> DataFrame:
    homes = roots.select("audit_id", U.normalize_link_url(F.col("root_url")).alias("home"))
    return profile.join(homes, "audit_id").filter((F.col("norm") != F.col("home"))).drop("home")


def link_candidates(profile: DataFrame, roots: DataFrame, existing: DataFrame, hot_df: int = 512, block: int = 1 << 15) -> DataFrame:
    """The best two or three sources of every weak target (fewer than three incoming links), exactly.

    An audit's pages are cut by hash into blocks of about ``block`` sources and an eighth as many targets. Each block of targets meets
    each block of sources in one task (``_best_sources``), which counts shared tokens as arrays and returns three sources a
    target; the best of all blocks stay. So no pair of pages is ever a row, and a task holds two blocks, however large an audit
    or common a token. ``existing``: audit_id, src_norm, dst_norm.
    """
    c = F.col
    # pages without a number count as one page, as in a group of nulls
    live = profile.filter("audit_id is not null and norm is not null").withColumns(
        {"seq": F.coalesce(c("seq").cast("long"), F.lit(NO_SEQ)), "n": F.size("tokens"), "words": F.array_join("tokens", " ")}).filter("n > 0")
    weak = _targets(live, roots).filter("incoming_links < 3")

    def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy("audit_id").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    cut = stage(blocks(live, block, "js").join(blocks(weak, max(1, block // 8), "is"), "audit_id"))
    sources = live.join(cut, "audit_id").withColumn("j", F.pmod(F.xxhash64("seq"), c("js")).cast("int"))
    targets = weak.join(cut, "audit_id").withColumn("i", F.pmod(F.xxhash64("seq", F.lit(7)), c("is")).cast("int"))
    closed = (existing.select("audit_id", c("src_norm").alias("url"), c("dst_norm").alias("norm")).distinct()
              .join(targets.select("audit_id", "norm", "i").distinct(), ["audit_id", "norm"])
              .join(sources.select("audit_id", c("norm").alias("url"), "j").distinct(), ["audit_id", "url"]))

    def rows(df: DataFrame, kind: int) -> DataFrame:
        held = {"seq": F.lit(0).cast("long"), "words": F.lit(""), "n": F.lit(0), "parent": F.lit(""), "bonus": F.lit(0), "incoming_links": F.lit(0)}
        return df.select("audit_id", c("i").cast("int").alias("i"), c("j").cast("int").alias("j"), F.lit(kind).alias("kind"), "url", "norm",
                         *[(c(x) if kind < 2 else v).alias(x) for x, v in held.items()])
    every = rows(targets.withColumn("j", F.explode(F.sequence(F.lit(0), c("js") - 1))), 0).unionByName(
        rows(sources.withColumn("i", F.explode(F.sequence(F.lit(0), c("is") - 1))), 1)).unionByName(rows(closed, 2))
    kind = profile.schema["audit_id"].dataType.simpleString()
    # few bytes may be much work, so the partitions are not left to be merged
    near = every.repartition(core_parts(profile), "audit_id", "i", "j").groupBy("audit_id", "i", "j").applyInPandas(
        _best_sources(hot_df), f"audit_id {kind}, target_id long, source_id long, source_url string, score int, incoming_links int")
    ranked = top_per_key(near, PAIR, [F.desc("score"), "source_url", "source_id"], 3, "rank")
    number = profile.schema["seq"].dataType
    return ranked.filter((c("rank") <= 2) | (c("incoming_links") == 0)).select(
        "audit_id", *[F.nullif(c(x), F.lit(NO_SEQ)).cast(number).alias(x) for x in ("target_id", "source_id")], "source_url", "score", "rank")


def _best_sources(hot_df: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """One block of weak targets against one block of sources: the best three sources of each target.

    Rows of kind 0 are targets, 1 sources, 2 pairs of normal URLs that are linked already (url to norm). A token's pages are a list, those
    of a token on more than ``hot_df`` of them (and a sixteenth of the block) an array of counts that is added whole. Scores as in ``link_score``.
    """
    def best(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        kind, out = pdf["kind"].to_numpy(), []
        targets, sources, closed = pdf[kind == 0], pdf[kind == 1], pdf[kind == 2]
        if len(targets) and len(sources):
            sources = sources.sort_values(["url", "seq"], ignore_index=True)
            page, seqs = pd.factorize(sources["seq"])
            firsts = sources.drop_duplicates("seq")
            urls, parents, bonus = firsts["url"].to_numpy(), firsts["parent"].to_numpy(), firsts["bonus"].to_numpy(np.int32)
            size = len(seqs)
            token, names = pd.factorize(np.array(" ".join(sources["words"]).split(" "), dtype=object))
            order = np.argsort(token, kind="stable")
            holders = np.repeat(page, sources["n"].to_numpy())[order]
            ends = np.searchsorted(token[order], np.arange(len(names) + 1))
            number = {name: i for i, name in enumerate(names)}
            pages = [holders[ends[i]:ends[i + 1]] for i in range(len(names))]
            hot = {i: np.bincount(p, minlength=size).astype(np.int32) for i, p in enumerate(pages) if len(p) > max(hot_df, size // 16)}
            places = {norm: page[at] for norm, at in sources.groupby("norm", sort=False).indices.items()}
            barred = {norm: [places[norm]] if norm in places else [] for norm in set(targets["norm"])}
            for src, norm in zip(closed["url"], closed["norm"]):
                barred[norm].append(places[src])
            barred = {norm: np.concatenate(at) for norm, at in barred.items() if at}
            wanted = {}
            for seq, norm, words, n, parent, links in zip(*(targets[x] for x in ("seq", "norm", "words", "n", "parent", "incoming_links"))):
                wanted.setdefault(seq, (parent, norm, n, links, []))[4].extend(words.split(" "))
            section, offered = None, bonus
            for seq, (parent, norm, n, links, words) in sorted(wanted.items(), key=lambda w: w[1][0]):
                met = [number[w] for w in words if w in number]
                if not met:
                    continue
                if parent != section:
                    section, offered = parent, bonus + np.int32(12) * (parents == parent) if parent else bonus
                rare = [pages[i] for i in met if i not in hot]
                shared = np.bincount(np.concatenate(rare), minlength=size) if rare else np.zeros(size, np.int64)
                for i in met:
                    if i in hot:
                        shared += hot[i]
                worth = np.floor(np.arange(shared.max() + 1) / n * 72 + 0.5).astype(np.int32)
                worth[0] = -1000
                score = np.minimum(worth[shared] + offered, 100)
                if norm in barred:
                    score[barred[norm]] = -1
                for _ in range(3):  # the first of the highest scores is that of the first URL
                    at = score.argmax()
                    if score[at] < MIN_SCORE:
                        break
                    out.append((key[0], seq, seqs[at], urls[at], score[at], links))
                    score[at] = -1
        return pd.DataFrame(out, columns=["audit_id", "target_id", "source_id", "source_url", "score", "incoming_links"])
    return best


def internal_links(pages: DataFrame, roots: DataFrame, links: DataFrame, compat: bool = True, hot_df: int = 512,
                   budget: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(suggestions, skipped targets) of every audit.

    Targets are walked from least to most linked, longer pages first, until ``budget`` suggestions are out (never, if
    it is None); targets reached before that without any candidate are the skipped ones. ``links``: audit_id, src, dst.
    """
    c = F.col
    profile = stage(page_profile(spread(pages, "audit_id", "seq"), compat))
    existing = stage(links.select("audit_id", U.normalize_link_url(c("src")).alias("src_norm"),
                            U.normalize_link_url(c("dst")).alias("dst_norm")).distinct())
    roots = stage(roots.select("audit_id", "root_url"))
    found = stage(link_candidates(profile, roots, existing, hot_df))
    walk = F.struct("incoming_links", (-c("word_count")).alias("w"), c("seq").alias("s"))
    targets = _targets(profile, roots).filter("incoming_links < 3").select(
        "audit_id", c("seq").alias("target_id"), c("url").alias("target_url"), "anchor", c("tokens").alias("target_tokens"),
        c("parent").alias("target_parent"), walk.alias("at"))
    walked = found.join(targets, PAIR)
    # Positions are counted in blocks of equally weak targets, so that a large audit is not one task.
    placed = bucketed_rank(walked, ["audit_id"], F.struct("at.incoming_links", "at.w"), ["at", "rank"], "position")
    kept = stage(placed if budget is None else placed.filter(c("position") <= budget))
    cut = kept.filter(c("position") == (0 if budget is None else budget)).select("audit_id", c("at").alias("last"))
    idle = targets.join(found.select(*PAIR).distinct(), PAIR, "left_anti").join(cut, "audit_id", "left")
    skipped = idle.filter(c("last").isNull() | (c("at") < c("last"))).select("audit_id", "target_url")
    sources = profile.select("audit_id", c("seq").alias("source_id"), c("tokens").alias("source_tokens"),
                             c("parent").alias("source_parent"), c("word_count").alias("source_words"))
    full = kept.join(sources, ["audit_id", "source_id"])
    terms = F.array_join(F.slice(F.array_intersect("target_tokens", "source_tokens"), 1, 5), ", ")
    reasons = F.filter(F.array(
        F.concat(F.lit("Shared topic terms: "), terms),
        F.when((c("target_parent") != "") & (c("target_parent") == c("source_parent")),
               "Pages are in the same top-level section."),
        F.when(c("source_words") >= 150, "Source page has enough context for a natural in-content link.")),
        lambda r: r.isNotNull())
    suggestions = full.select(
        "audit_id", "source_id", "target_id", "source_url", "target_url", c("anchor").alias("anchor_text"), "score",
        confidence(c("score")).alias("confidence"), reasons.alias("reasons"), F.lit("proposed").alias("status"), "position",
        X.stable_id(c("audit_id"), c("source_url"), c("target_url")).alias("id"))
    return suggestions, skipped


def link_page_report(pages: DataFrame, roots: DataFrame) -> DataFrame:
    """Orphan and underlinked pages, one row each."""
    live = indexable(pages).withColumn("norm", U.normalize_link_url(F.col("url")))
    weak = _targets(live, roots).filter("incoming_links <= 1")
    return weak.select("audit_id", "url", (F.col("incoming_links") == 0).alias("orphan"), F.lit(True).alias("underlinked"))


def link_analysis_summary(pages: DataFrame, roots: DataFrame, suggestions: DataFrame, skipped: DataFrame) -> DataFrame:
    """Counts per audit: distinct indexable pages, orphans, underlinked pages, suggestions, skipped targets."""
    live = indexable(pages).withColumn("norm", U.normalize_link_url(F.col("url")))
    sizes = live.groupBy("audit_id", "norm").agg(F.count("*").alias("n")).groupBy("audit_id").agg(
        F.count("*").alias("page_count"))
    weak = link_page_report(pages, roots).groupBy("audit_id").agg(
        F.count_if("orphan").alias("orphan_count"), F.count("*").alias("underlinked_count"))
    made = suggestions.groupBy("audit_id").agg(F.count("*").alias("suggestion_count"))
    idle = skipped.groupBy("audit_id").agg(F.count("*").alias("skipped_count"))
    out = roots.select("audit_id").join(sizes, "audit_id", "left")
    for part in (weak, made, idle):
        out = out.join(part, "audit_id", "left")
    return out.na.fill(0)

"""Keyword clusters without a size limit: leaders found in rounds of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siteloom.functions import constants as K
from siteloom.functions import text as X
from siteloom.operators.similarity import prefix_entries
from siteloom.session import stage

KEY = ["analysis_id", "token", "lo", "hi"]


def _score(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def _entries(items: DataFrame) -> DataFrame:
    """Lists in which neighbours meet: similarity prefixes, and whole texts with the texts whose words contain them.

    Roles tell the two sides of a list apart: only different roles can be neighbours, except in lists of equal sizes.
    """
    c = F.col
    near = prefix_entries(items, ["analysis_id"], "normalized", "tokens", K.JOIN_SCORE, ["at"])
    near = near.select(*KEY, c("id").alias("normalized"), "at", "set", F.when(c("lo") == c("hi"), 0).when(
        c("n") == c("lo"), 1).otherwise(2).alias("role"))
    words = F.split("normalized", " ")
    base = items.select("analysis_id", "normalized", "at", F.array_distinct("tokens").alias("set"), words.alias("w")).filter(
        F.size("set") > 0)
    runs = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.transform(
        F.sequence(F.lit(1), F.size("w") - i + 1), lambda n: F.array_join(F.slice("w", i, n), " ")))))
    inner = base.select("analysis_id", F.explode(F.filter(runs, lambda r: r != c("normalized"))).alias("token"), F.lit(0).alias("lo"),
                        F.lit(0).alias("hi"), "normalized", "at", "set", F.lit(2).alias("role"))
    whole = base.select("analysis_id", c("normalized").alias("token"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), "normalized", "at",
                        "set", F.lit(1).alias("role"))
    used = inner.select("analysis_id", "token").distinct()
    found = inner.join(base.select("analysis_id", c("normalized").alias("token")), ["analysis_id", "token"], "left_semi")
    return near.unionByName(found).unionByName(whole.join(used, ["analysis_id", "token"], "left_semi"))


def _meet(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """Neighbours (first, second) in analysis order that meet in a list, with their score."""
    c = F.col
    a = earlier.select(*KEY, c("normalized").alias("first"), c("at").alias("first_at"), c("set").alias("set_a"), c("role").alias("ra"))
    b = later.select(*KEY, c("normalized").alias("second"), c("at").alias("second_at"), c("set").alias("set_b"), c("role").alias("rb"))
    met = a.join(b, KEY).filter((c("first_at") < c("second_at")) & ((c("ra") != c("rb")) | (c("ra") == 0)))
    scored = met.withColumn("score", _score(c("set_a"), c("set_b")))
    keep = (c("score") >= K.JOIN_SCORE) | ((c("lo") == 0) & (c("score") >= K.CONTAINMENT_SCORE))
    return (scored.filter(keep).groupBy("analysis_id", "first", "second")
                  .agg(F.max("score").alias("score"), F.first("first_at").alias("first_at")))


def _pair_load(entries: DataFrame) -> tuple[int, int]:
    """Candidate pairs a full join of the lists would form, and the number of list entries (two numbers)."""
    c = F.col
    per_list = entries.groupBy(*KEY).agg(F.count("*").alias("n"), F.count_if(c("role") == 1).alias("s"),
                                         F.count_if(c("role") == 2).alias("l"))
    load = F.when(c("s") + c("l") == 0, c("n").cast("double") * c("n") / 2).otherwise(c("s").cast("double") * c("l"))
    row = per_list.agg(F.coalesce(F.sum(load), F.lit(0.0)).alias("pairs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    return row["pairs"], row["n"]


def _head_round(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new leaders, texts they cover): leaders are first among their possible partners in every list they are in."""
    c = F.col
    firsts = entries.groupBy(*KEY).agg(*[F.min(F.when(c("role") == r, c("at"))).alias(f"f{r}") for r in (0, 1, 2)])
    rival = F.when(c("role") == 0, c("f0")).when(c("role") == 1, c("f2")).otherwise(c("f1"))
    safe = (entries.join(firsts, KEY).withColumn("blocked", F.coalesce(rival < c("at"), F.lit(False)))
            .groupBy("analysis_id", "normalized").agg(F.bool_or("blocked").alias("blocked")))
    heads = stage(safe.filter("not blocked").select("analysis_id", "normalized"))
    led = entries.join(heads, ["analysis_id", "normalized"], "left_semi")
    covered = stage(_meet(led, entries).select("analysis_id", F.col("second").alias("normalized")).distinct())
    return heads, covered


def _edge_rounds(items: DataFrame, edges: DataFrame) -> DataFrame:
    """Leaders of an explicit neighbour graph: first in order among undecided neighbours, round by round."""
    c, keys = F.col, ["analysis_id", "normalized"]
    left, open_edges, leaders = items.select(*keys), edges.select("analysis_id", "first", "second"), None
    while True:
        waiting = open_edges.select("analysis_id", c("second").alias("normalized")).distinct()
        fresh = stage(left.join(waiting, keys, "left_anti"))
        leaders = fresh if leaders is None else leaders.unionByName(fresh)
        if open_edges.isEmpty():
            return leaders
        hit = open_edges.join(fresh.withColumnRenamed("normalized", "first"), ["analysis_id", "first"], "left_semi")
        covered = hit.select("analysis_id", c("second").alias("normalized")).distinct()
        left = stage(left.join(covered, keys, "left_anti").join(fresh, keys, "left_anti"))
        names = left.select(*keys)
        open_edges = stage(open_edges.join(names.withColumnRenamed("normalized", "first"), ["analysis_id", "first"], "left_semi")
                           .join(names.withColumnRenamed("normalized", "second"), ["analysis_id", "second"], "left_semi"))


def keyword_clusters(items: DataFrame, pairs_per_entry: int = 64) -> DataFrame:
    """Clusters of every analysis, whatever its size.

    In analysis order a keyword leads a cluster unless an earlier leader is its neighbour (Jaccard >= 0.34, or >= 0.2 and
    one text holds the other as whole words); every other keyword joins its best-scoring earlier leader, ties to the
    earliest. While the meeting lists would form too many pairs - groups of near copies - only the first keyword of each
    list is compared with the list, which removes such groups at once; what remains is joined in full.
    """
    c, keys = F.col, ["analysis_id", "normalized"]
    order = F.struct((-c("n_tokens")).alias("t"), "keyword")
    ranked = stage(items.withColumn("at", order))
    entries = all_entries = stage(_entries(ranked))
    alone = ranked.select(*keys).join(entries.select(*keys).distinct(), keys, "left_anti")
    leaders, undecided = alone, ranked.select(*keys).join(alone, keys, "left_anti")
    while True:
        pairs, n = _pair_load(entries)
        if pairs <= max(1_000_000, pairs_per_entry * n):
            leaders = leaders.unionByName(_edge_rounds(undecided, stage(_meet(entries, entries))))
            break
        heads, covered = _head_round(entries)
        leaders = leaders.unionByName(heads)
        undecided = undecided.join(heads, keys, "left_anti").join(covered, keys, "left_anti")
        entries = stage(entries.join(undecided, keys, "left_semi"))
    leaders = stage(leaders)
    followers = all_entries.join(leaders, keys, "left_anti")
    offers = _meet(all_entries.join(leaders, keys, "left_semi"), followers)
    joined = offers.groupBy("analysis_id", c("second").alias("normalized")).agg(
        F.min_by("first", F.struct((-c("score")).alias("s"), "first_at")).alias("leader"))
    own = leaders.withColumn("leader", c("normalized"))
    return ranked.drop("at").join(own.unionByName(joined), keys).withColumn(
        "cluster_id", F.concat(F.lit("cluster-"), F.substring(X.stable_id(c("analysis_id"), c("leader")), 1, 16)))

"""Exact set-similarity self-joins that never pair up everything behind a common token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siteloom.session import stage


def _needed(n: Column, m: Column, t: float) -> Column:
    """Tokens two sets of sizes n and m must share to reach Jaccard t."""
    return F.greatest(F.lit(1), F.ceil((n + m) * (t / (1 + t)) - 1e-9)).cast("int")


def prefix_entries(items: DataFrame, keys: list[str], ident: str, tokens: str, threshold: float, carry: list[str]) -> DataFrame:
    """Where a token set looks for partners of Jaccard >= threshold: one row per (token, pair of sizes).

    Tokens are ordered rarest first, and a set only looks for partners of size m through its first
    n - needed(n, m) + 1 tokens, because partners must meet there. A frequent token therefore matters only to sets too
    small to do without it. The key holds both sizes, which also splits the lists of hot tokens.
    """
    c = F.col
    sets = items.select(*keys, c(ident).alias("id"), *carry, F.array_distinct(tokens).alias("set")).filter(F.size("set") > 0)
    words = sets.select(*keys, F.explode("set").alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("df"))
    sized = (sets.select(*keys, "id", *carry, F.explode("set").alias("token")).join(words, [*keys, "token"])
             .groupBy(*keys, "id", *carry).agg(F.array_sort(F.collect_list(F.struct("df", "token")))["token"].alias("set"))
             .withColumn("n", F.size("set")))
    present = sized.groupBy(*keys).agg(F.collect_set("n").alias("sizes"))
    wide = sized.join(present, keys).withColumn("m", F.explode(F.filter(
        "sizes", lambda m: (m >= c("n") * threshold - 1e-9) & (m * threshold - 1e-9 <= c("n")))))
    prefix = c("n") - _needed(c("n"), c("m"), threshold) + 1
    return wide.filter(prefix > 0).select(
        *keys, "id", *carry, "set", "n", F.least("n", "m").alias("lo"), F.greatest("n", "m").alias("hi"),
        F.explode(F.slice("set", F.lit(1), prefix)).alias("token"))


def dealt_entries(entries: DataFrame, keys: list[str], block: int) -> tuple[DataFrame, DataFrame]:
    """The two sides of every list, cut into blocks of about ``block`` sets: each pair of blocks (i, j) is a group of its own.

    The side of the smaller size carries its block in ``i`` and goes to every ``j``, the other side the other way round; a
    list of one size meets itself, in the triangle j >= i only. Lists are counted map-side, and the long ones are met by a
    salted join, so that a token of nearly all sets is many groups at every step.
    """
    c = F.col
    on = [*keys, "token", "lo", "hi"]
    salts = 16
    sized = entries.withColumns({"small": c("n") == c("lo"), "salt": F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")})
    # at most one list in ``block`` entries is longer than a block; Spark knows the size of what is staged
    long = stage(sized.groupBy(*on).agg(F.count_if("small").alias("ns"), F.count_if(c("n") == c("hi")).alias("nl")).filter(c("ns") + c("nl") > block))
    cut = long.select(*on, F.ceil(c("ns") / block).cast("int").alias("ps"), F.ceil(c("nl") / block).cast("int").alias("pl"),
                      F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")).filter("ps > 0 and pl > 0")
    met = sized.join(cut, [*on, "salt"], "left").withColumns({k: F.coalesce(k, F.lit(1)) for k in ("ps", "pl")})
    at = lambda parts: F.pmod(F.xxhash64("id", F.lit(3)), c(parts)).cast("int")
    first = met.filter("small").withColumn("i", at("ps")).withColumn("j", F.explode(F.sequence(
        F.when(c("lo") == c("hi"), c("i")).otherwise(0), c("pl") - 1)))
    second = met.filter(c("n") == c("hi")).withColumn("j", at("pl")).withColumn("i", F.explode(F.sequence(
        F.lit(0), F.when(c("lo") == c("hi"), c("j")).otherwise(c("ps") - 1))))
    return first, second


def similar_pairs(items: DataFrame, keys: list[str], ident: str, tokens: str, threshold: float, block: int = 2048) -> DataFrame:
    """Pairs (left < right) within ``keys`` whose token sets have Jaccard >= threshold, by prefix join over blocks of the lists.

    A pair is compared where it first meets: the tokens left after that place bound what it can share, which spares most
    comparisons, and a pair that has met under a rarer token is dropped there, so no pair comes out twice.
    """
    c = F.col
    entries = stage(prefix_entries(items, keys, ident, tokens, threshold, []))
    first, second = dealt_entries(entries, keys, block)
    on = [*keys, "token", "lo", "hi", "i", "j"]
    place = (F.array_position("set", c("token"))).cast("int")
    small = first.select(*on, c("id").alias("a"), c("set").alias("set_a"), place.alias("pa"))
    large = second.select(*on, c("id").alias("b"), c("set").alias("set_b"), place.alias("pb"))
    needed = _needed(c("lo"), c("hi"), threshold)
    met = small.join(large, on).filter(((c("lo") < c("hi")) | (c("i") < c("j")) | (c("a") < c("b")))
                                       & (1 + F.least(c("lo") - c("pa"), c("hi") - c("pb")) >= needed))
    both = met.withColumn("both", F.array_intersect("set_a", "set_b")).filter(F.get("both", F.lit(0)) == c("token"))
    shared = F.size("both")
    return both.filter(shared / (c("lo") + c("hi") - shared) >= threshold - 1e-12).select(
        *keys, F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right"), (shared / (c("lo") + c("hi") - shared)).alias("jaccard"))

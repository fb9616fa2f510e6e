"""How filters act on each other: for every order in which they could run, what each one removes, and its Shapley share.

A document's failures are a set of filters, so per part the whole corpus comes down to a count for each (failed set, labels): at
most ``2 ** filters`` rows a part and label pair. The states of a run are the subsets of filters already applied; an edge
adds one filter to a subset and removes what fails it and nothing before. ``lattice`` counts, forwards and backwards, the orders
that reach and leave every subset: an edge lies on reached(S) * left(S + f) orders, its weight in the Shapley sum. ``per_order``
reads every step of every order from the same edges, so no order is ever applied to the rows themselves.

Filters over a whole text (words: runs of characters other than space and 9 to 13, case kept):
A under 200 words; B fewer distinct words than half of the words; C more than 2 in 100 code points in A-Z; D holds one of
``#$%&*|``; E equals the text of a smaller key anywhere in the table, removed or not.

Defined cases: a null text is empty (fails A; B and C compare 0 with 0 and pass); a null part is the empty string; a null key
has no smaller one, so it never fails E, but is no reason for others to fail either; rows with one key and text are not each
other's copies; repeated rows each count; a key with several label rows carries a label if any row has it; an empty table gives no
rows. Equal texts are told by SHA-256.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, functions as F

FILTERS = "ABCDE"
SPACE = "[ \\t\\n\\x0B\\f\\r]"


def failures(text: Column) -> list[Column]:
    """The conditions of A to D over a text that isn't null."""
    words = F.array_remove(F.split(text, f"{SPACE}+"), "")
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [F.size(words) < 200, 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
            100 * capitals > 2 * F.char_length(text), text.rlike("[#$%&*|]")]


def masked(docs: DataFrame, labels: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """(part, mask, good, toxic, n): documents by the set of filters they fail, as bits in the order of ``FILTERS``.

    One pass over the texts; after it a row is a key, a digest, a part and a few bits. A copy is found by sums only: each
    (digest, part, labels) group keeps its least key and the rows at that key, so a text held by any share of the table is one
    row a part before its digest is ever gathered.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    held = docs.select(F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("body"))
    bits = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(failures(F.col("body")))), F.lit(0))
    rows = held.select("id", "part", bits.alias("mask"), F.unhex(F.sha2("body", 256)).alias("digest"))
    marks = labels.select(F.col(key).alias("id"), "quality", "toxic").groupBy("id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    by = ["digest", "part", "mask", "good", "toxic"]
    same = rows.groupBy("id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n")).join(marks, "id", "left")
    same = same.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    groups = same.groupBy(by).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("keyless"),
                                  F.min(F.when(F.col("id").isNotNull(), F.struct("id"))).alias("least"),
                                  F.min_by("n", "id").alias("at_least"))
    first = groups.groupBy("digest").agg(F.min("least").alias("first"))
    told = groups.join(first, "digest")
    spared = F.col("keyless") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    copy = 1 << FILTERS.index("E")
    split = told.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), spared.alias("n")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - spared).alias("n")))).alias("x"))
    return split.groupBy("part", F.col("x.mask").alias("mask"), "good", "toxic").agg(F.sum("x.n").alias("n"))


def lattice(n: int) -> list[tuple[int, int, int]]:
    """(subset, filter, orders through the edge that adds the filter), for every edge of the lattice of ``n`` filters.

    Forwards, a subset is reached by the sum of the orders that reach its lower neighbours; backwards, it is left by the sum of
    those that leave its upper ones.
    """
    full = (1 << n) - 1
    reached, left = {0: 1}, {full: 1}
    for s in range(1, full + 1):
        reached[s] = sum(reached[s ^ 1 << f] for f in range(n) if s >> f & 1)
    for s in range(full - 1, -1, -1):
        left[s] = sum(left[s | 1 << f] for f in range(n) if not s >> f & 1)
    assert reached[full] == left[0] == factorial(n)
    return [(s, f, reached[s] * left[s | 1 << f]) for s in range(full) for f in range(n) if not s >> f & 1]


def edge_sums(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part and edge: what the added filter removes there, what its failures lost before, and the labels lost."""
    edges = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(f).alias("f"), F.lit(1 << f).alias("bit"), F.lit(o).cast("long").alias("orders"))
                      for s, f, o in lattice(len(filters))])
    at = counts.select("*", F.explode(edges).alias("e")).select("part", "mask", "good", "toxic", "n", "e.*")
    fails, before = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("s")) != 0
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return at.groupBy("part", "s", "f", "orders").agg(
        F.sum("n").alias("all"), total(fails & ~before).alias("removed"), total(fails & before).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"), total(fails & ~before & (F.col("good") == 1)).alias("good_lost"),
        total(fails & ~before & (F.col("toxic") == 1)).alias("toxic_lost"))


def orders_of(filters: str) -> list[tuple[str, list[str]]]:
    """Every order with the edges it takes, as "subset:filter"."""
    out = []
    for order in permutations(range(len(filters))):
        s, path = 0, []
        for f in order:
            path.append(f"{s}:{f}")
            s |= 1 << f
        out.append(("".join(filters[f] for f in order), path))
    return out


def per_order(sums: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, ... shapley) for all orders, read from the edges: a map of all edges a part, walked once an order."""
    held = ["removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    shares = sums.groupBy("part", "f").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    table = sums.join(shares, ["part", "f"]).groupBy("part", "all").agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "s", "f"), F.struct(*held)))).alias("edge"))
    walks = F.array(*[F.struct(F.lit(name).alias("filter_order"), F.array(*map(F.lit, path)).alias("path")) for name, path in orders_of(filters)])
    steps = table.select("part", "all", "edge", F.explode(walks).alias("w")).select(
        "part", "all", F.col("w.filter_order").alias("filter_order"), F.transform("w.path", lambda k: F.col("edge")[k]).alias("x"))
    # What is left after a step is the whole part less all removals up to it.
    left = F.transform("x", lambda _, i: F.aggregate(F.slice("x", F.lit(1), i + 1), F.col("all"), lambda a, e: a - e["removed"]))
    rows = steps.select("part", "filter_order", F.posexplode(F.arrays_zip(F.col("x").alias("x"), left.alias("kept"))).alias("i", "r"))
    return rows.select("part", "filter_order", (F.col("i") + 1).cast("int").alias("step"), "r.kept", *[f"r.x.{c}" for c in held])


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """All orders of the five filters for every part of ``docs``; ``labels`` holds ``key``, quality and toxic."""
    return per_order(edge_sums(masked(docs, labels, key, text, part)))

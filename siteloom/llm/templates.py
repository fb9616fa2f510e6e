"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names and units turn into typed placeholders, case and punctuation go. Every window of ``width``
template words of every document is hash-joined with the windows of the benchmark items that hold at least ``literal`` words
that are no placeholders. Matches on one alignment (document place minus item place) belong together. An alignment
is consistent if its slots are: each value of the item stands for one value of the document and the other way round, so a question
with other numbers or names is caught, and one that merely looks alike is not. A document leaks an item if a consistent
alignment has ``least`` windows (or all of the item's, if it has fewer).

Numbers are runs that start with a digit; a unit follows a number; a name is a capitalised word after another word or comma.
Replacing touches no white space, so template and plain words align by number.

An item without such windows (fewer than ``width`` words, or nearly all of them placeholders) is searched by its plain words: windows of
``width`` words, or of all of its words if it has fewer. Documents give plain windows only of the lengths that these items have.

Only hashes and places are exploded. The item windows are small; Spark broadcasts them if their size, known from the staged
table, allows, and joins by hash otherwise. Slot values are read in a second pass, over documents with matches only.

Defined cases: null and empty texts and items have no windows; items of fewer than ``SHORTEST`` words are not searched, since their
words alone say nothing (``unsearched`` lists them); repeated documents are reported once each key; repeated items each under their id, null included; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siteloom.session import stage

#: Units that may follow a number.
UNITS = ["km", "m", "cm", "mm", "kg", "g", "mg", "l", "ml", "s", "h", "min", "hour", "hours", "minute", "minutes", "second", "seconds",
         "day", "days", "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "euro", "euros", "cent", "cents",
         "percent", "mile", "miles", "foot", "feet", "inch", "inches", "pound", "pounds"]
#: Least words of an item that is searched.
SHORTEST = 3
NUMBER, NAME, UNIT = "", "", ""


def words(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(text), f"[^\\p{{L}}\\p{{N}}{NUMBER}-{UNIT}\\s]+", "")
    return F.array_remove(F.split(plain, "\\s+"), "")


def template(text: Column) -> Column:
    """Template words; as many as ``words`` has."""
    t = F.regexp_replace(text, "(?<=[\\p{L}\\p{N},] )\\p{Lu}\\p{Ll}+(?![\\p{L}\\p{N}])", NAME)
    t = F.regexp_replace(t, "(?<![\\p{L}\\p{N}])\\p{N}[\\p{N}.,:/]*", NUMBER)
    return words(F.regexp_replace(t, f"(?<={NUMBER} )(?i:{'|'.join(UNITS)})(?![\\p{{L}}\\p{{N}}])", UNIT))


def windows(w: str, width: int) -> Column:
    """Hashes of all windows of the array column ``w``, in order."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)]))
    return F.when(F.size(w) >= width, hashes).otherwise(F.array().cast("array<bigint>"))


def unsearched(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """key and n_words of the items too short to be searched."""
    n = F.size(words(F.coalesce(F.col(text), F.lit(""))))
    return items.select(F.col(key).alias(key), n.alias("n_words")).filter(F.col("n_words") < SHORTEST)


def item_windows(items: DataFrame, key: str, text: str, width: int, literal: int) -> DataFrame:
    """item, q (place), h (hash), slots (has placeholders), plain (the window's plain words), t (its template words), length.

    ``length`` is null for template windows and the number of words of windows of plain words.
    """
    w = items.select(F.col(key).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    w = stage(w.select("item", words(F.col("body")).alias("w"), template(F.col("body")).alias("t")))
    cut = lambda c, n: F.slice(c, F.col("q") + 1, n).alias("plain" if c == "w" else c)
    t = w.select("item", "w", "t", F.posexplode(windows("t", width)).alias("q", "h"))
    t = t.select("item", "q", "h", cut("t", F.lit(width)), cut("w", F.lit(width)))
    slots = F.size(F.filter("t", lambda x: x.rlike(f"[{NUMBER}-{UNIT}]")))
    t = stage(t.withColumn("slots", slots).filter(width - F.col("slots") >= literal).withColumn("length", F.lit(None).cast("int")))
    bare = w.filter(F.size("w") >= SHORTEST).join(t.select(F.col("item").alias("has")).distinct(), F.col("item").eqNullSafe(F.col("has")), "left_anti")
    parts = [t]
    for n in range(SHORTEST, width + 1):
        mine = bare.filter(F.least(F.size("w"), F.lit(width)) == n).select("item", "w", F.posexplode(windows("w", n)).alias("q", "h"))
        parts.append(mine.select("item", "q", "h", F.col("w").alias("t"), cut("w", F.lit(n)), F.lit(0).alias("slots"), F.lit(n).alias("length")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def document_windows(width: int, lengths: list[int]) -> Column:
    """Rows (p, h) of the windows of an array column t of template words and, for each of ``lengths``, of w of plain words."""
    placed = lambda c, n: F.transform(windows(c, n), lambda h, i: F.struct(i.alias("p"), h.alias("h")))
    return F.concat(placed("t", width), *[placed("w", n) for n in lengths])


def consistent_runs(docs: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str, width: int, literal: int, least: int) -> DataFrame:
    """key, id (hash of key and text), item, n_windows, first_word of each consistent alignment of enough windows."""
    known = stage(item_windows(items, item_key, item_text, width, literal))
    lengths = sorted(r["length"] for r in known.select("length").distinct().collect() if r["length"])  # at most ``width`` numbers
    sizes = known.select("item", "q").distinct().groupBy("item").agg(F.count(F.lit(1)).alias("size"))
    seen = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    rows = seen.select("key", F.xxhash64("key", "body").alias("id"), template(F.col("body")).alias("t"), words(F.col("body")).alias("w"))
    if lengths:
        rows = rows.select("key", "id", F.explode(document_windows(width, lengths)).alias("x")).select("key", "id", "x.p", "x.h")
    else:
        rows = rows.select("key", "id", F.posexplode(windows("t", width)).alias("p", "h"))
    found = stage(rows.join(known.select("item", "q", "slots", F.col("h").alias("k")), F.col("h") == F.col("k")).select(
        "key", "id", "p", "item", "q", "slots").distinct())

    # Slot values of the matches that have slots; the texts of other documents go no further than the scan.
    wanted = stage(found.filter("slots > 0"))
    texts = seen.withColumn("i", F.xxhash64("key", "body")).join(wanted.select(F.col("id").alias("i")).distinct(), "i", "left_semi")
    plain = texts.select("i", words(F.col("body")).alias("w")).dropDuplicates(["i"])
    pairs = wanted.join(plain, F.col("id") == F.col("i")).select("id", "item", "p", "q", F.slice("w", F.col("p") + 1, F.lit(width)).alias("ours"))
    pairs = pairs.join(known.select(F.col("item").alias("it"), F.col("q").alias("qq"), "plain", "t"), F.col("item").eqNullSafe(F.col("it")) & (F.col("q") == F.col("qq")))
    slot = F.explode(F.filter(F.arrays_zip("t", "plain", "ours"), lambda x: x["t"].rlike(f"[{NUMBER}-{UNIT}]")))
    pairs = pairs.select("id", "item", (F.col("p") - F.col("q")).alias("shift"), slot.alias("x")).select(
        "id", "item", "shift", F.col("x.t").alias("kind"), F.col("x.plain").alias("theirs"), F.col("x.ours").alias("ours")).distinct()
    place = ["id", "item", "shift"]
    clash = pairs.groupBy(*place, "kind", "theirs").agg(F.count(F.lit(1)).alias("n")).select(*place, "n").unionByName(
        pairs.groupBy(*place, "kind", "ours").agg(F.count(F.lit(1)).alias("n")).select(*place, "n")).filter("n > 1").select(*place).distinct()

    runs = found.groupBy("key", "id", "item", (F.col("p") - F.col("q")).alias("shift")).agg(
        F.count_distinct("q").alias("n_windows"), F.min("p").alias("first_word"))
    clash = clash.select(*[F.col(c).alias(f"c_{c}") for c in place])
    same = (F.col("id") == F.col("c_id")) & F.col("item").eqNullSafe(F.col("c_item")) & (F.col("shift") == F.col("c_shift"))
    sizes = sizes.withColumnRenamed("item", "of")
    runs = runs.join(clash, same, "left_anti").join(sizes, F.col("item").eqNullSafe(F.col("of"))).drop("of")
    return runs.filter(F.col("n_windows") >= F.least(F.lit(least), F.col("size")))


def matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
            width: int = 8, literal: int = 5, least: int = 4) -> DataFrame:
    """key, item_id, n_windows, first_word: leaked items of each document, with its best consistent alignment."""
    runs = consistent_runs(docs, items, key, text, item_key, item_text, width, literal, least)
    return runs.groupBy("key", "item").agg(F.max("n_windows").alias("n_windows"), F.min("first_word").alias("first_word")).withColumnsRenamed(
        {"key": key, "item": item_key})


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
                  width: int = 8, literal: int = 5, least: int = 4) -> DataFrame:
    """``docs`` without the rows that leak an item; the list of leaking rows is joined by its real size.

    A row is its key (null is a key like any other) and its text, so other texts of a null or reused key stay.
    """
    runs = consistent_runs(docs, items, key, text, item_key, item_text, width, literal, least)
    leaks = stage(runs.select("key", "id").distinct())
    # The columns travel in one struct, so that no name of theirs can clash.
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(key).alias("k"),
                       F.xxhash64(F.col(key), F.coalesce(F.col(text), F.lit(""))).alias("h"))
    return held.join(leaks, (F.col("h") == F.col("id")) & F.col("k").eqNullSafe(F.col("key")), "left_anti").select("doc.*")

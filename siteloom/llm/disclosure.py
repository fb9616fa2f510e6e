"""Information-theoretic sanitisation of personal data.

Base spans (emails, addresses, card and phone numbers) are protected entities. A term of the same document may give an entity
away even when the entity itself is gone. How strongly is estimated from the corpus: with N documents, n(e) holding entity e,
n(t) holding term t and n(t, e) holding both, the term's share of the entity's information is

    PMI(t, e) / IC(e) = 1 + ln(n(t, e) / n(t)) / ln(N / n(e))

1 when every document with t holds e, 0 when they are independent. Distance plays no part. Terms of at least ``threshold`` that
share ``support`` documents of different words with e are disclosing; wherever they stand in a document that holds e they are
generalised to a placeholder, and removed if their share reaches ``remove``. Copies of one text are no further evidence.

Everything is DataFrame expressions. Each document with entities gives its distinct terms and its distinct entities; documents
of equal words and entities are combined first, and entities of fewer than ``support`` different texts, whose terms can't reach
it, pair with nothing. A document's terms are dealt out to ``DEAL`` groups, so a long one is not one task's.

Positions come from splitting by the pattern: gaps and hits alternate, so a running length gives each hit's place in code
points. Patterns are possessive and start only where a run starts, so long runs cost no backtracking; they match what the plain
forms in KINDS' comment match, left to right, without overlaps.

Defined cases: a null text is empty and has no spans; repeated rows get equal results; entities compare in lower case; in a
document without entities nothing is touched; an empty table gives no rows. Words are runs of letters and digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siteloom.session import stage

DEAL = 16
#: Kinds in their order.
#: email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+   ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#: card [0-9]([\x20-]?[0-9])+   phone \+[0-9][\x20().0-9-]+[0-9]
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){11}", "phone": r"\+[0-9]"}
WORD = r"[\p{L}\p{N}]++"
SPAN = "array<struct<s:int,k:int,e:int,v:string>>"


def luhn(digits: Column) -> Column:
    size = F.char_length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, size - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), size), F.lit(0), step) % 10 == 0


def accepted(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return hit.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return F.when(F.char_length(digits).between(12, 19), luhn(digits)).otherwise(False)
    return F.char_length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def located(text: Column, pattern: Column | str, accept, rank: int) -> Column:
    """Spans (start, rank, end, text) of all matches that are accepted, in code points."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    parts = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)),
                       lambda g, h: F.struct(g.alias("g"), h.alias("h")))

    def step(held: Column, x: Column) -> Column:
        start = held["at"] + F.char_length(x["g"])
        stop = start + F.coalesce(F.char_length(x["h"]), F.lit(0))
        span = F.struct(start.alias("s"), F.lit(rank).alias("k"), stop.alias("e"), x["h"].alias("v"))
        good = F.when(x["h"].isNotNull(), accept(x["h"])).otherwise(False)
        return F.struct(stop.alias("at"), F.when(good, F.concat(held["out"], F.array(span))).otherwise(held["out"]).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    return F.aggregate(parts, first, step, lambda x: x["out"])


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind."""
    found = [F.when(text.rlike(HINTS[k]), located(text, PATTERNS[k], lambda h, k=k: accepted(k, h), i)).otherwise(F.array().cast(SPAN))
             for i, k in enumerate(KINDS)]
    return F.sort_array(F.concat(*found))


def rebuilt(text: Column, spans: Column, fill) -> Column:
    """``text`` with every span (sorted; overlaps join) replaced by ``fill(span, start)``."""
    def step(held: Column, x: Column) -> Column:
        start, fresh = F.greatest(held["at"], x["s"]), x["e"] > held["at"]
        grown = F.concat(held["out"], F.substring(text, held["at"] + 1, start - held["at"]), fill(x, start))
        return F.struct(F.greatest(held["at"], x["e"]).alias("at"), F.when(fresh, grown).otherwise(held["out"]).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, first, step, lambda x: F.concat(x["out"], F.substring(text, x["at"] + 1, F.char_length(text))))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, [*KINDS, "term"]))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def entity_of(span: Column) -> Column:
    return F.concat(span["k"].cast("string"), F.lit(":"), F.lower(span["v"]))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def disclosing_terms(found: DataFrame, texts: DataFrame, support: int, threshold: float) -> DataFrame:
    """(entity, term, share) of the disclosing terms.

    ``found``: id, spans, masked (text with blanked spans) of the documents with entities. ``texts``: text of all documents.
    """
    held = found.select(F.array_sort(F.array_distinct(F.transform("spans", entity_of))).alias("entities"), words(F.col("masked")).alias("w"))
    held = held.select("entities", F.xxhash64("w").alias("words"), F.array_distinct("w").alias("terms"))
    held = stage(held.groupBy("words", F.xxhash64("entities").alias("named")).agg(
        F.first("entities").alias("entities"), F.first("terms").alias("terms"), F.count(F.lit(1)).alias("n")))

    entities = stage(held.select("words", "n", F.explode("entities").alias("entity")).groupBy("entity").agg(
        F.sum("n").alias("n_e"), F.count_distinct("words").alias("different")))
    often = entities.filter(F.col("different") >= support).select("entity")
    holds = held.select("words", "named", F.explode("entities").alias("entity")).join(often, "entity", "left_semi")
    holds = holds.select("words", "named", "entity", F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1))).alias("deal"))
    said = held.select("words", "named", "n", F.explode("terms").alias("term")).withColumn("deal", F.pmod(F.xxhash64("term"), F.lit(DEAL)).cast("int"))
    together = said.join(holds, ["words", "named", "deal"]).groupBy("entity", "term").agg(
        F.count_distinct("words").alias("different"), F.sum("n").alias("n_te"))
    candidates = stage(together.filter(F.col("different") >= support).select("entity", "term", "n_te"))

    terms = texts.select(F.explode(F.array_distinct(words(F.coalesce("text", F.lit(""))))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n_t"))
    total = texts.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    share = 1 + F.log(F.least(F.col("n_te"), F.col("n_t")) / F.col("n_t")) / F.nullif(F.log(F.lit(float(total)) / F.col("n_e")), F.lit(0.0))
    # An inner join: Spark pushes a semi join below the count, and then every word of every document is shuffled.
    scored = candidates.join(terms, F.col("term") == F.col("t")).join(entities, "entity").withColumn("share", share)
    return stage(scored.filter(F.col("share") >= threshold).select("entity", "term", "share"))


def scan(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, id (hash of key and text), spans and, where there are any, the text with its spans blanked."""
    held = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    held = held.select("key", F.xxhash64("key", "body").alias("id"), base_spans(F.col("body")).alias("spans"), "body")
    blank = lambda x, start: F.repeat(F.lit(" "), x["e"] - start)
    return held.withColumn("masked", F.when(F.size("spans") > 0, rebuilt(F.col("body"), F.col("spans"), blank))).drop("body")


def flagged(docs: DataFrame, staged: DataFrame, text: str, support: int, threshold: float) -> DataFrame:
    """(id, terms) of the documents that hold an entity and may hold terms that disclose it; terms carry their share."""
    found = staged.filter(F.size("spans") > 0)
    terms = disclosing_terms(found, docs.select(F.col(text).alias("text")), support, threshold)
    holds = found.select("id", F.explode(F.array_distinct(F.transform("spans", entity_of))).alias("entity")).distinct()
    return stage(holds.join(terms, "entity").groupBy("id", "term").agg(F.max("share").alias("share"))
                 .groupBy("id").agg(F.sort_array(F.collect_list(F.struct("term", "share"))).alias("terms")))


def term_spans(masked: Column, terms: Column) -> Column:
    """Places of the terms in a text of blanked spans, as whole words of any case."""
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(F.transform(terms, lambda x: x["term"]), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    return F.when(F.size(terms) > 0, located(masked, pattern, lambda h: F.lit(True), len(KINDS))).otherwise(F.array().cast(SPAN))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", support: int = 3, threshold: float = 0.9) -> DataFrame:
    """key, base (base spans) and spans (base and term spans, by start, then kind) of every row."""
    staged = stage(scan(docs, key, text))
    said = flagged(docs, staged, text, support, threshold)
    added = said.join(staged.filter(F.size("spans") > 0).dropDuplicates(["id"]), "id").select(
        F.col("id").alias("i"), term_spans(F.col("masked"), F.col("terms")).alias("more"))
    both = F.sort_array(F.concat("spans", F.coalesce("more", F.array().cast(SPAN))))
    return staged.join(added, F.col("id") == F.col("i"), "left").select(F.col("key").alias(key), F.col("spans").alias("base"), both.alias("spans"))


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text", support: int = 3, threshold: float = 0.9,
             remove: float = 0.99) -> DataFrame:
    """``docs`` with every base span replaced by its kind and disclosing terms generalised or removed."""
    # Spark pushes no filter below a row number, so spans are found once.
    staged = stage(scan(docs, key, text).withColumn("at", F.monotonically_increasing_id()).filter((F.size("spans") > 0) & (F.col("at") >= 0)).drop("at"))
    said = flagged(docs, staged, text, support, threshold)
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("key"), F.col(text).alias("raw"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    rows = rows.withColumn("id", F.xxhash64("key", "body")).join(said.withColumnRenamed("id", "i"), F.col("id") == F.col("i"), "left")
    rows = rows.withColumn("base", base_spans(F.col("body")))
    blank = lambda x, start: F.repeat(F.lit(" "), x["e"] - start)
    rows = rows.withColumn("masked", F.when(F.col("terms").isNotNull(), rebuilt(F.col("body"), F.col("base"), blank)))
    rows = rows.withColumn("more", F.when(F.col("terms").isNotNull(), term_spans(F.col("masked"), F.col("terms"))).otherwise(F.array().cast(SPAN)))
    rows = rows.withColumn("all", F.sort_array(F.concat("base", "more")))
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    gone = lambda x: F.exists("terms", lambda t: (t["term"] == F.lower(x["v"])) & (t["share"] >= remove))
    fill = lambda x, start: F.when(x["k"] < len(KINDS), F.get(names, x["k"])).when(F.coalesce(gone(x), F.lit(False)), "").otherwise(
        F.when(x["v"].rlike("^[0-9]+$"), "<number>").otherwise("<term>"))
    clean = F.when(F.size("all") > 0, rebuilt(F.col("body"), F.col("all"), fill)).otherwise(F.col("raw"))
    return rows.withColumn("clean", clean).select(*[F.col("clean").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns])

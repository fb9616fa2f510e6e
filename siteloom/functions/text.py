"""Column functions over text. Everything is built-in except NFKC, which Spark lacks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from siteloom.functions import constants as K

WS = r"[\t\n\x0B\f\r\p{Z}﻿]"
WORD = r"[\p{L}\p{N}]+"


@F.pandas_udf(T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Unicode compatibility composition, one Arrow batch at a time."""
    return values.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFKC", s))


def js_round(c: Column) -> Column:
    """Round half up on doubles (floor(x + 0.5)), as whole numbers."""
    return F.floor(c + F.lit(0.5)).cast("int")


def clamp(c: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def js_length(c: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def collapse_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, rf"{WS}+", " "))


def normalize_keyword(c: Column, compat: bool = True) -> Column:
    """NFKC, lower case, straight apostrophes, single spaces. ``compat=False`` skips NFKC for text known to be ASCII."""
    base = nfkc(c) if compat else c
    return collapse_ws(F.regexp_replace(F.lower(base), "[‘’]", "'"))


def tokenize(c: Column) -> Column:
    """Letter/digit runs, lower-cased, longer than one character, without stop words; duplicates stay."""
    words = F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))
    return F.filter(words, lambda t: (F.length(t) > 1) & ~t.isin(K.STOP_WORDS))


def intent_score(normalized: Column, tokens: Column, intent: str) -> Column:
    """How many listed terms of one intent occur: token membership, or substring for terms of several words."""
    terms = K.INTENT_TERMS[intent]
    words = [t for t in terms if " " not in t]
    score = F.lit(0)
    for times in range(1, max(map(words.count, words)) + 1):
        listed = sorted({t for t in words if words.count(t) >= times})
        score = score + F.size(F.array_intersect(tokens, F.array(*[F.lit(t) for t in listed])))
    for phrase in (t for t in terms if " " in t):
        score = score + normalized.contains(phrase).cast("int")
    return score


def classify_intent(normalized: Column, tokens: Column) -> Column:
    """Highest-scoring intent; ties go to the earlier of the listed order; nothing matched means informational."""
    order = list(K.INTENT_TERMS)
    scores = {i: intent_score(normalized, tokens, i) for i in order}
    ranked = [F.struct(scores[i].alias("score"), F.lit(len(order) - n).alias("rank"), F.lit(i).alias("intent"))
              for n, i in enumerate(order)]
    best = F.greatest(*ranked)
    return F.when(best["score"] > 0, best["intent"]).otherwise("informational")


def lookup(key: Column, table: dict) -> Column:
    """Value of a small fixed table."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.create_map(*pairs)[key]


def page_type_for_intent(intent: Column) -> Column:
    return F.coalesce(lookup(intent, K.PAGE_TYPE), F.lit("guide"))


def slugify(c: Column, compat: bool = True) -> Column:
    """Slug of at most 80 characters; the cut comes after trimming hyphens."""
    s = F.regexp_replace(normalize_keyword(c, compat), "['’]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    s = F.substring(s, 1, 80)
    return F.concat(F.lit("/"), F.when(s == "", "topic").otherwise(s), F.lit("/"))


def jaccard(left: Column, right: Column) -> Column:
    """Set Jaccard; 0 when either side is empty."""
    both = F.size(F.array_intersect(left, right))
    union = F.size(F.array_union(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(both / union)


def keyword_priority(intent: Column, cluster_size: Column, n_tokens: Column) -> Column:
    return F.least(F.lit(100), F.lit(35) + lookup(intent, K.INTENT_PRIORITY_BOOST)
                   + F.least(cluster_size * 4, F.lit(24)) + F.least(n_tokens * 2, F.lit(10))).cast("int")


def title_case(c: Column) -> Column:
    """Upper-case the letters at the start and after blanks or dashes; all other letters stay as they are."""
    marked = F.regexp_replace(c, rf"(^|{WS}|[\-–—])(\p{{L}})", "$1\u0000$2")
    parts = F.split(marked, "\u0000")
    upper = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(
        F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))))
    return F.array_join(upper, "")


def trim_meta(c: Column, limit: int) -> Column:
    """Cut at limit-1, drop the broken last word, add an ellipsis; short values pass unchanged."""
    cut = trim_ws(F.regexp_replace(F.substring(c, 1, limit - 1), rf"{WS}+[^\t\n\x0B\f\r\p{{Z}}﻿]*$", ""))
    return F.when(js_length(c) <= limit, c).otherwise(F.concat(cut, F.lit("…")))


def clean_text(c: Column, limit: int) -> Column:
    """struct(value, error): whitespace collapsed; error is ``required`` or ``too-long``."""
    v = collapse_ws(c)
    error = F.when(v.isNull() | (v == ""), "required").when(F.length(v) > limit, "too-long")
    return F.struct(F.when(error.isNull(), v).alias("value"), error.alias("error"))


def unique_strings(c: Column, max_items: int, max_length: int) -> Column:
    """Collapsed, cut, distinct without regard to case (first spelling stays), at most max_items."""
    cleaned = F.filter(F.transform(c, lambda s: F.substring(collapse_ws(s), 1, max_length)),
                       lambda s: s.isNotNull() & (s != ""))
    keys = F.transform(cleaned, F.lower)
    firsts = F.filter(cleaned, lambda s, i: F.array_position(keys, F.lower(s)) == i + 1)
    return F.coalesce(F.slice(firsts, 1, max_items), F.array().cast("array<string>"))


def owner_key(email: Column, ip: Column) -> Column:
    return F.when(email.isNotNull() & (email != ""), F.concat(F.lit("user:"), email)).otherwise(
        F.concat(F.lit("ip:"), F.sha2(ip, 256)))


def positive_limit(raw: Column, fallback: int) -> Column:
    n = raw.try_cast("double")
    ok = n.isNotNull() & ~F.isnan(n) & (n > 0) & (n < float("inf"))
    return F.when(ok, F.floor(n)).otherwise(F.lit(fallback)).cast("long")


def csv_cell(c: Column) -> Column:
    flat = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\r?\n", " ")
    quoted = F.concat(F.lit('"'), F.replace(flat, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(flat.rlike('[",\n]'), quoted).otherwise(flat)


def html_escape(c: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def decode_xml(c: Column) -> Column:
    for pattern, char in (("(?i)&amp;", "&"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&quot;", '"'),
                          ("(?i)&#39;|&apos;", "'")):
        c = F.regexp_replace(c, pattern, char)
    return trim_ws(c)


def stable_id(*parts: Column) -> Column:
    """Deterministic id of a row from its natural key."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)

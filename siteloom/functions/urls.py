"""URL columns: parts, resolution, canonical crawl form and target validation."""

from __future__ import annotations

import posixpath
import re
from urllib.parse import quote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from siteloom.functions import constants as K
from siteloom.functions.text import WS, clamp, collapse_ws, trim_ws  # noqa: F401  (clamp re-exported for callers)

_SHAPE = (r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://(?:([^/?#]*)@)?(\[[^\]/?#]*\]|[^/?#:@]*)(?::(\d*))?"
          r"(/[^?#]*)?(?:\?([^#]*))?(?:#(.*))?$")
_PART = {"scheme": 1, "userinfo": 2, "host": 3, "port": 4, "path": 5, "query": 6, "fragment": 7}


def url_part(u: Column, name: str) -> Column:
    """One part of an absolute URL; '' when the part or the shape is absent."""
    c = F.regexp_extract(u, _SHAPE, _PART[name])
    return F.lower(c) if name in ("scheme", "host") else c


#: In normal form already: a plain host, a path, nothing to trim. One test spares such URLs the chain of rewrites.
_NORMAL = r"^https?://[a-z0-9.\-]+/[!-~]*\z"


def absolute_url(u: Column) -> Column:
    """Case, port and empty-path normal form of an absolute http(s) URL, JVM side; null for anything else."""
    t = trim_ws(u)
    site = F.regexp_replace(F.lower(F.regexp_extract(t, r"^((?i:https?)://[^/?#]+)", 1)),
                            r"^(?:(https://.*?):443|(http://.*?):80|(.*?):?)$", "$1$2$3")
    rest = F.regexp_extract(t, r"(?s)^[A-Za-z]+://[^/?#]*(.*)$", 1)
    return F.when(u.rlike(_NORMAL), u).when(site != "", F.concat(site, F.when(rest.startswith("/"), "").otherwise("/"), rest))


def origin(u: Column) -> Column:
    """Scheme, host and port of a normalised URL; '' when it has none."""
    return F.regexp_extract(u, r"^([a-z]+://(?:[^/?#@]*@)?[^/?#]*)", 1)


def path_of(u: Column) -> Column:
    p = F.regexp_extract(u, r"^[a-z]+://[^/?#]*(/[^?#]*)", 1)
    return F.when(p == "", "/").otherwise(p)


_SAFE = "!$%&'()*+,-./:;=@_~"


def _resolve(raw: str, base: str | None) -> str | None:
    """Browser-style resolution of one reference: trimmed, joined, lower-cased host, escaped, no dot segments."""
    try:
        raw = re.sub(r"[\t\n\r]", "", raw.strip(" \t\n\r\f\x00"))
        joined = raw if re.match(r"(?i)[a-z][a-z0-9+.\-]*:", raw) or not base else urljoin(base, raw)
        parts = urlsplit(joined)
        if parts.scheme not in ("http", "https"):
            return joined if parts.scheme else None
        host = (parts.hostname or "").rstrip()
        if not host or re.search(r"[\s<>^|%\\]", host):
            return None
        if not host.isascii():
            host = host.encode("idna").decode()
        if ":" in host:
            host = f"[{host}]"
        default = {"http": 80, "https": 443}[parts.scheme]
        port = "" if parts.port in (None, default) else f":{parts.port}"
        user = f"{parts.netloc.rsplit('@', 1)[0]}@" if "@" in parts.netloc else ""
        path = quote(parts.path.replace("\\", "/"), safe=_SAFE + "|^[]`".replace("`", "")) or "/"
        if "/." in path:
            tail = "/" if re.search(r"/\.{0,2}$", path) else ""
            path = posixpath.normpath(path)
            path = "/" if path in ("/", "//", ".") else path.rstrip("/") + tail
        query = f"?{quote(parts.query, safe=_SAFE + '?/[]^`{|}' + chr(92))}" if "?" in joined.split("#", 1)[0] else ""
        frag = f"#{quote(parts.fragment, safe=_SAFE + '?/[]^{|}#' + chr(92))}" if "#" in joined else ""
        return f"{parts.scheme}://{user}{host}{port}{path}{query}{frag}"
    except (ValueError, UnicodeError):
        return None


@F.pandas_udf(T.StringType())
def resolve_url(raw: pd.Series, base: pd.Series) -> pd.Series:
    """Resolve references against their page, one Arrow batch at a time; null when unresolvable."""
    return pd.Series([None if r is None else _resolve(r, b) for r, b in zip(raw, base)], dtype="object")


def _form_decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))


def _kept_params(u: Column) -> Column:
    entries = F.filter(F.split(F.regexp_extract(u, r"(?s)^[^?#]*\?([^#]*)", 1), "&"), lambda p: p != "")
    pairs = F.transform(entries, lambda p, i: F.struct(
        _form_decode(F.regexp_extract(p, "(?s)^([^=]*)", 1)).alias("k"), i.alias("i"),
        _form_decode(F.regexp_extract(p, "(?s)^[^=]*=?(.*)$", 1)).alias("v")))
    return F.filter(pairs, lambda p: ~(F.lower(p["k"]).startswith("utm_") | F.lower(p["k"]).isin(K.TRACKING_PARAMS)))


def canonicalize_urls(df: DataFrame, url: str, base: str, out: str = "canonical_url", resolved: bool = False) -> DataFrame:
    """Add the crawl form of ``url`` within the site of ``base``; ``resolved=True`` when URLs are already absolute.

    Same origin, no fragment, no tracking, parameters sorted by name; null for another origin, credentials, more than
    12 remaining parameters, or an asset extension.
    """
    absolute = absolute_url(F.col(url)) if resolved else resolve_url(F.col(url), F.col(base))
    staged = (df.withColumn("__abs", absolute)
                .withColumns({"__site": origin(F.col("__abs")), "__path": path_of(F.col("__abs")),
                              "__kept": _kept_params(F.col("__abs"))}))
    c = F.col
    pairs = F.array_join(F.transform(F.array_sort(c("__kept")), lambda p: F.concat(
        F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")
    text = F.concat(c("__site"), c("__path"), F.when(F.size("__kept") == 0, "").otherwise(F.concat(F.lit("?"), pairs)))
    ok = (c("__site").rlike("^https?://") & (c("__site") == origin(absolute_url(c(base)))) & ~c("__site").contains("@")
          & (F.size("__kept") <= K.MAX_QUERY_PARAMS) & ~c("__path").rlike(rf"(?i)\.(?:{K.ASSET_EXTENSIONS})$"))
    return staged.withColumn(out, F.when(ok, text)).drop("__abs", "__site", "__path", "__kept")


def _trim_slashes(u: Column) -> Column:
    """Drop the slashes after the last path segment; a path of slashes only becomes one slash."""
    rooted = F.regexp_replace(u, r"(?s)^([a-z]+://[^/?#]*)//+(\?.*)?$", "$1/$2")
    return F.regexp_replace(rooted, r"(?s)^([a-z]+://[^/?#]*/[^?#]*?[^/?#])/+(\?.*)?$", "$1$2")


# Most stored URLs are in normal form already; one test spares them the chain of rewrites.
_CLEAN = r"^https?://[a-z0-9.\-]+/[\w.~%!$&'()*+,;=@/\-]*[\w.~%!$&'()*+,;=@\-]$"
_CLEAN_SLASH = r"^https?://[a-z0-9.\-]+/[\w.~%!$&'()*+,;=@\-][\w.~%!$&'()*+,;=@/\-]*/$"


def normalize_issue_url(raw: Column) -> Column:
    """No fragment, no trailing slash, query kept; unparsable values lower-cased; null is site-wide."""
    bare = F.regexp_replace(absolute_url(raw), "(?s)#.*$", "")
    text = _trim_slashes(bare)
    return (F.when(raw.isNull() | (raw == ""), "site-wide").when(raw.rlike(_CLEAN), raw)
             .when(raw.rlike(_CLEAN_SLASH), F.rtrim(raw, F.lit("/")))
             .otherwise(F.coalesce(text, F.lower(trim_ws(raw)))))


def normalize_link_url(raw: Column) -> Column:
    """As normalize_issue_url without the query; unparsable values stay as they are."""
    bare = F.regexp_replace(absolute_url(raw), r"(?s)[?#].*$", "")
    return (F.when(raw.rlike(_CLEAN), raw).when(raw.rlike(_CLEAN_SLASH), F.rtrim(raw, F.lit("/")))
             .otherwise(F.coalesce(_trim_slashes(bare), raw)))


def path_segments(u: Column) -> Column:
    return F.filter(F.split(path_of(u), "/"), lambda s: s != "")


def path_parent(u: Column) -> Column:
    """First path segment when there are at least two."""
    parts = path_segments(u)
    return F.when(F.size(parts) > 1, parts[0]).otherwise("")


def decoded_path(u: Column) -> Column:
    """Percent-decoded path with - and _ as blanks; the whole URL when it cannot be decoded."""
    spaced = F.regexp_replace(path_of(u), "[-_]", " ")
    return F.coalesce(F.when(origin(u) != "", F.try_url_decode(F.replace(spaced, F.lit("+"), F.lit("%2B")))), u)


def anchor_text(first_h1: Column, title: Column, u: Column) -> Column:
    """Proposed link text: heading, title or last path segment without the site-name suffix."""
    last = F.try_element_at(path_segments(u), F.lit(-1))
    value = F.coalesce(F.nullif(first_h1, F.lit("")), F.nullif(title, F.lit("")), last, F.lit("Learn more"))
    return F.substring(collapse_ws(F.regexp_replace(value, rf"{WS}*[|—–-]{WS}*[^|—–]+$", "")), 1, 90)


def ipv4_number(c: Column) -> Column:
    """Dotted quad as a whole number; null when it is not an IPv4 literal."""
    parts = F.transform(F.split(c, r"\."), lambda p: p.try_cast("long"))
    value = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p)
    ok = c.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$") & F.forall(parts, lambda p: p <= 255)
    return F.when(ok, value)


def quad_number(quad: str) -> int:
    a, b, c, d = map(int, quad.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def in_ranges(number: Column, ranges: list[tuple[str, str]]) -> Column:
    """Whether an address number falls in one of a dozen fixed ranges (plain comparisons, no join needed)."""
    test = F.lit(False)
    for low, high in ranges:
        test = test | number.between(quad_number(low), quad_number(high))
    return test


def validate_targets(df: DataFrame, url: str) -> DataFrame:
    """Add normalized_url and reject_reason (null when the target may be audited)."""
    raw = trim_ws(F.coalesce(F.col(url), F.lit("")))
    full = F.when(raw.rlike("(?i)^https?://"), raw).otherwise(F.concat(F.lit("https://"), raw))
    out = df.withColumn("__raw", raw).withColumn("__full", full).withColumn("__abs", absolute_url(F.col("__full")))
    a = F.col("__abs")
    host = F.regexp_replace(url_part(a, "host"), r"\.$", "")
    number = ipv4_number(host)
    blocked = host.isin(K.BLOCKED_HOSTS) | (host == "")
    for suffix in K.BLOCKED_SUFFIXES:
        blocked = blocked | host.endswith(suffix)
    v6 = F.regexp_replace(host, r"^\[|\]$", "")
    reason = (F.when(F.col("__raw") == "", "empty")
              .when(F.length("__raw") > K.MAX_TARGET_LENGTH, "too-long")
              .when(a.isNull() | url_part(a, "host").rlike(r"[\s<>^|%\\]"), "invalid")
              .when(url_part(a, "userinfo") != "", "credentials")
              .when(blocked, "private-host")
              .when(F.coalesce(in_ranges(number, K.TARGET_RANGES), F.lit(False))
                    | (v6.contains(":") & v6.rlike(K.BLOCKED_V6_TARGET)), "private-address")
              .when(url_part(a, "port") != "", "port"))
    clean = F.regexp_replace(a, "(?s)#.*$", "")
    return (out.withColumn("reject_reason", reason)
               .withColumn("normalized_url", F.when(F.col("reject_reason").isNull(), clean))
               .drop("__raw", "__full", "__abs"))

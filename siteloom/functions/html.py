"""Page features from raw HTML: a small event handler run inside mapInPandas batches."""

from __future__ import annotations

from html.parser import HTMLParser
import re
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from siteloom.functions.urls import _resolve

HIDDEN = {"script", "style", "noscript", "template", "svg"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SPACE = re.compile(r"[\s﻿]+")

FEATURES = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("description", T.StringType()),
    T.StructField("canonical", T.StringType()), T.StructField("canonical_resolved", T.StringType()),
    T.StructField("robots", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("h1", T.ArrayType(T.StringType())), T.StructField("heading_count", T.IntegerType()),
    T.StructField("word_count", T.IntegerType()), T.StructField("image_count", T.IntegerType()),
    T.StructField("images_missing_alt", T.IntegerType()),
    T.StructField("internal_links", T.ArrayType(T.StringType())),
    T.StructField("external_links", T.ArrayType(T.StringType())),
    T.StructField("schema_count", T.IntegerType()), T.StructField("og_title", T.StringType()),
    T.StructField("og_description", T.StringType()),
])


def _flat(parts: list[str]) -> str:
    return SPACE.sub(" ", "".join(parts)).strip(" ")


class _Page(HTMLParser):
    """Collects the page fields while the markup streams by; hidden subtrees add no text, headings or images."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.hidden: list[str] = []
        self.meta: dict[str, str] = {}
        self.hrefs: list[str] = []
        self.h1s: list[list[str]] = []
        self.title: list[str] | None = None
        self.in_title = self.in_h1 = self.in_body = False
        self.body: list[str] = []
        self.headings = self.images = self.no_alt = self.schemas = 0
        self.canonical = self.lang = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(reversed(attrs))
        if tag == "a" and "href" in a:
            self.hrefs.append(a["href"] or "")
        if tag == "script" and (a.get("type") or "").lower() == "application/ld+json":
            self.schemas += 1
        if tag == "meta":
            for key in ("name", "property"):
                name = f"{key}:{(a.get(key) or '').lower()}"
                self.meta.setdefault(name, (a.get("content") or "").strip())
        if tag == "link" and self.canonical is None and (a.get("rel") or "").lower() == "canonical":
            self.canonical = (a.get("href") or "").strip()
        if tag == "html" and self.lang is None:
            self.lang = (a.get("lang") or "").strip()
        if tag == "body":
            self.in_body = True
        if tag in HIDDEN:
            self.hidden.append(tag)
        if self.hidden:
            return
        if tag in HEADINGS:
            self.headings += 1
        if tag == "h1":
            self.h1s.append([])
            self.in_h1 = True
        if tag == "title" and self.title is None:
            self.title, self.in_title = [], True
        if tag == "img":
            self.images += 1
            self.no_alt += "alt" not in a

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.hidden:
            while self.hidden and self.hidden.pop() != tag:
                pass
            return
        if self.hidden:
            return
        if tag == "title":
            self.in_title = False
        elif tag == "h1":
            self.in_h1 = False
        elif tag == "body":
            self.in_body = False

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        if self.in_title and self.title is not None:
            self.title.append(data)
        if self.in_h1:
            self.h1s[-1].append(data)
        if self.in_body:
            self.body.append(data)


def _features(html: str | None, url: str) -> tuple:
    page = _Page()
    page.feed(html or "")
    page.close()
    links = {}
    for href in page.hrefs:
        full = _resolve(href, url)
        if full and full.startswith(("http://", "https://")):
            links.setdefault(full.split("#", 1)[0])
    mine = urlsplit(url)
    inside = [u for u in links if urlsplit(u)[:2] == mine[:2]]
    outside = [u for u in links if urlsplit(u)[:2] != mine[:2]]
    heads = [h for h in map(_flat, page.h1s) if h]
    canonical = page.canonical or ""
    meta = page.meta
    return (_flat(page.title or []), meta.get("name:description", ""), canonical,
            _resolve(canonical, url) if canonical else None, meta.get("name:robots", ""), page.lang or "", heads,
            page.headings, len(_flat(page.body).split(" ")) if _flat(page.body) else 0, page.images, page.no_alt,
            inside, outside, page.schemas, meta.get("property:og:title", ""), meta.get("property:og:description", ""))


def extract_page_features(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Replace the HTML column by the page fields; every other column passes through."""
    keep = [c for c in pages.columns if c != html]
    schema = T.StructType([f for f in pages.schema.fields if f.name != html] + FEATURES.fields)

    def parse(batches):
        for pdf in batches:
            rows = [_features(h, u) for h, u in zip(pdf[html], pdf[url])]
            out = pdf[keep].reset_index(drop=True)
            for i, field in enumerate(FEATURES.fields):
                out[field.name] = pd.Series([r[i] for r in rows], dtype="object")
            yield out

    return pages.select(*keep, html).mapInPandas(parse, schema)


def page_links(pages: DataFrame, *keys: str) -> DataFrame:
    """Edge rows of the pages: one row per distinct link with its position and side."""
    def side(name: str, internal: bool):
        return (pages.select(*keys, F.col("url").alias("src"), F.posexplode(name).alias("position", "dst_raw"))
                     .withColumn("internal", F.lit(internal)))
    return side("internal_links", True).unionByName(side("external_links", False))

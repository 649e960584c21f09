"""Page features from raw HTML.

One small helper reads the markup and returns what is written in it; every judgement on top of that is a
column. `pages` needs project_id, url and html; other columns are kept.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlscope import constants as C
from crawlscope.functions import jsonld
from crawlscope.functions.text import collapse, count_words, strip
from crawlscope.functions.urls import same_site, without_fragment

# Executors need no installed copy of this package: the helper travels with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MARKUP_SCHEMA = (
    "title string, html_lang string, metas array<struct<key:string,content:string>>, canonical string, "
    "h1_raw array<string>, anchors array<struct<href:string,rel:string>>, jsonld array<string>, "
    "has_time boolean, body_text string"
)
MARKUP_FIELDS = ["title", "html_lang", "metas", "canonical", "h1_raw", "anchors", "jsonld", "has_time", "body_text"]
_SILENT = {"script", "style", "template"}


class _Markup(HTMLParser):
    """What one document declares, with text joined by spaces and <br> inside a heading read as a space."""

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base = base
        self.title: str | None = None
        self.html_lang: str | None = None
        self.canonical: str | None = None
        self.has_time = False
        self.metas: list[dict] = []
        self.h1: list[str] = []
        self.anchors: list[dict] = []
        self.jsonld: list[str] = []
        self.text: list[str] = []
        self._open: list[str] = []
        self._capture: str | None = None

    def handle_starttag(self, tag, attrs):
        attributes = {k: v or "" for k, v in reversed(attrs)}
        if tag == "meta":
            for key in {attributes.get("name"), attributes.get("property")} - {None, ""}:
                self.metas.append({"key": key, "content": attributes.get("content", "")})
        elif tag == "html" and self.html_lang is None:
            self.html_lang = attributes.get("lang")
        elif tag == "link" and self.canonical is None and "canonical" in attributes.get("rel", "").lower().split():
            self.canonical = attributes.get("href")
        elif tag == "a" and "href" in attributes:
            try:
                target = urljoin(self.base, attributes["href"])
            except ValueError:
                target = attributes["href"]
            self.anchors.append({"href": target, "rel": attributes.get("rel", "").lower()})
        elif tag == "time":
            self.has_time = True
        elif tag == "br" and self._capture == "h1":
            self.h1[-1] += " "
        elif tag in _SILENT:
            self._open.append(tag)
            if tag == "script" and attributes.get("type", "").lower() == "application/ld+json":
                self._capture = "jsonld"
                self.jsonld.append("")
        elif tag == "h1":
            self._capture = "h1"
            self.h1.append("")
        elif tag == "title" and self.title is None:
            self._capture = "title"
            self.title = ""

    def handle_endtag(self, tag):
        if tag in _SILENT and tag in self._open:
            self._open.remove(tag)
            self._capture = None if self._capture == "jsonld" else self._capture
        elif tag == self._capture:
            self._capture = None

    def handle_data(self, data):
        if self._capture == "jsonld":
            self.jsonld[-1] += data
            return
        if self._open:
            return
        if self._capture == "h1":
            self.h1[-1] += data
        elif self._capture == "title":
            self.title += data
        if not data.isspace():
            self.text.append(data.strip())


def _read_markup(url: str, html: str) -> dict:
    reader = _Markup(url or "")
    reader.feed(html or "")
    reader.close()
    return {
        "title": reader.title, "html_lang": reader.html_lang, "metas": reader.metas, "canonical": reader.canonical,
        "h1_raw": reader.h1, "anchors": reader.anchors, "jsonld": reader.jsonld, "has_time": reader.has_time,
        "body_text": " ".join(reader.text),
    }


def read_markup(pages: DataFrame) -> DataFrame:
    """Replace `html` by what the markup declares; `url` is the base for relative links."""
    kept = [f for f in pages.schema.fields if f.name != "html"]
    names = [f.name for f in kept]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", " + MARKUP_SCHEMA

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_read_markup(u, h) for u, h in zip(batch["url"], batch["html"])]
            yield pd.concat([batch[names].reset_index(drop=True), pd.DataFrame(found, columns=MARKUP_FIELDS)], axis=1)

    return pages.mapInPandas(read, schema)


def _meta(key: str) -> Column:
    return F.get(F.filter("metas", lambda m: m["key"] == key), F.lit(0))["content"]


def _has_meta(*keys: str) -> Column:
    return F.exists("metas", lambda m: m["key"].isin(*keys))


def h1_texts() -> Column:
    """Headings with whitespace collapsed and empty ones dropped."""
    return F.filter(F.transform("h1_raw", collapse), lambda t: t != "")


def link_columns(markup: DataFrame) -> DataFrame:
    """internal_links, nofollow_internal and nofollow_external_count from the resolved anchors."""
    web = F.filter("anchors", lambda a: a["href"].rlike("(?i)^https?:"))
    inside = F.filter(web, lambda a: same_site(a["href"], F.col("url")))
    outside = F.filter(web, lambda a: ~same_site(a["href"], F.col("url")))
    nofollow = lambda a: F.array_contains(F.split(a["rel"], r"\s+"), "nofollow")
    href = lambda a: without_fragment(a["href"])
    return markup.withColumns(
        {
            "internal_links": F.transform(inside, href),
            "nofollow_internal": F.transform(F.filter(inside, nofollow), href),
            "nofollow_external_count": F.size(F.filter(outside, nofollow)),
        }
    )


def eeat_columns(features: DataFrame) -> DataFrame:
    """has_author, has_date and has_contact from metas, types and the visible text."""
    text = F.col("body_text")
    return features.withColumns(
        {
            "has_author": _has_meta("author") | F.array_contains("schema_types", "Person")
            | text.rlike("(?iuU)" + C.BYLINE),
            "has_date": _has_meta("article:published_time", "article:modified_time") | F.col("has_time")
            | text.rlike("(?iuU)" + C.VISIBLE_DATE),
            "has_contact": F.exists("anchors", lambda a: a["href"].rlike("(?i)^mailto:"))
            | text.rlike(C.PHONE) | text.rlike("(?iuU)" + C.CONTACT_WORDS),
        }
    )


def extract_page_features(pages: DataFrame) -> DataFrame:
    """The crawl record of every page: texts, links, structured data and trust signals."""
    markup = read_markup(pages)
    nodes = jsonld.node_texts("jsonld")
    base = markup.withColumn("_nodes", nodes).withColumns(
        {
            "title": strip(F.col("title")),
            "meta_description": strip(_meta("description")),
            "h1_tags": h1_texts(),
            "is_indexable": ~F.contains(F.lower(F.coalesce(_meta("robots"), F.lit(""))), F.lit("noindex")),
            "lang_declared": F.coalesce(
                F.nullif(F.substring_index(F.coalesce("html_lang", F.lit("es")), "-", 1), F.lit("")), F.lit("es")
            ),
            "og": F.struct(
                F.nullif(_meta("og:title"), F.lit("")).alias("title"),
                F.nullif(_meta("og:description"), F.lit("")).alias("description"),
                F.nullif(_meta("og:image"), F.lit("")).alias("image"),
            ),
            "word_count": count_words(F.col("body_text")),
            "schema_types": F.flatten(F.transform("_nodes", jsonld.node_types)),
            "schema_has_errors": jsonld.has_errors("jsonld"),
            "schema_nodes": F.transform(
                F.filter("_nodes", lambda n: F.get_json_object(n, "$['@type']").isNotNull()),
                lambda n: F.struct(jsonld.node_types(n).alias("types"), jsonld.node_fields(n).alias("fields")),
            ),
            "local_business_schema": F.get(
                F.transform(
                    F.filter("_nodes", lambda n: F.array_contains(jsonld.node_types(n), "LocalBusiness")),
                    lambda n: F.struct(
                        F.get_json_object(n, "$.name").alias("name"),
                        F.get_json_object(n, "$.telephone").alias("telephone"),
                    ),
                ),
                F.lit(0),
            ),
        }
    )
    return eeat_columns(link_columns(base)).drop("_nodes", "metas", "h1_raw", "anchors", "jsonld", "html_lang", "has_time")

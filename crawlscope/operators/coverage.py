"""Sitemap, crawl and index compared as sets of canonical urls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlscope.functions.urls import canonical_url

SITE = ["project_id"]
SOURCES = ["sitemap", "crawled", "indexed", "inspected"]


def broken_pages(pages: DataFrame) -> DataFrame:
    return pages.filter(F.col("status_code") >= 400).select(*SITE, "url", "status_code")


def redirect_links(pages: DataFrame) -> DataFrame:
    """Pages reached through a redirect to another canonical url."""
    moved = F.coalesce("redirected_to", F.lit("")) != ""
    return pages.filter(moved & (canonical_url(F.col("redirected_to")) != canonical_url(F.col("url")))).select(
        *SITE, "url", "redirected_to"
    )


def coverage_base(
    crawl: DataFrame, sitemap: DataFrame | None = None, inspections: DataFrame | None = None
) -> DataFrame:
    """One row per site and canonical url with a flag per source, in one pass over the union of all.

    `crawl` is pages, `sitemap` project_id and url, `inspections` project_id, url and verdict. The has_*
    columns say whether the site has that source at all: a missing source is unknown, not empty.
    """

    def flagged(rows: DataFrame, **flags) -> DataFrame:
        columns = [flags.get(s, F.lit(False)).alias(s) for s in SOURCES]
        return rows.select(*SITE, canonical_url(F.col("url")).alias("url"), *columns)

    yes = F.lit(True)
    parts = [flagged(crawl.filter(F.col("status_code") == 200), crawled=yes)]
    if sitemap is not None:
        parts.append(flagged(sitemap, sitemap=yes))
    if inspections is not None:
        parts.append(flagged(inspections, inspected=yes, indexed=F.coalesce(F.col("verdict") == "PASS", F.lit(False))))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.groupBy(*SITE, "url").agg(*[F.bool_or(s).alias(s) for s in SOURCES])


def _source_presence(base: DataFrame) -> DataFrame:
    return base.groupBy(*SITE).agg(
        F.bool_or("sitemap").alias("has_sitemap"), F.bool_or("inspected").alias("has_index"),
        F.count(F.lit(1)).alias("_n"),
    )


def coverage_diff(base: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """The five differences in long form: project_id, difference, url.

    "Not indexed" is said only of inspected urls; the others are "not inspected". Differences that need a
    source the site does not have are absent. `sources` (project_id, has_sitemap, has_index) says which
    sources were landed, so that a landed but empty sitemap is told from none; without it a source without
    rows counts as missing.
    """
    from crawlscope.skew import lookup_join

    present = _source_presence(base)
    if sources is not None:
        told = sources.select(*SITE, F.col("has_sitemap").alias("_s"), F.col("has_index").alias("_i"))
        present = present.join(told, SITE, "left").select(
            *SITE, F.coalesce("_s", "has_sitemap").alias("has_sitemap"), F.coalesce("_i", "has_index").alias("has_index"), "_n"
        )
    known = lookup_join(base, present, SITE, weight="_n", how="inner")
    c = {s: F.col(s) for s in [*SOURCES, "has_sitemap", "has_index"]}
    both = c["has_sitemap"] & c["has_index"]
    rules = {
        "in_sitemap_not_crawled": c["has_sitemap"] & c["sitemap"] & ~c["crawled"],
        "crawled_not_in_sitemap": c["has_sitemap"] & c["crawled"] & ~c["sitemap"],
        "sitemap_not_indexed": both & c["sitemap"] & c["inspected"] & ~c["indexed"],
        "sitemap_not_inspected": both & c["sitemap"] & ~c["inspected"],
        "indexed_not_in_sitemap": both & c["indexed"] & ~c["sitemap"],
    }
    names = F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return known.select(*SITE, F.explode(names).alias("difference"), "url")


def coverage_counts(base: DataFrame) -> DataFrame:
    """Urls per source and site; NULL for a source the site does not have."""
    counts = base.groupBy(*SITE).agg(*[F.count_if(s).alias(s) for s in SOURCES])
    return counts.select(
        *SITE, "crawled", F.nullif("sitemap", F.lit(0)).alias("sitemap"),
        F.when(F.col("inspected") > 0, F.col("indexed")).alias("indexed"),
        F.nullif("inspected", F.lit(0)).alias("inspected"),
    )


def robots_sitemap_conflicts(sitemap: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """Sitemap urls that the robots.txt of their own site keeps from being read."""
    from crawlscope.sources.robots import blocked_urls

    return blocked_urls(sitemap.select(*SITE, "url").distinct(), robots, agent)

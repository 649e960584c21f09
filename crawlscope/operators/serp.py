"""Search-result listings: project_id, keyword, date, position, url, domain, title, is_ours.

One listing is a page of results: at most a few dozen rows share project, keyword and date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlscope.functions.text import is_platform
from crawlscope.functions.urls import domain_of, without_www
from crawlscope.sinks.current import History
from crawlscope.skew import Newest, first_k, latest_rows, lookup_join

SITE = ["project_id"]
LISTING = ["project_id", "keyword"]


def current(listings: DataFrame | Newest | History) -> DataFrame:
    """The newest listing day of every site."""
    return latest_rows(listings, SITE, "date") if isinstance(listings, DataFrame) else listings.current()


def _with_own(listings: DataFrame, sites: DataFrame) -> DataFrame:
    own = sites.select(*SITE, domain_of(F.col("url"), keep_port=True).alias("own_domain"))
    return lookup_join(listings, own, SITE).withColumn("domain", F.lower("domain"))


def discover_competitors(
    listings: DataFrame, sites: DataFrame, registered: DataFrame | None = None, min_appearances: int | None = None
) -> DataFrame:
    """Who shares our result pages: keywords, best and mean position, share, registered or platform.

    Counted per (domain, keyword) first, so a domain present everywhere is summed before it is shuffled.
    """
    rows = _with_own(listings, sites)
    totals = rows.select(*LISTING).distinct().groupBy(*SITE).agg(F.count(F.lit(1)).alias("total_keywords"))
    rivals = rows.filter((F.coalesce("domain", F.lit("")) != "") & (F.col("domain") != F.col("own_domain")))
    per_keyword = rivals.groupBy(*SITE, "domain", "keyword").agg(
        F.min("position").alias("best"), F.sum("position").alias("sum"), F.count(F.lit(1)).alias("n")
    )
    found = per_keyword.groupBy(*SITE, "domain").agg(
        F.count(F.lit(1)).alias("appearances"), F.min("best").alias("best_position"),
        F.bround(F.sum("sum") / F.sum("n"), 1).alias("avg_position"),
    ).join(totals, SITE)
    least = F.lit(min_appearances) if min_appearances is not None else F.when(F.col("total_keywords") <= 3, 1).otherwise(2)
    kept = found.filter(F.col("appearances") >= least)
    if registered is None:
        kept = kept.withColumn("is_registered", F.lit(False))
    else:
        names = registered.select(*SITE, without_www(F.lower("domain")).alias("domain")).distinct()
        kept = kept.join(names.withColumn("_known", F.lit(True)), [*SITE, "domain"], "left").withColumn(
            "is_registered", F.col("_known").isNotNull()
        )
    return kept.select(
        *SITE, "domain", "appearances", "best_position", "avg_position", "is_registered",
        is_platform(F.col("domain")).alias("is_platform"),
        F.bround(F.col("appearances") / F.col("total_keywords"), 2).alias("share_of_keywords"),
    )


def domain_keywords(listings: DataFrame, sites: DataFrame) -> DataFrame:
    """The keywords behind every discovered domain, one row each."""
    return _with_own(listings, sites).filter(F.col("domain") != F.col("own_domain")).groupBy(*SITE, "domain", "keyword").agg(
        F.min("position").alias("best_position")
    )


def who_beats_us(listings: DataFrame, sites: DataFrame) -> DataFrame:
    """Rows ranked above our best row of the same keyword, or all of them where we do not appear."""
    rows = _with_own(listings, sites)
    ours = F.coalesce("is_ours", F.lit(False)) | (F.col("domain") == F.col("own_domain"))
    page = Window.partitionBy(*LISTING)
    marked = rows.withColumns(
        {
            "our_position": F.min(F.when(ours, F.col("position"))).over(page),
            "our_url": F.min(F.when(ours, F.struct("position", "url"))).over(page)["url"],
        }
    )
    above = F.col("our_position").isNull() | (F.col("position") < F.col("our_position"))
    return marked.filter(above & (F.coalesce("domain", F.lit("")) != F.col("own_domain"))).select(
        *LISTING, "our_position", "our_url", "position", "domain", "url", is_platform(F.col("domain")).alias("is_platform")
    )


def keyword_standing(listings: DataFrame, sites: DataFrame) -> DataFrame:
    """One row per keyword: our position (NULL when absent) and how many rows beat us. NULLs sort first."""
    rows = _with_own(listings, sites)
    ours = F.coalesce("is_ours", F.lit(False)) | (F.col("domain") == F.col("own_domain"))
    page = Window.partitionBy(*LISTING)
    best = rows.withColumn("our_position", F.min(F.when(ours, F.col("position"))).over(page))
    above = F.col("our_position").isNull() | (F.col("position") < F.col("our_position"))
    rival = F.coalesce("domain", F.lit("")) != F.col("own_domain")
    return best.groupBy(*LISTING).agg(
        F.max("our_position").alias("our_position"), F.count_if(above & rival).alias("beaten_by")
    )


# --- our page beside the listed ones -----------------------------------------------------------------

MEASURES = ["word_count", "title_length", "h1_count", "links", "schema_types", "has_author", "has_date"]


def page_measures(pages: DataFrame) -> DataFrame:
    """What the comparison needs of a page, by exact url."""
    measured = pages.select(
        "url", "word_count", F.length(F.coalesce("title", F.lit(""))).alias("title_length"),
        F.size("h1_tags").alias("h1_count"), F.size("internal_links").alias("links"), "schema_types",
        "has_author", "has_date",
    )
    return measured.groupBy("url").agg(F.max(F.struct(*MEASURES)).alias("m")).select("url", "m.*")


def serp_medians(listed: DataFrame) -> DataFrame:
    """Medians and shares over the measured competitor rows of each keyword, types listed once."""
    middle = lambda c: F.percentile(c, F.lit(0.5)).cast("int")
    share = lambda c: F.bround(F.avg(F.when(c, 1).otherwise(0)), 2)
    return listed.groupBy(*LISTING).agg(
        F.count(F.lit(1)).alias("pages_measured"),
        middle("word_count").alias("median_word_count"), middle("title_length").alias("median_title_length"),
        middle("h1_count").alias("median_h1_count"), middle("links").alias("median_links"),
        share(F.size("schema_types") > 0).alias("pct_with_schema"), share(F.col("has_author")).alias("pct_with_author"),
        share(F.col("has_date")).alias("pct_with_date"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("schema_types")))).alias("common_schema_types"),
    )


def serp_rows(listings: DataFrame) -> DataFrame:
    """The newest listing of every keyword."""
    return latest_rows(listings, LISTING, "date")


def competitor_rows(listings: DataFrame, measures: DataFrame, max_urls: int | None = None) -> DataFrame:
    """The foreign rows of every keyword with their measured pages; `max_urls` keeps the best placed only."""
    foreign = serp_rows(listings).filter(~F.coalesce("is_ours", F.lit(False)))
    if max_urls is not None:
        foreign = first_k(foreign, LISTING, [F.col("position")], max_urls).drop("_rank")
    return lookup_join(foreign, measures, ["url"], how="inner")


def serp_compare(listings: DataFrame, sites: DataFrame, measures: DataFrame, max_urls: int | None = None) -> DataFrame:
    """Measured differences between our page and the medians above it, one row per keyword and difference.

    Our page is the one that ranks, or the home page where none does.
    """
    medians = serp_medians(competitor_rows(listings, measures, max_urls))
    own = serp_rows(listings).groupBy(*LISTING).agg(
        F.min(F.when(F.col("is_ours"), F.struct("position", "url"))).alias("_own")
    )
    homes = sites.select(*SITE, F.col("url").alias("_home"))
    chosen = lookup_join(own, homes, SITE).select(
        *LISTING, F.coalesce("_own.url", "_home").alias("url"), F.col("_own").isNotNull().alias("is_ranking_page")
    )
    ours = lookup_join(chosen, measures, ["url"], how="inner")
    both = ours.join(medians, LISTING)
    words, top = F.col("word_count"), F.col("median_word_count")

    def difference(metric, condition, own_value, top_value):
        return F.when(condition, F.struct(F.lit(metric).alias("metric"), own_value.cast("string").alias("ours"),
                                          top_value.cast("string").alias("top10")))

    untyped, percent = F.size("schema_types") == 0, lambda c: (F.col(c) * 100).cast("int")
    found = F.filter(
        F.array(
            difference("content shorter", (top > 0) & (words < top * 0.6), words, top),
            difference("content longer", (top > 0) & (words > top * 1.8), words, top),
            difference("structured data", untyped & (F.col("pct_with_schema") >= 0.5), F.lit(0), percent("pct_with_schema")),
            difference("author", ~F.col("has_author") & (F.col("pct_with_author") >= 0.5), F.lit(0), percent("pct_with_author")),
            difference("date", ~F.col("has_date") & (F.col("pct_with_date") >= 0.5), F.lit(0), percent("pct_with_date")),
            difference("h1", F.col("h1_count") == 0, F.lit(0), F.col("median_h1_count")),
        ),
        lambda x: x.isNotNull(),
    )
    return both.select(*LISTING, "url", "is_ranking_page", F.inline(found))

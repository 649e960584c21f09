"""Groups of pages: repeated texts, thin content, response headers, site averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlscope import constants as C
from crawlscope.functions.text import norm_text
from crawlscope.operators.links import redirect_alias_filter
from crawlscope.skew import counted_sample, lookup_join

SITE = ["project_id"]
FIELDS = ["title", "meta_description", "h1"]


def own_pages(pages: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Indexable pages answered with 200 (or not measured) that are no redirect alias."""
    kept = pages.filter(
        F.coalesce("is_indexable", F.lit(True)) & (F.col("status_code").isNull() | (F.col("status_code") == 200))
    )
    return kept if edges is None else redirect_alias_filter(kept, edges)


def _field_values(pages: DataFrame, edges: DataFrame | None) -> DataFrame:
    """All three texts of a page in one pass: project_id, field, value, url."""
    listed = F.explode(
        F.array(*[F.struct(F.lit(f).alias("field"), norm_text(F.col(f)).alias("value")) for f in FIELDS])
    )
    return own_pages(pages, edges).select(*SITE, "url", listed.alias("v")).select(*SITE, "url", "v.*").filter(
        "value IS NOT NULL"
    )


def duplicate_field(pages: DataFrame, edges: DataFrame | None = None, samples: int = 5) -> DataFrame:
    """Texts shared by two pages or more: how many pages, and the first few urls."""
    grouped = counted_sample(_field_values(pages, edges), [*SITE, "field", "value"], F.col("url"), [F.col("url")], samples)
    return grouped.filter("n > 1").withColumnRenamed("n", "pages").withColumnRenamed("sample", "sample_urls")


def duplicate_members(pages: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Every page of every group of copies, one row each, so that a huge group never becomes one row."""
    keys = [*SITE, "field", "value"]
    values = _field_values(pages, edges)
    groups = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count(F.lit(1)).alias("pages"))
    return lookup_join(values, groups.filter("pages > 1"), keys, weight="_n", how="inner").select(*keys, "pages", "url")


def thin_content(pages: DataFrame, edges: DataFrame | None = None, threshold: int = C.MIN_WORDS_THIN) -> DataFrame:
    """Own pages with fewer words than the threshold; a page without a count is not thin, just unmeasured."""
    return own_pages(pages, edges).filter(F.col("word_count") < threshold).select(*SITE, "url", "word_count")


def _blank(name: str) -> Column:
    return F.coalesce(name, F.lit("")) == ""


def cache_header_findings(pages: DataFrame) -> DataFrame:
    """One row per page answered with 200 and header it lacks."""
    lacking = F.filter(
        F.array(F.when(_blank("content_encoding"), F.lit("uncompressed")), F.when(_blank("cache_control"), F.lit("no_cache_control"))),
        lambda x: x.isNotNull(),
    )
    return pages.filter(F.col("status_code") == 200).select(*SITE, "url", F.explode(lacking).alias("finding"))


def cache_header_summary(pages: DataFrame) -> DataFrame:
    """Per site: pages checked, without compression and without Cache-Control."""
    return pages.filter(F.col("status_code") == 200).groupBy(*SITE).agg(
        F.count(F.lit(1)).alias("pages_checked"), F.count_if(_blank("content_encoding")).alias("uncompressed"),
        F.count_if(_blank("cache_control")).alias("no_cache_control"),
    )


def content_insights(pages: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Averages over the pages of a site; empty texts and zero counts do not enter the averages."""

    def mean(value: Column, present: Column) -> Column:
        return F.bround(F.avg(F.when(present, value)), 1)

    def share(flag: str) -> Column:
        return F.bround(100 * F.count_if(F.coalesce(flag, F.lit(False))) / F.count(F.lit(1))).cast("int")

    return pages.groupBy(*(keys or SITE)).agg(
        F.count(F.lit(1)).alias("pages"),
        mean(F.col("word_count"), F.col("word_count") > 0).alias("avg_word_count"),
        mean(F.length("title"), ~_blank("title")).alias("avg_title_length"),
        mean(F.length("meta_description"), ~_blank("meta_description")).alias("avg_meta_length"),
        share("has_author").alias("has_author_pct"), share("has_date").alias("has_date_pct"),
        share("has_contact").alias("has_contact_pct"),
    )


def schema_coverage(pages: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """How often each structured-data type occurs on a site."""
    by = keys or SITE
    return pages.select(*by, F.explode("schema_types").alias("type")).groupBy(*by, "type").agg(
        F.count(F.lit(1)).alias("occurrences")
    )

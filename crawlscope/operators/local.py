"""Phone consistency and local-business data of a site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlscope.functions.text import extract_phones, normalize_phone
from crawlscope.skew import sample_text

SITE = ["project_id"]


def phone_mentions(pages: DataFrame) -> DataFrame:
    """Every distinct phone spelling on every page: project_id, phone, raw, url, from_schema."""
    stated = F.when(
        F.col("local_business_schema.telephone").isNotNull(),
        F.array(F.struct(F.col("local_business_schema.telephone").alias("raw"), F.lit(True).alias("from_schema"))),
    ).otherwise(F.array().cast("array<struct<raw:string,from_schema:boolean>>"))
    written = F.transform(extract_phones(F.col("body_text")), lambda p: F.struct(p.alias("raw"), F.lit(False).alias("from_schema")))
    rows = pages.select(*SITE, "url", F.explode(F.concat(stated, written)).alias("p")).select(*SITE, "url", "p.*")
    return rows.withColumn("phone", normalize_phone(F.col("raw"))).filter("phone <> ''").distinct()


def nap_phones(pages: DataFrame, examples: int = 10) -> DataFrame:
    """Per site and number: pages it appears on, whether structured data states it, and `examples` of its spellings.

    Counted per page first, so a number in every footer is summed before it is shuffled by number.
    """
    mentions = phone_mentions(pages)
    keys = [*SITE, "phone"]
    per_page = mentions.groupBy(*keys, "url").agg(F.bool_or("from_schema").alias("from_schema"))
    counted = per_page.groupBy(*keys).agg(F.count(F.lit(1)).alias("pages_count"), F.bool_or("from_schema").alias("from_schema"))
    spellings = mentions.select(*keys, "raw").distinct()
    named = sample_text(spellings, keys, F.col("raw"), [F.col("raw")], examples, "raw_examples")
    return counted.join(named, keys)


def phone_spellings(pages: DataFrame) -> DataFrame:
    """Every spelling of every number of a site and the pages it stands on: the long table behind `nap_phones`."""
    return phone_mentions(pages).groupBy(*SITE, "phone", "raw").agg(F.countDistinct("url").alias("pages_count"))


def nap_consistency(pages: DataFrame, phones: DataFrame) -> DataFrame:
    """Per site: distinct numbers, whether they agree, and the number on most pages.

    A site without any number has none that disagree.
    """
    counted = phones.groupBy(*SITE).agg(
        F.count(F.lit(1)).alias("phones"), F.max_by("phone", F.struct("pages_count", "phone")).alias("primary_phone")
    )
    known = pages.select(*SITE).distinct().join(counted, SITE, "left").withColumn("phones", F.coalesce("phones", F.lit(0)))
    return known.select(*SITE, "phones", (F.col("phones") <= 1).alias("is_consistent"), "primary_phone")


def local_score(pages: DataFrame) -> DataFrame:
    """100 less 40 for several numbers or 30 for none, less 30 without local-business data, not below 0."""
    schema = pages.groupBy(*SITE).agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col("local_business_schema").isNotNull()).alias("pages_with_schema")
    )
    phones = phone_mentions(pages).select(*SITE, "phone").distinct().groupBy(*SITE).agg(F.count(F.lit(1)).alias("phones"))
    known = schema.join(phones, SITE, "left").withColumn("phones", F.coalesce("phones", F.lit(0)))
    penalty = (
        F.when(F.col("phones") > 1, 40).when(F.col("phones") == 0, 30).otherwise(0)
        + F.when(F.col("pages_with_schema") == 0, 30).otherwise(0)
    )
    return known.select(
        *SITE, "phones", "pages_with_schema",
        F.bround(F.col("pages_with_schema") / F.col("pages"), 2).alias("coverage_ratio"),
        F.greatest(F.lit(0), 100 - penalty).alias("local_score"),
    )

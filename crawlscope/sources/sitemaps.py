"""Sitemaps: files as XML, or texts already landed in a column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SITE = ["project_id"]
_LOC = r"(?is)<loc(?:\s[^>]*)?>(.*?)</loc>"


def read_sitemaps(spark: SparkSession, path: str) -> DataFrame:
    """The <url> entries of sitemap files, split across tasks; folders named project_id=… give the site."""
    urls = spark.read.format("xml").option("rowTag", "url").schema("loc string").load(path)
    site = F.regexp_extract(F.col("_metadata.file_path"), r"project_id=([^/]+)", 1)
    return urls.select(site.cast("long").alias("project_id"), F.trim("loc").alias("url")).filter("url <> ''").distinct()


def sitemap_ingest(sitemaps: DataFrame) -> DataFrame:
    """project_id and url of every <loc> of url sets in `xml`, each once; index files name sitemaps, not pages."""
    bodies = sitemaps.filter(~F.col("xml").rlike(r"(?i)<sitemapindex"))
    locations = bodies.select(*SITE, F.explode(F.regexp_extract_all("xml", F.lit(_LOC), F.lit(1))).alias("loc"))
    found = locations.select(*SITE, F.regexp_replace("loc", r"^\s+|\s+$", "").alias("url"))
    plain = F.replace(F.replace("url", F.lit("&amp;"), F.lit("&")), F.lit("&apos;"), F.lit("'"))
    return found.filter("url <> ''").select(*SITE, plain.alias("url")).distinct()


def sub_sitemaps(sitemaps: DataFrame) -> DataFrame:
    """The sitemaps that index files point to."""
    index = sitemaps.filter(F.col("xml").rlike(r"(?i)<sitemapindex"))
    found = index.select(*SITE, F.explode(F.regexp_extract_all("xml", F.lit(_LOC), F.lit(1))).alias("loc"))
    return found.select(*SITE, F.regexp_replace("loc", r"^\s+|\s+$", "").alias("sitemap_url")).distinct()

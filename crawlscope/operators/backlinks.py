"""Links from other sites: project_id, source_url, source_domain, target_url, anchor_text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlscope import constants as C
from crawlscope.functions.text import is_spam_domain, strip
from crawlscope.functions.urls import canonical_url, top_level_domain
from crawlscope.operators.links import resolve
from crawlscope.skew import lookup_join

SITE = ["project_id"]


def anchor_distribution(backlinks: DataFrame) -> DataFrame:
    """How often each anchor occurs, its share, and whether it is suspiciously dominant. Brands are not exempt."""
    anchor = strip(F.coalesce(F.nullif("anchor_text", F.lit("")), F.lit(C.EMPTY_ANCHOR)))
    counts = backlinks.groupBy(*SITE, anchor.alias("anchor_text")).agg(F.count(F.lit(1)).alias("count"))
    totals = counts.groupBy(*SITE).agg(F.sum("count").alias("_total"))
    share = F.col("count") / F.col("_total")
    return counts.join(totals, SITE).select(
        *SITE, "anchor_text", "count", F.bround(share * 100, 1).alias("percentage"),
        (share > C.OVER_OPTIMIZED_SHARE).alias("over_optimized"),
    )


def toxic_backlinks(backlinks: DataFrame) -> DataFrame:
    """Links from top-level domains known for spam: a weak sign, and the reason says so."""
    reason = F.concat(F.lit("top-level domain ."), top_level_domain(F.col("source_domain")), F.lit(" is known for spam"))
    return backlinks.filter(is_spam_domain(F.col("source_domain"))).select(
        *SITE, "source_domain", "source_url", "anchor_text", reason.alias("reason")
    )


def link_reclaim(backlinks: DataFrame, closure: DataFrame, broken: DataFrame) -> DataFrame:
    """Links whose target is broken, or redirects to another page. Broken wins."""
    targets = broken.select(*SITE, canonical_url(F.col("url")).alias("_target")).distinct().withColumn("_broken", F.lit(True))
    rows = backlinks.withColumn("_target", canonical_url(F.col("target_url"))).filter("_target <> ''")
    known = resolve(lookup_join(rows, targets, [*SITE, "_target"]), "target_url", closure)
    is_broken = F.col("_broken").isNotNull()
    found = known.filter(is_broken | (F.col("final_url") != F.col("_target")))
    return found.select(
        *SITE, "source_url", "source_domain", "target_url", "anchor_text",
        F.when(is_broken, "broken").otherwise("redirects").alias("finding"),
        F.when(~is_broken, F.col("final_url")).alias("final_url"),
    )


def disavow_domains(toxic: DataFrame) -> DataFrame:
    """One row per toxic domain."""
    return toxic.groupBy(*SITE, "source_domain").agg(F.min("reason").alias("reason"))

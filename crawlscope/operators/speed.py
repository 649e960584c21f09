"""Web vitals of measured pages: project_id, date, strategy, url, lcp_ms, cls, tbt_ms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlscope import constants as C
from crawlscope.operators.issues import issue
from crawlscope.skew import counted_sample

SITE = ["project_id"]
LABELS = {"lcp_ms": "LCP", "cls": "CLS", "tbt_ms": "TBT"}


def rating(metric: str, value: Column) -> Column:
    warn, poor = C.VITALS_THRESHOLDS[metric]
    return F.when(value >= poor, "poor").when(value >= warn, "needs improvement").when(value.isNotNull(), "good")


def cwv_rating(pages: DataFrame) -> DataFrame:
    """One row per page and measured metric with its rating."""
    metrics = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), rating(m, F.col(m)).alias("rating"))
            for m in C.VITALS_THRESHOLDS
        ]
    )
    return pages.select(*SITE, "url", F.inline(metrics)).filter("rating IS NOT NULL")


def cwv_groups(pages: DataFrame) -> DataFrame:
    """Pages per metric and rating worth acting on, with five of them by url."""
    slow = cwv_rating(pages).filter(F.col("rating") != "good")
    return counted_sample(slow, [*SITE, "metric", "rating"], F.col("url"), [F.col("url")], 5).withColumnRenamed("n", "pages")


def cwv_issues(pages: DataFrame) -> DataFrame:
    groups = cwv_groups(pages)
    label = F.create_map(*[F.lit(v) for pair in LABELS.items() for v in pair])
    poor = F.col("rating") == "poor"
    title = F.concat(F.try_element_at(label, F.col("metric")), F.lit(" "), F.col("rating"), F.lit(" on "),
                     F.col("pages").cast("string"), F.lit(" pages"))
    finding = issue(F.when(poor, "high").otherwise("medium"), "performance_cwv", title, "1d",
                    F.when(poor, 4).otherwise(2), current=F.col("sample"))
    return groups.select(*SITE, finding.alias("i")).select(*SITE, "i.*")

"""Findings from search performance, and the scores of a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlscope.operators import page_rules as P
from crawlscope.operators import scores as S
from crawlscope.operators import search as Q
from crawlscope.operators.issues import ISSUE_COLUMNS
from crawlscope.operators.summaries import union
from crawlscope.session import written
from crawlscope.skew import Newest


def opportunity_findings(queries: Q.Rows, daily: DataFrame, pages: DataFrame, redirects: DataFrame | None) -> DataFrame:
    """The newest rows are looked for once, and written without the columns that no finding reads."""
    needed = ["project_id", "query", "page", "clicks", "impressions", "position"]
    queries = Newest(written(Q.current(queries).select(*needed)))
    parts = [
        Q.cannibalization(queries, redirects), Q.top10_zero_ctr(queries), Q.zero_impression_pages(pages, queries),
        Q.decay_issues(daily), Q.never_clicked_issues(queries),
    ]
    return union([p.select("project_id", *ISSUE_COLUMNS) for p in parts])


def site_scores(pages: DataFrame, history: DataFrame) -> DataFrame:
    """Technical and content score from the stored pages, the rest from its latest measurement, and their mean."""
    latest = S.latest_by_kind(history.filter(F.col("kind").isin("geo", "local"))).groupBy("project_id").agg(
        *[F.max(F.when(F.col("kind") == k, F.col("value"))).alias(f"{k}_score") for k in ("geo", "local")]
    )
    own = P.technical_score(P.from_stored(pages)).join(P.content_score(pages), "project_id", "full")
    return S.seo_score(own.join(latest, "project_id", "full"))


def score_rows(scored: DataFrame, day: Column) -> DataFrame:
    """The measured scores as history rows of `day`; what is NULL writes no row."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_score").alias("value")) for k in ("technical", "content", "seo")])
    return scored.select("project_id", day.alias("date"), F.inline(kinds)).filter("value IS NOT NULL")

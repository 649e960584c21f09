"""The tables behind a site report, for all sites at once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from crawlscope.operators import coverage as V
from crawlscope.operators import ledger as E
from crawlscope.operators import local as N
from crawlscope.operators import scores as S
from crawlscope.operators import search as Q
from crawlscope.operators import serp as R
from crawlscope.operators import speed as W
from crawlscope.session import written
from crawlscope.skew import Newest
from crawlscope.sources.landing import verdict_summary


def report_tables(
    sites: DataFrame, daily: DataFrame, queries: DataFrame, pages: DataFrame, ledger: DataFrame, scores: DataFrame,
    snapshots: DataFrame, keywords: DataFrame, listings: DataFrame, inspections: DataFrame, vitals: DataFrame, sitemap: DataFrame,
) -> dict[str, DataFrame]:
    """What several tables read, the newest rows of queries and listings, is looked for once and written."""
    queries, listed = Newest(written(Q.current(queries))), written(R.current(listings))
    return {
        "scorecards": Q.scorecards(sites, daily, queries, ledger, scores, snapshots),
        "action_plan": E.action_plan(ledger),
        "top_keywords": Q.top_queries(queries),
        "near_top10": Q.near_top10(queries),
        "keywords": Q.keywords_view(queries, keywords),
        "ctr_curve": Q.ctr_curve(queries),
        "ctr_summary": Q.ctr_summary(queries),
        "score_deltas": S.score_delta(scores),
        "local": N.local_score(pages),
        "competitors": R.discover_competitors(listed, sites),
        "rank_standing": R.keyword_standing(listed, sites),
        "vitals": W.cwv_groups(vitals),
        "index_verdicts": verdict_summary(inspections),
        "coverage": V.coverage_counts(V.coverage_base(pages, sitemap, inspections)),
    }

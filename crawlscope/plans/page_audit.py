"""A fresh crawl judged and booked: page rules, current-state pages, issue ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlscope import constants as C
from crawlscope.functions.text import flesch_huerta
from crawlscope.operators import ledger as E
from crawlscope.operators import page_rules as P
from crawlscope.session import written


def page_findings(crawl: DataFrame) -> DataFrame:
    """All findings of single pages; a shuffle happens only when they meet the ledger."""
    return P.technical_issues(crawl).unionByName(P.content_issues(crawl))


def stored_pages(crawl: DataFrame, now: Column) -> DataFrame:
    """The crawl as rows of the current-state table."""
    return crawl.withColumns(
        {
            "h1": F.nullif(F.array_join("h1_tags", " | "), F.lit("")),
            "readability_score": F.bround(flesch_huerta(F.col("body_text"))).cast("int"),
            "eeat_score": P.eeat_score().cast("int"), "last_crawled": now,
        }
    ).select(
        "project_id", "url", "status_code", "title", "meta_description", "h1", "canonical", "schema_types", "og", "word_count",
        F.col("lang_declared").alias("lang_detected"), "is_indexable", "x_robots_tag", "redirected_to", "readability_score",
        "eeat_score", "has_author", "has_date", "has_contact", "last_crawled",
    )


def book(ledger: DataFrame, found: DataFrame, categories, snapshot_id: int, now: Column, by_page: bool,
         pages: DataFrame | None = None) -> DataFrame:
    """The ledger after a run: what is gone resolved, what is new appended."""
    added = E.record_issues(ledger, found, snapshot_id, now)
    return E.reconcile_issues(ledger, found, categories, now, by_page, pages).unionByName(added.select(*ledger.columns))


def run(crawl: DataFrame, ledger: DataFrame, snapshot_id: int, now: Column) -> dict[str, DataFrame]:
    """`crawl` carries page_id. Returns the findings, the page rows to upsert and the new ledger."""
    # judged once: the ledger reads the findings twice
    keyed = written(page_findings(crawl).join(crawl.select("project_id", F.col("url").alias("page_url"), "page_id"), ["project_id", "page_url"], "left"))
    return {
        "found": keyed,
        "pages": stored_pages(crawl, now),
        "ledger": book(ledger, keyed, C.PAGE_CATEGORIES, snapshot_id, now, True, crawl.select("project_id", "page_id")),
    }

"""Coverage, links, copies, structured data and headers of a site, as tables and as findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from crawlscope.operators import coverage as V
from crawlscope.operators import links as L
from crawlscope.operators import page_rules as P
from crawlscope.operators import pages as G
from crawlscope.operators import summaries as Y
from crawlscope.operators.issues import ISSUE_COLUMNS
from crawlscope.session import written


@dataclass
class Sources:
    """What is known of the sites. Sources a site lacks stay None and are reported as unknown."""

    crawl: DataFrame
    pages: DataFrame
    homes: DataFrame
    sitemap: DataFrame | None = None
    inspections: DataFrame | None = None
    robots: DataFrame | None = None


# What is kept of a crawled page beside its place in the link graph, and of a stored page; no text of a body is among it.
CRAWL_FEATURES = ["redirected_to", "nofollow_internal", "schema_nodes", "content_encoding", "cache_control"]
PAGE_FEATURES = ["project_id", "url", "status_code", "is_indexable", "redirected_to", *G.FIELDS, "word_count"]


def tables(s: Sources, agent: str) -> dict[str, DataFrame]:
    """The tables of the analysis. Crawl and pages are read once, into features of which every table reads its own columns;
    written besides is only what takes a shuffle and is read more than once."""
    crawl = written(L.link_records(s.crawl, CRAWL_FEATURES))
    pages = written(s.pages.select(*PAGE_FEATURES))
    redirects = written(L.redirect_map_merge(L.redirect_edges(pages), L.redirect_edges(crawl)))
    own = written(G.own_pages(pages, redirects))
    base = written(V.coverage_base(crawl, s.sitemap, s.inspections))
    links = L.out_links(crawl)
    inbound = written(L.inbound_counts(crawl, links))
    found = {
        "orphans": written(L.orphans(crawl, s.homes, links, inbound)), "broken": V.broken_pages(crawl), "redirects": V.redirect_links(crawl),
        "coverage_counts": V.coverage_counts(base), "coverage_diff": written(V.coverage_diff(base)),
        "links": written(L.link_table(crawl, s.homes, links, inbound)), "nofollow": L.nofollow_pages(crawl),
        "duplicates": written(G.duplicate_field(own)), "thin": G.thin_content(own),
        "schema_groups": P.schema_groups(crawl), "cache_findings": G.cache_header_findings(crawl), "cache_summary": G.cache_header_summary(crawl),
    }
    if s.robots is not None and s.sitemap is not None:
        found["robots_conflicts"] = written(V.robots_sitemap_conflicts(s.sitemap, s.robots, agent))
    return found


def findings(t: dict[str, DataFrame]) -> DataFrame:
    parts = [
        Y.coverage_issues(t["orphans"], t["broken"], t["redirects"], t["coverage_diff"]), Y.link_issues(t["links"], t["nofollow"]),
        Y.duplicate_issues(t["duplicates"], t["thin"]), Y.schema_issues(t["schema_groups"]),
        Y.cache_issues(t["cache_findings"], t["cache_summary"]),
    ]
    if "robots_conflicts" in t:
        parts.append(Y.robots_issues(t["robots_conflicts"]))
    return Y.union([p.select("project_id", *ISSUE_COLUMNS) for p in parts])

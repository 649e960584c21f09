"""Every operator as a named query over the given tables."""


def all_queries() -> dict:
    from crawlscope.catalog import (  # noqa: F401
        audit_queries, graph_queries, ingest_queries, ledger_queries, market_queries, search_queries, text_queries,
    )
    from crawlscope.catalog.registry import QUERIES

    return QUERIES

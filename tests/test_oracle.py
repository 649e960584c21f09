"""Every registered query against its SQL on the smallest data, and what no plan may contain."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from crawlscope.catalog import all_queries

SF_DIR = "/root/testdata/sf0.001"
QUERIES = {n: q for n, q in entry.queries().items() if n in all_queries()}
ORACLES = {n: q for n, q in entry.oracle_sql().items() if n in QUERIES}
# Queries that read HTML, robots.txt or payloads cut over many tasks; all others stay in the JVM.
READS_TEXT_IN_PYTHON = set((
    "agent_matrix competitor_comparison crawl_pages duplicate_titles_html eeat_signals_html extract_links extract_page_features "
    "extract_page_features_markup geo_issues geo_score jsonld keyword_gap latest_crawl_pages robots_issues robots_rules "
    "robots_sitemap_conflicts technical_audit_html").split())


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    ok, message = compare(spark, SF_DIR, duck, QUERIES[name], ORACLES.get(name))
    assert ok, message


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_has_no_product_and_no_needless_python(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert ("InPandas" in plan or "Python" in plan) == (name in READS_TEXT_IN_PYTHON)


def test_entry(spark):
    assert entry.entry(spark).count() > 0

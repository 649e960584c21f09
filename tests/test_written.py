"""Costly rows that several findings read are found once."""

import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"


def test_reclaimed_links_are_found_once(spark):
    found = entry.queries()["reclaim_issues"](spark, SF_DIR)
    assert not [f for f in found.inputFiles() if "/orders.parquet" in f]


@pytest.mark.parametrize(("name", "table"), [
    ("record_issues", "part"), ("serp_issues", "lineitem"), ("robots_issues", "lineitem"),
    ("zero_impression_pages_canonical", "lineitem"),
])
def test_what_is_read_several_times_is_built_once(spark, name, table):
    found = entry.queries()[name](spark, SF_DIR)
    assert not [f for f in found.inputFiles() if f"/{table}.parquet" in f]


def test_an_audit_judges_its_pages_once(spark):
    plan = entry.queries()["page_audit_run"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("/part.parquet") == 1  # the crawled pages' numbers


@pytest.mark.parametrize("name", ["inbound_counts", "coverage_issues", "weak_pages"])
def test_links_of_a_page_are_read_once(spark, name):
    found = entry.queries()[name](spark, SF_DIR)
    assert not [f for f in found.inputFiles() if "/lineitem.parquet" in f]

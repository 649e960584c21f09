"""Tables of few megabytes that many tasks must share."""

import pytest

import __spark_entry__ as entry
from crawlscope.catalog.fixtures import load

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_are_built_by_more_tasks_than_their_file_has_splits(spark):
    assert "REPARTITION_BY_COL" in plan_of(load(spark, SF_DIR, "crawl_flat"))
    assert load(spark, SF_DIR, "shop_pages").count() == load(spark, SF_DIR, "part").count()


@pytest.mark.parametrize("name", ["jsonld", "extract_page_features_markup"])
def test_markup_is_read_after_its_rows_are_dealt(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF_DIR))
    assert plan.index("MapInPandas") < plan.index("REPARTITION_BY_COL")  # upper lines come later


def test_only_the_heaviest_groups_of_copies_are_broadcast(spark):
    plan = plan_of(entry.queries()["duplicate_members"](spark, SF_DIR))
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" in plan


def test_places_of_a_pack_are_not_sorted_as_rows(spark):
    assert "posexplode" not in plan_of(entry.queries()["local_pack_ingest"](spark, SF_DIR))

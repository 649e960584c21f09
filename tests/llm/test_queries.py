"""The registered queries against their SQL, and the pipeline over the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from crawlscope.llm.common import stored
from crawlscope.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, SF_DIR).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_entry_registers_every_operator():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} and "pipeline" in names
    assert set(ORACLES) <= set(entry.oracle_sql())


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows, columns = docs.count(), docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stored(stage(spark, docs, SF_DIR))
        assert docs.count() > 0
        if i < 3:
            assert docs.columns == columns and docs.count() <= rows
            rows = docs.count()
    assert {"doc_id", "sequence_id", "offset"} <= set(docs.columns)


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF_DIR))
        assert docs.count() == 0

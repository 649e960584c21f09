"""From raw documents to packed training sequences: five stages, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlscope.llm.common import WRITTEN, dropped, stored
from crawlscope.llm.mixing import resample
from crawlscope.llm.ngram_join import keep_one
from crawlscope.llm.packing import pack_documents
from crawlscope.llm.substrings import without_repeats
from crawlscope.llm.toxicity import without_toxic
from crawlscope.session import tune


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network does not reject; it is fitted on the labelled ones among them."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more on five-word shingles."""
    return keep_one(docs, width=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that another document keeps; n_chars follows the text."""
    cut = without_repeats(docs)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        cut = cut.withColumn("n_chars", F.when(F.col("removed_words") > 0, length).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: not at all, once or twice."""
    return resample(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    return pack_documents(docs)


# What the stage called last has written for itself.
_LAST: list[str] = []


def _alone(stage):
    """`stage`, after deleting what the stage before wrote for itself: that one's rows have been written in full since."""
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        tune(spark)
        dropped(spark, _LAST)
        before = len(WRITTEN)
        rows = stage(spark, docs, sf_dir)
        _LAST[:] = WRITTEN[before:]
        return rows

    return call


_FUNCTIONS = (toxicity, ngram_jaccard, substring_dedup, mixing, packing)
STAGES = [(f.__name__, _alone(f)) for f in _FUNCTIONS]

# Networks, hashes and packing have no SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's rows written as Parquet to the shared folder and read by the next.

    A run's result is to be written or collected before the next run begins, which deletes what the last stage wrote for itself.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs

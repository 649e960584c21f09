"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlscope.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
# Rows that one numbering task sorts on average.
BLOCK_ROWS = 4096


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which the driver and all executors reach."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        cut_lineage(spark.range(1))  # sets the folder, or refuses on a cluster without one
    return context.getCheckpointDir()


# Folders written by `stored` in this process, in order.
WRITTEN: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: lineage is cut, lost executors lose nothing."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete folders that `stored` has written, once nothing reads them any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_words(text: str | None) -> list[bytes]:
    """Lower-case A-Z, then the words between ASCII white space. Exactly WORD: bytes.split knows no other white space."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, rows: int | None = None) -> DataFrame:
    """Number the rows of each key from 0 without gaps, in blocks: no task holds all rows of a heavy key.

    Rows are hashed to blocks of about BLOCK_ROWS; counts of the blocks before give each block its first number.
    Within a block `order` decides, so equal inputs get equal numbers.
    """
    if rows is None:
        rows = df.count()
    blocks = max(1, -(-rows // BLOCK_ROWS))
    cut = df.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    at = [*keys, "_block"]
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    first = cut.groupBy(*at).agg(F.count(F.lit(1)).alias("_n")).select(*at, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inner = Window.partitionBy(*at).orderBy(*order)
    return (
        cut.withColumn("_rank", F.row_number().over(inner)).join(first, at)
        .withColumn(name, (F.col("_first") + F.col("_rank") - 1).cast("long")).drop("_block", "_rank", "_first")
    )


def whole_groups(frames: Iterable[pd.DataFrame], key: str | list[str]) -> Iterator[pd.DataFrame]:
    """Cut a sorted stream of frames so that each yielded frame holds whole runs of `key`; for bounded runs only."""
    keys = [key] if isinstance(key, str) else key
    rest: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        last = (frame[keys] != frame[keys].iloc[-1]).any(axis=1).to_numpy()
        cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
        if rest and not (rest[-1][keys].iloc[-1] == frame[keys].iloc[0]).all():
            yield pd.concat(rest, ignore_index=True)
            rest = []
        if cut:
            yield pd.concat([*rest, frame.iloc[:cut]], ignore_index=True)
            rest = []
        rest.append(frame.iloc[cut:])
    if rest:
        yield pd.concat(rest, ignore_index=True)


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 64) -> DataFrame:
    """(node, component) for every end of a link: the smallest node that links reach.

    Each round hangs every node's neighbours under the smallest neighbour and follows labels twice, so a chain shortens
    by half or more; the driver sees one number per round. Nodes and labels are written after each round.
    """
    both = links.filter(F.col(a) != F.col(b)).select(F.col(a).alias("x"), F.col(b).alias("y"))
    edges = stored(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    label = stored(edges.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("c")).select(F.col("x").alias("node"), "c"))
    for _ in range(rounds):
        near = edges.join(label, edges["y"] == label["node"]).groupBy("x").agg(F.min("c").alias("m"))
        least = label.join(near, label["node"] == near["x"]).select("node", "c", F.least("c", "m").alias("m"))
        # what a node's old label learns from its members, then the label of the label
        roots = least.groupBy("c").agg(F.min("m").alias("r")).withColumnRenamed("c", "root")
        hooked = stored(least.join(roots, least["c"] == roots["root"]).select("node", F.col("c").alias("old"), F.least("m", "r").alias("c")))
        jump = hooked.select(F.col("node").alias("j"), F.col("c").alias("cj"))
        new = stored(hooked.join(jump, hooked["c"] == jump["j"], "left").select("node", "old", F.coalesce(F.least("c", "cj"), "c").alias("c")))
        changed = new.filter(F.col("c") != F.col("old")).limit(1).count()
        label = new.select("node", "c")
        if not changed:
            break
    else:
        raise RuntimeError(f"links still change after {rounds} rounds")
    return label.select("node", F.col("c").alias("component"))

"""Landed payloads into current tables: landing a window twice, or overlapping ones, gives every key once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlscope.operators.ledger import upsert
from crawlscope.sources import landing as I

# What names a row of each source.
KEYS = {
    "gsc_daily": (I.gsc_daily_ingest, ["project_id", "date"]),
    "gsc_queries": (I.gsc_queries_ingest, ["project_id", "date", "query", "page"]),
    "export_daily": (I.export_daily, ["project_slug", "date"]),
    "export_queries": (I.export_queries, ["project_slug", "date", "query", "page"]),
    "indexation": (I.indexation_ingest, ["project_id", "url"]),
    "trends": (I.trends_ingest, ["project_id", "keyword"]),
    "related_queries": (I.related_queries_ingest, ["project_id", "seed_keyword", "relation", "keyword"]),
    "backlinks": (I.backlinks_ingest, ["project_id", "source_url", "target_url"]),
}


def ingest(source: str, landing: DataFrame, current: DataFrame | None = None, snapshot: str = "snapshot_id") -> DataFrame:
    """The rows of all payloads of `landing`, each key as its latest snapshot says, written over `current` where given.

    `landing` is one row per payload with the site, the payload and the number of its `snapshot`. Of equal keys in one
    payload the greatest row counts.
    """
    read, keys = KEYS[source]
    return latest_of(read, keys, landing, current, snapshot)


def latest_of(read: Callable[[DataFrame], DataFrame], keys: Sequence[str], landing: DataFrame, current: DataFrame | None, snapshot: str) -> DataFrame:
    site = keys[0]
    # readers carry the site column along as it is, and so the snapshot with it
    rows = read(landing.withColumn(site, F.struct(F.col(site).alias("site"), F.col(snapshot).alias("snapshot"))))
    rows = rows.withColumns({"_snapshot": F.col(f"{site}.snapshot"), site: F.col(f"{site}.site")})
    values = [c for c in rows.columns if c not in keys and c != "_snapshot"]
    # partial sums keep one row per key in each task, so a window landed many times is not shuffled as often
    last = rows.groupBy(*keys).agg(F.max(F.struct("_snapshot", *values)).alias("_last"))
    latest = last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in values]).select(*[c for c in rows.columns if c != "_snapshot"])
    return latest if current is None else upsert(current, latest, keys)

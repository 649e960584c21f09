"""The issue ledger and other current-state tables: applying the same run twice changes nothing.

`ledger` is project_id, page_id (NULL for site-wide findings), snapshot_id, severity, category, title,
current_text, suggested_text, effort, impact, status, detected_at, resolved_at. `found` has the columns of
`operators.issues` and page_id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlscope import constants as C
from crawlscope.operators.issues import effort_rank
from crawlscope.skew import first_k, lookup_join

SITE = ["project_id"]
ISSUE_KEY = ["project_id", "category", "title"]


# --- current-state tables ----------------------------------------------------------------------------


def upsert(
    current: DataFrame, updates: DataFrame, keys: Sequence[str], keep: Sequence[str] = (), order: str | None = None
) -> DataFrame:
    """`current` with `updates` written over it by natural key; columns in `keep` survive once they are set.

    Of several updates of one key the one with the highest `order` wins. Columns the updates do not carry stay.
    """
    values = [c for c in current.columns if c not in keys]
    brought = [c for c in updates.columns if c not in keys and c in values]
    last = updates.groupBy(*keys).agg(
        F.max_by(F.struct(*brought), F.col(order) if order else F.struct(*brought)).alias("_new")
    )
    old = current.select(*keys, F.struct(*values).alias("_old"))

    def merged(name: str) -> Column:
        if name not in brought:
            return F.col(f"_old.{name}")
        if name in keep:
            return F.coalesce(f"_old.{name}", f"_new.{name}")
        return F.when(F.col("_new").isNotNull(), F.col(f"_new.{name}")).otherwise(F.col(f"_old.{name}"))

    return old.join(last, list(keys), "full").select(*keys, *[merged(c).alias(c) for c in values]).select(*current.columns)


def pages_upsert(current: DataFrame, crawled: DataFrame) -> DataFrame:
    """Current pages with a fresh crawl written over them; first_seen is set once, old urls stay."""
    fresh = crawled.withColumn("first_seen", F.col("last_crawled"))
    return upsert(current, fresh, ["project_id", "url"], keep=["first_seen"], order="last_crawled")


def replace_slice(current: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whole slices replaced: every key present in `updates` loses its old rows first."""
    touched = updates.select(*keys).distinct()
    return current.join(touched, list(keys), "left_anti").unionByName(updates.select(*current.columns))


def set_issue_status(ledger: DataFrame, changes: DataFrame) -> DataFrame:
    """Manual status changes (issue_id, status, changed_at); reopening clears the time of resolution."""
    stamped = changes.groupBy("issue_id").agg(F.max_by(F.struct("status", "changed_at"), "changed_at").alias("_c"))
    joined = ledger.join(stamped, ["issue_id"], "left")
    touched = F.col("_c").isNotNull()
    return joined.select(
        *[
            F.when(touched, F.col("_c.status")).otherwise(F.col("status")).alias("status") if c == "status"
            else F.when(touched, F.when(F.col("_c.status") != "open", F.col("_c.changed_at"))).otherwise(F.col(c)).alias(c)
            if c == "resolved_at" else F.col(c)
            for c in ledger.columns
        ]
    )


# --- findings ----------------------------------------------------------------------------------------


def record_issues(ledger: DataFrame, found: DataFrame, snapshot_id: int, now: Column) -> DataFrame:
    """The rows to append: findings without an open row of the same site, category and title.

    Closed ones come back as new rows.
    """
    shared = [c for c in found.columns if c in ledger.columns and c not in ISSUE_KEY]
    once = found.groupBy(*ISSUE_KEY).agg(F.min(F.struct(*shared)).alias("_row")).select(*ISSUE_KEY, "_row.*")
    opened = ledger.filter(F.col("status") == "open").select(*ISSUE_KEY)
    return once.join(opened, ISSUE_KEY, "left_anti").withColumns(
        {
            "snapshot_id": F.lit(snapshot_id).cast("long"), "status": F.lit("open"), "detected_at": now,
            "resolved_at": F.lit(None).cast("timestamp"),
        }
    )


def reconcile_issues(
    ledger: DataFrame, found: DataFrame, categories: Sequence[str], now: Column, by_page: bool,
    pages: DataFrame | None = None,
) -> DataFrame:
    """The ledger with open findings that the fresh analysis no longer reports marked resolved.

    Page scope touches only rows of the analysed `pages` (project_id, page_id); site scope only rows
    without a page. Both touch only the categories the analysis owns.
    """
    key = [*ISSUE_KEY, "page_id"] if by_page else ISSUE_KEY
    fresh = found.select(*key).distinct().withColumn("_fresh", F.lit(True))
    owned = (F.col("status") == "open") & F.col("category").isin(list(categories))
    scope = F.col("page_id").isNotNull() if by_page else F.col("page_id").isNull()
    joined = ledger.join(fresh, key, "left")
    if by_page and pages is not None:
        joined = lookup_join(joined, pages.select(*SITE, "page_id").distinct().withColumn("_seen", F.lit(True)), [*SITE, "page_id"])
        scope = scope & F.col("_seen").isNotNull()
    gone = owned & scope & F.col("_fresh").isNull()
    return joined.withColumns(
        {
            "status": F.when(gone, F.lit("resolved")).otherwise(F.col("status")),
            "resolved_at": F.when(gone, now).otherwise(F.col("resolved_at")),
        }
    ).select(*ledger.columns)


def new_critical_issues(ledger: DataFrame, runs: DataFrame) -> DataFrame:
    """Open critical rows created by one of the runs (project_id, snapshot_id)."""
    critical = ledger.filter((F.col("status") == "open") & (F.col("severity") == "critical"))
    return critical.join(runs.select(*SITE, "snapshot_id").distinct(), [*SITE, "snapshot_id"], "left_semi")


# --- plan --------------------------------------------------------------------------------------------


def action_plan(ledger: DataFrame) -> DataFrame:
    """Open findings with their rank: impact first, then effort, within severity. Equals share a rank.

    Ranks come from counting the few (impact, effort) classes of a site, so its rows are never gathered.
    """
    opened = ledger.filter(F.col("status") == "open").withColumns(
        {"effort": F.coalesce("effort", F.lit("1h")), "impact": F.coalesce("impact", F.lit(3))}
    ).withColumn("effort_rank", effort_rank(F.col("effort")))
    group, klass = [*SITE, "severity"], [*SITE, "severity", "impact", "effort_rank"]
    sizes = opened.groupBy(*klass).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy(F.col("impact").desc(), F.col("effort_rank")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    ranks = sizes.withColumn("priority_rank", F.coalesce(F.sum("_n").over(before), F.lit(0)) + 1)
    return lookup_join(opened, ranks, klass, weight="_n")


def top_issues(ledger: DataFrame, k: int = 10) -> DataFrame:
    opened = ledger.filter(F.col("status") == "open")
    return first_k(opened, SITE, [F.col("impact").desc(), F.col("category"), F.col("title")], k, "rank")


def severity_counts(ledger: DataFrame) -> DataFrame:
    opened = ledger.filter(F.col("status") == "open")
    return opened.groupBy(*SITE).agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in C.SEVERITIES]
    )

"""Query and page performance.

`queries` is project_id, date, query, page, clicks, impressions, position; `daily` the same per day without
query and page. Operators over "the current state" read the newest date of each site: of a DataFrame by aggregation, of a
`sinks.current.History` from the folders of these dates, and a `skew.Newest` holds just these rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlscope import constants as C
from crawlscope.functions import text as T
from crawlscope.functions.urls import canonical_url
from crawlscope.operators.issues import issue
from crawlscope.session import written
from crawlscope.sinks.current import History
from crawlscope.skew import Newest, counted_sample, first_k, latest_rows, lookup_join, sample_text

SITE = ["project_id"]
Rows = DataFrame | Newest | History


def current(queries: Rows) -> DataFrame:
    return latest_rows(queries, SITE, "date") if isinstance(queries, DataFrame) else queries.current()


# --- totals ------------------------------------------------------------------------------------------


def totals_last_n_days(daily: DataFrame, days: int = 28) -> DataFrame:
    """Clicks, impressions and plain mean position of the last `days` days, counted back from the newest row."""
    newest = daily.groupBy(*SITE).agg(F.max("date").alias("newest"), F.count(F.lit(1)).alias("_n"))
    recent = lookup_join(daily, newest, SITE, weight="_n", how="inner").filter(
        F.col("date") > F.date_sub("newest", days)
    )
    return recent.groupBy(*SITE).agg(
        F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.avg("position").alias("avg_position")
    )


def scorecards(
    sites: DataFrame, daily: DataFrame, queries: Rows, issues: DataFrame, scores: DataFrame, snapshots: DataFrame,
    measured: DataFrame | None = None,
) -> DataFrame:
    """One dashboard row per site; what was never measured stays NULL, counts of nothing are 0.

    Scores are the latest of the history, or those of `measured` (project_id and *_score), freshly computed.
    """
    from crawlscope.operators.scores import latest_by_kind, score_delta

    totals = totals_last_n_days(daily)
    ranked = current(queries).select(*SITE, "query").distinct().groupBy(*SITE).agg(F.count(F.lit(1)).alias("keywords_ranking"))
    opened = issues.filter(F.col("status") == "open").groupBy(*SITE).agg(
        F.count(F.lit(1)).alias("issues_open"), F.count_if(F.col("severity") == "critical").alias("issues_critical")
    )
    values = measured if measured is not None else latest_by_kind(scores).groupBy(*SITE).agg(
        *[F.max(F.when(F.col("kind") == k, F.col("value"))).alias(f"{k}_score") for k in C.SCORE_LABELS]
    )
    change = score_delta(scores).filter(F.col("kind") == "seo").select(*SITE, F.col("delta").alias("seo_score_delta"))
    last_run = snapshots.groupBy(*SITE).agg(F.max_by("finished_at", "snapshot_id").alias("last_snapshot_at"))
    joined = sites.select(*SITE)
    for part in (totals, ranked, opened, values, change, last_run):
        joined = joined.join(part, SITE, "left")
    clicks, shown = F.coalesce("clicks", F.lit(0)), F.coalesce("impressions", F.lit(0))
    return joined.select(
        *SITE,
        *[F.col(f"{k}_score") for k in C.SCORE_LABELS], "seo_score_delta",
        clicks.alias("clicks_28d"), shown.alias("impressions_28d"),
        F.coalesce(F.bround(F.try_divide(clicks, shown), 4), F.lit(0.0)).alias("ctr_28d"),
        F.bround("avg_position", 2).alias("avg_position_28d"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("keywords_ranking", "issues_open", "issues_critical")],
        "last_snapshot_at",
    )


# --- click-through -----------------------------------------------------------------------------------


def ctr_curve(queries: Rows) -> DataFrame:
    """Click-through per position bucket; buckets without keywords do not appear."""
    bucketed = current(queries).withColumn("bucket", T.position_bucket(F.col("position"))).filter("bucket IS NOT NULL")
    clicks, shown = F.sum("clicks"), F.sum("impressions")
    return bucketed.groupBy(*SITE, "bucket").agg(
        F.count(F.lit(1)).alias("keywords"), shown.alias("impressions"), clicks.alias("clicks"),
        F.bround(F.try_divide(clicks, shown), 4).alias("ctr"),
    )


def ctr_summary(queries: Rows, min_clicks: int = C.RELIABLE_CLICKS) -> DataFrame:
    """Site totals and whether the clicks suffice to judge; without impressions the rate is NULL."""
    clicks, shown = F.sum("clicks"), F.sum("impressions")
    summed = current(queries).groupBy(*SITE).agg(
        clicks.alias("total_clicks"), shown.alias("total_impressions"),
        F.bround(F.try_divide(clicks, shown), 4).alias("site_ctr"), (clicks >= min_clicks).alias("reliable"),
    )
    note = F.concat(
        F.lit("Only "), F.col("total_clicks").cast("string"), F.lit(f" clicks loaded, {min_clicks} needed to compare keywords")
    )
    return summed.withColumn("note", F.when(~F.col("reliable"), note))


def never_clicked(queries: Rows, min_impressions: int = C.NEVER_CLICKED_IMPRESSIONS) -> DataFrame:
    return current(queries).filter(
        (F.col("position") <= 10) & (F.col("impressions") >= min_impressions) & (F.coalesce("clicks", F.lit(0)) == 0)
    ).select(*SITE, "query", "page", F.bround("position", 1).alias("position"), "impressions")


def top10_zero_ctr(queries: Rows, min_impressions: int = C.ZERO_CTR_IMPRESSIONS) -> DataFrame:
    """A finding per first-page query that is shown and never clicked."""
    shown = current(queries).filter(
        (F.col("position") <= 10) & (F.col("clicks") == 0) & (F.col("impressions") >= min_impressions)
    )
    title = F.concat(
        F.lit("'"), F.col("query"), F.lit("': position "), F.bround("position", 1).cast("string"), F.lit(", "),
        F.col("impressions").cast("string"), F.lit(" impressions, 0 clicks"),
    )
    return shown.select(*SITE, issue("high", "meta", title, "5min", 5, F.nullif("page", F.lit(""))).alias("i")).select(
        *SITE, "i.*"
    )


# --- lists -------------------------------------------------------------------------------------------


def _by_impressions() -> list[Column]:
    return [F.col("impressions").desc(), F.col("query").asc(), F.col("page").asc_nulls_first()]


def rankings_filter(
    queries: Rows, contains: str | None = None, min_position: float | None = None,
    max_position: float | None = None,
) -> DataFrame:
    """All current rows matching a part of the query and a position range; `top_rows` limits them."""
    rows = current(queries)
    if contains:
        pattern = contains.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
        rows = rows.filter(F.col("query").ilike(f"%{pattern}%"))
    if min_position is not None:
        rows = rows.filter(F.col("position") >= min_position)
    if max_position is not None:
        rows = rows.filter(F.col("position") <= max_position)
    return rows


def top_rows(rows: DataFrame, k: int) -> DataFrame:
    return first_k(rows, SITE, _by_impressions(), k, "rank")


def near_top10(queries: Rows, k: int = 5) -> DataFrame:
    second_page = current(queries).filter((F.col("position") > 10) & (F.col("position") <= 20))
    return top_rows(second_page, k)


def top_queries(queries: Rows, k: int = 10) -> DataFrame:
    return top_rows(current(queries), k)


def top_keywords(queries: Rows, k: int, brands: DataFrame | None = None) -> DataFrame:
    """The k most shown distinct queries. With `brands` (project_id, name) queries naming the brand are left out."""
    distinct = current(queries).groupBy(*SITE, "query").agg(F.max("impressions").alias("impressions"))
    if brands is not None:
        tokens = F.filter(
            F.split(T.strip_accents(F.lower("name")), r"(?U)\s+"), lambda t: F.length(t) > 2
        )
        named = lookup_join(distinct, brands.select(*SITE, tokens.alias("_tokens")), SITE)
        plain = T.strip_accents(F.lower("query"))
        hit = F.exists("_tokens", lambda t: F.contains(plain, t))
        distinct = named.filter(~F.coalesce(hit, F.lit(False))).drop("_tokens")
    return first_k(distinct, SITE, [F.col("impressions").desc(), F.col("query")], k, "rank")


def speed_targets(queries: Rows, sites: DataFrame, max_pages: int = 6) -> DataFrame:
    """The home page and the most shown pages of each site, one url per canonical page, whose spellings are summed first."""
    per_page = current(queries).filter(F.coalesce("page", F.lit("")) != "").groupBy(*SITE, "page").agg(F.sum("impressions").alias("_n"))
    shown = per_page.withColumn("_canonical", canonical_url(F.col("page"))).groupBy(*SITE, "_canonical").agg(
        F.sum("_n").alias("_n"), F.min(F.struct(-F.col("_n"), "page")).alias("_best")
    )
    home = sites.select(*SITE, canonical_url(F.col("url")).alias("_canonical"), F.col("url").alias("page"), F.lit(0).alias("_tier"), F.lit(0).cast("long").alias("_n"))
    listed = home.unionByName(shown.select(*SITE, "_canonical", "_best.page", F.lit(1).alias("_tier"), (-F.col("_n")).alias("_n")))
    once = listed.groupBy(*SITE, "_canonical").agg(F.min(F.struct("_tier", "_n", "page")).alias("_first"))
    return first_k(once.select(*SITE, "_first.*"), SITE, [F.col("_tier"), F.col("_n"), F.col("page")], max_pages, "rank").select(
        *SITE, "rank", F.col("page").alias("url")
    )


def merged_keyword_list(queries: Rows, keywords: DataFrame, k: int) -> DataFrame:
    """Own queries by impressions, then related-search ideas, each keyword once."""
    own = current(queries).groupBy(*SITE, "query").agg(F.max("impressions").alias("_shown"))
    own = own.select(*SITE, F.col("query").alias("keyword"), F.lit(0).alias("_tier"), "_shown")
    ideas = keywords.filter(F.col("source") == "trends_related").select(
        *SITE, "keyword", F.lit(1).alias("_tier"), F.lit(0).cast("long").alias("_shown")
    )
    both = own.unionByName(ideas).filter(F.coalesce("keyword", F.lit("")) != "")
    once = both.groupBy(*SITE, "keyword").agg(F.min(F.struct("_tier", -F.col("_shown"))).alias("_place"))
    return first_k(once, SITE, [F.col("_place"), F.col("keyword")], k, "rank").drop("_place")


def keywords_view(queries: Rows, keywords: DataFrame) -> DataFrame:
    """Current rows with the trend volume of their query and its intent, whatever source gave it."""
    newest = F.struct("last_updated", "source")
    volume = keywords.filter(F.col("source") == "trends").groupBy(*SITE, F.col("keyword").alias("query")).agg(
        F.max_by("volume", newest).alias("trend_volume")
    )
    intent = keywords.filter(F.coalesce("intent", F.lit("")) != "").groupBy(*SITE, F.col("keyword").alias("query")).agg(
        F.max_by("intent", newest).alias("intent")
    )
    dims = volume.join(intent, [*SITE, "query"], "full")
    return lookup_join(current(queries), dims, [*SITE, "query"]).select(
        *SITE, "query", "page", "position", "clicks", "impressions", "trend_volume", "intent"
    )


# --- pages against queries ---------------------------------------------------------------------------


def zero_impression_pages(pages: DataFrame, queries: Rows, canonical: bool = False) -> DataFrame:
    """A low-weight finding per indexable page that no current query shows. Urls must match exactly by default."""
    key = canonical_url if canonical else (lambda c: c)
    per_page = current(queries).filter(F.coalesce("page", F.lit("")) != "").groupBy(*SITE, "page").agg(F.sum("impressions").alias("_n"))
    # a page's queries are summed before its url is read
    shown = per_page.groupBy(*SITE, key(F.col("page")).alias("_key")).agg(F.sum("_n").alias("_shown"))
    indexable = pages.filter(F.coalesce("is_indexable", F.lit(True))).select(*SITE, "url", key(F.col("url")).alias("_key"))
    silent = indexable.join(shown, [*SITE, "_key"], "left").filter(F.coalesce("_shown", F.lit(0)) == 0)
    title = F.concat("url", F.lit(": no impressions in the loaded window"))
    finding = issue("medium", "pruning", title, "1h", 1, F.col("url"),
                    suggested="Check the full window before removing anything")
    return silent.select(*SITE, finding.alias("i")).select(*SITE, "i.*")


def _pages_of_queries(queries: Rows, redirects: DataFrame | None) -> DataFrame:
    """One row per query and final page, written: what competes is counted and listed from it."""
    rows = current(queries).filter(F.coalesce("page", F.lit("")) != "").withColumn("_source", canonical_url(F.col("page")))
    if redirects is not None:
        finals = redirects.select(*SITE, F.col("source").alias("_source"), F.col("final").alias("_final"))
        rows = lookup_join(rows, finals, [*SITE, "_source"])
        rows = rows.withColumn("_source", F.coalesce("_final", "_source"))
    return written(rows.groupBy(*SITE, "query", F.col("_source").alias("final_page")).agg(
        F.min(F.struct("position", "page")).alias("_best"), F.sum("impressions").alias("impressions")
    ))


def cannibal_pages(queries: Rows, redirects: DataFrame | None = None) -> DataFrame:
    """One row per query and final page, for queries on which two pages or more compete."""
    per_page = _pages_of_queries(queries, redirects)
    counted = per_page.groupBy(*SITE, "query").agg(F.count(F.lit(1)).alias("pages"), F.count(F.lit(1)).alias("_n"))
    rivals = counted.filter(F.col("pages") >= 2)
    return lookup_join(per_page, rivals, [*SITE, "query"], weight="_n", how="inner").select(
        *SITE, "query", "final_page", "pages", "_best.position", "_best.page", "impressions"
    )


def cannibalization(queries: Rows, redirects: DataFrame | None = None, listed: int = 20) -> DataFrame:
    """A finding per query on which pages compete; `listed` of them by name, all counted (`cannibal_pages` has all of them).

    The names come from a top-k of each query's pages in two steps, so neither a query's pages nor their names are gathered.
    """
    rows = _pages_of_queries(queries, redirects)
    keys = [*SITE, "query"]
    grouped = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pages"), F.sum("impressions").alias("impressions"),
        F.count_if(F.col("_best.position") <= 20).alias("_top20"), F.min("_best").alias("_best"),
    ).filter("pages >= 2")
    named = sample_text(rows.select(*keys, "final_page"), keys, F.col("final_page"), [F.col("final_page")], listed, "page_list")
    severity = F.when(F.col("_top20") >= 2, "critical").otherwise("high")
    title = F.concat(
        F.lit("'"), F.col("query"), F.lit("': "), F.col("pages").cast("string"), F.lit(" pages compete ("),
        F.col("impressions").cast("string"), F.lit(" impressions together)"),
    )
    suggested = F.concat(
        F.lit("Consolidate on "), F.col("_best.page"), F.lit(" (position "),
        F.bround("_best.position", 1).cast("string"), F.lit(")"),
    )
    finding = issue(severity, "cannibalization", title, "1d", F.when(F.col("_top20") >= 2, 4).otherwise(3),
                    F.col("_best.page"), F.col("page_list"), suggested)
    return grouped.join(named, keys).select(*keys, finding.alias("i")).select(*keys, "i.*")


# --- decay -------------------------------------------------------------------------------------------


def content_decay(daily: DataFrame, min_days: int = C.DECAY_MIN_DAYS) -> DataFrame:
    """Per site: average clicks of the older and newer half of its days, and the drop or why there is none.

    A site has one row per day, so its window holds at most the days of its history.
    """
    by_day = Window.partitionBy(*SITE).orderBy("date")
    older = F.col("_row") <= F.floor(F.col("_days") / 2)
    halves = (
        daily.select(*SITE, "date", "clicks")
        .withColumn("_row", F.row_number().over(by_day))
        .withColumn("_days", F.count(F.lit(1)).over(Window.partitionBy(*SITE)))
        .groupBy(*SITE)
        .agg(
            F.max("_days").alias("days"),
            F.avg(F.when(older, F.col("clicks"))).alias("older_avg"),
            F.avg(F.when(~older, F.col("clicks"))).alias("recent_avg"),
        )
    )
    drop = F.try_divide(F.col("older_avg") - F.col("recent_avg"), F.col("older_avg"))
    enough = F.col("days") >= min_days
    reason = F.when(~enough, f"fewer than {min_days} days loaded").when(
        F.col("older_avg") == 0, "no clicks in the older half"
    )
    measured = halves.withColumn("reason", reason).withColumn("drop_share", F.when(F.col("reason").isNull(), drop))
    return measured.withColumn("decayed", F.coalesce(F.col("drop_share") > C.DECAY_DROP, F.lit(False)))


def decay_issues(daily: DataFrame) -> DataFrame:
    decayed = content_decay(daily).filter("decayed")
    title = F.concat(
        F.lit("Traffic down "), F.bround(F.col("drop_share") * 100).cast("int").cast("string"),
        F.lit("% (average clicks "), F.bround("older_avg", 1).cast("string"), F.lit(" to "),
        F.bround("recent_avg", 1).cast("string"), F.lit(")"),
    )
    finding = issue("high", "decay", title, "1d", 4, suggested="Refresh prices, dates and facts that have aged")
    return decayed.select(*SITE, finding.alias("i")).select(*SITE, "i.*")


def never_clicked_issues(queries: Rows) -> DataFrame:
    """One finding per site that counts its never-clicked first-page keywords."""
    text = F.concat(
        F.lit("'"), F.col("query"), F.lit("' (position "), F.col("position").cast("string"), F.lit(", "),
        F.col("impressions").cast("string"), F.lit(" impressions)"),
    )
    found = counted_sample(never_clicked(queries), SITE, text, _by_impressions(), 5)
    reliable = ctr_summary(queries).select(*SITE, "reliable")
    advice = F.concat(
        F.lit("Check title, description and intent of the ranking page"),
        F.when(F.col("reliable"), F.lit("")).otherwise(F.lit("; too few clicks on the site to be conclusive")),
    )
    title = F.concat(F.col("n").cast("string"), F.lit(" first-page keywords with many impressions and no clicks"))
    finding = issue("medium", "ctr", title, "1h", 3, current=F.col("sample"), suggested=advice)
    return found.join(reliable, SITE).select(*SITE, finding.alias("i")).select(*SITE, "i.*")

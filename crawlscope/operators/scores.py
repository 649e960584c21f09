"""Scores and their history. `scores` is project_id, date, kind, value: one value per day and kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlscope import constants as C

SERIES = ["project_id", "kind"]


def latest_by_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row per key, picked by aggregation: no key is ever gathered in one place."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_row")).select(*keys, "_row.*")


def latest_by_kind(scores: DataFrame) -> DataFrame:
    return latest_by_key(scores.select(*SERIES, "date", "value"), SERIES, "date")


def score_delta(scores: DataFrame) -> DataFrame:
    """Latest value, the one before and their difference; NULL when there is only one.

    A series has one row per day, which bounds its window.
    """
    by_day = Window.partitionBy(*SERIES).orderBy(F.col("date").desc())
    recent = scores.withColumn("_rank", F.row_number().over(by_day)).filter(F.col("_rank") <= 2)
    pair = recent.groupBy(*SERIES).agg(
        F.max("date").alias("date"),
        F.max(F.when(F.col("_rank") == 1, F.col("value"))).alias("current"),
        F.max(F.when(F.col("_rank") == 2, F.col("value"))).alias("previous"),
    )
    return pair.withColumn("delta", F.col("current") - F.col("previous"))


def score_drops(scores: DataFrame, threshold: int = C.SCORE_DROP) -> DataFrame:
    watched = scores.filter(F.col("kind").isin("seo", "technical", "geo", "local"))
    return score_delta(watched).filter(F.col("delta") <= -threshold).select(
        *SERIES, "previous", "current", (-F.col("delta")).alias("drop_points")
    )


def scores_history(scores: DataFrame) -> DataFrame:
    """The drawn series, with the number of points of the site and a reason when they are too few."""
    drawn = scores.filter(F.col("kind").isin("seo", "geo", "technical"))
    points = F.count(F.lit(1)).over(Window.partitionBy("project_id"))
    few = F.when(F.col("points") < 2, F.lit("fewer than two measurements"))
    return drawn.select("project_id", "kind", "date", "value", points.alias("points")).withColumn("empty_reason", few)


def seo_score(components: DataFrame) -> DataFrame:
    """Mean of the available components; NULL when a site has none of them."""
    present = F.filter(
        F.array("technical_score", "content_score", "geo_score", "local_score"), lambda x: x.isNotNull()
    )
    total = F.aggregate(present, F.lit(0), lambda a, x: a + x.cast("int"))
    mean = F.bround(F.try_divide(total, F.size(present))).cast("int")
    return components.withColumns({"seo_score": mean, "components": F.size(present)})


def agent_matrix(sites: DataFrame) -> DataFrame:
    """One row per site and answer-engine agent: may it read the home page, and what is recommended.

    `sites` holds project_id, llms_txt, llms_full_txt and the parsed `robots` of `sources.robots`.
    """
    from crawlscope.sources.robots import allowed

    agents = F.explode(
        F.array(
            *[
                F.struct(F.lit(a).alias("agent"), F.lit(o).alias("owner"), F.lit(r).alias("recommended"))
                for a, o, r in C.AI_AGENTS
            ]
        )
    )
    rows = sites.select("project_id", "robots", agents.alias("a")).select("project_id", "robots", "a.*")
    rows = rows.withColumn("allowed", allowed(F.col("robots"), F.col("agent"), F.lit("/")))
    advice = (
        F.when(F.col("recommended") & F.col("allowed"), "keep allowed").when(F.col("recommended"), "allow")
        .when(F.col("allowed"), "block").otherwise("keep blocked")
    )
    return rows.drop("robots").withColumn("recommendation", advice)


def geo_score(sites: DataFrame) -> DataFrame:
    """20 for llms.txt, 10 for llms-full.txt and 70 shared by the recommended agents that may read the site."""
    wanted = sum(1 for _, _, recommended in C.AI_AGENTS if recommended)
    allowed = agent_matrix(sites).groupBy("project_id").agg(
        F.count_if(F.col("recommended") & F.col("allowed")).alias("agents_allowed")
    )
    points = (
        F.when(F.col("llms_txt"), 20).otherwise(0) + F.when(F.col("llms_full_txt"), 10).otherwise(0)
        + F.bround(F.col("agents_allowed") * F.lit(70 / wanted), 1)
    )
    return sites.join(allowed, "project_id").select(
        "project_id", "llms_txt", "llms_full_txt", "agents_allowed", F.bround(points).cast("int").alias("geo_score")
    )


def audit_days(scores: DataFrame) -> DataFrame:
    """The two newest days with an overall score per site; sites with fewer are left out."""
    days = scores.filter(F.col("kind") == "seo").select("project_id", "date").distinct()
    newest = Window.partitionBy("project_id").orderBy(F.col("date").desc())
    ranked = days.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= 2)
    return ranked.groupBy("project_id").agg(
        F.max(F.when(F.col("_rank") == 2, F.col("date"))).alias("from_date"),
        F.max(F.when(F.col("_rank") == 1, F.col("date"))).alias("to_date"),
    ).filter("from_date IS NOT NULL")


def compare_scores(scores: DataFrame, days: DataFrame) -> DataFrame:
    """Per site and kind the values on both days; a kind measured on one day only keeps NULL for the other."""
    from crawlscope.skew import lookup_join

    dated = lookup_join(scores.filter(F.col("kind").isin(list(C.SCORE_LABELS))), days, ["project_id"], how="inner")
    value = lambda day: F.max(F.when(F.col("date") == F.col(day), F.col("value")))
    pairs = dated.groupBy(*SERIES).agg(value("from_date").alias("from_value"), value("to_date").alias("to_value"))
    return pairs.filter("from_value IS NOT NULL OR to_value IS NOT NULL").withColumn(
        "delta", F.col("to_value") - F.col("from_value")
    )


def changed_between(rows: DataFrame, days: DataFrame, at: str) -> DataFrame:
    """Rows whose time `at` lies on or between the two days, ends included."""
    from crawlscope.skew import lookup_join

    dated = lookup_join(rows, days, ["project_id"], how="inner")
    return dated.filter(
        (F.col(at) >= F.col("from_date")) & (F.col(at) < F.date_add("to_date", 1))
    ).drop("from_date", "to_date")


def audit_compare(scores: DataFrame, issues: DataFrame, pages: DataFrame, days: DataFrame | None = None) -> dict[str, DataFrame]:
    """Score deltas, findings resolved and new, and pages new between two audits of every site."""
    days = audit_days(scores) if days is None else days
    return {
        "score_deltas": compare_scores(scores, days),
        "issues_resolved": changed_between(issues.filter(F.col("status") != "open"), days, "resolved_at"),
        "issues_new": changed_between(issues, days, "detected_at"),
        "pages_new": changed_between(pages, days, "first_seen"),
    }

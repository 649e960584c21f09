"""The common shape of a finding, and the checks every finding must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlscope import constants as C

ISSUE_COLUMNS = ["severity", "category", "title", "page_url", "current_text", "suggested_text", "effort", "impact"]


def _text(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.lit(value).cast("string")


def issue(severity, category, title, effort="1h", impact=3, page_url=None, current=None, suggested=None) -> Column:
    """One finding as a struct; plain values and columns both go."""
    impact_column = impact if isinstance(impact, Column) else F.lit(impact)
    return F.struct(
        _text(severity).alias("severity"), _text(category).alias("category"), _text(title).alias("title"),
        _text(page_url).alias("page_url"), _text(current).alias("current_text"),
        _text(suggested).alias("suggested_text"), _text(effort).alias("effort"),
        impact_column.cast("int").alias("impact"),
    )


def when_issue(condition: Column, finding: Column) -> Column:
    return F.when(condition, finding)


def explode_issues(df: DataFrame, findings: list[Column], keep: list[str]) -> DataFrame:
    """One row per finding that applies; the list is built inside the row, so nothing is shuffled."""
    present = F.filter(F.array(*findings), lambda x: x.isNotNull())
    return df.select(*keep, F.inline(present))


def issue_constraints(issues: DataFrame) -> DataFrame:
    """Mark each finding `valid`: impact 1 to 5 and a known severity. The effort is not checked."""
    valid = F.col("impact").between(1, 5) & F.col("severity").isin(C.SEVERITIES)
    return issues.withColumn("valid", F.coalesce(valid, F.lit(False)))


def effort_rank(effort: Column) -> Column:
    known = F.create_map(*[F.lit(v) for pair in C.EFFORT_RANK.items() for v in pair])
    return F.coalesce(F.try_element_at(known, effort), F.lit(len(C.EFFORT_RANK)))

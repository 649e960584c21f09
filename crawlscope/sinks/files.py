"""Files other tools read: the action plan as CSV, the disavow list as text, report tables as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlscope.functions.text import csv_safe
from crawlscope.operators.backlinks import disavow_domains

SITE = ["project_id"]
PLAN_COLUMNS = {"severity": "severidad", "category": "categoria", "title": "titulo", "current_text": "actual",
                "suggested_text": "sugerido", "effort": "esfuerzo"}


def action_plan_rows(ledger: DataFrame) -> DataFrame:
    """The eight columns of the export, texts guarded against spreadsheet formulas."""
    return ledger.filter(F.col("status") == "open").select(
        *SITE, *[csv_safe(F.col(c)).alias(n) for c, n in PLAN_COLUMNS.items()], F.col("impact").alias("impacto"),
        F.col("detected_at").alias("detectado_en"),
    )


def write_action_plan_csv(ledger: DataFrame, path: str) -> None:
    """One folder per site, highest impact first inside every file.

    Rows are ranged by site and impact, so a huge site is written by many tasks.
    """
    ranged = action_plan_rows(ledger).repartitionByRange("project_id", F.col("impacto").desc(), "titulo")
    ranged.sortWithinPartitions("project_id", F.col("impacto").desc(), "titulo").write.mode("overwrite").partitionBy(
        *SITE
    ).option("header", True).csv(path)


def disavow_lines(toxic: DataFrame) -> DataFrame:
    """Two lines per toxic domain, the reason as a comment: project_id, source_domain, line_no, value."""
    lines = F.array(F.concat(F.lit("# "), F.col("reason")), F.concat(F.lit("domain:"), F.col("source_domain")))
    return disavow_domains(toxic).select(*SITE, "source_domain", F.posexplode(lines).alias("line_no", "value"))


DISAVOW_HEADER = "# Check every domain before submitting this list\n# https://search.google.com/search-console/disavow-links\n"


def write_disavow(toxic: DataFrame, path: str) -> None:
    """One folder per site of text files in the disavow format, the notice first.

    The two lines of a domain stay together; read in name order, the files of a site are one list.
    """
    domains = disavow_domains(toxic)
    pair = F.concat(F.lit("# "), F.col("reason"), F.lit("\ndomain:"), F.col("source_domain"))
    notice = domains.select(*SITE).distinct().select(*SITE, F.lit("").alias("source_domain"), F.lit(DISAVOW_HEADER).alias("value"))
    rows = notice.unionByName(domains.select(*SITE, "source_domain", pair.alias("value")))
    ranged = rows.repartitionByRange("project_id", "source_domain").sortWithinPartitions("project_id", "source_domain")
    ranged.select(*SITE, "value").write.mode("overwrite").partitionBy(*SITE).text(path)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Every table of a report as Parquet, under its own name."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")

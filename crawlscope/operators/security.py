"""Response headers of a site as a trust signal. `sites` is project_id and headers (map of name to value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlscope import constants as C
from crawlscope.operators.issues import explode_issues, issue, when_issue


def security_headers(sites: DataFrame) -> DataFrame:
    """Which headers are present, and what weakens them."""
    entries = F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>")))

    def header(name: str) -> Column:
        # The same header written in two cases is one header; the last one counts.
        same = F.filter("_entries", lambda e: F.lower(e["key"]) == name)
        return F.nullif(F.try_element_at(same, F.lit(-1))["value"], F.lit(""))

    hsts, csp = header("strict-transport-security"), header("content-security-policy")
    age = F.nullif(F.regexp_extract(F.coalesce(hsts, F.lit("")), r"(?i)max-age=(\d+)", 1), F.lit("")).try_cast("long")
    policy = F.coalesce(F.lower(csp), F.lit(""))
    unsafe = F.filter(
        F.array(*[F.when(F.contains(policy, F.lit(t)), F.lit(t)) for t in C.UNSAFE_CSP_TOKENS]), lambda t: t.isNotNull()
    )
    covered = F.contains(policy, F.lit("frame-ancestors"))
    return sites.withColumn("_entries", entries).select(
        "project_id",
        hsts.alias("hsts"), age.alias("hsts_max_age"),
        (hsts.isNotNull() & (F.coalesce(age, F.lit(0)) < C.HSTS_MIN_AGE)).alias("hsts_weak"),
        csp.alias("csp"), F.array_join(unsafe, ", ").alias("csp_unsafe"), covered.alias("frame_ancestors"),
        header("x-frame-options").alias("x_frame_options"),
        header("x-content-type-options").alias("x_content_type_options"),
        header("referrer-policy").alias("referrer_policy"), header("permissions-policy").alias("permissions_policy"),
    )


def security_issues(headers: DataFrame) -> DataFrame:
    """Findings over the output of `security_headers`."""
    c = F.col
    findings = [
        when_issue(c("hsts").isNull(), issue("high", "security", "No Strict-Transport-Security header", "5min", 3)),
        when_issue(
            c("hsts_weak"),
            issue("medium", "security",
                  F.concat(F.lit("HSTS max-age is low ("), F.coalesce(c("hsts_max_age").cast("string"), F.lit("none")),
                           F.lit(f" of {C.HSTS_MIN_AGE} seconds)")), "5min", 1, current=c("hsts")),
        ),
        when_issue(c("csp").isNull(), issue("medium", "security", "No Content-Security-Policy header", "1h", 2)),
        when_issue(
            c("csp_unsafe") != "",
            issue("medium", "security", F.concat(F.lit("CSP allows "), c("csp_unsafe")), "1d", 1,
                  current=c("csp")),
        ),
        when_issue(
            c("x_frame_options").isNull() & ~c("frame_ancestors"),
            issue("medium", "security", "No X-Frame-Options and no frame-ancestors in CSP", "5min", 2),
        ),
        when_issue(c("x_content_type_options").isNull(),
                   issue("medium", "security", "No X-Content-Type-Options header", "5min", 1)),
        when_issue(c("referrer_policy").isNull(), issue("medium", "security", "No Referrer-Policy header", "5min", 1)),
    ]
    return explode_issues(headers, findings, ["project_id"])

"""One finding per site and subject, built from counts and a first few examples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlscope import constants as C
from crawlscope.operators.issues import explode_issues, issue, when_issue
from crawlscope.session import written
from crawlscope.skew import counted_sample

SITE = ["project_id"]


def _finding(rows: DataFrame, text: Column, order: list[Column], severity, category: str, title: str, effort: str,
             impact, k: int = 5, separator: str = ", ", suggested: str | None = None) -> DataFrame:
    """`title` is the wording after the count."""
    summed = counted_sample(rows, SITE, text, order, k, separator)
    worded = F.concat(F.col("n").cast("string"), F.lit(f" {title}"))
    finding = issue(severity, category, worded, effort, impact, current=F.col("sample"), suggested=suggested)
    return summed.select(*SITE, finding.alias("i")).select(*SITE, "i.*")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def coverage_issues(orphans: DataFrame, broken: DataFrame, redirects: DataFrame, diff: DataFrame) -> DataFrame:
    url = F.col("url")

    def missing(name: str) -> DataFrame:
        return diff.filter(F.col("difference") == name)

    return union(
        [
            _finding(broken, F.concat(url, F.lit(" ("), F.col("status_code").cast("string"), F.lit(")")), [url], "critical",
                     "coverage", "broken internal links (4xx/5xx)", "1h", 5, suggested="Correct or remove these links"),
            _finding(orphans, url, [url], "high", "coverage", "orphan pages without an internal link", "1h", 4,
                     suggested="Link them from the menu or related pages"),
            _finding(missing("in_sitemap_not_crawled"), url, [url], "medium", "coverage",
                     "sitemap urls the crawl did not reach", "1h", 2),
            _finding(missing("sitemap_not_indexed"), url, [url], "high", "coverage",
                     "sitemap urls inspected and not indexed", "1h", 4),
            _finding(missing("sitemap_not_inspected"), url, [url], "medium", "coverage",
                     "sitemap urls not inspected yet", "5min", 1),
            _finding(redirects, F.concat(url, F.lit(" → "), F.col("redirected_to")), [url], "medium", "coverage",
                     "internal links to a url that redirects", "1h", 2, suggested="Link the final url"),
        ]
    )


def robots_issues(conflicts: DataFrame) -> DataFrame:
    url, conflicts = F.col("url"), written(conflicts)  # count and sample read them
    return _finding(conflicts, url, [url], "high", "coverage", "sitemap urls blocked by robots.txt", "5min", 4,
                    suggested="Drop them from the sitemap or unblock them")


def link_issues(table: DataFrame, nofollow: DataFrame) -> DataFrame:
    """`table` is `links.link_table`, `nofollow` is `links.nofollow_pages`."""
    url = F.col("url")

    def numbered(name: str) -> Column:
        return F.concat(url, F.lit(" ("), F.col(name).cast("string"), F.lit(")"))

    wasted = counted_sample(nofollow, SITE, F.concat(url, F.lit(" → "), F.col("sample")), [url], 3, "; ",
                            extra=[F.sum("targets").alias("targets")])
    title = F.concat(F.col("targets").cast("string"), F.lit(" internal links with nofollow"))
    finding = issue("medium", "internal_links", title, "1h", 3, current=F.col("sample"))
    return union(
        [
            _finding(table.filter("weak"), numbered("inbound"), [F.col("inbound"), url], "medium", "internal_links",
                     "pages with at most one internal link", "1h", 3),
            _finding(table.filter("deep"), numbered("click_depth"), [F.col("click_depth").desc(), url], "medium",
                     "internal_links", f"pages {C.DEEP_CLICKS} or more clicks from home", "1h", 2),
            wasted.select(*SITE, finding.alias("i")).select(*SITE, "i.*"),
        ]
    )


def duplicate_issues(groups: DataFrame, thin: DataFrame) -> DataFrame:
    """`groups` is `pages.duplicate_field`, `thin` is `pages.thin_content`."""
    words = {"title": ("high", "titles", 4), "meta_description": ("medium", "meta descriptions", 3), "h1": ("medium", "headings", 2)}
    text = F.concat(F.lit('"'), F.col("value"), F.lit('" ×'), F.col("pages").cast("string"))
    keys = [*SITE, "field"]
    summed = counted_sample(groups, keys, text, [F.col("pages").desc(), F.col("value")], 3, "; ",
                            extra=[F.sum("pages").alias("affected")])
    findings = []
    for field, (severity, name, impact) in words.items():
        title = F.concat(F.col("affected").cast("string"), F.lit(f" pages share {name} ("), F.col("n").cast("string"), F.lit(" texts)"))
        findings.append(when_issue(F.col("field") == field,
                                   issue(severity, "duplicates", title, "1h", impact, current=F.col("sample"))))
    short = _finding(thin, F.concat("url", F.lit(" ("), F.col("word_count").cast("string"), F.lit(")")),
                     [F.col("word_count"), F.col("url")], "medium", "duplicates",
                     f"pages with thin content (fewer than {C.MIN_WORDS_THIN} words)", "1d", 3)
    return union([explode_issues(summed, findings, SITE), short])


def schema_issues(groups: DataFrame) -> DataFrame:
    """`groups` is `page_rules.schema_groups`."""
    required = F.col("level") == "required"
    title = F.concat(F.col("type"), F.lit(" data without "), F.col("level"), F.lit(" ["), F.col("missing_fields"),
                     F.lit("] on "), F.col("pages_affected").cast("string"), F.lit(" pages"))
    finding = issue(F.when(required, "high").otherwise("medium"), "schema", title, "1h",
                    F.when(required, 4).otherwise(2), current=F.col("sample_urls"))
    return groups.select(*SITE, finding.alias("i")).select(*SITE, "i.*")


def cache_issues(findings: DataFrame, summary: DataFrame) -> DataFrame:
    """Said only when at least half of the pages lack the header: that is server set-up, not an accident."""
    url = F.col("url")
    counted = counted_sample(findings, [*SITE, "finding"], url, [url], 5).join(summary.select(*SITE, "pages_checked"), SITE)
    widespread = counted.filter(F.col("n") >= F.greatest(F.lit(1), F.floor(F.col("pages_checked") / 2)))
    name = F.when(F.col("finding") == "uncompressed", "compression").otherwise("Cache-Control")
    title = F.concat(F.col("n").cast("string"), F.lit(" of "), F.col("pages_checked").cast("string"), F.lit(" pages without "), name)
    finding = issue("medium", "performance", title, "1h", 2, current=F.col("sample"))
    return widespread.select(*SITE, finding.alias("i")).select(*SITE, "i.*")


def backlink_issues(backlinks: DataFrame, toxic: DataFrame) -> DataFrame:
    total = backlinks.groupBy(*SITE).agg(F.count(F.lit(1)).alias("total"))
    bad = toxic.groupBy(*SITE).agg(F.count(F.lit(1)).alias("bad"))
    both = bad.join(total, SITE)
    ratio = F.col("bad") / F.col("total")
    critical = ratio > C.TOXIC_CRITICAL
    severity = F.when(critical, "critical").when(ratio > C.TOXIC_HIGH, "high").otherwise("medium")
    title = F.concat(F.col("bad").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" backlinks look toxic"))
    finding = issue(severity, "backlinks", title, "30min", F.when(critical, 4).otherwise(3),
                    suggested="Check the disavow list before submitting it")
    return both.select(*SITE, finding.alias("i")).select(*SITE, "i.*")


def reclaim_issues(reclaim: DataFrame) -> DataFrame:
    """Both findings count and sample the rows, so these are found once and written."""
    reclaim = written(reclaim)
    order = [F.col("source_domain"), F.col("target_url"), F.col("source_url")]
    arrow = F.concat(F.col("source_domain"), F.lit(" → "), F.col("target_url"))
    return union(
        [
            _finding(reclaim.filter(F.col("finding") == "broken"), arrow, order, "high", "backlinks",
                     "backlinks point to a broken page", "1h", 4, separator="; "),
            _finding(reclaim.filter(F.col("finding") == "redirects"), F.concat(arrow, F.lit(" → "), F.col("final_url")),
                     order, "medium", "backlinks", "backlinks point to a url that redirects", "5min", 2, separator="; "),
        ]
    )


def local_issues(scored: DataFrame, phones: DataFrame) -> DataFrame:
    """`scored` is `local.local_score`, `phones` is `local.nap_phones`."""
    order = [F.col("pages_count").desc(), F.col("phone")]
    named = counted_sample(phones, SITE, F.substring_index("raw_examples", ", ", 1), order, 3).select(*SITE, "sample")
    joined = scored.join(named, SITE, "left")
    findings = [
        when_issue(F.col("phones") > 1,
                   issue("high", "local", F.concat(F.col("phones").cast("string"), F.lit(" different phone numbers on the site")),
                         "1h", 4, current=F.col("sample"))),
        when_issue(F.col("phones") == 0, issue("medium", "local", "No phone number on the site", "5min", 3)),
        when_issue(F.col("pages_with_schema") == 0, issue("high", "local", "No LocalBusiness data on any page", "1h", 4)),
    ]
    return explode_issues(joined, findings, SITE)


def geo_issues(scored: DataFrame, matrix: DataFrame) -> DataFrame:
    """`scored` is `scores.geo_score`, `matrix` is `scores.agent_matrix`."""
    files = explode_issues(
        scored,
        [
            when_issue(~F.col("llms_txt"), issue("high", "geo", "No /llms.txt", "1h", 4)),
            when_issue(~F.col("llms_full_txt"), issue("medium", "geo", "No /llms-full.txt", "1h", 2)),
        ],
        SITE,
    )
    who = F.concat(F.col("agent"), F.lit(" ("), F.col("owner"), F.lit(")"))
    agents = explode_issues(
        matrix,
        [
            when_issue(F.col("recommended") & ~F.col("allowed"),
                       issue("high", "geo", F.concat(who, F.lit(" blocked in robots.txt")), "5min", 4)),
            when_issue(~F.col("recommended") & F.col("allowed"),
                       issue("medium", "geo", F.concat(who, F.lit(" allowed in robots.txt")), "5min", 2)),
        ],
        SITE,
    )
    return union([files, agents])


def serp_issues(discovered: DataFrame, standing: DataFrame) -> DataFrame:
    """`discovered` is `serp.discover_competitors`, `standing` is `serp.keyword_standing`."""
    discovered, standing = written(discovered), written(standing)
    order = [F.col("appearances").desc(), F.col("avg_position"), F.col("domain")]
    named = F.concat(F.col("domain"), F.lit(" ("), F.col("appearances").cast("string"), F.lit(")"))
    rivals = discovered.filter(~F.col("is_registered") & ~F.col("is_platform"))
    return union(
        [
            _finding(rivals, named, order, "medium", "serp", "competitors in the top results are not registered", "5min", 3),
            _finding(discovered.filter("is_platform"), named, order, "medium", "serp", "platforms hold top results", "1h", 2),
            _finding(standing.filter("our_position IS NULL"), F.col("keyword"), [F.col("keyword")], "high", "serp",
                     "checked keywords without us in the top results", "1d", 4),
        ]
    )

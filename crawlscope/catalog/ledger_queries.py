"""Ledger, current state, summaries, plans and exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from crawlscope import constants as C
from crawlscope.catalog import audit_queries as A
from crawlscope.catalog import graph_queries as N
from crawlscope.catalog import market_queries as M
from crawlscope.catalog import search_queries as Q
from crawlscope.catalog.fixtures import crawl, linked_crawl, load
from crawlscope.catalog.registry import ORACLES, query
from crawlscope.operators import ledger as E
from crawlscope.operators import links as L
from crawlscope.operators import page_rules as P
from crawlscope.operators import scores as S
from crawlscope.operators import search
from crawlscope.operators import serp as R
from crawlscope.operators import summaries as Y
from crawlscope.operators.backlinks import toxic_backlinks
from crawlscope.operators.local import local_score, nap_phones
from crawlscope.plans import opportunities, page_audit, report, site_health
from crawlscope.session import scratch, written
from crawlscope.sinks import files
from crawlscope.sinks.current import CurrentTable

_THEN, _NOW = "CAST('2024-01-01' AS TIMESTAMP)", "CAST('2024-02-01' AS TIMESTAMP)"

def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


# The findings of today; a page is known by the number at the end of its url.
_PAGE_ID = "coalesce(TRY_CAST(regexp_extract(page_url, '[0-9]+$') AS BIGINT), 0)"
FOUND = f"(SELECT project_id, page_url, severity, category, title, current_text, suggested_text, effort, impact, {_PAGE_ID} AS page_id FROM ({A.TECHNICAL_ISSUES}) t)"
# The ledger of last month: no canonical findings yet, og dismissed, headings worded differently, one stale row per site.
LEDGER = f"""(SELECT project_id, page_id, CAST(1 AS BIGINT) AS snapshot_id, severity, category, title || CASE WHEN category = 'h1' THEN ' (old)' ELSE '' END AS title, current_text, suggested_text,
      CASE WHEN category = 'schema' THEN NULL WHEN category = 'content' THEN '30min' ELSE effort END AS effort, CASE WHEN category = 'schema' THEN NULL ELSE impact END AS impact,
      CASE WHEN category = 'og' THEN 'dismissed' ELSE 'open' END AS status, {_THEN} AS detected_at, CASE WHEN category = 'og' THEN {_THEN} END AS resolved_at
    FROM {FOUND} f WHERE category <> 'canonical'
    UNION ALL SELECT DISTINCT project_id, NULL, 2, 'critical', category, '=stale ' || category, NULL, '-note', '1h', 3, 'open', {_THEN}, CAST(NULL AS TIMESTAMP) FROM {FOUND} f)"""


def found(spark, sf):
    number = F.regexp_extract("page_url", r"[0-9]+$", 0).try_cast("long")
    return P.technical_issues(crawl(spark, sf)).withColumn("page_id", F.coalesce(number, F.lit(0).cast("long")))


def found_once(spark, sf):
    """`found`, judged once and written, where ledger and findings, or several tables, read it."""
    return written(found(spark, sf))


def ledger(spark, sf, fresh=None):
    then, none = F.lit("2024-01-01").cast("timestamp"), F.lit(None).cast("string")
    category = F.col("category")
    fresh = found_once(spark, sf) if fresh is None else fresh
    paged = fresh.filter(category != "canonical").select(
        "project_id", "page_id", F.lit(1).cast("long").alias("snapshot_id"), "severity", "category",
        F.concat("title", F.when(category == "h1", " (old)").otherwise("")).alias("title"), "current_text", "suggested_text",
        F.when(category == "schema", none).when(category == "content", "30min").otherwise(F.col("effort")).alias("effort"),
        F.when(category != "schema", F.col("impact")).alias("impact"), F.when(category == "og", "dismissed").otherwise("open").alias("status"),
        then.alias("detected_at"), F.when(category == "og", then).alias("resolved_at"),
    )
    stale = fresh.select("project_id", "category").distinct().select(
        "project_id", F.lit(None).cast("long").alias("page_id"), F.lit(2).cast("long").alias("snapshot_id"), F.lit("critical").alias("severity"), "category",
        F.concat(F.lit("=stale "), category).alias("title"), none.alias("current_text"), F.lit("-note").alias("suggested_text"), F.lit("1h").alias("effort"),
        F.lit(3).alias("impact"), F.lit("open").alias("status"), then.alias("detected_at"), F.lit(None).cast("timestamp").alias("resolved_at"),
    )
    return paged.unionByName(stale)


def timed(df):
    return df.withColumns({c: F.col(c).cast("string") for c in ("detected_at", "resolved_at") if c in df.columns})


_STAMPED = "CAST(detected_at AS STRING) AS detected_at, CAST(resolved_at AS STRING) AS resolved_at"
_COLS = "project_id, page_id, snapshot_id, severity, category, title, current_text, suggested_text, effort, impact, status"
ADDED = f"""(SELECT project_id, page_id, CAST(9 AS BIGINT) AS snapshot_id, severity, category, title, current_text, suggested_text, effort, impact, 'open' AS status, {_NOW} AS detected_at, CAST(NULL AS TIMESTAMP) AS resolved_at
    FROM {FOUND} f WHERE NOT EXISTS (SELECT 1 FROM {LEDGER} l WHERE l.status = 'open' AND l.project_id = f.project_id AND l.category = f.category AND l.title = f.title))"""


@query("record_issues", f"SELECT {_COLS}, {_STAMPED} FROM {ADDED} a")
def record(spark, sf):
    fresh = found_once(spark, sf)
    return timed(E.record_issues(ledger(spark, sf, fresh), fresh, 9, now())).drop("page_url")


def _reconciled(scope: str, categories) -> str:
    names = ", ".join(f"'{c}'" for c in categories)
    gone = f"""l.status = 'open' AND l.category IN ({names}) AND {scope} AND NOT EXISTS (
        SELECT 1 FROM {FOUND} f WHERE f.project_id = l.project_id AND f.category = l.category AND f.title = l.title)"""
    return f"""(SELECT l.* EXCLUDE (status, resolved_at), CASE WHEN {gone} THEN 'resolved' ELSE l.status END AS status, CASE WHEN {gone} THEN {_NOW} ELSE l.resolved_at END AS resolved_at FROM {LEDGER} l)"""


_CRAWLED = "(SELECT DISTINCT project_id, coalesce(TRY_CAST(regexp_extract(url, '[0-9]+$') AS BIGINT), 0) AS page_id FROM {crawl_flat} c WHERE status_code = 200)"
_SEEN = f"l.page_id IS NOT NULL AND EXISTS (SELECT 1 FROM {_CRAWLED} p WHERE p.project_id = l.project_id AND p.page_id = l.page_id)"


def crawled_ids(spark, sf):
    number = F.regexp_extract("url", r"[0-9]+$", 0).try_cast("long")
    return N.flat(spark, sf).filter("status_code = 200").select("project_id", F.coalesce(number, F.lit(0).cast("long")).alias("page_id"))


@query("reconcile_page_issues", f"SELECT {_COLS}, {_STAMPED} FROM {_reconciled(_SEEN, C.PAGE_CATEGORIES)} r")
def reconcile_pages(spark, sf):
    fresh = found_once(spark, sf)
    return timed(E.reconcile_issues(ledger(spark, sf, fresh), fresh, C.PAGE_CATEGORIES, now(), True, crawled_ids(spark, sf)))


@query("reconcile_site_issues", f"SELECT {_COLS}, {_STAMPED} FROM {_reconciled('l.page_id IS NULL', C.OPPORTUNITY_CATEGORIES)} r")
def reconcile_site(spark, sf):
    fresh = found_once(spark, sf)
    return timed(E.reconcile_issues(ledger(spark, sf, fresh), fresh, C.OPPORTUNITY_CATEGORIES, now(), False))


@query("page_audit_run", f"SELECT project_id, category, status, count(*) AS rows FROM (SELECT project_id, category, status FROM {_reconciled(_SEEN, C.PAGE_CATEGORIES)} r UNION ALL SELECT project_id, category, status FROM {ADDED} a) u GROUP BY 1, 2, 3")
def audit_run(spark, sf):
    fresh = found_once(spark, sf)
    after = page_audit.book(ledger(spark, sf, fresh), fresh, C.PAGE_CATEGORIES, 9, now(), True, crawled_ids(spark, sf))
    return after.groupBy("project_id", "category", "status").agg(F.count(F.lit(1)).alias("rows"))


@query("new_critical_issues", f"SELECT {_COLS} FROM {LEDGER} l WHERE status = 'open' AND severity = 'critical' AND snapshot_id = 2")
def new_critical(spark, sf):
    book = ledger(spark, sf)
    return E.new_critical_issues(book, book.filter("page_id IS NULL").select("project_id", "snapshot_id")).drop("detected_at", "resolved_at")


@query("set_issue_status", """
    SELECT event_id AS issue_id, event_type AS title, CASE WHEN value > 20 THEN 'dismissed' WHEN value > 15 THEN 'open' WHEN event_type = 'view' THEN 'done' ELSE 'open' END AS status,
           CASE WHEN value > 20 THEN '2024-02-01 00:00:00' WHEN value > 15 THEN NULL WHEN event_type = 'view' THEN '2024-01-01 00:00:00' END AS resolved_at FROM {events}""")
def set_status(spark, sf):
    events = load(spark, sf, "events")
    book = events.select(F.col("event_id").alias("issue_id"), F.col("event_type").alias("title"), F.when(F.col("event_type") == "view", "done").otherwise("open").alias("status"),
                         F.when(F.col("event_type") == "view", F.lit("2024-01-01").cast("timestamp")).alias("resolved_at"))
    changes = events.filter("value > 15").select(F.col("event_id").alias("issue_id"), F.when(F.col("value") > 20, "dismissed").otherwise("open").alias("status"), now().alias("changed_at"))
    return timed(E.set_issue_status(book, changes))


_RANKED = f"""(SELECT project_id, severity, category, title, coalesce(effort, '1h') AS effort, coalesce(impact, 3) AS impact, CASE coalesce(effort, '1h') WHEN '5min' THEN 0 WHEN '30min' THEN 1 WHEN '1h' THEN 2 WHEN '1d' THEN 3 ELSE 4 END AS effort_rank
    FROM {LEDGER} l WHERE status = 'open')"""


@query("action_plan", f"SELECT *, rank() OVER (PARTITION BY project_id, severity ORDER BY impact DESC, effort_rank) AS priority_rank FROM {_RANKED} r")
def plan(spark, sf):
    return E.action_plan(ledger(spark, sf)).select("project_id", "severity", "category", "title", "effort", "impact", "effort_rank", "priority_rank")


@query("top_issues", f"SELECT * FROM (SELECT project_id, category, title, impact, row_number() OVER (PARTITION BY project_id ORDER BY impact DESC NULLS LAST, category, title) AS rank FROM {LEDGER} l WHERE status = 'open') r WHERE rank <= 10")
def top_issues(spark, sf):
    return E.top_issues(ledger(spark, sf)).select("project_id", "category", "title", "impact", "rank")


@query("severity_counts", f"SELECT project_id, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium FROM {LEDGER} l WHERE status = 'open' GROUP BY 1")
def severities(spark, sf):
    return E.severity_counts(ledger(spark, sf))


_CARDS = f"""
    SELECT s.project_id, seo_score, geo_score, technical_score, content_score, local_score, seo_score_delta, coalesce(clicks, 0) AS clicks_28d, coalesce(impressions, 0) AS impressions_28d,
           coalesce(round_even(clicks::DOUBLE / impressions, 4), 0) AS ctr_28d, coalesce(keywords_ranking, 0) AS keywords_ranking, coalesce(issues_open, 0) AS issues_open,
           coalesce(issues_critical, 0) AS issues_critical, CAST(last_snapshot_at AS STRING) AS last_snapshot_at
    FROM {{sites}} s
    LEFT JOIN (SELECT d.project_id, sum(clicks) AS clicks, sum(impressions) AS impressions FROM {{daily_rows}} d JOIN (SELECT project_id, max(date) AS newest FROM {{daily_rows}} m GROUP BY 1) n
               ON d.project_id = n.project_id AND d.date > n.newest - 28 GROUP BY 1) t ON t.project_id = s.project_id
    LEFT JOIN (SELECT project_id, count(DISTINCT query) AS keywords_ranking FROM {Q.CURRENT} c GROUP BY 1) q ON q.project_id = s.project_id
    LEFT JOIN (SELECT project_id, count(*) AS issues_open, count(*) FILTER (WHERE severity = 'critical') AS issues_critical FROM {LEDGER} l WHERE status = 'open' GROUP BY 1) i ON i.project_id = s.project_id
    LEFT JOIN (SELECT project_id, arg_max(value, date) FILTER (WHERE kind = 'seo') AS seo_score, arg_max(value, date) FILTER (WHERE kind = 'geo') AS geo_score,
                      arg_max(value, date) FILTER (WHERE kind = 'technical') AS technical_score, arg_max(value, date) FILTER (WHERE kind = 'content') AS content_score,
                      arg_max(value, date) FILTER (WHERE kind = 'local') AS local_score FROM {{score_rows}} v GROUP BY 1) v ON v.project_id = s.project_id
    LEFT JOIN (SELECT project_id, max(value) FILTER (WHERE rn = 1) - max(value) FILTER (WHERE rn = 2) AS seo_score_delta FROM (
                 SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY date DESC) AS rn FROM {{score_rows}} w WHERE kind = 'seo') r GROUP BY 1) d ON d.project_id = s.project_id
    LEFT JOIN (SELECT user_id % 5 AS project_id, arg_max(ts, event_id) AS last_snapshot_at FROM {{events}} GROUP BY 1) e ON e.project_id = s.project_id"""


def snapshots(spark, sf):
    return load(spark, sf, "events").select((F.col("user_id") % 5).alias("project_id"), F.col("event_id").alias("snapshot_id"), F.col("ts").alias("finished_at"))


@query("scorecards", _CARDS)
def scorecards(spark, sf):
    cards = search.scorecards(N.sites(spark, sf), load(spark, sf, "daily_rows"), Q.rows(spark, sf), ledger(spark, sf), Q.scores(spark, sf), snapshots(spark, sf))
    return cards.drop("avg_position_28d").withColumn("last_snapshot_at", F.col("last_snapshot_at").cast("string"))


# --- current-state tables ----------------------------------------------------------------------------


UPSERT = """
    SELECT coalesce(c.project_id, u.project_id) AS project_id, coalesce(c.keyword, u.keyword) AS keyword, coalesce(u.volume, c.volume) AS volume, coalesce(c.first_seen, u.first_seen) AS first_seen, c.intent
    FROM (SELECT project_id, keyword, max(volume) AS volume, min(last_updated) AS first_seen, max(intent) AS intent FROM {keyword_rows} k WHERE source = 'trends' GROUP BY 1, 2) c
    FULL JOIN (SELECT project_id, keyword, arg_max(volume, last_updated) AS volume, max(last_updated) AS first_seen FROM {keyword_rows} k WHERE source = 'trends_related' GROUP BY 1, 2) u
    ON u.project_id = c.project_id AND u.keyword = c.keyword"""


def _keywords(spark, sf):
    rows = load(spark, sf, "keyword_rows")
    current = rows.filter("source = 'trends'").groupBy("project_id", "keyword").agg(F.max("volume").alias("volume"), F.min("last_updated").alias("first_seen"), F.max("intent").alias("intent"))
    updates = rows.filter("source = 'trends_related'").select("project_id", "keyword", "volume", F.col("last_updated").alias("first_seen"))
    return current, updates


@query("upsert", UPSERT)
def upsert(spark, sf):
    return E.upsert(*_keywords(spark, sf), ["project_id", "keyword"], keep=["first_seen"], order="first_seen")


@query("current_upsert", UPSERT)
def current_upsert(spark, sf):
    """The same through a table on disk, the updates applied twice."""
    current, updates = _keywords(spark, sf)
    table = CurrentTable(spark, scratch(spark), ["project_id", "keyword"], buckets=16)
    for rows in (current, updates, updates):
        table.upsert(rows, keep=["first_seen"], order="first_seen")
    return table.read()


PAGES_UPSERT = """
    SELECT project_id, url, CASE WHEN has_contact THEN title || ' v2' ELSE title END AS title, '2024-01-01 00:00:00' AS first_seen, CASE WHEN has_contact THEN '2024-02-01 00:00:00' ELSE '2024-01-01 00:00:00' END AS last_crawled FROM {crawl_flat} c
    UNION ALL SELECT project_id, url || '?new', title || ' v2', '2024-02-01 00:00:00', '2024-02-01 00:00:00' FROM {crawl_flat} c WHERE has_contact"""


def _crawled(spark, sf):
    flat = N.flat(spark, sf)
    then = F.lit("2024-01-01").cast("timestamp")
    current = flat.select("project_id", "url", "title", then.alias("first_seen"), then.alias("last_crawled"))
    again = flat.filter("has_contact").select("project_id", F.explode(F.array(F.col("url"), F.concat("url", F.lit("?new")))).alias("url"), F.concat("title", F.lit(" v2")).alias("title"), now().alias("last_crawled"))
    return current, again


@query("pages_upsert", PAGES_UPSERT)
def pages_upsert(spark, sf):
    merged = E.pages_upsert(*_crawled(spark, sf))
    return merged.withColumns({c: F.col(c).cast("string") for c in ("first_seen", "last_crawled")})


@query("current_pages_upsert", PAGES_UPSERT)
def current_pages_upsert(spark, sf):
    current, again = _crawled(spark, sf)
    table = CurrentTable(spark, scratch(spark), ["project_id", "url"], buckets=16)
    table.upsert(current)
    table.pages_upsert(again)
    merged = table.read()
    return merged.withColumns({c: F.col(c).cast("string") for c in ("first_seen", "last_crawled")})


REPLACED = """
    WITH fresh AS (SELECT project_id, keyword, date, position, url FROM {listing_rows} l WHERE is_ours)
    SELECT project_id, keyword, CAST(date AS STRING) AS date, position, url FROM fresh
    UNION ALL SELECT project_id, keyword, CAST(date AS STRING), position, url FROM {listing_rows} l
    WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.project_id = l.project_id AND f.keyword = l.keyword AND f.date = l.date)"""
SLICE = ["project_id", "keyword", "date"]


def _listed(spark, sf):
    rows = M.listings(spark, sf).select(*SLICE, "position", "url", "is_ours")
    return rows.drop("is_ours"), rows.filter("is_ours").drop("is_ours")


@query("replace_slice", REPLACED)
def replace_slice(spark, sf):
    return E.replace_slice(*_listed(spark, sf), SLICE).withColumn("date", F.col("date").cast("string"))


@query("current_replace_slice", REPLACED)
def current_replace_slice(spark, sf):
    rows, fresh = _listed(spark, sf)
    table = CurrentTable(spark, scratch(spark), [*SLICE, "position"], by=SLICE, buckets=16)
    for part in (rows, fresh, fresh):
        table.replace_slice(part, SLICE)
    replaced = table.read()
    return replaced.withColumn("date", F.col("date").cast("string"))


# --- summaries ---------------------------------------------------------------------------------------


def _summary(rows: str, text: str, order: str, severity: str, category: str, title: str, effort: str, impact: str, k: int = 5, sep: str = ", ", suggested: str = "NULL", title_sql: str | None = None) -> str:
    worded = title_sql or f"count(*) || ' {title}'"
    return f"""SELECT project_id, {severity} AS severity, '{category}' AS category, {worded} AS title, NULL AS page_url,
        string_agg({text}, '{sep}' ORDER BY rn) FILTER (WHERE rn <= {k}) AS current_text, {suggested} AS suggested_text, '{effort}' AS effort, {impact} AS impact
        FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY {order}) AS rn FROM ({rows}) x) r GROUP BY project_id"""


_BROKEN = "SELECT project_id, url, status_code FROM {crawl_flat} c WHERE status_code >= 400"
_REDIRECTED = f"SELECT project_id, url, redirected_to FROM {{crawl_flat}} c WHERE redirected_to IS NOT NULL AND {N.sql_canonical('url')} <> {N.sql_canonical('redirected_to')}"


def _diff(name: str) -> str:
    return f"SELECT * FROM ({N.DIFF}) d WHERE difference = '{name}'"


COVERAGE_ISSUES = " UNION ALL ".join([
    _summary(_BROKEN, "url || ' (' || status_code || ')'", "url", "'critical'", "coverage", "broken internal links (4xx/5xx)", "1h", "5", suggested="'Correct or remove these links'"),
    _summary(N.ORPHANS, "url", "url", "'high'", "coverage", "orphan pages without an internal link", "1h", "4", suggested="'Link them from the menu or related pages'"),
    _summary(_diff("in_sitemap_not_crawled"), "url", "url", "'medium'", "coverage", "sitemap urls the crawl did not reach", "1h", "2"),
    _summary(_diff("sitemap_not_indexed"), "url", "url", "'high'", "coverage", "sitemap urls inspected and not indexed", "1h", "4"),
    _summary(_diff("sitemap_not_inspected"), "url", "url", "'medium'", "coverage", "sitemap urls not inspected yet", "5min", "1"),
    _summary(_REDIRECTED, "url || ' → ' || redirected_to", "url", "'medium'", "coverage", "internal links to a url that redirects", "1h", "2", suggested="'Link the final url'")])


@query("coverage_issues", COVERAGE_ISSUES)
def coverage_issues(spark, sf):
    return Y.coverage_issues(N.orphans(spark, sf), N.broken(spark, sf), N.redirect_links(spark, sf), N.diff(spark, sf))


@query("robots_issues", _summary("""SELECT u.project_id, url FROM {shop_urls} u JOIN {robots_rows} r ON r.project_id = u.project_id
    WHERE s_nationkey % 2 = 0 AND (contains(url, '/part/2') OR contains(url, '/a%C3%B1ejo'))""", "url", "url", "'high'", "coverage", "sitemap urls blocked by robots.txt", "5min", "4", suggested="'Drop them from the sitemap or unblock them'"))
def robots_issues(spark, sf):
    return Y.robots_issues(N.conflicts(spark, sf))


_NOFOLLOW = """SELECT c.project_id, c.url, count(*) AS targets, array_to_string(list_slice(list(href ORDER BY href), 1, 2), ', ') AS sample FROM {crawl_flat} c
    JOIN {link_rows} l ON l.project_id = c.project_id AND l.src_idx = c.idx WHERE nofollow GROUP BY 1, 2"""
LINK_ISSUES = " UNION ALL ".join([
    _summary(f"SELECT * FROM ({N.LINK_TABLE}) t WHERE weak", "url || ' (' || inbound || ')'", "inbound, url", "'medium'", "internal_links", "pages with at most one internal link", "1h", "3"),
    _summary(f"SELECT * FROM ({N.LINK_TABLE}) t WHERE deep", "url || ' (' || click_depth || ')'", "click_depth DESC, url", "'medium'", "internal_links", "pages 4 or more clicks from home", "1h", "2"),
    _summary(_NOFOLLOW, "url || ' → ' || sample", "url", "'medium'", "internal_links", "", "1h", "3", 3, "; ", title_sql="sum(targets) || ' internal links with nofollow'")])


def sorted_links(spark, sf):
    return linked_crawl(spark, sf).withColumn("nofollow_internal", F.array_sort("nofollow_internal"))


@query("link_issues", LINK_ISSUES)
def link_issues(spark, sf):
    return Y.link_issues(N.link_table(spark, sf), L.nofollow_pages(sorted_links(spark, sf)))


def _copies(field: str, severity: str, name: str, impact: int) -> str:
    return _summary(f"SELECT * FROM ({A.DUPLICATES}) d WHERE field = '{field}'", "'\"' || value || '\" ×' || pages", "pages DESC, value", f"'{severity}'", "duplicates", "", "1h", str(impact), 3, "; ",
                    title_sql=f"sum(pages) || ' pages share {name} (' || count(*) || ' texts)'")


DUPLICATE_ISSUES = " UNION ALL ".join([
    _copies("title", "high", "titles", 4), _copies("meta_description", "medium", "meta descriptions", 3), _copies("h1", "medium", "headings", 2),
    _summary(A.THIN, "url || ' (' || word_count || ')'", "word_count, url", "'medium'", "duplicates", "pages with thin content (fewer than 200 words)", "1d", "3")])


@query("duplicate_issues", DUPLICATE_ISSUES)
def duplicate_issues(spark, sf):
    return Y.duplicate_issues(A.duplicates(spark, sf), A.thin(spark, sf))


SCHEMA_ISSUES = f"""SELECT project_id, CASE level WHEN 'required' THEN 'high' ELSE 'medium' END AS severity, 'schema' AS category,
    type || ' data without ' || level || ' [' || missing_fields || '] on ' || pages_affected || ' pages' AS title, NULL AS page_url, sample_urls AS current_text, NULL AS suggested_text, '1h' AS effort,
    CASE level WHEN 'required' THEN 4 ELSE 2 END AS impact FROM ({A.SCHEMA_GROUPS}) g"""


@query("schema_issues", SCHEMA_ISSUES)
def schema_issues(spark, sf):
    return Y.schema_issues(P.schema_groups(crawl(spark, sf)))


CACHE_ISSUES = f"""SELECT x.project_id, 'medium' AS severity, 'performance' AS category, n || ' of ' || checked || ' pages without ' || CASE finding WHEN 'uncompressed' THEN 'compression' ELSE 'Cache-Control' END AS title,
    NULL AS page_url, sample AS current_text, NULL AS suggested_text, '1h' AS effort, 2 AS impact
    FROM (SELECT project_id, finding, count(*) AS n, array_to_string(list_slice(list_sort(list(url)), 1, 5), ', ') AS sample FROM ({A.CACHE}) c GROUP BY 1, 2) x
    JOIN (SELECT project_id, count(*) AS checked FROM {{crawl_flat}} c WHERE status_code = 200 GROUP BY 1) k ON k.project_id = x.project_id WHERE n >= greatest(1, checked // 2)"""


@query("cache_issues", CACHE_ISSUES)
def cache_issues(spark, sf):
    return Y.cache_issues(A.cache_findings(spark, sf), A.cache_summary(spark, sf))


@query("backlink_issues", f"""SELECT t.project_id, CASE WHEN bad::DOUBLE / total > 0.20 THEN 'critical' WHEN bad::DOUBLE / total > 0.05 THEN 'high' ELSE 'medium' END AS severity, 'backlinks' AS category,
    bad || ' of ' || total || ' backlinks look toxic' AS title, NULL AS page_url, NULL AS current_text, 'Check the disavow list before submitting it' AS suggested_text, '30min' AS effort,
    CASE WHEN bad::DOUBLE / total > 0.20 THEN 4 ELSE 3 END AS impact FROM (SELECT project_id, count(*) AS bad FROM {M.TOXIC} t GROUP BY 1) t
    JOIN (SELECT project_id, count(*) AS total FROM {{backlink_rows}} b GROUP BY 1) b ON b.project_id = t.project_id""")
def backlink_issues(spark, sf):
    return Y.backlink_issues(M.backlinks(spark, sf), M.toxic(spark, sf))


_ARROW = "source_domain || ' → ' || target_url"


@query("reclaim_issues", " UNION ALL ".join([
    _summary(f"SELECT * FROM {M.RECLAIM} r WHERE finding = 'broken'", _ARROW, "source_domain, target_url, source_url", "'high'", "backlinks", "backlinks point to a broken page", "1h", "4", sep="; "),
    _summary(f"SELECT * FROM {M.RECLAIM} r WHERE finding = 'redirects'", _ARROW + " || ' → ' || final_url", "source_domain, target_url, source_url", "'medium'", "backlinks", "backlinks point to a url that redirects", "5min", "2", sep="; ")]))
def reclaim_issues(spark, sf):
    return Y.reclaim_issues(M.reclaimed(spark, sf))


def _plain(rows: str, condition: str, severity: str, category: str, title: str, effort: str, impact: int, current: str = "NULL") -> str:
    return f"SELECT project_id, '{severity}' AS severity, '{category}' AS category, {title} AS title, NULL AS page_url, {current} AS current_text, NULL AS suggested_text, '{effort}' AS effort, {impact} AS impact FROM ({rows}) x WHERE {condition}"


_LOCAL = f"""SELECT l.*, sample FROM {A.LOCAL} l LEFT JOIN (SELECT project_id, string_agg(split_part(raw_examples, ', ', 1), ', ' ORDER BY rn) FILTER (WHERE rn <= 3) AS sample FROM (
    SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY pages_count DESC, phone) AS rn FROM {A.PHONES} p) r GROUP BY 1) s ON s.project_id = l.project_id"""


@query("local_issues", " UNION ALL ".join([
    _plain(_LOCAL, "phones > 1", "high", "local", "phones || ' different phone numbers on the site'", "1h", 4, "sample"),
    _plain(_LOCAL, "phones = 0", "medium", "local", "'No phone number on the site'", "5min", 3),
    _plain(_LOCAL, "pages_with_schema = 0", "high", "local", "'No LocalBusiness data on any page'", "1h", 4)]))
def local_issues(spark, sf):
    pages = A.phone_pages(spark, sf)
    return Y.local_issues(local_score(pages), nap_phones(pages))


@query("geo_issues", " UNION ALL ".join([
    _plain(f"SELECT * FROM {A.GEO} g", "NOT llms_txt", "high", "geo", "'No /llms.txt'", "1h", 4),
    _plain(f"SELECT * FROM {A.GEO} g", "NOT llms_full_txt", "medium", "geo", "'No /llms-full.txt'", "1h", 2),
    _plain(f"SELECT * FROM {A.MATRIX} m", "recommended AND NOT allowed", "high", "geo", "agent || ' (' || owner || ') blocked in robots.txt'", "5min", 4),
    _plain(f"SELECT * FROM {A.MATRIX} m", "NOT recommended AND allowed", "medium", "geo", "agent || ' (' || owner || ') allowed in robots.txt'", "5min", 2)]))
def geo_issues(spark, sf):
    robots = A.robots_sites(spark, sf)
    return Y.geo_issues(S.geo_score(robots), S.agent_matrix(robots))


_DOMAIN = "domain || ' (' || appearances || ')'"
_BY_PRESENCE = "appearances DESC, avg_position, domain"


@query("serp_issues", " UNION ALL ".join([
    _summary(f"SELECT * FROM {M.DISCOVERED} d WHERE NOT is_registered AND NOT is_platform", _DOMAIN, _BY_PRESENCE, "'medium'", "serp", "competitors in the top results are not registered", "5min", "3"),
    _summary(f"SELECT * FROM {M.DISCOVERED} d WHERE is_platform", _DOMAIN, _BY_PRESENCE, "'medium'", "serp", "platforms hold top results", "1h", "2"),
    _summary(f"SELECT * FROM {M.STANDING} s WHERE our_position IS NULL", "keyword", "keyword", "'high'", "serp", "checked keywords without us in the top results", "1d", "4")]))
def serp_issues(spark, sf):
    listed, own = M.listings(spark, sf), N.sites(spark, sf)
    return Y.serp_issues(R.discover_competitors(listed, own, M.registered(spark, sf)), R.keyword_standing(R.current(listed), own))


@query("decay_issues", Q.DECAY + """ SELECT project_id, 'high' AS severity, 'decay' AS category,
    'Traffic down ' || CAST(round_even(drop_share * 100, 0) AS INT) || '% (average clicks ' || round_even(older_avg, 1) || ' to ' || round_even(recent_avg, 1) || ')' AS title, NULL AS page_url,
    NULL AS current_text, 'Refresh prices, dates and facts that have aged' AS suggested_text, '1d' AS effort, 4 AS impact FROM decay WHERE drop_share > 0.30""")
def decay_issues(spark, sf):
    return search.decay_issues(load(spark, sf, "daily_rows"))


_TEXTS = "project_id, severity, category, title, page_url, current_text, suggested_text, effort, impact"


@query("opportunity_findings", " UNION ALL ".join(f"SELECT {_TEXTS} FROM ({ORACLES[n]}) q" for n in (
    "cannibalization", "top10_zero_ctr", "zero_impression_pages", "decay_issues", "never_clicked_issue")))
def opportunity_findings(spark, sf):
    return opportunities.opportunity_findings(Q.rows(spark, sf), load(spark, sf, "daily_rows"), crawl(spark, sf), Q.closure(spark, sf))


@query("site_scores", f"""
    SELECT *, CAST(round_even(total::DOUBLE / 4, 0) AS INT) AS seo_score FROM (
      SELECT t.project_id, technical_score, content_score, geo_score, local_score, technical_score + content_score + geo_score + local_score AS total FROM ({A.STORED_SCORE}) t
      JOIN (SELECT project_id, CAST(round_even(avg(eeat_score), 0) AS INT) AS content_score FROM {{crawl_flat}} c GROUP BY 1) c ON c.project_id = t.project_id
      JOIN (SELECT project_id, arg_max(value, date) FILTER (WHERE kind = 'geo') AS geo_score, arg_max(value, date) FILTER (WHERE kind = 'local') AS local_score FROM {{score_rows}} s GROUP BY 1) s
        ON s.project_id = t.project_id) u""")
def site_scores(spark, sf):
    found = opportunities.site_scores(crawl(spark, sf), Q.scores(spark, sf)).drop("components")
    return found.withColumn("total", reduce(lambda a, b: a + b, [F.col(f"{k}_score") for k in ("technical", "content", "geo", "local")]))


@query("site_health_findings", " UNION ALL ".join(f"SELECT project_id, category, severity, title, impact FROM ({s}) q" for s in (COVERAGE_ISSUES, LINK_ISSUES, DUPLICATE_ISSUES, SCHEMA_ISSUES, CACHE_ISSUES)))
def health(spark, sf):
    pages = sorted_links(spark, sf)
    known = site_health.Sources(pages, crawl(spark, sf), N.sites(spark, sf), load(spark, sf, "sitemap_urls"), load(spark, sf, "inspections"))
    return site_health.findings(site_health.tables(known, N.AGENT)).select("project_id", "category", "severity", "title", "impact")


# --- exports -----------------------------------------------------------------------------------------


def _safe(column: str) -> str:
    return f"CASE WHEN regexp_matches(coalesce({column}, ''), '^[=+\\-@]') THEN chr(39) || {column} ELSE coalesce({column}, '') END"


@query("action_plan_csv", f"""SELECT project_id, {_safe('severity')} AS severidad, {_safe('category')} AS categoria, {_safe('title')} AS titulo, {_safe('current_text')} AS actual, {_safe('suggested_text')} AS sugerido,
    {_safe('effort')} AS esfuerzo, impact AS impacto, CAST(detected_at AS STRING) AS detectado_en FROM {LEDGER} l WHERE status = 'open'""")
def plan_csv(spark, sf):
    return files.action_plan_rows(ledger(spark, sf)).withColumn("detectado_en", F.col("detectado_en").cast("string"))


@query("disavow_lines", f"""SELECT project_id, source_domain, CAST(n AS INT) AS line_no, CASE n WHEN 0 THEN '# ' || reason ELSE 'domain:' || source_domain END AS value FROM (
    SELECT project_id, source_domain, min(reason) AS reason, unnest([0, 1]) AS n FROM {M.TOXIC} t GROUP BY 1, 2) d""")
def disavow(spark, sf):
    return files.disavow_lines(toxic_backlinks(M.backlinks(spark, sf)))


_TABLES = {"scorecards": "scorecards", "action_plan": "action_plan", "top_keywords": "top_queries", "near_top10": "near_top10", "keywords": "keywords_view",
           "ctr_curve": "ctr_curve", "ctr_summary": "ctr_summary", "score_deltas": "score_delta", "rank_standing": "keyword_standing", "vitals": "cwv_groups", "coverage": "coverage_counts"}


@query("report_tables", " UNION ALL ".join(
    [f"SELECT '{name}' AS table_name, project_id, count(*) AS rows FROM ({ORACLES[of]}) q GROUP BY 2" for name, of in _TABLES.items()] + [
        "SELECT DISTINCT 'local', project_id, 1 FROM {crawl_flat} c",
        "SELECT 'index_verdicts', project_id, count(DISTINCT coalesce(verdict, '')) FROM {inspections} i GROUP BY 2",
        f"""SELECT 'competitors', d.project_id, count(*) FROM (SELECT project_id, domain, count(DISTINCT keyword) AS n FROM {M.NOW} l WHERE domain <> {M.OWN_DOMAIN} GROUP BY 1, 2) d
            JOIN (SELECT project_id, count(DISTINCT keyword) AS total FROM {M.NOW} l GROUP BY 1) t ON t.project_id = d.project_id WHERE n >= CASE WHEN total <= 3 THEN 1 ELSE 2 END GROUP BY 2"""]))
def report_rows(spark, sf):
    """Rows and sites of every report table."""
    counted = [t.groupBy("project_id").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "project_id", "rows") for name, t in _report(spark, sf).items()]
    return reduce(lambda a, b: a.unionByName(b), counted)


def _report(spark, sf):
    return report.report_tables(
        N.sites(spark, sf), load(spark, sf, "daily_rows"), Q.rows(spark, sf), crawl(spark, sf), ledger(spark, sf), Q.scores(spark, sf), snapshots(spark, sf),
        load(spark, sf, "keyword_rows"), M.listings(spark, sf), load(spark, sf, "inspections"), load(spark, sf, "vital_rows"), load(spark, sf, "sitemap_urls"),
    )


# Columns that make up a row's text.
_SHOWN = {
    "scorecards": ["clicks_28d", "impressions_28d", "keywords_ranking", "issues_open", "issues_critical", "seo_score", "technical_score", "seo_score_delta"],
    "action_plan": ["severity", "category", "title", "effort", "impact", "priority_rank"], "top_keywords": ["query", "page", "impressions", "rank"],
    "near_top10": ["query", "page", "impressions"], "ctr_curve": ["bucket", "keywords", "impressions", "clicks"], "ctr_summary": ["total_clicks", "total_impressions", "reliable", "note"],
    "score_deltas": ["kind", "current", "previous", "delta"], "rank_standing": ["keyword", "our_position"], "coverage": ["crawled", "sitemap", "indexed", "inspected"],
}


@query("report_table_rows", " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, project_id, concat_ws('|', {', '.join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in columns)}) AS content FROM ({ORACLES[_TABLES[name]]}) q"
    for name, columns in _SHOWN.items()))
def report_table_rows(spark, sf):
    """The report's rows themselves, not their number."""
    tables = _report(spark, sf)
    shown = [
        tables[name].select(F.lit(name).alias("table_name"), "project_id", F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]).alias("content"))
        for name, columns in _SHOWN.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), shown)

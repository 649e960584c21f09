"""Listings, links from elsewhere, competitors."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlscope import constants as C
from crawlscope.catalog.audit_queries import HTML, INSIGHTS, features
from crawlscope.catalog.fixtures import crawl, linked_crawl, load
from crawlscope.catalog.graph_queries import flat, sites
from crawlscope.catalog.registry import ORACLES, query
from crawlscope.catalog.search_queries import CLOSURE, closure
from crawlscope.catalog.text_queries import sql_canonical, sql_in, sql_list, sql_words
from crawlscope.operators import backlinks as K
from crawlscope.operators import competitors as R
from crawlscope.operators import coverage as V
from crawlscope.operators import serp as P
from crawlscope.operators.page_rules import technical_score
from crawlscope.session import written


def listings(spark, sf):
    """Listings as they lie on disk: their operators read them several times, and building them joins and ranks."""
    return written(load(spark, sf, "listing_rows"))


def registered(spark, sf):
    return load(spark, sf, "registered_rivals")


# --- listings ----------------------------------------------------------------------------------------

_PLATFORM = f"len(list_filter({sql_list(C.PLATFORM_DOMAINS)}, lambda p: domain = p OR ends_with(domain, '.' || p))) > 0"
_OWN = "('www.site' || CAST(project_id AS STRING) || '.example')"
OWN_DOMAIN = "('site' || CAST(project_id AS STRING) || '.example')"
DISCOVERED = f"""(SELECT d.project_id, d.domain, appearances, best_position, avg_position, g.domain IS NOT NULL AS is_registered, {_PLATFORM.replace('domain', 'd.domain')} AS is_platform,
    round_even(appearances::DOUBLE / total, 2) AS share_of_keywords
  FROM (SELECT project_id, domain, count(DISTINCT keyword) AS appearances, min(position) AS best_position, round_even(sum(position)::DOUBLE / count(*), 1) AS avg_position
        FROM {{listing_rows}} l WHERE domain <> {OWN_DOMAIN} GROUP BY 1, 2) d
  JOIN (SELECT project_id, count(DISTINCT keyword) AS total FROM {{listing_rows}} l GROUP BY 1) t ON t.project_id = d.project_id
  LEFT JOIN (SELECT DISTINCT project_id, replace(domain, 'www.', '') AS domain FROM {{registered_rivals}} r) g ON g.project_id = d.project_id AND g.domain = d.domain
  WHERE appearances >= CASE WHEN total <= 3 THEN 1 ELSE 2 END)"""


@query("discover_competitors", f"SELECT * FROM {DISCOVERED} d")
def discover(spark, sf):
    return P.discover_competitors(listings(spark, sf), sites(spark, sf), registered(spark, sf))


@query("domain_keywords", f"SELECT project_id, domain, keyword, min(position) AS best_position FROM {{listing_rows}} l WHERE domain <> {OWN_DOMAIN} GROUP BY 1, 2, 3")
def domain_keywords(spark, sf):
    return P.domain_keywords(load(spark, sf, "listing_rows"), sites(spark, sf))


NOW = """(SELECT l.* FROM {listing_rows} l JOIN (SELECT project_id, max(date) AS newest FROM {listing_rows} m GROUP BY 1) n ON n.project_id = l.project_id AND l.date = n.newest)"""


@query("discover_competitors_newest", "SELECT * FROM " + DISCOVERED.replace("{listing_rows} l", NOW + " l") + " d")
def discover_newest(spark, sf):
    return P.discover_competitors(P.current(listings(spark, sf)), sites(spark, sf), registered(spark, sf))


_OURS = f"(is_ours OR domain = {OWN_DOMAIN})"
_BEATEN = f"""(SELECT *, min(position) FILTER (WHERE {_OURS}) OVER (PARTITION BY project_id, keyword) AS our_position,
    first_value(CASE WHEN {_OURS} THEN url END) OVER (PARTITION BY project_id, keyword ORDER BY CASE WHEN {_OURS} THEN position END NULLS LAST) AS our_url FROM {NOW} n)"""


@query("who_beats_us", f"""SELECT project_id, keyword, our_position, our_url, position, domain, url, {_PLATFORM} AS is_platform FROM {_BEATEN} b
    WHERE (our_position IS NULL OR position < our_position) AND domain <> {OWN_DOMAIN}""")
def beaten(spark, sf):
    return P.who_beats_us(P.current(listings(spark, sf)), sites(spark, sf))


STANDING = f"""(SELECT project_id, keyword, max(our_position) AS our_position, count(*) FILTER (WHERE (our_position IS NULL OR position < our_position) AND domain <> {OWN_DOMAIN}) AS beaten_by
    FROM {_BEATEN} b GROUP BY 1, 2)"""


@query("keyword_standing", f"SELECT * FROM {STANDING} s")
def standing(spark, sf):
    return P.keyword_standing(P.current(listings(spark, sf)), sites(spark, sf))


# Listed shops are measured by their product texts: one page per listing url.
_MEASURES = """(SELECT 'https://www.shop' || CAST(s_suppkey AS STRING) || '.example/list' AS url, CAST(s_suppkey * 13 % 700 AS INT) AS word_count, CAST(length(s_name) + s_nationkey AS INT) AS title_length,
      CAST(s_nationkey % 3 AS INT) AS h1_count, CAST(s_nationkey * 2 AS INT) AS links, CASE WHEN s_acctbal > 3000 THEN 'Product' ELSE '' END AS types, s_acctbal > 4000 AS has_author, s_nationkey > 9 AS has_date FROM {supplier}
    UNION ALL SELECT url, coalesce(word_count, 0), length(coalesce(title, '')), CASE WHEN h1 = '' THEN 0 ELSE len(string_split(h1, ' | ')) END, 0, schema_types, has_author, has_date FROM {crawl_flat} c)"""


def measures(spark, sf):
    shop = load(spark, sf, "supplier").select(
        F.concat(F.lit("https://www.shop"), F.col("s_suppkey").cast("string"), F.lit(".example/list")).alias("url"),
        (F.col("s_suppkey") * 13 % 700).cast("int").alias("word_count"), (F.length("s_name") + F.col("s_nationkey")).cast("int").alias("title_length"),
        (F.col("s_nationkey") % 3).cast("int").alias("h1_count"), (F.col("s_nationkey") * 2).cast("int").alias("links"),
        F.when(F.col("s_acctbal") > 3000, F.array(F.lit("Product"))).otherwise(F.array().cast("array<string>")).alias("schema_types"),
        (F.col("s_acctbal") > 4000).alias("has_author"), (F.col("s_nationkey") > 9).alias("has_date"),
    )
    own = P.page_measures(crawl(spark, sf).withColumns({"internal_links": F.array().cast("array<string>"), "word_count": F.coalesce("word_count", F.lit(0))}))
    return shop.unionByName(own)


_LISTED = """(SELECT l.* FROM {listing_rows} l JOIN (SELECT project_id, keyword, max(date) AS newest FROM {listing_rows} m GROUP BY 1, 2) n
    ON n.project_id = l.project_id AND n.keyword = l.keyword AND l.date = n.newest)"""
MEDIANS = f"""(SELECT project_id, keyword, count(*) AS pages_measured, CAST(trunc(median(word_count)) AS INT) AS median_word_count, CAST(trunc(median(title_length)) AS INT) AS median_title_length,
    CAST(trunc(median(h1_count)) AS INT) AS median_h1_count, CAST(trunc(median(links)) AS INT) AS median_links, round_even(avg(CAST(types <> '' AS INT)), 2) AS pct_with_schema,
    round_even(avg(CAST(has_author AS INT)), 2) AS pct_with_author, round_even(avg(CAST(has_date AS INT)), 2) AS pct_with_date,
    array_to_string(list_sort(list_distinct(flatten(list(CASE WHEN types = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(types, ',') END)))), ', ') AS common_schema_types
  FROM (SELECT *, row_number() OVER (PARTITION BY project_id, keyword ORDER BY position) AS rn FROM {_LISTED} l WHERE NOT is_ours) f JOIN {_MEASURES} m ON m.url = f.url GROUP BY 1, 2)"""


@query("serp_medians", f"SELECT * FROM {MEDIANS} m")
def medians(spark, sf):
    found = P.serp_medians(P.competitor_rows(listings(spark, sf), measures(spark, sf)))
    return found.withColumn("common_schema_types", F.array_join("common_schema_types", ", "))


def _difference(metric, condition, ours, top):
    return f"SELECT project_id, keyword, url, is_ranking_page, '{metric}' AS metric, CAST({ours} AS STRING) AS ours, CAST({top} AS STRING) AS top10 FROM ours WHERE {condition}"


@query("serp_compare", f"""
    WITH own AS (SELECT project_id, keyword, arg_min(url, position) FILTER (WHERE is_ours) AS own_url FROM {_LISTED} l GROUP BY 1, 2),
    chosen AS (SELECT project_id, keyword, coalesce(own_url, 'https://www.site' || CAST(project_id AS STRING) || '.example/') AS url, own_url IS NOT NULL AS is_ranking_page FROM own),
    ours AS (SELECT c.*, m.word_count, m.types, m.has_author, m.has_date, m.h1_count, d.* EXCLUDE (project_id, keyword) FROM chosen c JOIN {_MEASURES} m ON m.url = c.url
             JOIN {MEDIANS} d ON d.project_id = c.project_id AND d.keyword = c.keyword)
    """ + " UNION ALL ".join([
    _difference("content shorter", "median_word_count > 0 AND word_count < median_word_count * 0.6", "word_count", "median_word_count"),
    _difference("content longer", "median_word_count > 0 AND word_count > median_word_count * 1.8", "word_count", "median_word_count"),
    _difference("structured data", "types = '' AND pct_with_schema >= 0.5", "0", "CAST(trunc(pct_with_schema * 100) AS INT)"),
    _difference("author", "NOT has_author AND pct_with_author >= 0.5", "0", "CAST(trunc(pct_with_author * 100) AS INT)"),
    _difference("date", "NOT has_date AND pct_with_date >= 0.5", "0", "CAST(trunc(pct_with_date * 100) AS INT)"),
    _difference("h1", "h1_count = 0", "0", "median_h1_count")]))
def compare(spark, sf):
    return P.serp_compare(listings(spark, sf), sites(spark, sf), measures(spark, sf))


# --- links from elsewhere ----------------------------------------------------------------------------


def backlinks(spark, sf):
    return load(spark, sf, "backlink_rows")


@query("anchor_distribution", """
    SELECT *, round_even(count::DOUBLE / total * 100, 1) AS percentage, count::DOUBLE / total > 0.30 AS over_optimized FROM (
      SELECT a.project_id, anchor_text, n AS count, sum(n) OVER (PARTITION BY a.project_id) AS total FROM (
        SELECT project_id, trim(coalesce(nullif(anchor_text, ''), '(sin texto / imagen)')) AS anchor_text, count(*) AS n FROM {backlink_rows} b GROUP BY 1, 2) a) t""".replace("SELECT *, round", "SELECT project_id, anchor_text, count, round"))
def anchors(spark, sf):
    return K.anchor_distribution(backlinks(spark, sf))


TOXIC = f"""(SELECT project_id, source_domain, source_url, anchor_text, 'top-level domain .' || regexp_extract(source_domain, '[^.]*$') || ' is known for spam' AS reason
    FROM {{backlink_rows}} b WHERE regexp_extract(source_domain, '[^.]*$') IN {sql_in(C.SPAM_TLDS)})"""


@query("toxic_backlinks", f"SELECT * FROM {TOXIC} t")
def toxic(spark, sf):
    return K.toxic_backlinks(backlinks(spark, sf))


RECLAIM = f"""(SELECT b.project_id, source_url, source_domain, target_url, anchor_text, CASE WHEN x.url IS NOT NULL THEN 'broken' ELSE 'redirects' END AS finding,
    CASE WHEN x.url IS NULL THEN final END AS final_url
  FROM {{backlink_rows}} b LEFT JOIN (SELECT DISTINCT project_id, {sql_canonical('url')} AS url FROM {{crawl_flat}} c WHERE status_code >= 400) x ON x.project_id = b.project_id AND x.url = {sql_canonical('target_url')}
  LEFT JOIN ({CLOSURE}) k ON k.project_id = b.project_id AND k.source = {sql_canonical('target_url')}
  WHERE x.url IS NOT NULL OR final <> {sql_canonical('target_url')})"""


def reclaimed(spark, sf):
    return K.link_reclaim(backlinks(spark, sf), closure(spark, sf), V.broken_pages(flat(spark, sf)))


@query("link_reclaim", f"SELECT * FROM {RECLAIM} r")
def reclaim(spark, sf):
    return reclaimed(spark, sf)


# --- competitors -------------------------------------------------------------------------------------
# The hosts of the raw pages are the competitors of five shops.

_RIVALS = f"(SELECT page_id % 5 AS project_id, project_id AS competitor, page_id, title, h1, lang FROM {HTML} h)"


def rival_pages(spark, sf):
    return features(spark, sf).withColumns({"competitor": F.col("project_id"), "status_code": F.lit(200)}).withColumn("project_id", F.col("page_id") % 5)


@query("keyword_gap", f"""
    WITH own AS (SELECT DISTINCT project_id, unnest({sql_words('text')}) AS word FROM (SELECT doc_id % 5 AS project_id, text FROM {{documents}}) d),
    topics AS (SELECT project_id, competitor, min(trim(topic)) AS topic FROM (SELECT project_id, competitor, title AS topic FROM {_RIVALS} r UNION ALL SELECT project_id, competitor, h1 FROM {_RIVALS} r) t
               WHERE trim(topic) <> '' GROUP BY 1, 2, lower(trim(topic))),
    words AS (SELECT project_id, competitor, topic, unnest({sql_words('topic')}) AS word FROM topics)
    SELECT w.project_id, competitor, topic, count(o.word) AS shared_words, count(*) AS topic_words, round_even(count(o.word)::DOUBLE / count(*), 2) AS overlap_ratio
    FROM words w LEFT JOIN own o ON o.project_id = w.project_id AND o.word = w.word GROUP BY 1, 2, 3 HAVING count(o.word)::DOUBLE / count(*) <= 0.34""")
def gap(spark, sf):
    own = load(spark, sf, "documents").select((F.col("doc_id") % 5).alias("project_id"), F.col("text").alias("query"))
    return R.keyword_gap(own, R.competitor_topics(rival_pages(spark, sf)))


@query("competitive_matrix", f"""
    SELECT s.project_id, 'www.site' || CAST(s.project_id AS STRING) || '.example' AS domain, TRUE AS is_own_site, n AS pages_crawled, technical_score, NULL AS geo_score, NULL AS scanned_at, NULL AS note
    FROM {{sites}} s JOIN (SELECT project_id, count(*) AS n FROM {{crawl_flat}} c GROUP BY 1) c ON c.project_id = s.project_id
    LEFT JOIN ({ORACLES["technical_score"]}) t ON t.project_id = s.project_id
    UNION ALL
    SELECT r.project_id, r.domain, FALSE, n, lowest, highest, CAST(seen AS STRING), CASE WHEN n IS NULL THEN 'never scanned' END
    FROM {{registered_rivals}} r LEFT JOIN (
      SELECT project_id, domain, arg_max(n, seen) AS n, arg_max(lowest, seen) AS lowest, arg_max(highest, seen) AS highest, max(seen) AS seen FROM (
        SELECT project_id, CASE WHEN length(domain) > 13 THEN 'www.' ELSE 'other.' END || domain AS domain, CAST(date AS TIMESTAMP) AS seen, count(*) AS n, min(position) AS lowest, max(position) AS highest FROM {{listing_rows}} l
        GROUP BY 1, 2, 3) g GROUP BY 1, 2) x ON x.project_id = r.project_id AND x.domain = r.domain""")
def matrix(spark, sf):
    pages = crawl(spark, sf)
    own = pages.groupBy("project_id").agg(F.count(F.lit(1)).alias("pages_crawled")).join(technical_score(pages), "project_id", "left")
    own = own.withColumn("geo_score", F.lit(None).cast("int"))
    # short names were scanned under another host, so some rivals count as never scanned
    host = F.concat(F.when(F.length("domain") > 13, F.lit("www.")).otherwise(F.lit("other.")), "domain")
    scans = load(spark, sf, "listing_rows").groupBy(
        "project_id", host.alias("domain"), F.col("date").cast("timestamp").alias("scanned_at")
    ).agg(F.count(F.lit(1)).alias("pages_crawled"), F.min("position").alias("technical_score"), F.max("position").alias("geo_score"))
    return R.competitive_matrix(sites(spark, sf), registered(spark, sf), own, scans).withColumn("scanned_at", F.col("scanned_at").cast("string"))


def _share(flag: str) -> str:
    return f"CAST(round_even(100.0::DOUBLE * count(*) FILTER (WHERE {flag}) / count(*), 0) AS INT) AS {flag}_pct"


@query("competitor_comparison", f"""
    SELECT t.*, o.* EXCLUDE (project_id) FROM (
      SELECT project_id, competitor, count(*) AS pages, round_even(avg(words) FILTER (WHERE words > 0), 1) AS avg_word_count, round_even(avg(length(title)) FILTER (WHERE title <> ''), 1) AS avg_title_length,
             CAST(NULL AS DOUBLE) AS avg_meta_length, {_share('has_author')}, {_share('has_date')}, {_share('has_contact')}
      FROM (SELECT r.*, len(regexp_extract_all(body, '\\S+')) AS words, has_author, has_date, has_contact FROM {_RIVALS} r JOIN (SELECT page_id, body FROM {HTML} h) b ON b.page_id = r.page_id
            JOIN ({ORACLES["eeat_signals_html"]}) e ON e.page_id = r.page_id) r GROUP BY 1, 2) t
    LEFT JOIN (SELECT project_id, pages AS own_pages, avg_word_count AS own_avg_word_count, avg_title_length AS own_avg_title_length, avg_meta_length AS own_avg_meta_length,
      has_author_pct AS own_has_author_pct, has_date_pct AS own_has_date_pct, has_contact_pct AS own_has_contact_pct FROM ({INSIGHTS}) i) o ON o.project_id = t.project_id""")
def comparison(spark, sf):
    return R.competitor_comparison(crawl(spark, sf), rival_pages(spark, sf))


@query("schema_gap", """
    SELECT DISTINCT t.project_id, competitor, type FROM (
      SELECT project_id, CASE WHEN has_contact THEN 'a.example' ELSE 'b.example' END AS competitor, unnest(string_split(schema_types, ',')) AS type FROM {crawl_flat} c WHERE schema_types <> '') t
    WHERE NOT EXISTS (SELECT 1 FROM (SELECT project_id, unnest(string_split(schema_types, ',')) AS type FROM {crawl_flat} c WHERE is_indexable AND word_count < 400) o
      WHERE o.project_id = t.project_id AND o.type = t.type)""")
def schema_gap(spark, sf):
    pages = crawl(spark, sf)
    rivals = pages.withColumn("competitor", F.when(F.col("has_contact"), "a.example").otherwise("b.example"))
    # own pages that are long or not indexable state no types, so a gap is left
    stated = F.when(F.expr("is_indexable AND word_count < 400"), F.col("schema_types")).otherwise(F.array().cast("array<string>"))
    return R.schema_gap(pages.withColumn("schema_types", stated), rivals)

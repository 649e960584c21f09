"""Site-analytics inputs projected from the given tables.

Each projection is plain SQL that Spark and an independent SQL engine read alike, so an operator can be
checked against SQL over the very same input. Names in braces are tables or other projections.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()

# Parts are the pages of five shops; page 0 of a shop is its home page.
_BASE = "'https://www.site' || CAST({0} AS STRING) || '.example/'"
_PAGE = "CASE WHEN {1} = 0 THEN " + _BASE + " ELSE " + _BASE + " || 'p/' || CAST({1} AS STRING) END"


def _page(site: str, idx: str) -> str:
    return "(" + _PAGE.format(site, idx) + ")"


def _div(value: str, by: int) -> str:
    return f"CAST(floor({value} / {by}) AS BIGINT)"


PROJECTIONS: dict[str, str] = {
    "sites": f"""
        SELECT DISTINCT p_partkey % 5 AS project_id, {_BASE.format('(p_partkey % 5)')} AS url,
               'Shop ' || CAST(p_partkey % 5 AS STRING) AS name
        FROM {{part}}""",
    "shop_pages": f"""
        SELECT p_partkey % 5 AS project_id, {_div('p_partkey', 5)} AS idx, p_partkey, p_name, p_brand, p_type, p_size,
               p_retailprice
        FROM {{part}}""",
    # The crawl record of every page, with lists written as comma-separated text.
    "crawl_flat": f"""
        SELECT project_id, idx,
          CASE WHEN p_size = 50 THEN replace({_page('project_id', 'idx')}, 'https:', 'http:')
               WHEN p_size = 40 THEN replace({_page('project_id', 'idx')}, 'www.', '')
               ELSE {_page('project_id', 'idx')} END AS url,
          CASE WHEN p_size = 13 THEN 404 WHEN p_size = 37 THEN 500 WHEN p_size = 44 THEN NULL ELSE 200 END AS status_code,
          CASE WHEN floor(idx / 2) % 40 = 7 THEN {_page('project_id', '(idx + 1 - 2 * (idx % 2))')}
               WHEN p_size IN (7, 19) THEN {_page('project_id', '(idx + 1)')}
               WHEN p_size = 46 THEN {_page('project_id', _div('idx', 2))} || '?from=old' END AS redirected_to,
          CASE WHEN p_size = 5 THEN NULL WHEN p_size = 6 THEN '' WHEN p_size = 8 THEN p_name
               WHEN p_size IN (9, 10) THEN p_type || ' ' || p_name || ' repair | ' || p_brand || ' | ' || p_brand
               WHEN p_size IN (11, 12) THEN 'The best of our ' || p_name || ' and of your ' || lower(p_type) || ' range is in the shop at ' || p_brand
               WHEN p_size = 14 THEN p_name || ' ' || lower(p_type) || ' now'
               WHEN p_size = 16 THEN rpad('Reparación de ' || p_name || ' ', 65, 'y más ')
               ELSE 'Reparación ' || p_name || ' ' || lower(p_type) || ' | ' || p_brand END AS title,
          CASE WHEN p_size < 8 THEN NULL
               WHEN p_size < 30 THEN rpad('Servicio de ' || p_name || ', cotiza hoy ', 84 + p_size * 4, 'en la tienda ')
               ELSE rpad('Servicio de ' || p_name || ' en la ciudad ', 40 + p_size * 3, 'con los repuestos ') END AS meta_description,
          CASE WHEN p_size IN (3, 15) THEN '' WHEN p_size = 16 THEN 'REPARACIÓNiPhone ' || p_name
               WHEN p_size = 17 THEN 'Reparación iPHONE ' || p_name
               WHEN p_size IN (18, 20) THEN p_name || ' | ' || p_type
               ELSE p_type || ' ' || p_name END AS h1,
          CASE WHEN p_size < 8 THEN '' WHEN p_size < 16 THEN 'WebPage' WHEN p_size < 25 THEN 'LocalBusiness,ElectronicsRepair'
               WHEN p_size < 40 THEN 'Product' ELSE 'WebSite,Article' END AS schema_types,
          CASE WHEN p_size < 20 THEN 'name,telephone' WHEN p_size < 25 THEN 'name,location,openingHours,priceRange'
               WHEN p_size < 33 THEN 'name,image,description,brand,sku,offers' WHEN p_size < 40 THEN 'logo,brand'
               WHEN p_size < 45 THEN 'headline,author' ELSE 'author' END AS schema_fields,
          p_size IN (26, 45) AS schema_has_errors,
          CASE WHEN p_size > 10 THEN p_name END AS og_title,
          CASE WHEN p_size > 20 THEN p_type END AS og_description,
          CASE WHEN p_size > 30 THEN 'i.png' ELSE '' END AS og_image,
          CASE WHEN p_size = 21 THEN NULL
               WHEN p_size = 22 THEN replace({_page('project_id', 'idx')}, 'www.', '')
               ELSE {_page('project_id', 'idx')} END AS canonical,
          p_size NOT IN (3, 15, 25) AS is_indexable, p_size = 25 AS noindex_justified, 'es' AS lang_declared,
          CASE WHEN p_size = 1 THEN 'noindex, nofollow' WHEN p_size = 2 THEN 'Googlebot: NoIndex' WHEN p_size = 3 THEN 'none'
               WHEN p_size = 4 THEN 'max-snippet: 20' WHEN p_size = 24 THEN ' , ' END AS x_robots_tag,
          CASE WHEN p_size > 30 THEN 'gzip' END AS content_encoding,
          CASE WHEN p_size < 46 THEN 'max-age=0' END AS cache_control,
          CASE WHEN p_size <> 44 THEN CAST(p_size * 17 AS INT) END AS word_count,
          p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4') AS has_author, p_type = 'PROMO' AS has_date,
          p_size > 25 AS has_contact, lower(p_name) AS keyword,
          'Tel. 300 123 45' || CAST(10 + p_size % 3 AS STRING) || '. ' || p_name || ' de calidad. Servicio en la ciudad.' AS body_text,
          CASE WHEN p_size BETWEEN 16 AND 24 THEN '+57 300-123-4510' END AS schema_phone,
          CAST(40 + p_size AS INT) AS readability_score,
          CASE WHEN p_size % 9 <> 0 THEN CAST(p_size * 2 AS INT) END AS eeat_score,
          CAST('2024-01-01' AS DATE) AS crawled_on
        FROM {{shop_pages}}""",
    # Menu tree, links from every sold item to hub pages; some urls in another spelling.
    "link_rows": f"""
        SELECT project_id, {_div('idx', 3)} AS src_idx,
               CASE WHEN idx % 2 = 0 THEN {_page('project_id', 'idx')} || '#top'
                    ELSE replace({_page('project_id', 'idx')}, 'www.', '') || '/?from=menu' END AS href,
               FALSE AS nofollow
        FROM {{shop_pages}} WHERE idx > 0 AND p_size NOT IN (41, 42)
        UNION ALL
        SELECT DISTINCT l_partkey % 5, {_div('l_partkey', 5)}, {_page('(l_partkey % 5)', _div('l_suppkey', 5))},
               l_returnflag = 'R' AND l_linenumber = 1
        FROM {{lineitem}}""",
    "sitemap_urls": """
        SELECT project_id, replace(url, 'www.', '') AS url FROM {crawl_flat} WHERE content_encoding IS NULL
        UNION ALL
        SELECT s_suppkey % 5, 'https://www.site' || CAST(s_suppkey % 5 AS STRING) || '.example/s/' || CAST(s_suppkey AS STRING)
        FROM {supplier}""",
    "inspections": """
        SELECT project_id, url, CASE WHEN has_author THEN 'PASS' WHEN has_date THEN 'NEUTRAL' END AS verdict
        FROM {crawl_flat} WHERE has_contact OR has_author""",
    "search_rows": f"""
        SELECT l_partkey % 5 AS project_id, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS date,
               lower(p_type || ' ' || p_name) AS query,
               CASE WHEN l_linenumber = 7 THEN NULL WHEN l_suppkey % 3 = 0 THEN replace({_page('(l_partkey % 5)', _div('l_partkey', 5))}, 'www.', '')
                    WHEN l_suppkey % 7 = 0 THEN {_page('(l_partkey % 5)', _div('l_partkey', 5))} || '/'
                    ELSE {_page('(l_partkey % 5)', _div('l_partkey', 5))} END AS page,
               count(*) FILTER (WHERE l_returnflag = 'R' AND l_linenumber = 1) AS clicks,
               sum(CAST(floor(l_quantity) AS BIGINT)) AS impressions,
               1 + (min(l_orderkey) % 400) / 10e0 AS position
        FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey
        GROUP BY 1, 2, 3, 4""",
    "daily_rows": """
        SELECT o_custkey % 5 AS project_id, CAST(o_orderdate AS DATE) AS date,
               count(*) FILTER (WHERE o_orderstatus = 'F' AND (o_custkey % 5 <> 1 OR o_orderdate < CAST('1998-01-01' AS TIMESTAMP))) AS clicks,
               10 * count(*) AS impressions,
               1 + (min(o_orderkey) % 400) / 10e0 AS position
        FROM {orders} GROUP BY 1, 2""",
    "keyword_rows": """
        SELECT p_partkey % 5 AS project_id, lower(p_type || ' ' || p_name) AS keyword,
               CASE WHEN p_size < 25 THEN 'trends' ELSE 'trends_related' END AS source, CAST(p_size AS INT) AS volume,
               CASE WHEN p_size > 40 THEN 'comercial' WHEN p_size > 30 THEN 'local' WHEN p_size > 28 THEN 'other' END AS intent,
               max(p_partkey) AS last_updated
        FROM {part} GROUP BY 1, 2, 3, 4, 5""",
    # Result pages: suppliers of a keyword and quarter, ten to a page.
    "result_rows": f"""
        SELECT project_id, keyword, date, {_div('rn - 1', 10)} + 1 AS page, CAST((rn - 1) % 10 + 1 AS INT) AS position,
               CASE WHEN l_suppkey % 20 = 3 THEN 'https://www.site' || CAST(project_id AS STRING) || '.example/p/' || CAST(l_suppkey AS STRING)
                    WHEN l_suppkey % 20 = 4 THEN 'https://m.instagram.com/x/' || CAST(l_suppkey AS STRING)
                    WHEN l_suppkey % 20 = 5 THEN 'https://x.com/y' || CAST(l_suppkey AS STRING)
                    WHEN l_suppkey % 20 = 6 THEN NULL
                    ELSE 'https://www.shop' || CAST(l_suppkey AS STRING) || '.example/list' END AS link,
               'Listing ' || CAST(l_suppkey AS STRING) AS title
        FROM (SELECT *, row_number() OVER (PARTITION BY project_id, keyword, date ORDER BY first_order, l_suppkey) AS rn
              FROM (SELECT l_partkey % 5 AS project_id, lower(p_type || ' ' || substr(p_name, 1, 3)) AS keyword,
                           CAST(date_trunc('quarter', l_shipdate) AS DATE) AS date, l_suppkey, min(l_orderkey) AS first_order
                    FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4) g) r""",
    "listing_rows": """
        SELECT r.project_id, keyword, date, position, link AS url, replace(split_part(link, '/', 3), 'www.', '') AS domain,
               title, split_part(link, '/', 3) = 'www.site' || CAST(r.project_id AS STRING) || '.example' AS is_ours
        FROM {result_rows} r WHERE page = 1 AND link IS NOT NULL""",
    "registered_rivals": """
        SELECT s_suppkey % 5 AS project_id, 'www.shop' || CAST(s_suppkey AS STRING) || '.example' AS domain
        FROM {supplier} WHERE s_acctbal > 6000""",
    "backlink_rows": f"""
        SELECT o_custkey % 5 AS project_id,
               'https://www.blog' || CAST(o_custkey AS STRING) || '.example.' ||
                 CASE c_mktsegment WHEN 'BUILDING' THEN 'xyz' WHEN 'MACHINERY' THEN 'Top' ELSE 'com' END || ':8080/post/' ||
                 CAST(o_orderkey AS STRING) AS source_url,
               'blog' || CAST(o_custkey AS STRING) || '.example.' ||
                 CASE c_mktsegment WHEN 'BUILDING' THEN 'xyz' WHEN 'MACHINERY' THEN 'top' ELSE 'com' END AS source_domain,
               {_page('(o_custkey % 5)', _div('o_orderkey', 40))} AS target_url,
               CASE o_orderpriority WHEN '1-URGENT' THEN NULL WHEN '2-HIGH' THEN '' WHEN '3-MEDIUM' THEN ' visit shop '
                    ELSE lower(o_orderpriority) || ' ' || o_orderstatus END AS anchor_text
        FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey""",
    "score_rows": """
        SELECT user_id % 5 AS project_id, CAST(ts AS DATE) AS date,
               CASE event_type WHEN 'view' THEN 'seo' WHEN 'click' THEN 'technical' WHEN 'signup' THEN 'geo'
                    WHEN 'purchase' THEN 'local' ELSE 'content' END AS kind,
               CAST(count(*) * 7 % 101 AS INT) AS value
        FROM {events} GROUP BY 1, 2, 3""",
    "text_pages": """
        SELECT source AS project_id,
               CASE WHEN lang = 'de' THEN 'http://' ELSE 'https://' END || source || '.example/d/' || CAST(doc_id AS STRING) AS url,
               text AS body_text, lang
        FROM {documents}""",
    "header_rows": """
        SELECT s_suppkey AS project_id,
               CASE WHEN s_nationkey < 6 THEN NULL WHEN s_nationkey < 12 THEN 'max-age=' || CAST(s_suppkey * 400000 AS STRING)
                    WHEN s_nationkey < 15 THEN 'includeSubDomains' ELSE 'Max-Age=31536000; preload' END AS hsts,
               CASE WHEN s_nationkey % 4 = 0 THEN NULL WHEN s_nationkey % 4 = 1 THEN 'default-src ''self''; script-src ''Unsafe-Inline'' ''unsafe-eval'''
                    WHEN s_nationkey % 4 = 2 THEN 'frame-ancestors ''none''' ELSE 'default-src ''self''' END AS csp,
               CASE WHEN s_acctbal > 4000 THEN 'SAMEORIGIN' END AS xfo, CASE WHEN s_acctbal > 2000 THEN 'nosniff' END AS xcto,
               CASE WHEN s_acctbal > 5000 THEN 'no-referrer' ELSE '' END AS referrer
        FROM {supplier}""",
    "robots_rows": """
        SELECT s_suppkey AS project_id, s_acctbal > 5000 AS llms_txt, s_acctbal > 8000 AS llms_full_txt,
               'User-agent: CCBot' || chr(10) || CASE WHEN s_nationkey < 12 THEN 'Disallow: /' ELSE 'Disallow:' END || chr(10) || chr(10) ||
               CASE WHEN s_nationkey % 3 = 0 THEN 'User-agent: GPTBot' || chr(10) || 'User-agent: ClaudeBot' || chr(10) || 'Disallow: /' || chr(10) || chr(10) ELSE '' END ||
               'User-agent: *' || chr(10) || 'Allow: /part/1' || chr(10) ||
               CASE WHEN s_nationkey % 2 = 0 THEN 'Disallow: /part/2' || chr(10) || 'Disallow: /añejo' ELSE 'Disallow: /zz' END || chr(10) AS robots_txt,
               s_nationkey
        FROM {supplier}""",
    "shop_urls": """
        SELECT DISTINCT l_suppkey AS project_id,
               'https://shop' || CAST(l_suppkey AS STRING) || '.example' ||
               CASE WHEN l_returnflag = 'N' THEN '/a%C3%B1ejo/' ELSE '/part/' END || CAST(l_partkey AS STRING) || '?f=' || l_returnflag AS url
        FROM {lineitem}""",
    "vital_rows": """
        SELECT project_id, url, CAST(crawled_on AS DATE) AS date, CAST(idx * 37 % 6000 AS BIGINT) AS lcp_ms,
               CASE WHEN has_contact THEN (idx * 7 % 400) / 1000e0 END AS cls, CAST(idx * 13 % 900 AS BIGINT) AS tbt_ms,
               (idx * 11 % 101) / 100e0 AS performance
        FROM {crawl_flat}""",
    "session_rows": """
        SELECT o_custkey % 5 AS project_id, '/landing/' || lower(substr(o_orderpriority, 3)) || '/' || CAST(o_custkey AS STRING) AS landing_page,
               count(*) AS sessions, count(DISTINCT o_orderstatus) AS users,
               count(*) FILTER (WHERE o_orderstatus = 'F') AS conversions
        FROM {orders} GROUP BY 1, 2""",
    "trend_points": """
        SELECT o_custkey % 5 AS project_id, lower(o_orderpriority) AS keyword, CAST(o_orderdate AS DATE) AS date, count(*) AS value
        FROM {orders} GROUP BY 1, 2, 3""",
    "related_rows": """
        SELECT p_partkey % 5 AS project_id, lower(p_name) AS seed, CASE WHEN p_size % 2 = 0 THEN 'top' ELSE 'rising' END AS relation,
               lower(p_type) || ' ' || p_name || ' ' || lower(p_brand) AS query,
               CASE WHEN p_size > 40 THEN 'Breakout' ELSE CAST(p_size AS STRING) END AS value
        FROM {part}""",
    "suggestion_rows": """
        SELECT p_partkey % 5 AS project_id, p_name AS seed, p_partkey AS position,
               CASE WHEN p_size < 10 THEN '¿Cómo reparar ' || p_name || '?' WHEN p_size < 20 THEN 'POR QUÉ FALLA ' || upper(p_name) || ' ' || p_type
                    WHEN p_size < 25 THEN p_name WHEN p_size < 35 THEN 'dónde comprar barato'
                    WHEN p_size < 45 THEN 'cuánto cuesta ' || p_name || ' ' || lower(p_type) || ' ' || p_brand
                    ELSE p_name || ' precio' END AS suggestion
        FROM {part}""",
    "question_rows": """
        SELECT DISTINCT project_id, suggestion AS question FROM {suggestion_rows}
        UNION
        SELECT DISTINCT p_partkey % 5, p_name FROM {part}""",
    "answer_rows": """
        SELECT conv_id % 5 AS project_id, role AS provider, CASE WHEN turn % 2 = 1 THEN 'category' ELSE 'brand' END AS prompt_type,
               'prompt ' || CAST(conv_id AS STRING) AS prompt, text AS response_text, turn AS checked_at
        FROM {conversations}""",
    "answer_sites": """
        SELECT DISTINCT conv_id % 5 AS project_id, 'https://éTH' || '.shop.example/' AS url, 'Thé' AS name FROM {conversations}""",
}


def render(text: str, tables: dict[str, str]) -> str:
    """Fill in table names and, where a projection is named, its own text in parentheses."""

    def fill(match: re.Match) -> str:
        name = match.group(1)
        if name in tables:
            return tables[name]
        return "(" + render(PROJECTIONS[name], tables) + ")" if name in PROJECTIONS else match.group(0)

    return re.sub(r"\{(\w+)\}", fill, text)


def duck(text: str) -> str:
    """The text over plain table names."""
    return render(text, {t: t for t in TABLES})


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a projection of the given tables."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tables = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    # Parts are a few megabytes whatever their number, so one or two tasks would build and judge all pages.
    spread = render(PROJECTIONS["shop_pages"], tables).replace("SELECT", "SELECT /*+ REPARTITION(p_partkey) */", 1)
    return spark.sql(render(f"SELECT * FROM {{{name}}}", tables | {"shop_pages": f"({spread})"}))


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`crawl_flat` with real lists, structs and links: the shape of a crawl record."""
    words = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, ","))
    flat = load(spark, sf_dir, "crawl_flat")
    return flat.select(
        *[c for c in flat.columns if c not in ("schema_types", "schema_fields", "og_title", "og_description", "og_image", "schema_phone")],
        F.when(F.col("h1") == "", F.array().cast("array<string>")).otherwise(F.split("h1", r" \| ")).alias("h1_tags"),
        words("schema_types").alias("schema_types"),
        F.struct(F.col("og_title").alias("title"), F.col("og_description").alias("description"), F.col("og_image").alias("image")).alias("og"),
        F.array(F.struct(words("schema_types").alias("types"), words("schema_fields").alias("fields"))).alias("schema_nodes"),
        F.when(F.col("schema_phone").isNotNull(), F.struct(F.lit("Shop").alias("name"), F.col("schema_phone").alias("telephone"))).alias("local_business_schema"),
    )


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`link_rows` as two lists per page, `internal_links` and `nofollow_internal`.

    Sold items are dealt once by page, made distinct and listed as numbers; only the lists are put into urls.
    """
    keys = ["project_id", "idx"]
    sold = load(spark, sf_dir, "lineitem").selectExpr(
        "l_partkey % 5 AS project_id", f"{_div('l_partkey', 5)} AS idx", f"{_div('l_suppkey', 5)} AS hub",
        "l_returnflag = 'R' AND l_linenumber = 1 AS nofollow",
    ).repartition(*keys).distinct()
    # an even number for a followed link, an odd one for a link with nofollow
    items = sold.groupBy(*keys).agg(F.collect_list(F.col("hub") * 2 + F.when(F.col("nofollow"), 1).otherwise(0)).alias("_sold"))
    menu = load(spark, sf_dir, "shop_pages").filter("idx > 0 AND p_size NOT IN (41, 42)").selectExpr(
        "project_id", f"{_div('idx', 3)} AS idx",
        f"CASE WHEN idx % 2 = 0 THEN {_page('project_id', 'idx')} || '#top' ELSE replace({_page('project_id', 'idx')}, 'www.', '') || '/?from=menu' END AS href",
    ).groupBy(*keys).agg(F.collect_list("href").alias("_menu"))
    hubs = f"x -> {_page('project_id', _div('x', 2))}"
    return items.join(menu, keys, "full").selectExpr(
        *keys, f"concat(coalesce(_menu, CAST(array() AS ARRAY<STRING>)), coalesce(transform(_sold, {hubs}), CAST(array() AS ARRAY<STRING>))) AS internal_links",
        f"coalesce(transform(filter(_sold, x -> x % 2 <> 0), {hubs}), CAST(array() AS ARRAY<STRING>)) AS nofollow_internal",
    )


def linked_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawl with its links: a page lists a few dozen of them."""
    empty = F.array().cast("array<string>")
    # lists of numbers look small enough to broadcast, and then one task would put them all into urls
    return crawl(spark, sf_dir).join(page_links(spark, sf_dir).hint("merge"), ["project_id", "idx"], "left").withColumns(
        {
            "internal_links": F.coalesce("internal_links", empty), "nofollow_internal": F.coalesce("nofollow_internal", empty),
            "nofollow_external_count": F.size("h1_tags"),
        }
    )

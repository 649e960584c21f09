"""Redirects, internal links and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlscope.catalog.fixtures import crawl, linked_crawl, load
from crawlscope.catalog.registry import query
from crawlscope.catalog.search_queries import CLOSURE
from crawlscope.catalog.text_queries import sql_canonical
from crawlscope.operators import coverage as V
from crawlscope.operators import links as L
from crawlscope.sources import robots as B

AGENT = "SiteCheck/1.0"


def flat(spark, sf):
    return load(spark, sf, "crawl_flat")


def sites(spark, sf):
    return load(spark, sf, "sites")


_RAW_EDGES = f"""SELECT project_id, {sql_canonical('url')} AS source, {sql_canonical('redirected_to')} AS target, url FROM {{crawl_flat}} c WHERE redirected_to IS NOT NULL"""
REDIRECTS = f"(SELECT project_id, source, arg_max(target, (url, target)) AS target FROM ({_RAW_EDGES}) e WHERE source <> target GROUP BY 1, 2)"


@query("redirect_edges", f"SELECT * FROM {REDIRECTS} r")
def redirect_edges(spark, sf):
    return L.redirect_edges(flat(spark, sf))


@query("redirect_closure", CLOSURE)
def redirect_closure(spark, sf):
    return L.redirect_closure(L.redirect_edges(flat(spark, sf)))


@query("resolve_redirects", f"""
    WITH closure AS ({CLOSURE})
    SELECT r.project_id, page, coalesce(final, {sql_canonical('page')}) AS final_url, rows
    FROM (SELECT project_id, page, count(*) AS rows FROM {{search_rows}} s WHERE page IS NOT NULL GROUP BY 1, 2) r
    LEFT JOIN closure k ON k.project_id = r.project_id AND k.source = {sql_canonical('page')}""")
def resolve(spark, sf):
    seen = load(spark, sf, "search_rows").filter("page IS NOT NULL").groupBy("project_id", "page").agg(F.count(F.lit(1)).alias("rows"))
    return L.resolve(seen, "page", L.redirect_closure(L.redirect_edges(flat(spark, sf))))


@query("redirect_alias_filter", f"""
    SELECT c.project_id, url FROM {{crawl_flat}} c WHERE NOT EXISTS (
      SELECT 1 FROM {REDIRECTS} r WHERE r.project_id = c.project_id AND r.source = {sql_canonical('c.url')})""")
def alias_filter(spark, sf):
    return L.redirect_alias_filter(flat(spark, sf), L.redirect_edges(flat(spark, sf))).select("project_id", "url")


@query("redirect_map_merge", f"""
    SELECT coalesce(o.project_id, n.project_id) AS project_id, coalesce(o.source, n.source) AS source, coalesce(n.target, o.target) AS target
    FROM {REDIRECTS} o FULL JOIN (
      SELECT project_id, {sql_canonical('url')} || CASE WHEN word_count > 100 THEN '' ELSE '/moved' END AS source, {sql_canonical('canonical')} AS target FROM {{crawl_flat}} c
      WHERE redirected_to IS NOT NULL AND {sql_canonical('url')} <> {sql_canonical('redirected_to')}) n
    ON n.project_id = o.project_id AND n.source = o.source""")
def map_merge(spark, sf):
    from crawlscope.functions.urls import canonical_url

    persisted = L.redirect_edges(flat(spark, sf))
    moved = flat(spark, sf).filter("redirected_to IS NOT NULL")
    moved = moved.filter(canonical_url(F.col("url")) != canonical_url(F.col("redirected_to")))
    # short pages have moved to a place that the kept map does not know
    source = F.concat(canonical_url(F.col("url")), F.when(F.col("word_count") > 100, F.lit("")).otherwise(F.lit("/moved")))
    fresh = moved.select("project_id", source.alias("source"), canonical_url(F.col("canonical")).alias("target"))
    return L.redirect_map_merge(persisted, fresh)


# --- internal links ----------------------------------------------------------------------------------

NODES = f"(SELECT DISTINCT project_id, {sql_canonical('url')} AS node FROM {{crawl_flat}} c)"
EDGES = f"""(SELECT DISTINCT l.project_id, {sql_canonical('c.url')} AS source, {sql_canonical('l.href')} AS target
    FROM {{link_rows}} l JOIN {{crawl_flat}} c ON c.project_id = l.project_id AND c.idx = l.src_idx
    JOIN {NODES} n ON n.project_id = l.project_id AND n.node = {sql_canonical('l.href')}
    WHERE {sql_canonical('c.url')} <> {sql_canonical('l.href')})"""
INBOUND = f"""(SELECT n.project_id, n.node, count(e.source) AS inbound FROM {NODES} n
    LEFT JOIN {EDGES} e ON e.project_id = n.project_id AND e.target = n.node GROUP BY 1, 2)"""
HOMES = f"(SELECT project_id, {sql_canonical('url')} AS node FROM {{sites}} s)"
# The first level at which a page is met; pages already met earlier stay where they are.
DEPTH = f"""(WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {EDGES} x), walk AS (
      SELECT project_id, node, 0 AS click_depth FROM {HOMES} h
      UNION SELECT e.project_id, e.target, w.click_depth + 1 FROM walk w JOIN e ON e.project_id = w.project_id AND e.source = w.node WHERE w.click_depth < 12)
    SELECT project_id, node, min(click_depth) AS click_depth FROM walk GROUP BY 1, 2)"""


@query("link_edges", f"SELECT * FROM {EDGES} e")
def link_edges(spark, sf):
    return L.link_edges(linked_crawl(spark, sf))


@query("inbound_counts", f"SELECT * FROM {INBOUND} i")
def inbound(spark, sf):
    return L.inbound_counts(linked_crawl(spark, sf))


ORPHANS = f"""SELECT c.project_id, c.url FROM {{crawl_flat}} c JOIN {INBOUND} i ON i.project_id = c.project_id AND i.node = {sql_canonical('c.url')}
    LEFT JOIN {HOMES} h ON h.project_id = c.project_id AND h.node = i.node
    WHERE status_code = 200 AND is_indexable AND inbound = 0 AND h.node IS NULL"""


@query("orphans", ORPHANS)
def orphans(spark, sf):
    return L.orphans(linked_crawl(spark, sf), sites(spark, sf))


@query("click_depth", f"SELECT * FROM {DEPTH} d")
def click_depth(spark, sf):
    return L.click_depth(L.out_links(linked_crawl(spark, sf)), sites(spark, sf))


LINK_TABLE = f"""SELECT c.project_id, c.url, inbound, click_depth, h.node IS NULL AND inbound <= 1 AS weak, coalesce(click_depth >= 4, FALSE) AS deep
    FROM {{crawl_flat}} c JOIN {INBOUND} i ON i.project_id = c.project_id AND i.node = {sql_canonical('c.url')}
    LEFT JOIN {DEPTH} d ON d.project_id = i.project_id AND d.node = i.node
    LEFT JOIN {HOMES} h ON h.project_id = i.project_id AND h.node = i.node WHERE status_code = 200"""


def link_table(spark, sf):
    return L.link_table(linked_crawl(spark, sf), sites(spark, sf))


@query("link_table", LINK_TABLE)
def table(spark, sf):
    return link_table(spark, sf)


@query("weak_pages", f"SELECT project_id, url, inbound, click_depth FROM ({LINK_TABLE}) t WHERE weak")
def weak(spark, sf):
    return L.weak_pages(link_table(spark, sf))


@query("deep_pages", f"SELECT project_id, url, inbound, click_depth FROM ({LINK_TABLE}) t WHERE deep")
def deep(spark, sf):
    return L.deep_pages(link_table(spark, sf))


@query("nofollow_summary", """
    SELECT c.project_id, count(*) FILTER (WHERE n > 0) AS nofollow_pages, sum(n) AS nofollow_links, sum(external) AS nofollow_external
    FROM (SELECT c.project_id, c.idx, (SELECT count(*) FROM {link_rows} l WHERE l.project_id = c.project_id AND l.src_idx = c.idx AND nofollow) AS n,
                 CASE WHEN h1 = '' THEN 0 ELSE len(string_split(h1, ' | ')) END AS external FROM {crawl_flat} c) c GROUP BY 1""")
def nofollow(spark, sf):
    return L.nofollow_summary(linked_crawl(spark, sf))


# --- coverage ----------------------------------------------------------------------------------------

BASE = f"""(SELECT project_id, url, bool_or(s) AS sitemap, bool_or(c) AS crawled, bool_or(i) AS indexed, bool_or(n) AS inspected FROM (
    SELECT project_id, {sql_canonical('url')} AS url, FALSE AS s, TRUE AS c, FALSE AS i, FALSE AS n FROM {{crawl_flat}} a WHERE status_code = 200
    UNION ALL SELECT project_id, {sql_canonical('url')}, TRUE, FALSE, FALSE, FALSE FROM {{sitemap_urls}} b
    UNION ALL SELECT project_id, {sql_canonical('url')}, FALSE, FALSE, coalesce(verdict = 'PASS', FALSE), TRUE FROM {{inspections}} d) u GROUP BY 1, 2)"""
DIFF = f"""SELECT project_id, 'in_sitemap_not_crawled' AS difference, url FROM {BASE} b WHERE sitemap AND NOT crawled
    UNION ALL SELECT project_id, 'crawled_not_in_sitemap', url FROM {BASE} b WHERE crawled AND NOT sitemap
    UNION ALL SELECT project_id, 'sitemap_not_indexed', url FROM {BASE} b WHERE sitemap AND inspected AND NOT indexed
    UNION ALL SELECT project_id, 'sitemap_not_inspected', url FROM {BASE} b WHERE sitemap AND NOT inspected
    UNION ALL SELECT project_id, 'indexed_not_in_sitemap', url FROM {BASE} b WHERE indexed AND NOT sitemap"""


def coverage(spark, sf):
    return V.coverage_base(flat(spark, sf), load(spark, sf, "sitemap_urls"), load(spark, sf, "inspections"))


@query("coverage_diff", DIFF)
def diff(spark, sf):
    return V.coverage_diff(coverage(spark, sf))


@query("coverage_diff_without_index", f"""SELECT project_id, 'in_sitemap_not_crawled' AS difference, url FROM {BASE} b WHERE sitemap AND NOT crawled
    UNION ALL SELECT project_id, 'crawled_not_in_sitemap', url FROM {BASE} b WHERE crawled AND NOT sitemap""")
def diff_without_index(spark, sf):
    return V.coverage_diff(V.coverage_base(flat(spark, sf), load(spark, sf, "sitemap_urls")))


@query("coverage_counts", f"""SELECT project_id, count(*) FILTER (WHERE crawled) AS crawled, count(*) FILTER (WHERE sitemap) AS sitemap,
    count(*) FILTER (WHERE indexed) AS indexed, count(*) FILTER (WHERE inspected) AS inspected FROM {BASE} b GROUP BY 1""")
def counts(spark, sf):
    return V.coverage_counts(coverage(spark, sf))


@query("broken_pages", "SELECT project_id, url, status_code FROM {crawl_flat} c WHERE status_code >= 400")
def broken(spark, sf):
    return V.broken_pages(crawl(spark, sf))


@query("redirect_links", f"SELECT project_id, url, redirected_to FROM {{crawl_flat}} c WHERE {sql_canonical('redirected_to')} <> '' AND {sql_canonical('url')} <> {sql_canonical('redirected_to')}")
def redirect_links(spark, sf):
    return V.redirect_links(crawl(spark, sf))


@query("robots_rules", """
    SELECT project_id, agent, allow, path FROM (
      SELECT project_id, 'ccbot' AS agent, s_nationkey >= 12 AS allow, CASE WHEN s_nationkey < 12 THEN '/' ELSE '' END AS path FROM {robots_rows} r
      UNION ALL SELECT project_id, unnest(['gptbot', 'claudebot']), FALSE, '/' FROM {robots_rows} r WHERE s_nationkey % 3 = 0
      UNION ALL SELECT project_id, '*', TRUE, '/part/1' FROM {robots_rows} r
      UNION ALL SELECT project_id, '*', FALSE, unnest(CASE WHEN s_nationkey % 2 = 0 THEN ['/part/2', '/a%C3%B1ejo'] ELSE ['/zz'] END) FROM {robots_rows} r) x""")
def robots_rules(spark, sf):
    return B.robots_rules(load(spark, sf, "robots_rows")).select("project_id", "agent", "allow", "path")


@query("robots_sitemap_conflicts", """
    SELECT u.project_id, url FROM {shop_urls} u JOIN {robots_rows} r ON r.project_id = u.project_id
    WHERE s_nationkey % 2 = 0 AND (contains(url, '/part/2') OR contains(url, '/a%C3%B1ejo'))""")
def conflicts(spark, sf):
    return V.robots_sitemap_conflicts(load(spark, sf, "shop_urls"), load(spark, sf, "robots_rows"), AGENT)

"""Landed payloads. Each query writes table rows as the JSON a collector lands and reads them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlscope import constants as C
from crawlscope.catalog.fixtures import crawl, load
from crawlscope.catalog.graph_queries import sites
from crawlscope.catalog.registry import query
from crawlscope.catalog.text_queries import sql_list
from crawlscope.functions.urls import domain_of
from crawlscope.plans import ingest as N
from crawlscope.session import scratch
from crawlscope.sources import landing as I
from crawlscope.sources import payloads as P
from crawlscope.sources import sitemaps as X


def payload(rows: DataFrame, *columns: Column) -> DataFrame:
    return rows.select("project_id", F.to_json(F.struct(*columns)).alias("raw_data"))


def one(name: str, *fields: Column) -> Column:
    return F.array(F.struct(*fields)).alias(name)


# --- snapshots and crawl -----------------------------------------------------------------------------

_SNAPSHOTS = """(SELECT event_id AS snapshot_id, user_id % 5 AS project_id, CASE event_type WHEN 'view' THEN 'crawler' WHEN 'click' THEN 'sitemap' ELSE 'gsc' END AS collector,
    CASE WHEN value > 20 THEN 'error' WHEN value > 10 THEN 'partial' ELSE 'ok' END AS status, props AS raw_data FROM {events})"""


@query("latest_snapshot", f"SELECT project_id, max(snapshot_id) AS snapshot_id, arg_max(raw_data, snapshot_id) AS raw_data FROM {_SNAPSHOTS} s WHERE collector = 'crawler' AND status IN ('ok', 'partial') GROUP BY 1")
def latest_snapshot(spark, sf):
    kind, value = F.col("event_type"), F.col("value")
    landed = load(spark, sf, "events").select(
        F.col("event_id").alias("snapshot_id"), (F.col("user_id") % 5).alias("project_id"),
        F.when(kind == "view", "crawler").when(kind == "click", "sitemap").otherwise("gsc").alias("collector"),
        F.when(value > 20, "error").when(value > 10, "partial").otherwise("ok").alias("status"), F.col("props").alias("raw_data"),
    )
    return I.latest_snapshot(landed, "crawler")


@query("crawl_pages", """SELECT project_id, url, status_code, title, meta_description, h1, schema_types, is_indexable, word_count, redirected_to, x_robots_tag,
    schema_phone AS telephone, og_image, schema_fields FROM {crawl_flat} c""")
def crawl_pages(spark, sf):
    pages = crawl(spark, sf)
    return _flat_record(P.read_records(spark, landed(pages, F.lit(1)), "pages", I.CRAWL_PAGE))


def landed(pages: DataFrame, snapshot: Column) -> str:
    """A folder of payloads, each of many records."""
    spark = pages.sparkSession
    record = [c for c in pages.columns if c not in ("project_id", "crawled_on")]
    folder = scratch(spark)
    part = F.pmod(F.xxhash64("url"), F.lit(16))  # several payloads of a site's snapshot, as a collector lands a crawl in portions
    parts = pages.groupBy("project_id", snapshot.cast("long").alias("snapshot_id"), part.alias("_part")).agg(F.collect_list(F.struct(*record)).alias("_rows"))
    errors = F.array(F.lit('{"pages":[{"url":"none"}]}')).alias("errors")
    parts.select(
        "project_id", "snapshot_id", F.to_json(F.struct(errors, F.col("_rows").alias("pages"))).alias("value"),
    ).write.partitionBy("project_id", "snapshot_id").text(folder)
    return folder


def _flat_record(rows: DataFrame) -> DataFrame:
    return rows.select(
        "project_id", "url", "status_code", "title", "meta_description", F.array_join("h1_tags", " | ").alias("h1"), F.array_join("schema_types", ",").alias("schema_types"),
        "is_indexable", "word_count", "redirected_to", "x_robots_tag", F.col("local_business_schema.telephone").alias("telephone"), F.col("og.image").alias("og_image"),
        F.array_join(F.get("schema_nodes", F.lit(0))["fields"], ",").alias("schema_fields"),
    )


@query("latest_crawl_pages", """
    SELECT project_id, CASE WHEN project_id % 2 = 0 THEN 3 ELSE 1 END AS snapshot_id, url, CASE WHEN project_id % 2 = 0 THEN title || ' v3' ELSE title END AS title
    FROM {crawl_flat} c WHERE project_id % 2 = 0 OR NOT has_contact""")
def latest_crawl_pages(spark, sf):
    """Three snapshots per site, of which odd sites' newest has failed and their second is another collector's."""
    pages = crawl(spark, sf)
    once = pages.filter((F.col("project_id") % 2 == 0) | ~F.col("has_contact")).withColumn("snapshot_id", F.lit(1))
    again = pages.filter(F.col("project_id") % 2 == 0).withColumns({"snapshot_id": F.lit(3), "title": F.concat("title", F.lit(" v3"))})
    failed = pages.filter(F.col("project_id") % 2 == 1).withColumn("snapshot_id", F.lit(3))
    folder = landed(once.unionByName(again).unionByName(failed).drop("crawled_on"), F.col("snapshot_id"))
    index = sites(spark, sf).select("project_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("snapshot_id"))
    index = index.withColumns({
        "collector": F.when(F.col("snapshot_id") == 2, "sitemap").otherwise("crawler"),
        "status": F.when((F.col("snapshot_id") == 3) & (F.col("project_id") % 2 == 1), "error").otherwise("ok")})
    records = P.read_records(spark, folder, "pages", I.CRAWL_PAGE, P.newest_payloads(index, "crawler"))
    return P.last_of(records, ["project_id", "snapshot_id", "url"]).select("project_id", "snapshot_id", "url", "title")


# --- search performance ------------------------------------------------------------------------------


@query("gsc_daily_ingest", "SELECT project_id, CAST(date AS STRING) AS date, coalesce(nullif(clicks, 2), 0) AS clicks, impressions, 0e0 AS ctr, position FROM {daily_rows} d")
def gsc_daily(spark, sf):
    rows = load(spark, sf, "daily_rows")
    landed = payload(rows, one("daily", F.array(F.col("date").cast("string")).alias("keys"), F.nullif("clicks", F.lit(2)).alias("clicks"), F.col("impressions"), F.col("position")))
    return I.gsc_daily_ingest(landed).withColumn("date", F.col("date").cast("string"))


@query("gsc_queries_ingest", "SELECT project_id, '2001-06-30' AS date, query, page, clicks, impressions, 0.5e0 AS ctr, position FROM {search_rows} s")
def gsc_queries(spark, sf):
    rows = load(spark, sf, "search_rows")
    landed = payload(rows, F.lit("2001-06-30").alias("end_date"), one("queries", F.array("query", "page").alias("keys"), F.col("clicks"), F.col("impressions"), F.lit(0.5).alias("ctr"), F.col("position")))
    return I.gsc_queries_ingest(landed).withColumn("date", F.col("date").cast("string"))


def exports(spark, sf):
    from pyspark.sql.types import StructType

    daily = load(spark, sf, "daily_rows").select("project_id", F.to_json(F.struct(
        F.col("project_id").cast("string").alias("project_slug"), F.lit("2001-06-30").alias("end_date"),
        one("daily", F.col("date").cast("string").alias("date"), (F.col("clicks")).alias("clicks"), (F.col("impressions") - 10).alias("impressions"), F.col("position")),
    )).alias("raw"))
    found = load(spark, sf, "search_rows").select("project_id", F.to_json(F.struct(
        F.col("project_id").cast("string").alias("project_slug"), F.lit("2001-06-30").alias("end_date"), one("queries", "query", "page", "clicks", "impressions", "position"),
    )).alias("raw"))
    schema = StructType.fromDDL(I.EXPORT_SCHEMA)
    return daily.unionByName(found).select(F.from_json("raw", schema).alias("p")).select("p.*")


@query("export_daily", "SELECT CAST(project_id AS STRING) AS project_slug, CAST(date AS STRING) AS date, clicks, impressions - 10 AS impressions, coalesce(clicks::DOUBLE / nullif(impressions - 10, 0), 0) AS ctr, position FROM {daily_rows} d")
def export_daily(spark, sf):
    return I.export_daily(exports(spark, sf)).withColumn("date", F.col("date").cast("string"))


@query("export_queries", "SELECT CAST(project_id AS STRING) AS project_slug, '2001-06-30' AS date, query, page, clicks, impressions, clicks::DOUBLE / impressions AS ctr, position FROM {search_rows} s")
def export_queries(spark, sf):
    return I.export_queries(exports(spark, sf)).withColumn("date", F.col("date").cast("string"))


def twice(rows: DataFrame, site: str, record: Column, name: str) -> DataFrame:
    """Payloads of several records each: snapshot 1 lands all rows, snapshot 2 again those with an even number of impressions, one click more."""
    again = rows.filter("impressions % 2 = 0").withColumns({"clicks": F.col("clicks") + 1, "snapshot_id": F.lit(2)})
    both = rows.withColumn("snapshot_id", F.lit(1)).unionByName(again)
    # small payloads, as a collector lands a window in pages
    return both.groupBy(site, "snapshot_id", F.pmod(F.xxhash64(*rows.columns), F.lit(64)).alias("_page")).agg(F.collect_list(record).alias(name))


_AGAIN = "clicks + CASE WHEN impressions % 2 = 0 THEN 1 ELSE 0 END"
_DAYS = "(SELECT project_id, date, max(clicks) AS clicks, max(impressions) AS impressions, min(position) AS position FROM {daily_rows} d GROUP BY 1, 2)"
_PAIRS = "(SELECT project_id, query, page, max(clicks) AS clicks, max(impressions) AS impressions, min(position) AS position FROM {search_rows} s WHERE page IS NOT NULL GROUP BY 1, 2, 3)"


def days(spark, sf):
    return load(spark, sf, "daily_rows").groupBy("project_id", "date").agg(F.max("clicks").alias("clicks"), F.max("impressions").alias("impressions"), F.min("position").alias("position"))


def pairs(spark, sf):
    rows = load(spark, sf, "search_rows").filter("page IS NOT NULL")
    return rows.groupBy("project_id", "query", "page").agg(F.max("clicks").alias("clicks"), F.max("impressions").alias("impressions"), F.min("position").alias("position"))


def landed_twice(rows: DataFrame, keys: Column, name: str) -> DataFrame:
    record = F.struct(keys.alias("keys"), "clicks", "impressions", F.lit(0.5).alias("ctr"), "position")
    grouped = twice(rows, "project_id", record, name)
    return grouped.select("project_id", "snapshot_id", F.to_json(F.struct(F.lit("2001-06-30").alias("end_date"), name)).alias("raw_data"))


@query("gsc_daily_upsert", f"SELECT project_id, CAST(date AS STRING) AS date, {_AGAIN} AS clicks, impressions, 0.5e0 AS ctr, position FROM {_DAYS} d")
def gsc_daily_upsert(spark, sf):
    rows = landed_twice(days(spark, sf), F.array(F.col("date").cast("string")), "daily")
    return N.ingest("gsc_daily", rows).withColumn("date", F.col("date").cast("string"))


@query("gsc_queries_upsert", f"SELECT project_id, '2001-06-30' AS date, query, page, {_AGAIN} AS clicks, impressions, 0.5e0 AS ctr, position FROM {_PAIRS} p")
def gsc_queries_upsert(spark, sf):
    rows = landed_twice(pairs(spark, sf), F.array("query", "page"), "queries")
    return N.ingest("gsc_queries", rows).withColumn("date", F.col("date").cast("string"))


def exported_twice(rows: DataFrame, record: Column, name: str) -> DataFrame:
    from pyspark.sql.types import StructType

    grouped = twice(rows.withColumn("project_slug", F.col("project_id").cast("string")).drop("project_id"), "project_slug", record, name)
    raw = grouped.select("snapshot_id", F.to_json(F.struct("project_slug", F.lit("2001-06-30").alias("end_date"), name)).alias("raw"))
    return raw.select("snapshot_id", F.from_json("raw", StructType.fromDDL(I.EXPORT_SCHEMA)).alias("p")).select("snapshot_id", "p.*")


@query("export_daily_upsert", f"SELECT CAST(project_id AS STRING) AS project_slug, CAST(date AS STRING) AS date, {_AGAIN} AS clicks, impressions, coalesce(({_AGAIN})::DOUBLE / nullif(impressions, 0), 0) AS ctr, position FROM {_DAYS} d")
def export_daily_upsert(spark, sf):
    record = F.struct(F.col("date").cast("string").alias("date"), "clicks", "impressions", "position")
    return N.ingest("export_daily", exported_twice(days(spark, sf), record, "daily")).withColumn("date", F.col("date").cast("string"))


@query("export_queries_upsert", f"SELECT CAST(project_id AS STRING) AS project_slug, '2001-06-30' AS date, query, page, {_AGAIN} AS clicks, impressions, coalesce(({_AGAIN})::DOUBLE / nullif(impressions, 0), 0) AS ctr, position FROM {_PAIRS} p")
def export_queries_upsert(spark, sf):
    record = F.struct("query", "page", "clicks", "impressions", "position")
    return N.ingest("export_queries", exported_twice(pairs(spark, sf), record, "queries")).withColumn("date", F.col("date").cast("string"))


# Of the other sources each payload is landed a second time with a changed value; the later one counts.


@query("indexation_upsert", """SELECT project_id, query AS url, CASE WHEN impressions % 2 = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict
    FROM (SELECT project_id, query, max(impressions) AS impressions FROM {search_rows} s GROUP BY 1, 2) q""")
def indexation_upsert(spark, sf):
    rows = load(spark, sf, "search_rows").groupBy("project_id", "query").agg(F.max("impressions").alias("impressions")).withColumn("clicks", F.lit(0))
    verdict = F.when(F.col("clicks") > 0, "PASS").otherwise("FAIL")
    record = F.struct(F.col("query").alias("url"), F.struct(F.struct(verdict.alias("verdict")).alias("indexStatusResult")).alias("result"))
    landed = twice(rows, "project_id", record, "results").select("project_id", "snapshot_id", F.to_json(F.struct("results")).alias("raw_data"))
    return N.ingest("indexation", landed).select("project_id", "url", "verdict")


@query("trends_upsert", """SELECT project_id, query AS keyword, 'trends' AS source, CAST(CASE WHEN impressions % 2 = 0 THEN 1 ELSE 0 END AS INT) AS latest
    FROM (SELECT project_id, query, max(impressions) AS impressions FROM {search_rows} s GROUP BY 1, 2) q""")
def trends_upsert(spark, sf):
    rows = load(spark, sf, "search_rows").groupBy("project_id", "query").agg(F.max("impressions").alias("impressions")).withColumn("clicks", F.lit(0))
    again = rows.filter("impressions % 2 = 0").withColumns({"clicks": F.lit(1), "snapshot_id": F.lit(2)})
    points = F.array(F.struct(F.lit("2001-06-29").alias("date"), F.lit(7).alias("value")), F.struct(F.lit("2001-06-30").alias("date"), F.col("clicks").alias("value"))).alias("points")
    landed = rows.withColumn("snapshot_id", F.lit(1)).unionByName(again).select("project_id", "snapshot_id", F.to_json(F.struct(F.col("query").alias("keyword"), points)).alias("raw_data"))
    return N.ingest("trends", landed).select("project_id", "keyword", "source", "latest")


@query("related_queries_upsert", """SELECT project_id, query AS keyword, 'seed' AS seed_keyword, 'top' AS relation, CAST(CASE WHEN impressions % 2 = 0 THEN 1 ELSE 0 END AS INT) AS volume
    FROM (SELECT project_id, query, max(impressions) AS impressions FROM {search_rows} s GROUP BY 1, 2) q""")
def related_queries_upsert(spark, sf):
    rows = load(spark, sf, "search_rows").groupBy("project_id", "query").agg(F.max("impressions").alias("impressions")).withColumn("clicks", F.lit(0))
    landed = twice(rows, "project_id", F.struct("query", F.col("clicks").cast("string").alias("value")), "top")
    none = F.array().cast("array<struct<query:string,value:string>>").alias("rising")
    landed = landed.select("project_id", "snapshot_id", F.to_json(F.struct(F.lit("seed").alias("seed"), "top", none)).alias("raw_data"))
    return N.ingest("related_queries", landed).select("project_id", "keyword", "seed_keyword", "relation", "volume")


@query("backlinks_upsert", """SELECT project_id, query AS source_url, 'https://a.com/' AS target_url, CASE WHEN impressions % 2 = 0 THEN 'new' ELSE 'old' END AS anchor_text
    FROM (SELECT project_id, query, max(impressions) AS impressions FROM {search_rows} s WHERE query <> '' GROUP BY 1, 2) q""")
def backlinks_upsert(spark, sf):
    rows = load(spark, sf, "search_rows").filter("query <> ''").groupBy("project_id", "query").agg(F.max("impressions").alias("impressions")).withColumn("clicks", F.lit(0))
    anchor = F.when(F.col("clicks") > 0, "new").otherwise("old")
    landed = twice(rows, "project_id", F.struct(F.col("query").alias("Url"), anchor.alias("AnchorText")), "details")
    landed = landed.select("project_id", "snapshot_id", F.to_json(F.struct(F.lit("https://a.com/").alias("site_url"), F.lit("bing").alias("source"), "details")).alias("raw_data"))
    return N.ingest("backlinks", landed).select("project_id", "source_url", "target_url", "anchor_text")


SESSIONS = """(SELECT project_id, landing_page, CAST(CASE WHEN users = 1 THEN 0 ELSE sessions END AS INT) AS sessions, CAST(users AS INT) AS users, CAST(conversions AS DOUBLE) AS conversions,
    'keyEvents' AS conversion_metric, CASE WHEN users <> 1 THEN round_even(conversions::DOUBLE / sessions, 4) END AS conversion_rate FROM {session_rows} s)"""


def sessions(spark, sf):
    value = lambda c: F.struct(c.cast("string").alias("value"))
    shown = F.when(F.col("users") == 1, F.lit("n/a")).otherwise(F.col("sessions").cast("string"))
    rows = load(spark, sf, "session_rows")
    full = F.struct(F.array(value(F.col("landing_page"))).alias("dimensionValues"), F.array(value(shown), value(F.col("users")), value(F.col("conversions"))).alias("metricValues"))
    short = F.struct(F.array(value(F.lit("short"))).alias("dimensionValues"), F.array(value(F.lit("1"))).alias("metricValues"))
    return I.ga4_ingest(payload(rows, F.lit("keyEvents").alias("conversion_metric"), F.array(full, short).alias("rows")))


@query("ga4_ingest", f"SELECT * FROM {SESSIONS} s")
def ga4(spark, sf):
    return sessions(spark, sf)


@query("ga4_totals", f"SELECT project_id, sum(sessions) AS sessions, round_even(sum(conversions), 2) AS conversions FROM {SESSIONS} s GROUP BY 1")
def ga4_totals(spark, sf):
    return I.ga4_totals(sessions(spark, sf))


# --- speed and index ---------------------------------------------------------------------------------


@query("pagespeed_ingest", """SELECT project_id, CAST(date AS STRING) AS date, 'mobile' AS strategy, url, CAST(round_even(performance * 100, 0) AS INT) AS performance_score, NULL AS seo_score,
    lcp_ms, cls, tbt_ms, CASE WHEN tbt_ms > 400 THEN CAST(lcp_ms AS DOUBLE) END AS field_lcp_ms, CASE WHEN tbt_ms > 400 THEN round_even(tbt_ms / 100e0, 3) END AS field_cls, tbt_ms > 400 AS field_data_available
    FROM {vital_rows} v""")
def pagespeed(spark, sf):
    rows = load(spark, sf, "vital_rows")
    number = lambda c: F.struct(F.col(c).alias("numericValue"))
    lab = F.struct(
        F.struct(F.struct(F.col("performance").alias("score")).alias("performance")).alias("categories"),
        F.struct(number("lcp_ms").alias("largest-contentful-paint"), number("cls").alias("cumulative-layout-shift"), number("tbt_ms").alias("total-blocking-time")).alias("audits"),
    )
    field = F.struct(F.when(F.col("tbt_ms") > 400, F.struct(
        F.struct(F.col("lcp_ms").alias("percentile")).alias("LARGEST_CONTENTFUL_PAINT_MS"), F.struct(F.col("tbt_ms").alias("percentile")).alias("CUMULATIVE_LAYOUT_SHIFT_SCORE"),
    )).alias("metrics"))
    landed = payload(rows, F.col("date").cast("string").alias("date"), F.lit("mobile").alias("strategy"),
                     one("pages", F.col("url"), F.struct(lab.alias("lighthouseResult"), field.alias("loadingExperience")).alias("data")))
    found = I.pagespeed_ingest(landed).withColumn("date", F.col("date").cast("string"))
    return found.select("project_id", "date", "strategy", "url", "performance_score", "seo_score", "lcp_ms", "cls", "tbt_ms", "field_lcp_ms", "field_cls", "field_data_available")


_INSPECTED = "(SELECT project_id, url, coalesce(verdict, 'VERDICT_UNSPECIFIED') AS verdict, CASE WHEN verdict = 'PASS' THEN 'Submitted and indexed' END AS coverage_state FROM {inspections} i)"


def inspected(spark, sf):
    rows = load(spark, sf, "inspections")
    status = F.struct(F.col("verdict"), F.when(F.col("verdict") == "PASS", "Submitted and indexed").alias("coverageState"))
    return I.indexation_ingest(payload(rows, one("results", F.col("url"), F.struct(status.alias("indexStatusResult")).alias("result"))))


@query("indexation_ingest", f"SELECT project_id, url, verdict, coverage_state, NULL AS google_canonical FROM {_INSPECTED} i")
def indexation(spark, sf):
    return inspected(spark, sf).select("project_id", "url", "verdict", "coverage_state", "google_canonical")


@query("verdict_summary", f"SELECT project_id, verdict, count(*) AS urls FROM {_INSPECTED} i GROUP BY 1, 2")
def verdicts(spark, sf):
    return I.verdict_summary(inspected(spark, sf))


# --- listings ----------------------------------------------------------------------------------------

_RIVALS = "(SELECT DISTINCT project_id, replace(domain, 'www.', '') AS domain FROM {registered_rivals} g)"
_HITS = """(SELECT project_id, keyword, date, (page - 1) * 10 + position AS position, link AS url, replace(split_part(link, '/', 3), 'www.', '') AS domain FROM {result_rows} r WHERE link IS NOT NULL)"""


def result_pages(spark, sf):
    """One payload per result page: ten entries at most."""
    rows = load(spark, sf, "result_rows")
    keys = ["project_id", "keyword", "date", "page"]
    pages = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("position", "link", "title"))).alias("organic"))
    return payload(pages, F.col("keyword"), F.col("date").cast("string").alias("date"), F.col("page"), F.col("organic"))


def rivals(spark, sf):
    return load(spark, sf, "registered_rivals").select("project_id", domain_of(F.concat(F.lit("//"), "domain")).alias("domain"))


@query("serp_rank_ingest", f"""
    WITH own AS (SELECT project_id, keyword, date, min(position) AS our_position, arg_min(url, position) AS our_url FROM {_HITS} h
                 WHERE domain = 'site' || CAST(project_id AS STRING) || '.example' GROUP BY 1, 2, 3),
    rivals AS (SELECT project_id, keyword, date, string_agg(domain || '=' || position, ' ' ORDER BY domain) AS competitor_positions FROM (
                 SELECT h.project_id, keyword, date, h.domain, min(position) AS position FROM {_HITS} h JOIN {_RIVALS} g ON g.project_id = h.project_id AND g.domain = h.domain GROUP BY 1, 2, 3, 4) f GROUP BY 1, 2, 3)
    SELECT k.project_id, k.keyword, CAST(k.date AS STRING) AS date, our_position, our_url, coalesce(competitor_positions, '') AS competitor_positions
    FROM (SELECT DISTINCT project_id, keyword, date FROM {{result_rows}} r) k LEFT JOIN own o ON o.project_id = k.project_id AND o.keyword = k.keyword AND o.date = k.date
    LEFT JOIN rivals v ON v.project_id = k.project_id AND v.keyword = k.keyword AND v.date = k.date""")
def serp_rank(spark, sf):
    found = I.serp_rank_ingest(result_pages(spark, sf), sites(spark, sf), rivals(spark, sf))
    positions = F.array_sort(F.transform(F.map_entries("competitor_positions"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    return found.select("project_id", "keyword", F.col("date").cast("string").alias("date"), F.col("our_position").cast("long").alias("our_position"), "our_url",
                        F.array_join(positions, " ").alias("competitor_positions"))


@query("serp_top10_ingest", "SELECT project_id, keyword, CAST(date AS STRING) AS date, position, url, domain, title, is_ours FROM {listing_rows} l")
def serp_top10(spark, sf):
    return I.serp_top10_ingest(result_pages(spark, sf), sites(spark, sf)).drop("snippet").withColumn("date", F.col("date").cast("string"))


@query("local_pack_ingest", f"""
    SELECT k.project_id, k.keyword, CAST(k.date AS STRING) AS date, our_position, our_listing_title, CAST(our_position / 2e0 AS DOUBLE) AS our_rating
    FROM (SELECT DISTINCT project_id, keyword, date FROM {{result_rows}} r) k LEFT JOIN (
      SELECT project_id, keyword, date, min(position) AS our_position, arg_min('Place ' || position, position) AS our_listing_title FROM {_HITS} h
      WHERE domain = 'site' || CAST(project_id AS STRING) || '.example' GROUP BY 1, 2, 3) o ON o.project_id = k.project_id AND o.keyword = k.keyword AND o.date = k.date""")
def local_pack(spark, sf):
    rows = load(spark, sf, "result_rows").withColumn("absolute", (F.col("page") - 1) * 10 + F.col("position"))
    place = F.struct(F.col("position"), F.concat(F.lit("Place "), F.col("absolute").cast("string")).alias("title"), F.col("link").alias("website"), (F.col("absolute") / 2).alias("rating"))
    pages = rows.groupBy("project_id", "keyword", "date", "page").agg(F.array_sort(F.collect_list(place)).alias("places"))
    landed = payload(pages, F.col("keyword"), F.col("date").cast("string").alias("date"), F.col("page"), F.col("places"))
    return I.local_pack_ingest(landed, sites(spark, sf)).select(
        "project_id", "keyword", F.col("date").cast("string").alias("date"), F.col("our_position").cast("long").alias("our_position"), "our_listing_title", "our_rating"
    )


@query("sitemap_ingest", "SELECT DISTINCT project_id, url || '?a=1&b=2' AS url FROM {sitemap_urls} s")
def sitemap(spark, sf):
    rows = load(spark, sf, "sitemap_urls")
    xml = F.concat(F.lit("<?xml version='1.0'?><urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'><url>\n<loc> "), "url", F.lit("?a=1&amp;b=2 </loc></url></urlset>"))
    index = F.concat(F.lit("<sitemapindex><sitemap><loc>"), "url", F.lit("</loc></sitemap></sitemapindex>"))
    texts = rows.select("project_id", F.explode(F.array(xml, index, xml)).alias("xml"))
    return X.sitemap_ingest(texts)


# --- keyword ideas -----------------------------------------------------------------------------------


@query("trends_ingest", """
    WITH p AS (SELECT *, row_number() OVER (PARTITION BY project_id, keyword ORDER BY date DESC) AS rn FROM {trend_points} t)
    SELECT project_id, keyword, 'trends' AS source, CAST(trunc(round_even(avg(value) FILTER (WHERE rn <= 28), 1)) AS INT) AS volume, round_even(avg(value) FILTER (WHERE rn <= 28), 1) AS avg_recent,
           CAST(max(value) FILTER (WHERE rn = 1) AS INT) AS latest, CAST(count(*) AS INT) AS points FROM p GROUP BY 1, 2""")
def trends(spark, sf):
    # A keyword has one point per day, so its series is as long as the days of the table.
    rows = load(spark, sf, "trend_points")
    series = rows.groupBy("project_id", "keyword").agg(F.collect_list(F.struct(F.col("date").cast("string").alias("date"), F.col("value").cast("int").alias("value"))).alias("points"))
    return I.trends_ingest(payload(series, F.col("keyword"), F.col("points"))).withColumn("points", F.size("trend_data")).drop("trend_data")


@query("related_queries_ingest", """SELECT project_id, query AS keyword, 'trends_related' AS source, TRY_CAST(value AS INT) AS volume, seed AS seed_keyword, relation, value AS raw_value FROM {related_rows} r""")
def related(spark, sf):
    rows = load(spark, sf, "related_rows")
    item, none = F.array(F.struct("query", "value")), F.array().cast("array<struct<query:string,value:string>>")
    return I.related_queries_ingest(payload(rows, F.col("seed"), F.when(F.col("relation") == "top", item).otherwise(none).alias("top"),
                                            F.when(F.col("relation") == "rising", item).otherwise(none).alias("rising")))


@query("question_ideas", f"""
    WITH once AS (SELECT project_id, seed, min(position) AS position, arg_min(suggestion, position) AS suggestion FROM {{suggestion_rows}} s
                  WHERE lower(suggestion) <> lower(seed) GROUP BY 1, 2, lower(suggestion)),
    asked AS (SELECT * FROM (SELECT *, strip_accents(lower(suggestion)) AS s, list_filter(string_split(strip_accents(lower(seed)), ' '), lambda x: length(x) > 3) AS w FROM once) q
              WHERE len(list_filter({sql_list(C.QUESTION_MARKERS)}, lambda m: contains(s, m))) > 0 AND (len(w) = 0 OR len(list_filter(w, lambda x: contains(s, x))) > 0))
    SELECT * FROM (SELECT project_id, seed, suggestion, row_number() OVER (PARTITION BY project_id, seed ORDER BY position, suggestion) AS rank FROM asked) r""")
def ideas(spark, sf):
    return I.question_ideas(load(spark, sf, "suggestion_rows"))


# --- links and answers -------------------------------------------------------------------------------


@query("backlinks_ingest", "SELECT project_id, source_url, source_domain, target_url, coalesce(anchor_text, '') AS anchor_text, 'bing' AS source FROM {backlink_rows} b")
def backlinks(spark, sf):
    rows = load(spark, sf, "backlink_rows")
    empty = F.struct(F.lit("").alias("Url"), F.lit("x").alias("AnchorText"))
    details = F.array(F.struct(F.col("source_url").alias("Url"), F.col("anchor_text").alias("AnchorText")), empty).alias("details")
    return I.backlinks_ingest(payload(rows, F.col("target_url").alias("site_url"), F.lit("bing").alias("source"), details))


@query("ai_mentions", """SELECT project_id, provider, prompt, prompt_type, checked_at,
    CASE WHEN prompt_type = 'category' THEN contains(strip_accents(lower(response_text)), 'the') OR contains(strip_accents(lower(response_text)), 'éth') END AS mentions_business FROM {answer_rows} a""")
def mentions(spark, sf):
    found = I.ai_mentions(load(spark, sf, "answer_rows"), load(spark, sf, "answer_sites"))
    return found.select("project_id", "provider", "prompt", "prompt_type", "checked_at", "mentions_business")


@query("closed_intents", "SELECT project_id, keyword, intent FROM {keyword_rows} k WHERE intent IN ('comercial', 'local')")
def intents(spark, sf):
    return I.closed_intents(load(spark, sf, "keyword_rows")).select("project_id", "keyword", "intent")


@query("closed_clusters", """SELECT DISTINCT r.project_id, seed AS name, k.keyword FROM (SELECT project_id, seed, lower(query) AS keyword FROM {related_rows} q UNION ALL
      SELECT project_id, lower(seed), 'economy ' || lower(seed) FROM {related_rows} q) r JOIN (SELECT DISTINCT project_id, keyword FROM {keyword_rows} w) k ON k.project_id = r.project_id AND k.keyword = r.keyword""")
def clusters(spark, sf):
    rows = load(spark, sf, "related_rows")
    members = rows.select("project_id", F.col("seed").alias("name"), F.explode(F.array(F.lower("query"), F.concat(F.lit("economy "), F.lower("seed")))).alias("keyword")).distinct()
    return I.closed_clusters(members, load(spark, sf, "keyword_rows"))

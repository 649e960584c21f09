"""Landed collector payloads turned into typed rows.

A landing row is snapshot_id, project_id, collector, status, finished_at and raw_data, the payload as JSON
text. Everything here stays inside the row (parse, open arrays, select), so no payload is shuffled before
it is reduced to the few columns that matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlscope.functions.text import looks_like_question, strip_accents
from crawlscope.functions.urls import domain_of
from crawlscope.skew import first_k, lookup_join

SITE = ["project_id"]
# Places in the order of arrival within which questions are ranked together.
RANKED_TOGETHER = 4096
SNAPSHOT_SCHEMA = (
    "snapshot_id long, project_id long, collector string, status string, finished_at timestamp, "
    "error_message string, raw_data string"
)
CRAWL_PAGE = (
    "struct<url:string,status_code:int,title:string,meta_description:string,h1_tags:array<string>,"
    "schema_types:array<string>,schema_has_errors:boolean,og:struct<title:string,description:string,image:string>,"
    "canonical:string,is_indexable:boolean,lang_declared:string,word_count:int,internal_links:array<string>,"
    "nofollow_internal:array<string>,nofollow_external_count:int,fetched_at:timestamp,redirected_to:string,"
    "x_robots_tag:string,content_encoding:string,cache_control:string,body_text:string,has_author:boolean,"
    "has_date:boolean,has_contact:boolean,local_business_schema:struct<name:string,telephone:string>,"
    "schema_nodes:array<struct<types:array<string>,fields:array<string>>>>"
)


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    """Landed rows as JSON lines, in folders collector=/date= that a filter can prune."""
    return spark.read.schema(SNAPSHOT_SCHEMA).json(path)


def _parsed(landing: DataFrame, schema: str) -> DataFrame:
    return landing.select(*SITE, F.from_json("raw_data", schema).alias("p"))


def latest_snapshot(landing: DataFrame, collector: str) -> DataFrame:
    """The newest usable payload per site: only the largest id and its text survive each map task."""
    usable = landing.filter((F.col("collector") == collector) & F.col("status").isin("ok", "partial"))
    return usable.groupBy(*SITE).agg(
        F.max("snapshot_id").alias("snapshot_id"), F.max_by("raw_data", "snapshot_id").alias("raw_data")
    )


def crawl_pages(landing: DataFrame) -> DataFrame:
    """The crawl records of raw_data.pages."""
    return _parsed(landing, f"struct<pages:array<{CRAWL_PAGE}>>").select(*SITE, F.inline("p.pages"))


# --- search performance ------------------------------------------------------------------------------

_METRICS = "keys:array<string>,clicks:long,impressions:long,ctr:double,position:double"


def _measures() -> list[Column]:
    return [
        F.coalesce("r.clicks", F.lit(0)).alias("clicks"), F.coalesce("r.impressions", F.lit(0)).alias("impressions"),
        F.coalesce("r.ctr", F.lit(0.0)).alias("ctr"), F.coalesce("r.position", F.lit(0.0)).alias("position"),
    ]


def gsc_daily_ingest(landing: DataFrame) -> DataFrame:
    """Daily totals; what a row leaves out is 0 there, as the interface defines it."""
    rows = _parsed(landing, f"struct<daily:array<struct<{_METRICS}>>>").select(*SITE, F.explode("p.daily").alias("r"))
    return rows.select(*SITE, F.to_date(F.get("r.keys", F.lit(0))).alias("date"), *_measures())


def gsc_queries_ingest(landing: DataFrame) -> DataFrame:
    """Query and page rows, all stamped with the last day of their window."""
    rows = _parsed(landing, f"struct<end_date:string,queries:array<struct<{_METRICS}>>>").select(
        *SITE, F.to_date("p.end_date").alias("date"), F.explode("p.queries").alias("r")
    )
    return rows.select(
        *SITE, "date", F.get("r.keys", F.lit(0)).alias("query"), F.get("r.keys", F.lit(1)).alias("page"), *_measures()
    )


EXPORT_SCHEMA = (
    "project_slug string, start_date string, end_date string, "
    "daily array<struct<date:string,clicks:long,impressions:long,position:double>>, "
    "queries array<struct<query:string,page:string,clicks:long,impressions:long,position:double>>"
)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXPORT_SCHEMA).option("multiLine", True).json(path)


def _export_ctr() -> Column:
    return F.coalesce(F.try_divide("r.clicks", "r.impressions"), F.lit(0.0)).alias("ctr")


def export_daily(exports: DataFrame) -> DataFrame:
    rows = exports.select("project_slug", F.explode("daily").alias("r"))
    return rows.select("project_slug", F.to_date("r.date").alias("date"), "r.clicks", "r.impressions", _export_ctr(), "r.position")


def export_queries(exports: DataFrame) -> DataFrame:
    rows = exports.select("project_slug", F.to_date("end_date").alias("date"), F.explode("queries").alias("r"))
    return rows.select(
        "project_slug", "date", "r.query", "r.page", "r.clicks", "r.impressions", _export_ctr(), "r.position"
    )


def ga4_ingest(landing: DataFrame) -> DataFrame:
    """Landing-page sessions; rows without a dimension or with fewer than three metrics are dropped."""
    value = "struct<value:string>"
    rows = _parsed(
        landing,
        f"struct<conversion_metric:string,rows:array<struct<dimensionValues:array<{value}>,metricValues:array<{value}>>>>",
    ).select(*SITE, "p.conversion_metric", F.explode("p.rows").alias("r"))
    full = rows.filter((F.size("r.dimensionValues") > 0) & (F.size("r.metricValues") >= 3))

    def number(index: int) -> Column:
        return F.coalesce(F.get("r.metricValues", F.lit(index))["value"].try_cast("double"), F.lit(0.0))

    return full.select(
        *SITE, F.get("r.dimensionValues", F.lit(0))["value"].alias("landing_page"), number(0).cast("int").alias("sessions"),
        number(1).cast("int").alias("users"), number(2).alias("conversions"), "conversion_metric",
    ).withColumn("conversion_rate", F.bround(F.try_divide("conversions", "sessions"), 4))


def ga4_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*SITE).agg(F.sum("sessions").alias("sessions"), F.bround(F.sum("conversions"), 2).alias("conversions"))


# --- speed and index ---------------------------------------------------------------------------------

_AUDITS = {"lcp_ms": "largest-contentful-paint", "cls": "cumulative-layout-shift", "tbt_ms": "total-blocking-time",
           "fcp_ms": "first-contentful-paint", "si_ms": "speed-index"}
_CATEGORIES = {"performance_score": "performance", "accessibility_score": "accessibility",
               "best_practices_score": "best-practices", "seo_score": "seo"}
_FIELD = {"field_lcp_ms": "LARGEST_CONTENTFUL_PAINT_MS", "field_cls": "CUMULATIVE_LAYOUT_SHIFT_SCORE",
          "field_inp_ms": "INTERACTION_TO_NEXT_PAINT"}


def pagespeed_ingest(landing: DataFrame) -> DataFrame:
    """One row per measured page: lab scores and times, and field data only where there is any."""
    scores = ",".join(f"`{c}`:struct<score:double>" for c in _CATEGORIES.values())
    audits = ",".join(f"`{a}`:struct<numericValue:double>" for a in _AUDITS.values())
    rows = _parsed(
        landing,
        "struct<date:string,strategy:string,pages:array<struct<url:string,data:struct<"
        f"lighthouseResult:struct<categories:struct<{scores}>,audits:struct<{audits}>>,"
        "loadingExperience:struct<metrics:map<string,struct<percentile:double>>>>>>>",
    ).select(*SITE, F.to_date("p.date").alias("date"), "p.strategy", F.explode("p.pages").alias("r"))
    lab, metrics = "r.data.lighthouseResult", F.col("r.data.loadingExperience.metrics")
    out = [F.bround(F.col(f"{lab}.categories.`{c}`.score") * 100).cast("int").alias(n) for n, c in _CATEGORIES.items()]
    for name, audit in _AUDITS.items():
        value = F.col(f"{lab}.audits.`{audit}`.numericValue")
        out.append((F.bround(value, 3) if name == "cls" else F.bround(value).cast("long")).alias(name))
    for name, metric in _FIELD.items():
        value = F.try_element_at(metrics, F.lit(metric))["percentile"]
        out.append((F.bround(value / 100, 3) if name == "field_cls" else value).alias(name))
    available = F.coalesce(F.size(F.map_keys(metrics)) > 0, F.lit(False)).alias("field_data_available")
    return rows.select(*SITE, "date", "strategy", "r.url", *out, available)


_INDEX_FIELDS = {"coverage_state": "coverageState", "robots_txt_state": "robotsTxtState", "indexing_state": "indexingState",
                 "page_fetch_state": "pageFetchState", "google_canonical": "googleCanonical",
                 "user_canonical": "userCanonical", "crawled_as": "crawledAs", "last_google_crawl": "lastCrawlTime"}


def indexation_ingest(landing: DataFrame) -> DataFrame:
    """What the index says about each inspected url, word for word."""
    fields = ",".join(["verdict:string", *[f"{v}:string" for v in _INDEX_FIELDS.values()]])
    rows = _parsed(landing, f"struct<results:array<struct<url:string,result:struct<indexStatusResult:struct<{fields}>>>>>").select(
        *SITE, F.explode("p.results").alias("r")
    )
    status = "r.result.indexStatusResult"
    return rows.select(
        *SITE, "r.url", F.coalesce(F.col(f"{status}.verdict"), F.lit("VERDICT_UNSPECIFIED")).alias("verdict"),
        *[F.col(f"{status}.{v}").alias(k) for k, v in _INDEX_FIELDS.items()],
    )


def verdict_summary(inspections: DataFrame) -> DataFrame:
    return inspections.groupBy(*SITE, "verdict").agg(F.count(F.lit(1)).alias("urls"))


# --- listings ----------------------------------------------------------------------------------------

_ORGANIC = "array<struct<position:int,link:string,title:string,snippet:string>>"
_FEATURES = ["peopleAlsoAsk", "relatedSearches", "answerBox", "knowledgeGraph"]


def _listing_rows(landing: DataFrame) -> DataFrame:
    features = ",".join(f"{f}:string" for f in _FEATURES)
    return _parsed(landing, f"struct<keyword:string,date:string,page:int,organic:{_ORGANIC},{features}>").select(
        *SITE, "p.keyword", F.to_date("p.date").alias("date"), "p.page", "p.organic", *[f"p.{f}" for f in _FEATURES]
    )


def serp_rank_ingest(landing: DataFrame, sites: DataFrame, rivals: DataFrame | None = None) -> DataFrame:
    """Per keyword and day our first position and url over all result pages, and a map of competitors'.

    A payload is one result page; `sites` is project_id and url, `rivals` project_id and domain, as listings name it. Hits are
    rows that meet the site's targets by (site, domain), so no site's list of rivals travels with its pages; of a domain the first
    hit of a listing is left before the map, of at most a listing's domains, is built.
    """
    targets = sites.select(*SITE, domain_of(F.col("url"), keep_port=True).alias("domain"), F.lit(True).alias("_own"))
    if rivals is not None:
        targets = targets.unionByName(rivals.select(*SITE, "domain", F.lit(False).alias("_own")))
    targets = targets.groupBy(*SITE, "domain").agg(F.bool_or("_own").alias("_own"))
    keys = [*SITE, "keyword", "date"]
    pages = lookup_join(_listing_rows(landing), sites.select(*SITE).distinct(), SITE, how="left_semi")
    listed = pages.groupBy(*keys).agg(*[F.max(F.when(F.col("page") == 1, F.col(f))).alias(f) for f in _FEATURES])
    entries = pages.select(*keys, "page", F.posexplode("organic").alias("at", "e"))
    hits = lookup_join(
        entries.withColumn("domain", domain_of(F.coalesce("e.link", F.lit("")), keep_port=True)), targets, [*SITE, "domain"], how="inner")
    position = (F.col("page") - 1) * 10 + F.coalesce("e.position", F.lit(0))
    first = hits.groupBy(*keys, "domain", "_own").agg(
        F.min(F.struct("page", "at", position.alias("position"), F.col("e.link").alias("url"))).alias("h"))
    theirs = F.map_from_entries(F.array_sort(F.collect_list(F.when(~F.col("_own"), F.struct("domain", "h.position")))))
    found = first.groupBy(*keys).agg(
        F.max(F.when(F.col("_own"), F.col("h.position"))).alias("our_position"), F.max(F.when(F.col("_own"), F.col("h.url"))).alias("our_url"),
        theirs.alias("competitor_positions"))
    nobody = F.create_map().cast("map<string,int>")
    return listed.join(found, keys, "left").select(
        *keys, "our_position", "our_url", F.coalesce("competitor_positions", nobody).alias("competitor_positions"), *_FEATURES)


def serp_top10_ingest(landing: DataFrame, sites: DataFrame) -> DataFrame:
    """The linked organic rows of the first result page."""
    first = _listing_rows(landing).filter(F.col("page") == 1).select(*SITE, "keyword", "date", F.inline("organic"))
    own = sites.select(*SITE, domain_of(F.col("url"), keep_port=True).alias("_own"))
    linked = lookup_join(first.filter(F.coalesce("link", F.lit("")) != ""), own, SITE, how="inner")
    domain = domain_of(F.col("link"), keep_port=True)
    return linked.select(
        *SITE, "keyword", "date", F.coalesce("position", F.lit(0)).alias("position"), F.col("link").alias("url"),
        domain.alias("domain"), "title", "snippet", (domain == F.col("_own")).alias("is_ours"),
    )


def local_pack_ingest(landing: DataFrame, sites: DataFrame) -> DataFrame:
    """Per keyword and day the first listed place whose website is ours; NULLs where there is none."""
    places = "array<struct<position:int,title:string,website:string,rating:double,ratingCount:int>>"
    pages = _parsed(landing, f"struct<keyword:string,date:string,page:int,places:{places}>").select(
        *SITE, "p.keyword", F.to_date("p.date").alias("date"), "p.page", "p.places"
    )
    own = sites.select(*SITE, domain_of(F.col("url"), keep_port=True).alias("_own"))
    keys = [*SITE, "keyword", "date"]
    # A page's places stay one row: a minimum of texts sorts its rows, so only each page's first hit goes into it.
    placed = F.transform("places", lambda place, at: F.struct(at.alias("at"), place.alias("r")))
    first = F.get(F.filter(placed, lambda x: domain_of(F.coalesce(x["r"]["website"], F.lit("")), keep_port=True) == F.col("_own")), F.lit(0))
    rows = lookup_join(pages, own, SITE, how="inner").select(*keys, "page", first.alias("_first"))
    place = F.col("_first.r")
    hit = F.struct(
        F.col("page").alias("page"), F.col("_first.at").alias("at"),
        ((F.col("page") - 1) * 10 + F.coalesce(place["position"], F.lit(0))).alias("position"),
        place["title"].alias("title"), place["rating"].alias("rating"), place["ratingCount"].alias("reviews"),
    )
    return rows.groupBy(*keys).agg(F.min(F.when(F.col("_first").isNotNull(), hit)).alias("h")).select(
        *keys, F.col("h.position").alias("our_position"), F.col("h.title").alias("our_listing_title"),
        F.col("h.rating").alias("our_rating"), F.col("h.reviews").alias("our_reviews_count"),
    )


# --- keyword ideas -----------------------------------------------------------------------------------


def trends_ingest(landing: DataFrame, days: int = 28) -> DataFrame:
    """Per keyword the mean of its last points, the newest one and the series. A payload is one keyword."""
    point = "struct<date:string,value:int>"
    rows = _parsed(landing, f"struct<keyword:string,points:array<{point}>>").select(*SITE, "p.keyword", F.array_sort("p.points").alias("points"))
    recent = F.slice("points", F.greatest(F.lit(1), F.size("points") - (days - 1)), F.lit(days))
    total = F.aggregate(recent, F.lit(0).cast("long"), lambda a, x: a + x["value"])
    mean = F.bround(F.try_divide(total, F.size(recent)), 1)
    return rows.select(
        *SITE, "keyword", F.lit("trends").alias("source"), mean.cast("int").alias("volume"), mean.alias("avg_recent"),
        F.try_element_at("points", F.lit(-1))["value"].alias("latest"), F.col("points").alias("trend_data"),
    )


def related_queries_ingest(landing: DataFrame) -> DataFrame:
    """Related searches as keyword candidates; a value that is no whole number gives no volume but is kept."""
    pair = "array<struct<query:string,value:string>>"
    rows = _parsed(landing, f"struct<seed:string,top:{pair},rising:{pair}>").select(*SITE, "p.*")
    opened = rows.select(*SITE, "seed", F.lit("top").alias("relation"), F.inline("top")).unionByName(
        rows.select(*SITE, "seed", F.lit("rising").alias("relation"), F.inline("rising"))
    )
    return opened.select(
        *SITE, F.col("query").alias("keyword"), F.lit("trends_related").alias("source"),
        F.col("value").try_cast("int").alias("volume"), F.col("seed").alias("seed_keyword"), "relation",
        F.col("value").alias("raw_value"),
    )


def question_ideas(suggestions: DataFrame, per_seed: int | None = None) -> DataFrame:
    """Suggestions that are questions, each once per seed, ranked in order of arrival; `per_seed` keeps the first ones only.

    `suggestions` is project_id, seed, position, suggestion. The seed itself does not count.
    """
    keys = [*SITE, "seed"]
    fresh = suggestions.filter(F.lower("suggestion") != F.lower("seed"))
    once = fresh.groupBy(*keys, F.lower("suggestion").alias("_key")).agg(F.min(F.struct("position", "suggestion")).alias("_s"))
    asked = once.select(*keys, "_s.*").filter(looks_like_question(F.col("suggestion"), F.col("seed")))
    order = [F.col("position"), F.col("suggestion")]
    if per_seed is not None:
        return first_k(asked, keys, order, per_seed, "rank").drop("position")
    # a seed's questions are ranked by stretches of arrival, after the counts of the stretches before: no seed is sorted whole
    dealt = asked.withColumn("_part", F.floor(F.col("position") / RANKED_TOGETHER))
    parts = [*keys, "_part"]
    before = Window.partitionBy(*keys).orderBy(F.col("_part").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.groupBy(*parts).agg(F.count(F.lit(1)).alias("_n")).select(
        *[F.col(c).alias(f"{c}_") for c in parts], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*parts).orderBy(*order)
    numbered = dealt.withColumn("_rank", F.row_number().over(inner))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in parts])
    return numbered.join(first, same).select(*keys, "suggestion", (F.col("_before") + F.col("_rank")).cast("int").alias("rank"))


# --- links and answers -------------------------------------------------------------------------------


def backlinks_ingest(landing: DataFrame) -> DataFrame:
    """Inbound links with the domain they come from."""
    rows = _parsed(landing, "struct<site_url:string,source:string,details:array<struct<Url:string,AnchorText:string>>>").select(
        *SITE, "p.site_url", "p.source", F.inline("p.details")
    )
    return rows.filter(F.coalesce("Url", F.lit("")) != "").select(
        *SITE, F.col("Url").alias("source_url"), domain_of(F.col("Url")).alias("source_domain"),
        F.col("site_url").alias("target_url"), F.coalesce("AnchorText", F.lit("")).alias("anchor_text"), "source",
    )


def ai_mentions(responses: DataFrame, sites: DataFrame) -> DataFrame:
    """Does an answer to a category question name the business? NULL where the question already names it.

    `responses` is project_id, provider, prompt_type, prompt, response_text; `sites` is project_id, url, name.
    """
    label = F.substring_index(F.substring_index(F.substring_index("url", "//", -1), "/", 1), ".", 1)
    names = sites.select(*SITE, strip_accents(F.lower("name")).alias("_name"), F.lower(label).alias("_label"))
    joined = lookup_join(responses, names, SITE, how="inner")
    answer = strip_accents(F.lower("response_text"))
    named = F.contains(answer, F.col("_name")) | F.contains(answer, F.col("_label"))
    return joined.withColumn("mentions_business", F.when(F.col("prompt_type") == "category", named)).drop("_name", "_label")


def closed_intents(classified: DataFrame) -> DataFrame:
    """Classifications with an intent of the closed set."""
    from crawlscope.constants import INTENTS

    return classified.filter(F.col("intent").isin(INTENTS))


def closed_clusters(clusters: DataFrame, keywords: DataFrame) -> DataFrame:
    """Cluster members (project_id, name, keyword) that are real keywords; clusters left empty vanish."""
    return clusters.join(keywords.select(*SITE, "keyword").distinct(), [*SITE, "keyword"], "left_semi").select(
        *SITE, "name", "keyword"
    )



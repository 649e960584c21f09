"""Rules over pages and sites: markup features, traffic lights, trust, copies, headers, vitals, phones."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlscope import constants as C
from crawlscope.catalog.fixtures import crawl, load
from crawlscope.catalog.graph_queries import REDIRECTS, flat
from crawlscope.catalog.registry import query
from crawlscope.catalog.text_queries import sql_canonical, sql_directives, sql_flesch, sql_in, sql_list, sql_mismatch, sql_norm, sql_stuck
from crawlscope.functions.urls import authority
from crawlscope.operators import links as L
from crawlscope.operators import page_rules as P
from crawlscope.operators import pages as G
from crawlscope.operators import scores as S
from crawlscope.operators import security as H
from crawlscope.operators import speed as W
from crawlscope.operators.issues import ISSUE_COLUMNS, issue_constraints
from crawlscope.operators.local import local_score, nap_consistency, nap_phones, phone_spellings
from crawlscope.sources import html as M
from crawlscope.sources import robots as B

# --- raw HTML ----------------------------------------------------------------------------------------

_UNESCAPE = "replace(replace(replace(replace(replace({0}, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_VISIBLE = _UNESCAPE.format(r"regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '<[^>]*>', ' ', 'g')")
_TITLE = "trim(" + _UNESCAPE.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)") + ")"
_H1 = "trim(regexp_replace(" + _UNESCAPE.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)") + r", '\s+', ' ', 'g'))"
_HOST = "split_part(url, '/', 3)"
_SITE_URL = "split_part(url, '/', 1) || '//' || " + _HOST
HTML = rf"""(SELECT page_id, regexp_replace({_HOST}, '^www\.', '') AS project_id, url, {_TITLE} AS title, {_H1} AS h1,
    regexp_extract(html, '<html lang="([a-z]+)', 1) AS lang, {_VISIBLE} AS body,
    list_transform(regexp_extract_all(html, '(?s)<a href="(.*?)"', 1), lambda h: {_SITE_URL} || h) AS links FROM {{pages}})"""


def raw_pages(spark, sf):
    """The given pages, each host a site of its own."""
    pages = load(spark, sf, "pages")
    return pages.withColumn("project_id", F.regexp_replace(authority(F.col("url")), r"^www\.", ""))


def features(spark, sf):
    return M.extract_page_features(raw_pages(spark, sf))


_EDGE = r"[^\p{L}\p{N}_]"


@query("extract_page_features", rf"""
    SELECT page_id, project_id, title, h1 AS h1_tags, lang AS lang_declared, len(regexp_extract_all(body, '\S+')) AS word_count, TRUE AS is_indexable,
           NULL AS meta_description, NULL AS canonical, 0 AS schema_types FROM {HTML} h""")
def page_features(spark, sf):
    return features(spark, sf).select(
        "page_id", "project_id", "title", F.array_join("h1_tags", " | ").alias("h1_tags"), "lang_declared", "word_count",
        "is_indexable", "meta_description", "canonical", F.size("schema_types").alias("schema_types"),
    )


@query("extract_links", f"SELECT page_id, unnest(links) AS href FROM {HTML} h")
def links(spark, sf):
    return features(spark, sf).select("page_id", F.explode("internal_links").alias("href"))


# Pages written as markup from the stored crawl, so every feature is read back as the page states it.
_NEXT = "'/p/' || CAST(idx + 1 AS STRING)"


def marked_pages(spark, sf):
    """Crawled pages as raw HTML: only what the crawl knows is declared; every fourth page keeps a link from authority."""
    def said(text: str, column: str):
        return F.when(F.col(column).isNotNull(), F.format_string(text, F.col(column))).otherwise("")

    third, fourth, half = [F.pmod("idx", F.lit(n)) == 0 for n in (3, 4, 2)]
    html = F.concat(
        F.lit("<!doctype html><html lang='es-CO'><head>"), said("<title> %s\n</title>", "title"), said("<meta name='description' content='%s'>", "meta_description"),
        said("<meta property='og:title' content='%s'>", "og_title"), said("<meta property='og:description' content='%s'>", "og_description"),
        said("<meta property='og:image' content='%s'>", "og_image"), said("<link rel='canonical' href='%s'>", "canonical"),
        F.when(~F.col("is_indexable"), "<meta name='robots' content='NoIndex, follow'>").otherwise(""), F.lit("</head><body>"),
        F.when(F.col("h1") != "", F.concat(F.lit("<h1>"), F.replace(F.col("h1"), F.lit(" | "), F.lit("</h1><h1>")), F.lit("</h1>"))).otherwise(""),
        F.format_string("<a href='/p/%d#top'%s>next</a>", F.col("idx") + 1, F.when(fourth, " rel='nofollow'").otherwise("")),
        F.when(third, "<a rel='noopener NOFOLLOW' href='https://elsewhere.example/'>there</a>").otherwise("<a href='https://elsewhere.example/'>there</a>"),
        F.when(half, "<a rel='nofollow ugc' href='//other.example/x'>x</a>").otherwise("<a href='mailto:a@b.example'>x</a>"), F.lit("</body></html>"))
    return load(spark, sf, "crawl_flat").select("project_id", "idx", "url", html.alias("html"))


@query("extract_page_features_markup", f"""
    SELECT project_id, idx, trim(title) AS title, trim(meta_description) AS meta_description, canonical, og_title, og_description, nullif(og_image, '') AS og_image, is_indexable, 'es' AS lang_declared,
           CASE WHEN h1 = '' THEN 0 ELSE len(string_split(h1, ' | ')) END AS headings, regexp_extract(url, '^https?://[^/]+') || {_NEXT} AS links,
           CASE WHEN idx % 4 = 0 THEN regexp_extract(url, '^https?://[^/]+') || {_NEXT} ELSE '' END AS nofollow_internal,
           CASE WHEN idx % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN idx % 2 = 0 THEN 1 ELSE 0 END AS nofollow_external_count FROM {{crawl_flat}} c""")
def page_features_markup(spark, sf):
    return M.extract_page_features(marked_pages(spark, sf)).select(
        "project_id", "idx", "title", "meta_description", "canonical", F.col("og.title").alias("og_title"), F.col("og.description").alias("og_description"),
        F.col("og.image").alias("og_image"), "is_indexable", "lang_declared", F.size("h1_tags").alias("headings"), F.array_join("internal_links", " ").alias("links"),
        F.array_join("nofollow_internal", " ").alias("nofollow_internal"), "nofollow_external_count")


@query("eeat_signals_html", rf"""
    SELECT page_id, regexp_matches(flat, '(?i)(^|{_EDGE})(por|escrito por|autor|redactado por)\s*:?\s*[\p{{L}}\p{{N}}_]+') AS has_author,
           regexp_matches(flat, '(^|{_EDGE})\d{{4}}-\d{{2}}-\d{{2}}($|{_EDGE})') AS has_date,
           regexp_matches(flat, '{C.PHONE}') OR regexp_matches(flat, '(?i)(^|{_EDGE})(contáctanos|contacto|whatsapp|escríbenos)($|{_EDGE})') AS has_contact
    FROM (SELECT page_id, trim(regexp_replace(body, '\s+', ' ', 'g')) AS flat FROM {HTML} h) t""")
def eeat(spark, sf):
    return features(spark, sf).select("page_id", "has_author", "has_date", "has_contact")


_LONG = ["title", "meta_description", "h1", "schema", "og", "canonical", "indexable", "x_robots"]


@query("technical_audit_html", rf"""
    SELECT project_id, url, CASE WHEN title = '' THEN 'red' WHEN length(title) < 20 OR length(title) > 70 THEN 'red' WHEN length(title) < 30 OR length(title) > 60 THEN 'yellow' ELSE 'green' END AS title,
           'red' AS meta_description, CASE WHEN h1 = '' OR {sql_stuck('h1')} THEN 'red' ELSE 'green' END AS h1,
           'red' AS schema, 'red' AS og, 'red' AS canonical, 'green' AS indexable, 'green' AS x_robots FROM {HTML} h""")
def audit_html(spark, sf):
    return P.technical_audit(features(spark, sf)).select("project_id", "url", *_LONG)


# Part data written as structured data, parsed back as a page would be.
_ENTITY = """(SELECT p_partkey, p_size, p_name, p_brand, p_retailprice FROM {part})"""


@query("jsonld", f"""
    SELECT p_partkey, p_size % 10 = 9 AS has_errors,
           CASE WHEN p_size % 10 = 9 THEN 'Thing' WHEN p_size % 2 = 0 THEN 'LocalBusiness Store Product' ELSE 'Product Thing' END AS types,
           CASE WHEN p_size % 10 = 9 THEN 'name' WHEN p_size % 2 = 0 THEN 'address address.city name telephone; name offers offers.price' ELSE 'name offers offers.price; name' END AS fields,
           CASE WHEN p_size % 2 = 0 THEN p_name || ' / ' || p_brand END AS business
    FROM {_ENTITY} e""")
def jsonld(spark, sf):
    from crawlscope.functions import jsonld as J

    part = load(spark, sf, "part").repartition("p_partkey")  # few megabytes, but much to read once written as markup
    product = F.concat(F.lit('{"@type":"Product","name":"'), "p_name", F.lit('","offers":[{"@type":"Offer","price":'), F.col("p_size").cast("string"), F.lit("}]}"))
    business = F.concat(
        F.lit('{"@context":"x","@graph":[{"@type":["LocalBusiness","Store"],"name":"'), "p_name", F.lit('","telephone":"'), "p_brand",
        F.lit('","address":{"@type":"PostalAddress","city":"c"}},'), product, F.lit("]}"),
    )
    thing = F.lit('[{"@type":"Thing","name":"t"}, "loose text", 3]')
    odd = F.when(F.col("p_size") % 10 == 9, F.array(F.lit('{"@type": broken'), thing)).otherwise(F.array(product, thing))
    bodies = part.withColumn("html", F.concat(
        F.lit("<html><head>"),
        F.array_join(F.transform(F.when(F.col("p_size") % 2 == 0, F.array(business)).otherwise(odd),
                                 lambda b: F.concat(F.lit('<script type="application/ld+json">'), b, F.lit("</script>"))), ""),
        F.lit("</head><body>x</body></html>"),
    )).withColumn("url", F.lit("https://a.example/")).withColumn("project_id", F.lit(1))
    found = M.extract_page_features(bodies.select("project_id", "url", "p_partkey", "html"))
    fields = F.transform("schema_nodes", lambda n: F.array_join(n["fields"], " "))
    return found.select(
        "p_partkey", F.col("schema_has_errors").alias("has_errors"), F.array_join("schema_types", " ").alias("types"),
        F.array_join(fields, "; ").alias("fields"),
        F.concat("local_business_schema.name", F.lit(" / "), "local_business_schema.telephone").alias("business"),
    )


# --- traffic lights ----------------------------------------------------------------------------------

_TYPES = "string_split(schema_types, ',')"
_RELEVANT = f"list_filter({_TYPES}, lambda t: list_contains({sql_list(C.RELEVANT_SCHEMA_TYPES)}, t))"
_PARTS = "string_split(title, '|')"
_SUFFIX = f"(CASE WHEN len({_PARTS}) >= 3 AND trim({_PARTS}[-1]) = trim({_PARTS}[-2]) THEN trim({_PARTS}[-1]) END)"
_CALL = f"len(list_filter({sql_list(C.CALL_TO_ACTION_MARKS)}, lambda m: contains(meta_description, m))) > 0"
_H1S = "string_split(h1, ' | ')"
_LACK = "list_filter([CASE WHEN coalesce(og_title, '') = '' THEN 'title' END, CASE WHEN coalesce(og_description, '') = '' THEN 'description' END, CASE WHEN coalesce(og_image, '') = '' THEN 'image' END], lambda x: x IS NOT NULL)"
_DIRECTIVES = sql_directives("x_robots_tag")
_BLOCKS = f"len(list_intersect({_DIRECTIVES}, ['noindex', 'none'])) > 0"
_RULES = {
    "title": [("coalesce(title, '') = ''", "red", "'Title missing'"), (f"{_SUFFIX} IS NOT NULL", "red", f"'Brand suffix repeated: ' || {_SUFFIX}"),
              ("length(title) < 20 OR length(title) > 70", "red", "'Title has ' || length(title) || ' characters, outside 20-70'"),
              ("length(title) < 30 OR length(title) > 60", "yellow", "'Title has ' || length(title) || ' characters, at the edge'"),
              ("NOT contains(lower(title), lower(keyword))", "yellow", "'Title without the keyword'"), ("TRUE", "green", "'Title good'")],
    "meta_description": [("coalesce(meta_description, '') = ''", "red", "'Meta description missing'"),
                         ("length(meta_description) < 100", "red", "'Meta description has ' || length(meta_description) || ' characters, too short'"),
                         (f"length(meta_description) BETWEEN 120 AND 160 AND {_CALL}", "green", "'Meta description good'"),
                         ("length(meta_description) < 120 OR length(meta_description) BETWEEN 161 AND 180", "yellow", "'Meta description has ' || length(meta_description) || ' characters, at the edge'"),
                         (f"NOT ({_CALL})", "yellow", "'Meta description without a call to action'"), ("TRUE", "yellow", "'Meta description can be better'")],
    "h1": [("h1 = ''", "red", "'H1 missing'"), (sql_stuck("h1"), "red", "'H1 with words stuck together'"),
           (f"len({_H1S}) > 1", "yellow", f"len({_H1S}) || ' H1 found, one expected'"), ("TRUE", "green", "'One H1'")],
    "schema": [("schema_types = ''", "red", "'No structured data'"), ("schema_has_errors", "yellow", "'Structured data with errors'"),
               (f"len({_RELEVANT}) > 0", "green", f"'Relevant types: ' || array_to_string({_RELEVANT}, ', ')"),
               ("TRUE", "yellow", f"'Generic types: ' || array_to_string({_TYPES}, ', ')")],
    "og": [(f"len({_LACK}) = 0", "green", "'Open Graph complete'"), (f"len({_LACK}) < 3", "yellow", f"'Open Graph lacks ' || array_to_string({_LACK}, ', ')"),
           ("TRUE", "red", "'No Open Graph'")],
    "canonical": [("coalesce(canonical, '') = ''", "red", "'Canonical missing'"),
                  ("contains(url, '://www.') <> contains(canonical, '://www.')", "yellow", "'Canonical and url disagree about www'"), ("TRUE", "green", "'Canonical present'")],
    "indexable": [("is_indexable", "green", "'Indexable'"), ("noindex_justified", "yellow", "'Not indexable, on purpose'"), ("TRUE", "red", "'Not indexable without a reason'")],
    "x_robots": [(f"len({_DIRECTIVES}) = 0", "green", "'No X-Robots-Tag'"), (f"{_BLOCKS} AND is_indexable", "red", "'X-Robots-Tag blocks what the page allows: ' || x_robots_tag"),
                 (_BLOCKS, "yellow", "'X-Robots-Tag agrees with noindex: ' || x_robots_tag"), ("TRUE", "green", "'X-Robots-Tag does not block: ' || x_robots_tag")],
}


def _case(cell: str, part: int) -> str:
    value = (lambda r: f"'{r[1]}'") if part == 1 else (lambda r: r[2])
    return "CASE " + " ".join(f"WHEN {r[0]} THEN {value(r)}" for r in _RULES[cell]) + " END"


AUDIT = "(SELECT c.*, " + ", ".join(f"{_case(c, 1)} AS light_{c}, {_case(c, 2)} AS reason_{c}" for c in P.CELLS) + " FROM {crawl_flat} c)"


@query("technical_audit", "SELECT project_id, url, " + ", ".join(f"light_{c} AS {c}, reason_{c} AS {c}_reason" for c in P.CELLS) + f" FROM {AUDIT} a")
def audit(spark, sf):
    return P.technical_audit(crawl(spark, sf))


for _cell in P.CELLS:
    def _one(spark, sf, cell=_cell):
        found = P.technical_audit(crawl(spark, sf))
        return found.groupBy("project_id", F.col(cell).alias("light"), F.col(f"{cell}_reason").alias("reason")).agg(F.count(F.lit(1)).alias("pages"))

    query(f"evaluate_{_cell}", f"SELECT project_id, light_{_cell} AS light, reason_{_cell} AS reason, count(*) AS pages FROM {AUDIT} a GROUP BY 1, 2, 3")(_one)


@query("zombie_page", "SELECT url, h1 = '' AND schema_types = '' AND NOT is_indexable AS zombie FROM {crawl_flat} c")
def zombie(spark, sf):
    pages = crawl(spark, sf)
    return pages.select("url", P.zombie_page(pages).alias("zombie"))


_WEIGHTS = {"title": ("meta", "5min", 4), "meta_description": ("meta", "5min", 5), "h1": ("h1", "1h", 4), "schema": ("schema", "1h", 3), "og": ("og", "1h", 2),
            "canonical": ("canonical", "1h", 3), "indexable": ("index", "1h", 5), "x_robots": ("index", "5min", 5)}
_COMBINED = "concat_ws(' ', nullif(title, ''), nullif(meta_description, ''), nullif(replace(h1, ' | ', ' '), ''))"


def _cell_issue(cell: str) -> str:
    category, effort, impact = _WEIGHTS[cell]
    applies = f"light_{cell} = 'red'" if cell == "x_robots" else f"light_{cell} <> 'green'"
    return f"""SELECT project_id, url AS page_url, CASE WHEN light_{cell} = 'red' THEN 'critical' ELSE 'medium' END AS severity, '{category}' AS category,
        url || ': ' || reason_{cell} AS title, NULL AS current_text, NULL AS suggested_text, '{effort}' AS effort,
        CASE WHEN light_{cell} = 'red' THEN {impact} ELSE {max(1, impact - 3)} END AS impact FROM {AUDIT} a WHERE {applies}"""


TECHNICAL_ISSUES = " UNION ALL ".join(_cell_issue(c) for c in P.CELLS) + f"""
    UNION ALL SELECT project_id, url, 'critical', 'content', url || ': English content on a Spanish site', {_COMBINED}, NULL, '1d', 4
    FROM {{crawl_flat}} c WHERE {sql_mismatch(_COMBINED, 'lang_declared')}
    UNION ALL SELECT project_id, url, 'critical', 'zombie', url || ': zombie page (no H1, no structured data, noindex)', NULL, NULL, '1h', 3
    FROM {{crawl_flat}} c WHERE h1 = '' AND schema_types = '' AND NOT is_indexable"""


@query("technical_issues", TECHNICAL_ISSUES)
def technical_issues(spark, sf):
    return P.technical_issues(crawl(spark, sf))


@query("issue_constraints", f"""SELECT title, impact, severity, impact BETWEEN 1 AND 5 AND severity IN ('critical', 'high', 'medium') AS valid FROM (
    SELECT title, impact + CASE WHEN category = 'index' THEN 1 ELSE -1 END AS impact, CASE WHEN category = 'og' THEN 'low' ELSE severity END AS severity FROM ({TECHNICAL_ISSUES}) t) x""")
def constraints(spark, sf):
    found = P.technical_issues(crawl(spark, sf))
    shifted = found.withColumn("impact", F.col("impact") + F.when(F.col("category") == "index", 1).otherwise(-1)).withColumn(
        "severity", F.when(F.col("category") == "og", "low").otherwise(F.col("severity"))
    )
    return issue_constraints(shifted).select("title", "impact", "severity", "valid")


_SUM = lambda light: " + ".join(f"CAST(light_{c} = '{light}' AS INT)" for c in P.CELLS)


@query("semaphore_summary", f"SELECT project_id, sum({_SUM('green')}) AS green, sum({_SUM('yellow')}) AS yellow, sum({_SUM('red')}) AS red FROM {AUDIT} a GROUP BY 1")
def semaphores(spark, sf):
    return P.semaphore_summary(crawl(spark, sf))


@query("technical_score", f"SELECT project_id, CAST(round_even(100.0::DOUBLE * sum({_SUM('green')}) / (count(*) * 8), 0) AS INT) AS technical_score FROM {AUDIT} a GROUP BY 1")
def technical_score(spark, sf):
    return P.technical_score(crawl(spark, sf))


STORED_SCORE = f"""SELECT project_id, CAST(round_even(100.0::DOUBLE * sum({_SUM('green')} + CASE WHEN schema_has_errors AND len({_RELEVANT}) > 0 THEN 1 ELSE 0 END) / (count(*) * 8), 0) AS INT) AS technical_score
    FROM {AUDIT} a GROUP BY 1"""


@query("technical_score_stored", STORED_SCORE)
def technical_score_stored(spark, sf):
    return P.technical_score(P.from_stored(crawl(spark, sf)))


@query("content_score", "SELECT project_id, CAST(round_even(avg(eeat_score), 0) AS INT) AS content_score FROM {crawl_flat} c GROUP BY 1")
def content_score(spark, sf):
    return P.content_score(crawl(spark, sf))


# --- content and trust -------------------------------------------------------------------------------

_TEXT = rf"""(SELECT project_id, url, body_text, len(regexp_extract_all(body_text, '\S+')) AS word_count, lang = 'en' AS has_author, lang = 'es' AS has_date,
    regexp_matches(body_text, '{C.PHONE}') AS has_contact, {sql_flesch('body_text')} AS ease FROM {{text_pages}} t)"""
_EEAT = """CASE WHEN has_author THEN 20 ELSE 0 END + CASE WHEN has_date THEN 20 ELSE 0 END + CASE WHEN starts_with(url, 'https://') THEN 30 ELSE 0 END
    + CASE WHEN has_contact THEN 20 ELSE 0 END + CASE WHEN word_count >= 300 THEN 10 ELSE 0 END"""


def text_pages(spark, sf):
    from crawlscope.functions.text import count_words

    return load(spark, sf, "text_pages").select(
        "project_id", "url", "body_text", count_words(F.col("body_text")).alias("word_count"), (F.col("lang") == "en").alias("has_author"),
        (F.col("lang") == "es").alias("has_date"), F.col("body_text").rlike(C.PHONE).alias("has_contact"),
    )


@query("eeat_score", f"""SELECT project_id, url, word_count, ease AS readability_score, CASE WHEN ease >= 60 THEN 'green' WHEN ease >= 45 THEN 'yellow' ELSE 'red' END AS readability,
    {_EEAT} AS eeat_score, has_author, has_date, has_contact FROM {_TEXT} t""")
def eeat_score(spark, sf):
    return P.content_audit(text_pages(spark, sf))


def _content(condition, severity, category, title, suggested, effort, impact):
    return f"SELECT project_id, url AS page_url, '{severity}' AS severity, '{category}' AS category, url || ': ' || {title} AS title, NULL AS current_text, {suggested} AS suggested_text, '{effort}' AS effort, {impact} AS impact FROM {_TEXT} t WHERE {condition}"


@query("content_issues", " UNION ALL ".join([
    _content("ease < 45", "medium", "content", "'hard to read (' || ease || '/100)'", "'Shorter sentences and simpler words; aim at 60 or more'", "1h", 2),
    _content("word_count < 300", "high", "content", "'thin content (' || word_count || ' words, at least 300)'", "NULL", "1d", 3),
    _content("NOT has_author", "medium", "eeat", "'no visible author'", "'Name who wrote or checked the text'", "1h", 2),
    _content("NOT has_date", "medium", "eeat", "'no visible date'", "'Show when the text was published or updated'", "5min", 2),
    _content("NOT starts_with(url, 'https://')", "critical", "eeat", "'served without HTTPS'", "NULL", "1h", 5)]))
def content_issues(spark, sf):
    return P.content_issues(text_pages(spark, sf))


# --- copies and thin pages ---------------------------------------------------------------------------

OWN = f"""(SELECT c.* FROM {{crawl_flat}} c WHERE is_indexable AND (status_code IS NULL OR status_code = 200) AND NOT EXISTS (
    SELECT 1 FROM {REDIRECTS} r WHERE r.project_id = c.project_id AND r.source = {sql_canonical('c.url')}))"""
_VALUES = "(" + " UNION ALL ".join(f"SELECT project_id, '{f}' AS field, {sql_norm(f)} AS value, url FROM {OWN} o" for f in G.FIELDS) + ")"
DUPLICATES = f"""SELECT project_id, field, value, count(*) AS pages, array_to_string(list_slice(list_sort(list(url)), 1, 5), ', ') AS sample_urls
    FROM {_VALUES} v WHERE value IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) > 1"""


def edges(spark, sf):
    return L.redirect_edges(flat(spark, sf))


@query("duplicate_field", DUPLICATES)
def duplicates(spark, sf):
    return G.duplicate_field(crawl(spark, sf), edges(spark, sf))


@query("duplicate_members", f"""SELECT v.project_id, v.field, v.value, d.pages, v.url FROM {_VALUES} v JOIN ({DUPLICATES}) d
    ON d.project_id = v.project_id AND d.field = v.field AND d.value = v.value""")
def members(spark, sf):
    return G.duplicate_members(crawl(spark, sf), edges(spark, sf))


@query("duplicate_titles_html", f"""SELECT CASE WHEN starts_with(project_id, 'm.') THEN 'm' ELSE 'other' END AS project_id, field, value, count(*) AS pages FROM (
      SELECT project_id, 'title' AS field, {sql_norm('title')} AS value FROM {HTML} h UNION ALL SELECT project_id, 'h1', {sql_norm('h1')} FROM {HTML} h) t
    GROUP BY 1, 2, 3 HAVING count(*) > 1 AND value IS NOT NULL""")
def duplicate_titles_html(spark, sf):
    pages = features(spark, sf).withColumns({
        "project_id": F.when(F.startswith("project_id", F.lit("m.")), "m").otherwise("other"), "status_code": F.lit(200),
        "h1": F.array_join("h1_tags", " | "),
    })
    return G.duplicate_field(pages).select("project_id", "field", "value", "pages")


THIN = f"SELECT project_id, url, word_count FROM {OWN} o WHERE word_count < 200"


@query("thin_content", THIN)
def thin(spark, sf):
    return G.thin_content(crawl(spark, sf), edges(spark, sf))


# --- structured data fields --------------------------------------------------------------------------


def _missing_sql(names) -> str:
    def absent(n):
        other = C.SCHEMA_FIELD_EQUIVALENTS.get(n)
        return f"CASE WHEN NOT list_contains(f, '{n}')" + (f" AND NOT list_contains(f, '{other}')" if other else "") + f" THEN '{n}' END"

    return "list_filter([" + ", ".join(absent(n) for n in names) + "], lambda x: x IS NOT NULL)" if names else "CAST([] AS VARCHAR[])"


_KNOWN = f"list_filter(t, lambda x: list_contains({sql_list(C.SCHEMA_FIELD_RULES)}, x))[1]"
_CHECK = f"""(SELECT * FROM (SELECT project_id, url, type,
      CASE type {" ".join(f"WHEN '{n}' THEN {_missing_sql(r[0])}" for n, r in C.SCHEMA_FIELD_RULES.items())} END AS missing_required,
      CASE type {" ".join(f"WHEN '{n}' THEN {_missing_sql(r[1])}" for n, r in C.SCHEMA_FIELD_RULES.items())} END AS missing_recommended
    FROM (SELECT project_id, url, f, {_KNOWN} AS type FROM (SELECT project_id, url, string_split(schema_types, ',') AS t, string_split(schema_fields, ',') AS f FROM {{crawl_flat}} c
      WHERE status_code IS NULL OR status_code = 200) s) k WHERE type IS NOT NULL) m WHERE len(missing_required) > 0 OR len(missing_recommended) > 0)"""


@query("schema_node_check", f"SELECT project_id, url, type, array_to_string(missing_required, ' ') AS missing_required, array_to_string(missing_recommended, ' ') AS missing_recommended FROM {_CHECK} m")
def node_check(spark, sf):
    found = P.schema_findings(crawl(spark, sf))
    return found.withColumns({c: F.array_join(c, " ") for c in ("missing_required", "missing_recommended")})


def _group(level: str) -> str:
    return f"""SELECT project_id, type, '{level}' AS level, array_to_string(list_sort(list_distinct(flatten(list(missing_{level})))), ', ') AS missing_fields, count(*) AS pages_affected,
        array_to_string(list_slice(list_sort(list(url)), 1, 5), ', ') AS sample_urls FROM {_CHECK} m WHERE len(missing_{level}) > 0 GROUP BY 1, 2"""


SCHEMA_GROUPS = _group("required") + " UNION ALL " + _group("recommended")


@query("schema_groups", SCHEMA_GROUPS)
def groups(spark, sf):
    return P.schema_groups(crawl(spark, sf))


# --- headers -----------------------------------------------------------------------------------------


@query("cache_header_summary", """SELECT project_id, count(*) AS pages_checked, count(*) FILTER (WHERE content_encoding IS NULL) AS uncompressed,
    count(*) FILTER (WHERE cache_control IS NULL) AS no_cache_control FROM {crawl_flat} c WHERE status_code = 200 GROUP BY 1""")
def cache_summary(spark, sf):
    return G.cache_header_summary(crawl(spark, sf))


CACHE = """SELECT project_id, url, 'uncompressed' AS finding FROM {crawl_flat} c WHERE status_code = 200 AND content_encoding IS NULL
    UNION ALL SELECT project_id, url, 'no_cache_control' FROM {crawl_flat} c WHERE status_code = 200 AND cache_control IS NULL"""


@query("cache_header_findings", CACHE)
def cache_findings(spark, sf):
    return G.cache_header_findings(crawl(spark, sf))


HEADERS = """(SELECT project_id, hsts, age AS hsts_max_age, hsts IS NOT NULL AND coalesce(age, 0) < 15768000 AS hsts_weak, csp,
      concat_ws(', ', CASE WHEN contains(lower(csp), 'unsafe-inline') THEN 'unsafe-inline' END, CASE WHEN contains(lower(csp), 'unsafe-eval') THEN 'unsafe-eval' END) AS csp_unsafe,
      coalesce(contains(lower(csp), 'frame-ancestors'), FALSE) AS frame_ancestors, xfo AS x_frame_options, xcto AS x_content_type_options,
      nullif(referrer, '') AS referrer_policy, NULL AS permissions_policy
    FROM (SELECT *, TRY_CAST(regexp_extract(hsts, '(?i)max-age=(\\d+)', 1) AS BIGINT) AS age FROM {header_rows} h) h)"""


def header_sites(spark, sf):
    names = {"Strict-Transport-Security": "hsts", "content-security-policy": "csp", "X-Frame-Options": "xfo", "X-Content-Type-Options": "xcto", "Referrer-Policy": "referrer"}
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.col(v).alias("value")) for k, v in names.items()]), lambda p: p["value"].isNotNull())
    return load(spark, sf, "header_rows").select("project_id", F.map_from_entries(pairs).alias("headers"))


@query("security_headers", f"SELECT * FROM {HEADERS} h")
def security(spark, sf):
    return H.security_headers(header_sites(spark, sf))


def _header_issue(condition, severity, title, effort, impact, current="NULL"):
    return f"SELECT project_id, '{severity}' AS severity, 'security' AS category, {title} AS title, NULL AS page_url, {current} AS current_text, NULL AS suggested_text, '{effort}' AS effort, {impact} AS impact FROM {HEADERS} h WHERE {condition}"


@query("security_issues", " UNION ALL ".join([
    _header_issue("hsts IS NULL", "high", "'No Strict-Transport-Security header'", "5min", 3),
    _header_issue("hsts_weak", "medium", "'HSTS max-age is low (' || coalesce(CAST(hsts_max_age AS STRING), 'none') || ' of 15768000 seconds)'", "5min", 1, "hsts"),
    _header_issue("csp IS NULL", "medium", "'No Content-Security-Policy header'", "1h", 2),
    _header_issue("csp_unsafe <> ''", "medium", "'CSP allows ' || csp_unsafe", "1d", 1, "csp"),
    _header_issue("x_frame_options IS NULL AND NOT frame_ancestors", "medium", "'No X-Frame-Options and no frame-ancestors in CSP'", "5min", 2),
    _header_issue("x_content_type_options IS NULL", "medium", "'No X-Content-Type-Options header'", "5min", 1),
    _header_issue("referrer_policy IS NULL", "medium", "'No Referrer-Policy header'", "5min", 1)]))
def security_issues(spark, sf):
    return H.security_issues(H.security_headers(header_sites(spark, sf)))


# --- agents ------------------------------------------------------------------------------------------

MATRIX = """(SELECT project_id, agent, owner, recommended, allowed, CASE WHEN recommended AND allowed THEN 'keep allowed' WHEN recommended THEN 'allow' WHEN allowed THEN 'block' ELSE 'keep blocked' END AS recommendation
    FROM (SELECT project_id, llms_txt, llms_full_txt, a.agent, a.owner, a.agent <> 'CCBot' AS recommended,
            CASE WHEN a.agent = 'CCBot' THEN s_nationkey >= 12 WHEN a.agent IN ('GPTBot', 'ClaudeBot') THEN s_nationkey % 3 <> 0 ELSE TRUE END AS allowed
          FROM {robots_rows} r CROSS JOIN (VALUES ('GPTBot', 'OpenAI'), ('OAI-SearchBot', 'OpenAI'), ('ClaudeBot', 'Anthropic'), ('PerplexityBot', 'Perplexity'), ('CCBot', 'Common Crawl')) a(agent, owner)) m)"""
GEO = f"""(SELECT r.project_id, llms_txt, llms_full_txt, n AS agents_allowed, CASE WHEN llms_txt THEN 20 ELSE 0 END + CASE WHEN llms_full_txt THEN 10 ELSE 0 END + CAST(round_even(n * 17.5::DOUBLE, 0) AS INT) AS geo_score
    FROM {{robots_rows}} r JOIN (SELECT project_id, count(*) FILTER (WHERE recommended AND allowed) AS n FROM {MATRIX} m GROUP BY 1) a ON a.project_id = r.project_id)"""


def robots_sites(spark, sf):
    rows = load(spark, sf, "robots_rows")
    return rows.select("project_id", "llms_txt", "llms_full_txt").join(B.parse_robots(rows), "project_id")


@query("agent_matrix", f"SELECT * FROM {MATRIX} m")
def matrix(spark, sf):
    return S.agent_matrix(robots_sites(spark, sf))


@query("geo_score", f"SELECT * FROM {GEO} g")
def geo(spark, sf):
    return S.geo_score(robots_sites(spark, sf))


# --- vitals ------------------------------------------------------------------------------------------


def _rating(metric: str) -> str:
    warn, poor = C.VITALS_THRESHOLDS[metric]
    return f"""SELECT project_id, url, '{metric}' AS metric, CAST({metric} AS DOUBLE) AS value, CASE WHEN {metric} >= {poor} THEN 'poor' WHEN {metric} >= {warn} THEN 'needs improvement' ELSE 'good' END AS rating
        FROM {{vital_rows}} v WHERE {metric} IS NOT NULL"""


RATINGS = "(" + " UNION ALL ".join(_rating(m) for m in C.VITALS_THRESHOLDS) + ")"


@query("cwv_rating", f"SELECT * FROM {RATINGS} r")
def vitals(spark, sf):
    return W.cwv_rating(load(spark, sf, "vital_rows"))


VITAL_GROUPS = f"""(SELECT project_id, metric, rating, count(*) AS pages, array_to_string(list_slice(list_sort(list(url)), 1, 5), ', ') AS sample FROM {RATINGS} r WHERE rating <> 'good' GROUP BY 1, 2, 3)"""


@query("cwv_groups", f"SELECT * FROM {VITAL_GROUPS} g")
def vital_groups(spark, sf):
    return W.cwv_groups(load(spark, sf, "vital_rows"))


@query("cwv_issues", f"""SELECT project_id, CASE rating WHEN 'poor' THEN 'high' ELSE 'medium' END AS severity, 'performance_cwv' AS category,
    CASE metric WHEN 'lcp_ms' THEN 'LCP' WHEN 'cls' THEN 'CLS' ELSE 'TBT' END || ' ' || rating || ' on ' || pages || ' pages' AS title, NULL AS page_url, sample AS current_text, NULL AS suggested_text,
    '1d' AS effort, CASE rating WHEN 'poor' THEN 4 ELSE 2 END AS impact FROM {VITAL_GROUPS} g""")
def vital_issues(spark, sf):
    return W.cwv_issues(load(spark, sf, "vital_rows"))


# --- phones ------------------------------------------------------------------------------------------

_MENTIONS = f"""(SELECT DISTINCT project_id, url, raw, from_schema, right(regexp_replace(raw, '\\D', '', 'g'), 10) AS phone FROM (
    SELECT project_id, url, schema_phone AS raw, TRUE AS from_schema FROM {{crawl_flat}} c WHERE schema_phone IS NOT NULL
    UNION ALL SELECT project_id, url, unnest(regexp_extract_all(body_text, '{C.PHONE}')), FALSE FROM {{crawl_flat}} c
    UNION ALL SELECT length(source) % 5, 'd' || doc_id, unnest(regexp_extract_all(text, '{C.PHONE}')), FALSE FROM {{documents}}) r)"""
PHONES = f"""(SELECT project_id, phone, count(DISTINCT url) AS pages_count, bool_or(from_schema) AS from_schema,
    array_to_string(list_slice(list_sort(list_distinct(list(raw))), 1, 10), ', ') AS raw_examples FROM {_MENTIONS} m GROUP BY 1, 2)"""


def phone_pages(spark, sf):
    own = crawl(spark, sf).select("project_id", "url", "body_text", "local_business_schema")
    docs = load(spark, sf, "documents").select(
        (F.length("source") % 5).cast("long").alias("project_id"), F.concat(F.lit("d"), "doc_id").alias("url"), F.col("text").alias("body_text"),
        F.lit(None).cast("struct<name:string,telephone:string>").alias("local_business_schema"),
    )
    return own.unionByName(docs)


@query("nap_phones", f"SELECT * FROM {PHONES} p")
def nap(spark, sf):
    return nap_phones(phone_pages(spark, sf))


@query("phone_spellings", f"SELECT project_id, phone, raw, count(DISTINCT url) AS pages_count FROM {_MENTIONS} m GROUP BY 1, 2, 3")
def spellings(spark, sf):
    return phone_spellings(phone_pages(spark, sf))


@query("nap_consistency", f"SELECT project_id, count(*) AS phones, count(*) <= 1 AS is_consistent, arg_max(phone, (pages_count, phone)) AS primary_phone FROM {PHONES} p GROUP BY 1")
def nap_summary(spark, sf):
    pages = phone_pages(spark, sf)
    return nap_consistency(pages, nap_phones(pages))


LOCAL = f"""(SELECT c.project_id, coalesce(n, 0) AS phones, with_schema AS pages_with_schema, round_even(with_schema::DOUBLE / pages, 2) AS coverage_ratio,
    greatest(0, 100 - CASE WHEN coalesce(n, 0) > 1 THEN 40 WHEN coalesce(n, 0) = 0 THEN 30 ELSE 0 END - CASE WHEN with_schema = 0 THEN 30 ELSE 0 END) AS local_score
    FROM (SELECT project_id, count(*) AS pages, count(*) FILTER (WHERE s) AS with_schema FROM (
            SELECT project_id, schema_phone IS NOT NULL AS s FROM {{crawl_flat}} c UNION ALL SELECT length(source) % 5, FALSE FROM {{documents}}) u GROUP BY 1) c
    LEFT JOIN (SELECT project_id, count(*) AS n FROM {PHONES} p GROUP BY 1) p ON p.project_id = c.project_id)"""


@query("local_score", f"SELECT * FROM {LOCAL} l")
def local(spark, sf):
    return local_score(phone_pages(spark, sf))


# --- site averages -----------------------------------------------------------------------------------

INSIGHTS = """SELECT project_id, count(*) AS pages, round_even(avg(word_count) FILTER (WHERE word_count > 0), 1) AS avg_word_count,
    round_even(avg(length(title)) FILTER (WHERE title <> ''), 1) AS avg_title_length, round_even(avg(length(meta_description)) FILTER (WHERE meta_description <> ''), 1) AS avg_meta_length,
    CAST(round_even(100.0::DOUBLE * count(*) FILTER (WHERE has_author) / count(*), 0) AS INT) AS has_author_pct, CAST(round_even(100.0::DOUBLE * count(*) FILTER (WHERE has_date) / count(*), 0) AS INT) AS has_date_pct,
    CAST(round_even(100.0::DOUBLE * count(*) FILTER (WHERE has_contact) / count(*), 0) AS INT) AS has_contact_pct FROM {crawl_flat} c GROUP BY 1"""


@query("content_insights", INSIGHTS)
def insights(spark, sf):
    return G.content_insights(crawl(spark, sf))


@query("schema_coverage", "SELECT project_id, type, count(*) AS occurrences FROM (SELECT project_id, unnest(string_split(schema_types, ',')) AS type FROM {crawl_flat} c WHERE schema_types <> '') t GROUP BY 1, 2")
def schema_types(spark, sf):
    return G.schema_coverage(crawl(spark, sf))

"""URL and text functions, one query each."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlscope import constants as C
from crawlscope.catalog.fixtures import crawl, load
from crawlscope.catalog.registry import query
from crawlscope.functions import text as T
from crawlscope.functions import urls as U

# --- SQL counterparts --------------------------------------------------------------------------------

_URL = r"'^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)'"


def sql_part(url: str, group: int) -> str:
    return f"regexp_extract(trim({url}), {_URL}, {group})"


def sql_canonical(url: str) -> str:
    path = f"regexp_replace(regexp_replace({sql_part(url, 3)}, ';[^/]*$', ''), '/+$', '')"
    host = f"regexp_replace(lower({sql_part(url, 2)}), '^www\\.', '')"
    return (f"(CASE WHEN coalesce(trim({url}), '') = '' THEN '' ELSE {host} || "
            f"CASE WHEN {path} = '' THEN '/' ELSE {path} END END)")


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def sql_norm(text: str) -> str:
    return f"nullif(lower(trim(regexp_replace({text}, '\\s+', ' ', 'g'))), '')"


def sql_words(text: str) -> str:
    """Distinct significant words as a list."""
    return (f"list_distinct(list_transform(list_filter(regexp_extract_all(lower({text}), '{C.LETTER_RUN}'), lambda x: length(x) >= 4), "
            f"lambda x: translate(x, 'áéíóú', 'aeiou')))")


def sql_flesch(text: str) -> str:
    words = f"regexp_extract_all({text}, '{C.READING_WORD}')"
    syllables = f"coalesce(list_sum(list_transform({words}, lambda w: greatest(1, len(regexp_extract_all(w, '{C.READING_VOWELS}'))))), 0)"
    sentences = f"len(list_filter(regexp_split_to_array({text}, '{C.READING_SENTENCE_END}'), lambda s: regexp_matches(s, '\\S')))"
    return (f"round_even(206.84::DOUBLE - 60 * ({syllables}::DOUBLE / greatest(1, len({words}))) "
            f"- 1.02::DOUBLE * (greatest(1, len({words}))::DOUBLE / greatest(1, {sentences})), 1)")


def sql_mismatch(text: str, lang: str) -> str:
    words = f"list_distinct(regexp_extract_all(lower({text}), '{C.LETTER_RUN}'))"
    english = f"len(list_intersect({words}, {sql_list(C.ENGLISH_WORDS)}))"
    spanish = f"len(list_intersect({words}, {sql_list(C.SPANISH_WORDS)}))"
    return f"coalesce({lang} = 'es' AND {english} > {spanish} AND {english} >= 2, FALSE)"


def sql_directives(header: str) -> str:
    bots = sql_list(C.BOT_PREFIXES)
    prefix = "lower(trim(split_part(p, ':', 1)))"
    return (f"list_distinct(list_transform(list_filter(list_transform(string_split(coalesce({header}, ''), ','), lambda p: trim(p)), lambda p: p <> ''), "
            f"lambda p: CASE WHEN contains(p, ':') AND list_contains({bots}, {prefix}) THEN lower(trim(substr(p, strpos(p, ':') + 1))) ELSE {prefix} END))")


def sql_stuck(text: str) -> str:
    tokens = "|".join(sorted(C.BRAND_TOKENS, key=len, reverse=True))
    edge = r"[^\p{L}\p{N}_]"
    return f"regexp_matches(regexp_replace({text}, '(?i)(^|{edge})(?:{tokens})({edge}|$)', '\\1 \\2', 'g'), '{C.STUCK_WORDS}')"


def sql_bucket(position: str) -> str:
    return (f"CASE WHEN {position} IS NULL THEN NULL WHEN {position} <= 3 THEN '1-3' WHEN {position} <= 10 THEN '4-10' "
            f"WHEN {position} <= 20 THEN '11-20' ELSE '21+' END")


# --- queries -----------------------------------------------------------------------------------------

_HREFS = "SELECT project_id, src_idx, href FROM {link_rows} l"


@query("canonical_url", f"SELECT project_id, href, {sql_canonical('href')} AS canonical FROM ({_HREFS}) l")
def canonical(spark, sf):
    return load(spark, sf, "link_rows").select("project_id", "href", U.canonical_url(F.col("href")).alias("canonical"))


@query("canonical_url_html", f"SELECT page_id, {sql_canonical('url')} AS canonical FROM {{pages}}")
def canonical_html(spark, sf):
    return load(spark, sf, "pages").select("page_id", U.canonical_url(F.col("url")).alias("canonical"))


@query("normalize_url", """
    SELECT page_id, regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '/+$', '') ||
           CASE WHEN contains(split_part(url, '#', 1), '?') THEN '?' || split_part(split_part(url, '#', 1), '?', 2) ELSE '' END AS normalized
    FROM {pages}""")
def normalized(spark, sf):
    return load(spark, sf, "pages").select("page_id", U.normalize_url(F.col("url")).alias("normalized"))


@query("domain_of", """
    SELECT source_url, source_domain AS domain, regexp_replace(split_part(source_url, '/', 3), '^www\\.', '') AS domain_port
    FROM (SELECT lower(source_url) AS source_url, source_domain FROM {backlink_rows} b) b""")
def domains(spark, sf):
    url = F.col("source_url")
    return load(spark, sf, "backlink_rows").select(
        F.lower(url).alias("source_url"), U.domain_of(url).alias("domain"), U.domain_of(url, keep_port=True).alias("domain_port")
    )


@query("strip_accents", """
    SELECT doc_id, md5(strip_accents(lower(text))) AS bare, md5(translate(lower(text), 'áéíóú', 'aeiou')) AS vowels_bare FROM {documents}""")
def accents(spark, sf):
    low = F.lower("text")
    return load(spark, sf, "documents").select(
        "doc_id", F.md5(T.strip_accents(low)).alias("bare"), F.md5(T.strip_vowel_accents(low)).alias("vowels_bare")
    )


@query("significant_words", f"SELECT doc_id, len({sql_words('text')}) AS words, md5(array_to_string(list_sort({sql_words('text')}), ' ')) AS word_hash FROM {{documents}}")
def words(spark, sf):
    found = T.significant_words(F.col("text"))
    return load(spark, sf, "documents").select(
        "doc_id", F.size(found).cast("long").alias("words"), F.md5(F.array_join(F.array_sort(found), " ")).alias("word_hash")
    )


@query("norm_text", f"SELECT doc_id, md5({sql_norm('text')}) AS normalized FROM {{documents}}")
def norm(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.md5(T.norm_text(F.col("text"))).alias("normalized"))


@query("extract_phones", f"""
    SELECT doc_id, raw, right(regexp_replace(raw, '\\D', '', 'g'), 10) AS phone
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{C.PHONE}')) AS raw FROM {{documents}}) r""")
def phones(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.explode(T.extract_phones(F.col("text"))).alias("raw")).select(
        "doc_id", "raw", T.normalize_phone(F.col("raw")).alias("phone")
    )


@query("spam_tld", f"""
    SELECT source_domain, regexp_extract(source_domain, '[^.]*$') AS tld,
           regexp_extract(source_domain, '[^.]*$') IN {sql_in(C.SPAM_TLDS)} AS is_spam, count(*) AS links
    FROM {{backlink_rows}} b GROUP BY 1""")
def spam(spark, sf):
    domain = F.col("source_domain")
    return load(spark, sf, "backlink_rows").groupBy("source_domain").agg(F.count(F.lit(1)).alias("links")).select(
        "source_domain", U.top_level_domain(domain).alias("tld"), T.is_spam_domain(domain).alias("is_spam"), "links"
    )


@query("is_platform", f"""
    SELECT domain, len(list_filter({sql_list(C.PLATFORM_DOMAINS)}, lambda p: domain = p OR ends_with(domain, '.' || p))) > 0 AS is_platform, count(*) AS rows
    FROM {{listing_rows}} l GROUP BY domain""")
def platforms(spark, sf):
    return load(spark, sf, "listing_rows").groupBy("domain").agg(F.count(F.lit(1)).alias("rows")).select(
        "domain", T.is_platform(F.col("domain")).alias("is_platform"), "rows"
    )


@query("position_bucket", f"SELECT project_id, {sql_bucket('position')} AS bucket, count(*) AS rows, min(position) AS lowest, max(position) AS highest FROM {{search_rows}} s GROUP BY 1, 2")
def buckets(spark, sf):
    return load(spark, sf, "search_rows").groupBy("project_id", T.position_bucket(F.col("position")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("position").alias("lowest"), F.max("position").alias("highest")
    )


@query("csv_safe", """
    SELECT event_id, CASE WHEN substr(v, 1, 1) IN ('=', '+', '-', '@') THEN chr(39) || v ELSE v END AS safe
    FROM (SELECT event_id, substr('=+-@ax', CAST(event_id % 6 AS BIGINT) + 1) || props AS v FROM {events}) e""")
def safe(spark, sf):
    rows = load(spark, sf, "events").select("event_id", F.concat(F.substring(F.lit("=+-@ax"), (F.col("event_id") % 6 + 1).cast("int"), F.lit(6)), "props").alias("v"))
    return rows.select("event_id", T.csv_safe(F.col("v")).alias("safe"))


@query("x_robots_directives", f"SELECT url, array_to_string(list_sort({sql_directives('x_robots_tag')}), ' ') AS directives FROM {{crawl_flat}} c")
def directives(spark, sf):
    found = T.x_robots_directives(F.col("x_robots_tag"))
    return crawl(spark, sf).select("url", F.array_join(F.array_sort(found), " ").alias("directives"))


@query("flesch_huerta", f"""
    SELECT doc_id, score, CASE WHEN score >= 60 THEN 'green' WHEN score >= 45 THEN 'yellow' ELSE 'red' END AS readability
    FROM (SELECT doc_id, {sql_flesch('text')} AS score FROM {{documents}}) d""")
def reading(spark, sf):
    return load(spark, sf, "documents").select("doc_id", T.flesch_huerta(F.col("text")).alias("score")).withColumn(
        "readability", T.readability_class(F.col("score"))
    )


@query("looks_like_question", f"""
    SELECT project_id, seed, suggestion,
           len(list_filter({sql_list(C.QUESTION_MARKERS)}, lambda m: contains(s, m))) > 0
           AND (len(w) = 0 OR len(list_filter(w, lambda x: contains(s, x))) > 0) AS is_question
    FROM (SELECT *, strip_accents(lower(suggestion)) AS s,
                 list_filter(string_split(strip_accents(lower(seed)), ' '), lambda x: length(x) > 3) AS w FROM {{suggestion_rows}} q) q""")
def questions(spark, sf):
    return load(spark, sf, "suggestion_rows").select(
        "project_id", "seed", "suggestion", T.looks_like_question(F.col("suggestion"), F.col("seed")).alias("is_question")
    )


@query("language_mismatch", f"SELECT doc_id, {sql_mismatch('text', chr(39) + 'es' + chr(39))} AS mismatch FROM {{documents}}")
def mismatch(spark, sf):
    return load(spark, sf, "documents").select("doc_id", T.language_mismatch(F.col("text"), F.lit("es")).alias("mismatch"))


@query("stuck_words", f"SELECT url, h1, {sql_stuck('h1')} AS stuck FROM {{crawl_flat}} c")
def stuck(spark, sf):
    return crawl(spark, sf).select("url", "h1", T.stuck_words(F.col("h1")).alias("stuck"))


@query("duplicate_brand_suffix", """
    SELECT url, title, CASE WHEN len(p) >= 3 AND trim(p[-1]) = trim(p[-2]) AND length(trim(p[-1])) BETWEEN 2 AND 40 THEN trim(p[-1]) END AS suffix
    FROM (SELECT url, title, string_split(title, '|') AS p FROM {crawl_flat} c) c""")
def suffix(spark, sf):
    return crawl(spark, sf).select("url", "title", T.duplicate_brand_suffix(F.col("title")).alias("suffix"))

"""Competitors seen through their own pages, and questions people ask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlscope import constants as C
from crawlscope.functions.text import significant_words, strip, strip_accents
from crawlscope.functions.urls import authority
from crawlscope.operators.pages import content_insights, schema_coverage
from crawlscope.skew import lookup_join

SITE = ["project_id"]
RIVAL = ["project_id", "competitor"]


def competitor_topics(pages: DataFrame) -> DataFrame:
    """Titles and headings of competitor pages answered with 200: project_id, competitor, topic."""
    topics = F.concat(F.array("title"), F.col("h1_tags"))
    return pages.filter(F.col("status_code") == 200).select(*RIVAL, F.explode(topics).alias("topic")).filter(
        F.coalesce(strip(F.col("topic")), F.lit("")) != ""
    )


def keyword_gap(queries: DataFrame, topics: DataFrame, overlap: float = C.GAP_OVERLAP) -> DataFrame:
    """Competitor topics of which at most `overlap` of the words occur in any own query, of all dates."""
    own = queries.select(*SITE, "query").distinct().select(
        *SITE, F.explode(significant_words(F.col("query"))).alias("word")
    ).distinct().withColumn("known", F.lit(1))
    trimmed = strip(F.col("topic"))
    once = topics.filter(trimmed != "").groupBy(*RIVAL, F.lower(trimmed).alias("_key")).agg(F.min(trimmed).alias("topic"))
    words = once.select(*RIVAL, "topic", F.explode(significant_words(F.col("topic"))).alias("word"))
    hits = lookup_join(words, own, [*SITE, "word"])
    shared = hits.groupBy(*RIVAL, "topic").agg(
        F.sum(F.coalesce("known", F.lit(0))).alias("shared_words"), F.count(F.lit(1)).alias("topic_words")
    )
    ratio = F.col("shared_words") / F.col("topic_words")
    return shared.filter(ratio <= overlap).withColumn("overlap_ratio", F.bround(ratio, 2))


def competitive_matrix(sites: DataFrame, registered: DataFrame, own: DataFrame, scans: DataFrame) -> DataFrame:
    """The own row of every site and one per registered competitor, with NULLs where it was never scanned.

    `registered` is project_id and domain, a row per competitor; `own` and `scans` carry pages_crawled, technical_score and
    geo_score, the latter per domain with scanned_at.
    """
    numbers = ["pages_crawled", "technical_score", "geo_score"]
    ours = sites.join(own, SITE, "left").select(
        *SITE, F.coalesce(F.nullif(authority(F.col("url")), F.lit("")), "url").alias("domain"),
        F.lit(True).alias("is_own_site"), F.coalesce("pages_crawled", F.lit(0)).alias("pages_crawled"),
        *numbers[1:], F.lit(None).cast("timestamp").alias("scanned_at"), F.lit(None).cast("string").alias("note"),
    )
    newest = scans.groupBy(*SITE, "domain").agg(F.max_by(F.struct(*numbers, "scanned_at"), "scanned_at").alias("s"))
    theirs = registered.select(*SITE, "domain").join(newest, [*SITE, "domain"], "left").select(
        *SITE, "domain", F.lit(False).alias("is_own_site"), *[F.col(f"s.{n}").alias(n) for n in numbers],
        F.col("s.scanned_at").alias("scanned_at"), F.when(F.col("s").isNull(), "never scanned").alias("note"),
    )
    return ours.unionByName(theirs)


def competitor_comparison(own_pages: DataFrame, competitor_pages: DataFrame) -> DataFrame:
    """The averages of a site beside those of each of its competitors, own_ columns and plain ones."""
    theirs = content_insights(competitor_pages, RIVAL)
    ours = content_insights(own_pages)
    ours = ours.select(*SITE, *[F.col(c).alias(f"own_{c}") for c in ours.columns if c not in SITE])
    return theirs.join(ours, SITE, "left")


def schema_gap(own_pages: DataFrame, competitor_pages: DataFrame) -> DataFrame:
    """Structured-data types a competitor uses and the site does not."""
    theirs = schema_coverage(competitor_pages, RIVAL).select(*RIVAL, "type")
    return theirs.join(schema_coverage(own_pages).select(*SITE, "type"), [*SITE, "type"], "left_anti")


# Characters of the pieces by which a text is looked up in longer ones.
PIECE = 6


def _parts(length: int) -> Column:
    """The distinct substrings of `text` of one length."""
    starts = F.when(F.length("text") >= length, F.sequence(F.lit(1), F.length("text") - length + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda at: F.substring(F.col("text"), at, F.lit(length))))


def _containing(longs: DataFrame, shorts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of distinct texts (project_id, text): the longs that contain some short, and the shorts that lie in some long.

    A long text gives its pieces of PIECE characters, as many as its length. A short one of at least that length is looked
    up by its rarest piece and then compared whole; a shorter one meets the substrings of its own length. Both are semi
    joins, which end at a row's first match: a row comes out once or not at all, and no pair is ever made.
    """
    part = [*SITE, "part"]
    hashed = lambda df: df.withColumn("_h", F.xxhash64(*part))  # noqa: E731  lets run-time splitting cut a frequent piece
    pieces = longs.select(*SITE, F.col("text").alias("long"), F.explode(_parts(PIECE)).alias("part"))
    counts = pieces.groupBy(*part).agg(F.count(F.lit(1)).alias("n"))
    own = shorts.select(*SITE, F.col("text").alias("short"), F.explode(_parts(PIECE)).alias("part"))
    anchors = hashed(own).join(hashed(counts), [*part, "_h"]).groupBy(*SITE, "short").agg(F.min_by("part", F.struct("n", "part")).alias("part"))
    less = F.concat(F.array(F.lit("")), *[_parts(k) for k in range(1, PIECE)])
    little = longs.select(*SITE, F.col("text").alias("long"), F.explode(less).alias("part"))
    known = shorts.filter(F.length("text") < PIECE).select(*SITE, F.col("text").alias("short"), F.col("text").alias("part"))

    def met(these: DataFrame, those: DataFrame) -> DataFrame:
        """Rows of `these` that meet one of `those`."""
        a, b = hashed(these).alias("a"), hashed(those).alias("b")
        same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*part, "_h")]
        return a.join(b, [*same, F.contains("long", "short")], "left_semi")

    return tuple(
        met(these, those).unionByName(met(few, others)).select(*SITE, F.col(name).alias("text"))
        for name, these, those, few, others in (("long", pieces, anchors, little, known), ("short", anchors, pieces, known, little))
    )


def already_has_real_data(questions: DataFrame, queries: DataFrame) -> DataFrame:
    """Questions with a flag: does an own query of any date contain it, or lie within it, accents aside.

    Containment is looked up, not tried pair by pair, with rows in proportion to the texts' lengths, and only whether there is
    any is kept.
    """
    plain = lambda c: strip_accents(F.lower(c))
    asked = questions.select(*SITE, plain("question").alias("text")).distinct()
    known = queries.select(*SITE, plain("query").alias("text")).distinct()
    hit = _containing(asked, known)[0].unionByName(_containing(known, asked)[1]).distinct().withColumn("_hit", F.lit(True))
    keyed = questions.withColumn("text", plain("question"))
    return lookup_join(keyed, hit, [*SITE, "text"]).withColumn(
        "has_real_data", F.col("_hit").isNotNull()
    ).drop("text", "_hit")

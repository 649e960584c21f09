"""Rules over single pages: eight traffic lights, their findings, and content trust.

Input is the crawl record of `sources.html`, one row per page, with optional `noindex_justified` and
`keyword`. All of it is row-local: no rule shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlscope import constants as C
from crawlscope.functions import text as T
from crawlscope.operators.issues import explode_issues, issue, when_issue

CELLS = ["title", "meta_description", "h1", "schema", "og", "canonical", "indexable", "x_robots"]
GREEN, YELLOW, RED = "green", "yellow", "red"


def _ruled(*rules: tuple[Column | None, str, Column | str]) -> Column:
    """The first rule that applies decides; the last one has no condition."""
    chain = None
    for condition, light, reason in rules:
        text = F.lit(reason) if isinstance(reason, str) else reason
        value = F.struct(F.lit(light).alias("light"), text.alias("reason"))
        if condition is None:
            return value if chain is None else chain.otherwise(value)
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    raise ValueError("the last rule must be unconditional")


def _missing(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


def _sized(what: str, length: Column, tail: str) -> Column:
    return F.concat(F.lit(f"{what} has "), length.cast("string"), F.lit(f" characters, {tail}"))


def evaluate_title(title: Column, keyword: Column) -> Column:
    length, suffix = F.length(title), T.duplicate_brand_suffix(title)
    unseen = keyword.isNotNull() & ~F.contains(F.lower(title), F.lower(keyword))
    return _ruled(
        (_missing(title), RED, "Title missing"),
        (suffix.isNotNull(), RED, F.concat(F.lit("Brand suffix repeated: "), suffix)),
        ((length < 20) | (length > 70), RED, _sized("Title", length, "outside 20-70")),
        ((length < 30) | (length > 60), YELLOW, _sized("Title", length, "at the edge")),
        (unseen, YELLOW, "Title without the keyword"),
        (None, GREEN, "Title good"),
    )


def evaluate_meta(description: Column) -> Column:
    length = F.length(description)
    call = F.exists(T.literals(C.CALL_TO_ACTION_MARKS), lambda m: F.contains(description, m))
    return _ruled(
        (_missing(description), RED, "Meta description missing"),
        (length < 100, RED, _sized("Meta description", length, "too short")),
        (length.between(120, 160) & call, GREEN, "Meta description good"),
        ((length < 120) | length.between(161, 180), YELLOW, _sized("Meta description", length, "at the edge")),
        (~call, YELLOW, "Meta description without a call to action"),
        (None, YELLOW, "Meta description can be better"),
    )


def evaluate_h1(h1_tags: Column) -> Column:
    count = F.size(h1_tags)
    return _ruled(
        (F.coalesce(count, F.lit(0)) <= 0, RED, "H1 missing"),
        (F.exists(h1_tags, T.stuck_words), RED, "H1 with words stuck together"),
        (count > 1, YELLOW, F.concat(count.cast("string"), F.lit(" H1 found, one expected"))),
        (None, GREEN, "One H1"),
    )


def evaluate_schema(types: Column, errors: Column) -> Column:
    relevant = F.filter(types, lambda t: t.isin(C.RELEVANT_SCHEMA_TYPES))
    return _ruled(
        (F.coalesce(F.size(types), F.lit(0)) <= 0, RED, "No structured data"),
        (F.coalesce(errors, F.lit(False)), YELLOW, "Structured data with errors"),
        (F.size(relevant) > 0, GREEN, F.concat(F.lit("Relevant types: "), F.array_join(relevant, ", "))),
        (None, YELLOW, F.concat(F.lit("Generic types: "), F.array_join(types, ", "))),
    )


def evaluate_og(og: Column) -> Column:
    parts = {name: ~_missing(og[name]) for name in ("title", "description", "image")}
    absent = F.filter(F.array(*[F.when(~has, F.lit(name)) for name, has in parts.items()]), lambda x: x.isNotNull())
    found = 3 - F.size(absent)
    return _ruled(
        (found == 3, GREEN, "Open Graph complete"),
        (found > 0, YELLOW, F.concat(F.lit("Open Graph lacks "), F.array_join(absent, ", "))),
        (None, RED, "No Open Graph"),
    )


def evaluate_canonical(canonical: Column, url: Column) -> Column:
    return _ruled(
        (_missing(canonical), RED, "Canonical missing"),
        (F.contains(url, F.lit("://www.")) != F.contains(canonical, F.lit("://www.")), YELLOW,
         "Canonical and url disagree about www"),
        (None, GREEN, "Canonical present"),
    )


def evaluate_indexability(indexable: Column, justified: Column) -> Column:
    return _ruled(
        (F.coalesce(indexable, F.lit(True)), GREEN, "Indexable"),
        (F.coalesce(justified, F.lit(False)), YELLOW, "Not indexable, on purpose"),
        (None, RED, "Not indexable without a reason"),
    )


def evaluate_x_robots(header: Column, indexable: Column) -> Column:
    directives = T.x_robots_directives(header)
    blocking = F.arrays_overlap(directives, T.literals(C.BLOCKING_DIRECTIVES))
    return _ruled(
        (F.size(directives) == 0, GREEN, "No X-Robots-Tag"),
        (blocking & F.coalesce(indexable, F.lit(True)), RED,
         F.concat(F.lit("X-Robots-Tag blocks what the page allows: "), header)),
        (blocking, YELLOW, F.concat(F.lit("X-Robots-Tag agrees with noindex: "), header)),
        (None, GREEN, F.concat(F.lit("X-Robots-Tag does not block: "), header)),
    )


def _optional(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def from_stored(pages: DataFrame) -> DataFrame:
    """The crawl record as the current-state table keeps it: joined headings, parse errors forgotten."""
    return pages.withColumns(
        {
            "h1_tags": F.when(_missing(F.col("h1")), F.array().cast("array<string>")).otherwise(F.split("h1", r" \| ")),
            "schema_has_errors": F.lit(False),
        }
    )


def lights(pages: DataFrame) -> dict[str, Column]:
    return {
        "title": evaluate_title(F.col("title"), _optional(pages, "keyword", "string")),
        "meta_description": evaluate_meta(F.col("meta_description")),
        "h1": evaluate_h1(F.col("h1_tags")),
        "schema": evaluate_schema(F.col("schema_types"), F.col("schema_has_errors")),
        "og": evaluate_og(F.col("og")),
        "canonical": evaluate_canonical(F.col("canonical"), F.col("url")),
        "indexable": evaluate_indexability(F.col("is_indexable"), _optional(pages, "noindex_justified", "boolean")),
        "x_robots": evaluate_x_robots(_optional(pages, "x_robots_tag", "string"), F.col("is_indexable")),
    }


def _with_lights(pages: DataFrame) -> DataFrame:
    """Lights as _cell structs of their own projection, so no rule sees another cell's output name."""
    return pages.withColumns({f"_{name}": light for name, light in lights(pages).items()})


def technical_audit(pages: DataFrame, keep: tuple[str, ...] = ("project_id", "url")) -> DataFrame:
    """The kept columns and for every cell its light and its reason."""
    cells = [
        c for name in CELLS for c in (F.col(f"_{name}.light").alias(name), F.col(f"_{name}.reason").alias(f"{name}_reason"))
    ]
    return _with_lights(pages).select(*keep, *cells)


def zombie_page(pages: DataFrame) -> Column:
    return (
        (F.coalesce(F.size("h1_tags"), F.lit(0)) <= 0)
        & (F.coalesce(F.size("schema_types"), F.lit(0)) <= 0)
        & ~F.coalesce(F.col("is_indexable"), F.lit(True))
    )


# cell, category, effort, impact of a red light
_CELL_ISSUES = [
    ("title", "meta", "5min", 4), ("meta_description", "meta", "5min", 5), ("h1", "h1", "1h", 4),
    ("schema", "schema", "1h", 3), ("og", "og", "1h", 2), ("canonical", "canonical", "1h", 3),
    ("indexable", "index", "1h", 5), ("x_robots", "index", "5min", 5),
]


def technical_issues(pages: DataFrame) -> DataFrame:
    """Findings behind the lights that are not green, plus wrong language and zombie pages."""
    url = F.col("url")

    def titled(reason: Column) -> Column:
        return F.concat(url, F.lit(": "), reason)

    findings = []
    for cell, category, effort, impact in _CELL_ISSUES:
        light = F.col(f"_{cell}.light")
        red = light == RED
        applies = red if cell == "x_robots" else light != GREEN
        severity = F.when(red, "critical").otherwise("medium")
        weight = F.when(red, impact).otherwise(max(1, impact - 3))
        findings.append(
            when_issue(applies, issue(severity, category, titled(F.col(f"_{cell}.reason")), effort, weight, url))
        )
    words = F.concat_ws(" ", F.nullif("title", F.lit("")), F.nullif("meta_description", F.lit("")), "h1_tags")
    findings += [
        when_issue(
            T.language_mismatch(words, F.col("lang_declared")),
            issue("critical", "content", titled(F.lit("English content on a Spanish site")), "1d", 4, url,
                  current=words),
        ),
        when_issue(
            zombie_page(pages),
            issue("critical", "zombie", titled(F.lit("zombie page (no H1, no structured data, noindex)")), "1h", 3, url),
        ),
    ]
    return explode_issues(_with_lights(pages), findings, ["project_id"])


def eeat_score() -> Column:
    def points(flag: Column, worth: int) -> Column:
        return F.when(flag, worth).otherwise(0)

    return (
        points(F.col("has_author"), 20) + points(F.col("has_date"), 20)
        + points(F.startswith("url", F.lit("https://")), 30) + points(F.col("has_contact"), 20)
        + points(F.col("word_count") >= C.MIN_WORDS_CONTENT, 10)
    )


def content_audit(pages: DataFrame) -> DataFrame:
    """Reading ease, its class and the trust score of every page."""
    ease = T.flesch_huerta(F.col("body_text"))
    return pages.withColumn("readability_score", ease).select(
        "project_id", "url", "word_count", "readability_score",
        T.readability_class(F.col("readability_score")).alias("readability"),
        eeat_score().alias("eeat_score"), "has_author", "has_date", "has_contact",
    )


def content_issues(pages: DataFrame) -> DataFrame:
    url = F.col("url")

    def titled(*parts) -> Column:
        return F.concat(url, F.lit(": "), *[p if isinstance(p, Column) else F.lit(p) for p in parts])

    ease, words = F.col("readability_score"), F.col("word_count")
    findings = [
        when_issue(T.readability_class(ease) == RED,
                   issue("medium", "content", titled("hard to read (", ease.cast("string"), "/100)"), "1h", 2, url,
                         suggested="Shorter sentences and simpler words; aim at 60 or more")),
        when_issue(words < C.MIN_WORDS_CONTENT,
                   issue("high", "content",
                         titled("thin content (", words.cast("string"), f" words, at least {C.MIN_WORDS_CONTENT})"),
                         "1d", 3, url)),
        when_issue(~F.col("has_author"),
                   issue("medium", "eeat", titled("no visible author"), "1h", 2, url,
                         suggested="Name who wrote or checked the text")),
        when_issue(~F.col("has_date"),
                   issue("medium", "eeat", titled("no visible date"), "5min", 2, url,
                         suggested="Show when the text was published or updated")),
        when_issue(~F.startswith(url, F.lit("https://")),
                   issue("critical", "eeat", titled("served without HTTPS"), "1h", 5, url)),
    ]
    scored = pages.withColumn("readability_score", T.flesch_huerta(F.col("body_text")))
    return explode_issues(scored, findings, ["project_id"])


def _count_light(cells: Column, name: str) -> Column:
    return F.size(F.filter(cells, lambda c: c == name))


def light_counts(pages: DataFrame, keep: tuple[str, ...] = ("project_id", "url")) -> DataFrame:
    """The kept columns and the number of green, yellow and red lights of each page."""
    cells = F.array(*[F.col(c) for c in CELLS])
    return technical_audit(pages, keep).select(
        *keep, *[_count_light(cells, name).alias(name) for name in (GREEN, YELLOW, RED)]
    )


def semaphore_summary(pages: DataFrame) -> DataFrame:
    """Green, yellow and red cells per site."""
    return light_counts(pages).groupBy("project_id").agg(
        *[F.sum(c).cast("long").alias(c) for c in (GREEN, YELLOW, RED)]
    )


def technical_score(pages: DataFrame, keys: tuple[str, ...] = ("project_id",)) -> DataFrame:
    """Share of green cells in percent, pooled over the pages of each key.

    Every page has the same number of cells, so this is also the mean of the page shares.
    """
    cells = F.count(F.lit(1)) * len(CELLS)
    return light_counts(pages, keys).groupBy(*keys).agg(
        F.bround(100 * F.sum(GREEN) / cells).cast("int").alias("technical_score")
    )


def content_score(pages: DataFrame) -> DataFrame:
    """Mean trust score per site over the pages that have one; NULL when none has."""
    return pages.groupBy("project_id").agg(F.bround(F.avg("eeat_score")).cast("int").alias("content_score"))


# --- structured data fields --------------------------------------------------------------------------


def _lacking(names: list[str], fields: Column) -> Column:
    def present(name: str) -> Column:
        found = F.array_contains(fields, name)
        other = C.SCHEMA_FIELD_EQUIVALENTS.get(name)
        return found | F.array_contains(fields, other) if other else found

    if not names:
        return F.array().cast("array<string>")
    return F.filter(F.array(*[F.when(~present(n), F.lit(n)) for n in names]), lambda x: x.isNotNull())


def schema_node_check(types: Column, fields: Column) -> Column:
    """struct<type, missing_required, missing_recommended> of the first known type; NULL when all is there."""
    known = F.get(F.filter(types, lambda t: t.isin(list(C.SCHEMA_FIELD_RULES))), F.lit(0))
    required = recommended = None
    for name, (must, should) in C.SCHEMA_FIELD_RULES.items():
        is_type = known == name
        required = F.when(is_type, _lacking(must, fields)) if required is None else required.when(is_type, _lacking(must, fields))
        recommended = (
            F.when(is_type, _lacking(should, fields)) if recommended is None
            else recommended.when(is_type, _lacking(should, fields))
        )
    checked = F.struct(
        known.alias("type"), required.alias("missing_required"), recommended.alias("missing_recommended")
    )
    return F.when(known.isNotNull() & ((F.size(required) > 0) | (F.size(recommended) > 0)), checked)


def schema_findings(pages: DataFrame) -> DataFrame:
    """One row per incomplete node of pages that answered 200 (or were not measured)."""
    nodes = pages.filter(F.col("status_code").isNull() | (F.col("status_code") == 200)).select(
        "project_id", "url", F.explode("schema_nodes").alias("node")
    )
    return nodes.select(
        "project_id", "url", schema_node_check(F.col("node.types"), F.col("node.fields")).alias("found")
    ).filter("found IS NOT NULL").select("project_id", "url", "found.*")


def schema_groups(pages: DataFrame) -> DataFrame:
    """Per site, type and level: the union of missing fields, nodes affected and five sample urls."""
    from crawlscope.skew import counted_sample

    levels = schema_findings(pages).select(
        "project_id", "url", "type",
        F.explode(
            F.array(
                F.struct(F.lit("required").alias("level"), F.col("missing_required").alias("missing")),
                F.struct(F.lit("recommended").alias("level"), F.col("missing_recommended").alias("missing")),
            )
        ).alias("l"),
    ).select("project_id", "url", "type", "l.*").filter(F.size("missing") > 0)
    keys = ["project_id", "type", "level"]
    # The rule table bounds the field names of a type, so this set stays a handful of words.
    fields = levels.select(*keys, F.explode("missing").alias("field")).groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_set("field")), ", ").alias("missing_fields")
    )
    return (
        counted_sample(levels, keys, F.col("url"), [F.col("url")], 5)
        .join(fields, keys)
        .select(*keys, "missing_fields", F.col("n").alias("pages_affected"), F.col("sample").alias("sample_urls"))
    )

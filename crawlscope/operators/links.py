"""Redirects and internal links as graphs.

`pages` is the crawl record: project_id, url, status_code, is_indexable, redirected_to, internal_links,
nofollow_internal, nofollow_external_count. `homes` is project_id, url.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from crawlscope import constants as C
from crawlscope.functions.urls import canonical_url, canonical_urls
from crawlscope.session import cut_lineage, written
from crawlscope.skew import HOT_KEYS, lookup_join

SITE = ["project_id"]
# After so many levels of clicks their tables are written as one.
_LEVELS_PER_COPY = 8
# Fewer kept rows than these are not worth dropping settled ones.
_FEW_ROWS = 1_000_000


# --- redirects ---------------------------------------------------------------------------------------


def redirect_edges(pages: DataFrame, order: str | None = None) -> DataFrame:
    """source -> target on canonical urls, one edge per source: the one whose page comes last by `order`."""
    pair = canonical_urls(F.array("url", "redirected_to"))
    edges = pages.filter(F.coalesce("redirected_to", F.lit("")) != "").select(
        *SITE, pair[0].alias("source"), pair[1].alias("target"), (F.col(order) if order else F.col("url")).alias("_order"),
    )
    real = edges.filter((F.col("source") != "") & (F.col("target") != "") & (F.col("source") != F.col("target")))
    return real.groupBy(*SITE, "source").agg(F.max_by("target", F.struct("_order", "target")).alias("target"))


def redirect_map_merge(persisted: DataFrame, fresh: DataFrame) -> DataFrame:
    """Both maps together; where both know a source, the fresh target wins."""
    keys = [*SITE, "source"]
    old = persisted.select(*keys, F.col("target").alias("_old"))
    new = fresh.select(*keys, F.col("target").alias("_new"))
    return old.join(new, keys, "full").select(*keys, F.coalesce("_new", "_old").alias("target"))


def _jump(pointers: DataFrame) -> DataFrame:
    """Double the reach of every open pointer; a pointer at a node without an edge is closed."""
    there = pointers.select(*SITE, F.col("source").alias("target"), F.col("target").alias("_next"), F.col("open").alias("_more"))
    moved = lookup_join(pointers.filter("open"), there, [*SITE, "target"])
    walked = moved.select(
        *SITE, "source", F.coalesce("_next", "target").alias("target"), F.coalesce("_more", F.lit(False)).alias("open")
    )
    return pointers.filter("NOT open").unionByName(walked)


def _settle(pointers: DataFrame) -> tuple[DataFrame, int]:
    """Jump until nothing is open or every open pointer must be on a cycle. Returns how many stay open.

    On a chain that ends, only pointers further from the end than the reach are open, so its length is at
    most reach + open. Once open <= reach, one more doubling closes every such chain.
    """
    reach, open_before = 1, None
    while True:
        pointers = cut_lineage(_jump(pointers))
        still_open = pointers.filter("open").groupBy(*SITE).count().agg(F.max("count")).first()[0] or 0
        if still_open == 0 or (open_before is not None and open_before <= reach):
            return pointers, still_open
        open_before = still_open
        reach *= 2


def redirect_closure(edges: DataFrame) -> DataFrame:
    """project_id, source and the `final` url its chain ends at.

    Pointer doubling: a chain of n hops takes log2(n) rounds. A page on a cycle is its own end, and a chain
    running into a cycle ends where it enters.
    """
    start = edges.select(*SITE, "source", "target", F.lit(True).alias("open"))
    pointers, rest = _settle(start)
    if rest == 0:
        return pointers.select(*SITE, "source", F.col("target").alias("final"))
    # After that many hops an open pointer can only point at a page of its cycle, and every such page is hit.
    on_cycle = pointers.filter("open").select(*SITE, F.col("target").alias("source")).distinct()
    looping = pointers.filter("open").select(*SITE, "source")
    tails = edges.join(looping, [*SITE, "source"], "left_semi").join(on_cycle, [*SITE, "source"], "left_anti")
    stops = on_cycle.select(*SITE, "source", F.col("source").alias("target"), F.lit(False).alias("open"))
    entered, _ = _settle(
        cut_lineage(stops.unionByName(tails.select(*SITE, "source", "target", F.lit(True).alias("open"))))
    )
    return pointers.filter("NOT open").unionByName(entered).select(*SITE, "source", F.col("target").alias("final"))


def resolve(rows: DataFrame, url: str, closure: DataFrame, name: str = "final_url") -> DataFrame:
    """Add the canonical end of the redirect chain of a url column."""
    finals = closure.select(*SITE, F.col("source").alias("_source"), F.col("final").alias("_final"))
    joined = lookup_join(rows.withColumn("_source", canonical_url(F.col(url))), finals, [*SITE, "_source"])
    return joined.withColumn(name, F.coalesce("_final", "_source")).drop("_source", "_final")


def redirect_alias_filter(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """Pages that are not themselves the source of a redirect."""
    keyed = pages.withColumn("_source", canonical_url(F.col("url")))
    aliases = edges.select(*SITE, F.col("source").alias("_source"))
    return keyed.join(aliases.hint("merge"), [*SITE, "_source"], "left_anti").drop("_source")  # as many as pages, so not broadcast


# --- internal links ----------------------------------------------------------------------------------


def link_records(pages: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """What the link graph needs of a page: its canonical url as `node` and those it links to, each once and not itself; and `keep`."""
    node = canonical_url(F.col("url"))
    # A page's own repetitions and self links go before its links become rows.
    targets = F.array_except(canonical_urls(F.col("internal_links")), F.array(F.lit(""), node))
    return pages.select(*SITE, "url", "status_code", "is_indexable", node.alias("node"), targets.alias("targets"), *[F.col(c) for c in keep])


def _records(pages: DataFrame) -> DataFrame:
    return pages if "targets" in pages.columns else written(link_records(pages))


def _nodes(pages: DataFrame) -> DataFrame:
    return (pages if "node" in pages.columns else pages.select(*SITE, canonical_url(F.col("url")).alias("node"))).select(*SITE, "node").distinct()


def out_links(pages: DataFrame) -> DataFrame:
    """project_id, node and `targets`, where each link of a node stands once. `pages` may be `link_records`.

    A node of one page keeps that page's list, so its links are neither rows nor shuffled. A node of several pages, one
    url in many spellings, may have a list without bound: its links are made distinct as rows, each a list of one.
    """
    keys, records = [*SITE, "node"], _records(pages).select(*SITE, "node", "targets")
    several = written(records.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*keys))
    side = several.hint("broadcast" if several.count() <= HOT_KEYS else "merge")
    shared = records.join(side, keys, "left_semi").select(*keys, F.explode_outer("targets").alias("target")).distinct()
    lists = shared.select(*keys, F.array_compact(F.array("target")).alias("targets"))
    return records.join(side, keys, "left_anti").unionByName(lists)


def link_edges(pages: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Distinct links source -> target between crawled pages, without self links. `pages` may be `link_records`, `links` their `out_links`.

    Targets are where a navigation bar piles up (every page links home); their lookup is a semi join whose
    heavy partitions split while it runs.
    """
    records = _records(pages)
    links = out_links(records) if links is None else links
    edges = links.select(*SITE, F.col("node").alias("source"), F.explode("targets").alias("target"))
    return lookup_join(edges, _nodes(records).withColumnRenamed("node", "target"), [*SITE, "target"], how="left_semi")


def inbound_counts(pages: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Links into every crawled page, 0 for pages nobody links to. Counted where the lists lie, before they meet the crawled pages."""
    records = _records(pages)
    links = out_links(records) if links is None else links
    counted = links.select(*SITE, F.explode("targets").alias("node")).groupBy(*SITE, "node").agg(F.count(F.lit(1)).alias("inbound"))
    return _nodes(records).join(counted, [*SITE, "node"], "left").withColumn("inbound", F.coalesce("inbound", F.lit(0)))


def _home_nodes(homes: DataFrame) -> DataFrame:
    return homes.select(*SITE, canonical_url(F.col("url")).alias("node")).distinct()


def orphans(pages: DataFrame, homes: DataFrame, links: DataFrame | None = None, inbound: DataFrame | None = None) -> DataFrame:
    """Indexable pages answered with 200 that no crawled page links to; the home page needs no links."""
    records = _records(pages)
    candidates = records.filter((F.col("status_code") == 200) & F.coalesce("is_indexable", F.lit(True))).select(*SITE, "url", "node")
    lonely = (inbound_counts(records, links) if inbound is None else inbound).filter("inbound = 0").select(*SITE, "node")
    return candidates.join(lonely, [*SITE, "node"], "left_semi").join(
        _home_nodes(homes), [*SITE, "node"], "left_anti"
    ).select(*SITE, "url")


def click_depth(links: DataFrame, homes: DataFrame) -> DataFrame:
    """project_id, node and the fewest clicks from home, level by level; unreachable pages have no row. `links` are `out_links`.

    The lists are dealt once by (site, node), sorted and kept so; a level's pages come to them, never the other way round. A page
    is in the frontier once, so its list is taken apart once, and a level's targets are made distinct before they are looked up.
    Rows are dropped when half of those kept have had their turn. What is kept in the executors can be computed again from the
    written records. No level is broadcast: a small file may hold millions of pages.
    """
    keys = [*SITE, "node"]
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def kept(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, *keys).sortWithinPartitions(*keys).persist()

    out = kept(links.select(*keys, "targets"))
    left, gone = out.count(), 0
    frontier = written(_home_nodes(homes).withColumn("click_depth", F.lit(0)))
    reached, level = frontier, 0
    while True:
        level += 1
        # the number of rows followed tells when settled ones are worth dropping
        followed = out.join(frontier.select(*keys).hint("merge"), keys)
        counted = Observation()
        step = followed.observe(counted, F.count(F.lit(1)).alias("n")).select(*SITE, F.explode("targets").alias("node")).distinct()
        fresh = step.join(reached.select(*keys).hint("merge"), keys, "left_anti").join(out.select(*keys).hint("merge"), keys, "left_semi")
        frontier = written(fresh.withColumn("click_depth", F.lit(level)))
        if frontier.isEmpty():
            out.unpersist()
            return reached
        reached = reached.unionByName(frontier)
        if level % _LEVELS_PER_COPY == 0:
            reached = written(reached)
        gone += counted.get["n"]
        if 2 * gone > left > _FEW_ROWS:
            done = reached.select(*keys).join(frontier.select(*keys).hint("merge"), keys, "left_anti")
            rest = kept(out.join(done.hint("merge"), keys, "left_anti"))
            left, gone = rest.count(), 0
            out.unpersist()
            out = rest


def link_table(pages: DataFrame, homes: DataFrame, links: DataFrame | None = None, inbound: DataFrame | None = None) -> DataFrame:
    """Per page answered with 200: links in, clicks from home, and whether it is weak or deep. `pages` may be written `link_records`."""
    records = _records(pages)
    links = out_links(records) if links is None else links
    inbound, depth = inbound_counts(records, links) if inbound is None else inbound, click_depth(links, homes)
    home = _home_nodes(homes).withColumn("_home", F.lit(True))
    keys = [*SITE, "node"]
    rows = records.filter(F.col("status_code") == 200).select(*SITE, "url", "node")
    joined = rows.join(inbound, keys, "left").join(depth, keys, "left").join(home, keys, "left")
    return joined.select(
        *SITE, "url", "inbound", "click_depth",
        (F.col("_home").isNull() & (F.col("inbound") <= C.WEAK_INBOUND)).alias("weak"),
        F.coalesce(F.col("click_depth") >= C.DEEP_CLICKS, F.lit(False)).alias("deep"),
    )


def weak_pages(table: DataFrame) -> DataFrame:
    return table.filter("weak").select(*SITE, "url", "inbound", "click_depth")


def deep_pages(table: DataFrame) -> DataFrame:
    return table.filter("deep").select(*SITE, "url", "inbound", "click_depth")


def nofollow_pages(pages: DataFrame) -> DataFrame:
    """Pages that keep authority from their own site, with the number of such links and two of them."""
    return pages.filter(F.size("nofollow_internal") > 0).select(
        *SITE, "url", F.size("nofollow_internal").alias("targets"),
        F.array_join(F.slice("nofollow_internal", 1, 2), ", ").alias("sample"),
    )


def nofollow_summary(pages: DataFrame) -> DataFrame:
    """Per site: pages and links with internal nofollow, and the (harmless) external ones."""
    inside = F.greatest(F.lit(0), F.coalesce(F.size("nofollow_internal"), F.lit(0)))
    return pages.groupBy(*SITE).agg(
        F.count_if(inside > 0).alias("nofollow_pages"), F.sum(inside).alias("nofollow_links"),
        F.sum(F.coalesce("nofollow_external_count", F.lit(0))).alias("nofollow_external"),
    )

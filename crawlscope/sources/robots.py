"""robots.txt as data: parsed once per site into rules, by which agents and urls are judged."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Executors need no installed copy of this package: the helper travels with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GROUPS = "array<struct<agents:array<string>,rules:array<struct<allow:boolean,path:string>>>>"


def _groups(text: str | None) -> list[dict]:
    parser = RobotFileParser()
    parser.parse((text or "").splitlines())
    entries = [*parser.entries, *([parser.default_entry] if parser.default_entry else [])]
    return [
        {
            "agents": [agent.lower() for agent in entry.useragents],
            "rules": [{"allow": bool(r.allowance), "path": r.path} for r in entry.rulelines],
        }
        for entry in entries
    ]


def parse_robots(robots: DataFrame) -> DataFrame:
    """project_id and `robots`, the agent groups of its robots_txt in order, the general group last."""
    kind = robots.schema["project_id"].dataType.simpleString()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"project_id": batch["project_id"], "robots": [_groups(t) for t in batch["robots_txt"]]})

    return robots.select("project_id", "robots_txt").mapInPandas(parse, f"project_id {kind}, robots {GROUPS}")


def robots_rules(robots: DataFrame) -> DataFrame:
    """One row per site, group, agent and path rule."""
    groups = parse_robots(robots).select("project_id", F.posexplode("robots").alias("group_no", "g"))
    agents = groups.select("project_id", "group_no", F.explode("g.agents").alias("agent"), F.col("g.rules").alias("rules"))
    return agents.select("project_id", "group_no", "agent", F.posexplode("rules").alias("rule_no", "r")).select(
        "project_id", "group_no", "agent", "rule_no", "r.allow", "r.path"
    )


def url_path(url: Column) -> Column:
    """Everything after the host, percent-encoded the way the parsed rules are."""
    rest = F.regexp_replace(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?", "")
    plain = F.coalesce(F.try_url_decode(F.replace(rest, F.lit("+"), F.lit("%2B"))), rest)
    quoted = F.url_encode(plain)
    for written, wanted in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        quoted = F.replace(quoted, F.lit(written), F.lit(wanted))
    return F.when(quoted == "", F.lit("/")).otherwise(quoted)


def allowed(groups: Column, agent: Column, path: Column) -> Column:
    """May `agent` read `path`: the first group naming the agent, and in it the first rule that fits."""
    name = F.lower(F.substring_index(agent, "/", 1))
    group = F.get(
        F.filter(groups, lambda g: F.exists(g["agents"], lambda a: (a == "*") | F.contains(name, a))), F.lit(0)
    )
    rule = F.get(F.filter(group["rules"], lambda r: (r["path"] == "*") | F.startswith(path, r["path"])), F.lit(0))
    return F.coalesce(rule["allow"], F.lit(True))


def blocked_urls(urls: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """The distinct urls that their own site forbids to `agent`.

    Rules are rows. A url looks its path's beginnings up among its site's rules, at the lengths that rules have at all; the first
    rule that fits decides. Rules that fit every path are a number and a flag per site, however many rules it has.
    """
    from crawlscope.session import written
    from crawlscope.skew import lookup_join

    name = agent.split("/")[0].lower()
    named = robots_rules(robots).filter((F.col("agent") == "*") | F.contains(F.lit(name), F.col("agent")))
    # the first group that names the agent; sites with rules for others only have none here
    groups = parse_robots(robots).select("project_id", F.posexplode("robots").alias("group_no", "g")).filter(
        F.exists("g.agents", lambda a: (a == "*") | F.contains(F.lit(name), a)))
    first = groups.groupBy("project_id").agg(F.min("group_no").alias("group_no"))
    rules = named.join(first, ["project_id", "group_no"], "left_semi").select("project_id", "rule_no", "allow", "path").distinct()
    always = F.col("path").isin("", "*")
    everywhere = rules.filter(always).groupBy("project_id").agg(F.min(F.struct("rule_no", "allow")).alias("_any"))
    by_path = rules.filter(~always).groupBy("project_id", "path").agg(F.min(F.struct("rule_no", "allow")).alias("_rule"))
    lengths = sorted(r[0] for r in by_path.select(F.length("path")).distinct().collect())  # bounded by the length of a path
    ruled = lookup_join(urls.distinct().withColumn("_path", url_path(F.col("url"))), everywhere, ["project_id"])
    if lengths:
        ruled = written(ruled)  # a url's path is encoded once, and its beginnings come back to it
        fit = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("_path"))
        cut = ruled.select("project_id", "url", "_path", F.explode(fit).alias("_n"))
        begun = cut.select("project_id", "url", F.substring(F.col("_path"), F.lit(1), F.col("_n")).alias("path"))
        met = lookup_join(begun, by_path, ["project_id", "path"], how="inner").groupBy("project_id", "url").agg(F.min("_rule").alias("_met"))
        ruled = lookup_join(ruled, met, ["project_id", "url"])
    else:
        ruled = ruled.withColumn("_met", F.lit(None).cast("struct<rule_no:int,allow:boolean>"))
    return ruled.filter(~F.coalesce(F.least("_met", "_any")["allow"], F.lit(True))).select(*urls.columns)

"""Skewed keys, the ledger applied twice, sources and sinks on disk."""

from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import functions as F

from crawlscope import constants as C
from crawlscope.operators import competitors as R
from crawlscope.operators import ledger as E
from crawlscope.operators import search as Q
from crawlscope.operators.backlinks import toxic_backlinks
from crawlscope.plans import page_audit
from crawlscope.sinks import files
from crawlscope.skew import first_k, latest_rows, lookup_join
from crawlscope.sources import landing as I
from crawlscope.sources.robots import blocked_urls
from crawlscope.sources.sitemaps import read_sitemaps

def now():
    return F.lit("2024-02-01").cast("timestamp")


def skewed(spark):
    """A third of all rows share one key, and some keys are unknown to the other side."""
    facts = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).cast("long").alias("k"))
    dim = facts.filter("k <> 7").groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("k") * 2)
    return facts, dim


def test_lookup_join_gives_the_same_rows_on_both_ways(spark):
    facts, dim = skewed(spark)
    for how in ("left", "inner", "left_semi", "left_anti"):
        plain = sorted(lookup_join(facts, dim.drop("n"), ["k"], how=how).collect())
        split = sorted(lookup_join(facts, dim, ["k"], weight="n", how=how, hot_keys=3).collect())
        assert plain == split and (how == "left_anti" or len(plain) > 2900)


@contextmanager
def without_adaptive_help(spark):
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def heavy(spark, rows=100_000):
    """One key holds a third of the rows, 5000 others share the rest; half of the days are old."""
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000).cast("long")
    return spark.range(0, rows, 1, 8).select("id", key.alias("k"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 2).cast("int")).alias("date"))


def sizes(df):
    return [n for n in df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]


def test_no_partition_gathers_a_heavy_key(spark):
    with without_adaptive_help(spark):
        facts = heavy(spark)
        dim = facts.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("k") * 2)
        for joined in (lookup_join(facts, dim, ["k"], weight="n"), latest_rows(facts, ["k"], "date")):
            filled = sizes(joined)
            assert len(filled) >= 8 and max(filled) <= 2 * sum(filled) / len(filled)
        newest = facts.groupBy("k").agg(F.max("date").alias("date"))
        assert latest_rows(facts, ["k"], "date").count() == facts.join(newest, ["k", "date"], "left_semi").count()
        plan = latest_rows(facts, ["k"], "date")._jdf.queryExecution().executedPlan().toString()
        # histories meet their newest day by key and day; only sums per key are gathered by the key alone
        assert "hashpartitioning(k" in plan and ", date" in plan.split("LeftSemi")[0].split("SortMergeJoin")[1]


def test_first_k_sorts_no_heavy_key_in_one_task(spark):
    with without_adaptive_help(spark):
        facts = heavy(spark)
        best = first_k(facts, ["k"], [F.col("id")], 5)
        plan = best._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan and "_part" in plan
        got = sorted(r.id for r in best.filter("k = 0").collect())
        assert got == [0, 3, 6, 9, 12]
        dealt = facts.withColumn("_part", F.pmod(F.xxhash64("id", "k", "date"), F.lit(64))).repartition(8, "k", "_part")
        assert max(sizes(dealt)) <= 2 * 100_000 / 8


def test_nothing_beyond_the_old_caps_is_lost(spark):
    day = F.lit("2024-01-01").cast("date")
    rows = spark.range(1500).select(F.lit(1).cast("long").alias("project_id"), day.alias("date"), F.format_string("ring %04d", "id").alias("query"), F.format_string("https://a.com/p%d", F.col("id") % 40).alias("page"),
                                    F.lit(0).cast("long").alias("clicks"), F.col("id").alias("impressions"), F.lit(5.0).alias("position"))
    assert Q.rankings_filter(rows, "ring").count() == 1500
    ideas = spark.range(40).select(F.lit(1).cast("long").alias("project_id"), F.lit("zapato").alias("seed"), F.col("id").cast("int").alias("position"), F.format_string("como limpiar zapato %d", "id").alias("suggestion"))
    assert I.question_ideas(ideas).count() == 40 and I.question_ideas(ideas, per_seed=3).count() == 3
    # twenty spellings of one page stand before a wanted second page
    spelled = spark.range(20).select(F.lit(1).cast("long").alias("project_id"), day.alias("date"), F.lit("q").alias("query"), F.format_string("https://www.a.com/x?utm_source=%d", "id").alias("page"),
                                     F.lit(0).cast("long").alias("clicks"), F.lit(100).cast("long").alias("impressions"), F.lit(5.0).alias("position"))
    other = spelled.limit(1).withColumns({"page": F.lit("https://a.com/y"), "impressions": F.lit(1).cast("long")})
    sites = spark.createDataFrame([(1, "https://a.com/")], "project_id long, url string")
    urls = [r.url for r in Q.speed_targets(spelled.unionByName(other), sites, 6).collect()]
    assert "https://a.com/y" in urls


def ledger_and_findings(spark):
    ledger = spark.createDataFrame(
        [
            (1, 10, 1, "high", "meta", "kept", None, None, "1h", 3, "open", None), (1, 10, 1, "high", "meta", "gone", None, None, "1h", 3, "open", None),
            (1, 11, 1, "high", "meta", "page not analysed", None, None, "1h", 3, "open", None), (1, None, 1, "high", "meta", "site wide", None, None, "1h", 3, "open", None),
            (1, 10, 1, "high", "meta", "back again", None, None, "1h", 3, "dismissed", None), (1, 10, 1, "high", "cannibalization", "not owned", None, None, "1h", 3, "open", None),
        ],
        "project_id long, page_id long, snapshot_id long, severity string, category string, title string, current_text string, suggested_text string, effort string, impact int, status string, detected_at timestamp",
    ).withColumn("resolved_at", F.lit(None).cast("timestamp"))
    found = spark.createDataFrame(
        [(1, 10, "high", "meta", t, None, None, "1h", 3) for t in ("kept", "back again", "new", "new")],
        "project_id long, page_id long, severity string, category string, title string, current_text string, suggested_text string, effort string, impact int",
    )
    return ledger, found, spark.createDataFrame([(1, 10)], "project_id long, page_id long")


def test_ledger_scopes_and_idempotence(spark):
    ledger, found, pages = ledger_and_findings(spark)
    once = page_audit.book(ledger, found, C.PAGE_CATEGORIES, 2, now(), True, pages)
    states = sorted((r.title, r.status) for r in once.collect())
    assert states == sorted([
        ("kept", "open"), ("gone", "resolved"), ("page not analysed", "open"), ("site wide", "open"), ("back again", "dismissed"), ("back again", "open"),
        ("not owned", "open"), ("new", "open"),
    ])
    twice = page_audit.book(once, found, C.PAGE_CATEGORIES, 3, now(), True, pages)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    site = E.reconcile_issues(ledger, found, C.OPPORTUNITY_CATEGORIES, now(), False)
    assert {r.title for r in site.filter("status = 'resolved'").collect()} == {"site wide"}


def test_upsert_twice_changes_nothing(spark):
    kind = "project_id long, url string, title string, first_seen timestamp, last_crawled timestamp"
    current = spark.createDataFrame([(1, "a", "old", None, None), (1, "b", "b", None, None)], kind).withColumn("first_seen", F.lit("2024-01-01").cast("timestamp"))
    crawled = spark.createDataFrame([(1, "a", None), (1, "c", "c")], "project_id long, url string, title string").withColumn("last_crawled", now())
    once = E.pages_upsert(current, crawled)
    rows = {r.url: r for r in once.collect()}
    assert rows["a"].title is None and str(rows["a"].first_seen) == "2024-01-01 00:00:00" and rows["b"].title == "b" and str(rows["c"].first_seen) == "2024-02-01 00:00:00"
    assert sorted(map(str, once.collect())) == sorted(map(str, E.pages_upsert(once, crawled).collect()))


def test_action_plan_order_and_unknown_effort(spark):
    rows = [(1, "high", "a", "1d", 5), (1, "high", "b", "5min", 5), (1, "high", "c", "30min", 5), (1, "high", "d", None, None), (1, "high", "e", "soon", 5)]
    plan = E.action_plan(spark.createDataFrame(rows, "project_id long, severity string, title string, effort string, impact int").withColumn("status", F.lit("open")))
    assert {r.title: r.priority_rank for r in plan.collect()} == {"b": 1, "c": 2, "a": 3, "e": 4, "d": 5}


def test_questions_against_queries_by_brute_force(spark):
    queries = ["reparar iphone", "pantalla", "tv", "cómo reparar la pantalla rota"]
    questions = ["Cómo reparar iPhone", "reparar la pantalla", "por qué falla", "TV nueva", "donde"]
    plain = lambda s: s.lower().replace("ó", "o").replace("é", "e")
    want = {q: any(plain(k) in plain(q) or plain(q) in plain(k) for k in queries) for q in questions}
    got = R.already_has_real_data(
        spark.createDataFrame([(1, q) for q in questions] + [(2, "pantalla")], "project_id long, question string"), spark.createDataFrame([(1, q) for q in queries], "project_id long, query string")
    ).collect()
    assert {r.question: r.has_real_data for r in got if r.project_id == 1} == want
    assert [r.has_real_data for r in got if r.project_id == 2] == [False]


def test_containment_gives_each_text_once(spark):
    """A thousand questions that hold all of a thousand queries: a million pairs, of which none is made."""
    phrase = "cambio de pantalla rota y bateria hinchada bogota hoy"
    words = sorted({phrase[i:j] for i in range(len(phrase)) for j in range(i + 6, len(phrase) + 1)})[:1000]
    asked = spark.createDataFrame([(1, f"q{i} {phrase}") for i in range(1000)], "project_id long, text string")
    known = spark.createDataFrame([(1, w) for w in [*words, "hoy"]], "project_id long, text string")
    holding, held = R._containing(asked, known)
    assert {r.text for r in holding.distinct().collect()} == {r.text for r in asked.collect()} and {r.text for r in held.distinct().collect()} == {*words, "hoy"}
    assert held.count() <= known.count()
    for rows in (holding, held):
        joins = [line for line in rows._jdf.queryExecution().executedPlan().toString().splitlines() if "contains(" in line.lower()]
        assert joins and all("LeftSemi" in line for line in joins)
    got = R.already_has_real_data(asked.withColumnRenamed("text", "question"), known.withColumnRenamed("text", "query"))
    assert got.count() == 1000 and got.filter("NOT has_real_data").count() == 0


def test_cannibalization_edges(spark):
    rows = [
        (1, "q1", "https://www.a.com/x/", 1, 10, 4.0), (1, "q1", "http://a.com/x", 0, 5, 3.0), (1, "q2", "https://a.com/x", 0, 5, 3.0), (1, "q2", "https://a.com/y", 0, 7, 25.0),
        (1, "q3", "https://a.com/old", 0, 1, 5.0), (1, "q3", "https://a.com/new", 0, 1, 6.0), (1, "q4", None, 0, 1, 5.0), (1, "q4", "https://a.com/x", 0, 1, 6.0),
    ]
    queries = spark.createDataFrame(rows, "project_id long, query string, page string, clicks long, impressions long, position double").withColumn("date", F.lit("2024-01-01").cast("date"))
    redirects = spark.createDataFrame([(1, "a.com/old", "a.com/new")], "project_id long, source string, final string")
    found = {r.query: r for r in Q.cannibalization(queries, redirects).collect()}
    assert set(found) == {"q2"} and found["q2"].severity == "high" and found["q2"].page_url == "https://a.com/x" and "12 impressions" in found["q2"].title
    assert set(r.query for r in Q.cannibalization(queries).collect()) == {"q2", "q3"}


def test_robots(spark):
    text = "User-agent: *\nAllow: /p/ok\nDisallow: /p\nDisallow: /ñ\n"
    urls = ["https://a.com/p/ok/1", "https://a.com/p/x", "https://a.com/%C3%B1andu", "https://a.com/", "https://a.com/q?x=/p"]
    got = blocked_urls(spark.createDataFrame([(1, u) for u in urls], "project_id long, url string"), spark.createDataFrame([(1, text)], "project_id long, robots_txt string"), "Bot/1")
    assert {r.url for r in got.collect()} == {"https://a.com/p/x", "https://a.com/%C3%B1andu"}


def test_robots_rules_of_many_sites(spark):
    """Against the parser itself: groups, empty rules, rules for all, equal beginnings, sites without rules."""
    from urllib.robotparser import RobotFileParser

    texts = {
        1: "User-agent: other\nDisallow: /\n\nUser-agent: bot\nAllow: /a/b\nDisallow: /a\n\nUser-agent: *\nDisallow: /\n", 2: "User-agent: *\nDisallow:\nDisallow: /a\n",
        3: "User-agent: *\nAllow: /a\nDisallow: *\n", 4: "User-agent: *\nDisallow: /\nAllow: /a\n", 5: "", 6: "User-agent: other\nDisallow: /\n", 7: None,
        8: "User-agent: *\n" + "".join(f"Disallow: /x{i}/\n" for i in range(300)) + "Allow: /x299/ok\n",
    }
    urls = [f"https://s.com{p}" for p in ("", "/", "/a", "/a/b", "/a/bc?d=1", "/ab", "/x7/", "/x299/ok", "/z", "?q=1")]
    want = set()
    for site, text in texts.items():
        parser = RobotFileParser()
        parser.parse((text or "").splitlines())
        parser.modified()
        want |= {(site, u) for u in urls if not parser.can_fetch("Bot/1", u)}
    rows = spark.createDataFrame([(s, u) for s in [*texts, 9] for u in urls], "project_id long, url string")
    got = blocked_urls(rows, spark.createDataFrame(list(texts.items()), "project_id long, robots_txt string"), "Bot/1")
    assert {tuple(r) for r in got.collect()} == want
    assert got.columns == ["project_id", "url"]


def test_sources_on_disk(spark, tmp_path):
    folder = tmp_path / "maps" / "project_id=7"
    folder.mkdir(parents=True)
    (folder / "s.xml").write_text("<urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'><url><loc> https://a.com/1 </loc></url><url><loc>https://a.com/2&amp;x</loc></url><url><loc>https://a.com/1</loc></url></urlset>")
    assert {(r.project_id, r.url) for r in read_sitemaps(spark, str(tmp_path / "maps")).collect()} == {(7, "https://a.com/1"), (7, "https://a.com/2&x")}
    landed = tmp_path / "landing"
    landed.mkdir()
    (landed / "a.json").write_text('{"snapshot_id":1,"project_id":1,"collector":"gsc","status":"ok","raw_data":"{\\"end_date\\":\\"2024-01-31\\",\\"queries\\":[{\\"keys\\":[\\"q\\",\\"u\\"],\\"clicks\\":1}]}"}\n')
    rows = I.gsc_queries_ingest(I.latest_snapshot(I.read_landing(spark, str(landed)), "gsc")).collect()
    assert [(r.query, r.page, r.clicks, r.impressions, str(r.date)) for r in rows] == [("q", "u", 1, 0, "2024-01-31")]


def test_sinks_on_disk(spark, tmp_path):
    ledger, _, _ = ledger_and_findings(spark)
    files.write_action_plan_csv(ledger.withColumn("title", F.concat(F.lit("=cmd"), "title")), str(tmp_path / "plan"))
    text = "".join(p.read_text() for p in Path(tmp_path / "plan").rglob("*.csv"))
    assert "severidad,categoria,titulo,actual,sugerido,esfuerzo,impacto,detectado_en" in text and "'=cmdkept" in text and "back again" not in text
    links = spark.createDataFrame([(1, "spam.xyz", "u1", "a"), (1, "spam.xyz", "u2", "a"), (1, "ok.com", "u3", "a")], "project_id long, source_domain string, source_url string, anchor_text string")
    files.write_disavow(toxic_backlinks(links), str(tmp_path / "disavow"))
    lines = "".join(p.read_text() for p in sorted(Path(tmp_path / "disavow" / "project_id=1").glob("*.txt"))).splitlines()
    assert lines[0].startswith("# Check") and lines.count("domain:spam.xyz") == 1 and "domain:ok.com" not in lines


def test_heavy_partitions_split_while_running(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        facts, dim = skewed(spark)
        joined = lookup_join(facts.repartition(8, "id"), dim.drop("n"), ["k"])
        assert len(joined.collect()) == 3000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)

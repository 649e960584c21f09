import random
from collections import deque


from crawlscope.operators import coverage as V
from crawlscope.operators import links as L


def follow(edges, source):
    node, seen = source, set()
    while node in edges and node not in seen:
        seen.add(node)
        node = edges[node]
    return node


def closure(spark, edges):
    rows = spark.createDataFrame([(p, s, t) for p, e in edges.items() for s, t in e.items()], "project_id long, source string, target string")
    return {(r.project_id, r.source): r.final for r in L.redirect_closure(rows).collect()}


def test_chains_cycles_and_tails(spark):
    edges = {1: {"a": "b", "b": "c", "c": "d"}, 2: {"x": "y", "y": "x", "t": "x", "u": "t"}, 3: {f"n{i}": f"n{i + 1}" for i in range(70)}, 4: {"p": "q", "q": "r", "r": "p", "m": "q", "k": "end"}}
    assert closure(spark, edges) == {(p, s): follow(e, s) for p, e in edges.items() for s in e}


def test_random_redirects_like_following_them(spark):
    rng = random.Random(7)
    edges = {}
    for project in range(3):
        nodes = [f"p{i}" for i in range(60)]
        # A third of all sources lead to one page.
        edges[project] = {s: ("p0" if rng.random() < 0.33 else rng.choice(nodes)) for s in nodes if rng.random() < 0.8}
        edges[project] = {s: t for s, t in edges[project].items() if s != t}
    assert closure(spark, edges) == {(p, s): follow(e, s) for p, e in edges.items() for s in e}


def test_last_page_decides_a_source(spark):
    pages = spark.createDataFrame([(1, 1, "https://a.com/x", "https://a.com/y"), (1, 2, "http://www.a.com/x/", "https://a.com/z"), (1, 3, "https://a.com/s", "https://www.a.com/s/")], "project_id long, n int, url string, redirected_to string")
    assert [(r.source, r.target) for r in L.redirect_edges(pages, "n").collect()] == [("a.com/x", "a.com/z")]


def test_depth_orphans_and_inbound_like_a_queue(spark):
    rng = random.Random(3)
    n = 40
    links = {i: [rng.randrange(n) for _ in range(2)] + ([0] if i else []) for i in range(n - 4)}
    url = lambda i: f"https://www.s.com/{i}" if i else "https://www.s.com/"
    pages = spark.createDataFrame(
        [(1, url(i), 200, True, None, [url(j).replace("www.", "") + "#x" for j in links.get(i, [])] + ["https://www.s.com/never-crawled"], [], 0) for i in range(n)],
        "project_id long, url string, status_code int, is_indexable boolean, redirected_to string, internal_links array<string>, nofollow_internal array<string>, nofollow_external_count int",
    )
    homes = spark.createDataFrame([(1, "https://s.com")], "project_id long, url string")
    inbound = {i: len({s for s, t in links.items() if i in t and s != i}) for i in range(n)}
    depth, queue = {0: 0}, deque([0])
    while queue:
        node = queue.popleft()
        for t in links.get(node, []):
            if t not in depth:
                depth[t] = depth[node] + 1
                queue.append(t)
    got = {r.url: r for r in L.link_table(pages, homes).collect()}
    assert {u: (r.inbound, r.click_depth) for u, r in got.items()} == {url(i): (inbound[i], depth.get(i)) for i in range(n)}
    assert not got[url(0)].weak
    assert {r.url for r in L.orphans(pages, homes).collect()} == {url(i) for i in range(1, n) if inbound[i] == 0}


def test_missing_source_is_not_an_empty_one(spark):
    crawl = spark.createDataFrame([(1, "https://a.com/1", 200), (2, "https://b.com/1", 200)], "project_id long, url string, status_code int")
    sitemap = spark.createDataFrame([(1, "https://a.com/2")], "project_id long, url string")
    base = V.coverage_base(crawl, sitemap)
    found = {(r.project_id, r.difference, r.url) for r in V.coverage_diff(base).collect()}
    assert found == {(1, "in_sitemap_not_crawled", "a.com/2"), (1, "crawled_not_in_sitemap", "a.com/1")}
    told = spark.createDataFrame([(2, True, False)], "project_id long, has_sitemap boolean, has_index boolean")
    assert (2, "crawled_not_in_sitemap", "b.com/1") in {(r.project_id, r.difference, r.url) for r in V.coverage_diff(base, told).collect()}
    counts = {r.project_id: (r.sitemap, r.indexed) for r in V.coverage_counts(base).collect()}
    assert counts == {1: (1, None), 2: (None, None)}


def test_links_of_one_page_under_several_urls_count_once(spark):
    rows = [
        (1, "https://s.com/", ["https://s.com/a", "https://s.com/a/", "https://s.com/b"]), (1, "http://www.s.com/", ["https://s.com/a", "https://s.com/c", "https://s.com/"]),
        (1, "https://s.com/a", ["https://s.com/b", "https://s.com/d"]), (1, "https://s.com/b", []), (1, "https://s.com/d", None), (1, "http://s.com/d", []),
    ]
    pages = spark.createDataFrame([(*r[:2], 200, True, r[2]) for r in rows], "project_id long, url string, status_code int, is_indexable boolean, internal_links array<string>")
    homes = spark.createDataFrame([(1, "https://s.com")], "project_id long, url string")
    links = L.out_links(pages)
    assert {(r.node, t) for r in links.collect() for t in r.targets or []} == {("s.com/", "s.com/a"), ("s.com/", "s.com/b"), ("s.com/", "s.com/c"), ("s.com/a", "s.com/b"), ("s.com/a", "s.com/d")}
    assert {(r.source, r.target) for r in L.link_edges(pages).collect()} == {("s.com/", "s.com/a"), ("s.com/", "s.com/b"), ("s.com/a", "s.com/b"), ("s.com/a", "s.com/d")}
    assert {r.node: r.inbound for r in L.inbound_counts(pages).collect()} == {"s.com/": 0, "s.com/a": 1, "s.com/b": 2, "s.com/d": 1}
    assert {r.node: r.click_depth for r in L.click_depth(links, homes).collect()} == {"s.com/": 0, "s.com/a": 1, "s.com/b": 1, "s.com/d": 2}


def test_links_are_counted_before_they_are_dealt(spark):
    pages = spark.createDataFrame([(1, f"https://s.com/{i}", 200, True, ["https://s.com/0"]) for i in range(50)], "project_id long, url string, status_code int, is_indexable boolean, internal_links array<string>")
    plan = L.inbound_counts(pages)._jdf.queryExecution().executedPlan().toString()
    generated = plan.index("Generate explode")
    assert "partial_count" in plan[plan.rindex("Exchange", 0, generated):generated]  # upper lines come later

from pyspark.sql import functions as F

from crawlscope.operators import page_rules as P
from crawlscope.operators import pages as G
from crawlscope.operators.local import local_score, nap_consistency, nap_phones
from crawlscope.sources.html import extract_page_features

FULL = """<!doctype html><html lang="es-CO"><head><title>
 Cambio de pantalla </title><meta name="description" content=" Texto "><meta name="author" content="Ana"><meta name="robots" content="index,follow">
<link rel="canonical" href="https://www.taller.example/pantalla"><meta property="og:title" content="T"><meta property="og:image" content="">
<meta property="article:published_time" content="2024-01-01">
<script type="application/ld+json">{"@type":["LocalBusiness","Store"],"name":"Taller","telephone":"300 123 4567","address":{"@type":"PostalAddress","city":"Cali"}}</script>
<script type="application/ld+json">{"broken": </script><script>var t = "</p>";</script><style>p{}</style></head>
<body><!-- nada --><h1>REPARACIÓN DE<br/>CELULARES <span>i</span>Phone</h1><h1> </h1><p>Escríbenos &amp; llama</p>
<a href="/a#x">a</a><a href="https://taller.example/b" rel="NoFollow">b</a><a href="https://otro.example" rel="nofollow noopener">c</a><a href="mailto:x@y.z">m</a><a href="tel:1">t</a></body></html>"""
EMPTY = "<html><head><title></title><meta name='robots' content='NOINDEX'></head><body>x</body></html>"


def features(spark):
    rows = [(1, "https://www.taller.example/p/", FULL), (1, "https://www.taller.example/z", EMPTY)]
    return {r["url"]: r for r in extract_page_features(spark.createDataFrame(rows, "project_id long, url string, html string")).collect()}


def test_html_features(spark):
    page = features(spark)["https://www.taller.example/p/"]
    assert page["title"] == "Cambio de pantalla" and page["meta_description"] == "Texto" and page["lang_declared"] == "es"
    assert page["h1_tags"] == ["REPARACIÓN DE CELULARES iPhone"]
    assert page["canonical"] == "https://www.taller.example/pantalla" and page["is_indexable"]
    assert page["og"].asDict() == {"title": "T", "description": None, "image": None}
    assert page["internal_links"] == ["https://www.taller.example/a", "https://taller.example/b"]
    assert page["nofollow_internal"] == ["https://taller.example/b"] and page["nofollow_external_count"] == 1
    assert page["schema_types"] == ["LocalBusiness", "Store"] and page["schema_has_errors"]
    assert page["schema_nodes"][0]["fields"] == ["address", "address.city", "name", "telephone"]
    assert page["local_business_schema"].asDict() == {"name": "Taller", "telephone": "300 123 4567"}
    assert page["has_author"] and page["has_date"] and page["has_contact"]
    assert "var t" not in page["body_text"] and "nada" not in page["body_text"] and "Escríbenos & llama" in page["body_text"]


def test_zombie_page(spark):
    page = features(spark)["https://www.taller.example/z"]
    assert not page["is_indexable"] and page["h1_tags"] == [] and page["title"] == "" and page["lang_declared"] == "es"
    assert not (page["has_author"] or page["has_date"] or page["has_contact"])


def light(spark, column, **inputs):
    row = spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{k} string" for k in inputs))
    return row.select(column.alias("x")).first()["x"]["light"]


def test_title_and_meta_edges(spark):
    title = P.evaluate_title(F.col("t"), F.col("k"))
    for length, want in [(19, "red"), (20, "yellow"), (29, "yellow"), (30, "green"), (60, "green"), (61, "yellow"), (70, "yellow"), (71, "red")]:
        assert light(spark, title, t="a" * length, k=None) == want, length
    assert light(spark, title, t="a" * 40, k="zz") == "yellow" and light(spark, title, t="", k=None) == "red"
    meta = P.evaluate_meta(F.col("d"))
    for length, mark, want in [(99, "$", "red"), (119, "$", "yellow"), (120, "$", "green"), (160, "$", "green"), (161, "$", "yellow"), (140, "", "yellow"), (200, "$", "yellow")]:
        assert light(spark, meta, d="a" * (length - len(mark)) + mark) == want, length


def test_duplicates_ignore_aliases_and_other_states(spark):
    rows = [
        (1, "https://a.com/1", None, True, "Uno  dos", 10), (1, "https://a.com/2", 200, True, "uno DOS", 500), (1, "https://a.com/3", 404, True, "uno dos", 10),
        (1, "https://a.com/4", 200, False, "uno dos", 10), (1, "https://a.com/5", 200, True, "uno dos", None), (1, "https://a.com/6", 200, True, None, 199), (2, "https://b.com/1", 200, True, "uno dos", 200),
    ]
    pages = spark.createDataFrame(rows, "project_id long, url string, status_code int, is_indexable boolean, title string, word_count int").withColumns(
        {"meta_description": F.lit(None).cast("string"), "h1": F.lit("").cast("string")}
    )
    edges = spark.createDataFrame([(1, "a.com/5", "a.com/2")], "project_id long, source string, target string")
    found = G.duplicate_field(pages, edges).collect()
    assert [(r.project_id, r.field, r.value, r.pages, r.sample_urls) for r in found] == [(1, "title", "uno dos", 2, "https://a.com/1, https://a.com/2")]
    assert {r.url for r in G.duplicate_members(pages, edges).collect()} == {"https://a.com/1", "https://a.com/2"}
    assert {r.url for r in G.thin_content(pages, edges).collect()} == {"https://a.com/1", "https://a.com/6"}


def test_phones(spark):
    kind = "project_id long, url string, body_text string, local_business_schema struct<name:string,telephone:string>"
    pages = spark.createDataFrame(
        [(1, "u1", "Tel 300 123 4567 y 3001234567", None), (1, "u2", "nada", ("n", "+57 300 123 4567")), (2, "u3", "sin", None), (3, "u4", "3001234567 3109999999", None)], kind
    )
    phones = nap_phones(pages)
    one = phones.filter("project_id = 1").collect()
    assert [(r.phone, r.pages_count, r.from_schema) for r in one] == [("3001234567", 2, True)]
    summary = {r.project_id: (r.phones, r.is_consistent, r.primary_phone) for r in nap_consistency(pages, phones).collect()}
    assert summary[1] == (1, True, "3001234567") and summary[2] == (0, True, None) and summary[3][:2] == (2, False)
    assert {r.project_id: r.local_score for r in local_score(pages).collect()} == {1: 100, 2: 40, 3: 30}

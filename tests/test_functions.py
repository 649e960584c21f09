from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from crawlscope.functions import text as T
from crawlscope.functions import urls as U


def values(spark, inputs, column, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("v"))).collect()]


def expected_canonical(url):
    if not url or not url.strip():
        return ""
    parsed = urlparse(url.strip())
    host = parsed.netloc.lower()
    host = host[4:] if host.startswith("www.") else host
    return host + (parsed.path.rstrip("/") or "/")


URLS = [
    "https://www.A.com/x/", "http://a.com/x", "https://a.com/x?y=1#z", "https://a.com", "https://a.com///", " https://a.com/p q/ ", None, "", "  ",
    "a.com/b", "/only/path/", "//www.b.com/c//", "https://a.com/x;p=1", "https://a.com/x;p/y;q;r", "https://a.com/x;p/", "https://www.www.com/", "https://a.com:8080/é/|x",
    "HTTPS://WWW.A.COM/Path", "mailto:me@x.com", "https://a.com/#/route", "https://a.com?x=/y/", "https://a.com/a//b//",
]


def test_canonical_url_like_a_url_parser(spark):
    assert values(spark, URLS, U.canonical_url) == [expected_canonical(u) for u in URLS]


def test_normalize_and_domain(spark):
    assert values(spark, ["https://a.com/x/#y", "https://a.com/?q=1", "https://a.com"], U.normalize_url) == ["https://a.com/x", "https://a.com/?q=1", "https://a.com/"]
    assert values(spark, ["https://www.A.com:8080/x"], U.domain_of) == ["a.com"]
    assert values(spark, ["https://www.A.com:8080/x"], lambda c: U.domain_of(c, keep_port=True)) == ["a.com:8080"]
    assert values(spark, ["a.xyz", "localhost", "b.co.TOP"], U.top_level_domain) == ["xyz", "", "top"]


@pytest.mark.parametrize("position, bucket", [(-1.0, "1-3"), (0.0, "1-3"), (3.0, "1-3"), (3.1, "4-10"), (10.0, "4-10"), (10.4, "11-20"), (20.0, "11-20"), (20.1, "21+"), (None, None)])
def test_position_bucket(spark, position, bucket):
    assert values(spark, [position], T.position_bucket, "double") == [bucket]


def test_stuck_words(spark):
    cases = {"REPARACIÓNiPHONE": True, "REPARACIÓN iPHONE EN CALI": False, "Arreglo de iPadOS y MacBook": False, "ReparacióniPhone": True, "todo bien": False}
    assert values(spark, list(cases), T.stuck_words) == list(cases.values())


def test_duplicate_brand_suffix(spark):
    cases = {"Pantalla | Tienda | Tienda": "Tienda", "Pantalla - Mi Tienda – mi tienda ": "Mi Tienda", "Pantalla | Tienda": None, None: None}
    assert values(spark, list(cases), T.duplicate_brand_suffix) == list(cases.values())


def test_directives(spark):
    cases = {"googlebot: NoIndex, nofollow": ["nofollow", "noindex"], "max-snippet: 20": ["max-snippet"], " , ": [], None: [], "none": ["none"]}
    assert values(spark, list(cases), lambda c: F.array_sort(T.x_robots_directives(c))) == list(cases.values())


def test_phones_words_and_csv(spark):
    assert values(spark, ["+57 300-123-4567", "123"], T.normalize_phone) == ["3001234567", ""]
    assert values(spark, ["Tel (300) 123 4567 o +57 3019998877"], T.extract_phones) == [["(300) 123 4567", "+57 3019998877"]]
    assert values(spark, ["Reparación de la pantalla PANTALLA"], lambda c: F.array_sort(T.significant_words(c))) == [["pantalla", "reparacion"]]
    assert values(spark, ["=1+1", "ok", "@x", None], T.csv_safe) == ["'=1+1", "ok", "'@x", ""]
    assert values(spark, ["  Hola \n MUNDO ", "  ", None], T.norm_text) == ["hola mundo", None, None]
    assert values(spark, ["Ñandú Ça vă"], T.strip_accents) == ["Nandu Ca va"]


def test_platforms_and_questions(spark):
    assert values(spark, ["instagram.com", "m.facebook.com", "notx.com", "x.com"], T.is_platform) == [True, True, False, True]
    rows = spark.createDataFrame([("¿Cómo reparar iPhone?", "iphone"), ("cómo llegar", "iphone"), ("iphone barato", "iphone"), ("donde ir", "tv")], "t string, s string")
    assert [r[0] for r in rows.select(T.looks_like_question(F.col("t"), F.col("s"))).collect()] == [True, False, False, True]


def test_reading_ease_by_hand(spark):
    # 4 words, 7 syllables ("ph" has no vowel and counts one), 2 sentences.
    assert values(spark, ["Hola casa. ¿Perro ph?", "", None], T.flesch_huerta) == [round(206.84 - 60 * (7 / 4) - 1.02 * (4 / 2), 1), 205.8, 205.8]


def test_reading_ease_just_below_zero_keeps_its_sign(spark):
    # 27 words, 90 syllables, 4 sentences: -0.045, which titles of findings quote.
    words = ["abababab"] * 9 + ["ababab"] * 18
    text = ". ".join(" ".join(words[i:i + 7]) for i in range(0, 27, 7))
    assert values(spark, [text], lambda c: T.flesch_huerta(c).cast("string")) == ["-0.0"]


def test_language_mismatch(spark):
    assert values(spark, ["the best of our shop", "la casa de the is", "the"], lambda c: T.language_mismatch(c, F.lit("es"))) == [True, False, False]
    assert values(spark, ["the best of our shop"], lambda c: T.language_mismatch(c, F.lit("en"))) == [False]

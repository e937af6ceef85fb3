"""Scalar functions: URL normalization, vector parsing, codes, text helpers."""

import math

import pytest
from pyspark.sql import functions as F

from lingomesh.functions import codes as C
from lingomesh.functions import text as T
from lingomesh.functions.urls import code_candidate, normalize_url, strip_language
from lingomesh.functions.vectors import parse_vector_text


def _col(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


URL_CASES = [
    ("https://www.Example.com/de/Seite/?utm_source=x&b=2&a=1#top", "example.com/de/Seite?a=1&b=2"),
    ("http://example.com", "example.com/"),
    ("http://example.com/", "example.com/"),
    ("example.com/a/b/", "example.com/a/b"),
    ("", ""),
    (None, ""),
    ("nan", ""),
    ("https://user:pw@EXAMPLE.com:8080/x;params?q", "example.com/x?q="),
    ("https://example.com/a?x=%7e&y=a b", "example.com/a?x=~&y=a+b"),
    ("https://[bad/x", "https://[bad/x"),
    ("https://example.com//", "example.com"),
    ("https://example.com/p?gclid=1&FBCLID=2", "example.com/p"),
]


def test_normalize_url(spark):
    got = _col(spark, [u for u, _ in URL_CASES], normalize_url)
    assert got == [e for _, e in URL_CASES]


def test_strip_language(spark):
    df = spark.createDataFrame(
        [("example.com/de/a", "de"), ("example.com/de-at/a", "de"), ("example.com/DE/a?x=1", "de-AT"),
         ("example.com/fr/a", "de"), ("example.com", "de"), ("example.com/de", "de")],
        "u string, c string",
    )
    got = [r[0] for r in df.select(strip_language("u", F.col("c"))).collect()]
    assert got == ["*/a", "*/a", "*/a?x=1", "*/fr/a", "*/", "*/"]


def test_code_candidate(spark):
    urls = ["https://x.com/de-at/a", "https://fr.example.com/a", "https://www.example.de/a", "https://example.at/",
            "https://example.com/about", "https://[bad/x"]
    assert _col(spark, urls, code_candidate) == ["de-AT", "fr", "de", "", "", ""]


def test_codes(spark):
    vals = ["de-at", "DE", "fr-CH", " en ", "x-default", "deu", "de_AT", ""]
    assert _col(spark, vals, C.is_valid_code) == [True, True, True, True, False, False, False, False]
    assert _col(spark, vals, C.normalize_code) == ["de-AT", "de", "fr-CH", "en", "x-default", "deu", "de_AT", ""]
    assert _col(spark, ["de-AT", " FR "], C.language_of) == ["de", "fr"]


@pytest.mark.parametrize("text,expected", [
    ("[1, 2, 3]", [1.0, 2.0, 3.0]),
    ("1,2;3 4", [1.0, 2.0, 3.0, 4.0]),
    ('["1","2"]', [1.0, 2.0]),
    ("[true,false]", [1.0, 0.0]),
    ("[[1,2],[3,4]]", [1.0, 2.0, 3.0, 4.0]),
    ("[0.1, 0.2", [0.1, 0.2]),
    ("[]", None),
    ("", None),
    ("nan", None),
    ("abc", None),
    ("abc 5", [5.0]),
])
def test_parse_vector(spark, text, expected):
    got = _col(spark, [text], parse_vector_text)[0]
    if expected is None:
        assert got is None
    else:
        assert got == pytest.approx(expected, rel=1e-6)


def test_parse_vector_null_and_overflow(spark):
    got = _col(spark, ["[1, null, 2]", "[1e39, 1]"], parse_vector_text)
    assert math.isnan(got[0][1])
    assert math.isinf(got[1][0])


def test_text_helpers(spark):
    assert _col(spark, ["  a \n\t b  ", None], lambda c: T.truncate(c, 3)) == ["a b", ""]
    df = spark.createDataFrame([("Titel", None, "Haupt  text")], "a string, b string, c string")
    assert df.select(T.build_text(["a", "b", "c"], 100)).first()[0] == "Titel\n\nHaupt text"
    assert df.select(T.build_text(["a", "b", "c"], 8)).first()[0] == "Titel\n\nH"
    assert _col(spark, ["a&b<\"'>"], T.html_escape) == ["a&amp;b&lt;&quot;&#x27;&gt;"]
    assert _col(spark, [" NaN ", "none", "x", None], T.is_blank) == [True, True, False, True]

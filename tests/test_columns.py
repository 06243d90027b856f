"""URL, HTML and text columns on literal cases."""

from __future__ import annotations

import hashlib

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from weftline.functions import html as H, text as T, urls as U

URLS = [
    ("HTTPS://Example.COM/Path/?utm_source=x&b=2&a=1#frag", "https://example.com/Path?a=1&b=2"),
    ("http://a.com", "http://a.com/"),
    ("http://a.com///", "http://a.com/"),
    ("http://a.com/x?ref=1", "http://a.com/x"),
    ("http://a.com/x?REF=1", "http://a.com/x?REF=1"),
    ("http://a.com/x?q=a%20b", "http://a.com/x?q=a+b"),
    ("http://a.com/x?a=2&a=1", "http://a.com/x?a=2&a=1"),
    ("http://a.com:80/x", "http://a.com:80/x"),
    ("http://a.com/x?b", "http://a.com/x?b="),
    ("http://a.com/x?a=1;b=2", "http://a.com/x"),
    ("http://a.com/x?", "http://a.com/x?"),
    ("http://a.com/%zz", "http://a.com/%zz"),
    ("http://user:Pw@A.com/x/", "http://user:Pw@a.com/x"),
    ("http://a.com/a%2Fb", "http://a.com/a%2Fb"),
    ("http://a.com/x?q=~*", "http://a.com/x?q=~%2A"),
]


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1)])
    return row.select(column).first()[0]


def test_normalize(spark):
    rows = spark.createDataFrame(URLS, "u string, want string").select("u", U.normalize_url(F.col("u")).alias("got"), "want").collect()
    assert [(r.u, r.got) for r in rows] == [(r.u, r.want) for r in rows]


def test_normalize_is_idempotent(spark):
    urls = spark.createDataFrame(URLS, "u string, want string").select(U.normalize_url(F.col("u")).alias("n"))
    assert urls.where(U.normalize_url(F.col("n")) != F.col("n")).count() == 0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abXY/?&=#.%:u~ é", max_size=20), min_size=20, max_size=40))
def test_normalize_never_fails(spark, tails):
    rows = spark.createDataFrame([("http://h.example/" + t,) for t in tails], "u string")
    assert rows.where(U.normalize_url(F.col("u")).isNull()).count() == 0


@pytest.mark.parametrize(("url", "want"), [("http://Docs.GitHub.com:8080/x", "docs.github.com"), ("http://u@a.com", "a.com"), ("nonsense", ""), ("http://[::1]:80/x", "::1"), ("http://a b/", "")])
def test_host(spark, url, want):
    assert one(spark, U.url_host(F.col("u")), u=url) == want


@pytest.mark.parametrize(("host", "want"), [("github.com", True), ("docs.github.com", True), ("notgithub.com", False), ("github.com.evil.io", False)])
def test_suffix_match(spark, host, want):
    assert one(spark, U.host_matches(F.col("h"), [" GitHub.com "]), h=host) is want


@pytest.mark.parametrize(("url", "want"), [("http://a.com", "/"), ("http://a.com/a%20b?x=1", "/a b?x=1")])
def test_robots_path(spark, url, want):
    assert one(spark, U.robots_path(F.col("u")), u=url) == want


def page(text_bytes, scripts, more=0):
    return "<p>" + "x" * text_bytes + "</p>" + "<script src=a></script>" * scripts + "<!--" + "y" * more + "-->"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (page(150, 6), True), (page(150, 5), False), ('<div id="root"> </div>' + page(10_000, 0), True), (page(390, 0, 9_000), True), (page(600, 0, 20_000), False),
        ("<noscript>You need to enable JavaScript</noscript>" + page(900, 0), True), ("<noscript>no\nenable javascript</noscript>" + page(900, 0), False), ("", True),
    ],
)
def test_needs_javascript(spark, html, want):
    assert one(spark, H.content_assessment(F.col("h"))["needs_js"], h=html) is want


def test_assessment_figures(spark):
    a = one(spark, H.content_assessment(F.col("h")), h="<p>é  b</p><script>__NUXT__</script>")
    assert (a.text_length, a.script_tags, a.ssr_framework) == (len("é b __NUXT__".encode()), 1, "nuxt")


@pytest.mark.parametrize(("html", "want"), [("<title> 403 </title> captcha", "403"), ("Ray ID", "cloudflare"), ("hCaptcha", "captcha"), ("fine", "")])
def test_bot_signal(spark, html, want):
    assert one(spark, H.bot_signal(F.col("h")), h=html) == want


def test_truncation_cuts_bytes(spark):
    text = "é" * 3000
    want = text.encode()[:5000] + T.TRUNCATED.encode()
    assert bytes(one(spark, T.truncated_bytes(F.col("t")), t=text)) == want
    assert one(spark, F.sha2(T.truncated_bytes(F.col("t")), 256), t=text) == hashlib.sha256(want).hexdigest()
    assert one(spark, T.displayed(T.truncated_bytes(F.col("t"))), t="a" + text).endswith("... [truncated]")


@pytest.mark.parametrize(("x", "want"), [(0.125, "0.12"), (0.975, "0.97"), (0.005, "0.01"), (1.0, "1.00")])
def test_two_decimals(spark, x, want):
    assert one(spark, T.two_decimals(F.col("x")), x=x) == want


def test_blank_collapse(spark):
    assert one(spark, T.blank_collapse(F.col("t")), t=" \na\n\n\n\nb\n\nc\n ") == "a\n\nb\n\nc"


def test_quoted(spark):
    assert one(spark, T.quoted(F.col("t")), t='a "b"\n\\') == '"a \\"b\\"\\n\\\\"'


def test_two_decimals_of_the_binary_value(spark):
    import random

    r = random.Random(2)
    values = [0.0, -0.0, 0.005, 0.015, 0.125, 0.375, 1.005, 2.675, 0.994999999999, 0.995, 1e12 + 0.125, 123456789.345, -0.001, -1.125, 1e-300, 5e-324, 1e13, 12345678901234567.0, 1.0]
    values += [r.uniform(-1, 1) for _ in range(3000)] + [k / 1000 for k in range(-2000, 2000)] + [k / 8 for k in range(200)] + [r.uniform(-1e12, 1e12) for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", T.two_decimals(F.col("x")).alias("s")).collect()
    assert [x.s for x in rows] == [f"{v:.2f}" for v in values]
    odd = spark.createDataFrame([(None,), (float("nan"),)], "x double").select(T.two_decimals(F.col("x")).alias("s")).collect()
    assert [x.s for x in odd] == [None, None]

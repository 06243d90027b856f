"""Robots texts: grammar, groups, precedence, wildcards, status, and the joins that apply the rules."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weftline.config import Policy
from weftline.operators import robots

AGENT = "weftline"


@pytest.mark.parametrize(
    "body, want",
    [
        ("", ("rules", [])),
        ("User-agent: *\nDisallow: /a", ("rules", [(False, "/a")])),
        ("User-agent: *\nDisallow:\nAllow:", ("rules", [])),
        ("\ufeffUSER-AGENT: *\r\n\r\nDISALLOW : a # why\rAllow: *x", ("rules", [(False, "/a"), (True, "*x")])),
        ("User-agent: *\nDisallow: /\nUser-agent: weft\nDisallow: /w\nUser-agent: weftl\nDisallow: /wl\nUser-agent: weftliner\nDisallow: /no", ("rules", [(False, "/wl")])),
        ("User-agent: x\nUser-agent: WeftLine\nCrawl-delay: 3\nUser-agent: y\nDisallow: /y\nuser-agent: weftline\nDisallow: /z", ("rules", [(False, "/z")])),
        ("User-agent: x\nSitemap: /s\nUser-agent: weftline\nDisallow: /both", ("rules", [(False, "/both")])),
        ("User-agent: other\nDisallow: /", ("rules", [])),
        ("User-agent:\nDisallow: /", ("rules", [])),
        ("Disallow: /\nUser-agent: *", ("error", [])),
        ("<html>not: robots</html>", ("rules", [])),
    ],
)
def test_grammar(body, want):
    assert robots.parse(200, body, AGENT) == want


def test_status():
    state = lambda *a, **k: robots.parse(*a, AGENT, **k)[0]
    assert [state(s, "User-agent: *\nDisallow: /") for s in (None, 200, 204, 301, 404, 429, 500, 503)] == ["error", "rules", "rules", "error", "allow_all", "allow_all", "error", "error"]
    assert state(503, "", open_5xx=False) == "disallow_all" and state(200, None) == "error"


RULES = [
    ("/a/b", [(False, "/a"), (True, "/a/b")], True),
    ("/a/bc", [(True, "/a/"), (False, "/a/b")], False),
    ("/a", [(False, "/a"), (True, "/a")], True),
    ("/x", [(False, "/a")], True),
    ("/file.pdf", [(False, "/*.pdf$")], False),
    ("/file.pdf?x", [(False, "/*.pdf$")], True),
    ("/a/x/b/y", [(False, "/a*b")], False),
    ("/b/a", [(False, "/a*b")], True),
    ("/q/page", [(False, "*page"), (True, "/q")], False),
    ("/aXbXc", [(False, "/a*b*c$")], False),
    ("/aXbXcX", [(False, "/a*b*c$")], True),
    ("/a.b", [(False, "/a+b"), (False, "/a?b"), (False, "/a.c")], True),
    ("/cost$", [(False, "/cost$x")], True),
    ("/cost$x", [(False, "/cost$x")], False),
    ("/exact", [(False, "/exact$")], False),
    ("/exactly", [(False, "/exact$")], True),
    ("/ü/é", [(False, "/ü"), (True, "/*é")], True),
    ("/a\nb", [(False, "/*b")], False),
]


@pytest.mark.parametrize("path, rules, want", RULES)
def test_precedence(path, rules, want):
    assert robots.decide(rules, path) is want


def test_hostile_patterns_end():
    import time

    began = time.time()
    assert robots.decide([(False, "/" + "*a" * 60 + "*b")], "/" + "a" * 3000)
    assert time.time() - began < 2


def test_joins_equal_rows(spark):
    """Many hosts and paths at random, one host with most of them, against the rules row by row."""
    r = random.Random(7)
    part = lambda: r.choice(["a", "b", "ab", "é", "x.html", "c d"])
    bodies = []
    for k in range(40):
        lines = []
        for name in r.sample(["*", "weft", "weftline", "other"], r.randrange(1, 4)):
            lines.append(f"User-agent: {name}")
            lines += [f"{r.choice(['Allow', 'Disallow'])}: {r.choice(['/', '/*', ''])}{part()}{r.choice(['', '/', '*', '$', '*b', '/' + part()])}" for _ in range(r.randrange(6))]
        bodies.append((f"h{k}.com", r.choice([200, 200, 200, 200, 404, 500, None]), "\n".join(lines)))
    urls = [(i, f"https://h{0 if i % 3 else r.randrange(42)}.com/" + "/".join(part() for _ in range(r.randrange(4))) + r.choice(["", "?q=ab"])) for i in range(900)] + [(900, "nothing"), (901, None), (902, "https://h0.com")]
    rows = spark.createDataFrame(urls, "event_id long, url string").withColumns({"state": F.lit("clash"), "rule": F.lit(1), "path": F.lit("clash"), "host": F.lit("clash"), "salt": F.lit(0)})
    for policy in (Policy(), Policy(user_agent="otherbot", robots_5xx_open=False)):
        got = robots.with_robots(rows, spark.createDataFrame(bodies, "host string, status int, body string"), policy)
        assert got.columns == [*rows.columns, "robots_checked", "robots_allowed"]
        got = {x.event_id: (x.robots_checked, x.robots_allowed) for x in got.collect()}
        texts = {h: robots.parse(s, b, policy.user_agent, policy.robots_5xx_open) for h, s, b in bodies}
        want = {}
        for i, url in urls:
            host, _, path = (url or "").removeprefix("https://").partition("/")
            state, rules = texts.get(host if url and url.startswith("https://") else "", ("error", []))
            want[i] = (state != "error", state != "disallow_all" and robots.decide(rules, "/" + path))
        assert got == want and len(set(want.values())) >= 3


def test_nothing(spark):
    rows = spark.createDataFrame([("https://a.com/x",)], "url string")
    none = spark.createDataFrame([], "host string, status int, body string")
    assert [tuple(r) for r in robots.with_robots(rows, none).collect()] == [("https://a.com/x", False, True)]
    twice = spark.createDataFrame([("A.com", 200, "User-agent: *\nDisallow: /"), ("a.com", None, None), (None, 200, "")], "host string, status int, body string")
    assert [tuple(r) for r in robots.with_robots(rows, twice).collect()] == [("https://a.com/x", True, False)]
    assert robots.with_robots(rows.limit(0), twice).count() == 0

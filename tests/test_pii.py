"""Recognisers, check digits, the sweep over clashing spans, detectors that fail, and redaction, against plain versions."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from weftline.config import PII
from weftline.operators import pii


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "i int, content string, score string")


def spans(text, config=PII(), detectors=()):
    return pii._looking(config, detectors)([text])[0]


def test_licences_have_a_check_digit():
    assert [(e, text[a:b]) for text in ("AB1234563 AB1234564 ab1234563 A91234563 ZZ1234563",) for e, a, b, _ in spans(text)] == [("MEDICAL_LICENSE", "AB1234563"), ("MEDICAL_LICENSE", "A91234563")]


def test_entities_and_threshold():
    text = "a@b.example 10.1.2.3 123-45-6789 +49 170 1234567"
    assert {e for e, *_ in spans(text)} == {"EMAIL_ADDRESS", "IP_ADDRESS", "US_SSN", "PHONE_NUMBER"}
    assert {e for e, *_ in spans(text, PII(score_threshold=0.6))} == {"EMAIL_ADDRESS", "IP_ADDRESS", "US_SSN"}
    assert {e for e, *_ in spans(text, PII(entities=("IP_ADDRESS",)))} == {"IP_ADDRESS"}
    assert spans("123-45-6789", PII(entities=("PHONE_NUMBER",))) == [("PHONE_NUMBER", 0, 11, 0.5)]  # else a better one takes it
    assert spans("123-45-6789") == [("US_SSN", 0, 11, 0.85)]


def test_mail_is_found_as_by_its_pattern():
    pattern = re.compile(pii.RECOGNISERS[0].pattern, re.ASCII)
    domain = re.compile(pii.RECOGNISERS[0].pattern[pii.RECOGNISERS[0].pattern.index("@") :], re.ASCII)
    r = random.Random(3)
    for _ in range(3000):
        text = "".join(r.choice(["a", "b.c", "@", ".", "-", "com", " ", "é", "+", "x@y.zz", "1"]) for _ in range(r.randrange(14)))
        assert list(pii._mail_places(text, domain)) == [m.span() for m in pattern.finditer(text)], text


def test_sweep():
    r = random.Random(5)
    for _ in range(300):
        found = []
        for k in range(r.randrange(25)):
            a = r.randrange(60)
            found.append((f"T{k}", a, a + r.randrange(1, 12), r.choice([0.5, 0.6, 1.0])))
        kept = []
        for x in sorted(found, key=lambda s: (-s[3], -(s[2] - s[1]), s[1], found.index(s))):
            if all(x[2] <= y[1] or y[2] <= x[1] for y in kept):
                kept.append(x)
        assert pii.swept(found) == sorted(kept, key=lambda s: s[1])


def names():
    def look(texts, language):
        if any("broken" in t for t in texts):
            raise RuntimeError("down")
        assert language == "en"
        return [[("PERSON", m.start(), m.end(), 0.9) for m in re.finditer("Ann[a-z]*", t)] + [("PERSON", 0, 10**9, 1.0), ("PERSON", 2, 1, 1.0), ("UNKNOWN", 0, 1, 1.0)] for t in texts]

    return look


def wrong_count():
    return lambda texts, language: [[]] * (len(texts) + 1)


def test_detectors(spark):
    rows = docs(spark, "Anna 123-45-6789", "broken Anna", "", None, "Ann@b.example", *["Anna"] * 200)
    got = {r.i: r for r in pii.process(rows, PII(mode="redact"), detectors=[names]).collect()}
    assert got[0].content == "<PERSON> <REDACTED>" and got[0].score == "clash"
    assert (got[1].pii_action, got[1].pii_checked, got[1].content) == ("skipped", False, "broken Anna")
    assert (got[2].pii_action, got[2].content, got[3].content) == ("pass", "", None)
    assert got[4].content == "*" * 13  # the address is the better one
    assert {got[i].content for i in range(5, 205)} == {"<PERSON>"}
    failed = pii.process(rows, PII(mode="redact"), detectors=[names, wrong_count]).where("content is not null and content <> ''").select("pii_action").distinct().collect()
    assert [r.pii_action for r in failed] == ["skipped"]
    assert pii.process(rows.limit(0), detectors=[names]).count() == 0


def plain(text):
    out, at = "", 0
    for e, a, b, _ in spans(text):
        new = "*" * min(100, b - a) + text[a + 100 : b] if e == "EMAIL_ADDRESS" else {"PHONE_NUMBER": "<PHONE>", "PERSON": "<PERSON>"}.get(e, "<REDACTED>")
        out, at = out + text[at:a] + new, b
    return out + text[at:]


def test_redaction(spark):
    r = random.Random(9)
    part = lambda: r.choice(["x" * 120 + "@mail.example", "4111 1111 1111 1111", "é 😀", "DE44500105175407324931", "12 345 6789", "255.1.1.1", " ", "word", "\n"])
    texts = [" ".join(part() for _ in range(r.randrange(9))) for _ in range(100)]
    got = {x.i: x.content for x in pii.process(docs(spark, *texts), PII(mode="redact")).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("text", ["a1b2" * (1 << 19), "call 12 345 6789, " * 40_000, "x@y.example " * 60_000, "@" * 100_000 + "1" * 100_000])
def test_long_texts_are_linear(spark, text):
    began = time.time()
    row = pii.process(docs(spark, text), PII(mode="redact")).select(F.length("content"), "entity_count").first()
    assert row[0] > 0 and time.time() - began < 60

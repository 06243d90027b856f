"""Which level's page is used: the escalation table over pages already fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import Detection
from ..functions.html import bot_signal, content_assessment
from ..functions.once import evaluated

BODY_LIMIT = 5 << 20


def read_pages(pages: DataFrame) -> DataFrame:
    """Pages with bodies cut at 5 MiB; only those over the limit are sliced as bytes."""
    cut = F.make_valid_utf8(F.substring(F.encode("html", "UTF-8"), 1, BODY_LIMIT).cast("string"))
    return pages.withColumn("html", F.when(F.octet_length("html") > BODY_LIMIT, cut).otherwise(F.col("html")))


def escalation(l0: DataFrame, limits: Detection | None = None) -> DataFrame:
    """Level-0 pages with their assessment and whether a rendered page is wanted."""
    out = l0.withColumn("assessment", content_assessment(F.col("html"), limits))
    return out.withColumn("escalate", F.col("html").isNull() | F.coalesce(F.col("assessment.needs_js"), F.lit(False)))


def merge_levels(l0: DataFrame, rendered: DataFrame, l1_available: bool = True, l2_available: bool = True, limits: Detection | None = None) -> DataFrame:
    """(page_id, url, html, level, error): the outcome for each page.

    One pass: a page that needs no rendered one has a key of its own that matches none, so it is spread like the others.
    """
    judged = evaluated(escalation(l0, limits).drop("assessment"), "escalate")
    level = lambda n: rendered.where(F.col("level") == n).select(F.col("page_id").alias(f"_p{n}"), F.col("html").alias(f"l{n}"))
    wanted = lambda n: F.when(F.col("escalate"), F.col("page_id")).otherwise(-1 - F.col("page_id")) == F.col(f"_p{n}")
    both = judged.join(level(1), wanted(1), "left").join(level(2), wanted(2), "left")
    at, error = _outcome(l1_available, l2_available)
    at = F.when(F.col("escalate"), at).otherwise(F.lit(0))
    html = F.when(at == 0, F.col("html")).when(at == 1, F.col("l1")).when(at == 2, F.col("l2"))
    return both.select("page_id", "url", html.alias("html"), at.cast("int").alias("level"), F.when(F.col("escalate"), error).alias("error"))


def _outcome(l1_available: bool, l2_available: bool) -> tuple[Column, Column]:
    fetched = F.col("html").isNotNull()
    if not l1_available:
        return F.when(fetched, F.lit(0)), F.when(~fetched, "l0 failed, no l1")
    l1_ok, l1_blocked = F.col("l1").isNotNull(), bot_signal(F.col("l1")) != ""
    l2_ok, l2_blocked = F.col("l2").isNotNull(), bot_signal(F.col("l2")) != ""
    error = F.when(~l1_ok & ~fetched, "l0 and l1 failed").when(~l1_ok, "l1 failed")
    error = error.when(l1_blocked & F.lit(not l2_available), "l1 blocked, no l2").when(l1_blocked & ~l2_ok, "l2 failed").when(l1_blocked & l2_blocked, "l2 blocked")
    level = F.when(error.isNotNull(), F.lit(None).cast("int")).when(l1_blocked, F.lit(2)).otherwise(F.lit(1))
    return level, error

"""Counters, histograms, rates and sampling over pipeline telemetry."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import level_name

# Bucket bounds in milliseconds.
BOUNDS = (5, 10, 25, 50, 75, 100, 250, 500, 750, 1000, 2500, 5000, 7500, 10000)


# The pipeline's counters, and its histograms (durations in milliseconds, and a length in bytes).
COUNTERS = ("search.requests", "scrape.attempts", "scrape.errors", "pii.entities", "pii.blocked", "injection.chunks", "injection.flagged", "injection.blocked", "rerank.requests", "pipeline.requests")
HISTOGRAMS = ("search.duration", "scrape.duration", "pii.duration", "injection.duration", "rerank.duration", "pipeline.duration", "content.length")


def pipeline_counters(ranked: DataFrame, requests: DataFrame) -> DataFrame:
    """(counter, level, total): the ten counters of requests and their documents (``engine.ranked_documents``), in one pass.

    Attempts are told by level; the others have no level.  Entities count for documents that aren't blocked for them, chunks also for blocked
    ones; a request is ranked once it has a document left.
    """
    tried, read = F.col("policy_step") == "pass", F.coalesce("scraped", F.lit(False))
    pii_blocked, inj_blocked = F.coalesce("pii_blocked", F.lit(False)), F.coalesce("inj_blocked", F.lit(False))
    screened = read & ~pii_blocked
    n = lambda condition, of=F.lit(1): F.sum(F.when(condition, of).otherwise(0)).cast("long")
    per = ranked.groupBy("request_id").agg(
        n(tried & (F.col("level") == 0)).alias("l0"), n(tried & (F.col("level") == 1)).alias("l1"), n(tried & (F.col("level") == 2)).alias("l2"), n(tried & F.col("level").isNull()).alias("l"),
        n(tried & ~read).alias("errors"), n(screened, F.col("entity_count")).alias("entities"), n(read & pii_blocked).alias("pii"),
        n(screened, F.col("chunk_count")).alias("chunks"), n(screened, F.col("over_count")).alias("flagged"), n(screened & inj_blocked).alias("inj"), F.max((screened & ~inj_blocked).cast("long")).alias("ranked"),
    )
    names = ["l0", "l1", "l2", "l", "errors", "entities", "pii", "chunks", "flagged", "inj", "ranked"]
    all_ = per.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).crossJoin(requests.agg(F.count("*").alias("requests")))  # a row each
    level = lambda k: level_name(F.lit(k).cast("int"))
    row = lambda name, value, of=None: F.struct(F.lit(name).alias("counter"), (F.lit("") if of is None else of).alias("level"), F.col(value).alias("total"))
    search, attempts, errors, entities, pii, chunks, flagged, inj, rerank, pipeline = COUNTERS
    rows = [row(search, "requests"), *[row(attempts, f"l{k}", level(k)) for k in range(3)], row(attempts, "l", F.lit("unknown")), row(errors, "errors"), row(entities, "entities"), row(pii, "pii"), row(chunks, "chunks"), row(flagged, "flagged"), row(inj, "inj"), row(rerank, "ranked"), row(pipeline, "requests")]
    return all_.select(F.inline(F.array(*rows)))


def exposition(counted: DataFrame) -> DataFrame:
    """(value): counters (counter, level, total) as lines of the text exposition format, summed up over all that was exported."""
    name = F.concat(F.replace("counter", F.lit("."), F.lit("_")), F.lit("_total"))
    per = counted.groupBy("counter", "level").agg(F.sum("total").alias("total"))
    label = F.when(F.col("level") == "", "").otherwise(F.concat(F.lit('{level="'), "level", F.lit('"}')))
    line = F.concat(name, label, F.lit(" "), F.col("total").cast("string"))
    lines = per.groupBy("counter").agg(F.array_sort(F.collect_list(line)).alias("lines"))  # a line a level
    return lines.orderBy("counter").select(F.concat(F.lit("# TYPE "), name, F.lit(" counter\n"), F.array_join("lines", "\n")).alias("value"))


# --- sketches: counts by buckets whose bounds grow by a factor, so that sums of sketches are sketches of sums


def _growth(accuracy: float) -> float:
    return (1 + accuracy) / (1 - accuracy)


def sketch(facts: DataFrame, value: str, *by: str, accuracy: float = 0.01) -> DataFrame:
    """(by..., bucket, n): a quantile sketch a group, whose values are off by ``accuracy`` of themselves at most.

    A bucket is a power of the growth factor that its values don't exceed; values of zero or less share the bucket null.  Null and
    non-finite values take no part.
    """
    x = F.col(value).cast("double")
    bucket = F.when(x > 0, F.ceil(F.ln(x) / math.log(_growth(accuracy))).cast("int"))
    return facts.where(F.abs(x) < F.lit(float("inf"))).groupBy(*by, bucket.alias("bucket")).agg(F.count("*").alias("n"))


def windowed_sketch(facts: DataFrame, value: str, *by: str, minutes: int = 5, time: str = "timestamp", accuracy: float = 0.01) -> DataFrame:
    """(window_start, by..., bucket, n): sketches of clock-aligned windows."""
    placed = facts.withColumn("window_start", F.window(F.col(time).cast("timestamp"), f"{minutes} minutes")["start"].cast("timestamp_ntz"))
    return sketch(placed, value, "window_start", *by, accuracy=accuracy)


def merged(sketches: DataFrame, *by: str) -> DataFrame:
    """Sketches of groups of sketches, exactly those of all their values."""
    return sketches.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, points: dict[str, float], *by: str, accuracy: float = 0.01) -> DataFrame:
    """(by..., n, a column a point): the value at rank floor(q (n - 1)).  A group has as many rows as its sketch has buckets: some thousands at most."""
    order = Window.partitionBy(*by).orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    rows = sketches.withColumn("_upto", F.sum("n").over(order)).withColumn("_all", F.sum("n").over(Window.partitionBy(*by)))
    g = _growth(accuracy)
    value = F.when(F.col("bucket").isNull(), F.lit(0.0)).otherwise(2 * F.pow(F.lit(g), F.col("bucket")) / (g + 1))
    at = lambda q: F.min(F.when(F.col("_upto") > F.floor(F.lit(q) * (F.col("_all") - 1)), value))
    return rows.groupBy(*by).agg(F.sum("n").alias("n"), *[at(q).alias(name) for name, q in points.items()])


def counters(facts: DataFrame, *labels: str) -> DataFrame:
    return facts.groupBy(*labels).agg(F.sum("value").alias("total"))


def histogram(facts: DataFrame, value: str, *labels: str) -> DataFrame:
    """Cumulative counts by bound, with count, sum and extremes."""
    buckets = [F.count_if(F.col(value) <= b).alias(f"le_{b}") for b in BOUNDS]
    return facts.groupBy(*labels).agg(*buckets, F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"))


def error_rate(log: DataFrame, minutes: int = 5) -> DataFrame:
    """Share of blocked rows in clock-aligned windows."""
    windowed = log.groupBy(F.window(F.col("timestamp").cast("timestamp"), f"{minutes} minutes").alias("w"))
    out = windowed.agg(F.count("*").alias("n"), F.count_if(F.col("pii_action") == "blocked").alias("errors"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", "errors", (F.col("errors") / F.col("n")).alias("error_rate"))


def sampled(rows: DataFrame, rate: float, key: str = "request_id") -> DataFrame:
    """Ratio sampling by a hash of the id, alike for all spans of a trace."""
    first = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    return rows.where(first < int(rate * (1 << 32)))


def observed(rows: DataFrame, name) -> DataFrame:
    """The same rows; a listener of this name, or this Observation, gets how many rows and URLs pass."""
    return rows.observe(name, F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("url").alias("urls"))

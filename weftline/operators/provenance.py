"""Provenance: hash chains, records, sinks, and the questions asked of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import level_name, sha256_hex, truncated_bytes

# The 22 columns in order; zero values are what a record without them has.
COLUMNS = {
    "request_id": "string", "timestamp": "timestamp", "url": "string", "final_url": "string", "http_status": "int", "content_type": "string",
    "scraper_level": "int", "raw_html_hash": "string", "extracted_hash": "string", "final_hash": "string", "content_length": "bigint", "extraction_method": "string",
    "pii_mode": "string", "pii_action": "string", "pii_entities_found": "int", "reranker_score": "double", "reranker_rank": "int",
    "robots_checked": "boolean", "robots_allowed": "boolean", "scrape_duration_ms": "bigint", "pii_duration_ms": "bigint", "total_duration_ms": "bigint",
}
_ZERO = {"string": "", "int": 0, "bigint": 0, "double": 0.0, "boolean": False}


def hash_chain(raw: Column, extracted: Column, final: Column) -> Column:
    return F.struct(sha256_hex(raw).alias("raw_hash"), sha256_hex(extracted).alias("extracted_hash"), sha256_hex(final).alias("final_hash"))


def records(ranked: DataFrame) -> DataFrame:
    """One record a delivered document, from columns request_id, timestamp, url, raw, markdown, scraper_level, pii_mode, score, rank; columns of the record that the input has are taken over."""
    final = truncated_bytes(F.col("markdown"))
    made = {
        "final_url": F.col("url"), "raw_html_hash": sha256_hex(F.col("raw")), "extracted_hash": sha256_hex(F.col("markdown")), "final_hash": sha256_hex(final),
        "content_length": F.octet_length(final), "extraction_method": level_name(F.col("scraper_level")), "reranker_score": F.col("score"), "reranker_rank": F.col("rank"),
    }
    out = []
    for name, kind in COLUMNS.items():
        value = F.col(name) if name in ranked.columns else made.get(name, F.lit("pass") if name == "pii_action" else F.lit(_ZERO.get(kind)))
        out.append(value.cast(kind).alias(name))
    return ranked.select(*out)


def tsv(rows: DataFrame) -> Column:
    """A record as a tab-separated line: milliseconds UTC, six decimals, tabs and line breaks escaped."""
    parts = []
    for name, kind in COLUMNS.items():
        c = F.col(name)
        if kind == "timestamp":
            value = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS")
        elif kind == "double":
            value = F.printf(F.lit("%.6f"), c)
        elif kind == "string":
            value = c
            for char, code in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n")):
                value = F.replace(value, F.lit(char), F.lit(code))
        else:
            value = c.cast("string")
        parts.append(F.coalesce(value, F.lit("")))
    return F.concat_ws("\t", *parts)


def write(rows: DataFrame, path: str, batch: int | None = None) -> None:
    """Appends records by date, sorted as they are asked for; a day is dealt to as many tasks as its rows need."""
    dated = rows.withColumn("date", F.to_date("timestamp")).hint("rebalance", "date").sortWithinPartitions("date", "timestamp", "request_id").write.partitionBy("date")
    if batch is None:
        dated.mode("append").parquet(path)
    else:
        dated.mode("overwrite").parquet(f"{path}/batch={batch}")  # a batch that is written again replaces itself


def by_request(log: DataFrame, request_id: str) -> DataFrame:
    return log.where(F.col("request_id") == request_id).orderBy("reranker_rank")


def urls_since(log: DataFrame, now: str, hours: int = 24, top: int = 100) -> DataFrame:
    """The most frequent URLs of the last hours: a top-k report."""
    clock = F.lit(now).cast("timestamp")
    recent = log.where((F.col("timestamp") > clock - F.expr(f"interval {hours} hours")) & (F.col("timestamp") <= clock))
    return recent.groupBy("url").agg(F.count("*").alias("fetches"), F.max("timestamp").alias("last_seen")).orderBy(F.desc("fetches"), "url").limit(top)


def versions(log: DataFrame) -> DataFrame:
    return log.groupBy("url").agg(F.count_distinct("raw_html_hash").alias("versions"), F.count("*").alias("fetches"))


def changes(log: DataFrame, order: str = "event_id") -> DataFrame:
    """Fetches whose page differs from the one before."""
    before = F.lag("raw_html_hash").over(Window.partitionBy("url").orderBy("timestamp", order))
    return log.withColumn("previous_hash", before).where("previous_hash is not null and previous_hash <> raw_html_hash")


def retained(log: DataFrame, now: str, days: int = 90) -> DataFrame:
    return log.where(F.col("timestamp") >= F.lit(now).cast("timestamp") - F.expr(f"interval {days} days"))


def join_audits(pii: DataFrame, injection: DataFrame) -> DataFrame:
    return pii.join(injection, ["request_id", "url"], "full_outer")

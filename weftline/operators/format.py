"""The delivered answer: blocks of results, sources and metadata, one text a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import displayed, quoted, truncated_bytes, two_decimals


def result_block(rank: Column, title: Column, url: Column, score_text: Column, markdown: Column) -> Column:
    return F.concat(F.lit("## "), rank.cast("string"), F.lit(". "), title, F.lit("\n**Source:** "), url, F.lit("\n**Relevance:** "), score_text, F.lit("\n\n"), markdown, F.lit("\n\n---\n\n"))


def format_results(ranked: DataFrame) -> DataFrame:
    """One row a request from (request_id, query, rank, title, url, score, markdown): blocks in order of rank, then sources."""
    rows = ranked.withColumn("block", result_block(F.col("rank"), F.col("title"), F.col("url"), two_decimals(F.col("score")), displayed(truncated_bytes(F.col("markdown")))))
    grouped = rows.groupBy("request_id").agg(F.first("query").alias("query"), F.array_sort(F.collect_list(F.struct("rank", "url", "block"))).alias("r"))
    body = F.array_join(F.transform("r", lambda x: x["block"]), "")
    sources = F.array_join(F.transform("r", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["url"], F.lit("\n"))), "")
    content = F.concat(F.lit("# Search Results for: "), quoted(F.col("query")), F.lit("\n\n"), body, F.lit("**Sources:**\n"), sources)
    return grouped.select("request_id", content.alias("content"), F.size("r").alias("n_results"))


def notes(pii_blocked: Column, inj_blocked: Column) -> Column:
    line = lambda n, what: F.when(n > 0, F.concat(F.lit("**Note:** "), n.cast("string"), F.lit(f" document(s) were blocked by {what} policy and excluded from results.\n\n"))).otherwise(F.lit(""))
    return F.concat(line(pii_blocked, "PII"), line(inj_blocked, "prompt-injection"))


def metadata(n: Column, pii_mode: str, pii_checked: Column, injection: Column, reranker: Column, engines: Column) -> Column:
    text = lambda b: F.when(b, "true").otherwise("false")
    return F.concat(
        F.lit("\n**Metadata:**\n- Results returned: "), n.cast("string"), F.lit(f"\n- PII: {pii_mode} (checked="), text(pii_checked), F.lit(")\n- Injection: "), injection,
        F.lit("\n- Reranker: "), reranker, F.lit("\n- Search engines: "), F.array_join(engines, ", "), F.lit("\n"),
    )

"""The whole pipeline over many requests at once: results to ranked, policy-checked, auditable text."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from ..config import Config
from ..functions.once import evaluated
from ..functions.tables import scratch, written
from ..functions.text import displayed, quoted, sha256_hex, truncated_bytes, two_decimals
from ..operators import extract, format as fmt, injection, pii, policy, provenance, rank, scrape, search


def ranked_documents(requests: DataFrame, results: DataFrame, robots: DataFrame, l0: DataFrame, rendered: DataFrame, config: Config = Config(), scorers=None) -> DataFrame:
    """One row a result, through every stage: those delivered are ready, with rank and score; the others keep what dropped them.

    requests: request_id, query, category, language, max_results.  results: as ``search.read_responses`` gives them.
    l0: page_id, url, html (null: failed); of several pages of a URL, that with the smallest id counts.  rendered: page_id, url,
    level, html.  Stages that a setting turns off are not in the plan.
    """
    asked = search.request_defaults(requests, config)
    merged = search.merge_duplicates(search.trim_responses(results, config.search.max_results)).drop("category")
    pool = merged.join(asked.select("request_id", "query", F.col("max_results").alias("wanted")), "request_id")
    limited = search.limit_results(pool, F.col("wanted"))
    stepped = policy.funnel(limited, robots, config.policy)
    light = stepped.select("request_id", "position", "query", "url", F.col("title").alias("result_title"), "policy_step", "robots_checked", "robots_allowed")
    rows = written(light, scratch(requests.sparkSession), "policy")  # used twice, and small beside the pages

    # rows that a stage drops stay, without content, so that one pass gives results and counts
    asked_for = rows.where("policy_step = 'pass'").select(F.col("url").alias("_url")).distinct()
    visited = l0.join(asked_for, F.col("url") == F.col("_url"), "left_semi")  # no other page is judged
    judged = scrape.merge_levels(scrape.read_pages(visited), rendered, limits=config.detection)
    first = F.min(F.struct(F.col("page_id").isNull(), "page_id", F.col("error").isNotNull(), "level", "html", "error")).alias("p")
    pages = judged.groupBy(F.col("url").alias("_url")).agg(first).select("_url", "p.html", "p.level", "p.error")  # dealt like the join
    fetched = rows.join(pages, (F.col("url") == F.col("_url")) & (F.col("policy_step") == "pass"), "left").drop("_url")
    fetched = fetched.withColumn("html", F.when(F.col("error").isNull(), F.col("html")))
    read = extract.extract_articles(fetched.withColumn("raw_html_hash", sha256_hex(F.col("html")))).drop("excerpt", "site", "text")
    read = read.withColumn("title", F.when(F.col("title") == "", F.col("result_title")).otherwise(F.col("title"))).drop("result_title")
    read = read.withColumn("content", F.nullif("markdown", F.lit(""))).withColumn("extracted_hash", sha256_hex(F.col("markdown"))).drop("markdown").withColumn("scraped", F.col("content").isNotNull())

    checked = pii.process(read, config.pii).drop("entities", "pii_audit")
    checked = checked.withColumn("content", F.when(~F.coalesce("pii_blocked", F.lit(False)), F.col("content")))
    scanned = injection.process(checked, config.injection)
    ready = F.col("scraped") & ~F.coalesce("pii_blocked", F.lit(False)) & ~F.col("inj_blocked")
    scanned = evaluated(scanned.withColumn("ready", ready).withColumn("idx", F.col("position")), "ready", "content")
    return rank.rerank(scanned, config.rerank, scorers, ready="ready")


def web_search(requests: DataFrame, results: DataFrame, robots: DataFrame, l0: DataFrame, rendered: DataFrame, config: Config = Config(), scorers=None) -> DataFrame:
    """One row a request: status, content, results and counts.  What would end a single request early becomes its status here."""
    ranked = ranked_documents(requests, results, robots, l0, rendered, config, scorers)
    return answers(ranked, requests, results, config)


def answers(ranked: DataFrame, requests: DataFrame, results: DataFrame, config: Config = Config()) -> DataFrame:
    """The delivered answers of ``ranked_documents``."""
    asked = search.request_defaults(requests, config)
    delivered = truncated_bytes(F.col("content"))
    block = fmt.result_block(F.col("rank"), F.col("title"), F.col("url"), two_decimals(F.col("score")), displayed(delivered))
    item = F.struct("rank", "url", "title", "score", F.col("level").alias("scraper_level"), F.sha2(delivered, 256).alias("content_hash"), F.col("inj_action").alias("injection_action"), F.col("max_score").alias("injection_max_score"), block.alias("block"))
    step = lambda s: F.count_if(F.col("policy_step") == s)
    per = ranked.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("ready"), item))).alias("r"), F.first("reranker", ignorenulls=True).alias("reranker"),
        step("domain").alias("domain_dropped"), step("robots").alias("robots_blocked"), step("rate").alias("rate_limited"), step("pass").alias("results_after"),
        F.count_if("scraped").alias("scraped"), F.count_if(F.col("scraped") & F.col("pii_blocked")).alias("pii_blocked_n"), F.bool_or(F.col("scraped") & F.col("pii_checked")).alias("any_pii"),
        F.count_if(F.col("scraped") & F.col("inj_blocked")).alias("inj_blocked_n"), F.bool_or(F.col("scraped") & F.col("inj_checked")).alias("any_inj"),
    )
    found = results.groupBy("request_id").agg(F.count("*").alias("found"))
    out = asked.select("request_id", "query", "category").join(found, "request_id", "left").join(evaluated(per, "r"), "request_id", "left")
    n = F.coalesce(F.size("r"), F.lit(0))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    status = F.when(count("found") == 0, "no_results").when(count("results_after") == 0, "all_policy_filtered").when(count("scraped") == 0, "all_failed")
    status = status.when(count("pii_blocked_n") >= count("scraped"), "all_pii_blocked").when(n == 0, "all_injection_blocked").otherwise("ok")
    sources = F.array_join(F.transform("r", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["url"], F.lit("\n"))), "")
    inj_status = F.lit("disabled") if not config.injection.enabled else F.concat(F.lit(f"{config.injection.mode} (checked="), flag("any_inj").cast("string"), F.lit(", blocked="), count("inj_blocked_n").cast("string"), F.lit(")"))
    content = F.concat(
        F.lit("# Search Results for: "), quoted(F.col("query")), F.lit("\n\n"), F.array_join(F.transform("r", lambda x: x["block"]), ""),
        fmt.notes(count("pii_blocked_n"), count("inj_blocked_n")), F.lit("**Sources:**\n"), sources,
        fmt.metadata(n, config.pii.mode, flag("any_pii"), inj_status, F.coalesce("reranker", F.lit("none")), search.engine_route(F.col("category"), config.search)),
    )
    metas = F.transform("r", lambda x: F.struct(*[x[f].alias(f) for f in ("url", "title", "score", "scraper_level", "content_hash", "injection_action", "injection_max_score")]))
    return out.select(
        "request_id", "query", status.alias("status"), F.when(status == "ok", content).alias("content"), metas.alias("results"), n.alias("n_results"),
        *[count(c).alias(c) for c in ("domain_dropped", "robots_blocked", "rate_limited", "results_after", "scraped", "pii_blocked_n", "inj_blocked_n")],
    )


def provenance_of(ranked: DataFrame, request_time: str, config: Config = Config()) -> DataFrame:
    """A provenance record for each delivered document of ``ranked_documents``."""
    final = truncated_bytes(F.col("content"))
    known = {
        "timestamp": F.lit(request_time).cast("timestamp"), "scraper_level": F.col("level"), "final_hash": sha256_hex(final), "content_length": F.octet_length(final),
        "pii_entities_found": F.col("entity_count"), "robots_checked": F.col("robots_checked"), "robots_allowed": F.col("robots_allowed"), "raw": F.lit(None).cast("string"), "markdown": F.col("content"),
    }
    return provenance.records(ranked.where("ready").withColumns(known))


def searching(config: Config = Config(), **sections) -> Config:
    """Settings with some sections replaced."""
    return replace(config, **sections)

"""Which results may be visited: domains, robots rules, rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import Policy
from ..functions.urls import host_matches, host_suffixes, url_host
from .quota import anchored_quota
from .robots import with_robots

__all__ = ["allow_domains", "anchored_quota", "block_domains", "domain_allowed", "funnel", "funnel_counts", "request_quota", "with_robots"]


def domain_allowed(url: Column, policy: Policy) -> Column:
    """Blocklist: no match may be; allowlist: a match must be.  A URL without host is let through."""
    host = url_host(url)
    if policy.domain_mode == "allowlist":
        return (host == "") | host_matches(host, list(policy.allowlist))
    return (host == "") | ~host_matches(host, list(policy.blocklist))


def block_domains(results: DataFrame, domains: DataFrame) -> DataFrame:
    """Anti-join with a table of domains (domain), for lists too long to be literals; host suffixes make it an equi-join."""
    return _by_domain(results, domains, "left_anti")


def allow_domains(results: DataFrame, domains: DataFrame) -> DataFrame:
    """Semi-join with a table of domains; rows without host stay."""
    return _by_domain(results, domains, "left_semi")


def _by_domain(results: DataFrame, domains: DataFrame, how: str) -> DataFrame:
    listed = domains.select(F.lower(F.trim("domain")).alias("_suffix")).where("_suffix <> ''").distinct()
    hosts = results.select(url_host(F.col("url")).alias("_host")).where("_host <> ''").distinct()
    hits = hosts.withColumn("_suffix", F.explode(host_suffixes(F.col("_host")))).join(listed, "_suffix", "left_semi").select("_host").distinct()
    keyed = results.withColumn("_h", url_host(F.col("url")))
    if how == "left_anti":
        return keyed.join(hits, F.col("_h") == F.col("_host"), "left_anti").drop("_h")
    return keyed.join(hits, F.col("_h") == F.col("_host"), "left").where("_host is not null or _h = ''").drop("_h", "_host")


def request_quota(results: DataFrame, per_minute: int) -> DataFrame:
    """Adds rate_allowed for one batch with full buckets: the first ``per_minute`` rows of each request and host."""
    rank = F.row_number().over(Window.partitionBy("request_id", url_host(F.col("url"))).orderBy("position"))
    return results.withColumn("rate_allowed", (url_host(F.col("url")) == "") | (rank <= per_minute))


def funnel(results: DataFrame, robots: DataFrame, policy: Policy) -> DataFrame:
    """Adds policy_step: domain, robots, rate or pass.  Each step sees what the one before let through; nothing is backfilled."""
    marked = with_robots(results, robots, policy).withColumn("_domain_ok", domain_allowed(F.col("url"), policy))
    left = F.col("_domain_ok") & (F.col("robots_allowed") if policy.robots_enabled else F.lit(True))
    host = url_host(F.col("url"))
    rank = F.row_number().over(Window.partitionBy("request_id", host, left).orderBy("position"))
    rate_ok = (host == "") | (rank <= policy.requests_per_minute) if policy.rate_limit_enabled else F.lit(True)
    step = F.when(~F.col("_domain_ok"), "domain").when(~left, "robots").when(~rate_ok, "rate").otherwise("pass")
    return marked.withColumn("policy_step", step).drop("_domain_ok")


def funnel_counts(stepped: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("policy_step") == s)
    return stepped.groupBy("request_id").agg(count("domain").alias("domain_dropped"), count("robots").alias("robots_blocked"), count("rate").alias("rate_limited"), count("pass").alias("results_after"))

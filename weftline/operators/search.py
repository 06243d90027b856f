"""From a request to a merged list of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import Config, Search
from ..functions.urls import normalize_url, query_escape

RESPONSE = "query string, results array<struct<url: string, title: string, content: string, engine: string, engines: array<string>, score: double, category: string>>, suggestions array<string>, number_of_results int"


def request_defaults(requests: DataFrame, config: Config = Config()) -> DataFrame:
    """Empty category and language get their defaults; max_results is set and clamped."""
    limit = F.when(F.col("max_results") <= 0, F.lit(config.default_results)).otherwise(F.least(F.col("max_results"), F.lit(config.max_results)))
    return requests.withColumns({"category": or_default(F.col("category"), "general"), "language": or_default(F.col("language"), config.search.default_language), "max_results": F.coalesce(limit, F.lit(config.default_results))})


def or_default(text: Column, value: str) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(value))


def engine_route(category: Column, search: Search = Search()) -> Column:
    """Engines of a category; those of no category, or of an unknown one, are the defaults."""
    out = F.array(*[F.lit(e) for e in search.default_engines])
    key = or_default(category, "general")
    for name, engines in search.engine_routes.items():
        out = F.when(key == name, F.array(*[F.lit(e) for e in engines])).otherwise(out)
    return out


def request_url(query: Column, engines: Column, categories: Column, language: Column, time_range: Column, page_no: Column, search: Search = Search()) -> Column:
    """The metasearch request; parameters lie in order of their names."""
    pair = lambda k, v: F.concat(F.lit(f"{k}="), query_escape(v))
    joined = lambda a: F.array_join(a, ",")
    parts = [
        F.when(F.size(categories) > 0, pair("categories", joined(categories))),
        F.when(F.size(engines) > 0, pair("engines", joined(engines))),
        F.lit("format=json"),
        pair("language", or_default(language, search.default_language)),
        F.concat(F.lit("pageno="), F.greatest(F.coalesce(page_no, F.lit(1)), F.lit(1)).cast("string")),
        pair("q", F.coalesce(query, F.lit(""))),
        F.lit(f"safesearch={search.safe_search}"),
        F.when(F.coalesce(time_range, F.lit("")) != "", pair("time_range", time_range)),
    ]
    return F.concat(F.lit(f"{search.base_url}/search?"), F.concat_ws("&", *parts))


def read_responses(responses: DataFrame, column: str = "body") -> DataFrame:
    """Captured JSON responses as result rows with positions; missing values become empty ones."""
    parsed = responses.withColumn("_r", F.from_json(column, RESPONSE)).select("request_id", F.posexplode("_r.results").alias("_p", "_x"))
    text = lambda c: F.coalesce(F.col(f"_x.{c}"), F.lit("")).alias(c)
    return parsed.select("request_id", (F.col("_p") + 1).cast("int").alias("position"), text("url"), text("title"), F.coalesce("_x.content", F.lit("")).alias("snippet"), text("engine"), F.coalesce("_x.engines", F.array().cast("array<string>")).alias("engines"), F.coalesce("_x.score", F.lit(0.0)).alias("score"), text("category"))


def trim_responses(results: DataFrame, limit: int = Search.max_results) -> DataFrame:
    """The first results of each request, before merging."""
    return results.where(F.col("position") <= (limit if limit > 0 else Search.max_results))


def engine_union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def merge_duplicates(results: DataFrame) -> DataFrame:
    """One row for each canonical URL of a request, placed where its first result was.

    A single shuffle by (request, URL); the longest snippet counts bytes, the earliest wins ties, and
    engines are merged and sorted only where there was a duplicate.
    """
    keyed = results.withColumn("norm_url", normalize_url(F.col("url")))
    first = F.min_by(F.struct("url", "title", "engine", "engines", "category", "position"), "position")
    snippet = F.max_by("snippet", F.struct(F.octet_length("snippet"), -F.col("position")))
    engines = F.array_sort(F.array_distinct(F.flatten(F.collect_list("engines"))))
    merged = keyed.groupBy("request_id", "norm_url").agg(first.alias("f"), F.max("score").alias("score"), snippet.alias("snippet"), engines.alias("all"), F.count("*").alias("n_merged"))
    place = F.row_number().over(Window.partitionBy("request_id").orderBy("f.position"))
    engines = F.when(F.col("n_merged") > 1, F.col("all")).otherwise(F.col("f.engines"))
    return merged.select("request_id", place.alias("position"), "f.url", "norm_url", "f.title", "snippet", "f.engine", engines.alias("engines"), "score", "f.category", "n_merged")


def limit_results(results: DataFrame, limit: Column | int) -> DataFrame:
    """The first ``limit`` rows of each request by position, before any policy."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy("position"))
    return results.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")

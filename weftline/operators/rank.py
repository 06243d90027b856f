"""Ranking: scores onto documents, order, top k, and what happens without scores."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType

from ..config import Rerank
from ..functions.models import halved
from ..functions.text import quoted

PROMPT_BYTES = 2000
_NUMBERS = r"^\[\s*(?:(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|null)(?:\s*,\s*(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|null))*)?\s*\]$"


def fallback_score(position: Column) -> Column:
    """1.00, 0.99, ... by 0-based position."""
    return F.lit(1.0) - position * F.lit(0.01)


def rerank_none(docs: DataFrame, position: str = "position") -> DataFrame:
    """Original order; no top k."""
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy(position))
    return docs.withColumn("rank", rank).withColumn("score", fallback_score(F.col("rank") - 1))


def join_scores(docs: DataFrame, scores: DataFrame) -> DataFrame:
    """By index; scores without document and documents without score are dropped."""
    return docs.join(scores, ["request_id", "idx"])


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """1-based rank by score, ties by idx; the first ``k`` if k > 0."""
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("score"), "idx"))
    ranked = scored.withColumn("rank", rank)
    return ranked.where(F.col("rank") <= k) if k > 0 else ranked


def zip_scores(scores: Column, count: Column) -> Column:
    """(idx, score) pairs, or null where the lengths differ."""
    pairs = F.transform(scores, lambda s, i: F.struct(i.cast("int").alias("idx"), s.alias("score")))
    return F.when(F.size(scores) == count, pairs)


def parse_scores(text: Column, count: Column) -> Column:
    """Scores from a model's answer: what lies from the first ``[`` to the last ``]``, clamped; null if malformed."""
    found = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    values = F.from_json(F.when(found.rlike(_NUMBERS), found), "array<double>")
    clamped = F.transform(values, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(0.0)))))
    return F.when(F.size(values) == count, clamped)


def prompt(query: Column, documents: Column) -> Column:
    """The scoring prompt; documents are cut at 2,000 bytes."""
    cut = lambda d: F.when(F.octet_length(d) > PROMPT_BYTES, F.concat(F.make_valid_utf8(F.substring(F.encode(d, "UTF-8"), 1, PROMPT_BYTES).cast("string")), F.lit("..."))).otherwise(d)
    lines = F.array_join(F.transform(documents, lambda d, i: F.concat(F.lit("Document "), (i + 1).cast("string"), F.lit(": "), cut(d), F.lit("\n"))), "")
    # The prompt's wording.
    head = F.concat(F.lit("Given the query: "), quoted(query), F.lit("\n\nScore the relevance of each document on a scale of 0.0 to 1.0.\nRespond ONLY with a JSON array of scores in the same order as the documents.\n\n"))
    return F.concat(head, lines, F.lit("\nResponse format: [0.95, 0.23, 0.87]"))


def lexical_score(query: Column, text: Column) -> Column:
    """An addition: the share of distinct query words that the text holds."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    asked = words(query)
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, words(text))) / F.size(asked)).otherwise(F.lit(0.0))


def with_fallback(docs: DataFrame, k: int, name: str, score: str = "score", ready: str | None = None) -> DataFrame:
    """Requests of which any score is null fall back to the original order; others are ranked, top k.

    Where a column ``ready`` is named, no row is cut: rows without it pass by, ranked apart, and those beyond the top k lose it.
    """
    per = Window.partitionBy("request_id", *([ready] if ready else []))
    failed = F.max(F.col(score).isNull().cast("int")).over(per) == 1
    rows = docs.withColumn("_failed", failed)
    place = F.row_number().over(per.orderBy("idx"))
    rows = rows.withColumn("_place", place)
    rows = rows.withColumn("score", F.when(F.col("_failed"), fallback_score(F.col("_place") - 1)).otherwise(F.col(score)))
    rows = rows.withColumn("rank", F.row_number().over(per.orderBy(F.when(F.col("_failed"), F.col("_place")), F.desc("score"), "idx")))
    rows = rows.withColumn("reranker", F.when(F.col("_failed"), "none (fallback)").otherwise(name))
    within = F.col("_failed") | F.lit(k <= 0) | (F.col("rank") <= k)
    rows = rows.withColumn(ready, F.col(ready) & within) if ready else rows.where(within)
    return rows.drop("_failed", "_place")


def rerank(docs: DataFrame, config: Rerank = Rerank(), scorers: dict[str, Callable[[DataFrame], DataFrame]] | None = None, ready: str | None = None) -> DataFrame:
    """Ranks documents (request_id, idx, ...) by the configured provider; a provider is a function that adds score.

    Where a column ``ready`` is named, only rows with it are ranked, and the others stay, in one pass.
    """
    if config.provider in ("none", ""):
        place = F.row_number().over(Window.partitionBy("request_id", *([ready] if ready else [])).orderBy("idx"))
        return docs.withColumn("rank", place).withColumn("score", fallback_score(F.col("rank") - 1)).withColumn("reranker", F.lit("none"))
    if not scorers or config.provider not in scorers:
        raise ValueError(f"no scorer for provider {config.provider!r}")
    return with_fallback(scorers[config.provider](docs), config.top_k, config.provider, ready=ready)


def lexical_provider(docs: DataFrame) -> DataFrame:
    """The built-in provider: scores by query words in title and content; a stand-in for a model."""
    return docs.withColumn("score", lexical_score(F.col("query"), F.concat_ws(" ", "title", "content")))


def prompted_provider(answer: Callable[[Column], Column]) -> Callable[[DataFrame], DataFrame]:
    """A provider that asks a model: one prompt a request, ``answer`` (prompt -> text column) replies, and its scores go back by place.

    A malformed answer gives null scores, on which the request falls back to the original order.
    """

    def score(docs: DataFrame) -> DataFrame:
        ready = docs.where(F.col("content").isNotNull())
        per = ready.groupBy("request_id").agg(F.first("query").alias("q"), F.array_sort(F.collect_list(F.struct("idx", "content"))).alias("d"))
        told = per.select("request_id", "d", parse_scores(answer(prompt(F.col("q"), F.transform("d", lambda x: x["content"]))), F.size("d")).alias("s"))
        pairs = F.arrays_zip(F.transform("d", lambda x: x["idx"]).alias("idx"), F.col("s").alias("score"))
        scores = told.where(F.col("s").isNotNull()).select("request_id", F.inline(pairs)).toDF("request_id", "idx", "score")
        return docs.join(scores, ["request_id", "idx"], "left")

    return score


def tensor_provider(make: Callable[[], Callable[[list[str], list[str]], list[float]]], batch: int = 64) -> Callable[[DataFrame], DataFrame]:
    """A provider that asks a model for pairs: ``make`` loads it once a worker, and it takes queries and passages of one length and gives scores by place.

    Pairs of many requests make a batch, and no row moves.  Where the model raises, gives another number of scores or one that isn't a
    number, the batch is halved; a pair that fails has no score, on which its request falls back to the original order.
    """

    def load() -> Callable:
        model = make()

        def scored(pairs: list[tuple[str, str]]) -> list[float]:
            scores = [float(s) for s in model([q for q, _ in pairs], [p for _, p in pairs])]
            if not all(math.isfinite(s) for s in scores):
                raise ValueError("a score is not a number")
            return scores

        def predict(queries: np.ndarray, passages: np.ndarray) -> np.ndarray:
            found = halved(scored, [(str(q), str(p)) for q, p in zip(queries, passages, strict=True)])
            return np.array([math.nan if s is None else s for s in found], float)

        return predict

    def score(docs: DataFrame) -> DataFrame:
        ask = predict_batch_udf(load, return_type=DoubleType(), batch_size=batch)
        asked = docs.withColumn("_s", ask(F.coalesce("query", F.lit("")), F.coalesce("content", F.lit(""))))
        return asked.withColumn("score", F.when(~F.isnan("_s") & F.col("content").isNotNull(), F.col("_s"))).drop("_s")

    return score

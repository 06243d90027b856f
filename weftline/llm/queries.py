"""Queries of this package and their SQL; registered by the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import fim, katz, media, mixing, neardup, negatives, packing, quality, sharding, simhash, substring, tokens, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_report(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_report(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited copies of every hundredth raster (crops, turns, scales, noise, blur), searched among all rasters of ``embeddings``."""
    images = media.rasters(table(spark, sf_dir, "embeddings"))
    return media.matches(images, media.edited(images.where(F.col("id") % 100 == 0)))


def op9_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector of ``embeddings`` as an anchor; every seventh row's label is moved on, components are whole 256ths."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double")).alias("vector"),
    )
    return negatives.hard_negatives(rows, F.col("id") % 100 == 0)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.report(table(spark, sf_dir, "documents"))


def op13_simhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_histogram_sharding": op2_histogram_sharding,
        "op3_toxicity": op3_toxicity,
        "op4_source_mixing": op4_source_mixing,
        "op5_token_counts": op5_token_counts,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_image_copies": op8_image_copies,
        "op9_katz_scores": op9_katz_scores,
        "op10_near_duplicates": op10_near_duplicates,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_simhash_duplicates": op13_simhash_duplicates,
    }


_WORDS = "list_filter(string_split_regex(coalesce({t}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

SUBSTRING_SQL = f"""
WITH w AS (SELECT doc_id, {_WORDS.format(t="text")} AS ws FROM documents),
p AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 18), lambda s: struct_pack(s := s, t := array_to_string(ws[s:s + 19], ' ')))) AS x FROM w WHERE len(ws) >= 20),
k AS (SELECT doc_id, x.s AS s, row_number() OVER (PARTITION BY x.t ORDER BY doc_id, x.s) AS n FROM p),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM k WHERE n > 1),
each AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""

NEAR_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(t="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.b, w.doc_id)) AS component_id, w.doc_id <= coalesce(m.b, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = w.doc_id"""

NEGATIVES_SQL = """
WITH v AS (SELECT vec_id AS i, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.i AS a, b.i AS b, a.l = b.l AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS s FROM v a JOIN v b ON a.i % 100 = 0 AND a.i <> b.i),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
n AS (SELECT p.a, p.b AS p, p.s AS ps, s.b AS n, s.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS r
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.s <= 100 * s.s AND s.s <= p.s)
SELECT a AS anchor_id, p AS positive_id, CAST(r AS INT) AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE r <= 5"""

MIDDLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
d AS (SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
x AS (SELECT *, array_to_string(u[1:i], '') AS p, array_to_string(u[i + 1:j], '') AS m, array_to_string(u[j + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM x"""


def oracle_sql() -> dict[str, str]:
    """For the exact operators; learnt models, tokenizers and plans have no SQL form, and tests/llm has brute-force versions."""
    return {"op6_substring_dedup": SUBSTRING_SQL, "op10_near_duplicates": NEAR_SQL, "op11_hard_negatives": NEGATIVES_SQL, "op12_fill_in_middle": MIDDLE_SQL}

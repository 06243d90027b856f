"""The corpus pipeline's stages one after the other, against brute force where one exists."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tests.llm.test_operators import brute_near, brute_substring


def test_pipeline(spark, sf_dir, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs)
        assert name == "packing" or docs.columns == columns
    before, after = seen["toxicity"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    clean = labels.where("toxic = 0").join(before, "doc_id", "left_semi")
    assert clean.join(after, "doc_id", "left_anti").count() <= 0.1 * clean.count()
    before, after = seen["near_duplicates"]
    want = {i for i, (_, c) in brute_near([(r.doc_id, r.text) for r in before.collect()], 5).items() if i == c}
    assert {r.doc_id for r in after.collect()} == want
    before, after = seen["substrings"]
    words = {i: n - lost for i, (n, lost, _) in brute_substring([(r.doc_id, r.text) for r in before.collect()]).items()}
    assert {r.doc_id: len((r.text or "").encode().split()) for r in after.collect()} == {i: n for i, n in words.items() if n}
    before, after = seen["mixing"]
    size = lambda df: df.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert abs(size(after) - 1.5 * size(before)) <= 20
    packed = seen["packing"][1]
    assert packed.where("piece = 0").count() == after.count()
    total, sequences = packed.agg(F.sum("length"), F.count_distinct("sequence_id")).first()
    assert sequences <= math.ceil(total / 2048) * 1.1 + 2
    assert corpus_pipeline.run(spark, sf_dir).count() == packed.count()

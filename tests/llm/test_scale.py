"""Frequent rows and keys are spread, jobs don't grow with copies, and odd rows have the values that docstrings tell."""

from __future__ import annotations

import collections
import zlib

import corpus_pipeline
from pyspark.sql import functions as F

from weftline.llm import fim, katz, mixing, neardup, packing, quality, sharding, simhash, substring, tokens, toxicity
from weftline.llm._arrow import tokenizer_path

from .test_operators import SCHEMA, brute_near, check_shards, empty, labelled, odd, split  # noqa: F401


def test_cuts_within_many_groups_take_few_jobs(spark, monkeypatch):
    """80 texts of 100 copies in small parts: cuts fall on many hashes, which are divided in the same jobs."""
    calls = []
    count = sharding._count_bins
    monkeypatch.setattr(sharding, "_count_bins", lambda *a: calls.append(1) or count(*a))
    docs = spark.createDataFrame([(i, f"text {i % 80:03d} " * 4) for i in range(8000)], "doc_id long, text string").repartition(4)
    got = sharding.shard(docs, part_bytes=1000).collect()
    assert len(calls) <= 10
    assert len({r.doc_id for r in got}) == 8000
    check_shards(got, 16, 2 * 0.002 * sum(r.size for r in got) / 16 + 2 * 37)


def test_mix_of_a_frequent_row_is_spread(spark):
    """20,000 equal rows, whole passes and the row that the target cuts: all tasks of their shard get some."""
    docs = spark.createDataFrame([(1, "one two three", "a")] * 20_000 + [(k, "four five six seven", "b") for k in range(2, 40)], "doc_id long, text string, source string").repartition(4)
    mixed = mixing.sharded_mix(docs, salts=4).withColumn("task", F.spark_partition_id())
    per = mixed.where("source = 'a'").groupBy("shard", "task").agg(F.count("*").alias("n"), F.sum(F.size(F.split("text", " "))).alias("words")).collect()
    report = mixing.mixing_report(docs).where("size = 3").agg(F.sum("taken"), F.max("taken")).first()
    assert sum(r.words for r in per) == report[0] and report[1] <= 6
    assert len({r["shard"] for r in per}) == 1 and len(per) == 4 and max(r.n for r in per) < 0.5 * sum(r.n for r in per)
    assert mixed.columns == ["doc_id", "text", "source", "shard", "task"]


def test_an_id_with_two_texts_keeps_both(spark):
    long = " ".join(f"w{k}" for k in range(60))
    other = " ".join(f"v{k}" for k in range(60))
    docs = spark.createDataFrame([(1, long), (1, other), (1, long), (2, long + " more"), (3, None), (3, "")], "doc_id long, text string")
    left = sorted(((r.doc_id, r.text) for r in neardup.deduplicate(docs).collect()), key=str)
    assert left == sorted([(1, long), (1, other), (3, None), (3, "")], key=str)


def test_frequent_classes_are_joined_apart(spark):
    """Copies, empty texts and texts of their own, many more than a thousandth of all: components as by definition."""
    same, near = " ".join(f"w{k}" for k in range(80)), " ".join(f"w{k}" for k in range(1, 81))
    rows = [(i, [same, near, "", None, f"alone {i} " * 5][i % 5]) for i in range(2500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    assert got == {i: (0 if t in (same, near) else i) for i, t in rows}
    prints = {r.doc_id: r.component_id for r in simhash.simhash_duplicates(docs).collect()}
    assert {prints[i] for i, t in rows if t == ""} == {prints[i] for i, t in rows if t is None} == {2}


# --- values of odd rows


def _texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_odd_rows_have_their_values(spark, odd):  # noqa: F811
    import tokenizers

    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (None, 0, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    data = _texts(odd)
    count = lambda rows: collections.Counter(rows)
    words = {i: len(split(t)) for i, t in data}
    byte, word = (tokenizers.Tokenizer.from_file(tokenizer_path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    ids = {t: len(byte.encode(t or "", add_special_tokens=False).ids) for _, t in data}

    got = quality.quality_rules(odd, labels).collect()
    assert count((r.doc_id, r.n_words, r.base_failed) for r in got) == count((i, words[i], True) for i, _ in data)
    got = sharding.shard(odd).collect()
    assert count((r.doc_id, r["size"], r.text_crc32) for r in got) == count((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in data)
    got = toxicity.toxicity(odd, labels).collect()
    assert count((r.doc_id, r.held_out) for r in got) == count((i, zlib.crc32(str(i).encode()) % 3 == 1 if i is not None else r_held(got, i)) for i, _ in data) and all(0 <= r.score <= 1 for r in got)
    got = mixing.mixing_report(odd).collect()
    assert count((r.doc_id, r["size"]) for r in got) == count((i, words[i]) for i, _ in data) and all(r.taken <= 2 * r["size"] for r in got)
    got = tokens.count_tokens(odd).collect()
    assert count((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == count((i, len((t or "").encode()), ids[t], ids[t] > 1024) for i, t in data)
    got = substring.substring_report(odd).collect()
    assert count((r.doc_id, r.n_words) for r in got) == count((i, words[i]) for i, _ in data)
    pieces = collections.Counter()
    for r in packing.pack(odd).collect():
        pieces[r.doc_id] += r.length
    lengths = collections.Counter()
    for i, t in data:
        lengths[i] += len(word.encode(t or "", add_special_tokens=False).ids) + 1
    assert pieces == lengths
    got = katz.katz_scores(odd).collect()
    assert count((r.doc_id, r.n_tokens) for r in got) == count((i, words[i] + 1) for i, _ in data) and all(r.score < 0 for r in got)
    near = brute_near([(i, t) for i, t in data if i is not None])
    got = neardup.near_duplicates(odd).collect()
    assert count((r.doc_id, r.component_id) for r in got) == count((i, near[i][1] if i is not None else None) for i, _ in data)
    assert sorted((r.doc_id or 0) for r in fim.report(odd).collect()) == sorted((i or 0) for i, _ in data)


def r_held(rows, doc_id):
    return next(r.held_out for r in rows if r.doc_id == doc_id)


def test_stages_pass_odd_rows(spark, odd, empty, labelled, tmp_path):  # noqa: F811
    """All stages keep columns, values of other columns and clean texts; empty tables stay empty."""
    docs, labels = labelled
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    texts = count_texts(odd)
    clean = corpus_pipeline.reject_toxic(spark, odd.unionByName(docs, allowMissingColumns=True), str(tmp_path))
    assert clean.columns == odd.columns[:3] + [c for c in clean.columns if c not in odd.columns[:3]] and set(odd.columns) <= set(clean.columns)
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        got = stage(spark, odd, str(tmp_path))
        assert got.columns == odd.columns, name
        rows = got.collect()
        assert {r["group"] for r in rows} == {"clash"} and {r["size"] for r in rows} <= {1, 2, 3, 4}
        assert stage(spark, empty, str(tmp_path)).count() == 0
    whole = sharding.sharded(odd)
    assert collections.Counter((r.doc_id, r.text) for r in whole.collect()) == texts
    packed = corpus_pipeline.pack_sequences(spark, odd, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {1, 2, 3, None} and all(r.length <= 2048 for r in packed)
    assert corpus_pipeline.pack_sequences(spark, empty, str(tmp_path)).count() == 0
    assert corpus_pipeline.reject_toxic(spark, empty, str(tmp_path)).count() == 0


def count_texts(df):
    return collections.Counter(_texts(df))

"""The ten operators against brute force, round trips and held-out accuracy, and on odd inputs."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import _arrow, components, katz, media, mixing, neardup, packing, quality, sharding, substring, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def split(text):
    return [w for w in SPACE.split(text or "") if w]


def corpus(seed=5, n=120):
    """Texts with exact and near copies, shared passages, repeated lines, odd spaces, nulls, blanks and ties."""
    r = random.Random(seed)
    vocabulary = [f"{r.choice('bdgklmnprst')}{r.choice('aeiou')}{r.choice('lmnrst')}{k % 97}" for k in range(400)] + ["é", "Ünï", "don't", "x y", "<|endoftext|>"]
    passage = [r.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.choice([1, 3, 5, 40, 90, 200]))]
        if i % 5 == 0:
            at = r.randrange(len(words) + 1)
            words[at:at] = passage[r.randrange(10) : 60 - r.randrange(10)]
        if i % 6 == 1 and rows:
            words = split(rows[r.randrange(len(rows))][1])
            if i % 12 == 1 and len(words) > 30:
                words[r.randrange(len(words))] = "changed"
        rows.append((i * 3 + 1, r.choice([" ", "\n", "  ", "\t"]).join(words)))
    rows += [(1000, None), (1001, ""), (1002, " \n\x0b "), (1003, "single"), (1004, "a b a b " * 60), (4, rows[1][1])]
    r.shuffle(rows)
    return [(i, t, "en", ["s1", "s2", None][i % 3] if i % 4 else "hot", len(t or "")) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, a null id, a very long text, and extra columns whose names clash with the operators' own."""
    long = " ".join(f"w{k % 5000}" for k in range(40_000))
    data = [(1, "same words here " * 10, "x", 1), (1, "same words here " * 10, "x", 1), (None, "no id at all " * 10, None, 2), (2, long, "y", 3), (3, None, None, 4)]
    return spark.createDataFrame(data, "doc_id long, text string, source string, size int").withColumns({c: F.lit("clash") for c in ("group", "bucket", "kind", "rank", "label", "shard", "part", "h", "component_id", "cluster", "block", "_key", "_size", "new_text", "_id", "_block", "id", "row", "_part", "_h", "_order", "n", "e", "place")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labelled(spark):
    """Toxic rows hold one of a few stems; poor rows are shouted."""
    r = random.Random(3)
    stems = ["grumble", "snarlish", "vexor"]
    out, labels = [], []
    for i in range(700):
        words = [f"{r.choice('bdgklmn')}{r.choice('aeiou')}{r.choice('lmnrst')}{r.choice('aeiou')}" for _ in range(r.choice([12, 30, 80]))]
        toxic, poor = i % 5 == 0, i % 4 == 0
        if toxic:
            for _ in range(max(1, len(words) // 12)):
                words[r.randrange(len(words))] = r.choice(stems) + r.choice(["", "s", "ed", "x"])
        text = " ".join(w.upper() + "!!" for w in words) if poor else " ".join(words)
        out.append((i, text, "en", "s", len(text)))
        labels.append((i, 0 if poor else 1, int(toxic)))
    return spark.createDataFrame(out, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


# --- 1 quality


def test_quality_counts(docs, rows, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = collections.Counter(tuple(r)[:7] for r in quality.quality_rules(docs, labels).collect())
    want = collections.Counter()
    for i, text, *_ in rows:
        w, t = split(text), text or ""
        lines = [x for x in t.split("\n") if split(x)]
        windows = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + d for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for d in range(8)}
        want[(i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w))] += 1
    assert got == want


@pytest.fixture(scope="module")
def graded(spark):
    """Labels that follow the share of shouted words with some noise, so that probabilities between 0 and 1 are right."""
    r = random.Random(8)
    out, labels = [], []
    for i in range(1600):
        share = r.random()
        words = [f"{r.choice('bdgklmn')}{r.choice('aeiou')}{r.choice('lmnrst')}{r.choice('aeiou')}" for _ in range(60)]
        text = " ".join(w.upper() + "!!" if r.random() < share else w for w in words)
        out.append((i, text, "en", "s", len(text)))
        labels.append((i, int(r.random() > 1 / (1 + math.exp(-8 * (share - 0.5)))), 0))
    return spark.createDataFrame(out, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_of_rows_held_out(labelled, graded):
    """Rows that the model has not learnt from: right, and with probabilities that come true."""
    docs, labels = labelled
    got = quality.quality_rules(docs, labels.where("doc_id % 3 <> 1")).join(labels, "doc_id").where("not base_failed and doc_id % 3 = 1").collect()
    assert sum(r.kept == (r.quality == 1) for r in got) > 0.95 * len(got) > 100
    docs, labels = graded
    got = quality.quality_rules(docs, labels.where("doc_id % 2 = 0")).join(labels, "doc_id").where("doc_id % 2 = 1").collect()
    p, y = np.array([r.p_quality for r in got]), np.array([r.quality for r in got])
    q = np.clip(p, 1e-6, 1 - 1e-6)
    loss, base = -(y * np.log(q) + (1 - y) * np.log(1 - q)).mean(), -(y.mean() * math.log(y.mean()) + (1 - y.mean()) * math.log(1 - y.mean()))
    assert loss < 0.8 * base
    for low, high in ((0.0, 0.25), (0.25, 0.5), (0.5, 0.75), (0.75, 1.01)):
        some = (p >= low) & (p < high)
        if some.sum() >= 60:
            assert abs(p[some].mean() - y[some].mean()) < 0.15


def test_quality_scores_follow_their_definition(rows):
    """Logits in plain Python, with n-grams of words and code points."""
    model = quality.QualityModel(np.random.default_rng(1).normal(size=1 << quality.BITS).astype(np.float32), 0.25, 1.0, 0.0)
    texts = [t or "" for _, t, *_ in rows[:40]] + ["漢字かな交じり文 漢字かな", "aé漢😀b", "ab"]

    def bucket(chars, factor):
        key = 0
        for k, c in enumerate(chars):
            key = ((key * factor + int.from_bytes(c.encode(), "big")) if k else int.from_bytes(c.encode(), "big")) & 0xFFFFFFFF
        return (key * factor & 0xFFFFFFFF) >> (32 - quality.BITS)

    got = quality.logits(pa.array(texts), model)
    for i, text in enumerate(texts):
        want = 0.25
        for n, factor in ((3, 0x9E3779B1), (4, 0x85EBCA77)):
            grams = [text[k : k + n] for k in range(len(text) - n + 1)]
            want += sum(float(model.weights[bucket(g, factor)]) for g in grams) / max(1, len(grams))
        h = _arrow.hash64([w.encode() for w in split(text)], 7)
        mask = np.uint64((1 << quality.BITS) - 1)
        for keys in (_arrow.mixed(h) if len(h) else h, _arrow.rolled(h, 2, 3)):
            want += float(model.weights[(keys & mask).astype(int)].sum()) / max(1, len(keys))
        assert got[i] == pytest.approx(want, abs=1e-4)


# --- 2 sharding


def test_shards(docs, rows):
    got = sharding.shard(docs, shards=4).collect()
    assert sorted((r.doc_id, r.size) for r in got) == sorted((i, len((t or "").encode()) + 1) for i, t, *_ in rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert all(sorted(x.slot for x in own) == list(range(len(own))) for own in by.values())
    sizes = [sum(x.size for x in by[k]) for k in range(4)]
    assert max(sizes) - min(sizes) <= 4 * max(len((t or "").encode()) for _, t, *_ in rows)
    crc = {i: zlib.crc32((t or "").encode()) for i, t, *_ in rows}
    assert all(r.text_crc32 == crc[r.doc_id] and r.law == "bytes" and r.grown_shard is None for r in got)


def test_shards_hold_whole_rows(docs, rows, tmp_path):
    sharding.sharded(docs, shards=4).write.parquet(str(tmp_path / "shards"))
    got = docs.sparkSession.read.parquet(str(tmp_path / "shards")).withColumn("_file", F.input_file_name()).collect()
    assert sorted(map(repr, (tuple(r)[:5] for r in got))) == sorted(map(repr, rows))
    files = collections.defaultdict(list)
    for r in got:
        files[r._file].append((r._shard, r._slot))
    assert len(files) == 4 and all(own == [(own[0][0], k) for k in range(len(own))] for own in files.values())


def test_shards_cut_a_group_of_equal_texts(spark):
    docs = spark.createDataFrame([(i, "copy" * 5 if i % 2 else f"text {i:014d}") for i in range(4000)], "doc_id long, text string")
    sizes = [r["s"] for r in sharding.shard(docs).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) < 0.05 * sum(sizes) / 16


def check_shards(got, shards, slack):
    """Slots are gapless and sizes near equal."""
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert all(sorted(x.slot for x in own) == list(range(len(own))) for own in by.values())
    sizes = [sum(x.size for x in by[k]) for k in range(shards)]
    assert max(sizes) - min(sizes) <= slack, sizes


@pytest.mark.parametrize("part_bytes", [sharding.PART_BYTES, 1500])
def test_shards_of_repeated_rows(spark, part_bytes):
    """Rows that agree in everything, without an id, are half of all."""
    docs = spark.createDataFrame([(None, "one and the same", "x")] * 4000 + [(k, f"text {k:012d}", "y") for k in range(4000)], "doc_id long, text string, extra string").repartition(6)
    got = sharding.shard(docs, part_bytes=part_bytes).collect()
    assert collections.Counter((r.doc_id, r.size) for r in got) == {(None, 17): 4000, **{(k, 18): 1 for k in range(4000)}}
    check_shards(got, 16, 2 * 0.002 * 8700 + 2 * 18)


def test_shards_of_one_repeated_row(spark):
    docs = spark.createDataFrame([(7, "x" * 9)] * 1601, "doc_id long, text string")
    check_shards(sharding.shard(docs).collect(), 16, 2 * 0.002 * 1000 + 20)
    got = sharding.sharded(docs.withColumns({c: F.lit("clash") for c in ("row", "part", "h", "d", "e", "shard", "slot", "m", "run")})).collect()
    assert len(got) == 1601 and {r["part"] for r in got} == {"clash"} and sorted({r["_shard"] for r in got}) == list(range(16))


def test_shards_of_extreme_ids(spark):
    top, bottom = 2**63 - 1, -(2**63)
    rows = [(i, "same text") for i in (top, bottom, top - 1, bottom + 1, None, 0)] * 40 + [(top, "other"), (None, None)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=5).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, _ in rows)
    check_shards(got, 5, 2 * 10 + 4)


def test_cuts_lie_at_the_nearer_side(spark):
    r = random.Random(6)
    docs = spark.createDataFrame([(k, "t" * r.choice([5, 300, 2000]) + str(k)) for k in range(300)], "doc_id long, text string")
    got = sharding.shard(docs, shards=4, tolerance=0.0).collect()
    total, largest = sum(x.size for x in got), max(x.size for x in got)
    upto = np.cumsum([sum(x.size for x in got if x.shard == k) for k in range(4)])
    assert all(abs(upto[k] - total * (k + 1) // 4) <= largest / 2 + 1 for k in range(3))


# --- 3 toxicity


def test_toxicity_learns(labelled):
    docs, labels = labelled
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for r in got)
    toxic, clean = [r for r in got if r.toxic], [r for r in got if not r.toxic]
    assert sum(r.predicted for r in toxic) > 0.7 * len(toxic) and sum(r.predicted for r in clean) < 0.05 * len(clean)


def test_subwords_are_shared():
    bucket, off = toxicity.subwords(pa.array(["grumble", "grumbl3", "xyz", ""]))
    sets = [set(bucket[a:b].tolist()) for a, b in zip(off[:-1], off[1:], strict=True)]
    assert len(sets[0] & sets[1]) > 6 > len(sets[0] & sets[2])


def test_toxicity_scores_follow_their_definition(rows):
    """Scores in plain Python from a model's table: means of words of means of their subwords."""
    model = toxicity.ToxicModel(np.random.default_rng(1).normal(size=1 << toxicity.BITS).astype(np.float32), -0.5)
    texts = [t or "" for _, t, *_ in rows[:40]] + ["漢字かな 漢字かな x", "AbC abc ABC é É", ""]
    got = model.score(toxicity._means(pa.array(texts), model))
    for i, text in enumerate(texts):
        words = collections.Counter("".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in split(text))
        weight = {w: math.log2(1 + n) for w, n in words.items()}
        total = sum(weight.values()) + toxicity.BLANKS
        logit = -0.5
        for w, share in weight.items():
            bucket, _ = toxicity.subwords(pa.array([w]))
            assert len(bucket) == 1 + sum(max(0, len(w) + 2 - n + 1) for n in toxicity.SIZES)
            logit += share / total * float(model.value[bucket].mean())
        assert got[i] == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-5)


def test_hot_labelled_ids_leave_room_for_others(spark):
    """One id repeated more often than the sample is one example."""
    texts = [(k, f"{'vile' if k % 2 else 'kind'} words number {k}") for k in range(40)]
    docs = spark.createDataFrame(texts + [(1, "vile words number 1")] * 400, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(40)] + [(1, 1, 1)] * 400, "doc_id long, quality int, toxic int")
    chosen = labels.groupBy("doc_id").agg(F.max("toxic").alias("label"))
    got = quality.examples(chosen, docs, toxicity._bags)
    assert collections.Counter(y for y, _, _ in got) == {0: 20, 1: 20}
    model = toxicity.train_toxicity(docs, labels, sample=40)
    assert (model.score(toxicity._means(pa.array(["vile words number 3", "kind words number 4"]), model)).round() == [1, 0]).all()


# --- 4 mixing


def test_mixing_targets(docs, rows):
    sizes = collections.Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(split(t))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(sizes.values()), set(order)
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    report = mixing.mixing_report(docs).collect()
    source = {i: s for i, _, _, s, _ in rows}
    taken = collections.Counter()
    for r in report:
        assert r.target == pytest.approx(target[source[r.doc_id]]) and r.source_size == sizes[source[r.doc_id]] and 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    assert sorted(map(tuple, report), key=repr) == sorted(map(tuple, mixing.mixing_report(docs.repartition(5)).collect()), key=repr)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len(split(r.text)) for r in mixed.collect()) == sum(taken.values())


def test_mix_lies_in_shards(docs, tmp_path):
    planned, shard_of = collections.Counter(), {}
    for r in mixing.mixing_report(docs).where("taken > 0").collect():
        planned[r.shard] += r.taken
        shard_of.setdefault(r.doc_id, set()).add(r.shard)
    mixing.mix(docs).write.parquet(str(tmp_path / "mix"))
    files = collections.defaultdict(list)
    for r in docs.sparkSession.read.parquet(str(tmp_path / "mix")).withColumn("_file", F.input_file_name()).collect():
        files[r._file].append(r)
    for own in files.values():
        assert set.intersection(*(shard_of[r.doc_id] for r in own))
    got = collections.Counter()
    for r in (rows := mixing.sharded_mix(docs, salts=3).withColumn("_task", F.spark_partition_id()).collect()):
        assert r.shard in shard_of[r.doc_id] and r._task // 3 == r.shard
        got[r.shard] += len(split(r.text))
    assert got == planned and len(rows) == sum(map(len, files.values()))


@pytest.mark.parametrize("shards", [1, 5, 8, 16])
def test_splitting_tree_keeps_quotas(spark, shards):
    have = {1: 50, 2: 7, 3: 0, 4: 200, 5: 1}
    got = mixing.split_quotas(spark.createDataFrame(list(have.items()), "nth int, n long"), 3, shards).collect()
    assert len(got) == len(have) * shards and min(r.quota for r in got) >= 0
    source, shard = collections.Counter(), collections.Counter()
    for r in got:
        source[r.nth] += r.quota
        shard[r.shard] += r.quota
    assert {k: source[k] for k in have} == have and sorted(shard) == list(range(shards)) and max(shard.values()) - min(shard.values()) <= 1


def test_splitting_tree_draws_by_the_hypergeometric_law(spark):
    """Over many seeds, the left half's blocks of the first source have the law's mean and variance."""
    counts = spark.createDataFrame([(1, 12), (2, 20), (3, 8)], "nth int, n long").coalesce(1)
    draws = [mixing.split_quotas(counts, seed, 2).where("nth = 1 and shard = 0").select("quota") for seed in range(24)]
    while len(draws) > 1:
        draws = [a.unionAll(b) for a, b in zip(draws[::2], draws[1::2], strict=False)] + draws[len(draws) // 2 * 2 :]
    got = [r.quota for r in draws[0].collect()]
    mean, variance = 6.0, 20 * (12 / 40) * (28 / 40) * (20 / 39)
    assert abs(np.mean(got) - mean) < 4 * math.sqrt(variance / 24) and 0.3 * variance < np.var(got) < 2.5 * variance


def test_mix_keeps_equal_rows_of_several_sources(spark):
    same = "w1 w2 w3 w4"
    rows = [(1, same, s) for s in ("a", "b", None) for _ in range(5)] + [(1, same, "a")] * 3 + [(k, " ".join(f"x{k}y{j}" for j in range(k % 13)), "abc"[k % 3]) for k in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(7) for c in ("_key", "_size", "h", "place", "row", "block", "taken", "nth", "shard", "size", "text_", "copy")}).repartition(4)
    report = collections.Counter()
    for r in mixing.mixing_report(docs).collect():
        report[r.doc_id, r.source_size, r.target] += r.taken
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got = mixed.collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(split(t))
    taken = collections.Counter()
    for r in got:
        assert r["h"] == 7 and r["shard"] == 7
        taken[r["source"]] += len(split(r["text"]))
    by_size = collections.Counter()
    for (_, n, target), k in report.items():
        by_size[n, target] += k
    want = {(sizes[s], taken[s]) for s in sizes}
    assert {(n, k) for (n, _), k in by_size.items()} == want and all(abs(k - t) <= 0.5 for (_, t), k in by_size.items())
    assert all(taken[s] <= 2 * n for s, n in sizes.items()) and len(want) == 4


def test_mix_of_one_repeated_row(spark):
    docs = spark.createDataFrame([(1, "one two three", "a")] * 5000 + [(2, "four five", "b")] * 1000, "doc_id long, text string, source string")
    report = mixing.mixing_report(docs).collect()
    assert len(report) == 6000
    for source, words in (("a", 3), ("b", 2)):
        own = [r for r in report if r["size"] == words]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.5 and max(r.taken for r in own) <= 2 * words
        assert sum(len(split(r["text"])) for r in mixing.mix(docs).where(F.col("source") == source).collect()) == sum(r.taken for r in own)


def test_mixing_plan_has_no_window_over_rows(docs):
    """Single-partition exchanges move sources or their counts, not blocks or rows."""
    plan = mixing.mixing_report(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange SinglePartition" not in plan


# --- 5 tokens


def test_token_counts(docs, rows):
    tokenizer = tokens.load(tokens.VOCABULARY)
    want = sorted((i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False))) for i, t, *_ in rows)
    got = tokens.count_tokens(docs).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want and all(r.over_limit == (r.n_tokens > 1024) for r in got)


def test_long_documents_are_spliced(spark):
    """The test table's own documents, at the production chunk."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tokenizer = tokens.load(tokens.VOCABULARY)
    got = {r.doc_id: r for r in tokens.count_tokens(docs).collect()}
    long = 0
    for r in docs.collect():
        text, own = r.text or "", got[r.doc_id]
        assert own.n_tokens == len(tokenizer.encode(text, add_special_tokens=False))
        if len(text.encode()) > tokens.CHUNK:
            long += 1
            assert own.n_chunks >= 2 and own.n_splices >= 1
    assert long > 50


def test_splicing_widens_and_stays_linear():
    tokenizer = tokens.load(tokens.VOCABULARY)
    spliced = tokens.Spliced(tokenizer, 300, 20)
    text = ("word " * 30 + "x" * 120) * 40  # boundaries lie further back than the overlap
    assert spliced.count(text) == len(tokenizer.encode(text, add_special_tokens=False)) and spliced.widened > 10 and spliced.splices > 10

    class Counting:
        read = 0

        def encode(self, text, add_special_tokens):
            Counting.read += len(text)
            return tokenizer.encode(text, add_special_tokens=add_special_tokens)

    text = "漢" * 60_000  # no boundary at all
    assert tokens.Spliced(Counting(), 300, 20).count(text) == len(tokenizer.encode(text, add_special_tokens=False))
    assert Counting.read < 4 * len(text)


@pytest.mark.parametrize(("chunk", "overlap"), [(200, 10), (1000, 40), (4096, 64)])
def test_splices_agree_with_whole_texts(chunk, overlap):
    r = random.Random(9)
    texts = ["a" * 9000, " " * 5000, "a b " * 3000, "<|endoftext|>" * 900, "é漢字 \n\n  x" * 900, "".join(r.choice("ab \n\t'sé1漢<|endoftext|>") for _ in range(9000)), ("word " * 10 + " 　 \n") * 200]
    tokenizer = tokens.load(tokens.VOCABULARY)
    for t in texts:
        assert tokens.count_long(tokenizer, t, chunk, overlap) == len(tokenizer.encode(t, add_special_tokens=False))
    got = tokens.token_counts(pa.array([*texts, "", *texts[::-1]]), chunk=chunk, overlap=overlap)
    want = [len(tokenizer.encode(t, add_special_tokens=False)) for t in texts]
    assert got["n_tokens"].tolist() == [*want, 0, *want[::-1]]


# --- 6 substring


def brute_substring(rows):
    seen, out = set(), {}
    for i, text in sorted({(i, t) for i, t, *_ in rows if i is not None}, key=lambda x: x[0]):
        w = (text or "").encode().split()
        lost = set()
        for k in range(len(w) - 19):
            window = tuple(w[k : k + 20])
            if window in seen:
                lost |= set(range(k, k + 20))
            seen.add(window)
        out[i] = (len(w), len(lost), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in lost)).hexdigest())
    return out


@pytest.mark.parametrize("batches", [1, 2, 7])
def test_substrings(docs, rows, batches):
    want = brute_substring(rows)
    got = substring.substring_report(docs, batches=batches).collect()
    assert len(got) == len(rows) and all((r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id] for r in got)
    assert sum(n for _, n, _ in want.values()) > 500


def test_index_compacts(spark, docs, tmp_path):
    index = substring.FingerprintIndex(spark, str(tmp_path), 4, 3, fanout=2)
    parts = docs.where("doc_id is not null").randomSplit([1.0] * 5, 3)
    for part in parts:
        index.add(part)
    assert len(index.runs) < 5 and max(level for level, _ in index.runs) >= 1
    for _, path in index.runs:
        for row in spark.read.parquet(path).where("kind = 'r'").collect():
            keys, around = _arrow.unpack(row["keys"]), _arrow.unplanes(row["extra"], np.uint32)
            assert ((keys[1:] > keys[:-1]) | ((keys[1:] == keys[:-1]) & (around[1:] > around[:-1]))).all()


def test_stored_index_takes_new_batches(spark, docs, rows, tmp_path):
    """Batches added to a stored index, opened anew each time, give what the whole run gives; a compaction comes with the second."""
    want = brute_substring(rows)
    ids = sorted({i for i, *_ in rows})
    cuts, folder, got, history = [-1, ids[40], ids[80], ids[110], ids[-1]], str(tmp_path / "index"), {}, docs.limit(0)
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        batch = docs.where((F.col("doc_id") > low) & (F.col("doc_id") <= high))
        got |= {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.substring_increment(batch, history, folder).collect()}
        history = history.unionByName(batch)
    assert got == want
    index = substring.FingerprintIndex.open(spark, folder)
    assert index.version == 4 and max(level for level, _ in index.runs) >= 1 and len(index.runs) < 4
    with pytest.raises(ValueError):
        substring.substring_increment(docs.limit(3), history, folder)


def test_spark_hash(spark):
    ids = [0, 1, -1, 5, 2**62, -(2**63)]
    want = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i long").select(F.xxhash64("i")).collect()]
    assert substring.spark_hash(np.array(ids, np.int64)).tolist() == want


# --- 7 packing


def test_packing(docs, rows):
    tokenizer = tokens.load(packing.VOCABULARY)
    got = packing.pack(docs, capacity=128).collect()
    want = collections.Counter()
    for i, t, *_ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k, start in enumerate(range(0, len(ids), 128)):
            part = ids[start : start + 128]
            want[(i, k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 128
    assert len(by) <= math.ceil(sum(r.length for r in got) / 128) * 1.05 + 2


def test_histograms():
    r = random.Random(4)
    for counts in [{}, {1: 1}, {2048: 3, 5: 2}, {1500: 7, 600: 9}, {1025: 10, 1023: 10}, {r.randrange(1, 2049): r.randrange(1, 400) for _ in range(300)}]:
        runs, made = packing.pack_histogram(counts)
        runs.sort()
        sequences = collections.defaultdict(list)
        for k, (n, first, start, offset) in enumerate(runs):
            end = runs[k + 1][1] if k + 1 < len(runs) and runs[k + 1][0] == n else counts[n]
            for d in range(end - first):
                sequences[start + d].append((offset, n))
        assert len(sequences) == made and sum(map(len, sequences.values())) == sum(counts.values())
        for own in sequences.values():
            at = 0
            for offset, n in sorted(own):
                assert offset == at
                at += n
            assert at <= 2048
        if sum(counts.values()) > 1000:
            _, best_fit = packing.pack_histogram(counts, groups=1, small=1)  # best fit of all pieces
            assert made <= best_fit * 1.01


# --- 8 media


def vectors(n, seed=2):
    r = np.random.default_rng(seed)
    return [(i, r.normal(size=64).tolist()) for i in range(n)]


def pictures(n, seed=2):
    """Images of ``rasters``, without Spark."""
    waves, v = media._wave_images(), np.array([x for _, x in vectors(n, seed)])
    v /= np.sqrt((v**2 / media._CYCLES).sum(1, keepdims=True))
    return np.clip(np.round(128 + 60 * (v.astype(np.float32) @ waves)), 0, 255).astype(np.uint8).reshape(-1, media.SIDE, media.SIDE)


def described(images):
    got = media._described([(a.shape[1], a.shape[0]) for a in images], [a.tobytes() for a in images])
    columns = {c: pa.array([x[k] for x in got], pa.binary() if k else pa.int32()) for k, c in enumerate(media._POINTS)}
    return pa.table({"id": list(range(len(images))), "copies": [1] * len(images), **columns})


def test_image_copies(spark):
    nan, inf = float("nan"), float("inf")
    rows = [*vectors(60), (60, None), (61, [0.0] * 64), (62, [1.0] * 3), (64, [inf] * 64), (65, [nan] * 64), (66, [-inf, *[1.0] * 63]), (None, vectors(9)[8][1])]
    rows += [(63, rows[7][1]), (63, rows[7][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("digest", "id", "points", "copies", "n")})
    images = media.rasters(table)
    asked = images.where("id % 3 = 0 or id is null")
    got = media.search(images, media.edited(asked)).collect()
    queries = [i for i in range(64) if i % 3 == 0 and i not in (60,)]
    own = lambda i: 7 if i == 63 else i
    assert len({r.query_id for r in got if r.match_id == own(r.query_id)}) >= 0.9 * len(queries)
    assert not [r for r in got if r.match_id != own(r.query_id)]
    assert {r.match_copies for r in got if r.match_id == 7} == {3} and {r.match_copies for r in got if r.match_id == 8} <= {2}
    lists = media.matches(images, media.edited(asked)).collect()
    assert sorted(r.query_id for r in lists) == sorted([*queries, 60, 66]) and all(r.n_matches == len(r.match_ids) == len(r.n_inliers) == len(r.copies) for r in lists)
    assert {(r.query_id, m, c, n) for r in lists for m, c, n in zip(r.match_ids, r.copies, r.n_inliers, strict=True)} == {(r.query_id, r.match_id, r.match_copies, r.n_inliers) for r in got}
    none = table.limit(0)
    assert media.matches(media.rasters(none), media.edited(media.rasters(table))).agg(F.sum("n_matches")).first()[0] == 0
    assert media.matches(media.rasters(table), media.rasters(none)).count() == 0


@pytest.mark.parametrize("kind", media.EDITS)
def test_edited_images_are_found(kind):
    images = pictures(300, seed=11)
    queries = [media.edit(images[i], kind, 7919 * i) for i in range(0, 300, 6)]
    got = media._match(described(queries), described(list(images)), media.INLIERS)
    pairs = list(zip(got["q_id"].to_pylist(), got["m_id"].to_pylist(), strict=True))
    assert sum(m == 6 * q for q, m in pairs) >= 0.9 * len(queries) and sum(m != 6 * q for q, m in pairs) == 0


def test_tests_turn_with_the_image():
    """A quarter turn moves the places and turns the orientations; the tests stay."""
    (image,) = pictures(1)
    _, place, level, turn, tests = media.describe(image[None])
    _, place2, level2, turn2, tests2 = media.describe(np.rot90(image)[None].copy())
    first = {(y, x): k for k, (y, x) in enumerate(place[level == 0].tolist())}
    same = [(first[x, media.SIDE - 1 - y], k) for k, (y, x) in enumerate(place2[level2 == 0].tolist()) if (x, media.SIDE - 1 - y) in first]
    assert len(same) > 0.9 * len(first)
    off = np.array([np.bitwise_count(tests[level == 0][a] ^ tests2[level2 == 0][b]).sum() for a, b in same])
    angles = np.array([(turn2[level2 == 0][b] - turn[level == 0][a] + np.pi / 2) % (2 * np.pi) for a, b in same])
    assert (off <= media.RADIUS).mean() > 0.9 and (np.minimum(angles, 2 * np.pi - angles) < 0.05).mean() > 0.9


def test_consensus_needs_one_transform():
    r = np.random.default_rng(3)
    z = r.uniform(0, 200, 40) + 1j * r.uniform(0, 200, 40)
    moved = 1.5 * np.exp(0.6j) * z + (30 - 12j)
    one = np.ones(40)
    assert media.consensus(z, moved + r.normal(0, 0.5, 40), 0.65 * one, 1.4 * one, 3 * one, 6) >= 30
    assert media.consensus(z, r.permutation(moved), 0.65 * one, 1.4 * one, 3 * one, 6) < 6
    assert media.consensus(z[:1].repeat(20), moved[:1].repeat(20), 0.6 * one[:20], 1.5 * one[:20], 3 * one[:20], 6) <= 1  # one place, however many points


def test_close_points_are_all_found():
    r = np.random.default_rng(4)
    block = r.integers(0, 256, (300, media.BITS // 8), np.uint8)
    asked = np.unpackbits(block, axis=1)
    for k, bits in enumerate(asked):
        bits[r.choice(media.BITS, k % 20, replace=False)] ^= 1
    block[200:] = block[7]  # a frequent key
    asked = np.packbits(asked, axis=1)
    distance = np.bitwise_count(asked[:, None] ^ block[None]).sum(2, dtype=np.int64)
    assert media.RADIUS >= 12 and set(range(13)) <= set(distance.ravel())
    got = list(zip(*media.Tables(block).close(asked), strict=True))
    assert len(got) == len(set(got)) and set(got) == set(zip(*np.nonzero(distance <= media.RADIUS), strict=True))


def test_image_blocks_change_nothing(spark, monkeypatch):
    images = media.rasters(spark.createDataFrame(vectors(24, 3), "vec_id long, embedding array<double>"))
    found = lambda: sorted(map(tuple, media.search(images, media.edited(images.where("id % 4 = 0"))).collect()))
    want = found()
    monkeypatch.setattr(media, "IMAGE_POINTS", 900)
    monkeypatch.setattr(media, "QUERY_POINTS", 600)
    monkeypatch.setattr(media, "CANDIDATES", 50)
    assert want and found() == want


def test_quarter_of_a_large_image(spark):
    r = np.random.default_rng(8)
    large = [np.round(media._sums(r.integers(0, 256, (1, 256, 256)).astype(np.float64), 2)[0] / 25).astype(np.uint8) for _ in range(6)]
    row = lambda i, a: (i, a.shape[1], a.shape[0], bytearray(np.ascontiguousarray(a).tobytes()))
    schema = "id long, width int, height int, pixels binary"
    images = spark.createDataFrame([row(i, a) for i, a in enumerate(large)], schema)
    queries = spark.createDataFrame([row(100 + i, a[40 + i : 168 + i, 90 - i : 218 - i]) for i, a in enumerate(large)], schema)
    got = {(r.query_id, r.match_id): r.n_inliers for r in media.search(images, queries).collect()}
    assert set(got) == {(100 + i, i) for i in range(6)} and min(got.values()) >= 50


# --- 9 language model


class BruteKatz:
    """Katz backoff over plain dictionaries; a context is a tuple whose first token may be the start, 0."""

    def __init__(self, texts, order):
        self.order, self.counts = order, [collections.Counter() for _ in range(order)]
        self.starts = len(texts)
        for w in texts:
            for i in range(len(w)):
                for k in range(1, order + 1):
                    if k == 1 or i - k + 1 >= -1:
                        self.counts[k - 1][self.gram(w, i, k)] += 1
        count = lambda c: [0] + [sum(v == k for v in c.values()) for k in range(1, 7)]
        self.d = [katz.Discounts.from_counts(count(c)).table for c in self.counts]
        self.n = sum(self.counts[0].values())
        self.unknown = 1 - sum(self.mass(1, c) for c in self.counts[0].values()) / self.n if self.n else 1.0
        self.after = collections.defaultdict(list)
        for c in self.counts[1:]:
            for g in c:
                self.after[g[:-1]].append(g[-1])

    @staticmethod
    def gram(w, i, k):
        return tuple(w[i - k + 1 : i + 1]) if i - k + 1 >= 0 else (0, *w[: i + 1])

    def mass(self, k, r):
        return self.d[k - 1][min(r, 6)] * r

    def context_n(self, context):
        return self.starts if context == (0,) else self.counts[len(context) - 1][context]

    def alpha(self, context):
        seen = self.after[context]
        own = sum(self.p(context, w) for w in seen)
        return (1 - own) / (1 - sum(self.p(context[1:], w) for w in seen))

    def p(self, context, w):
        if not context:
            r = self.counts[0][(w,)]
            return self.mass(1, r) / self.n if r else self.unknown
        r, n = self.counts[len(context)][(*context, w)], self.context_n(context)
        if r:
            return self.mass(len(context) + 1, r) / n
        return (self.alpha(context) if n else 1.0) * self.p(context[1:], w)

    def score(self, w):
        return sum(math.log10(self.p(self.gram(w, i, min(self.order, i + 2))[:-1], w[i])) for i in range(len(w)))


def katz_texts(rows):
    lower = lambda t: bytes(c + 32 if 65 <= c <= 90 else c for c in t.encode())
    return [(i, [*lower(t or "").split(), 1]) for i, t, *_ in rows]


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


@pytest.mark.parametrize("order", [2, 3, 4])
def test_katz(docs, rows, order, monkeypatch):
    monkeypatch.setattr(katz, "BUCKET_BYTES", 4000)
    monkeypatch.setattr(katz, "FIRST_PART", 40_000)  # partitions of a corpus of some terabytes
    texts = katz_texts(rows)
    model = BruteKatz([w for i, w in texts if not held_out(i)], order)
    vocabulary = list(model.counts[0])
    contexts = random.Random(1).sample(sorted(model.after, key=repr), 25) + [(0,)]
    for context in contexts:
        assert sum(model.p(context, w) for (w,) in vocabulary) + model.p(context, b"never seen") == pytest.approx(1)
    n, v = model.n, len(vocabulary)
    got = {(r.doc_id, r.n_tokens): r for r in katz.katz_scores(docs, order).collect()}
    for i, w in texts:
        base = sum(math.log10((model.counts[0][(x,)] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        r = got[i, len(w)]
        assert (r.held_out, r.train_tokens, r.n_known) == (held_out(i), n, sum(model.counts[0][(x,)] > 0 for x in w))
        assert r.score == pytest.approx(model.score(w)) and r.base_score == pytest.approx(base)


def test_katz_without_training_texts(spark):
    held = [i for i in range(200) if held_out(i)][:3]
    got = katz.katz_scores(spark.createDataFrame([(i, "a b c") for i in held], "doc_id long, text string")).collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.score, r.base_score) for r in got] == [(True, 4, 0, 0, 0.0, 0.0)] * 3


# --- 10 near-duplicates


def brute_near(rows, shingle=4, percent=80):
    sets = {}
    for i, t, *_ in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets[i] = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_duplicates(docs, rows):
    want = brute_near(rows)
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and sum(not r.kept for r in got) >= 8
    left = neardup.deduplicate(docs)
    assert left.columns == docs.columns
    five = brute_near(rows, 5)
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, (_, c) in five.items() if i == c)  # one row each


def test_components_converge_or_fail(spark, tmp_path):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {tuple(r) for r in components.components(edges, str(tmp_path)).collect()} - {(0, 0)} == {(i, 0) for i in range(1, 41)}
    with pytest.raises(RuntimeError):
        components.components(edges, str(tmp_path), "few", rounds=3)


def test_estimates_follow_similarity():
    r = np.random.default_rng(7)
    base = r.integers(0, 2**63, 1000, dtype=np.int64).astype(np.uint64)
    for share in (0.2, 0.5, 0.8, 0.95):
        k = round(1000 * 2 * share / (1 + share))
        other = np.concatenate([base[:k], r.integers(0, 2**63, 1000 - k, dtype=np.int64).astype(np.uint64)])
        s = neardup.sketch(np.concatenate([base, other]), np.array([0, 1000, 2000])).astype(int)
        equal, more = (s[0] == s[1]).sum(), (s[0] > s[1]).sum()
        got = neardup.estimate(np.array([equal]), np.array([more]), np.array([neardup.REGISTERS - equal - more]), np.array([1000.0]), np.array([1000.0]))[0]
        assert abs(got - share) < 5 * math.sqrt(share * (1 - share) / neardup.REGISTERS) + 0.02


def test_blocks_of_a_large_cluster(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_SETS", 7)
    r = random.Random(1)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(i % 6):
            w[r.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(w)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute_near(rows)


@pytest.mark.parametrize("seed", range(3))
def test_clusters_of_several_groups(spark, monkeypatch, seed):
    """Groups of near copies that share templates: large candidate clusters of several components."""
    monkeypatch.setattr(neardup, "BLOCK_SETS", 5)
    r = random.Random(seed)
    template = [f"t{k}" for k in range(150)]
    rows = []
    for g in range(6):
        base = template[: 110 - 3 * g] + [f"g{g}w{k}" for k in range(14 + 2 * g)]
        for i in range(12):
            w = list(base)
            for _ in range(i % 4):
                w[r.randrange(len(w))] = f"x{g}y{i}"
            rows.append((100 * g + i, " ".join(w)))
    r.shuffle(rows)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_near(rows)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want and 1 < len({c for _, c in want.values()}) < len(rows)


# --- odd inputs

OPERATORS = {
    "quality": lambda d, l: quality.quality_rules(d, l), "shard": lambda d, l: sharding.shard(d), "toxicity": lambda d, l: toxicity.toxicity(d, l), "mixing": lambda d, l: mixing.mixing_report(d), "tokens": lambda d, l: tokens.count_tokens(d),
    "substring": lambda d, l: substring.substring_report(d), "packing": lambda d, l: packing.pack(d), "katz": lambda d, l: katz.katz_scores(d), "near": lambda d, l: neardup.near_duplicates(d),
}
PASSING = {"mix": mixing.mix, "cut": substring.deduplicate, "one": neardup.deduplicate}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(name, odd, empty, labelled, spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (None, 0, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    got = OPERATORS[name](odd, labels).collect()
    per_row = collections.Counter(r.doc_id for r in got if getattr(r, "piece", 0) == 0)
    assert per_row == {1: 2, None: 1, 2: 1, 3: 1}
    assert OPERATORS[name](empty, labels.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(PASSING))
def test_passing_stages_keep_columns(name, odd, empty):
    got = PASSING[name](odd)
    assert got.columns == odd.columns and got.count() >= 1
    assert PASSING[name](empty).count() == 0


def test_packed_numbers():
    r = np.random.default_rng(1)
    keys = np.sort(r.integers(0, 2**63, 1000, dtype=np.int64).astype(np.uint64) * np.uint64(2))
    assert (_arrow.unpack(_arrow.pack(keys)) == keys).all() and len(_arrow.unpack(_arrow.pack(keys[:0]))) == 0
    values = r.integers(-5, 5, 100).astype(np.int32)
    assert (_arrow.unplanes(_arrow.planes(values), np.int32) == values).all()


def test_pairs_in_their_first_band_are_all_links():
    """Sets compared in the first band that they share, over all bands: the same components as all pairs of those that share one."""
    rng = np.random.default_rng(5)
    base = rng.integers(1, 2**63, (6, 200), dtype=np.uint64)
    sets = [np.sort(np.concatenate([base[k % 6, rng.permutation(200)[:185]], rng.integers(1, 2**63, 10, dtype=np.uint64)])) for k in range(48)]
    registers = neardup.sketch(np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets]))
    ids, bands = np.arange(48), neardup.band_keys(registers)

    def linked(pairs):
        label = ids.copy()
        for a, b in pairs:
            label[label == label[b]] = label[a]
        return {frozenset(np.flatnonzero(label == x)) for x in label}

    met = []
    for key in np.unique(bands):
        some = np.flatnonzero((bands == key).any(1))
        args = ids[some], np.zeros(len(some), int), ids[some], [sets[k] for k in some], registers[some], 80
        met += neardup.confirmed(*args, band=int(key.astype(np.int64)))
    together = [(a, b) for a in ids for b in ids[:a] if (bands[a] == bands[b]).any() and 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))]
    assert linked(met) == linked(together) and len(linked(met)) < 48

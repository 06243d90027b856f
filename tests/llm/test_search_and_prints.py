"""Hard negatives, fill-in-the-middle and SimHash against brute force and round trips, and on odd inputs."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weftline.llm import fim, negatives, simhash

from .test_operators import corpus, docs, empty, odd, rows, split  # noqa: F401

# --- 11 hard negatives


def vectors(seed, n, width, labels=4):
    """Different norms, repeated vectors, equal scores, and rows that take no part."""
    r = random.Random(seed)
    hot = [r.randrange(-5, 6) for _ in range(width)]
    out = []
    for i in range(n):
        scale = r.choice([1, 1, 3, 9])
        v = hot if i % 3 == 0 else [scale * r.randrange(-6, 7) for _ in range(width)]
        out.append((i, i % labels if i % 5 else 0, [float(x) for x in v]))
    out += [(n, None, [1.0] * width), (n + 1, 1, None), (None, 1, [1.0] * width), (n + 2, 1, [1.0, None]), (n + 3, 1, [float("nan")] * width), (n + 4, 1, [float("inf")] * width), (n + 5, 1, [2.0]), (n + 6, 2, [])]
    return [*out, out[4], out[4], out[0]]


def brute_negatives(rows, asks, k=5, low=80):
    seen = sorted({(i, l, tuple(v)) for i, l, v in rows if i is not None and l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)})
    score = lambda a, b: sum(int(x) * int(y) for x, y in zip(a, b, strict=False))
    out = set()
    for i, l, v in seen:
        if not asks(i):
            continue
        all_ = [(-score(v, w), j, m) for j, m, w in seen if j != i]
        for s, p, _ in sorted(x for x in all_ if x[2] == l)[:k]:
            window = sorted(x for x in all_ if x[2] != l and low * -s <= 100 * -x[0] <= 100 * -s)[:k]
            out |= {(i, p, r, n, -s, -t) for r, (t, n, _) in enumerate(window, 1)}
    return out


@pytest.mark.parametrize("spread", [1, 7])
def test_hard_negatives_are_exact(spark, spread, monkeypatch):
    monkeypatch.setattr(negatives, "CELL", 40)
    monkeypatch.setattr(negatives, "ASKS", 6)
    data = vectors(spread, 300, 6)
    df = spark.createDataFrame(data, "id long, label int, vector array<double>").withColumns({"score": F.lit("clash"), "norm": F.lit(1), "cell": F.lit(2), "rank": F.lit(3)})
    got = negatives.hard_negatives(df, F.col("id") % 20 == 0, spread=spread).collect()
    want = brute_negatives(data, lambda i: i % 20 == 0)
    assert len(got) == len(want) > 50 and {tuple(r) for r in got} == want


def test_hard_negatives_of_large_numbers(spark):
    r = random.Random(4)
    data = [(i, i % 2, [float(r.randrange(-(1 << 29), 1 << 29)) for _ in range(4)]) for i in range(60)]
    got = negatives.hard_negatives(spark.createDataFrame(data, "id long, label int, vector array<double>"), F.col("id") % 10 == 0).collect()
    assert {tuple(x) for x in got} == brute_negatives(data, lambda i: i % 10 == 0) and got


def test_hard_negatives_of_nothing(spark):
    none = spark.createDataFrame([], "id long, label int, vector array<double>")
    assert negatives.hard_negatives(none, F.col("id") % 10 == 0).count() == 0
    alone = spark.createDataFrame([(0, 1, [1.0]), (1, 2, [1.0])], "id long, label int, vector array<double>")
    assert negatives.hard_negatives(alone, F.col("id") % 10 == 0).count() == 0  # no positive


def test_cells_out_of_reach_are_not_asked(spark):
    """Short vectors can't reach a window that only long ones fill."""
    data = [(i, i % 2, [100.0 + i % 3, 1.0]) for i in range(40)] + [(i, i % 2, [1.0, 1.0]) for i in range(40, 4000)]
    df = negatives.valid(spark.createDataFrame(data, "id long, label int, vector array<double>"))
    from weftline.llm._arrow import shared_folder

    cells = negatives.Cells(df, shared_folder(spark), 8)
    assert cells.count >= 8 and len(cells.routes) == cells.count
    reach = spark.range(1).select(cells.last(F.lit(50.0)).alias("far"), cells.last(F.lit(1e9)).alias("none"), cells.last(F.lit(0.0)).alias("all")).first()
    assert 0 <= reach["far"] < cells.count - 1 and reach["none"] == -1 and reach["all"] == cells.count - 1


# --- 12 fill-in-the-middle

UNIT = {"line": r"[^\n]*\n|[^\n]+", "word": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "character": r"(?s)."}


def brute_middle(doc_id, text, unit):
    text = text or ""
    units = re.findall(UNIT[unit], text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in fim.SENTINELS):
        return len(units), "plain", None, None, text
    i, j = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:i], units[i:j], units[j:]))
    assert p + m + s == text
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


TEXTS = ["", None, "\n", "\n\n\n", "a", "a\n", "\na", "ab\ncd\n\n\nef", " lead and trail \n", "é\n漢字 😀\n", "<P>x", "x <S> y\nz", "<M>\n", "<p>", " ", "\t\x0b\x0c\r\n", "no line feed " * 50, "x\n" * 3000, "ß" * 100 + "\n" + "😀" * 70 + "a"]


@pytest.mark.parametrize("unit", fim.UNITS)
def test_middles(spark, unit):
    data = [(i, t) for i in range(12) for t in TEXTS] + [(None, "no id\nat all\n"), (10**12, "big\nid\n")]
    made = fim.fill_in_middle(spark.createDataFrame(data, "doc_id long, text string").repartition(2), unit=unit)
    got = made.withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.again) for r in got), key=key) == sorted(((i, *brute_middle(i, t, unit), t or "") for i, t in data), key=key)


def test_runs_are_searched_not_listed():
    raw = np.frombuffer(b"ab\n\n\ncd\n" + b"\n" * 1000 + b"end", np.uint8)
    runs = fim.Runs(raw, np.array([0, len(raw)]), "line")
    assert len(runs.units) == 5 and runs.counts.tolist() == [1005]  # a thousand lines in one run
    assert [int(runs.place(np.array([k]))[0]) for k in (0, 1, 3, 4, 500, 1004, 1005)] == [0, 3, 5, 8, 504, 1008, 1011]


def test_middle_settings(spark, odd, empty):  # noqa: F811
    data = spark.createDataFrame([(i, "a\nb\nc\n") for i in range(400)], "doc_id long, text string")
    forms = {r["form"]: r["count"] for r in fim.fill_in_middle(data, percent=60, spm=25).groupBy("form").count().collect()}
    assert abs(forms["plain"] - 160) < 40 and abs(forms["spm"] - 60) < 30
    moved = fim.transformed(odd)
    assert moved.columns == odd.columns
    texts = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    assert texts(moved) == sorted(((i, brute_middle(i, t, "line")[-1]) for i, t in texts(odd)), key=str)
    assert fim.transformed(empty).count() == fim.report(empty).count() == 0


# --- 13 SimHash


def brute_print(text, shingle=4):
    words = split(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[k : k + shingle]) for k in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_simhash(rows, shingle=4):
    prints = {}
    for i, t in rows:
        prints.setdefault(brute_print(t, shingle), []).append(i)
    known = sorted(prints)
    label = {p: p for p in known}
    for a, b in itertools.combinations(known, 2):
        if (a ^ b).bit_count() <= 4 and label[a] != label[b]:
            old, new = label[b], label[a]
            label = {p: new if x == old else x for p, x in label.items()}
    least = {}
    for p, ids in prints.items():
        ids = [i for i in ids if i is not None]
        least[label[p]] = min([least.get(label[p]), *ids], key=lambda i: (i is None, i)) if ids or label[p] in least else None
    return sorted(((i, f"{p:016x}", least[label[p]]) for p, ids in prints.items() for i in ids), key=str)


def test_golay_code():
    words = np.arange(1 << 23)[:: 997]
    got = simhash.indices(words)
    table = simhash._errors()
    assert ((table >= 0).sum(1) == np.where((table >= 0).sum(1) == 1, 1, 6)).all() and (table >= 0).sum() == 277 + 6 * 1771
    codewords = np.array([(m << 11) | int(simhash._syndrome(np.array([m << 11]))[0]) for m in range(4096)])
    assert np.bitwise_count(codewords[1:].astype(np.uint64)).min() == 7
    for w, found in zip(words[:200], got[:200], strict=True):
        near = np.flatnonzero(np.bitwise_count((codewords ^ w).astype(np.uint64)) <= 4)
        assert sorted(found[found >= 0]) == sorted(near)


def test_any_two_within_four_bits_share_a_key():
    r = np.random.default_rng(2)
    x = r.integers(0, 2**63, 4000, dtype=np.int64).astype(np.uint64) * np.uint64(2) + r.integers(0, 2, 4000, dtype=np.int64).astype(np.uint64)
    y = x.copy()
    for _ in range(4):  # bits may be turned twice
        y ^= np.uint64(1) << r.integers(0, 64, 4000).astype(np.uint64)
    (a, k), (b, m) = simhash.keys_of(x), simhash.keys_of(y)
    left, right = set(zip(a.tolist(), k.tolist(), strict=True)), set(zip(b.tolist(), m.tolist(), strict=True))
    assert {i for i, _ in left & right} == set(range(4000))
    assert len(left) == len(a) <= 108 * 4000


def test_simhash_components(spark, docs, rows):  # noqa: F811
    got = sorted((tuple(r) for r in simhash.simhash_duplicates(docs).collect()), key=str)
    assert got == brute_simhash([r[:2] for r in rows])


def near_texts(seed, n):
    """Long texts with a few words changed, so that fingerprints differ in some bits, chained over several edits."""
    r = random.Random(seed)
    out = []
    for g in range(6):
        words = [f"w{r.randrange(10**6)}" for _ in range(400)]
        for k in range(n):
            words = list(words)
            words[r.randrange(400)] = f"x{r.randrange(10**6)}"
            out.append((g * 1000 + k, " ".join(words)))
    return out


@pytest.mark.parametrize("block", [4096, 8])
def test_simhash_chains(spark, block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    data = near_texts(block, 40)
    got = sorted((tuple(r) for r in simhash.simhash_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()), key=str)
    assert got == brute_simhash(data)
    assert 6 <= len({c for *_, c in got}) < len(data)


def test_links_are_a_forest():
    r = np.random.default_rng(3)
    fp = (np.int64(0x1234567) ^ (np.int64(1) << r.integers(0, 20, 300))).astype(np.int64)
    fp = np.unique(np.concatenate([fp, fp ^ 3, r.integers(0, 2**62, 100)]))
    n = len(fp)
    found = simhash.links_in(np.zeros(n, int), np.zeros(n, bool), np.zeros(n, int), fp, fp, 4)
    assert all((a ^ b).bit_count() <= 4 for a, b in found) and len(found) < n
    parent = {int(x): int(x) for x in fp}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        assert root(a) != root(b)
        parent[root(a)] = root(b)
    assert all(root(int(a)) == root(int(b)) for a, b in itertools.combinations(fp, 2) if (int(a) ^ int(b)).bit_count() <= 4)


def test_simhash_odd(spark, odd, empty, monkeypatch):  # noqa: F811
    data = [(r.doc_id, r.text) for r in odd.collect()]
    monkeypatch.setattr(simhash, "PIECE_BYTES", 1000)
    assert sorted((tuple(r) for r in simhash.simhash_duplicates(odd).collect()), key=str) == brute_simhash(data)
    assert simhash.simhash_duplicates(empty).count() == 0
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, None}
    long = " ".join(f"w{k % 700}" for k in range(3000)) + " " + "y" * 3000 + " end"
    assert simhash.fingerprint(long) == brute_print(long) and simhash.fingerprint("One TWO\tthree") == brute_print("one two three") and simhash.fingerprint(" \n") == 0

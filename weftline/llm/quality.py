"""Quality rules: fixed rules on counts, then a calibrated n-gram classifier.

The classifier is a logistic regression on hashed word 1- and 2-grams and character 3- and
4-grams, of code points.  A document's features are the shares of each n-gram among all of its kind, so
long and short texts compare.  It learns from at most ``sample`` labelled documents (those
with the smallest hash of their id); a fifth of them is set aside for Platt calibration.  An id with several labels has the
larger one, and one with several texts that of the smallest hash.
Scoring is one pass in Arrow batches; all n-grams of the whole text count.

Defined cases: a null or empty text has no words, so ``base_failed`` is true and ``kept``
false.  With no labelled rows, or rows of one class only, every document has that class's
share as its probability (1 without labels), so the rules alone decide.  Repeated rows are
scored each; columns of the input beyond id and text are ignored; null ids pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ._arrow import Words, characters, mixed, rolled, slices, sparse, sums, texts_of, unsparse, utf8

SAMPLE = 3000
BITS = 18
MIN_WORDS = 20
REPEAT_PERCENT = 30
KEEP_THRESHOLD = 0.5
WINDOW = 8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@dataclass
class QualityModel:
    weights: np.ndarray  # float32, one per bucket
    bias: float
    slope: float  # of the Platt calibration
    offset: float

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logit + self.offset, -60, 60)))


def _repeated_words(words: Words, hashes: np.ndarray) -> np.ndarray:
    """Words of each text that lie in a window found twice or more in that text."""
    docs = len(words.starts) - 1
    windows = rolled(hashes[words.codes], WINDOW)
    if not len(windows):
        return np.zeros(docs, np.int64)
    doc = words.doc
    inside = np.flatnonzero(doc[: len(windows)] == doc[WINDOW - 1 :])
    key = windows[inside] ^ mixed(doc[inside].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    ordered = key[order]
    equal = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(key), bool)
    left, right = inside[order[:-1][equal]], inside[order[1:][equal]]
    same = np.ones(len(left), bool)
    for k in range(WINDOW):  # the hash proposes, the words decide
        same &= words.codes[left + k] == words.codes[right + k]
    same &= doc[left] == doc[right]
    twice[order[:-1][equal][same]] = True
    twice[order[1:][equal][same]] = True
    edges = np.zeros(len(words.codes) + 1, np.int64)
    at = inside[twice]
    edges[at] += 1
    edges[at + WINDOW] -= 1
    covered = np.cumsum(edges[:-1]) > 0
    return sums(covered.astype(np.int64), words.starts[:-1], words.starts[1:])


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts on which the fixed rules rest."""
    words = Words(texts)
    raw, off = utf8(texts)
    starts, stops = off[:-1], off[1:]
    inner = ~_SPACE[raw] & ((raw & 0xC0) != 0x80)
    lines = pc.split_pattern(texts, "\n")
    flat = lines.flatten()
    line_doc = np.repeat(np.arange(len(texts)), pc.list_value_length(lines).to_numpy(zero_copy_only=False))
    has_word = pc.binary_length(pc.ascii_trim_whitespace(flat)).to_numpy(zero_copy_only=False) > 0
    codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)[has_word]
    doc = line_doc[has_word]
    first = np.unique(doc * (codes.max(initial=0) + 1) + codes, return_index=True)[1]
    n = len(texts)
    return {
        "n_words": words.counts,
        "word_chars": sums(inner.astype(np.int8), starts, stops),
        "n_symbols": sums(_SYMBOL[raw].astype(np.int8), starts, stops),
        "n_dup_lines": np.bincount(doc, minlength=n) - np.bincount(doc[first], minlength=n),
        "n_repeat_words": _repeated_words(words, words.hashes()),
    }


def _grams(texts: pa.Array, bits: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind of n-gram: buckets in a row, and where those of each text start and stop."""
    mask = np.uint64((1 << bits) - 1)
    words = Words(texts)
    hashes = words.hashes(7)
    occurrence = hashes[words.codes]
    out = [((mixed(occurrence) & mask).astype(np.int32), words.starts[:-1], words.starts[1:])]
    pairs = rolled(occurrence, 2, 3)
    first = np.minimum(words.starts[:-1], len(pairs))
    out.append(((pairs & mask).astype(np.int32), first, np.maximum(first, np.minimum(words.starts[1:] - 1, len(pairs)))))
    raw, off = utf8(texts)
    wide, off = characters(raw, off)
    for n, factor in ((3, 0x9E3779B1), (4, 0x85EBCA77)):
        count = max(0, len(wide) - n + 1)
        key = wide[:count].copy()
        for k in range(1, n):
            key *= np.uint32(factor)
            key += wide[k : k + count]
        key *= np.uint32(factor)
        key >>= np.uint32(32 - bits)
        start = np.minimum(off[:-1], count)
        out.append((key.astype(np.int32), start, np.maximum(start, np.minimum(off[1:] - n + 1, count))))
    return out


def logits(texts: pa.Array, model: QualityModel, bits: int = BITS) -> np.ndarray:
    total = np.full(len(texts), model.bias)
    for buckets, start, stop in _grams(texts, bits):
        total += sums(model.weights[buckets], start, stop) / np.maximum(stop - start, 1)
    return total


def _features(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows: list[list] = [[] for _ in range(batch.num_rows)]
        for buckets, start, stop in _grams(texts_of(batch), bits):
            for i, (a, b) in enumerate(zip(start, stop, strict=True)):
                where, n = np.unique(buckets[a:b], return_counts=True)
                rows[i].append((where, (n / max(1, b - a)).astype(np.float32)))
        packed = [sparse(np.concatenate([x for x, _ in r]), np.concatenate([x for _, x in r])) for r in rows]
        columns = [pa.array([p[k] for p in packed], pa.binary()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("_order"), *columns], names=["label", "_order", "buckets", "shares"])


def _fit(examples: list[tuple[int, bytes, bytes]], bits: int, epochs: int = 12) -> QualityModel:
    labels = np.array([y for y, _, _ in examples], np.float64)
    if not len(labels) or labels.min() == labels.max():
        share = labels.mean() if len(labels) else 1.0
        return QualityModel(np.zeros(1 << bits, np.float32), 0.0, 0.0, float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -20, 20)))
    held = np.arange(len(labels)) % 5 == 4
    weights, squares, bias, bias_square = np.zeros(1 << bits), np.full(1 << bits, 1e-8), 0.0, 1e-8
    random = np.random.default_rng(11)
    train = np.flatnonzero(~held)
    balance = {y: len(train) / max(1, 2 * int((labels[train] == y).sum())) for y in (0.0, 1.0)}
    for _ in range(epochs):
        order = random.permutation(train)
        for at in range(0, len(order), 64):
            some = order[at : at + 64]
            bags = [unsparse(*examples[i][1:]) for i in some]
            where, share = np.concatenate([w for w, _ in bags]), np.concatenate([s for _, s in bags])
            count = np.array([len(w) for w, _ in bags])
            row = np.repeat(np.arange(len(some)), count)
            logit = np.bincount(row, share * weights[where], len(some)) + bias
            error = (1 / (1 + np.exp(-np.clip(logit, -60, 60))) - labels[some]) * np.array([balance[y] for y in labels[some]]) / len(some)
            used, inverse = np.unique(where, return_inverse=True)
            slope = np.bincount(inverse, error[row] * share, len(used)) + 1e-7 * weights[used]
            squares[used] += slope**2
            weights[used] -= 1.0 * slope / np.sqrt(squares[used])
            bias_square += error.sum() ** 2
            bias -= 0.1 * error.sum() / np.sqrt(bias_square)
    logit = np.array([float(np.dot(s, weights[w])) + bias for w, s in (unsparse(*x[1:]) for x in examples)])
    a, b = _platt(logit[held], labels[held])
    return QualityModel(weights.astype(np.float32), bias, a, b)


def _platt(logit: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method with Platt's smoothed targets."""
    if len(label) < 10 or label.min() == label.max():
        return 1.0, 0.0
    scale = max(1.0, float(np.abs(logit).mean()))
    x = logit / scale
    up, down = (label == 1).sum(), (label == 0).sum()
    target = np.where(label == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - target) * x).sum() + 1e-3 * a, (p - target).sum()])
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 0.0) / scale, b


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, bits: int = BITS) -> QualityModel:
    """Learns from at most ``sample`` labelled documents, chosen by a hash of their id."""
    one = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    got = examples(one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), docs, lambda it: _features(it, bits))
    return _fit(got, bits)


def examples(chosen: DataFrame, docs: DataFrame, features) -> list[tuple[int, bytes, bytes]]:
    """Label and packed features of each chosen document (doc_id, label), in an order that reruns keep; one row an id, so they are no more than chosen."""
    text = F.coalesce("text", F.lit(""))
    rows = chosen.join(docs.select("doc_id", F.struct(F.xxhash64(text).alias("h"), text.alias("text")).alias("t")), "doc_id").groupBy("doc_id", "label").agg(F.min("t").alias("t"))
    rows = rows.select("label", F.xxhash64("doc_id", "t.text").alias("_order"), F.col("t.text").alias("text"))
    got = rows.mapInArrow(features, "label int, _order long, buckets binary, shares binary").toArrow().sort_by([("_order", "ascending"), ("label", "ascending")])
    return list(zip(got["label"].to_pylist(), got["buckets"].to_pylist(), got["shares"].to_pylist(), strict=True))


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = KEEP_THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: counts, rules, probability and verdict."""
    model = train_quality(docs, labels, sample=sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = texts_of(batch)
            base = base_counts(texts)
            failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > REPEAT_PERCENT * base["n_words"])
            good = shared.value.probability(logits(texts, shared.value))
            columns = {"doc_id": batch.column("doc_id")} | {k: pa.array(v, pa.int64()) for k, v in base.items()}
            columns |= {"base_failed": pa.array(failed), "p_quality": pa.array(good), "kept": pa.array(~failed & (good >= threshold))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, p_quality double, kept boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, schema)

"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

Each lower-cased word (A-Z) with a mark at both ends has itself and its character 3- to 5-grams (of code points) as
subwords, hashed to ``2**BITS`` embeddings of ``DIM`` numbers.  A document's vector is the mean
over its words of the mean over each word's subwords, where a word found c times weighs
log2(1 + c) and ``BLANKS`` blank words count along, so that a few chance words don't decide on
a short or repetitive text (a constant set by hand, about a short text's words); a softmax of two classes follows.  Both
layers are learnt together with Adagrad from at most ``sample`` labelled documents; an id with several labels is toxic if
one says so, and one with several texts has that of the smallest hash.  Misspelt words
share most of their n-grams with the known ones and so most of their vector.

Since averaging and the last layer are linear, scoring needs one number per subword, and each
distinct word of a batch is looked up once.  Every word of every whole text counts.

Defined cases: null and empty texts have no words and get the softmax of the biases; without
usable labels the score is the share of toxic rows among them (0 if there are none).  Repeated
rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ._arrow import Words, characters, ragged, slices, sparse, sums, texts_of, unsparse, utf8
from .quality import examples

BITS = 19
DIM = 8
SAMPLE = 4000
THRESHOLD = 0.7
SIZES = (3, 4, 5)
BLANKS = 40  # blank words, of vector 0, that each document's mean has besides its own


@dataclass
class ToxicModel:
    value: np.ndarray  # float32: what each subword adds to the logit
    bias: float

    def score(self, mean: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(mean + self.bias, -60, 60)))


def _lower(texts: pa.Array) -> pa.Array:
    return pc.ascii_lower(texts)


def subwords(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of each word, in a row, and the offsets of each word's."""
    raw, off = characters(*utf8(distinct))
    n_words = len(off) - 1
    lengths = np.diff(off) + 2
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1].astype(np.int64)
    marked = np.empty(int(lengths.sum()), np.uint32)
    inner = np.ones(len(marked), bool)
    inner[starts] = False
    inner[starts + lengths - 1] = False
    marked[starts], marked[starts + lengths - 1] = 1, 2
    marked[inner] = raw
    word = np.repeat(np.arange(n_words), lengths)
    owner, found = [], []
    # the word itself, as a sum over its characters and their places
    place = (np.arange(len(marked)) - starts[word]).astype(np.uint64)
    power = np.uint64(0x100000001B3)
    terms = (marked.astype(np.uint64) + np.uint64(17)) * (place * np.uint64(2) + np.uint64(1)) * power
    terms ^= terms >> np.uint64(29)
    terms *= np.uint64(0xBF58476D1CE4E5B9)
    total = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
    whole = total[starts + lengths] - total[starts]
    owner.append(np.arange(n_words))
    found.append((whole >> np.uint64(64 - BITS)).astype(np.int64))
    for n in SIZES:
        count = len(marked) - n + 1
        if count <= 0:
            continue
        same = np.flatnonzero(word[:count] == word[n - 1 :])
        key = marked[same].copy()
        for k in range(1, n):
            key *= np.uint32(0x01000193)
            key ^= marked[same + k] * np.uint32(0x9E3779B1)
        key *= np.uint32(0x85EBCA6B)
        key ^= key >> np.uint32(13)
        key *= np.uint32(0xC2B2AE35)
        owner.append(word[same])
        found.append((key >> np.uint32(32 - BITS)).astype(np.int64))
    own, got = np.concatenate(owner), np.concatenate(found)
    order = np.argsort(own, kind="stable")
    return got[order], np.concatenate([[0], np.cumsum(np.bincount(own, minlength=n_words))]).astype(np.int64)


def _weighed(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of each text: (text, code, share in the text's mean)."""
    width = max(1, len(words.distinct))
    key, count = np.unique(words.doc * width + words.codes, return_counts=True)
    doc, code = key // width, key % width
    weight = np.log2(1.0 + count)
    return doc, code, weight / (np.bincount(doc, weight, len(words.starts) - 1) + BLANKS)[doc]


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each labelled row: its subwords' buckets and their weights in the mean."""
    for batch in slices(batches):
        words = Words(_lower(texts_of(batch)))
        bucket, off = subwords(words.distinct)
        size = np.diff(off)
        doc, code, weight = _weighed(words)
        ends = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        where, share = [], []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            each = np.repeat(weight[a:b] / size[code[a:b]], size[code[a:b]])
            used, inverse = np.unique(bucket[ragged(off[code[a:b]], size[code[a:b]])], return_inverse=True)
            packed = sparse(used, np.bincount(inverse, each, len(used)))
            where.append(packed[0])
            share.append(packed[1])
        yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("_order"), pa.array(where, pa.binary()), pa.array(share, pa.binary())], names=["label", "_order", "buckets", "shares"])


def _fit(examples: list[tuple[int, bytes, bytes]], epochs: int = 12, rate: float = 2.0) -> ToxicModel:
    labels = np.array([y for y, _, _ in examples], np.int64)
    size = 1 << BITS
    if not len(labels) or labels.min() == labels.max():
        share = labels.mean() if len(labels) else 0.0
        return ToxicModel(np.zeros(size, np.float32), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    random = np.random.default_rng(5)
    table = random.normal(0, 0.1, (size, DIM))
    table_squares = np.full(size, 1e-6)
    layer, layer_squares = random.normal(0, 1.0, (DIM, 2)), np.full((DIM, 2), 1e-6)
    bias, bias_squares = np.zeros(2), np.full(2, 1e-6)
    balance = len(labels) / (2 * np.maximum(1, np.bincount(labels, minlength=2)))
    for _ in range(epochs):
        order = random.permutation(len(labels))
        for at in range(0, len(order), 32):
            some = order[at : at + 32]
            bags = [unsparse(*examples[i][1:]) for i in some]
            where, share = np.concatenate([w for w, _ in bags]), np.concatenate([s for _, s in bags])
            starts = np.concatenate([[0], np.cumsum([len(w) for w, _ in bags])])
            total = np.concatenate([np.zeros((1, DIM)), np.cumsum(table[where] * share[:, None], axis=0)])
            bag = total[starts[1:]] - total[starts[:-1]]
            out = bag @ layer + bias
            out -= out.max(1, keepdims=True)
            p = np.exp(out)
            p /= p.sum(1, keepdims=True)
            error = p
            error[np.arange(len(some)), labels[some]] -= 1
            error *= (balance[labels[some]] / len(some))[:, None]
            to_bag = error @ layer.T
            slope = bag.T @ error
            layer_squares += slope**2
            layer -= 0.1 * slope / np.sqrt(layer_squares)
            bias_squares += error.sum(0) ** 2
            bias -= 0.05 * error.sum(0) / np.sqrt(bias_squares)
            row = np.repeat(np.arange(len(some)), np.diff(starts))
            used, inverse = np.unique(where, return_inverse=True)
            step = np.stack([np.bincount(inverse, to_bag[row, d] * share, len(used)) for d in range(DIM)], 1)
            table_squares[used] += (step**2).mean(1)
            table[used] -= rate * step / np.sqrt(table_squares[used])[:, None]
    return ToxicModel((table @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def train_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicModel:
    """Learns from at most ``sample`` documents of ``labels`` (doc_id, toxic), those with the smallest hash of their id.

    Half of the sample at most goes to either class, so that a rare class is learnt too.
    """
    rows = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    one = lambda y: rows.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2)
    return _fit(examples(one(0).unionByName(one(1)), docs, _bags))


def _means(texts: pa.Array, model: ToxicModel) -> np.ndarray:
    words = Words(_lower(texts))
    if not len(words.codes):
        return np.zeros(len(texts))
    bucket, off = subwords(words.distinct)
    each = sums(model.value[bucket].astype(np.float64), off[:-1], off[1:]) / np.maximum(1, np.diff(off))
    doc, code, weight = _weighed(words)
    return np.bincount(doc, weight * each[code], len(texts))


def score_toxicity(docs: DataFrame, model: ToxicModel, passing: bool = False, threshold: float = THRESHOLD) -> DataFrame:
    """Scores all rows: (doc_id, held_out, score, predicted); ``passing`` keeps the input's columns and only rows under the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            score = shared.value.score(_means(texts_of(batch), shared.value))
            yield batch.filter(pa.array(score < threshold))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            score = shared.value.score(_means(texts_of(batch), shared.value))
            held = [x is not None and zlib.crc32(str(x).encode()) % 3 == 1 for x in batch.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(held), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    if passing:
        return docs.mapInArrow(keep, docs.schema)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tell, "doc_id long, held_out boolean, score double, predicted int")


def training_labels(labels: DataFrame) -> DataFrame:
    """Rows that may be learnt from: crc32 of the id as text, modulo 3, is not 1."""
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return score_toxicity(docs, train_toxicity(docs, training_labels(labels), sample))

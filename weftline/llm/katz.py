"""Language-model scores by Katz backoff of order ``ORDER``, learnt from and applied to whole corpora.

Tokens are words (A-Z lower-cased), then one end token a text; a start stands before the first.  The probability of
a token after a context of k - 1 tokens is evaluated recursively:

    P(w | context) = d_r * r / c(context)                    if the k-gram is seen r > 0 times in training,
                   = alpha(context) * P(w | shorter context)  if only the context is seen,
                   = P(w | shorter context)                   if the context isn't.

d_r is Katz's Good-Turing discount of that order for r up to ``LAST`` and ``HIGH`` above (Katz's own 1 would leave
contexts without mass for unseen words).  alpha is the context's left mass over the mass that the shorter context gives
to the words not seen after it, so each context's probabilities sum to 1 exactly.  P(w) is discounted likewise; what is left belongs to the one class of
unknown words.

No count is broadcast, since vocabularies grow with the corpus.  An n-gram is 64 bits of hash, and each order's table
is partitioned by ranges of them:

1. Texts become blocks of word codes (about 5 MB of text each), stored once.  A block is named by its partition and a
   number in it, two columns.
2. Each block sends its distinct n-grams of each order with training counts, packed, to the bucket of the n-gram.  There
   they are added up; counts go back to the blocks, with one block named the owner of each n-gram, and counts of counts are kept.
   A hot n-gram is one number in each block's record, so its bucket gets as many numbers as there are blocks; the start's bucket likewise.
3. Blocks with the answers give each text's sums.  Owners send what an n-gram adds to its context's masses, pre-added in
   the block, to the context's bucket, if any held-out text has the context; blocks ask there for the alphas that unseen n-grams need, each context once.
4. The alphas go back to the blocks, which give the texts' scores.

Defined cases: null and empty texts are the end token alone; without training texts (N = 0) every
probability is that of one class, score 0, and the base score is log10 of (0.1 / 0.1); repeated rows
count and are scored each; a null id is learnt from (its crc32 is that of no text) and scored; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ._arrow import Words, dropped, hash64, kept, mixed, pack, partitions, planes, released, shared_folder, slices, sums, texts_of, unpack, unplanes

ORDER = 3
LAST = 5
HIGH = 0.999
BLOCK_BYTES = 5 << 20
BUCKET_BYTES = 8 << 20
HELD = 10
FIRST_PART = 0  # the name of the first partition

START, END = hash64(["\x01 start", "\x02 end"])  # no word holds a space

_BLOCK = "part int, number int, ids binary, null_ids binary, held binary, starts binary, words binary, codes binary"
_ASK = "gram int, bucket int, part int, number int, keys binary, n binary, held binary"
_ANSWER = "kind string, gram int, bucket int, part int, number int, n binary, held binary, own binary, stats array<long>"
_SCORED = "kind string, gram int, bucket int, part int, number int, keys binary, a binary, b binary, data array<binary>"
_ALPHA = "gram int, bucket int, part int, number int, alpha binary"
_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets as ranges of the hash, so sorted hashes are sorted by bucket."""
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _dealt(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """Each bucket that sorted keys fall into, and its keys."""
    ends = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(ends)).tolist():
        yield k, slice(int(ends[k]), int(ends[k + 1]))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


def _numbers(values: np.ndarray) -> bytes:
    """Floating-point numbers of few different values: these, and which of them each is."""
    some, which = np.unique(values, return_inverse=True)
    return len(some).to_bytes(4, "little") + some.tobytes() + planes(which.astype(np.int32))


def _unnumbers(data: bytes) -> np.ndarray:
    stop = 4 + 8 * int.from_bytes(data[:4], "little")
    return np.frombuffer(data[4:stop], np.float64)[unplanes(data[stop:], np.int32)]


def _bits(values: np.ndarray) -> bytes:
    return planes(np.packbits(values))


def _unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(unplanes(data, np.uint8), count=n).astype(bool)


@dataclass
class Discounts:
    """d_r for r = 0..LAST (0 unused), and beyond."""

    table: np.ndarray

    def of(self, r: np.ndarray) -> np.ndarray:
        return self.table[np.minimum(r, LAST + 1)]

    @staticmethod
    def from_counts(counts: list[int]) -> Discounts:
        """counts[r]: how many n-grams are seen r times.  Where Good-Turing gives no proper discount, (r - 0.5) / r serves."""
        out = np.array([0.0, *((r - 0.5) / r for r in range(1, LAST + 1)), HIGH])
        n = [float(x) for x in counts]
        if n[1] and n[LAST + 1]:
            tail = (LAST + 1) * n[LAST + 1] / n[1]
            for r in range(1, LAST + 1):
                if n[r] and tail < 1:
                    d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail)
                    if 0 < d < 1:
                        out[r] = d
        return Discounts(out)


@dataclass
class Stats:
    tokens: int
    vocabulary: int
    texts: int
    orders: list[Discounts]  # of n-grams of 1, 2, ... tokens
    unknown: float  # the probability of the class of unknown words

    def word(self, c: np.ndarray) -> np.ndarray:
        """P of words seen c times."""
        return np.where(c > 0, self.orders[0].of(c) * c / max(1, self.tokens), self.unknown)


def _encode(docs: DataFrame) -> DataFrame:
    first = FIRST_PART

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = first + (context.partitionId() if context else 0)
        for number, batch in enumerate(slices(batches, limit=BLOCK_BYTES)):
            words = Words(pc.ascii_lower(texts_of(batch)))
            hashes = np.append(words.hashes(), END)
            order = np.argsort(hashes)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            n = batch.num_rows
            starts = words.starts + np.arange(n + 1)
            codes = np.empty(int(starts[-1]), np.int32)
            ends = starts[1:] - 1
            inner = np.ones(len(codes), bool)
            inner[ends] = False
            codes[inner] = place[words.codes]
            codes[ends] = place[-1]
            ids = batch.column("doc_id").to_pylist()
            held = np.array([x is not None and zlib.crc32(str(x).encode()) % HELD == 0 for x in ids], bool)
            row = (part, number, planes(np.array([x or 0 for x in ids], np.int64)), _bits(np.array([x is None for x in ids], bool)), _bits(held), planes(starts), pack(hashes[order]), planes(codes))
            yield _batch([row], _BLOCK)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, _BLOCK)


class Grams:
    """The distinct n-grams of one order in a block: sorted keys, a token each ends at, and the n-gram that ends at each token (-1: none)."""

    def __init__(self, keys: np.ndarray, valid: np.ndarray):
        at = np.flatnonzero(valid)
        order = np.argsort(keys[at])
        at = at[order]
        ordered = keys[at]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(at) else np.zeros(0, np.int64)
        self.keys, self.token = ordered[first], at[first]
        self.of_token = np.full(len(keys), -1, np.int64)
        self.of_token[at] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(at))))

    def sums(self, tokens: np.ndarray) -> np.ndarray:
        """A number of each token, added up by n-gram."""
        used = self.of_token >= 0
        return np.bincount(self.of_token[used], tokens[used], len(self.keys)).astype(np.int64)


class Block:
    """A stored block with its n-grams of at least ``least`` tokens; ``grams[k - 1]`` are those of k tokens."""

    def __init__(self, row: dict, order: int, least: int = 1):
        self.part, self.number = row["part"], row["number"]
        self.ids = unplanes(row["ids"], np.int64)
        n = len(self.ids)
        self.null_ids, self.held = _unbits(row["null_ids"], n), _unbits(row["held"], n)
        self.starts = unplanes(row["starts"], np.int64)
        word = unpack(row["words"])[unplanes(row["codes"], np.int32)]
        self.text = np.repeat(np.arange(n), np.diff(self.starts))
        self.place = np.arange(len(word)) - self.starts[self.text]
        self.before = np.arange(len(word)) - 1  # the token at which a context ends; not used where none does
        keys, self.grams = word, []
        for k in range(1, order + 1):
            if k > 1:
                context = np.where(self.place > 0, keys[self.before], START)
                keys = mixed(context * np.uint64(0x9E3779B97F4A7C15) + word)
            self.grams.append(Grams(keys, self.place + 2 >= k) if k >= least else None)

    def training(self) -> np.ndarray:
        return ~self.held[self.text]


def _spread(buckets: int, gram: int) -> int:
    """Buckets of an order's table; words are few."""
    return max(1, buckets // 8) if gram == 1 else buckets


def _ask(blocks: DataFrame, buckets: int, order: int) -> DataFrame:
    """The n-grams of ``order`` tokens of each block."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block = Block(batch.slice(k, 1).to_pylist()[0], order, order)
                training, own = block.training(), block.grams[order - 1]
                n, held = own.sums(training), own.sums(~training) > 0
                yield _batch([(order, bucket, block.part, block.number, pack(own.keys[s]), planes(n[s]), _bits(held[s])) for bucket, s in _dealt(own.keys, _spread(buckets, order))], _ASK)

    return blocks.mapInArrow(ask, _ASK)


def _answer(table: pa.Table) -> pa.Table:
    """Counts of one bucket of an order: answers to the blocks, and counts of counts."""
    table = table.sort_by([("part", "ascending"), ("number", "ascending")])
    gram, bucket = table["gram"][0].as_py(), table["bucket"][0].as_py()
    each = [unpack(x) for x in table["keys"].to_pylist()]
    sizes = np.array([len(x) for x in each])
    key = np.concatenate(each)
    n = np.concatenate([unplanes(x, np.int64) for x in table["n"].to_pylist()])
    held = np.concatenate([_unbits(x, k) for x, k in zip(table["held"].to_pylist(), sizes, strict=True)])
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    at = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    total, asked = np.add.reduceat(n[order], at), np.logical_or.reduceat(held[order], at)
    own = np.zeros(len(key), bool)
    own[order[at]] = True
    back = np.empty(len(key), np.int64)
    back[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(key))))
    of_key, asked_key = total[back], asked[back]
    rows, ends = [], np.cumsum(sizes)
    for part, number, a, b in zip(table["part"].to_pylist(), table["number"].to_pylist(), ends - sizes, ends, strict=True):
        rows.append(("a", gram, bucket, part, number, planes(of_key[a:b]), _bits(asked_key[a:b]), _bits(own[a:b]), None))
    end = int(total[ordered[at] == END].sum()) if gram == 1 else 0
    counts = np.bincount(np.minimum(total, LAST + 2), minlength=LAST + 3)[: LAST + 2].tolist()
    rows.append(("s", gram, bucket, None, None, None, None, None, [int(total.sum()), int((total > 0).sum()), end, *counts]))
    return pa.Table.from_batches([_batch(rows, _ANSWER)])


def _stats(answers: DataFrame, order: int) -> Stats:
    """Scalars of the whole corpus: a row of sums for each order."""
    width = 3 + LAST + 2
    rows = answers.where("kind = 's'").groupBy("gram").agg(*[F.sum(F.col("stats")[k]).alias(f"s{k}") for k in range(width)]).collect()
    got = {r["gram"]: [int(x) for x in r[1:]] for r in rows}
    of = [got.get(k, [0] * width) for k in range(1, order + 1)]
    orders = [Discounts.from_counts(x[3:]) for x in of]
    tokens, vocabulary, texts, *counts = of[0]
    known = sum(orders[0].table[r] * r * counts[r] for r in range(1, LAST + 1))
    above = tokens - sum(r * counts[r] for r in range(1, LAST + 1))
    seen = (known + HIGH * above) / tokens if tokens else 0.0
    return Stats(tokens, vocabulary, texts, orders, 1.0 - seen)


def _score(left: pa.Table, right: pa.Table, stats: Stats, buckets: int, order: int) -> pa.Table:
    """Of a block: sums of each text with what alphas it needs (kind b), questions for alphas (q), and masses of owned n-grams (m)."""
    rows: list[tuple] = []
    answers = right.sort_by("bucket").to_pylist()
    for row in left.to_pylist():
        block = Block(row, order)
        mine = [[r for r in answers if r["gram"] == k] for k in range(1, order + 1)]
        count = [np.concatenate([unplanes(r["n"], np.int64) for r in own]) if own else np.zeros(0, np.int64) for own in mine]
        sizes = [[len(unplanes(r["n"], np.int64)) for r in own] for own in mine]
        flags = lambda name: [np.concatenate([_unbits(r[name], n) for r, n in zip(own, size, strict=True)]) if own else np.zeros(0, bool) for own, size in zip(mine, sizes, strict=True)]  # noqa: B023, E731
        asked, owned = flags("held"), flags("own")
        # of the n-gram of each order that ends at each token; 0 where none does
        seen = [np.where(g.of_token >= 0, c[np.maximum(g.of_token, 0)], 0) for g, c in zip(block.grams, count, strict=True)]
        first, before = block.place == 0, np.maximum(block.before, 0)
        context_n = lambda k: np.where(first, stats.texts, seen[k - 2][before])  # noqa: B023, E731
        p_word = stats.word(seen[0])
        log, left_open, data = np.zeros(len(block.text)), np.ones(len(block.text), bool), []
        for k in range(order, 1, -1):
            grams, context = block.grams[k - 1], context_n(k)
            here = left_open & (grams.of_token >= 0)
            hit = here & (seen[k - 1] > 0)
            r = seen[k - 1][hit]
            log[hit] = np.log10(stats.orders[k - 1].of(r) * r / context[hit])
            left_open &= ~hit
            data.append(_questions(rows, block, stats, buckets, k, np.flatnonzero(here & ~hit & (context > 0)), context, seen))
            _masses(rows, block, stats, buckets, k, seen, asked, owned)
        log[left_open] = np.log10(p_word[left_open])
        a, b = block.starts[:-1], block.starts[1:]
        base = np.log10((seen[0] + 0.1) / (stats.tokens + 0.1 * (stats.vocabulary + 1)))
        sums_ = [np.diff(block.starts), sums((seen[0] > 0).astype(np.int64), a, b), sums(base, a, b), sums(log, a, b)]
        packed = [planes(block.ids), _bits(block.null_ids), _bits(block.held), *(planes(x) for x in sums_), *(x for own in data for x in own)]
        rows.append(("b", None, None, block.part, block.number, None, None, None, packed))
    return pa.Table.from_batches([_batch(rows, _SCORED)])


def _questions(rows: list[tuple], block: Block, stats: Stats, buckets: int, k: int, tokens: np.ndarray, context_n: np.ndarray, seen: list[np.ndarray]) -> list[bytes]:
    """Asks for the alphas of the contexts of ``tokens``, each once; which context and text these are, and how often, stays in the block."""
    start = block.place[tokens] == 0
    lower, before = block.grams[k - 2], np.maximum(tokens - 1, 0)
    key = np.where(start, START, lower.keys[np.maximum(lower.of_token[before], 0)] if len(lower.keys) else START)
    order = np.argsort(key, kind="stable")
    key, tokens, start, before = key[order], tokens[order], start[order], before[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    shorter = np.where(start, stats.tokens, stats.tokens if k == 2 else seen[k - 3][before])[at]
    for bucket, s in _dealt(key[at], buckets):
        rows.append(("q", k, bucket, block.part, block.number, pack(key[at][s]), planes(context_n[tokens[at[s]]]), planes(shorter[s]), None))
    which = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(key))))
    entry, n = np.unique(which * len(block.ids) + block.text[tokens], return_counts=True)
    return [planes(entry // len(block.ids)), planes((entry % len(block.ids)).astype(np.int32)), planes(n.astype(np.int32))]


def _masses(rows: list[tuple], block: Block, stats: Stats, buckets: int, k: int, seen: list[np.ndarray], asked: list[np.ndarray], owned: list[np.ndarray]) -> None:
    """What the block's own n-grams of order k add to the discounted mass of their contexts, and to what the shorter contexts give the same words."""
    grams, lower = block.grams[k - 1], block.grams[k - 2]
    token = grams.token[owned[k - 1]]
    token = token[seen[k - 1][token] > 0]
    start = block.place[token] == 0
    context = lower.of_token[np.maximum(token - 1, 0)]
    some = start | asked[k - 2][context]
    token, start, context = token[some], start[some], context[some]
    key = np.where(start, START, lower.keys[context])
    order = np.argsort(key, kind="stable")
    key, token = key[order], token[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    if not len(at):
        return
    mass = lambda j: np.add.reduceat(stats.orders[j].of(seen[j][token]) * seen[j][token], at)
    long, short = mass(k - 1), mass(k - 2)
    for bucket, s in _dealt(key[at], buckets):
        rows.append(("m", k, bucket, block.part, block.number, pack(key[at][s]), _numbers(long[s]), _numbers(short[s]), None))


def _alphas(asked: pa.Table, masses: pa.Table) -> pa.Table:
    """log10 of alpha for each context asked for, in the blocks' order."""
    rows: list[tuple] = []
    if asked.num_rows and masses.num_rows:
        masses = masses.sort_by([("part", "ascending"), ("number", "ascending")])  # reruns add in the same order
        key = np.concatenate([unpack(x) for x in masses["keys"].to_pylist()])
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        at = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        long, short = (np.add.reduceat(np.concatenate([_unnumbers(x) for x in masses[c].to_pylist()])[order], at) for c in ("a", "b"))
        for r in asked.to_pylist():
            own = np.searchsorted(ordered[at], unpack(r["keys"]))
            left = 1 - long[own] / unplanes(r["a"], np.int64)
            rest = 1 - short[own] / unplanes(r["b"], np.int64)
            rows.append((r["gram"], r["bucket"], r["part"], r["number"], planes(np.log10(np.maximum(left, 1e-12) / np.maximum(rest, 1e-12)))))
    return pa.Table.from_batches([_batch(rows, _ALPHA)])


def _texts(left: pa.Table, right: pa.Table, tokens: int, order: int) -> pa.Table:
    """Rows of a block's texts."""
    out: list[tuple] = []
    answers = right.sort_by("bucket").to_pylist()
    for row in left.to_pylist():
        ids, null_ids, held, n_tokens, known, base, score, *data = row["data"]
        ids, n_tokens, known = (unplanes(x, np.int64) for x in (ids, n_tokens, known))
        base, score = unplanes(base, np.float64), unplanes(score, np.float64)
        for j, k in enumerate(range(order, 1, -1)):
            which, text, n = (unplanes(x, kind) for x, kind in zip(data[3 * j : 3 * j + 3], (np.int64, np.int32, np.int32), strict=True))
            if len(which):
                alpha = np.concatenate([unplanes(r["alpha"], np.float64) for r in answers if r["gram"] == k])
                score = score + np.bincount(text, alpha[which] * n, len(ids))
        null = _unbits(null_ids, len(ids))
        out += zip([None if x else i for i, x in zip(ids.tolist(), null, strict=True)], _unbits(held, len(ids)).tolist(), n_tokens.tolist(), known.tolist(), [tokens] * len(ids), base.tolist(), score.tolist(), strict=True)
    return pa.Table.from_batches([_batch(out, _OUT)])


def katz_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    blocks = kept(_encode(docs), folder, "blocks")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(partitions(spark), -(-size // BUCKET_BYTES))
    tables = []
    for k in range(1, order + 1):  # one order after another, so that one table's records are on the way at a time
        tables.append(kept(_ask(blocks, buckets, k).groupBy("gram", "bucket").applyInArrow(_answer, _ANSWER), folder, f"answers-{k}"))
        released(spark)
    answers = functools.reduce(DataFrame.unionByName, tables)
    stats = _stats(answers, order)

    def score(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return _score(left, right, stats, buckets, order)

    back = answers.where("kind = 'a'").select("gram", "bucket", "part", "number", "n", "held", "own")
    scored = kept(blocks.groupBy("part", "number").cogroup(back.groupBy("part", "number")).applyInArrow(score, _SCORED), folder, "scored")
    released(spark)
    for name in ("blocks", *(f"answers-{k}" for k in range(1, order + 1))):
        dropped(spark, folder, name)

    def alphas(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return _alphas(left, right)

    names = ("gram", "bucket", "part", "number", "keys", "a", "b")
    some = lambda kind: scored.where(F.col("kind") == kind).select(*names).toDF(*names)  # noqa: E731  columns of their own on either side
    answered = some("q").groupBy("gram", "bucket").cogroup(some("m").groupBy("gram", "bucket")).applyInArrow(alphas, _ALPHA)
    tokens = stats.tokens

    def texts(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return _texts(left, right, tokens, order)

    return scored.where("kind = 'b'").select("part", "number", "data").groupBy("part", "number").cogroup(answered.groupBy("part", "number")).applyInArrow(texts, _OUT)

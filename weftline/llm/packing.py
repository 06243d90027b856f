"""Best-fit packing by linear grouping.

Documents become token ids plus a final id 0; only those longer than a sequence are cut.  Only
lengths matter to the packing, so the driver sees a histogram of at most ``CAPACITY`` lengths,
whatever the input:

1. Large pieces (over ``CAPACITY // SMALL``) are dealt, in order of length, into ``GROUPS`` groups of
   equal cardinality; each length is rounded up to the longest of its group.
2. Configurations (how many of each group's size share a sequence) are optimised as a linear
   programme by column generation; its basis has at most one configuration for each group.  Whole
   multiples are used; what is left over goes on with the small pieces.
3. Actual pieces replace the rounded sizes.  Sequences alike are kept as runs (first sequence,
   count, free space), so the work follows the number of lengths and not of documents.
4. The rest is placed from long to short, each into the fullest run in which it fits.

The plan is a list of runs (length, first rank, first sequence, offset), of a size bounded by
lengths times configurations.  Each piece has a rank among those of its length, which comes
from counts by (length, salt) and row numbers within; a length that a third of all pieces share
is many salts.  A piece finds its run by binary search.

Defined cases: a null or empty text is the single id 0; repeated rows are packed each; ties in
rank are broken by doc_id, piece and ids; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ._arrow import Words, kept, ragged, shared_folder, slices, texts_of
from .tokens import cached_words

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
GROUPS = 160
SMALL = 4
SALT_ROWS = 100_000
SLICE_BYTES = 10 << 20  # a larger slice has fewer words new to it


def encode_words(texts: pa.Array, name: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and the offsets of each.

    The vocabulary's tokenizer drops white space and never joins across it, so distinct words
    are encoded once.  Recent words stay in a bounded cache of the worker.
    """
    words = Words(texts)
    flat, first, size = cached_words(name).encode(words.distinct.to_pylist(), np.bincount(words.codes, minlength=len(words.distinct)))
    each = size[words.codes]
    ends = np.concatenate([[0], np.cumsum(each)])[words.starts]
    return flat[ragged(first[words.codes], each)], ends


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, name: str = VOCABULARY) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE_BYTES):
            ids, off = encode_words(texts_of(batch), name)
            rows: list[list] = [[], [], [], [], []]
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                own = np.append(ids[a:b], np.uint32(0)).astype("<u4")
                for k, start in enumerate(range(0, len(own), capacity)):
                    part = own[start : start + capacity]
                    for column, x in zip(rows, (doc, k, start, len(part), zlib.crc32(part.tobytes())), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often each is used, from the linear programme min sum x, A x >= demand, by column generation."""
    n = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    x = demand / np.diag(basis)
    for _ in range(60 * n):
        price = np.linalg.solve(basis.T, np.ones(n))
        column = _best_column(sizes, price, capacity)
        if column @ price <= 1 + 1e-7:
            break
        direction = np.linalg.solve(basis, column.astype(float))
        ratio = np.where(direction > 1e-9, np.maximum(x, 0) / np.where(direction > 1e-9, direction, 1), np.inf)
        leave = int(np.argmin(ratio))
        x = x - ratio[leave] * direction
        x[leave] = ratio[leave]
        basis[:, leave] = column
    return [(basis[:, k].astype(np.int64), float(x[k])) for k in range(n) if x[k] > 1e-9]


def _best_column(sizes: np.ndarray, price: np.ndarray, capacity: int) -> np.ndarray:
    """The most valuable configuration: a knapsack by number of pieces, over all capacities at once."""
    value, picks = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        best, pick = value.copy(), np.full(capacity + 1, -1)
        for k, (s, p) in enumerate(zip(sizes, price, strict=True)):
            if p <= 0:
                continue
            better = value[: capacity + 1 - s] + p > best[s:] + 1e-12
            best[s:][better] = (value[: capacity + 1 - s] + p)[better]
            pick[s:][better] = k
        picks.append(pick)
        if (pick < 0).all():
            break
        value = best
    column, left = np.zeros(len(sizes), np.int64), capacity
    for pick in reversed(picks):
        k = pick[left]
        if k >= 0:
            column[k] += 1
            left -= int(sizes[k])
    return column


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> tuple[list[tuple[int, int, int, int]], int]:
    """Runs (length, first rank, first sequence, offset) and the number of sequences, for so many pieces of each length."""
    left = {n: c for n, c in sorted(counts.items(), reverse=True) if c}
    rank = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int]] = []
    open_runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free space: (first sequence, count)
    free_sizes: list[int] = []
    made = 0

    def put(length: int, first: int, count: int, free: int) -> None:
        runs.append((length, rank[length], first, capacity - free))
        rank[length] += count
        left[length] -= count

    def offer(first: int, count: int, free: int) -> None:
        if free and count:
            if not open_runs[free]:
                insort(free_sizes, free)
            heapq.heappush(open_runs[free], (first, count))

    if full := left.get(capacity, 0):
        put(capacity, 0, full, capacity)
        made += full
    large = [(n, c) for n, c in left.items() if n > capacity // small and c]
    total = sum(c for _, c in large)
    members: list[list[list[int]]] = []  # of each group: [length, count], long ones first
    if total:
        share, members = -(-total // groups), [[]]
        room = share
        for n, c in large:
            while c:
                if not room:
                    members.append([])
                    room = share
                take = min(c, room)
                members[-1].append([n, take])
                c, room = c - take, room - take
        sizes = np.array([g[0][0] for g in members])
        merged: dict[int, int] = {}  # groups of one and the same rounded size are one size
        kind = np.array([merged.setdefault(int(s), len(merged)) for s in sizes])
        joined: list[list[list[int]]] = [[] for _ in merged]
        for k, g in zip(kind, members, strict=True):
            joined[k].extend(g)
        members = joined
        demand = np.array([sum(c for _, c in g) for g in members])
        for column, times in sorted(configurations(np.array(list(merged)), demand, capacity), key=lambda x: -x[1]):
            times = int(times + 1e-6)
            for k, need in enumerate(column):
                if need:
                    times = min(times, sum(c for _, c in members[k]) // int(need))
            if not times:
                continue
            bins = [(made, times, capacity)]
            made += times
            for k, need in enumerate(column):
                for _ in range(int(need)):
                    after = []
                    for first, count, free in bins:
                        while count:
                            n, c = members[k][0]
                            take = min(c, count)
                            put(n, first, take, free)
                            after.append((first, take, free - n))
                            first, count = first + take, count - take
                            members[k][0][1] -= take
                            if not members[k][0][1]:
                                members[k].pop(0)
                    bins = after
            for b in bins:
                offer(*b)
    for n in sorted(left, reverse=True):
        while left[n]:
            k = bisect_left(free_sizes, n)
            if k == len(free_sizes):
                per = capacity // n
                whole, rest = divmod(left[n], per)
                for count, depth in ((whole, per), (1, rest)):
                    if count and depth:
                        for d in range(depth):
                            put(n, made, count, capacity - d * n)
                        offer(made, count, capacity - depth * n)
                        made += count
                continue
            free = free_sizes[k]
            first, count = heapq.heappop(open_runs[free])
            if not open_runs[free]:
                free_sizes.pop(k)
            depth = min(free // n, -(-left[n] // count))
            if depth > 1 and left[n] < depth * count:
                depth -= 1
            take = min(left[n], count)
            if depth > 1:
                take = count
            for d in range(depth):
                put(n, first, take, free - d * n)
            offer(first, take, free - depth * n)
            offer(first + take, count - take, free)
    return runs, made


def pack(docs: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, name: str = VOCABULARY) -> DataFrame:
    spark = docs.sparkSession
    pieces = kept(pieces_of(docs, capacity, name), shared_folder(spark), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    runs, _ = pack_histogram(counts, capacity, groups)
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 4)
    shared = spark.sparkContext.broadcast(table)  # bounded by lengths and configurations
    salts = max(1, -(-max(counts.values(), default=1) // SALT_ROWS))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    bases = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    bases = bases.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).select("length", "salt", "base")
    numbered = salted.withColumn("nth", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = numbered.join(bases, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("nth") - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        keys = (t[:, 0] << np.int64(44)) + t[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << np.int64(44)) + rank, side="right") - 1
            sequence = t[at, 2] + rank - t[at, 1]
            out = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(sequence), pa.array(t[at, 3])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*columns, "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

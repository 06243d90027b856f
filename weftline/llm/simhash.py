"""Near-duplicates by SimHash: 64-bit fingerprints within four differing bits, found through Golay-coded segments.

A document's fingerprint has bit b set if bit b is set in over half of the hashes of its word shingles.  Equal
fingerprints form a class, represented by the fingerprint itself; copies are never expanded.

1. **Keys.**  A fingerprint is cut into three segments of 22, 21 and 21 bits.  A segment counts as a word of 23 bits
   and is decoded with the perfect binary Golay code: its *indices* are the messages of all codewords within four bits, one
   where a codeword is within two and six otherwise.  Two words that differ in at most two bits share an index: a word between
   them is within one bit of both and within three of some codeword.  Of four errors in three segments, either one segment has none, so
   another has at most two: key *(exact segment, index of another)*; or all have one or two and at most one has two: key
   *(index of one, an exact half of either other)*.  So all pairs within four bits share one of 18 kinds of keys, of which each has at most six.
2. **First links.**  A key's fingerprints are compared with the smallest of them.
3. **What is left** are keys whose fingerprints lie in several components still.  In each, the fingerprints outside of its most
   frequent component meet all of them, in blocks of bounded size, so no task has a whole group; pairs of one component are left
   out, and only links that connect something new are emitted.
4. The components of all links, with the smallest id of each class, are the result.  Classes with over a thousandth of all rows,
   fewer than a thousand, are joined by broadcast; no other key has more rows than that.

Defined cases: null and empty texts, and those without words, have fingerprint zero, which is linked like any other; texts
with fewer words than a shingle have one shingle of all words; repeated rows give a row each; a null id
takes part, and its component has the smallest id that is not null (null if there is none); extra columns are ignored by
the report and pass through ``deduplicate``.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ._arrow import kept, partitions, shared_folder, slices, texts_of
from .components import components

SHINGLE = 4
SEED = 42
DISTANCE = 4
PIECE_BYTES = 1 << 20
BLOCK = 4096
KEY_ROWS = 50_000  # fingerprints of a task that makes keys, which are a hundred times as many
HOT_SHARE = 1000
#: Generator polynomial of the Golay code of 23 bits: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0xC75
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainders modulo the generator."""
    out = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        out ^= np.where(out >> bit & 1, GENERATOR << (bit - 11), 0)
    return out


def _errors() -> np.ndarray:
    """For each of the 2,048 syndromes, six errors of at most four bits that lead to codewords; -1 where there are fewer."""
    out, used = np.full((2048, 6), -1, np.int64), np.zeros(2048, np.int64)
    for weight in range(5):
        words = np.array([sum(1 << b for b in bits) for bits in itertools.combinations(range(23), weight)], np.int64)
        for word, s in zip(words, _syndrome(words), strict=True):
            out[s, used[s]] = word
            used[s] += 1
    return out


ERRORS = _errors()


def indices(words: np.ndarray) -> np.ndarray:
    """Messages of all codewords within four bits of each word of 23 bits: six columns, -1 where there are fewer."""
    error = ERRORS[_syndrome(words)]
    return np.where(error < 0, -1, (words.astype(np.int64)[:, None] ^ error) >> 11)


def keys_of(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the fingerprint, key) for all keys of all fingerprints; two within four bits share one at least."""
    x = fingerprints.astype(np.uint64)
    part = [((x >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    index = [indices(p) for p in part]
    halves = [(p & 0x7FF, p >> 11) for p in part]
    tables = [(part[i], index[j]) for i, j in itertools.permutations(range(3), 2)]
    for i in range(3):
        j, k = (s for s in range(3) if s != i)
        tables += [(halves[j][a] | halves[k][b] << 11, index[i]) for a in (0, 1) for b in (0, 1)]
    owners, keys = [], []
    for tag, (exact, near) in enumerate(tables):
        row, column = np.nonzero(near >= 0)
        owners.append(row)
        keys.append(tag << 40 | exact[row] << 12 | near[row, column])
    return np.concatenate(owners), np.concatenate(keys)


def _pieces(data: bytes) -> Iterator[bytes]:
    """The text in pieces that end in white space, so that a huge one is never held as words."""
    at = 0
    while len(data) - at > PIECE_BYTES:
        end = max(data.rfind(c, at, at + PIECE_BYTES) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if end < at:  # one word longer than a piece
            found = [p for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (p := data.find(c, at + PIECE_BYTES)) >= 0]
            end = min(found, default=len(data) - 1)
        yield data[at : end + 1]
        at = end + 1
    yield data[at:]


def _bits(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each bit."""
    return np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits: those set in over half of the shingles' hashes."""
    digest = xxhash.xxh64_intdigest
    held: list[bytes] = []
    total, counts = 0, np.zeros(64, np.int64)
    for piece in _pieces((text or "").encode().lower()):
        words = held + piece.split()
        if len(words) >= shingle:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            hashes = [digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
            counts += _bits(hashes)
            total += len(hashes)
            held = words[len(words) - shingle + 1 :]
        else:
            held = words
    if not total:
        return digest(b" ".join(held), seed) if held else 0
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) for each row; fp is the fingerprint as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = np.array([fingerprint(t.as_py(), shingle, seed) for t in texts_of(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _keys(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), BLOCK):
                some = fp[at : at + BLOCK]
                owner, key = keys_of(some.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(some[owner])], names=["key", "fp"])

    tasks = max(partitions(classes.sparkSession), -(-classes.count() // KEY_ROWS))
    return classes.select("fp").repartition(tasks, "fp").mapInArrow(run, "key long, fp long")


def _differ(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows (key, fp, known) of keys with several components, at all places (key, i, j, side) where their blocks meet.

    Blocks under ``first`` hold what is not in the key's most frequent component, and meet all blocks; the others hold that
    component and don't meet each other.
    """
    most = rows.groupBy("key", "known").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "known")).alias("m"), F.sum("n").alias("n"))
    of_n = lambda n: F.ceil(n / BLOCK).cast("int")
    per = most.select("key", F.col("m.known").alias("main"), of_n(F.col("n") - F.col("m.n")).alias("first"), of_n(F.col("m.n")).alias("rest"))
    placed = rows.join(per, "key").withColumn("h", F.xxhash64("fp", F.lit(3)))
    block = F.when(F.col("known") == F.col("main"), F.col("first") + F.pmod("h", "rest")).otherwise(F.pmod("h", "first")).cast("int")
    placed = placed.withColumn("block", block)
    other = F.when(F.col("block") < F.col("first"), F.sequence(F.lit(0), F.col("first") + F.col("rest") - 1)).otherwise(F.sequence(F.lit(0), F.col("first") - 1))
    placed = placed.withColumn("other", F.explode(other))
    side = (F.col("block") > F.col("other")).cast("int")
    return placed.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), side.alias("side"), "fp", "known")


def links_in(place: np.ndarray, across: np.ndarray, side: np.ndarray, fp: np.ndarray, known: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links among rows sorted by ``place``, between rows of different components only, and only as many as connect these.

    Where a place has two sides, ``across``, rows of one side are not compared.  All places are compared at once, row i with row i + d for growing d.
    """
    _, label = np.unique(known, return_inverse=True)
    root = np.arange(label.max() + 1 if len(label) else 0)

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = int(root[k])
        return k

    out = []
    ends = np.searchsorted(place, place, side="right")
    reach = ends - np.arange(len(place)) - 1  # later rows at the same place
    at = np.flatnonzero(reach >= 1)
    x = fp.astype(np.int64).view(np.uint64)
    d = 1
    while len(at):
        b = at + d
        near = (np.bitwise_count(x[at] ^ x[b]) <= distance) & (root[label[at]] != root[label[b]]) & (~across[at] | (side[at] != side[b]))
        for k in np.flatnonzero(near):
            u, v = find(int(label[at[k]])), find(int(label[b[k]]))
            if u != v:
                root[max(u, v)] = min(u, v)
                out.append((int(fp[at[k]]), int(fp[b[k]])))
        if near.any():
            while (root[root] != root).any():
                root = root[root]
        d += 1
        at = at[reach[at] >= d]
    return out


def _rest(met: DataFrame, star: DataFrame, folder: str, distance: int) -> DataFrame:
    """Links among fingerprints that share a key and are not in one component of the links so far."""
    spark = met.sparkSession
    known = components(star, folder, "star").select(F.col("node").alias("fp"), "component")
    rows = met.select("key", "fp").join(known, "fp", "left").select("key", "fp", F.coalesce("component", "fp").alias("known"))
    rows = kept(rows, folder, "known")
    mixed = rows.groupBy("key").agg(F.min("known").alias("low"), F.max("known").alias("high")).where("low < high").select("key")
    placed = _blocks(kept(rows.join(mixed, "key", "left_semi"), folder, "mixed"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            rows = [] if batch is None else [np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "i", "j", "side", "fp", "known")])]
            table = np.concatenate(([held] if held is not None else []) + rows, axis=1) if held is not None or rows else np.zeros((6, 0), np.int64)
            new = np.concatenate([[True], (table[:3, 1:] != table[:3, :-1]).any(0)]) if table.shape[1] else np.zeros(0, bool)
            end = table.shape[1] if batch is None else int(np.flatnonzero(new)[-1])  # the last place goes on in the next batch
            held, done = table[:, end:], table[:, :end]
            if not done.shape[1]:
                continue
            place = np.cumsum(new[:end]) - 1
            found = links_in(place, done[1] != done[2], done[3], done[4], done[5], distance)
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    dealt = placed.repartition(partitions(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "fp")
    return dealt.mapInArrow(compare, "a long, b long")


def simhash_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, seed: int = SEED) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row; fingerprints at ``distance`` (four at most) or fewer differing bits are linked."""
    if not 0 <= distance <= 4:
        raise ValueError("the keys are made for at most four differing bits")
    folder = shared_folder(docs.sparkSession)
    prints = kept(fingerprints(docs, shingle, seed), folder, "prints")
    classes = kept(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), folder, "classes")
    keys = kept(_keys(classes), folder, "keys")
    shared = keys.groupBy("key").agg(F.min("fp").alias("hub"), F.max("fp").alias("last")).where("hub < last").select("key", "hub")
    met = kept(keys.join(shared, "key"), folder, "met")
    star = kept(met.where((F.col("fp") != F.col("hub")) & (_differ(F.col("fp"), F.col("hub")) <= distance)).select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct(), folder, "star")
    more = kept(_rest(met, star, folder, distance), folder, "more")
    linked = components(star.unionByName(more), folder, "linked").select(F.col("node").alias("fp"), "component")
    of_class = classes.join(linked, "fp", "left").select("fp", "first", "n", F.coalesce("component", "fp").alias("component"))
    least = of_class.groupBy("component").agg(F.min("first").alias("component_id"))
    named = kept(of_class.join(least, "component").select("fp", "n", "component_id"), folder, "named")
    floor = math.ceil(prints.count() / HOT_SHARE)
    hot = F.broadcast(named.where(F.col("n") > floor).select("fp", "component_id"))
    cold = named.where(F.col("n") <= floor).select("fp", "component_id")
    out = prints.join(hot, "fp").unionByName(prints.join(hot.select("fp"), "fp", "left_anti").join(cold, "fp"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, shingle: int = 5, distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; those without an id stay."""
    ids = simhash_duplicates(docs, shingle, distance).where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    return docs.join(ids, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))

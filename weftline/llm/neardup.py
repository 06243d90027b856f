"""Near-duplicates by SetSketch registers, banded, estimated by likelihood, then verified on full sets.

A document's set: hashes of all distinct ``SHINGLE``-word shingles (A-Z lower-cased), or of the whole
sequence if it has fewer words.  Its sketch has ``REGISTERS`` registers: register i is the truncated
logarithm, to base ``BASE``, of the smallest of the set's exponential variates for i, so registers are
minima, mergeable, and equal with a probability near the Jaccard similarity.

1. Documents with equal sets (128 bits of the set's hashes and its size) form a class, represented by
   the smallest id; copies are not expanded.
2. Bands of ``ROWS`` registers are keys.  Each representative is tied to the smallest one with the same
   key.  The components of these ties are candidate clusters: two sets that share any band are in one
   cluster, also when neither is the smallest.  A pair with similarity 0.8 shares none of the bands with
   a probability of about 2e-6.
3. Within a cluster of at most ``BLOCK_SETS`` sets all pairs count.  Of a larger one, the ties themselves come first: each set
   against the smallest with the same band.  That joins most of a group of copies with as many comparisons as there are ties.
   What is left are bands whose sets are in different components still; in each, the sets outside of its most frequent component
   are compared with all, in blocks, and the many inside are not compared with each other.  A pair that shares several
   bands is compared in the first one only.  A task has one pair of
   blocks, of bounded size, so a cluster may have any share of the rows.  In a task, pairs that a joint
   maximum-likelihood estimate from the registers puts far below the threshold (five standard errors) are
   left; the others are confirmed or refuted by exact intersections of full sets.  Pairs already linked
   through others need no link of their own.
4. The components of confirmed links, with the classes' members, are the result.

Defined cases: null and empty texts, or texts without words, have no set (size 0) and are linked with
nothing; repeated rows with the same id are one document as to links and give a row each; a null id is
linked with nothing and kept; extra columns are ignored by the report and pass through ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ._arrow import MIX, Words, kept, mixed, partitions, rolled, shared_folder, slices, texts_of
from .components import components

SHINGLE = 4
PERCENT = 80
BASE = 1.001
ROWS = 6
BANDS = 42
REGISTERS = ROWS * BANDS
BLOCK_SETS = 256
BLOCK_HASHES = 1_000_000
BUCKET_KEYS = 4_000_000
SPREAD = 5.0
HOT_SHARE = 1000

_SEEDS = mixed(np.arange(1, REGISTERS + 1, dtype=np.uint64) * MIX) | np.uint64(1)


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in a row, and the offsets of each."""
    words = Words(pc.ascii_lower(texts))
    hashes = words.hashes()[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    n = len(texts)
    counts = words.counts
    grams = rolled(hashes, shingle, 9)
    doc = words.doc
    full = np.flatnonzero(doc[: len(grams)] == doc[shingle - 1 :]) if len(grams) else np.zeros(0, np.int64)
    key, owner = grams[full], doc[full]
    short = np.flatnonzero((counts > 0) & (counts < shingle))
    if len(short):
        whole = [rolled(hashes[a : a + c], int(c), 9)[0] ^ np.uint64(c) for a, c in zip(words.starts[short], counts[short], strict=True)]
        key, owner = np.concatenate([key, np.array(whole, np.uint64)]), np.concatenate([owner, short])
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    key, owner = key[first], owner[first]
    return key, np.searchsorted(owner, np.arange(n + 1))


def sketch(key: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Registers of each set, as uint16; sets without elements have zeros."""
    n = len(off) - 1
    full = np.flatnonzero(np.diff(off) > 0)
    out = np.zeros((n, REGISTERS), np.uint16)
    if not len(full):
        return out
    low = (key ^ (key >> np.uint64(32))).astype(np.uint64)
    for i in range(REGISTERS):
        # the variate -log(1 - u) grows with u, so the smallest u decides; u is 64 bits of a product
        u = low * _SEEDS[i]
        u ^= u >> np.uint64(29)
        u *= np.uint64(0xBF58476D1CE4E5B9)
        least = np.minimum.reduceat(u, off[full])
        variate = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64)
        out[full, i] = np.clip(np.floor(32768 - np.log(np.maximum(variate, 1e-300)) / np.log(BASE)), 0, 65535)
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """64 bits for each set and band."""
    out = np.zeros((len(registers), BANDS), np.uint64)
    wide = registers.reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    for r in range(ROWS):
        out = mixed(out ^ (wide[:, :, r] + np.uint64((r + 1) * int(MIX) & 0xFFFFFFFFFFFFFFFF)))
    return mixed(out ^ (np.arange(1, BANDS + 1, dtype=np.uint64) * MIX)[None, :])


def estimate(equal: np.ndarray, more: np.ndarray, less: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity by maximum likelihood from how many registers are equal, larger or smaller, given both sizes.

    With shares u = |A|/(|A|+|B|) and v = 1 - u, registers of A are larger with probability p(u - v J) and smaller with
    p(v - u J), where p is near the identity for a base near 1, and equal otherwise; the likelihood is concave in J, and
    Newton's method finds its maximum.
    """
    u = size_a / (size_a + size_b)
    v = 1 - u
    top = np.minimum(u / v, v / u)
    j = np.clip(equal / REGISTERS, 1e-6, top - 1e-6)
    for _ in range(12):
        a, b, e = np.maximum(u - v * j, 1e-9), np.maximum(v - u * j, 1e-9), np.maximum(j, 1e-9)
        slope = -more * v / a - less * u / b + equal / e
        bend = -more * (v / a) ** 2 - less * (u / b) ** 2 - equal / e**2
        j = np.clip(j - slope / np.minimum(bend, -1e-9), 1e-9, top)
    return j


def _fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            key, off = shingle_sets(texts_of(batch), shingle)
            registers = sketch(key, off)
            size = np.diff(off)
            scrambled = np.concatenate([[np.uint64(0)], np.cumsum(mixed(key), dtype=np.uint64)])
            h1 = mixed(scrambled[off[1:]] - scrambled[off[:-1]] + size.astype(np.uint64)).view(np.int64)
            other = np.concatenate([[np.uint64(0)], np.cumsum(mixed(key ^ MIX), dtype=np.uint64)])
            h2 = (other[off[1:]] - other[off[:-1]]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(h1), pa.array(h2), pa.array([r.tobytes() for r in registers], pa.binary())], names=["doc_id", "n_shingles", "h1", "h2", "registers"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, "doc_id long, n_shingles long, h1 long, h2 long, registers binary")


def _ties(representatives: DataFrame) -> DataFrame:
    """(a, b): a set tied to the smallest with the same band key.

    Keys and ids travel packed by bucket; a batch sends one id for each key and ties its others to it at once.
    """
    spark = representatives.sparkSession
    buckets = max(1, partitions(spark), -(-representatives.count() * BANDS // BUCKET_KEYS))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            registers = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            keys = band_keys(registers).ravel()
            owner = np.repeat(ids, BANDS)
            order = np.lexsort((owner, keys))
            keys, owner = keys[order], owner[order]
            first = np.concatenate([[True], keys[1:] != keys[:-1]])
            hub = owner[first][np.cumsum(first) - 1]
            a, b = owner[~first], hub[~first]
            if len(a):
                pairs = np.unique(np.stack([a, b], 1)[a != b], axis=0)
                yield _packed([-1], [b""], [pairs[:, 0].tobytes()], [pairs[:, 1].tobytes()])
            keys, owner = keys[first], owner[first]
            bucket = (keys % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            some = [(k, order[ends[k] : ends[k + 1]]) for k in range(buckets) if ends[k] < ends[k + 1]]
            yield _packed([k for k, _ in some], [keys[o].tobytes() for _, o in some], [owner[o].tobytes() for _, o in some], [b""] * len(some))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners = [], []
        for batch in batches:
            for bucket, key, a, b in zip(*(batch.column(c).to_pylist() for c in ("bucket", "keys", "a", "b")), strict=True):
                if bucket < 0:
                    yield _pairs(np.frombuffer(a, np.int64), np.frombuffer(b, np.int64))
                else:
                    keys.append(np.frombuffer(key, np.uint64))
                    owners.append(np.frombuffer(a, np.int64))
        if keys:
            key, owner = np.concatenate(keys), np.concatenate(owners)
            order = np.lexsort((owner, key))
            key, owner = key[order], owner[order]
            first = np.concatenate([[True], key[1:] != key[:-1]])
            hub = owner[first][np.cumsum(first) - 1]
            yield _pairs(owner[~first], hub[~first])

    sent = representatives.select("doc_id", "registers").mapInArrow(emit, "bucket int, keys binary, a binary, b binary")
    salted = F.when(F.col("bucket") < 0, F.floor(F.rand(1) * buckets)).otherwise(F.col("bucket")).cast("int")
    return sent.withColumn("to", salted).repartition(buckets, "to").drop("to").mapInArrow(meet, "a long, b long")


def _packed(bucket: list, keys: list, a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), *(pa.array(x, pa.binary()) for x in (keys, a, b))], names=["bucket", "keys", "a", "b"])


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([a, b], 1)[a != b], axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])


def confirmed(ids: np.ndarray, side: np.ndarray, known: np.ndarray, sets: list[np.ndarray], registers: np.ndarray, percent: int, band: int | None = None) -> list[tuple[int, int]]:
    """Links among sets (across sides 0 and 1, or all if one side only) that connect all similar ones; those of one ``known`` component are connected.

    Sets that meet for a ``band`` key are compared only if it is the first band that they share: in every other one they meet again.
    """
    size = np.array([len(s) for s in sets], np.int64)
    starts = np.cumsum(size) - size
    code = mark = None  # most groups have no likely pair and need no codes
    across = side.min() != side.max()
    label = np.unique(known, return_inverse=True)[1]
    keys = None if band is None else band_keys(registers)
    links = []
    t = percent / 100
    for i in range(len(ids)):
        if across and side[i] == 1:
            break
        rest = np.flatnonzero((label != label[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])))
        rest = rest[side[rest] == 1] if across else rest[rest > i]
        if keys is not None and len(rest):
            shared = (keys[rest] == keys[i]).argmax(1)
            rest = rest[keys[i][shared] == np.uint64(band & 0xFFFFFFFFFFFFFFFF)]
        if not len(rest):
            continue
        equal = (registers[rest] == registers[i]).sum(1)
        more = (registers[rest] < registers[i]).sum(1)
        likely = estimate(equal, more, REGISTERS - equal - more, np.full(len(rest), size[i], float), size[rest].astype(float))
        rest = rest[likely >= t - SPREAD * np.sqrt(t * (1 - t) / REGISTERS)]
        if not len(rest):
            continue
        if code is None:
            code = np.unique(np.concatenate(sets), return_inverse=True)[1]
            mark = np.zeros(int(code.max()) + 1, np.int8)
        own = code[starts[i] : starts[i] + size[i]]
        mark[own] = 1
        for at in range(0, len(rest), 512):
            some = rest[at : at + 512]
            index = np.concatenate([code[starts[k] : starts[k] + size[k]] for k in some])
            ends = np.cumsum(size[some])
            total = np.concatenate([[0], np.cumsum(mark[index], dtype=np.int64)])
            common = total[ends] - total[ends - size[some]]
            for k in some[100 * common >= percent * (size[i] + size[some] - common)]:
                if label[i] != label[k]:
                    label[label == label[k]] = label[i]
                    links.append((int(ids[i]), int(ids[k])))
        mark[own] = 0
    return links


def _pairs_of_blocks(groups: DataFrame) -> DataFrame:
    """Places (doc_id, cluster, i, j, side, known) of sets (doc_id, cluster, block, first, blocks, known): a set of a block meets all blocks, but those from ``first`` on don't meet each other."""
    other = F.explode(F.when(F.col("block") < F.col("first"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.sequence(F.lit(0), F.col("first") - 1)))
    rows = groups.withColumn("other", other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    return rows.select("doc_id", "cluster", "i", "j", F.when((F.col("i") != F.col("j")) & (F.col("block") == F.col("j")), 1).otherwise(0).alias("side"), "known")


def _sets(places: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """Full sets and registers of the documents at some place, and all their places (doc_id, cluster, i, j, side, known)."""
    at = places.groupBy("doc_id").agg(F.collect_list(F.struct("cluster", "i", "j", "side", "known")).alias("at"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    mine = texts.join(at.hint("merge"), "doc_id")  # alike at every size

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            key, off = shingle_sets(texts_of(batch), shingle)
            registers = sketch(key, off)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("at"), pa.array([key[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)], pa.binary()), pa.array([r.tobytes() for r in registers], pa.binary())], names=["doc_id", "at", "hashes", "registers"])

    return mine.mapInArrow(sets, "doc_id long, at array<struct<cluster: long, i: int, j: int, side: int, known: long>>, hashes binary, registers binary")


def _links(rows: DataFrame, percent: int, by_band: bool = False) -> DataFrame:
    """Confirmed links (a, b) among sets that meet at a place (doc_id, cluster, i, j, side, known, hashes, registers): the two sides, or all if there is one side only.

    With ``by_band``, a cluster is a band key.
    """

    def check(table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "ascending"), ("doc_id", "ascending")])
        ids = table["doc_id"].to_numpy()
        table = table.filter(pa.array(np.concatenate([[True], ids[1:] != ids[:-1]])))  # repeated rows of one id are one document
        ids, side, known = (table[c].to_numpy() for c in ("doc_id", "side", "known"))
        found = []
        if table["i"][0].as_py() == table["j"][0].as_py() or side.min() != side.max():
            sets = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
            found = confirmed(ids, side, known, sets, np.stack([np.frombuffer(x, np.uint16) for x in table["registers"].to_pylist()]), percent, table["cluster"][0].as_py() if by_band else None)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return rows.groupBy("cluster", "i", "j").applyInArrow(check, "a long, b long")


def _blocks(sets: DataFrame, *by: str) -> DataFrame:
    """How many blocks the sets (n_shingles) of each group need."""
    per = sets.groupBy(*by).agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    return per.withColumn("blocks", F.greatest(F.ceil(F.col("n") / BLOCK_SETS), F.ceil(F.col("s") / BLOCK_HASHES)).cast("int"))


def _block_of(blocks) -> F.Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(3)), blocks).cast("int")


def _star_places(ties: DataFrame, large: DataFrame) -> DataFrame:
    """Places at which each set of a large cluster (doc_id, n_shingles) meets those that it is tied to."""
    mine = ties.distinct().join(large.select(F.col("doc_id").alias("a"), "n_shingles"), "a")
    per = _blocks(mine, "b").select("b", "blocks")
    members = mine.join(per, "b").select(F.col("a").alias("doc_id"), F.col("b").alias("cluster"), "blocks")
    members = members.withColumn("j", _block_of(F.col("blocks")) + 1).select("doc_id", "cluster", F.lit(0).alias("i"), "j", F.lit(1).alias("side"), F.col("doc_id").alias("known"))
    hubs = per.select(F.col("b").alias("doc_id"), F.col("b").alias("cluster"), F.lit(0).alias("i"), F.explode(F.sequence(F.lit(1), F.col("blocks"))).alias("j"), F.lit(0).alias("side"), F.col("b").alias("known"))
    return members.unionByName(hubs)


def _band_places(sets: DataFrame, folder: str) -> DataFrame:
    """Places for sets (doc_id, n_shingles, registers, known) that share a band and are not all in one component."""

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                registers = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
                each = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
                yield pa.RecordBatch.from_arrays([batch.column(c).take(each) for c in ("doc_id", "n_shingles", "known")] + [pa.array(band_keys(registers).ravel().view(np.int64))], names=["doc_id", "n_shingles", "known", "cluster"])

    rows = kept(sets.mapInArrow(bands, "doc_id long, n_shingles long, known long, cluster long"), folder, "bands")
    mixed_keys = rows.groupBy("cluster").agg(F.min("known").alias("low"), F.max("known").alias("high")).where("low < high").select("cluster")
    rows = kept(rows.join(mixed_keys, "cluster", "left_semi"), folder, "mixed-bands")
    most = rows.groupBy("cluster", "known").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max(F.struct("n", "known"))["known"].alias("main"))
    rows = rows.join(most, "cluster").withColumn("in_main", F.col("known") == F.col("main"))
    per = _blocks(rows, "cluster", "in_main")
    per = per.groupBy("cluster").agg(F.coalesce(F.max(F.when(~F.col("in_main"), F.col("blocks"))), F.lit(0)).alias("first"), F.coalesce(F.max(F.when(F.col("in_main"), F.col("blocks"))), F.lit(0)).alias("rest"))
    rows = rows.join(per, "cluster").withColumn("block", F.when(F.col("in_main"), F.col("first") + _block_of(F.greatest("rest", F.lit(1)))).otherwise(_block_of(F.greatest("first", F.lit(1)))))
    return _pairs_of_blocks(rows.select("doc_id", "cluster", "block", "first", (F.col("first") + F.col("rest")).alias("blocks"), "known"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row."""
    folder = shared_folder(docs.sparkSession)
    prints = kept(_fingerprints(docs, shingle), folder, "prints")
    light = prints.select("doc_id", "n_shingles", "h1", "h2")
    full = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    classes = light.where(full).groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n"))
    first = prints.where(full).join(classes.select(F.col("class_id").alias("doc_id"), "h1", "h2"), ["doc_id", "h1", "h2"], "left_semi").dropDuplicates(["doc_id", "h1", "h2"])
    ties = kept(_ties(first), folder, "tied")
    candidates = components(ties, folder, "ties")
    sizes = first.select("doc_id", "n_shingles").join(candidates.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")), "doc_id", "left")
    sizes = sizes.withColumn("cluster", F.coalesce("cluster", "doc_id"))
    per = _blocks(sizes, "cluster").where("n > 1").select("cluster", "blocks")
    clusters = kept(sizes.join(per, "cluster"), folder, "clusters")
    small = clusters.where("blocks = 1").select("doc_id", "cluster", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), F.col("doc_id").alias("known"))
    large = clusters.where("blocks > 1")
    sets = kept(_sets(small.unionByName(_star_places(ties, large)), docs, shingle), folder, "sets")  # texts are read for sets once
    links = kept(_links(sets.withColumn("at", F.explode("at")).select("doc_id", "at.*", "hashes", "registers"), percent), folder, "links")
    if not large.isEmpty():
        so_far = components(links, folder, "star-cc").select(F.col("node").alias("doc_id"), "component")
        members = large.join(so_far, "doc_id", "left").select("doc_id", "cluster", "n_shingles", F.coalesce("component", "doc_id").alias("known"))
        open_ = members.groupBy("cluster").agg(F.min("known").alias("low"), F.max("known").alias("high")).where("low < high").select("cluster")
        again = kept(members.join(open_, "cluster", "left_semi").drop("cluster"), folder, "again")
        own = sets.select("doc_id", "hashes", "registers").join(again.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])  # before they move
        own = kept(own, folder, "again-sets")
        places = _band_places(again.join(own.select("doc_id", "registers"), "doc_id"), folder).join(own, "doc_id")
        more = kept(_links(places, percent, by_band=True), folder, "more-links")
        links = links.unionByName(more)
    linked = components(links, folder, "links-cc")
    of_class = classes.join(linked.select(F.col("node").alias("class_id"), "component"), "class_id", "left")
    of_class = of_class.select("h1", "h2", "n_shingles", "n", F.coalesce("component", "class_id").alias("component_id"))
    # classes with over a thousandth of all rows, fewer than a thousand, are joined by broadcast; no other key has more rows than that
    key = ["h1", "h2", "n_shingles"]
    floor = -(-prints.count() // HOT_SHARE)
    of_class = kept(of_class, folder, "of-class")
    hot = F.broadcast(of_class.where(F.col("n") > floor).drop("n"))
    cold = of_class.where(F.col("n") <= floor).drop("n")
    linkable = light.where(full)
    told = linkable.join(hot, key).unionByName(linkable.join(hot.select(*key), key, "left_anti").join(cold, key))
    alone = light.where(~full).withColumn("component_id", F.col("doc_id"))
    out = told.select("doc_id", "n_shingles", "component_id").unionByName(alone.select("doc_id", "n_shingles", "component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, shingle: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose document stands for its group; rows that repeat an id and its text stay one, each text of an id stays."""
    kept_ids = near_duplicates(docs, shingle, percent).where("kept").select("doc_id").distinct()
    some = docs.join(kept_ids.where("doc_id is not null"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return some.unionByName(docs.where("doc_id is null")).select(*docs.columns)

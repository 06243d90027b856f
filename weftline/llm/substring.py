"""Substring deduplication with a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words of one document.  A word goes if a window that covers it
has a word sequence that also starts earlier: in a document with a smaller id, or earlier in the
same one.

The index holds fingerprints of selected windows.  Of every window's ``GRAM``-word hashes the
smallest is selected (the leftmost of equal ones), so equal windows select equal hashes at the
same place, and about one place in seven is kept.  The index is a list of immutable runs, each a
table sorted by hash within hash buckets: (hash, 32 bits of all windows that select it there, first document and place of both, whether the hash was seen twice).
A new batch is sorted likewise and merge-joined with each run: hashes seen before, or twice in the
batch, give suspect places, on either side.  Then the batch becomes a run of its own; ``FANOUT``
runs of a level are compacted into one of the next, keeping the first place of each hash and surroundings.  The list of runs is stored with
them, a version for each batch, so ``FingerprintIndex.open`` goes on with a stored index, and ``substring_increment``
tells of a new batch against all batches before: only its documents and the older ones under suspicion are read again.

Suspects are verified by their whole windows: every window around a suspect place is hashed again
with other functions to 64 and 32 bits over all its words, and windows equal in both are one
sequence (for 10^12 windows, a chance of about 10^-5 that any two differ).  All but the first of a
sequence mark the words that go.  Each slice of a batch sends one record a hash, so a passage that
a third of all documents share is a few records; records travel packed, sorted and by byte planes.

Defined cases: null and empty texts, and texts shorter than a window, lose nothing; repeated rows
(equal id and text) lose the same words and are not earlier than each other; a null id is neither
compared nor cut; an id stands for one text; an empty table gives an empty result.  Extra columns
are ignored by the report and pass through ``deduplicate``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._arrow import Words, kept, mixed, pack, partitions, planes, ragged, rolled, shared_folder, slices, sums, texts_of, unpack, unplanes

WINDOW = 20
GRAM = 8
BATCHES = 3
FANOUT = 2
BUCKET_BYTES = 16 << 20
GROUP_BYTES = 24 << 20

_RECORD = "kind string, bucket int, keys binary, extra binary, docs binary, places binary, flags binary"
_NAMES = ["kind", "bucket", "keys", "extra", "docs", "places", "flags"]


def spark_hash(ids: np.ndarray) -> np.ndarray:
    """What Spark's xxhash64 gives for longs."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    h = turn(ids.astype(np.int64).view(np.uint64) * p2, 31) * p1
    h ^= p5 + np.uint64(50)  # seed 42 and length 8
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _group_of(ids: np.ndarray, groups: int) -> np.ndarray:
    return np.mod(spark_hash(ids), groups)


def selected(hashes: np.ndarray, starts: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of word hashes in a row: the gram hashes, all window starts, and the place each window selects."""
    grams = rolled(hashes, gram, 5)
    count = np.diff(starts)
    first = ragged(starts[:-1], np.maximum(0, count - window + 1))
    if not len(first):
        return grams, first, first
    span = window - gram + 1
    least, at, width = grams, np.arange(len(grams)), 1
    while width * 2 <= span:
        least, at = _lesser(least, at, width)
        width *= 2
    if width < span:
        least, at = _lesser(least, at, span - width)
    return grams, first, at[first]


def _lesser(least: np.ndarray, at: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    left, right = least[:-shift], least[shift:]
    take = right < left
    return np.where(take, right, left), np.where(take, at[shift:], at[:-shift])


def _rows(kind: str, bucket: np.ndarray, keys: np.ndarray | None, extra: np.ndarray | None, docs: np.ndarray, places: np.ndarray, flags: np.ndarray | None) -> pa.RecordBatch:
    """One packed row for each bucket; within it, records keep their order (by key where there are keys)."""
    order = np.argsort(bucket, kind="stable")
    ends = np.flatnonzero(np.diff(bucket[order], append=-1)) + 1 if len(order) else np.zeros(0, np.int64)
    out: list[list] = [[] for _ in _NAMES]
    for a, b in zip([0, *ends[:-1]] if len(ends) else [], ends, strict=True):
        o = order[a:b]
        row = (kind, int(bucket[o[0]]), None if keys is None else pack(keys[o]), None if extra is None else planes(extra[o]), planes(docs[o]), planes(places[o].astype(np.int32)), None if flags is None else flags[o].astype(np.int8).tobytes())
        for column, x in zip(out, row, strict=True):
            column.append(x)
    kinds = (pa.string(), pa.int32(), *[pa.binary()] * 5)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=_NAMES)


def _records(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Keys, extra, docs, places and flags of all rows, in a row."""
    cols = {c: table.column(c).to_pylist() for c in ("keys", "extra", "docs", "places", "flags")}
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return (
        join([unpack(x) for x in cols["keys"] if x is not None], np.uint64),
        join([unplanes(x, np.uint32) for x in cols["extra"] if x is not None], np.uint32),
        join([unplanes(x, np.int64) for x in cols["docs"]], np.int64),
        join([unplanes(x, np.int32) for x in cols["places"]], np.int32),
        join([np.frombuffer(x, np.int8) for x in cols["flags"] if x is not None], np.int8),
    )


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where sorted columns change."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(out)


def _repeated(key: np.ndarray) -> np.ndarray:
    """Which of sorted keys are there twice or more."""
    again = key[1:] == key[:-1]
    out = np.zeros(len(key), bool)
    out[1:] |= again
    out[:-1] |= again
    return out


def _fingerprints(docs: DataFrame, buckets: int, groups: int, window: int, gram: int) -> DataFrame:
    """Packed records (kind f) of each slice's selected hashes, one a hash and surroundings, and marks (kind m) of places whose hash is seen twice in a slice."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            words = Words(texts_of(batch))
            if not len(words.codes):
                continue
            grams, starts, at = selected(words.hashes()[words.codes], words.starts, window, gram)
            if not len(at):
                continue
            own = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            windows = rolled(words.hashes()[words.codes], window, 31)[starts]
            around = (mixed(np.add.reduceat(windows, own)) >> np.uint64(32)).astype(np.uint32)
            at = at[own]
            owner = words.doc[at]
            key, doc, place = grams[at], ids[owner], at - words.starts[owner]
            order = np.lexsort((place, doc, around, key))
            key, around, doc, place = key[order], around[order], doc[order], place[order]
            twice = _repeated(key)
            if twice.any():
                yield _rows("m", _group_of(doc[twice], groups), None, None, doc[twice], place[twice], None)
            first = _starts(key, around)
            key, around, doc, place, flag = key[first], around[first], doc[first], place[first], twice[first]
            yield _rows("f", (key % np.uint64(buckets)).astype(np.int64), key, around, doc, place, flag)

    return docs.select("doc_id", "text").mapInArrow(find, _RECORD)


class FingerprintIndex:
    """Sorted immutable runs of window hashes in a shared folder, with a list of them for each version of the index."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int, groups: int, window: int = WINDOW, gram: int = GRAM, fanout: int = FANOUT):
        self.spark, self.folder, self.buckets, self.groups, self.window, self.gram, self.fanout = spark, folder, buckets, groups, window, gram, fanout
        self.runs: list[tuple[int, str]] = []  # level and path, older runs first
        self.made = self.version = 0
        self.last: int | None = None  # the largest id

    @staticmethod
    def open(spark: SparkSession, folder: str) -> FingerprintIndex:
        """The last version of a stored index; what a batch that failed has left is not in its list."""
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/lists")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        done = [f.getPath().getName() for f in fs.listStatus(path) if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
        rows = spark.read.parquet(f"{folder}/lists/{max(done, key=int)}").orderBy("nth").collect()  # a few runs
        head = rows[0]
        index = FingerprintIndex(spark, folder, head["buckets"], head["groups"], head["window"], head["gram"], head["fanout"])
        index.runs = [(r["level"], r["path"]) for r in rows if r["path"]]
        index.made, index.version, index.last = head["made"], int(max(done, key=int)), head["last"]
        return index

    def save(self) -> None:
        """Stores the list of runs as a new version."""
        self.version += 1
        head = (self.buckets, self.groups, self.window, self.gram, self.fanout, self.made, self.last)
        rows = [(k, level, path, *head) for k, (level, path) in enumerate(self.runs)] or [(0, 0, None, *head)]
        schema = "nth int, level int, path string, buckets int, groups int, window int, gram int, fanout int, made int, last long"
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/lists/{self.version}")

    def _read(self, path: str, number: int) -> DataFrame:
        return self.spark.read.schema(_RECORD).parquet(path).where("kind = 'r'").withColumn("run", F.lit(number))

    def add(self, docs: DataFrame, alone: bool = False) -> DataFrame:
        """Merge-joins a batch with all runs, makes it a run, and returns packed marks of suspect places on either side.

        Places marked for batches before are marked again only if the batch is looked at ``alone``.
        """
        new = _fingerprints(docs, self.buckets, self.groups, self.window, self.gram)
        # marks need no meeting: they go to any bucket's group
        rows = new.withColumn("run", F.lit(-1)).withColumn("to", F.when(F.col("kind") == "m", F.pmod("bucket", F.lit(self.buckets))).otherwise(F.col("bucket")))
        for k, (_, path) in enumerate(self.runs):
            rows = rows.unionByName(self._read(path, k).withColumn("to", F.col("bucket")))
        groups = self.groups

        def meet(table: pa.Table) -> pa.Table:
            return _meet(table, groups, alone)

        self.made += 1
        path = f"{self.folder}/run-0-{self.version}-{self.made}"
        rows.groupBy("to").applyInArrow(meet, _RECORD).write.mode("overwrite").parquet(path)
        self.runs.append((0, path))
        marks = self.spark.read.schema(_RECORD).parquet(path).where("kind = 'm'")
        self._compact()
        self.save()
        return marks

    def _compact(self) -> None:
        level = 0
        while len(own := [x for x in self.runs if x[0] == level]) >= self.fanout:
            rows = self._read(own[0][1], 0)
            for k, (_, path) in enumerate(own[1:], 1):
                rows = rows.unionByName(self._read(path, k))
            self.made += 1
            path = f"{self.folder}/run-{level + 1}-{self.made}"
            rows.groupBy("bucket").applyInArrow(_merge, _RECORD).write.mode("overwrite").parquet(path)
            at = self.runs.index(own[0])
            self.runs = [x for x in self.runs if x not in own]
            self.runs.insert(at, (level + 1, path))
            level += 1


def _merge(table: pa.Table) -> pa.Table:
    """Runs of one bucket as one: the first place of each hash and surroundings, and whether any run has the hash twice."""
    key, around, doc, place, flag = _records(table)
    order = np.lexsort((place, doc, around, key))
    key, around, doc, place, flag = key[order], around[order], doc[order], place[order], flag[order]
    of_key = _starts(key)
    flag = np.repeat(np.maximum.reduceat(flag, of_key) if len(of_key) else flag, np.diff(np.append(of_key, len(key))))
    at = _starts(key, around)
    return pa.Table.from_batches([_rows("r", np.full(len(at), table.column("bucket")[0].as_py()), key[at], around[at], doc[at], place[at], flag[at])])


def _meet(table: pa.Table, groups: int, alone: bool) -> pa.Table:
    run = table.column("run").to_numpy()
    kind = np.array(table.column("kind").to_pylist(), object)
    through = table.filter(pa.array(kind == "m")).select(_NAMES)
    out = [through]
    fresh = table.filter(pa.array(kind == "f"))
    if fresh.num_rows:
        key, around, doc, place, flag = _records(fresh)
        order = np.lexsort((place, doc, around, key))
        key, around, doc, place, flag = key[order], around[order], doc[order], place[order], flag[order]
        at = _starts(key)
        size = np.diff(np.append(at, len(key)))
        once = key[at]
        known = np.zeros(len(once), bool)
        marked_doc, marked_place = [], []
        for r in sorted(set(run[run >= 0].tolist()), reverse=True):  # newer runs first
            old, _, old_doc, old_place, old_flag = _records(table.filter(pa.array(run == r)))
            low, high = np.searchsorted(old, once, side="left"), np.searchsorted(old, once, side="right")
            hit = low < high
            # a hash with the mark of having been seen twice had all its places marked then, as had one that a newer run knows
            tell = hit & (alone | (~known & (old_flag[np.minimum(low, len(old) - 1)] == 0)))
            index = ragged(low[tell], (high - low)[tell])
            marked_doc.append(old_doc[index])
            marked_place.append(old_place[index])
            known |= hit
        seen = (size > 1) | known
        suspect = np.repeat(seen, size) & (flag == 0)
        marked_doc.append(doc[suspect])
        marked_place.append(place[suspect])
        docs, places = np.concatenate(marked_doc), np.concatenate(marked_place)
        if len(docs):
            out.append(pa.Table.from_batches([_rows("m", _group_of(docs, groups), None, None, docs, places, None)]))
        flags = np.repeat(np.maximum(np.maximum.reduceat(flag, at), seen.astype(np.int8)), size)
        write = _starts(key, around)
        out.append(pa.Table.from_batches([_rows("r", np.full(len(write), fresh.column("bucket")[0].as_py()), key[write], around[write], doc[write], place[write], flags[write])]))
    return pa.concat_tables([t.cast(out[-1].schema) if t.schema != out[-1].schema else t for t in out])


def _lookup(marks: pa.Table) -> np.ndarray:
    """Marks of one group as sorted pairs (document, place)."""
    if not marks.num_rows:
        return np.zeros((0, 2), np.int64)
    _, _, doc, place, _ = _records(marks)
    order = np.lexsort((place, doc))
    return np.stack([doc[order], place[order].astype(np.int64)], 1)


def _marked(pairs: np.ndarray, ids: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Marks as booleans over the words of a slice."""
    out = np.zeros(size, bool)
    low, high = np.searchsorted(pairs[:, 0], ids, side="left"), np.searchsorted(pairs[:, 0], ids, side="right")
    index = ragged(low, high - low)
    out[np.repeat(starts[:-1], high - low) + pairs[index, 1]] = True
    return out


def _windows(docs: pa.Table, marks: pa.Table, buckets: int, groups: int, window: int, gram: int) -> pa.Table:
    """Records (kind w) of windows at suspect places, and marks (kind m) of those not first within a slice."""
    pairs, out = _lookup(marks), []
    if len(pairs):
        for batch in slices(iter(docs.combine_chunks().to_batches())):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            here = np.isin(ids, pairs[:, 0])
            if not here.any():
                continue
            batch = batch.filter(pa.array(here))
            ids = ids[here]
            words = Words(texts_of(batch))
            base = words.hashes()
            suspect = _marked(pairs, ids, words.starts, len(words.codes))
            _, first, at = selected(base[words.codes], words.starts, window, gram)
            first = first[suspect[at]]
            if not len(first):
                continue
            key = rolled(words.hashes(23)[words.codes], window, 31)[first]
            extra = (rolled(words.hashes(57)[words.codes], window, 41)[first] >> np.uint64(32)).astype(np.uint32)
            owner = words.doc[first]
            doc, place = ids[owner], first - words.starts[owner]
            firsts, later = _first_windows(key, extra, doc, place)
            if len(later[0]):
                out.append(_rows("m", _group_of(later[0], groups), None, None, later[0], later[1], None))
            key, extra, doc, place = firsts
            out.append(_rows("w", (key % np.uint64(buckets)).astype(np.int64), key, extra, doc, place, None))
    return pa.Table.from_batches(out) if out else pa.Table.from_batches([_rows("m", *[np.zeros(0, np.int64)], None, None, np.zeros(0, np.int64), np.zeros(0, np.int64), None)])


def _first_windows(key: np.ndarray, extra: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[tuple, tuple]:
    """Records of the first place of each sequence, and (document, place) of the others."""
    order = np.lexsort((place, doc, extra, key))
    key, extra, doc, place = key[order], extra[order], doc[order], place[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (extra[1:] != extra[:-1])
    at = np.flatnonzero(first)[np.cumsum(first) - 1]
    later = (doc != doc[at]) | (place != place[at])  # a repeated row is not later than itself
    return (key[first], extra[first], doc[first], place[first]), (doc[later], place[later])


def _covered(docs: pa.Table, marks: pa.Table, window: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]], list[int]]]:
    """Slices of documents with the words kept of each, and how many each had."""
    pairs = _lookup(marks)
    for batch in slices(iter(docs.combine_chunks().to_batches())):
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        texts = texts_of(batch)
        lost = np.searchsorted(pairs[:, 0], ids, side="left") < np.searchsorted(pairs[:, 0], ids, side="right")
        words = [t.as_buffer().to_pybytes().split() for t in texts]
        total = [len(w) for w in words]
        for k in np.flatnonzero(lost):
            low, high = np.searchsorted(pairs[:, 0], ids[k], side="left"), np.searchsorted(pairs[:, 0], ids[k], side="right")
            edges = np.zeros(total[k] + 1, np.int64)
            np.add.at(edges, pairs[low:high, 1], 1)
            np.add.at(edges, pairs[low:high, 1] + window, -1)
            keep = np.cumsum(edges[:-1]) == 0
            words[k] = [w for w, ok in zip(words[k], keep, strict=True) if ok]
        yield batch, words, total


def _report(docs: pa.Table, marks: pa.Table, window: int) -> pa.Table:
    out: list[list] = [[], [], [], []]
    for batch, words, total in _covered(docs, marks, window):
        out[0] += batch.column("doc_id").to_pylist()
        out[1] += total
        out[2] += [n - len(w) for n, w in zip(total, words, strict=True)]
        out[3] += [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.table([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _texts(docs: pa.Table, marks: pa.Table, window: int) -> pa.Table:
    """(doc_id, new text) of documents that lose words; a text that loses none stays as it is."""
    out: list[list] = [[], []]
    for batch, words, total in _covered(docs, marks, window):
        for i, w, n in zip(batch.column("doc_id").to_pylist(), words, total, strict=True):
            if len(w) < n:
                out[0].append(i)
                out[1].append(b" ".join(w).decode())
    return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string())], names=["doc_id", "new_text"])


def _sizes(docs: DataFrame) -> tuple[int, int]:
    """Buckets and groups for texts of this size."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    least = partitions(docs.sparkSession)
    return max(least, -(-size // BUCKET_BYTES)), max(least, -(-size // GROUP_BYTES))


def _verified(keyed: DataFrame, marks: DataFrame, index: FingerprintIndex, folder: str) -> DataFrame:
    """Packed marks (bucket: group) of all windows at suspect places that are not first."""
    buckets, groups, window, gram = index.buckets, index.groups, index.window, index.gram

    def windows(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return _windows(left, right, buckets, groups, window, gram)

    light = keyed.select("group", "doc_id", "text")
    found = kept(light.groupBy("group").cogroup(marks.withColumn("group", F.col("bucket")).groupBy("group")).applyInArrow(windows, _RECORD), folder, "windows")

    def first(table: pa.Table) -> pa.Table:
        key, extra, doc, place, _ = _records(table)
        _, later = _first_windows(key, extra, doc, place)
        return pa.Table.from_batches([_rows("m", _group_of(later[0], groups), None, None, later[0], later[1], None)])

    later = found.where("kind = 'w'").groupBy("bucket").applyInArrow(first, _RECORD)
    return kept(later.unionByName(found.where("kind = 'm'")), folder, "marks").withColumn("group", F.col("bucket"))


def _keyed(docs: DataFrame, groups: int) -> DataFrame:
    return docs.where("doc_id is not null").withColumn("group", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int"))


def _later_windows(docs: DataFrame, batches: int, window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, text) keyed by group, and packed marks (bucket: group) of all windows that are not first."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    some = docs.where("doc_id is not null")
    cuts = [k / batches for k in range(1, batches)]
    seen = some.agg(F.percentile_approx("doc_id", cuts or [0.5], 1000).alias("cuts")).first()["cuts"]
    index = FingerprintIndex(spark, f"{folder}/index", *_sizes(some), window, gram)
    edges = [None, *sorted(set(seen or []))[: batches - 1], None]
    marks = None
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        part = some if low is None else some.where(F.col("doc_id") > low)
        got = index.add(part if high is None else part.where(F.col("doc_id") <= high))
        marks = got if marks is None else marks.unionByName(got)
    keyed = _keyed(some, index.groups)
    return keyed, _verified(keyed, marks, index, folder)


def substring_increment(docs: DataFrame, history: DataFrame, folder: str, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """What ``substring_report`` says of ``docs`` among ``history`` and ``docs`` together, from the index stored in ``folder``.

    ``history`` has all documents added before; their ids must be smaller than the new ones, which is checked.  A first batch makes the index.
    Of ``history`` only documents with suspect places are read on; new ids are not null.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first, last = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/lists")
    stored = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    index = FingerprintIndex.open(spark, folder) if stored else FingerprintIndex(spark, folder, *_sizes(rows), window, gram)
    if first is not None and index.last is not None and first <= index.last:
        raise ValueError(f"id {first} is not larger than {index.last}, which is in the index")
    index.last = last if last is not None else index.last
    marks = index.add(rows.where("doc_id is not null"), alone=True)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs in batch.column("docs").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(unplanes(docs, np.int64)))], names=["doc_id"])

    suspects = marks.select("docs").mapInArrow(ids, "doc_id long").distinct()
    old = history.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(suspects, "doc_id", "left_semi")
    keyed = _keyed(rows, index.groups)
    return _reported(rows, keyed, _verified(keyed.unionByName(_keyed(old, index.groups)), marks, index, shared_folder(spark)), index.window)


def _reported(rows: DataFrame, keyed: DataFrame, marks: DataFrame, window: int) -> DataFrame:
    def report(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return _report(left, right, window)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    out = keyed.select("group", "doc_id", "text").groupBy("group").cogroup(marks.groupBy("group")).applyInArrow(report, schema)

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = [t.as_buffer().to_pybytes().split() for t in texts_of(batch)]
            columns = [pa.array([len(w) for w in words], pa.int64()), pa.array([0] * len(words), pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return out.unionByName(rows.where("doc_id is null").mapInArrow(plain, schema))


def substring_report(docs: DataFrame, batches: int = BATCHES, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed, marks = _later_windows(rows, batches, window, gram)
    return _reported(rows, keyed, marks, window)


def deduplicate(docs: DataFrame, batches: int = BATCHES, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The rows of ``docs`` with the repeated words taken out; texts that lose nothing stay as they are, with their spaces.

    A document of which no word is left goes.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed, marks = _later_windows(rows, batches, window, gram)

    def texts(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return _texts(left, right, window)

    cut = keyed.select("group", "doc_id", "text").groupBy("group").cogroup(marks.groupBy("group")).applyInArrow(texts, "doc_id long, new_text string")
    cut = cut.dropDuplicates(["doc_id"])
    whole = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"))  # so that no column's name can clash
    joined = whole.join(cut, F.col("id") == F.col("doc_id"), "left").where("new_text is null or new_text <> ''")
    row = F.col("row").withField("text", F.coalesce("new_text", "row.text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("new_text").isNotNull(), F.length("new_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")))
    return joined.select(row.alias("row")).select("row.*")

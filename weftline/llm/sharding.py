"""Sharding by histogram sort: splitters from exact counts, then one exchange.

Law: ``bytes``.  Rows are ordered by (hash of the text, doc_id, hash of the whole row) and cut into shards of nearly
equal bytes (UTF-8 bytes of the text plus 1 each).  Equal texts are neighbours in this order,
so a group of copies stays in one shard unless a cut must fall into it to keep sizes equal; a
group of any size is cut by doc_id then, and rows that agree in everything are cut by their number.

Each round lays candidate boundaries into the open interval of each unfinished
splitter; every partition counts the bytes below each of them exactly, partial counts are
summed, and the interval shrinks to the two probes around the target.  A splitter is done when
a probe meets the tolerance, or when the interval is a single key, which goes to the nearer side if it is one row.  Splitters whose
interval is a key of several rows go on among these, by the next part of the order, all such keys in the same jobs.  What reaches
the driver is four numbers a probe (``ALL_PROBES`` a round, or four a cut if that is more) and an entry a part; parts grow with the
input, one for ``part_bytes`` of text.  Shards are further cut at finer
splitters of the same kind, with a looser tolerance, so that a task sorts about ``part_bytes`` of text; slots are the
exact count of rows in the parts before, plus the place in the part.  Whole rows move.  Rows that agree in everything
and are cut by number are counted, and as many are made again from one of them, in runs, so no task holds the group.

Defined cases: a null text has size 1 and no CRC-32 bytes (0) and hashes as an empty text; a
null doc_id counts as the smallest id; ids may have any value of a long; repeated rows lie next to each
other and are cut like others; an empty table gives an empty result; a single row goes to
shard 0.  Extra columns, of any name, move with their rows.  ``sharded`` moves all columns, ``shard`` tells of the rows that it moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ._arrow import kept, shared_folder

SHARDS = 16
PROBES = 64
ALL_PROBES = 1 << 18  # of a round, about
TOLERANCE = 0.002  # of a shard
PART_TOLERANCE = 0.1  # of a part
PART_BYTES = 512 << 20
RUN = 4096  # equal rows made by a task

LOW, HIGH = -(1 << 63), (1 << 63) - 1
LEVELS = ("h", "d", "e")

def _count_bins(rows: DataFrame, key: str, probes: list[np.ndarray]) -> list[list[tuple[int, int, int, int]]]:
    """For each group ``g`` of rows, and the keys between each two neighbours of its sorted probes: bytes, rows, smallest and largest key.  One job."""
    first = np.cumsum([0] + [len(p) + 1 for p in probes])
    shared = rows.sparkSession.sparkContext.broadcast((probes, first))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes, first = shared.value
        n = int(first[-1])
        total, many, low, high = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, HIGH), np.full(n, LOW)
        for batch in batches:
            group, keys, sizes = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            order = np.argsort(group, kind="stable") if len(probes) > 1 else np.arange(len(group))
            ends = np.searchsorted(group[order], np.arange(len(probes) + 1))
            for g in np.flatnonzero(np.diff(ends)):
                some = order[ends[g] : ends[g + 1]]
                k = keys[some]
                at = first[g] + np.searchsorted(probes[g], k, side="right")
                np.add.at(total, at, sizes[some])
                np.add.at(many, at, 1)
                np.minimum.at(low, at, k)
                np.maximum.at(high, at, k)
        used = np.flatnonzero(many)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(x[used]) for x in (total, many, low, high))], names=["bin", "b", "n", "low", "high"])

    parts = rows.select("g", key, "size").mapInArrow(count, "bin int, b long, n long, low long, high long")
    bins = [(0, 0, HIGH, LOW)] * int(first[-1])
    for r in parts.groupBy("bin").agg(F.sum("b").alias("b"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect():
        bins[r["bin"]] = (r["b"], r["n"], r["low"], r["high"])
    return [bins[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


def _splitters(rows: DataFrame, key: str, groups: list[int], targets: list[int], tolerances: list[float], probes: int) -> list[tuple[int, bool | None, int, int]]:
    """For each target (bytes of the rows of its group ``g`` that shall lie below): a key, whether its rows lie right of the cut (None: it must be divided),
    the bytes of smaller keys, and how many bytes rows of this key have each where it must be divided."""
    ends = [[LOW, HIGH, 0, None] for _ in targets]  # keys left in question: low <= key <= high; bytes below low, and up to high
    done: dict[int, tuple[int, bool | None, int, int]] = {}
    while len(done) < len(targets):
        probes = max(4, min(probes, ALL_PROBES // (len(targets) - len(done))))
        grids: list[set[int]] = [set() for _ in range(max(groups) + 1)]
        for i, (low, high, below, above) in enumerate(ends):
            if i in done:
                continue
            grid = grids[groups[i]]
            grid.update({low, high})
            grid.update(low + (high - low) * k // probes for k in range(1, probes))
            if above is not None and above > below:  # where evenly spread keys would have it
                centre = low + (high - low) * int(1e6 * (targets[i] - below) / (above - below)) // 1_000_000
                grid.update(x for d in range(-probes // 4, probes // 4) if low < (x := centre + (high - low) * d // (probes * probes)) < high)
        all_ordered = [sorted(g) for g in grids]
        all_bins = _count_bins(rows, key, [np.array(o, np.int64) for o in all_ordered])
        all_below = [np.concatenate([[0], np.cumsum([b for b, _, _, _ in bins])]) for bins in all_bins]  # below[k]: bytes under ordered[k - 1]
        for i, target in enumerate(targets):
            if i in done:
                continue
            ordered, bins, below = (x[groups[i]] for x in (all_ordered, all_bins, all_below))
            k = min(int(np.searchsorted(below, target, side="left")), len(bins))  # below[k - 1] < target <= below[k]
            k = max(k, 1)
            size, n, low, high = bins[k - 1]
            before, after = abs(int(below[k - 1]) - target), abs(int(below[k]) - target)
            if n == 0:
                done[i] = (ordered[min(k, len(ordered)) - 1], True, int(below[k - 1]), 0)
            elif low < high and min(before, after) > tolerances[i]:
                ends[i] = [low, high, int(below[k - 1]), int(below[k])]
            elif low == high and n > 1 and min(before, after) > tolerances[i]:
                done[i] = (low, None, int(below[k - 1]), size // n)
            else:  # the nearer side
                done[i] = (low, True, int(below[k - 1]), 0) if before <= after else (high, False, int(below[k - 1]), 0)
    return [done[i] for i in range(len(targets))]


#: A cut: keys of each part of the order, then whether rows that agree with all of them lie right of it, or how many of them lie left.
Cut = tuple[tuple[int, ...], bool | int]


def find_splitters(keyed: DataFrame, targets: list[int], tolerances: list[float], probes: int = PROBES) -> list[Cut]:
    """A cut for each target; ``keyed`` has h, d, e and size."""
    out: list[Cut | None] = [None] * len(targets)
    open_: dict[tuple[int, ...], list[tuple[int, int]]] = {(): list(enumerate(targets))}
    for depth, level in enumerate(LEVELS):
        if not open_:
            break
        rows = keyed.withColumn("g", F.lit(0))
        if depth:  # all keys that must be divided, at once; one row a cut at most
            names = LEVELS[:depth]
            table = keyed.sparkSession.createDataFrame([(*prefix, g) for g, prefix in enumerate(open_)], ", ".join(f"_{n} long" for n in names) + ", g int")
            on = F.lit(True)
            for n in names:
                on = on & (F.col(n) == F.col(f"_{n}"))
            rows = keyed.join(table, on)
        wanted = [(prefix, g, i, target) for g, (prefix, some) in enumerate(open_.items()) for i, target in some]
        found = _splitters(rows, level, [g for _, g, _, _ in wanted], [t for *_, t in wanted], [tolerances[i] for _, _, i, _ in wanted], probes)
        deeper: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for (prefix, _, i, target), (key, right, below, each) in zip(wanted, found, strict=True):
            if right is not None:
                out[i] = ((*prefix, key), right)
            elif depth + 1 < len(LEVELS):
                deeper.setdefault((*prefix, key), []).append((i, target - below))
            else:
                out[i] = ((*prefix, key), round((target - below) / each))
        open_ = deeper
    return out  # type: ignore[return-value]


class Parts:
    """The number of cuts left of a row."""

    def __init__(self, cuts: list[Cut]):
        self.cuts = cuts
        self.first = np.array([c[0][0] for c in cuts], np.int64)

    def of(self, h: np.ndarray, d: np.ndarray, e: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.first, h, side="left"), np.searchsorted(self.first, h, side="right")
        part = low.astype(np.int32)
        for k in np.unique(low[low < high]):  # the few hashes on which a cut falls
            same = np.flatnonzero((low == k) & (low < high))
            for c in range(int(k), int(high[same[0]])):
                part[same] += self._right(self.cuts[c], (h[same], d[same], e[same]))
        return part

    @staticmethod
    def _right(cut: Cut, keys: tuple[np.ndarray, ...]) -> np.ndarray:
        """Whether rows lie right of a cut; those that are cut by number don't."""
        above, equal = np.zeros(len(keys[0]), bool), np.ones(len(keys[0]), bool)
        for value, key in zip(cut[0], keys, strict=False):
            above |= equal & (key > value)
            equal &= key == value
        return above | equal if cut[1] is True else above

    def divided(self) -> dict[tuple[int, ...], list[int]]:
        """For keys whose rows are cut by number: how many lie left of each cut."""
        out: dict[tuple[int, ...], list[int]] = {}
        for keys, left in self.cuts:
            if not isinstance(left, bool):
                out.setdefault(keys, []).append(left)
        return out


def sharded(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, part_bytes: int = PART_BYTES) -> DataFrame:
    """Whole rows of ``docs`` with ``_shard`` and ``_slot``, exchanged once: a task holds one part of a shard, in order."""
    placed = _placed(docs, shards, tolerance, part_bytes)
    return placed.select("row.*", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))


def _placed(docs: DataFrame, shards: int, tolerance: float, part_bytes: int) -> DataFrame:
    """(row, shard, slot)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    others = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.name != "text" and "map<" not in f.dataType.simpleString() and f.dataType.typeName() not in ("variant", "void")]
    keys = [F.xxhash64(text).alias("h"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)).alias("d"), F.xxhash64(F.lit(29), text, F.col("text").isNull(), *others).alias("e")]
    keyed = kept(docs.select(*keys, (F.octet_length(text) + 1).cast("long").alias("size")), shared_folder(spark), "keys")  # read in each round: 8-byte numbers, no texts
    total = keyed.agg(F.sum("size")).first()[0] or 0
    parts = max(1, -(-total // (shards * part_bytes)))
    targets = [total * k // (shards * parts) for k in range(1, shards * parts)]
    tolerances = [tolerance * total / shards if k % parts == 0 else max(tolerance, PART_TOLERANCE / parts) * total / shards for k in range(1, shards * parts)]
    found = Parts(sorted(find_splitters(keyed, targets, tolerances), key=_position) if total else [])
    shared = spark.sparkContext.broadcast(found)  # one entry a part

    @F.pandas_udf("int")
    def part(h: pd.Series, d: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series(shared.value.of(h.to_numpy(), d.to_numpy(), e.to_numpy()))

    numbered = found.divided()
    counts = np.zeros(shards * parts, np.int64)
    for r in keyed.groupBy(part("h", "d", "e").alias("part")).agg(F.count("*").alias("n")).collect():  # a row a part
        counts[r["part"]] = r["n"]
    moved = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), *keys)
    if numbered:
        again, moved_on = _again(moved, keyed, found, numbered, spark)
        for a, b, n in moved_on:
            counts[a] -= n
            counts[b] += n
        table = spark.createDataFrame([k for k in numbered], "_h long, _d long, _e long")
        apart = (F.col("h") == F.col("_h")) & (F.col("d") == F.col("_d")) & (F.col("e") == F.col("_e"))
        moved = moved.join(table, apart, "left_anti").withColumn("part", part("h", "d", "e")).unionByName(again)
    else:
        moved = moved.withColumn("part", part("h", "d", "e"))
    # slots begin with the rows of the shard's parts before
    grid = counts.reshape(shards, parts)
    offsets = spark.sparkContext.broadcast((np.cumsum(grid, axis=1) - grid).ravel())
    exchanged = moved.repartitionById(shards * parts, F.col("part")).sortWithinPartitions("h", "d", "e")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0  # a task is a part
        for batch in batches:
            own = batch.column("part").to_numpy()
            slot = offsets.value[own] + np.arange(place, place + batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(own // parts, pa.int32()), pa.array(slot)], names=["row", "shard", "slot"])
            place += batch.num_rows

    row = exchanged.schema["row"]
    return exchanged.select("row", "part").mapInArrow(number, StructType([row, StructField("shard", IntegerType()), StructField("slot", LongType())]))


def _position(cut: Cut) -> tuple:
    """The order of cuts: one before all rows of a key comes before those among them, and these before the one after."""
    keys, side = cut
    return (*(x for k in keys for x in (1, k)), 0 if side is True else 2 if side is False else 1, side if not isinstance(side, bool) else 0)


def _again(moved: DataFrame, keyed: DataFrame, found: Parts, numbered: dict[tuple[int, ...], list[int]], spark) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """Rows of the groups that are cut by number, made from one of each and dealt to parts; and (part, part, rows) that lie otherwise than ``Parts`` says."""
    table = spark.createDataFrame([(*k, left) for k, left in numbered.items()], "_h long, _d long, _e long, _left array<long>")
    same = (F.col("h") == F.col("_h")) & (F.col("d") == F.col("_d")) & (F.col("e") == F.col("_e"))
    sizes = {(r["h"], r["d"], r["e"]): r["m"] for r in keyed.join(table, same).groupBy("h", "d", "e").agg(F.count("*").alias("m")).collect()}  # at most one row a cut
    moved_on, base = [], {}
    for key, left in numbered.items():
        first = int(found.of(*(np.array([x], np.int64) for x in key))[0])
        base[key] = first
        bounds = [*sorted(left), sizes[key]]
        moved_on += [(first, first + j + 1, b - a) for j, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]
    table = spark.createDataFrame([(*k, sorted(left), sizes[k], base[k]) for k, left in numbered.items()], "_h long, _d long, _e long, _left array<long>, m long, base int")
    one = moved.join(table, same).groupBy("h", "d", "e").agg(*[F.first(c).alias(c) for c in ("row", "_left", "m", "base")])
    runs = one.withColumn("run", F.explode(F.expr(f"sequence(0L, (m - 1) div {RUN})"))).repartition(F.col("h"), F.col("run"))
    each = runs.withColumn("k", F.explode(F.expr(f"sequence(run * {RUN}, least((run + 1) * {RUN}, m) - 1)")))
    beyond = F.size(F.filter("_left", lambda x: x <= F.col("k")))
    return each.select("row", "h", "d", "e", (F.col("base") + beyond).cast("int").alias("part")), moved_on


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row a document: what its row has in the shard that it was moved to."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return _placed(docs, shards, tolerance, part_bytes).select(
        F.col("row.doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )

"""Hard negatives by norm-bucketed exact search.

A score is the inner product of two vectors of whole numbers.  For each anchor, its *positives* are the first rows of its
own label, and for each positive the negatives are the first rows of other labels with a score within a window under the positive's.

1. Candidates are sorted by norm, longest first, and dealt to *cells*; a cell is a packed row with *buckets* of ``BUCKET``
   rows, of which each knows its largest norm.
2. An anchor with its windows asks the cells.  By Cauchy-Schwarz no score exceeds |anchor| x |longest of the cell|, so a cell
   that can't reach any window's lower limit is not asked at all.  The same bound leaves out buckets, against each window's
   lower limit and its running kth score, whichever is higher.
3. The cell with the longest vectors is asked first; the kth scores found there raise the windows' lower limits, and so decide
   which of the other cells are asked.
4. Each cell returns its first k rows a window; the first k of all are the result.

Anchors travel in packed blocks of at most ``ASKS``, sorted by the norm that they need, so that a task is one block against
one cell, both of bounded size, whatever the labels' and vectors' frequencies.  Routes are kept for at most ``ROUTES`` ranges
of norms, of which each may have many cells.

Defined cases: rows with a null id, label or vector, or with any null or non-finite component take no part; rows that agree in id,
label and vector count once; shorter vectors count as ending in zeros; ties go to the smaller id; an anchor without
positives, and a positive without negatives, give no row; scores beyond 64 bits are an error; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ._arrow import kept, partitions, shared_folder

BUCKET = 2048
CELL = 65_536
ASKS = 16_384
ROUTES = 1_024
LOWEST, HIGHEST = -(1 << 62), 1 << 62

_CELL = "cell int, norm double, width int, ids binary, labels binary, vectors binary"
_BLOCK = "last int, width int, k_windows int, ids binary, labels binary, vectors binary, lows binary, highs binary"


def _packed(vectors: np.ndarray) -> bytes:
    """Vectors of whole numbers as 32-bit floats where these are exact, else as doubles."""
    small = not vectors.size or np.abs(vectors).max() < 1 << 24
    return vectors.astype("<f4" if small else "<f8").tobytes()


def _unpacked(data: bytes, rows: int, width: int) -> np.ndarray:
    kind = "<f4" if len(data) == 4 * rows * width else "<f8"
    return np.frombuffer(data, kind).astype(np.float64).reshape(rows, width)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows, filled with zeros at the end."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def valid(rows: DataFrame) -> DataFrame:
    """(id, label, vector, norm2) of the rows that take part."""
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    return rows.dropDuplicates(["id", "label", "vector"]).withColumn("norm2", F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))


class Cells:
    """Candidates by norm: the packed cells, and what is needed to route to them."""

    def __init__(self, rows: DataFrame, folder: str, spread: int | None = None):
        spark = rows.sparkSession
        count, self.width = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
        self.width = max(1, self.width or 0)
        n = max(1, spread or partitions(spark), -(-count // CELL))
        width = self.width

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = [b for b in batches if b.num_rows]
            if not whole:
                return
            table = pa.Table.from_batches(whole)
            order = np.lexsort((table["id"].to_numpy(), -table["norm2"].to_numpy()))
            for at in range(0, len(order), CELL):
                part = table.take(pa.array(order[at : at + CELL]))
                vectors = _matrix(part["vector"], width)
                columns = [pa.array([0], pa.int32()), pa.array([float(np.sqrt(part["norm2"][0].as_py()))]), pa.array([width], pa.int32())]
                columns += [pa.array([x], pa.binary()) for x in (part["id"].to_numpy().tobytes(), part["label"].to_numpy().tobytes(), _packed(vectors))]
                yield pa.RecordBatch.from_arrays(columns, names=["cell", "norm", "width", "ids", "labels", "vectors"])

        # ids part equal norms, so no range holds a frequent one
        dealt = rows.repartitionByRange(n, F.desc("norm2"), "id").mapInArrow(pack, _CELL)
        packed = kept(dealt, folder, "cells-unnamed")
        # names by norm: windows over one row a cell, without the vectors
        order = Window.orderBy(F.desc("norm"), "h")
        named = packed.select("norm", F.xxhash64("ids").alias("h")).withColumn("at", (F.row_number().over(order) - 1).cast("int"))
        self.table = kept(packed.withColumn("h", F.xxhash64("ids")).drop("cell").join(named.select("norm", "h", F.col("at").alias("cell")), ["norm", "h"]).drop("h"), folder, "cells")
        self.count = named.count()
        ranges = named.withColumn("range", F.floor(F.col("at") * min(ROUTES, max(1, self.count)) / max(1, self.count)))
        #: (longest norm, last cell) of each range, from the longest on; never more than ROUTES.
        self.routes = [(r["norm"], r["last"]) for r in ranges.groupBy("range").agg(F.max("norm").alias("norm"), F.max("at").alias("last")).orderBy("range").collect()]

    def last(self, need: Column) -> Column:
        """The last cell that a vector which needs a norm of ``need`` may have to ask; -1 if none."""
        if not self.routes:
            return F.lit(-1)
        reached = F.filter(F.array(*[F.struct(F.lit(float(a)).alias("norm"), F.lit(int(b)).alias("last")) for a, b in self.routes]), lambda r: r["norm"] >= need)
        return F.coalesce(F.array_max(F.transform(reached, lambda r: r["last"])), F.lit(-1))


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each row by score, then column; columns lie by id."""
    n = scores.shape[1]
    if scores.dtype == object:  # Python's numbers
        return np.array([sorted(range(n), key=lambda j, row=row: (-row[j], j))[:k] for row in scores], np.int64)
    joint = scores * BUCKET + (n - 1 - np.arange(n))  # unique, and in the right order
    some = np.argpartition(-joint, min(k, n) - 1, axis=1)[:, :k] if n > k else np.tile(np.arange(n), (len(scores), 1))
    return np.take_along_axis(some, np.argsort(-np.take_along_axis(joint, some, 1), axis=1, kind="stable"), 1)


def answer(block: dict, cells: list[dict], same: bool, k: int) -> tuple[np.ndarray, ...]:
    """(anchor, window, score, id) of the first ``k`` rows of the cells for each window of the block's anchors."""
    asked = np.frombuffer(block["ids"], np.int64)
    labels = np.frombuffer(block["labels"], np.int64)
    n, w = len(asked), block["k_windows"]
    vectors = _unpacked(block["vectors"], n, block["width"])
    low = np.frombuffer(block["lows"], np.int64).reshape(n, w).copy()
    high = np.frombuffer(block["highs"], np.int64).reshape(n, w)
    own = np.sqrt((vectors**2).sum(1))
    best = np.full((n, w, k), LOWEST, np.int64)
    who = np.full((n, w, k), HIGHEST, np.int64)
    for cell in sorted(cells, key=lambda c: -c["norm"]):
        ids, marks = np.frombuffer(cell["ids"], np.int64), np.frombuffer(cell["labels"], np.int64)
        rows = _unpacked(cell["vectors"], len(ids), cell["width"])
        for at in range(0, len(ids), BUCKET):
            some = np.argsort(ids[at : at + BUCKET], kind="stable") + at
            longest = np.sqrt((rows[some] ** 2).sum(1).max())
            bound = own * longest * (1 + 1e-9)
            floor = np.maximum(low, best[:, :, -1])
            wanted = np.flatnonzero(((bound[:, None] >= floor) & (low <= high)).any(1))
            for first in range(0, len(wanted), 512):
                who_asks = wanted[first : first + 512]
                a = vectors[who_asks]
                exact = float(own[who_asks].max()) * float(longest) < 1 << 51
                if exact:
                    scores = (a @ rows[some].T).astype(np.int64)
                else:
                    whole = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
                    scores = whole(a).dot(whole(rows[some]).T)
                match = (labels[who_asks][:, None] == marks[some][None, :]) == same
                match &= asked[who_asks][:, None] != ids[some][None, :]
                for window in range(w):
                    held = floor[who_asks, window]
                    fits = match & (scores >= held[:, None]) & (scores <= high[who_asks, window][:, None])
                    hit = np.flatnonzero(fits.any(1))
                    if not len(hit):
                        continue
                    masked = np.where(fits[hit], scores[hit], LOWEST >> 12 if exact else LOWEST)
                    place = _top(masked, k)
                    score = np.take_along_axis(masked, place, 1)
                    good = np.take_along_axis(fits[hit], place, 1)
                    score = np.where(good, score, LOWEST).astype(np.int64)
                    found = np.where(good, ids[some][place], HIGHEST)
                    rows_of = who_asks[hit]
                    both, names = np.concatenate([best[rows_of, window], score], 1), np.concatenate([who[rows_of, window], found], 1)
                    order = np.lexsort((names, -both), axis=1)[:, :k]
                    best[rows_of, window], who[rows_of, window] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)
    i, window, j = np.nonzero(who != HIGHEST)
    return asked[i], window, best[i, window, j], who[i, window, j]


def _search(asks: DataFrame, cells: Cells, first: int, last: int | None, same: bool, k: int, folder: str, name: str) -> DataFrame:
    """(anchor_id, window, score, id) from the cells ``first`` to ``last`` for asks (anchor_id, label, vector, norm2, lows, highs); per cell, the first k."""
    spark, width = asks.sparkSession, cells.width
    need = F.array_min(F.transform(F.filter(F.arrays_zip("lows", "highs"), lambda x: x["lows"] <= x["highs"]), lambda x: x["lows"]))
    # a score over zero needs a norm; others may come from any cell
    norm = F.when(need <= 0, F.lit(0.0)).otherwise(need / F.sqrt("norm2") * (1 - 1e-9))
    asks = asks.withColumn("norm", norm).where(F.col("norm").isNotNull()).withColumn("last", cells.last(F.col("norm"))).where(F.col("last") >= first)
    asks = kept(asks, folder, f"asks-{name}")
    count = asks.count()
    blocks = max(1, -(-count // ASKS))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [b for b in batches if b.num_rows]
        if not whole:
            return
        table = pa.Table.from_batches(whole)
        for at in range(0, len(table), ASKS):
            part = table.slice(at, ASKS).combine_chunks()
            windows = max(map(len, part["lows"].to_pylist()))
            lows, highs = np.full((len(part), windows), HIGHEST, np.int64), np.full((len(part), windows), LOWEST, np.int64)
            for i, (a, b) in enumerate(zip(part["lows"].to_pylist(), part["highs"].to_pylist(), strict=True)):
                lows[i, : len(a)], highs[i, : len(b)] = a, b
            data = [part["anchor_id"].to_numpy().tobytes(), part["label"].to_numpy().tobytes(), _packed(_matrix(part["vector"], width)), lows.tobytes(), highs.tobytes()]
            columns = [pa.array([max(part["last"].to_pylist())], pa.int32()), pa.array([width], pa.int32()), pa.array([windows], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array([x], pa.binary()) for x in data], names=[x.split()[0] for x in _BLOCK.split(", ")])

    packed = asks.repartitionByRange(blocks, F.desc("norm"), "anchor_id").drop("norm", "norm2").select("anchor_id", "label", "vector", "lows", "highs", "last").mapInArrow(pack, _BLOCK)
    packed = kept(packed.withColumn("block", F.xxhash64("ids", "last")), folder, f"blocks-{name}")
    until = F.least("last", F.lit(last)) if last is not None else F.col("last")
    left = packed.withColumn("cell", F.explode(F.sequence(F.lit(first), until)))
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    left = left.select("cell", "block", "width", "ids", "labels", "vectors", "k_windows", "lows", "highs", none("norm", "double"))
    wanted = left.select("cell", "block")
    right = cells.table.join(wanted, "cell").select("cell", "block", "width", "ids", "labels", "vectors", none("k_windows", "int"), none("lows", "binary"), none("highs", "binary"), "norm")

    def work(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        parts = [answer(r, [c for c in rows if c["norm"] is not None], same, k) for r in rows if r["norm"] is None]
        cat = [np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in range(4)]
        return pa.table({"anchor_id": pa.array(cat[0], pa.int64()), "window": pa.array(cat[1].astype(np.int32)), "score": pa.array(cat[2], pa.int64()), "id": pa.array(cat[3], pa.int64())})

    return left.unionByName(right).groupBy("cell", "block").applyInArrow(work, "anchor_id long, window int, score long, id long")


def first_rows(asks: DataFrame, cells: Cells, same: bool, k: int, folder: str, name: str) -> DataFrame:
    """(anchor_id, window, score, id, rank) of the first k rows of each window: the longest cell first, then those its kth scores leave."""
    seed = kept(_search(asks, cells, 0, 0, same, k, folder, f"{name}-seed"), folder, f"{name}-seed-found")
    kth = seed.groupBy("anchor_id", "window").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k)
    raised = kth.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("window", "kth"))).alias("kth"))  # a window an entry
    rest = asks.join(raised, "anchor_id", "left")
    rest = rest.withColumn("lows", F.transform("lows", lambda x, i: F.greatest(x, F.get(F.array(F.try_element_at("kth", i)), F.lit(0))))).drop("kth")
    found = seed if cells.count < 2 else seed.unionByName(_search(rest, cells, 1, None, same, k, folder, f"{name}-rest"))
    rank = F.row_number().over(Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "id"))
    return kept(found.withColumn("rank", rank).where(F.col("rank") <= k), folder, name)


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, spread: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    rows: id, label, vector (whole numbers).  ``anchors``: which rows ask.  A negative's score lies between ``low`` percent of the
    positive's and the positive's.  ``spread``: into how many cells to deal the candidates at least (default: shuffle partitions).
    """
    folder = shared_folder(rows.sparkSession)
    taken = kept(valid(rows), folder, "rows")
    cells = Cells(taken, folder, spread)
    asking = taken.where(anchors).withColumnRenamed("id", "anchor_id")
    whole = asking.withColumns({"lows": F.array(F.lit(LOWEST)), "highs": F.array(F.lit(HIGHEST))})
    own = first_rows(whole, cells, True, positives, folder, "positives")
    floor = F.ceil(F.col("score").cast("decimal(38,0)") * low / 100).cast("long")
    windows = own.withColumn("low", floor).groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score", "low"))).alias("p"))  # at most ``positives``
    windows = windows.withColumns({"lows": F.transform("p", lambda x: x["low"]), "highs": F.transform("p", lambda x: x["score"])})
    asks = kept(asking.join(windows.select("anchor_id", "lows", "highs"), "anchor_id"), folder, "windows")
    found = first_rows(asks, cells, False, negatives, folder, "negatives")
    of = own.select("anchor_id", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(of, ["anchor_id", "window"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

"""Anchored quotas: N visits a window, where a window opens with the first visit at least a minute after the last opening.

Which visits open windows depends on all visits before, but only through one number, the time of the last opening.  What a
span of time does to that number is a step function, and functions of neighbouring spans can be composed:

1. Visits are grouped by key and *chunk* of ``CHUNK_S`` seconds.  A chunk's function has a step for each opening with which it may be left:
   the last opening in the chunk, if the first one is no earlier than a given time.  Only entries in its first minute are possible.
2. ``FANOUT`` neighbouring functions are composed into one, level by level, until a key has one.
3. From the top level down, the opening before each span is passed to its parts.
4. In each chunk the openings are followed from the first one; a visit belongs to the last opening up to it, and the first N visits of each are allowed.

A group has a key's visits of one chunk, or as many steps as a key has visits in a minute times ``FANOUT``; no group has all visits of a key.
The work is linear in the visits.

Defined cases: visits without a key (null or empty) or time are allowed; visits at the same time go by ``order``; repeated rows
count each; negative times (before 1970) are like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.tables import scratch, written

MINUTE = 60_000_000
CHUNK_S = 600
FANOUT = 64
NEVER = -(1 << 61)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of lists without nulls in a row, and the offsets of each list."""
    off = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), off - off[0]


def _array(values: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values, pa.int64()))


class Chunks:
    """Sorted times of many chunks at once, and for each time the place of the first one a minute later in its chunk (or its end)."""

    def __init__(self, times: np.ndarray, off: np.ndarray, begins: np.ndarray):
        self.times, self.off, self.begins = times, off, begins
        self.owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
        # a time beyond its chunk is less than the next chunk's on this scale
        self.scale = 1 << 42
        self.line = times - begins[self.owner] + self.owner * self.scale
        self.next = np.searchsorted(self.line, self.line + MINUTE)

    def first_from(self, at: np.ndarray) -> np.ndarray:
        """The place of each chunk's first time no earlier than ``at``; its end if there is none."""
        least = np.clip(at - self.begins, 0, self.scale - 1) + np.arange(len(at)) * self.scale
        return np.minimum(np.searchsorted(self.line, least), self.off[1:])

    def steps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entries, exits, offsets): a chunk entered at or before an entry, and after the entry before it, is left with the exit."""
        end = self.off[1:][self.owner]
        last = np.where(self.next < end, self.next, np.arange(len(self.times)))
        while True:  # doubling: as often as the number of windows in a chunk has binary digits
            further = last[last]
            if (further == last).all():
                break
            last = further
        inner = np.concatenate([[True], self.owner[1:] != self.owner[:-1]]) if len(self.times) else np.zeros(0, bool)
        before = np.concatenate([[0], self.times[:-1]])
        possible = np.flatnonzero(inner | (before < self.begins[self.owner] + MINUTE))
        new_exit = np.concatenate([(last[possible][1:] != last[possible][:-1]), [True]]) if len(possible) else np.zeros(0, bool)
        some = possible[new_exit]  # the last entry of each exit
        return self.times[some], self.times[last[some]], np.searchsorted(self.owner[some], np.arange(len(self.off)))

    def openings(self, opened: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(times, offsets) of the openings in each chunk, given the last one before it."""
        marked = np.zeros(len(self.times), bool)
        at, end = self.first_from(opened + MINUTE), self.off[1:]
        live = np.flatnonzero(at < end)
        at = at[live]
        while len(live):
            marked[at] = True
            at = self.next[at]
            on = at < end[live]
            live, at = live[on], at[on]
        return self.times[marked], np.concatenate([[0], np.cumsum(marked)])[self.off]


def _composed(parts: list[tuple[np.ndarray, np.ndarray]], begin: int) -> tuple[np.ndarray, np.ndarray]:
    """One step function for neighbouring ones, in order of time."""
    entry, exit_ = parts[0]
    for enter, leave in parts[1:]:
        at = np.searchsorted(enter, exit_ + MINUTE)
        on = np.where(at < len(enter), leave[np.minimum(at, len(enter) - 1)], exit_)
        later = enter > entry[-1]
        entry, exit_ = np.concatenate([entry, enter[later]]), np.concatenate([on, leave[later]])
    possible = np.concatenate([[True], entry[:-1] < begin + MINUTE])
    entry, exit_ = entry[possible], exit_[possible]
    last = np.concatenate([exit_[1:] != exit_[:-1], [True]])
    return entry[last], exit_[last]


def _up(level: DataFrame, size: int) -> DataFrame:
    """Functions (key, part, begin, entries, exits) of spans of ``size`` parts."""

    def compose(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        rows = table.select(["entries", "exits"]).to_pylist()
        begin = table["begin"][0].as_py()
        entry, exit_ = _composed([(np.array(r["entries"], np.int64), np.array(r["exits"], np.int64)) for r in rows], begin)
        return pa.table({"key": table["key"].slice(0, 1), "part": pa.array([table["up"][0].as_py()], pa.int64()), "begin": pa.array([begin], pa.int64()), "entries": pa.array([entry.tolist()], pa.list_(pa.int64())), "exits": pa.array([exit_.tolist()], pa.list_(pa.int64()))})

    return level.withColumn("up", F.floor(F.col("part") / size)).groupBy("key", "up").applyInArrow(compose, "key string, part long, begin long, entries array<long>, exits array<long>")


def _down(level: DataFrame, above: DataFrame, size: int) -> DataFrame:
    """(key, part, opened): the last opening before each part, given that before each span of ``size`` parts."""

    def follow(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        opened, out = table["opened"][0].as_py(), []
        for r in table.select(["entries", "exits"]).to_pylist():
            out.append(opened)
            at = int(np.searchsorted(np.array(r["entries"], np.int64), opened + MINUTE))
            opened = r["exits"][at] if at < len(r["exits"]) else opened
        return pa.table({"key": table["key"], "part": table["part"], "opened": pa.array(out, pa.int64())})

    parts = level.withColumn("up", F.floor(F.col("part") / size)).join(above.select("key", F.col("part").alias("up"), "opened"), ["key", "up"])
    return parts.select("key", "up", "part", "entries", "exits", "opened").groupBy("key", "up").applyInArrow(follow, "key string, part long, opened long")


def openings(times: DataFrame, folder: str) -> DataFrame:
    """(key, part, opened, starts) of sorted times (key, part, begin, times): the opening before each chunk, and those in it."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = Chunks(*_lists(batch.column("times")), batch.column("begin").to_numpy())
            entry, exit_, off = chunks.steps()
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("part"), batch.column("begin"), _array(entry, off), _array(exit_, off)], names=["key", "part", "begin", "entries", "exits"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = Chunks(*_lists(batch.column("times")), batch.column("begin").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("part"), batch.column("opened"), _array(*chunks.openings(batch.column("opened").to_numpy()))], names=["key", "part", "opened", "starts"])

    levels = [written(times.mapInArrow(step, "key string, part long, begin long, entries array<long>, exits array<long>"), folder, "level-0")]
    spread = (levels[0].agg(F.max("part")).first()[0] or 0) + 1
    while spread > FANOUT:
        levels.append(written(_up(levels[-1], FANOUT), folder, f"level-{len(levels)}"))
        spread = -(-spread // FANOUT)
    # the top's parts are all one span
    opened = levels[-1].select("key").distinct().select("key", F.lit(0).cast("long").alias("part"), F.lit(NEVER).alias("opened"))
    for k in reversed(range(len(levels))):
        opened = written(_down(levels[k], opened, FANOUT), folder, f"opened-{k}")
    return times.join(opened, ["key", "part"]).mapInArrow(mark, "key string, part long, opened long, starts array<long>")


def anchored_quota(visits: DataFrame, per_minute: int, key: str = "host", time: str = "ts", order: str = "event_id") -> DataFrame:
    """Adds allowed to visits: the first ``per_minute`` of each window.  Windows are anchored to the visits of a key, not to the clock."""
    folder = scratch(visits.sparkSession)
    us = F.unix_micros(F.col(time).cast("timestamp"))
    counted = F.coalesce((F.col(key) != "") & us.isNotNull(), F.lit(False))
    length = CHUNK_S * 1_000_000
    rows = visits.withColumns({"_key": F.col(key).cast("string"), "_us": us, "_chunk": F.floor(us / length)})
    some = rows.where(counted)
    least = some.agg(F.min("_chunk")).first()[0]
    if least is None:
        return visits.withColumn("allowed", F.lit(True))
    times = some.groupBy(F.col("_key").alias("key"), (F.col("_chunk") - least).alias("part")).agg(F.array_sort(F.collect_set("_us")).alias("times"))
    times = written(times.withColumn("begin", (F.col("part") + least) * length), folder, "times")
    starts = openings(times, folder).select(F.col("key").alias("_key"), (F.col("part") + least).alias("_chunk"), "opened", "starts")
    placed = some.join(starts.withColumnsRenamed({"opened": "_opened", "starts": "_starts"}), ["_key", "_chunk"])
    placed = placed.withColumn("_window", F.coalesce(F.array_max(F.filter("_starts", lambda s: s <= F.col("_us"))), F.col("_opened")))
    place = F.row_number().over(Window.partitionBy("_key", "_window").orderBy("_us", order))
    flagged = placed.withColumn("allowed", place <= per_minute).select(*visits.columns, "allowed")
    return flagged.unionByName(rows.where(~counted).select(*visits.columns, F.lit(True).alias("allowed")))

"""Anchored quotas against a fold in order, over gaps, ties, chunk borders, dense and sparse hosts."""

from __future__ import annotations

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import quota


def folded(rows, per_minute):
    """(id, allowed) by visiting all rows in order."""
    state, out = {}, set()
    for host, us, i in sorted((r for r in rows if r[0] and r[1] is not None), key=lambda r: (r[0], r[1], r[2])):
        opened, used = state.get(host, (-(1 << 62), 0))
        if us - opened >= 60_000_000:
            opened, used = us, 0
        out.add((i, used < per_minute))
        state[host] = opened, used + 1
    return out | {(r[2], True) for r in rows if not r[0] or r[1] is None}


def visits(seed, n):
    r = random.Random(seed)
    rows, at = [], {}
    for i in range(n):
        host = r.choice(["hot", "hot", "hot", "a", "b", "rare"]) if i % 50 else r.choice(["", None, "far"])
        gap = {"hot": r.choice([0, 100_000, 3_000_000, 7_000_000]), "a": r.choice([20_000_000, 60_000_000, 59_999_999]), "b": r.choice([1, 600_000_000]), "rare": r.randrange(10**12)}.get(host, r.randrange(-(10**15), 10**15))
        at[host] = at.get(host, -5_000_000) + gap
        rows.append((host, None if i % 97 == 0 else at[host], i))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk, fanout, per_minute", [(600, 64, 1), (60, 2, 3), (90, 3, 2)])
def test_equals_a_fold(spark, monkeypatch, chunk, fanout, per_minute):
    monkeypatch.setattr(quota, "CHUNK_S", chunk)
    monkeypatch.setattr(quota, "FANOUT", fanout)
    rows = visits(chunk, 3000)
    if fanout == 2:  # times within some months, so that levels stay few
        rows = [(h, None if t is None else t % 10**13, i) for h, t, i in rows]
    df = spark.createDataFrame(rows, "host string, us long, event_id long").withColumn("ts", F.timestamp_micros("us")).withColumns({"part": F.lit("clash"), "key": F.lit(1), "opened": F.lit("clash"), "times": F.lit(1)})
    got = quota.anchored_quota(df, per_minute)
    assert got.columns == [*df.columns, "allowed"]
    got = [(r.event_id, r.allowed) for r in got.collect()]
    assert len(got) == len(rows) and set(got) == folded(rows, per_minute)


def test_repeated_rows_and_nothing(spark):
    t = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([("h", t, 1)] * 5 + [("h", t, 2)], "host string, ts timestamp, event_id long")
    assert sorted((r.event_id, r.allowed) for r in quota.anchored_quota(df, 3).collect()) == [(1, False)] * 2 + [(1, True)] * 3 + [(2, False)]
    assert quota.anchored_quota(df.limit(0), 3).count() == 0
    assert [r.allowed for r in quota.anchored_quota(df.withColumn("host", F.lit("")), 1).collect()] == [True] * 6


def test_composed_functions_are_functions_of_the_whole():
    """Openings through composed steps are those of a walk over all times, whatever the opening before."""
    r = np.random.default_rng(4)
    for _ in range(30):
        times = np.unique(r.integers(0, 30 * quota.MINUTE, r.integers(1, 400)))
        parts, begins = [], np.arange(0, 30, 5) * quota.MINUTE
        cuts = np.searchsorted(times, begins)
        chunks = quota.Chunks(times, np.append(cuts, len(times)), begins)
        entry, exit_, off = chunks.steps()
        parts = [(entry[a:b], exit_[a:b]) for a, b in zip(off[:-1], off[1:], strict=True) if a < b]
        enter, leave = quota._composed(parts, 0)
        assert (np.diff(enter) > 0).all() and (np.diff(leave) != 0).all() and len(enter) == len(leave)
        for opened in [quota.NEVER, *r.integers(-quota.MINUTE, 0, 20).tolist()]:
            last = opened
            for t in times.tolist():
                last = t if t - last >= quota.MINUTE else last
            at = int(np.searchsorted(enter, opened + quota.MINUTE))
            assert (int(leave[at]) if at < len(leave) else opened) == last

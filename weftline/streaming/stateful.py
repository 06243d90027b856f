"""Streaming operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import Policy
from ..functions.urls import normalize_url
from ..operators import provenance, robots, telemetry
from ..sources import sinks

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class AnchoredBucket(StatefulProcessor):
    """N visits a window for each host; a window opens with the first visit at least 60 s after the last opening.

    State per host is two numbers and, where ``ttl_ms`` is given, lives that long without visits; a query with such a
    state goes on making batches without data.
    """

    def __init__(self, per_minute: int, ttl_ms: int | None = None):
        self.per_minute, self.ttl_ms = per_minute, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bucket", "opened long, used int", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        opened, used = self.state.get() if self.state.exists() else (-(1 << 62), 0)
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        allowed = []
        for at in frame["ts"].astype("datetime64[us]").astype("int64"):
            if at - opened >= 60_000_000:
                opened, used = int(at), 0
            allowed.append(used < self.per_minute)
            used += allowed[-1]
        self.state.update((opened, used))
        yield pd.DataFrame({"host": key[0], "event_id": frame["event_id"].values, "ts": frame["ts"].values, "allowed": allowed})

    def close(self) -> None:
        pass


def _mode(ttl_ms: int | None) -> str:
    return "processingtime" if ttl_ms else "none"


def rate_limited(visits: DataFrame, per_minute: int, ttl_ms: int | None = None) -> DataFrame:
    """visits: host, event_id, ts.  Needs the RocksDB state store."""
    return visits.groupBy("host").transformWithStateInPandas(AnchoredBucket(per_minute, ttl_ms), "host string, event_id long, ts timestamp, allowed boolean", "append", _mode(ttl_ms))


def rolling_error_rate(log: DataFrame, lateness: str = "10 minutes", size: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Share of blocked rows by event-time window; windows close when the watermark has passed them."""
    windowed = log.withWatermark("timestamp", lateness).groupBy(F.window("timestamp", size, slide).alias("w") if slide else F.window("timestamp", size).alias("w"))
    out = windowed.agg(F.count("*").alias("n"), F.count_if(F.col("pii_action") == "blocked").alias("errors"))
    return out.select("w.start", "w.end", "n", "errors", (F.col("errors") / F.col("n")).alias("error_rate"))


def distinct_urls(results: DataFrame, within: str = "1 hour") -> DataFrame:
    """The first result of each canonical URL; later ones within the watermark are dropped."""
    return results.withColumn("norm_url", normalize_url(F.col("url"))).withWatermark("ts", within).dropDuplicatesWithinWatermark(["norm_url"])


class RuleCache(StatefulProcessor):
    """Robots texts with a lifetime by event time: rows of fetches refresh a host's text, visits get what is still valid.

    ``drop_ms`` is how long an unused text's state is kept.
    """

    def __init__(self, ttl_ms: int, policy: Policy, drop_ms: int | None = None):
        self.ttl_ms, self.policy, self.drop_ms = ttl_ms, policy, drop_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("text", "status int, body string, fetched long", ttlDurationMs=self.drop_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        status, body, fetched = self.state.get() if self.state.exists() else (None, None, None)
        found = robots.parse(status, body, self.policy.user_agent, self.policy.robots_5xx_open)
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        out, new = [], False
        for r in frame.itertuples():
            at = int(pd.Timestamp(r.ts).value // 1_000_000)
            if r.fetch:
                status, body, fetched, new = None if pd.isna(r.status) else int(r.status), r.body if isinstance(r.body, str) else None, at, True
                found = robots.parse(status, body, self.policy.user_agent, self.policy.robots_5xx_open)
                continue
            state, rules = found if fetched is not None and at - fetched < self.ttl_ms else ("error", [])
            out.append((key[0], r.event_id, state != "error", state != "disallow_all" and robots.decide(rules, str(r.path))))
        if new:
            self.state.update((status, body, fetched))
        yield pd.DataFrame(out, columns=["host", "event_id", "checked", "allowed"])

    def close(self) -> None:
        pass


def robots_checked(rows: DataFrame, ttl_ms: int, policy: Policy = Policy(), drop_ms: int | None = None) -> DataFrame:
    """rows: host, event_id, ts, fetch, path (of a visit), status, body (of a fetch, null where it failed)."""
    return rows.groupBy("host").transformWithStateInPandas(RuleCache(ttl_ms, policy, drop_ms), "host string, event_id long, checked boolean, allowed boolean", "append", _mode(drop_ms))


def export_provenance(records: DataFrame, path: str, checkpoint: str, every: str = "5 seconds", once: bool = False):
    """Writes batches of records by batch and date; a batch that comes again after a failure replaces itself, so none is dropped or there twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.dropDuplicates(["request_id", "url", "timestamp", "reranker_rank"])
        provenance.write(rows, path, batch_id)

    writer = records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def export_counters(ranked: DataFrame, path: str, checkpoint: str, every: str = "5 seconds", once: bool = False):
    """Adds the ten counters of each batch of documents to a committed table: a batch that comes again counts once.

    All documents of a request come in one batch.
    """
    sinks.register(ranked.sparkSession)

    def write(batch: DataFrame, batch_id: int) -> None:
        counted = telemetry.pipeline_counters(batch, batch.select("request_id").distinct())
        counted.coalesce(1).write.format("committed").mode("append").option("path", path).option("batch", f"counters-{batch_id:012d}").save()  # a row a counter

    writer = ranked.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def drop_expired(spark, path: str, now: str, days: int = 90, delete: Callable[[str], None] | None = None) -> list[str]:
    """Date partitions older than the retention, of all batches; deletes them through Spark's file system unless told how."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    limit = str((pd.Timestamp(now) - pd.Timedelta(days=days)).date())
    names = lambda at: [f.getPath().getName() for f in fs.listStatus(jvm.org.apache.hadoop.fs.Path(at))]
    every = [n for n in names(path) if n.startswith("date=")]
    every += [f"{b}/{n}" for b in names(path) if b.startswith("batch=") for n in names(f"{path}/{b}") if n.startswith("date=")]
    old = sorted(n for n in every if n.rpartition("date=")[2] < limit)
    for name in old:
        (delete or (lambda p: fs.delete(jvm.org.apache.hadoop.fs.Path(p), True)))(f"{path}/{name}")
    return old

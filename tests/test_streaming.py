"""Streams give what the batch operators give."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from weftline.operators import policy
from weftline.plans.views import table, view
from weftline.streaming import stateful


def stream(spark, rows, path, files=3):
    """The rows as a stream of several files in order of time."""
    for k, part in enumerate(rows.randomSplit([1.0] * files, 7) if "ts" not in rows.columns else _by_time(rows, files)):
        part.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1 if k + 1 < files else 0)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _by_time(rows, files):
    n = rows.count()
    cuts = [r[0] for r in rows.select("ts").orderBy("ts").collect()]
    edges = [cuts[n * k // files] for k in range(1, files)]
    low = None
    for high in [*edges, None]:
        part = rows if low is None else rows.where(F.col("ts") >= F.lit(low))
        yield part if high is None else part.where(F.col("ts") < F.lit(high))
        low = high


def drained(query_of, name, path):
    q = query_of.writeStream.format("memory").queryName(name).option("checkpointLocation", path).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)


def visits(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("h"), (F.col("user_id") % 3).cast("string")).alias("host"), F.col("ts").cast("timestamp").alias("ts"))


def test_rate_limit_stream(spark, sf_dir, tmp_path):
    rows = visits(spark, sf_dir).limit(300).cache()
    live = stream(spark, rows, str(tmp_path / "in"))
    drained(stateful.rate_limited(live, 1), "limited", str(tmp_path / "cp"))
    got = {(r.event_id, r.allowed) for r in spark.table("limited").collect()}
    want = {(r.event_id, r.allowed) for r in policy.anchored_quota(rows, 1).collect()}
    assert got == want


def test_distinct_urls_stream(spark, tmp_path):
    """The first result of each canonical URL within the watermark; later ones, and those of other batches, are dropped."""
    import datetime

    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    data = [(1, "https://a.com/x?utm_source=s", at(0)), (2, "https://A.com/x/", at(1)), (3, "https://a.com/y", at(2)), (4, "https://a.com/x", at(30)), (5, "https://a.com/y#top", at(59)), (6, "https://b.com/", at(240)), (7, "https://a.com/x", at(241))]
    rows = spark.createDataFrame(data, "event_id long, url string, ts timestamp")
    live = stream(spark, rows, str(tmp_path / "in"), files=4)
    drained(stateful.distinct_urls(live), "urls", str(tmp_path / "cp"))
    got = sorted(r.event_id for r in spark.table("urls").collect())
    assert {1, 3, 6} <= set(got) <= {1, 3, 6, 7} and 4 not in got and 5 not in got


def test_error_rate_stream(spark, sf_dir, tmp_path):
    rows = view(spark, sf_dir, "provenance_log").select(F.col("timestamp").cast("timestamp").alias("timestamp"), "pii_action", F.col("timestamp").cast("timestamp").alias("ts"))
    live = stream(spark, rows, str(tmp_path / "in")).drop("ts")
    drained(stateful.rolling_error_rate(live), "rates", str(tmp_path / "cp"))
    got = {r.start: (r.n, r.errors) for r in spark.table("rates").collect()}
    want = {r.w.start: (r.n, r.errors) for r in rows.groupBy(F.window("timestamp", "5 minutes").alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("pii_action") == "blocked").alias("errors")).collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(got) >= len(want) - 5


def test_robots_cache_and_export(spark, tmp_path):
    import datetime

    t = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    body = "User-agent: *\nDisallow: /x\nAllow: /x/open"
    data = [(1, t(0), False, "/x", None, None), (2, t(1), True, None, 200, body), (3, t(2), False, "/x/y", None, None), (4, t(3), False, "/z", None, None), (5, t(4), False, "/x/open/1", None, None), (6, t(200), False, "/x", None, None), (7, t(201), True, None, None, None), (8, t(202), False, "/x", None, None)]
    rows = spark.createDataFrame([(k, "h", *r) for k, *r in data], "event_id long, host string, ts timestamp, fetch boolean, path string, status int, body string")
    live = stream(spark, rows, str(tmp_path / "in"), files=1)
    drained(stateful.robots_checked(live, 60_000), "rules", str(tmp_path / "cp"))
    got = {r.event_id: (r.checked, r.allowed) for r in spark.table("rules").collect()}
    assert got == {1: (False, True), 3: (True, False), 4: (True, True), 5: (True, True), 6: (False, True), 8: (False, True)}
    records = rows.select(F.lit("r").alias("request_id"), F.lit("u").alias("url"), F.col("ts").alias("timestamp"), F.col("event_id").cast("int").alias("reranker_rank"), "ts")
    log = stream(spark, records, str(tmp_path / "log_in"), files=2).drop("ts")
    stateful.export_provenance(log, str(tmp_path / "log"), str(tmp_path / "log_cp"), once=True).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 8


def test_sources():
    import json

    from weftline.sources import metasearch as M

    body = json.dumps({"results": [{"url": "http://a", "score": 1, "x": 2}]})
    reader = M.MetasearchReader({"requests": json.dumps([{"request_id": "r", "url": "http://s/search?q=1"}])}, fetch=lambda url, timeout, headers: body)
    assert [row for p in reader.partitions() for row in reader.read(p)] == [("r", 1, "http://a", "", "", "", [], 1.0, "")]

    def refuse(url, timeout, headers):
        raise OSError("down")

    pages = M.PageReader({"urls": '["http://a"]'}, fetch=refuse)
    assert [row for p in pages.partitions() for row in pages.read(p)] == [(0, "http://a", None, "down")]
    robots = M.RobotsReader({"hosts": '["a.com"]'}, fetch=lambda url, timeout, headers: (404, url))
    assert [row for p in robots.partitions() for row in robots.read(p)] == [("a.com", 404, "https://a.com/robots.txt")]
    assert [row for p in robots.partitions() for row in M.RobotsReader({}, fetch=refuse).read(p)] == [("a.com", None, None)]
    assert M.MetasearchSource.name() == "metasearch" and M.PageSource.name() == "pages"

"""Traces: trees of spans from intervals, self times, critical paths, and OTLP lines.

An interval is (trace_id, name, level, started, ended) in microseconds; ``level`` says how deep a kind of span may lie: 0 for a
request, 1 for its stages, 2 for their documents.  A span's parent is, of the spans of its trace with a lower level that hold its
interval, the deepest, then the shortest, then the latest, then the one with the largest id; without one it is a root.

- ``self_us``: the time in which none of a span's children ran.
- ``on_path``: whether the span is on its trace's critical path: going back from a span's end, the child that ends last decides,
  then, from that child's start, the one that ends last before it, and so on.  Roots are on it.
- ``path_us``: the span's own part of that path, 0 off the path.  The parts of a tree sum up to its root's duration.

A span's children are merged by their starts and by their ends before they are read in order, so equal times cost nothing; the spans over the deepest
level of a trace are its stages, and each other span meets those only.

Defined cases: rows without a start are left out; a missing end, or one before the start, is the start; equal rows are spans of
their own; a null trace or name is an empty one; extra columns are left out, but for ``attributes`` in ``otlp_lines``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.tables import scratch, written

# The names of spans by level.
STAGES = {"pipeline": 0, "search": 1, "policy": 1, "scrape": 1, "pii": 1, "injection": 1, "rerank": 1, "format": 1, "scrape.page": 2, "provenance": 2}
LEVELS = 3


def level_of(name: Column) -> Column:
    """The level of a stage's name; others lie deepest."""
    out = F.lit(max(STAGES.values()))
    for stage, level in STAGES.items():
        out = F.when(name == stage, level).otherwise(out)
    return out


def identified(intervals: DataFrame) -> DataFrame:
    """(trace_id, span_id, name, level, started, ended) with ids that depend on the row alone, and on its number among equal ones."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = intervals.where("started is not null").select(text("trace_id"), text("name"), F.col("level").cast("int").alias("level"), F.col("started").cast("long").alias("started"), F.greatest(F.coalesce("ended", "started"), "started").cast("long").alias("ended"))
    fields = ["trace_id", "name", "level", "started", "ended"]
    number = F.row_number().over(Window.partitionBy(*fields).orderBy("started"))
    return rows.select(*fields, F.substring(F.sha2(F.concat_ws("|", *fields, number), 256), 1, 16).alias("span_id"))


def with_parents(spans: DataFrame, folder: str) -> DataFrame:
    """Adds parent_id, by an equi-join on the trace with the spans that may hold others: those over the trace's deepest level."""
    deepest = spans.groupBy(F.col("trace_id").alias("_t")).agg(F.max("level").alias("_deepest"))
    holder = F.struct(F.col("level").alias("l"), (F.col("started") - F.col("ended")).alias("d"), F.col("started").alias("s"), F.col("span_id").alias("id"))
    above = spans.join(deepest, F.col("trace_id") == F.col("_t")).where(F.col("level") < F.col("_deepest"))
    over = written(above.select("_t", F.col("started").alias("_a"), F.col("ended").alias("_b"), holder.alias("_p")), folder, "holders")
    holds = (F.col("trace_id") == F.col("_t")) & (F.col("_p.l") < F.col("level")) & (F.col("_a") <= F.col("started")) & (F.col("_b") >= F.col("ended"))
    return spans.join(over, holds, "left").groupBy(*spans.columns).agg(F.max("_p")["id"].alias("parent_id"))


def deciding(children: DataFrame) -> DataFrame:
    """(parent_id, ended, began, id): the ends at which a parent's critical path goes back, and the child with that end that it takes.

    Of the children with one end, those without length decide first, all of them, then the one that began last (``id``, null if none has a
    length), and no other; so a parent is its different ends, read in order as a stream.
    """
    ran = F.when(F.col("started") < F.col("ended"), F.struct((-F.col("started")).alias("s"), F.col("span_id").alias("id")))
    ends = children.groupBy("parent_id", "ended").agg(F.min(ran).alias("r")).select("parent_id", "ended", (-F.col("r.s")).alias("began"), F.col("r.id").alias("id"))

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent, until = None, 0
        for batch in batches:
            fits = []
            for own, ended, began in zip(*(batch.column(c).to_pylist() for c in ("parent_id", "ended", "began")), strict=True):
                if own != parent:
                    parent, until = own, ended
                fits.append(ended <= until)
                if fits[-1] and began is not None:
                    until = began
            yield batch.filter(pa.array(fits, pa.bool_()))

    return ends.repartition("parent_id").sortWithinPartitions("parent_id", F.desc("ended")).mapInArrow(back, ends.schema)


def assembled(intervals: DataFrame) -> DataFrame:
    """(trace_id, span_id, parent_id, name, level, started, ended, self_us, on_path, path_us) of all intervals."""
    folder = scratch(intervals.sparkSession)
    tree = written(with_parents(written(identified(intervals), folder, "spans"), folder), folder, "tree")
    children = tree.where("parent_id is not null")
    # what children cover: each start adds what lies behind all that began before it
    starts = children.groupBy("parent_id", "started").agg(F.max("ended").alias("ended"))
    so_far = F.max("ended").over(Window.partitionBy("parent_id").orderBy("started").rowsBetween(Window.unboundedPreceding, -1))
    added = F.greatest(F.lit(0), F.col("ended") - F.greatest("started", F.coalesce(so_far, F.col("started"))))
    covered = starts.withColumn("added", added).groupBy("parent_id").agg(F.sum("added").alias("covered"))
    taken = written(deciding(children), folder, "taken")
    spent = taken.groupBy("parent_id").agg(F.sum(F.col("ended") - F.coalesce("began", "ended")).alias("spent"))
    sums = covered.join(spent, "parent_id").withColumnRenamed("parent_id", "_id")
    at = taken.select(F.col("parent_id").alias("_p"), F.col("ended").alias("_e"), F.coalesce("id", F.lit("")).alias("_best"))

    def decided(spans: DataFrame) -> DataFrame:
        met = spans.join(at, (F.col("parent_id") == F.col("_p")) & (F.col("ended") == F.col("_e")), "left")
        own = F.col("_p").isNotNull() & ((F.col("started") == F.col("ended")) | (F.col("span_id") == F.col("_best")))
        return met.withColumn("decides", F.col("parent_id").isNull() | own).drop("_p", "_e", "_best")

    # on the path: a span that decides and whose ancestors all do, level by level; only spans with children are ancestors
    parents = written(decided(tree.join(sums, F.col("span_id") == F.col("_id")).drop("_id")), folder, "parents")
    path = known = parents.select("span_id", "parent_id", "decides", "covered", "spent")
    for _ in range(LEVELS - 2):
        above = known.select(F.col("span_id").alias("_id"), F.col("parent_id").alias("_up"), F.col("decides").alias("_d"))
        path = path.join(above, F.col("parent_id") == F.col("_id"), "left").select("span_id", F.col("_up").alias("parent_id"), (F.col("decides") & F.coalesce("_d", F.lit(True))).alias("decides"), "covered", "spent")
    path = written(path, folder, "path")
    over = path.select(F.col("span_id").alias("_up"), F.col("decides").alias("_on"))
    out = decided(tree).join(over, F.col("parent_id") == F.col("_up"), "left").withColumn("on_path", F.col("decides") & F.coalesce("_on", F.lit(True)))
    out = out.join(path.select("span_id", "covered", "spent"), "span_id", "left")
    length = F.col("ended") - F.col("started")
    return out.select(
        "trace_id", "span_id", "parent_id", "name", "level", "started", "ended", (length - F.coalesce("covered", F.lit(0))).alias("self_us"),
        "on_path", F.when(F.col("on_path"), length - F.coalesce("spent", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("path_us"),
    )


def otlp_lines(spans: DataFrame, service: str = "weftline") -> DataFrame:
    """(value): a span a line in OTLP's JSON form, for ``write.text``; ``attributes``, where there, is a map of strings."""
    said = lambda k, v: F.struct(k.alias("key"), F.struct(v.alias("stringValue")).alias("value"))
    has = "attributes" in spans.columns
    own = F.transform(F.map_entries("attributes"), lambda e: said(e["key"], e["value"])) if has else F.array().cast("array<struct<key: string, value: struct<stringValue: string>>>")
    nano = lambda c: F.concat(F.col(c).cast("string"), F.lit("000"))
    span = F.struct(
        F.substring(F.sha2("trace_id", 256), 1, 32).alias("traceId"), F.col("span_id").alias("spanId"), F.coalesce("parent_id", F.lit("")).alias("parentSpanId"), F.col("name"), F.lit(1).alias("kind"),
        nano("started").alias("startTimeUnixNano"), nano("ended").alias("endTimeUnixNano"), own.alias("attributes"),
    )
    scoped = F.array(F.struct(F.struct(F.lit(service).alias("name")).alias("scope"), F.array(span).alias("spans")))
    resource = F.struct(F.array(said(F.lit("service.name"), F.lit(service))).alias("attributes"))
    return spans.select(F.to_json(F.struct(F.array(F.struct(resource.alias("resource"), scoped.alias("scopeSpans"))).alias("resourceSpans"))).alias("value"))

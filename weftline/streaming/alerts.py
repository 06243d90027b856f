"""Alerts that need a condition to hold for some time: batch and streaming give the same transitions.

A rule's value is computed for each minute from the facts of the last minutes.  While the condition holds, the rule is *pending*; once it
has held for ``hold`` minutes it is *firing*; when it ends, it is *resolved* if it was firing, else *inactive*.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MINUTE_US = 60_000_000
TICK = "rule string, at timestamp, value double, active boolean"
STATE = "rule string, state string, at timestamp"


@dataclass(frozen=True)
class Rule:
    """``kind``: share (of ``fact`` in ``total``), rate (of ``fact`` a second) or gauge (the most of ``fact``, which alerts when it isn't over the threshold)."""

    name: str
    kind: str
    fact: str
    threshold: float
    minutes: int
    hold: int
    total: str = "total"


# The four rules.
RULES = (
    Rule("error_rate", "share", "errors", 0.05, 5, 10),
    Rule("pii_unchecked", "rate", "unchecked", 0.0, 5, 5),
    Rule("reranker_down", "gauge", "available", 0.0, 1, 10),
    Rule("l2_surge", "rate", "l2", 2.0, 10, 15),
)


def ticks(facts: DataFrame, rules: tuple[Rule, ...] = RULES, time: str = "timestamp") -> DataFrame:
    """(rule, at, value, active): each rule at each minute from the first fact to the last.

    facts: a time and a number column for each fact that the rules name.  Facts are summed up by minute before any is sent; a minute's sums
    go to all minutes whose values they are part of.  A share without a total, and a gauge without a fact, is null and not active.
    """
    names = sorted({r.fact for r in rules} | {r.total for r in rules if r.kind == "share"})
    minute = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / MINUTE_US).alias("minute")
    most = {r.fact for r in rules if r.kind == "gauge"}
    per = facts.where(F.col(time).isNotNull()).groupBy(minute).agg(*[(F.max(n) if n in most else F.sum(n)).cast("double").alias(n) for n in names])
    values = [F.struct(F.lit(r.name).alias("rule"), F.col(r.fact).alias("fact"), (F.col(r.total) if r.kind == "share" else F.lit(None).cast("double")).alias("total"), F.lit(r.minutes).alias("minutes")) for r in rules]
    each = per.select("minute", F.inline(F.array(*values))).select("rule", "fact", "total", F.explode(F.sequence(F.col("minute"), F.col("minute") + F.col("minutes") - 1)).alias("minute"))
    sums = each.groupBy("rule", "minute").agg(F.sum("fact").alias("sum"), F.max("fact").alias("most"), F.sum("total").alias("total"))
    span = per.agg(F.min("minute").alias("a"), F.max("minute").alias("b")).where("a is not null")
    grid = span.select(F.explode(F.sequence("a", "b")).alias("minute")).select("minute", F.explode(F.array(*[F.lit(r.name) for r in rules])).alias("rule"))
    rows = grid.join(sums, ["rule", "minute"], "left")
    value, active = F.lit(None).cast("double"), F.lit(False)
    for r in rules:
        own = F.col("rule") == r.name
        zero = F.coalesce("sum", F.lit(0.0))
        v = F.when(F.col("total") > 0, zero / F.col("total")) if r.kind == "share" else F.col("most") if r.kind == "gauge" else zero / (60 * r.minutes)
        value = F.when(own, v).otherwise(value)
        active = F.when(own, v <= r.threshold if r.kind == "gauge" else v > r.threshold).otherwise(active)
    return rows.select("rule", F.timestamp_micros(F.col("minute") * MINUTE_US).alias("at"), value.alias("value"), F.coalesce(active, F.lit(False)).alias("active"))


def _held(rules: tuple[Rule, ...]) -> Column:
    out = F.lit(0)
    for r in rules:
        out = F.when(F.col("rule") == r.name, r.hold).otherwise(out)
    return out


def transitions(ticks: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(rule, state, at) of a rule's ticks (rule, at, active), one a minute; windows go over a rule's minutes, not over facts."""
    order = Window.partitionBy("rule").orderBy("minute")
    rows = ticks.select("rule", F.floor(F.unix_micros("at") / MINUTE_US).alias("minute"), "active")
    rows = rows.withColumn("run", F.sum((~F.col("active")).cast("int")).over(order)).withColumn("end", F.max("minute").over(Window.partitionBy("rule")))
    runs = rows.where("active").groupBy("rule", "run").agg(F.min("minute").alias("since"), F.max("minute").alias("last"), F.max("end").alias("end")).withColumn("hold", _held(rules))
    fired, over = F.col("last") - F.col("since") >= F.col("hold"), F.col("last") < F.col("end")
    step = lambda state, at: F.struct(state.alias("state"), at.alias("minute"))
    steps = F.array(
        step(F.lit("pending"), F.col("since")), F.when(fired, step(F.lit("firing"), F.col("since") + F.col("hold"))), F.when(over, step(F.when(fired, "resolved").otherwise("inactive"), F.col("last") + 1))
    )
    return runs.select("rule", F.inline(F.array_compact(steps))).select("rule", "state", F.timestamp_micros(F.col("minute") * MINUTE_US).alias("at"))


class Alert(StatefulProcessor):
    """A rule's state: since when it holds, and whether it fires.  A timer fires it where no tick comes in time."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.hold = {r.name: r.hold * 60_000 for r in rules}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("alert", "since long, firing boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        hold = self.hold.get(key[0], 0)
        since, firing = self.state.get() if self.state.exists() else (None, False)
        timed, out = since, []
        frame = pd.concat(list(rows)).sort_values("at", kind="stable")
        for at, active in zip(frame["at"].astype("datetime64[ms]").astype("int64"), frame["active"], strict=True):
            at = int(at)
            if since is not None and not firing and (at > since + hold or (active and at == since + hold)):
                firing = True
                out.append(("firing", since + hold))
            if active and since is None:
                since, firing = at, False
                out.append(("pending", at))
                if not hold:
                    firing = True
                    out.append(("firing", at))
            elif not active and since is not None:
                out.append(("resolved" if firing else "inactive", at))
                since, firing = None, False
        if timed is not None and (timed != since or firing):
            self.handle.deleteTimer(timed + hold)
        if since is not None and not firing and timed != since:
            self.handle.registerTimer(since + hold)
        if since is None:
            self.state.clear()
        else:
            self.state.update((since, firing))
        if out:
            yield _states(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.state.exists():
            since, firing = self.state.get()
            if not firing and expiredTimerInfo.getExpiryTimeInMs() == since + self.hold.get(key[0], 0):
                self.state.update((since, True))
                out.append(("firing", since + self.hold.get(key[0], 0)))
        if out:
            yield _states(key[0], out)

    def close(self) -> None:
        pass


def _states(rule: str, steps: list[tuple[str, int]]) -> pd.DataFrame:
    return pd.DataFrame({"rule": [rule] * len(steps), "state": [s for s, _ in steps], "at": pd.to_datetime([t for _, t in steps], unit="ms")})


def alerting(ticks: DataFrame, rules: tuple[Rule, ...] = RULES, lateness: str = "1 minute") -> DataFrame:
    """The transitions of a stream of ticks (rule, at, active), which come in order up to ``lateness``."""
    live = ticks.select("rule", "at", "active").withWatermark("at", lateness)
    return live.groupBy("rule").transformWithStateInPandas(Alert(rules), STATE, "append", "eventtime")

"""Robots rules: texts to a table of rules, and the rule that decides on each path.

Grammar: lines end in CR, LF or both; ``#`` begins a comment; a line is ``key: value``, keys in any case.  Consecutive
``user-agent`` lines and the ``allow``, ``disallow`` and ``crawl-delay`` lines after them make a group; other keys are ignored
wherever they are.  Of all groups, those count that name the longest prefix of the agent's name, else those of ``*``; several groups of a name are
one.  A rule without a value says nothing; one that begins with neither ``/`` nor ``*`` gets a ``/``.  ``*`` stands for any
characters, and ``$`` at the end for the end of the path.

A path is decided by the matching rule with the most bytes; of equal ones, by one that allows; without any it is allowed.

Status: 2xx texts are parsed; 4xx allows everything; 5xx allows everything unchecked, or forbids everything where
``robots_5xx_open`` is off; any other status, a failed fetch (null), and a text with a rule before its first agent are failures: all
is allowed, and unchecked.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..config import Policy
from ..functions.urls import robots_path, url_host

PARSED = "host string, state string, rules array<struct<allow: boolean, path: string, size: int, regex: string>>"
_RULES = pa.list_(pa.struct([("allow", pa.bool_()), ("path", pa.string()), ("size", pa.int32()), ("regex", pa.string())]))
SALTS = 16


def _lines(body: str) -> Iterator[tuple[str, str]]:
    """(key, value) of the lines that the grammar knows."""
    for line in re.split(r"\r\n|\r|\n", body.removeprefix("﻿")):
        key, colon, value = line.partition("#")[0].partition(":")
        key = key.strip().lower()
        if colon and key in ("user-agent", "allow", "disallow", "crawl-delay"):
            yield key, value.strip()


def parse(status: int | None, body: str | None, agent: str, open_5xx: bool = True) -> tuple[str, list[tuple[bool, str]]]:
    """(state, rules as (allow, path)); states: rules, allow_all, disallow_all, error."""
    if status is not None and 400 <= status < 500:
        return "allow_all", []
    if status is not None and 500 <= status < 600 and not open_5xx:
        return "disallow_all", []
    if status is None or not 200 <= status < 300 or body is None:
        return "error", []
    groups: dict[str, list[tuple[bool, str]]] = {}
    named: list[str] = []
    in_agents = False
    for key, value in _lines(body):
        if key == "user-agent":
            named = [*named, value.lower()] if in_agents else [value.lower()]
            groups.setdefault(value.lower(), [])
            in_agents = True
            continue
        if not named:
            return "error", []
        in_agents = False
        if key != "crawl-delay" and value:
            path = value if value[0] in "/*" else "/" + value
            for name in dict.fromkeys(named):
                groups[name].append((key == "allow", path))
    own = max((n for n in groups if n and n != "*" and agent.lower().startswith(n)), key=len, default="*")
    return "rules", groups.get(own, [])


def regex(path: str) -> str | None:
    """A pattern for a rule with wildcards, null for a plain one; what a star has matched is never tried again."""
    anchored = path.endswith("$")
    if not anchored and "*" not in path:
        return None
    first, *rest = [re.escape(x) for x in re.sub(r"\*+", "*", path[:-1] if anchored else path).split("*")]
    if not rest:
        return f"(?s)^{first}(?!.)"
    *middle, last = rest
    ends = f".*{last}(?!.)" if anchored else (f".*?{last}" if last else "")
    return f"(?s)^{first}" + "".join(f"(?>.*?{x})" for x in middle) + ends


def decide(rules: list[tuple[bool, str]], path: str) -> bool:
    """What the rules say of one path, row by row: for states and tests."""
    met = [(len(p.encode()), allow) for allow, p in rules if (re.search(r, path) if (r := regex(p)) else path.startswith(p))]
    return max(met, default=(0, True))[1]


def parsed(bodies: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """(host, state, rules) of fetched texts (host, status, body); of several rows of a host, the largest counts."""
    agent, open_5xx = policy.user_agent, policy.robots_5xx_open
    one = bodies.where("host is not null").groupBy(F.lower("host").alias("host")).agg(F.max(F.struct(F.col("status").cast("int").alias("status"), F.col("body").cast("string").alias("body"))).alias("f"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [parse(s, b, agent, open_5xx) for s, b in zip(batch.column("status").to_pylist(), batch.column("body").to_pylist(), strict=True)]
            rules = [[{"allow": a, "path": p, "size": len(p.encode()), "regex": regex(p)} for a, p in dict.fromkeys(r)] for _, r in read]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([s for s, _ in read], pa.string()), pa.array(rules, _RULES)], names=["host", "state", "rules"])

    return one.select("host", "f.status", "f.body").mapInArrow(run, PARSED)


def judged(asked: DataFrame, rules: DataFrame, salts: int = SALTS) -> DataFrame:
    """(host, path, state, allowed) of distinct (host, path): plain rules by an equi-join, those with wildcards apart.

    A path is cut to the sizes that its host's plain rules have, and each such prefix is looked up.  A host with many paths
    is dealt by ``salts`` on both sides.
    """
    rules = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).repartition("host", "salt")  # read once, used twice
    plain = F.filter("rules", lambda r: r["regex"].isNull())
    hosts = rules.select("host", "salt", "state", F.array_distinct(F.transform(plain, lambda r: r["size"])).alias("sizes"), F.filter("rules", lambda r: r["regex"].isNotNull()).alias("wild"))
    known = asked.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(salts)).cast("int")).join(hosts, ["host", "salt"])
    data = F.encode("path", "UTF-8")
    fits = F.filter("wild", lambda r: F.rlike(F.col("path"), r["regex"]))
    apart = F.array_max(F.transform(fits, lambda r: F.struct(r["size"].alias("size"), r["allow"].alias("allow"))))
    base = known.select("host", "path", "state", apart.alias("rule"))
    cut = known.select("host", "salt", "path", "state", F.explode(F.filter("sizes", lambda n: n <= F.octet_length("path"))).alias("size"))
    cut = cut.withColumn("prefix", F.substring(F.encode("path", "UTF-8"), F.lit(1), F.col("size")))
    each = rules.select("host", "salt", F.explode(plain).alias("r")).select("host", "salt", F.encode("r.path", "UTF-8").alias("prefix"), "r.size", "r.allow")
    looked_up = cut.join(each, ["host", "salt", "prefix", "size"]).select("host", "path", "state", F.struct("size", "allow").alias("rule"))
    best = base.unionByName(looked_up).groupBy("host", "path", "state").agg(F.max("rule").alias("rule"))
    allowed = F.when(F.col("state") == "rules", F.coalesce("rule.allow", F.lit(True))).otherwise(F.col("state") != "disallow_all")
    return best.select("host", "path", "state", allowed.alias("allowed"))


def with_robots(results: DataFrame, bodies: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Adds robots_checked and robots_allowed from fetched texts (host, status, body); each path of a host is judged once.

    A failure allows and counts as not checked; hosts without a row, and URLs without a host, likewise.
    """
    keyed = results.withColumn("_h", url_host(F.col("url"))).withColumn("_path", robots_path(F.col("url")))
    asked = keyed.where("_h <> ''").select(F.col("_h").alias("host"), F.col("_path").alias("path")).distinct()
    said = judged(asked, parsed(bodies, policy)).select(F.col("host").alias("_rh"), F.col("path").alias("_rp"), F.col("state").alias("_state"), F.col("allowed").alias("_allowed"))
    joined = keyed.join(said, (F.col("_h") == F.col("_rh")) & (F.col("_path") == F.col("_rp")), "left")
    checked = F.coalesce(F.col("_state") != "error", F.lit(False))
    return joined.withColumn("robots_checked", checked).withColumn("robots_allowed", F.coalesce("_allowed", F.lit(True))).drop("_h", "_path", "_rh", "_rp", "_state", "_allowed")

"""Personal data: recognisers, detectors, redaction, density blocking, audits.

Recognisers are patterns with a fixed confidence and, some of them, a check digit; detectors are functions plugged in, for what needs a
model (persons, places).  All look at the whole text, so their spans may overlap.  A sweep keeps, of spans whose type is
asked for and whose score reaches the threshold, the highest score first, then the longest, then the earliest, then the first
recogniser, each one unless it overlaps one that is kept.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from ..config import PII
from ..functions.arrow import slices
from ..functions.models import halved
from ..functions.once import evaluated

#: Makes a detector: (texts, language) -> for each text a list of (entity, start, end, score), by characters.
Detector = Callable[[], Callable[[list[str], str], list]]


@dataclass(frozen=True)
class Recogniser:
    entity: str
    pattern: str
    score: float
    check: str = ""


# Patterns in the subset that Java, Python and RE2 share, in order of priority.
RECOGNISERS = (
    Recogniser("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", 1.0),
    Recogniser("CREDIT_CARD", r"\b[0-9](?:[ -]?[0-9]){12,18}\b", 1.0, "luhn"),
    Recogniser("IBAN_CODE", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b", 1.0),
    Recogniser("IP_ADDRESS", r"\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\b", 0.6),
    Recogniser("US_SSN", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", 0.85),
    Recogniser("PHONE_NUMBER", r"\+?\b[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}(?:[ .-]?[0-9]{2,4})?\b", 0.5),
    Recogniser("MEDICAL_LICENSE", r"\b[ABCDEFGHJKLMPRSTUX][A-Z9][0-9]{7}\b", 1.0, "licence"),
)
UNSUPPORTED = ("PERSON", "LOCATION")  # without a detector
# Replacements; an e-mail address is masked with up to 100 stars from its start.
REPLACEMENTS = {"DEFAULT": "<REDACTED>", "PERSON": "<PERSON>", "PHONE_NUMBER": "<PHONE>"}
MASKED = {"EMAIL_ADDRESS": ("*", 100)}

ENTITIES = "array<struct<entity_type: string, start: int, end: int, score: double>>"
_SPANS = pa.list_(pa.struct([("entity_type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
BATCH = 64
RUN = 1 << 20  # bytes of text that are Python's strings at once, or a single text

Span = tuple[str, int, int, float]


def chosen(config: PII) -> list[Recogniser]:
    return [r for r in RECOGNISERS if r.entity in config.entities and r.score >= config.score_threshold]


def luhn(number: str) -> bool:
    digits = [int(c) for c in reversed(number) if c.isdigit()]
    return sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(digits)) % 10 == 0


def licence(number: str) -> bool:
    """The last of seven digits is that of the sum of the odd ones and twice the even ones."""
    d = [int(c) for c in number[2:]]
    return (d[0] + d[2] + d[4] + 2 * (d[1] + d[3] + d[5])) % 10 == d[6]


CHECKS = {"": lambda match: True, "luhn": luhn, "licence": licence}


def _mail_places(text: str, domain: re.Pattern) -> Iterator[tuple[int, int]]:
    """The same matches as the whole pattern's, from each at sign outwards: a long run without one costs nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := domain.match(text, at)):
            yield begin, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _finder(r: Recogniser) -> Callable[[str], Iterator[tuple[int, int]]]:
    if r.entity == "EMAIL_ADDRESS":
        domain = re.compile(r.pattern[r.pattern.index("@") :], re.ASCII)
        return lambda text: _mail_places(text, domain)
    pattern, check = re.compile(r.pattern, re.ASCII), CHECKS[r.check]
    return lambda text: (m.span() for m in pattern.finditer(text) if check(m[0]))


def swept(spans: list[Span]) -> list[Span]:
    """Spans without overlaps, sorted by start: the best first; spans come in order of priority."""
    begins: list[int] = []
    kept: list[Span] = []
    for span in sorted(spans, key=lambda s: (-s[3], s[1] - s[2], s[1])):
        k = bisect.bisect_right(begins, span[1])
        if (k == 0 or kept[k - 1][2] <= span[1]) and (k == len(kept) or span[2] <= kept[k][1]):
            begins.insert(k, span[1])
            kept.insert(k, span)
    return kept


def _looking(config: PII, detectors: Sequence[Detector]) -> Callable[[list[str | None]], list[list[Span] | None]]:
    """Texts to spans; null for a null text, and for one for which a detector fails."""
    finders = [(r, _finder(r)) for r in chosen(config)]
    plugged = [make() for make in detectors]
    digit = re.compile("[0-9]")

    def own(text: str) -> list[Span]:
        some = finders if digit.search(text) else finders[:1] if finders and finders[0][0].entity == "EMAIL_ADDRESS" and "@" in text else []
        return [(r.entity, a, b, r.score) for r, find in some for a, b in find(text)]

    def valid(text: str, spans: list) -> list[Span]:
        said = [(str(e), int(a), int(b), float(s)) for e, a, b, s in spans]
        return [x for x in said if x[0] in config.entities and x[3] >= config.score_threshold and 0 <= x[1] < x[2] <= len(text)]

    def look(texts: list[str | None]) -> list[list[Span] | None]:
        full = [t for t in texts if t is not None]
        more: list[list[Span] | None] = [[] for _ in full]
        for detect_ in plugged:
            said: list = []
            for at in range(0, len(full), BATCH):
                part = full[at : at + BATCH]
                said += halved(lambda some: [valid(t, x) for t, x in zip(some, detect_(some, config.language), strict=True)], part)
            more = [None if a is None or b is None else a + b for a, b in zip(more, said, strict=True)]
        found = iter([None if m is None else swept(own(t) + m) for t, m in zip(full, more, strict=True)])
        return [None if t is None else next(found) for t in texts]

    return look


def detect(docs: DataFrame, text: str = "content", config: PII = PII(), detectors: Sequence[Detector] = ()) -> DataFrame:
    """Adds entities: spans in characters, sorted by start; null for a null text, and for one for which a detector fails.

    ``detectors`` are made once a worker and asked for ``BATCH`` texts at a time.
    """

    @F.arrow_udf(ENTITIES)
    def entities(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        look = _looking(config, detectors)
        for texts in batches:
            done = [pa.array([], _SPANS)]
            for some in slices(texts, RUN):
                done.append(pa.array([None if f is None else [{"entity_type": e, "start": a, "end": b, "score": s} for e, a, b, s in f] for f in look(some.to_pylist())], _SPANS))
            yield pa.concat_arrays(done)

    return docs.withColumn("entities", entities(F.col(text)))


def replaced(entity: str, match: str) -> str:
    if entity in MASKED:
        char, limit = MASKED[entity]
        return char * min(limit, len(match)) + match[limit:]
    return REPLACEMENTS.get(entity, REPLACEMENTS["DEFAULT"])


@F.arrow_udf(StringType())
def _redacted(texts: pa.Array, entities: pa.Array) -> pa.Array:
    done, first = [pa.array([], pa.string())], 0
    for some in slices(texts, RUN):
        out = []
        for text, spans in zip(some.to_pylist(), entities.slice(first, len(some)).to_pylist(), strict=True):
            if text is None or spans is None:
                out.append(text)
                continue
            pieces, at = [], 0
            for s in spans:
                pieces += [text[at : s["start"]], replaced(s["entity_type"], text[s["start"] : s["end"]])]
                at = s["end"]
            out.append("".join([*pieces, text[at:]]))
        done.append(pa.array(out, pa.string()))
        first += len(some)
    return pa.concat_arrays(done)


def redact(text: Column, entities: Column) -> Column:
    """The text with all spans replaced; only texts with spans are sent."""
    some = F.coalesce(F.size(entities) > 0, F.lit(False))
    return F.when(some, _redacted(F.when(some, text), F.when(some, entities))).otherwise(text)


def density(entities: Column, text: Column) -> Column:
    """Entities for 1,000 bytes; 0 for an empty text."""
    return F.when(F.octet_length(text) > 0, F.size(entities) / F.octet_length(text) * 1000).otherwise(F.lit(0.0))


def audit_entities(entities: Column) -> Column:
    """Type, mean score and count, sorted by type; never the matched text."""
    types = F.array_sort(F.array_distinct(F.transform(entities, lambda e: e["entity_type"])))

    def row(t: Column) -> Column:
        own = F.filter(entities, lambda e: e["entity_type"] == t)
        total = F.aggregate(own, F.lit(0.0), lambda a, e: a + e["score"])
        return F.struct(t.alias("type"), (total / F.size(own)).alias("score"), F.size(own).alias("count"))

    return F.transform(types, row)


def process(docs: DataFrame, config: PII = PII(), text: str = "content", detectors: Sequence[Detector] = ()) -> DataFrame:
    """Adds pii_checked, pii_action, pii_blocked, pii_mode, pii_density, pii_audit, entity_count and the text's bytes before; the text is redacted by mode.

    A null entities column, where the input brings one, is a failed detector: skipped and unchecked.  Blocked rows keep
    their place and lose their text.
    """
    if not config.enabled:
        none = F.lit(None)
        return docs.withColumns({"pii_content_length": F.octet_length(text), "pii_checked": F.lit(False), "pii_action": F.lit("skipped"), "pii_blocked": F.lit(False), "pii_mode": F.lit(config.mode), "pii_density": F.lit(0.0), "entity_count": F.lit(0), "pii_audit": none.cast("array<struct<type: string, score: double, count: int>>")})
    found = docs if "entities" in docs.columns else detect(docs, text, config, detectors)
    spans, content = F.col("entities"), F.col(text)
    mode = config.mode if config.mode in ("audit", "redact", "block") else "audit"
    checked = spans.isNotNull()
    full = F.coalesce(F.size(spans) > 0, F.lit(False))
    found = found.withColumn("pii_density", F.coalesce(F.when(checked, density(spans, content)), F.lit(0.0)))
    blocked = checked & (F.col("pii_density") > config.max_density) if mode == "block" else F.lit(False)
    action = F.when(~checked, "skipped").when(blocked, "blocked").when(full & F.lit(mode != "audit"), "redacted").otherwise("pass")
    label = F.when(blocked, "block").otherwise("redact" if mode == "block" else mode)
    out = found.withColumns({"pii_content_length": F.octet_length(content), "pii_checked": checked, "pii_blocked": blocked, "pii_action": action, "pii_mode": label, "entity_count": F.coalesce(F.when(checked, F.size(spans)), F.lit(0)), "pii_audit": audit_entities(spans)})
    changed = F.when(F.col("pii_blocked"), F.lit("")).when(F.col("pii_action") == "redacted", redact(content, spans)).otherwise(content)
    return evaluated(out.withColumn(text, changed), text, "pii_action", "pii_blocked", "pii_checked")


def audit_records(processed: DataFrame, time: Column, language: str = PII.language) -> DataFrame:
    """The audit of ``process``'s documents (request_id, url, ...), one record for each that was checked: never a matched text."""
    return processed.where("pii_checked").select(
        time.cast("timestamp").alias("timestamp"), "request_id", "url", F.col("pii_mode").alias("mode"), F.lit(language).alias("language"), F.col("pii_audit").alias("entities"), F.transform("pii_audit", lambda e: e["type"]).alias("entity_types"),
        "entity_count", "pii_density", F.col("pii_action").alias("action"), F.col("pii_content_length").alias("content_length"),
    )

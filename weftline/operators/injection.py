"""Prompt injection: chunks of documents, scores, and what follows from them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, StringType, StructField, StructType

from ..config import Injection
from ..functions.arrow import sliced, slices, utf8
from ..functions.models import halved
from ..functions.once import evaluated, let

CHUNK = "array<struct<index: int, text: string, byte_offset: int, length: int>>"
_CHUNK_TYPE = pa.list_(pa.struct([("index", pa.int32()), ("text", pa.string()), ("byte_offset", pa.int32()), ("length", pa.int32())]))
TOLD = StructType([StructField("labels", ArrayType(StringType())), StructField("scores", ArrayType(DoubleType())), StructField("ok", IntegerType())])
LABELS = "array<struct<label: string, score: double>>"

# The built-in scorer's phrases; a stand-in for a model, not its equal.
STRONG = ("ignore previous", "ignore all previous", "disregard previous", "disregard the above")
WEAK = ("system prompt", "you are now", "reveal your", "developer mode", "jailbreak")
STRONG_SCORE, WEAK_SCORE, BENIGN_SCORE = 0.97, 0.6, 0.02


# White space by Unicode's property.
_SOLID = re.compile("[^\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_ASCII_SOLID = np.zeros(256, bool)
_ASCII_SOLID[:128] = True
_ASCII_SOLID[[*range(9, 14), 32]] = False


def _paragraphs(raw: np.ndarray, off: np.ndarray, feeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of what lies between empty lines; of a run of line feeds each whole pair, from the left, is a border."""
    owner = np.searchsorted(off, feeds, side="right") - 1
    first = np.flatnonzero(np.concatenate([[True], (np.diff(feeds) > 1) | (np.diff(owner) > 0)])) if len(feeds) else np.zeros(0, np.int64)
    pairs = np.diff(np.append(first, len(feeds))) // 2
    ends = np.cumsum(pairs)
    within = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - pairs, pairs)
    border = np.repeat(feeds[first], pairs) + 2 * within
    of = np.concatenate([np.arange(len(off) - 1), np.repeat(owner[first], pairs)])
    starts, stops = np.concatenate([off[:-1], border + 2]), np.concatenate([off[1:], border])
    order = np.lexsort((starts, of))
    return of[order], starts[order], stops[np.lexsort((stops, of))]


def _packed_lines(begin: np.ndarray, end: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """(start, size) of buffers of lines: as many lines as fit, at least one; only the last buffer is cut hard."""
    out, i, n = [], 0, len(begin)
    while i < n:
        if begin[i] == end[i]:  # an empty line begins no buffer
            i += 1
            continue
        a = int(begin[i])
        j = max(i, int(np.searchsorted(end, a + limit, side="right")) - 1)
        if j >= n - 1:
            out += [(k, min(limit, int(end[-1]) - k)) for k in range(a, int(end[-1]), limit)]
            break
        out.append((a, int(end[j]) - a))
        i = j + 1
    return out


def chunk_places(raw: np.ndarray, off: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, size) of all chunks of a batch of texts, by offsets: paragraphs that fit, else packed lines."""
    feeds = np.flatnonzero(raw == 10)
    of, start, end = _paragraphs(raw, off, feeds)
    size = end - start
    solid = np.append(_ASCII_SOLID[raw], False)  # a byte each: a sum over the bytes would take eight
    full = np.logical_or.reduceat(solid, np.column_stack([start, end]).ravel())[::2] & (size > 0)
    for k in np.flatnonzero(~full & (size > 0)):  # white space, or no ASCII at all
        full[k] = _SOLID.search(raw[start[k] : end[k]].tobytes().decode(errors="replace")) is not None
    short = full & (size <= limit)
    long = np.flatnonzero(full & (size > limit))
    made = [(int(of[k]), a, n) for k in long for a, n in _packed_lines(*_lines(feeds, int(start[k]), int(end[k])), limit)]
    more = np.array(made, np.int64).reshape(-1, 3)
    owner, at, length = (np.concatenate([x, y]) for x, y in zip((of[short], start[short], size[short]), more.T, strict=True))
    order = np.lexsort((at, owner))
    return owner[order], at[order], length[order]


def _lines(feeds: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    inside = feeds[np.searchsorted(feeds, start) : np.searchsorted(feeds, end)]
    return np.concatenate([[start], inside + 1]), np.concatenate([inside, [end]])


def chunk_bytes(content: str | None, limit: int) -> list[tuple[str, int, int]]:
    """(text, byte offset, byte length) of the chunks of one text."""
    return [(c["text"], c["byte_offset"], c["length"]) for c in _chunked(pa.array([content], pa.string()), limit if limit > 0 else 1200)[0].as_py()]


def _chunked(texts: pa.Array, limit: int) -> pa.Array:
    """Chunks of each text, as lists."""
    done = []
    for some in slices(texts):
        raw, off = utf8(some)
        owner, at, size = chunk_places(raw, off, limit)
        data = memoryview(raw)
        count = np.bincount(owner, minlength=len(some)) if len(owner) else np.zeros(len(some), np.int64)
        ends = np.cumsum(count)
        index = np.arange(len(owner)) - np.repeat(ends - count, count)
        text = pa.array([str(data[a : a + n], "utf-8", "replace") for a, n in zip(at.tolist(), size.tolist(), strict=True)], pa.string())
        fields = [pa.array(index.astype(np.int32)), text, pa.array((at - off[:-1][owner]).astype(np.int32)), pa.array(size.astype(np.int32))]
        items = pa.StructArray.from_arrays(fields, names=["index", "text", "byte_offset", "length"])
        done.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), items))
    return pa.concat_arrays(done) if done else pa.array([], _CHUNK_TYPE)


def with_chunks(docs: DataFrame, limit: int = Injection.max_chunk_bytes, text: str = "content") -> DataFrame:
    """Adds chunks, by one Arrow pass over offsets that is linear in the bytes; a null text has none.

    Rows go by in runs of about a MiB of text, so a worker holds the chunks of one run, whatever the batch; nor can the optimizer run the
    pass twice, as it does with a column that a generator or a filter uses.
    """
    limit = limit if limit > 0 else 1200
    rest = docs.drop("chunks")
    schema = StructType([*rest.schema.fields, StructField("chunks", DataType.fromDDL(CHUNK))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return chunk_batches(batches, limit, text)

    return rest.mapInArrow(run, schema)


def chunk_batches(batches: Iterator[pa.RecordBatch], limit: int, text: str) -> Iterator[pa.RecordBatch]:
    """The rows with their chunks, in smaller batches."""
    for batch in batches:
        for part in sliced(batch, text):
            yield pa.RecordBatch.from_arrays([*part.columns, _chunked(part.column(text), limit)], names=[*part.schema.names, "chunks"])


def keyword_score(text: Column) -> Column:
    """The built-in scorer."""

    def scored(low: Column) -> Column:
        has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
        return F.when(has(STRONG), F.lit(STRONG_SCORE)).when(has(WEAK), F.lit(WEAK_SCORE)).otherwise(F.lit(BENIGN_SCORE))

    return let(F.lower(text), scored)


def pick_scores(labels: Column, label: str = Injection.label) -> Column:
    """STRUCT of the label's score (any case; the last match) and the best of the others."""
    own = F.filter(labels, lambda x: F.lower(x["label"]) == label.lower())
    others = F.transform(F.filter(labels, lambda x: F.lower(x["label"]) != label.lower()), lambda x: x["score"])
    last = F.when(F.size(own) > 0, F.element_at(own, -1)["score"])
    return F.struct(F.coalesce(last, F.lit(0.0)).alias("injection_score"), F.greatest(F.coalesce(F.array_max(others), F.lit(0.0)), F.lit(0.0)).alias("benign_score"))


def score_chunks(docs: DataFrame, config: Injection = Injection(), scorer=keyword_score) -> DataFrame:
    """Adds scores to chunks: an array of (index, length, injection_score, benign_score, over_threshold) by ``scorer`` (text -> score column)."""

    def row(c: Column) -> Column:
        told = lambda s: F.struct(c["index"].alias("index"), c["length"].alias("length"), s.alias("injection_score"), (1.0 - s).alias("benign_score"), (s > config.threshold).alias("over_threshold"))
        return let(scorer(c["text"]), told)

    return docs.withColumn("chunk_scores", F.transform("chunks", row))


def annotate(content: Column, chunks: Column, scores: Column, opening: str, closing: str) -> Column:
    """Marks around chunks over the threshold; bytes outside chunks stay.  The text is cut at marked chunks only, each byte once."""
    both = F.zip_with(chunks, scores, lambda c, s: F.struct(c["byte_offset"].alias("at"), (c["byte_offset"] + c["length"]).alias("end"), s["over_threshold"].alias("over")))
    over = F.filter(both, lambda x: F.coalesce(x["over"], F.lit(False)))
    piece = lambda data, a, b: F.substring(data, a + 1, b - a).cast("string")  # noqa: E731  bytes: a hard cut may lie within a character

    def marked(x: Column) -> Column:
        data, cuts = x["data"], x["cuts"]
        before = lambda i: F.when(i > 0, F.get(cuts, i - 1)["end"]).otherwise(0)
        parts = F.transform(cuts, lambda c, i: F.concat(piece(data, before(i), c["at"]), F.lit(opening), piece(data, c["at"], c["end"]), F.lit(closing)))
        return F.concat(F.array_join(parts, ""), piece(data, before(F.size(cuts)), F.octet_length(data)))

    return F.make_valid_utf8(let(F.struct(F.encode(content, "UTF-8").alias("data"), over.alias("cuts")), marked))


# --- classifiers


def batched(make: Callable[[], Callable[[list[str]], list]], batch: int = 64) -> Callable[[Column], Column]:
    """A column function (text -> STRUCT of labels, scores, ok) of a model.

    ``make`` loads the model once a worker; the model takes a list of texts and gives for each a list of (label, score).  Where it
    raises or gives another number of answers, the batch is halved until the texts that fail are alone; those are not ok.
    """
    from pyspark.ml.functions import predict_batch_udf  # here, for workers that only make chunks: it loads all of pyspark.ml and pandas

    def load() -> Callable[[np.ndarray], list[dict]]:
        model = make()

        def pairs(texts: list[str]) -> list:
            return [[(str(label), float(score)) for label, score in x] for x in model(texts)]

        def predict(texts: np.ndarray) -> list[dict]:
            found = halved(pairs, [str(t) for t in texts])
            return [{"labels": np.array([a for a, _ in x or []], object), "scores": np.array([s for _, s in x or []], float), "ok": int(x is not None)} for x in found]

        return predict

    return predict_batch_udf(load, return_type=TOLD, batch_size=batch)


def classify(docs: DataFrame, make: Callable[[], Callable[[list[str]], list]], config: Injection = Injection(enabled=True), text: str = "content", batch: int = 64) -> DataFrame:
    """Adds chunks and chunk_scores by a model that gives label arrays; each different chunk of all documents is asked once.

    A chunk that fails has null scores, and with it its document is unchecked (``process``).  Documents with equal texts are one
    until the end, and chunks go by their hash, so a frequent text or chunk is a row.
    """
    rows = with_chunks(docs, config.max_chunk_bytes, text).withColumn("_text", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    whole = rows.select("_text", "chunks").dropDuplicates(["_text"]).select("_text", F.inline("chunks"))
    each = whole.select("_text", "index", "length", "text", F.sha2("text", 256).alias("_chunk"))
    told = each.groupBy("_chunk").agg(F.first("text").alias("text")).select("_chunk", batched(make, batch)(F.col("text")).alias("told"))
    labels = F.arrays_zip(F.col("told.labels").alias("label"), F.col("told.scores").alias("score"))
    picked = told.select("_chunk", F.when(F.col("told.ok") == 1, pick_scores(labels, config.label)).alias("p"))
    one = F.struct("index", "length", F.col("p.injection_score").alias("injection_score"), F.col("p.benign_score").alias("benign_score"), (F.col("p.injection_score") > config.threshold).alias("over_threshold"))
    per = each.drop("text").join(picked, "_chunk").groupBy("_text").agg(F.array_sort(F.collect_list(one)).alias("chunk_scores"))
    none = F.array().cast("array<struct<index: int, length: int, injection_score: double, benign_score: double, over_threshold: boolean>>")
    return rows.join(per, "_text", "left").withColumn("chunk_scores", F.coalesce("chunk_scores", none)).drop("_text")


def process(docs: DataFrame, config: Injection = Injection(enabled=True), text: str = "content", scorer=keyword_score, classifier: Callable[[], Callable[[list[str]], list]] | None = None) -> DataFrame:
    """Adds inj_checked, inj_action, inj_blocked, inj_mode and the audit's figures; annotates or empties the text by mode.

    Without chunks a document is checked and passes, without audit figures; any null score makes it unchecked.
    Scores come from ``scorer`` (text -> score column) or, where given, from the model that ``classifier`` loads.
    """
    if not config.enabled:
        return docs.withColumns({"inj_content_length": F.octet_length(text), "inj_checked": F.lit(False), "inj_action": F.lit("skipped"), "inj_blocked": F.lit(False), "inj_mode": F.lit(config.mode), "chunk_count": F.lit(0), "over_count": F.lit(0), "max_score": F.lit(0.0), "mean_score": F.lit(None).cast("double")})
    mode = config.mode if config.mode in ("audit", "annotate", "block") else "audit"
    rows = classify(docs, classifier, config, text) if classifier else score_chunks(with_chunks(docs, config.max_chunk_bytes, text), config, scorer)
    rows = evaluated(rows, "chunk_scores")
    scores = F.transform("chunk_scores", lambda s: s["injection_score"])
    n = F.size("chunk_scores")
    ok = ~F.exists(scores, lambda s: s.isNull())
    over = F.size(F.filter("chunk_scores", lambda s: s["over_threshold"]))
    any_over = ok & (over > 0)
    action = F.when(~ok, "skipped").when(any_over & F.lit(mode == "block"), "blocked").when(any_over & F.lit(mode == "annotate"), "annotated").otherwise("pass")
    total = F.aggregate(scores, F.lit(0.0), lambda a, s: a + s)
    rows = rows.withColumns({"inj_content_length": F.octet_length(text), "inj_checked": ok, "inj_action": action, "inj_blocked": action == "blocked", "inj_mode": F.lit(mode), "chunk_count": n, "over_count": F.when(ok, over).otherwise(0), "max_score": F.when(ok & (n > 0), F.greatest(F.lit(0.0), F.array_max(scores))).otherwise(0.0), "mean_score": F.when(ok & (n > 0), total / n)})
    marked = annotate(F.col(text), F.col("chunks"), F.col("chunk_scores"), config.open_mark, config.close_mark)
    rows = evaluated(rows, "inj_action", "inj_checked", "inj_blocked")
    return rows.withColumn(text, F.when(F.col("inj_action") == "blocked", F.lit("")).when(F.col("inj_action") == "annotated", marked).otherwise(F.col(text))).drop("chunks", "chunk_scores")


def audit_records(processed: DataFrame, time: Column, model: str = "builtin") -> DataFrame:
    """The audit of ``process``'s documents (request_id, url, ...), one record for each that was checked and has chunks: never a chunk's text."""
    return processed.where("inj_checked and chunk_count > 0").select(
        time.cast("timestamp").alias("timestamp"), "request_id", "url", F.col("inj_mode").alias("mode"), F.lit(model).alias("model"), "chunk_count", F.col("over_count").alias("over_threshold"), "max_score", "mean_score",
        F.col("inj_action").alias("action"), F.col("inj_content_length").alias("content_length"),
    )

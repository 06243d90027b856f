"""Fill-in-the-middle: cut points between units, found in run-length encoded character classes.

A text is encoded as its maximal runs of one character class, each with the units that end before it.  The classes are

- ``line``: line feeds and all else.  Every line feed ends a unit; a last run without one is a unit.
- ``word``: white space (U+0020, U+0009 to U+000D) and all else.  A word with the white space before it is a unit; white
  space at the end of a text is one.
- ``character``: the widths of characters in UTF-8.  Every character is a unit.

The place after k units lies in the run whose cumulative counts hold k, which a binary search finds; within the run the
place is a product of the units before it and the unit's width.  Neither lines nor words are ever listed.

``seed:doc_id`` is hashed (SHA-256); its first four 32-bit groups choose both cuts, whether the text is changed at all and
which of the two forms it takes.  The pieces are put together with three sentinels; ``restored`` takes them apart.

Defined cases: null texts count as empty, and empty ones are plain; texts that hold a sentinel are plain; a null id is
hashed as an empty string; repeated rows give a row each, all alike; extra columns are left out of ``fill_in_middle`` and
pass through ``transformed``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ._arrow import slices, texts_of, utf8

UNITS = ("line", "word", "character")
SENTINELS = ("<P>", "<S>", "<M>")
FIELDS = "n long, form string, prefix_chars long, middle_chars long, output string"

_WHITE = np.zeros(256, np.uint8)
_WHITE[[0x20, *range(0x09, 0x0E)]] = 1
_FEED = np.zeros(256, np.uint8)
_FEED[0x0A] = 1
#: Bytes of the character that a byte begins; 0 for a byte within one.
_WIDTH = np.repeat(np.array([1, 0, 2, 3, 4], np.uint8), [0x80, 0x40, 0x20, 0x10, 0x10])


class Runs:
    """Runs of all texts of a slice: where each begins, the units that it holds, and the bytes of such a unit."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, unit: str):
        if unit not in UNITS:
            raise ValueError(f"unit {unit!r} is none of {', '.join(UNITS)}")
        if unit == "character":
            classes = _WIDTH[raw]
            classes = classes[classes > 0]
            bounds = np.concatenate([[0], np.cumsum([np.count_nonzero(_WIDTH[raw[a:b]]) for a, b in zip(off[:-1], off[1:], strict=True)], dtype=np.int64)])
        else:
            classes, bounds = (_FEED if unit == "line" else _WHITE)[raw], off
        full = bounds[:-1][np.diff(bounds) > 0]
        first = np.union1d(np.flatnonzero(classes[1:] != classes[:-1]) + 1, full).astype(np.int64)
        length = np.diff(np.append(first, len(classes)))
        kind = classes[first].astype(np.int64)
        last = np.isin(first + length, bounds)  # runs that end a text
        if unit == "character":
            self.units, self.width = length, kind
            size = length * kind
            self.start = np.cumsum(size) - size
        else:
            whole = np.where(last, 1, 0) if unit == "line" else np.where(kind == 0, 1, last.astype(np.int64))
            self.units = np.where(kind == 1, length, whole) if unit == "line" else whole
            self.width = np.where((kind == 1) & (unit == "line"), 1, length)
            self.start = first
        self.after = np.cumsum(self.units)
        counted = np.concatenate([[0], self.after])
        edge = np.searchsorted(first, bounds)
        self.base, self.counts = counted[edge[:-1]], np.diff(counted[edge])
        self.texts = off

    def place(self, k: np.ndarray) -> np.ndarray:
        """The byte after ``k[i]`` units of text i, within the slice."""
        wanted = self.base + k
        at = np.minimum(np.searchsorted(self.after, wanted), max(0, len(self.after) - 1))
        if not len(self.after):
            return self.texts[:-1].copy()
        before = self.after[at] - self.units[at]
        return np.where(k > 0, self.start[at] + (wanted - before) * self.width[at], self.texts[:-1])


def draws(ids: list, seed: int) -> np.ndarray:
    """Four 32-bit numbers for each id."""
    digests = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(digests, ">u4").reshape(-1, 4).astype(np.int64)


def _cut(batch: pa.RecordBatch, unit: str, seed: int, percent: int, spm: int, sentinels: tuple[str, str, str]) -> list[pa.Array]:
    """The columns of ``FIELDS`` for a slice."""
    texts = texts_of(batch)
    raw, off = utf8(texts)
    runs, h = Runs(raw, off, unit), draws(batch.column("doc_id").to_pylist(), seed)
    plain = (np.diff(off) == 0) | (h[:, 2] % 100 >= percent)
    for mark in sentinels:
        plain |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False).astype(bool)
    k = h[:, :2] % (runs.counts + 1)[:, None]
    begin, end = runs.place(k.min(1)), runs.place(k.max(1))
    data, forms, heads, middles, out = raw.tobytes(), [], [], [], []
    p, s, m = (x.encode() for x in sentinels)
    for i in range(len(texts)):
        a, b = int(off[i]), int(off[i + 1])
        if plain[i]:
            forms.append("plain"), heads.append(None), middles.append(None), out.append(data[a:b])
            continue
        u, v = int(begin[i]), int(end[i])
        heads.append(int(np.count_nonzero(_WIDTH[raw[a:u]]))), middles.append(int(np.count_nonzero(_WIDTH[raw[u:v]])))
        first_suffix = h[i, 3] % 100 < spm
        forms.append("spm" if first_suffix else "psm")
        out.append(b"".join((s, data[v:b], p, data[a:u], m, data[u:v]) if first_suffix else (p, data[a:u], s, data[v:b], m, data[u:v])))
    return [pa.array(runs.counts.astype(np.int64)), pa.array(forms, pa.string()), pa.array(heads, pa.int64()), pa.array(middles, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]


def fill_in_middle(docs: DataFrame, unit: str = "line", seed: int = 7, percent: int = 100, spm: int = 50, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row: units, form, code points of prefix and middle, and the new text.

    ``percent`` of all texts change; ``spm`` percent of them have the suffix first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cut = _cut(batch, unit, seed, percent, spm, sentinels)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cut], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {FIELDS}")


def transformed(docs: DataFrame, unit: str = "line", seed: int = 7, percent: int = 100, spm: int = 50, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """The rows of ``docs`` with their texts in the new form; all other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", _cut(batch, unit, seed, percent, spm, sentinels)[-1])

    return docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")}).mapInArrow(run, ", ".join(f"`{f.name}` {'long' if f.name == 'doc_id' else f.dataType.simpleString()}" for f in docs.schema))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of either form was made from."""
    parts = F.split(output, "|".join(f"\\Q{x}\\E" for x in sentinels), -1)
    piece = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(piece(1), piece(3), piece(2))).when(form == "spm", F.concat(piece(2), piece(3), piece(1))).otherwise(output)


def report(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) for each row."""
    made = fill_in_middle(docs, **settings)
    again = restored(F.col("output"), F.col("form"), settings.get("sentinels", SENTINELS))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))

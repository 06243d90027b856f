"""Token counts of whole texts by overlap resynchronisation.

A text is encoded in chunks of ``chunk`` bytes that overlap by ``overlap``, with offsets.  Two neighbouring
chunks are spliced at a proven stable boundary: a space between a non-space and an ASCII letter, from which on both
have a run of ``AGREE`` tokens that agree in id and in place.  The
byte-level pre-tokeniser looks one character ahead and never across such a start, so tokens
right of it do not depend on what is left of it: the left chunk counts before the boundary, the
right one from it on.  If no boundary is found, the right chunk is encoded again with twice the
overlap, back to the last splice; then one chunk from there of twice the length takes the left one's place, so the result is
the whole text's in every case, and a text without any boundary costs a few times its length.  A special token's string is matched before anything else and is
never cut, because it holds no white space.  Within chunks, each distinct piece between stable boundaries is encoded once a batch.

Defined cases: a null or empty text has 0 tokens and 0 bytes; repeated rows count each; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ._arrow import ragged, slices, texts_of, tokenizer_path, utf8

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
CHUNK = 4096
OVERLAP = 128
AGREE = 3
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=4)
def load(name: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(name if "/" in name else tokenizer_path(name))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class PieceCache:
    """Ids of pieces that a worker has seen twice or more in a batch; of bounded size, emptied when full."""

    LIMIT = 400_000

    def __init__(self, name: str):
        self.tokenizer = load(name)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.sizes = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def encode(self, distinct: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A row of ids, and where in it those of each distinct piece begin and how many they are."""
        get = self.index.get
        known = np.array([get(x, -1) for x in distinct], np.int64)
        new = np.flatnonzero(known < 0)
        order = new[np.argsort(counts[new] < 2, kind="stable")]  # those worth keeping come first
        words = [distinct[i] for i in order.tolist()]
        got, size = self.fresh(words)
        flat = np.concatenate([self.flat, got])
        sizes = np.concatenate([self.sizes, size])
        base = len(self.sizes)
        known[order] = base + np.arange(len(order))
        first = (np.cumsum(sizes) - sizes)[known]
        kept = int((counts[order] >= 2).sum())
        if base + kept > self.LIMIT:
            self.clear()
        else:
            self.index.update(zip(words[:kept], range(base, base + kept), strict=True))
            self.sizes = sizes[: base + kept].copy()
            self.flat = flat[: int(self.sizes.sum())].copy()
        return flat, first, sizes[known]

    def fresh(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has."""
        ids: list[int] = []
        size = []
        for at in range(0, len(words), 20_000):
            for got in self.tokenizer.encode_batch(words[at : at + 20_000], add_special_tokens=False):
                own = got.ids
                size.append(len(own))
                ids += own
        return np.array(ids, np.uint32), np.array(size, np.int64)


class WordCache(PieceCache):
    """For a vocabulary that drops white space and marks the ends of its pre-tokens: plain words, of Latin letters and at
    most one mark after them, are encoded many at once, as one text, and told apart by the number of ends."""

    PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]?)")

    def __init__(self, name: str):
        super().__init__(name)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True

    def fresh(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        match = self.PLAIN.fullmatch
        found = [match(w) for w in words]
        plain = np.array([m is not None for m in found], bool)
        together = [w for w, m in zip(words, found, strict=True) if m]
        marks = np.array([2 if m[2] else 1 for m in found if m], np.int64)
        flats, sizes = [], []
        for at in range(0, len(together), 2_000):
            flat = np.array(self.tokenizer.encode(" ".join(together[at : at + 2_000]), add_special_tokens=False).ids, np.uint32)
            stops = np.flatnonzero(self.ends[flat]) + 1
            own = np.cumsum(marks[at : at + 2_000])
            if len(stops) != own[-1]:
                return super().fresh(words)
            flats.append(flat)
            sizes.append(np.diff(stops[own - 1], prepend=0))
        other, other_size = super().fresh([w for w, m in zip(words, found, strict=True) if not m])
        flat = np.concatenate([*flats, other])
        size = np.concatenate([*sizes, other_size]).astype(np.int64)
        at = np.empty(len(words), np.int64)
        at[np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])] = np.arange(len(words))
        first = np.cumsum(size) - size
        return flat[ragged(first[at], size[at])], size[at]


@lru_cache(maxsize=4)
def cached_words(name: str) -> WordCache:
    return WordCache(name)


@lru_cache(maxsize=4)
def cached(name: str) -> PieceCache:
    return PieceCache(name)


def _boundary(text: str, at: int) -> bool:
    """A space before which a non-space and after which an ASCII letter stands: a pre-token begins at it, whatever stands before."""
    return 0 < at < len(text) - 1 and text[at] == " " and not text[at - 1].isspace() and text[at + 1].isascii() and text[at + 1].isalpha()


class Spliced:
    """Counts tokens of texts by splicing overlapping chunks; tells how many chunks it encoded and spliced."""

    def __init__(self, tokenizer, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.tokenizer, self.chunk, self.overlap, self.chunks, self.splices, self.widened = tokenizer, chunk, overlap, 0, 0, 0

    def _encode(self, text: str):
        self.chunks += 1
        return self.tokenizer.encode(text, add_special_tokens=False)

    def count(self, text: str) -> int:
        begin, total, skip = 0, 0, 0  # tokens from ``begin`` on are not yet counted: those of the left chunk without the first ``skip``
        left_from, stop = 0, min(len(text), self.chunk)
        left = self._encode(text[:stop])
        while stop < len(text):
            wide = self.overlap
            while (right_from := stop - wide) > begin:
                right_stop = min(len(text), max(right_from + self.chunk, stop + 1))
                right = self._encode(text[right_from:right_stop])
                if found := _splice(text, begin, left, left_from, right, right_from, stop):
                    at, of_left, of_right = found
                    total += of_left - skip
                    begin, skip, left, left_from, stop = at, of_right, right, right_from, right_stop
                    self.splices += 1
                    break
                wide *= 2
                self.widened += 1
            else:  # nothing agrees back to the last splice: one chunk from there, of twice the length, so its cost stays in proportion
                stop = min(len(text), begin + 2 * (stop - begin))
                left, left_from, skip = self._encode(text[begin:stop]), begin, 0
        return total + len(left) - skip


def count_long(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    return Spliced(tokenizer, chunk, overlap).count(text)


def _splice(text: str, begin: int, left, left_from: int, right, right_from: int, stop: int) -> tuple[int, int, int] | None:
    """A place where both encodings agree on ``AGREE`` tokens, and either's tokens before it; the last is sought first."""
    left_ids, right_ids = left.ids, right.ids
    at = text.rfind(" ", max(begin, right_from) + 1, stop)
    while at >= 0:
        if _boundary(text, at):
            k, j = left.char_to_token(at - left_from), right.char_to_token(at - right_from)
            if k is not None and j is not None and k + AGREE < len(left_ids) and left_ids[k : k + AGREE] == right_ids[j : j + AGREE]:
                places = lambda e, first, of: [e.token_to_chars(first + i)[0] + of for i in range(AGREE)]
                own = places(left, k, left_from)
                if own[0] == at and own == places(right, j, right_from):
                    return at, k, j
        at = text.rfind(" ", max(begin, right_from) + 1, at)
    return None


def _pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts cut at stable boundaries (a space between a non-space and an ASCII letter), the text of each piece and the byte of it at which it begins."""
    raw, off = utf8(texts)
    inner = np.flatnonzero((raw[1:-1] == 32) & ~_SPACE[raw[:-2]] & _LETTER[raw[2:]]) + 1 if len(raw) > 2 else np.zeros(0, np.int64)
    ends = np.sort(np.concatenate([off, inner]), kind="stable")
    ends = ends[np.concatenate([[True], ends[1:] != ends[:-1]])]
    pieces = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(raw))])
    owner = np.searchsorted(off, ends[:-1], side="right") - 1
    return pieces, owner, ends[:-1] - off[owner]


def _chunks(texts: pa.Array, chunk: int, overlap: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Overlapping chunks of all texts, of about so many bytes but of whole characters; the text of each and the byte of it at which it begins."""
    raw, off = utf8(texts)
    size = np.diff(off)
    many = 1 + np.maximum(0, -(-(size - chunk) // (chunk - overlap)))
    text = np.repeat(np.arange(len(size)), many)
    nth = ragged(np.zeros(len(size), np.int64), many)
    starts = off[text] + nth * (chunk - overlap)
    stops = np.minimum(starts + chunk, off[text + 1])
    for ends in (starts, stops):
        for _ in range(3):
            inside = ends < len(raw)
            ends[inside] += (raw[ends[inside]] & 0xC0) == 0x80
    lengths = stops - starts
    data = raw[ragged(starts, lengths)]
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)]), text, starts - off[text]


def token_counts(texts: pa.Array, name: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> dict[str, np.ndarray]:
    """Of each text its tokens, chunks and splices.

    Within a chunk, each distinct piece between stable boundaries is encoded once a batch.  Where neighbours don't agree in their overlap, the text is
    counted by widening overlaps.
    """
    n = len(texts)
    chunks, text, begins = _chunks(texts, chunk, overlap)
    pieces, owner, place = _pieces(chunks)
    coded = pieces.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    _, _, each = cached(name).encode(coded.dictionary.cast(pa.string()).to_pylist(), np.bincount(codes, minlength=len(coded.dictionary)))
    upto = np.concatenate([[0], np.cumsum(each[codes])])  # tokens before each piece
    ends = np.searchsorted(owner, np.arange(len(chunks) + 1))  # pieces of each chunk
    first, last = ends[:-1].copy(), ends[1:].copy()  # pieces that count, of each chunk
    left = np.flatnonzero(text[1:] == text[:-1])
    right = left + 1
    # the last place in the left chunk from which on it has AGREE tokens in pieces that are whole there
    stop = last[left] - 1
    at = np.searchsorted(upto, upto[stop] - AGREE, side="right") - 1
    place = place + begins[owner]  # in the text
    inside = (at >= first[left]) & (at < stop)
    at = np.where(inside, at, 0)
    inside &= place[at] > begins[right]
    wide = int(place.max(initial=0)) + 2
    same = np.searchsorted(owner * wide + place, right * wide + place[at])
    agree = inside & (same < ends[right + 1])
    for k in range(int((stop - at)[agree].max(initial=0))):  # the same pieces at the same places are the same ids at the same places
        more = agree & (at + k < stop)
        a, b = np.where(more, at + k, 0), np.minimum(np.where(more, same + k, 0), len(codes) - 1)
        agree &= ~more | ((codes[a] == codes[b]) & (place[a] == place[b]) & (owner[b] == right))
    last[left[agree]], first[right[agree]] = at[agree], same[agree]
    tokens = np.bincount(text, np.maximum(upto[last] - upto[first], 0), n).astype(np.int64)
    n_chunks, n_splices = np.bincount(text, minlength=n), np.bincount(text[left[agree]], minlength=n)
    for i in np.unique(text[left[~agree]]):
        spliced = Spliced(load(name), chunk, overlap)
        tokens[i] = spliced.count(texts[int(i)].as_py())
        n_chunks[i], n_splices[i] = n_chunks[i] + spliced.chunks, spliced.splices
    return {"n_tokens": tokens, "n_chunks": n_chunks, "n_splices": n_splices}


def count_tokens(docs: DataFrame, name: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, n_chunks, n_splices) of each row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = texts_of(batch)
            got = token_counts(texts, name)
            columns = {"doc_id": batch.column("doc_id"), "n_bytes": pc.cast(pc.binary_length(texts), pa.int64()), "n_tokens": pa.array(got["n_tokens"]), "over_limit": pa.array(got["n_tokens"] > limit)}
            columns |= {k: pa.array(got[k]) for k in ("n_chunks", "n_splices")}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chunks long, n_splices long")

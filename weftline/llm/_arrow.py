"""Helpers shared by the operators that work on Arrow batches.

A word is a run of bytes other than space and U+0009 to U+000D.  All helpers take
whole texts; a null text counts as an empty one.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import re
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 4 << 20

MIX = np.uint64(0x9E3779B97F4A7C15)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that a slice has about ``limit`` bytes of text, or a single row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            pa.default_memory_pool().release_unused()  # executors share little memory with their Python workers
            start = stop


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The text column as a compact array without nulls."""
    got = pc.fill_null(batch.column(column), "")
    return pa.concat_arrays([got]) if got.offset == 0 else pa.array(got, type=got.type).take(pa.array(np.arange(len(got))))


def utf8(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings in a row, and the offsets of each."""
    large = pa.types.is_large_string(strings.type) or pa.types.is_large_binary(strings.type)
    _, offsets, data = strings.buffers()
    if len(strings) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def characters(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all strings in a row, each as the number its one to four bytes make, and the offsets of each string."""
    first = (raw & 0xC0) != 0x80
    at = np.flatnonzero(first)
    out = raw[at].astype(np.uint32)
    more = np.diff(np.append(at, len(raw))) - 1
    for k in range(1, 4):
        some = np.flatnonzero(more >= k)
        out[some] = (out[some] << np.uint32(8)) | raw[at[some] + k]
    return out, np.searchsorted(at, off)


class Words:
    """Words of a slice: distinct ones, a code for each occurrence, and where each text's words begin."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(texts)
        flat = lists.flatten()
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
        before = np.concatenate([[0], np.cumsum(full)])
        ends = np.concatenate([[0], np.cumsum(lengths)])
        self.starts = before[ends].astype(np.int64)
        coded = (flat if full.all() else flat.filter(pa.array(full))).dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.distinct: pa.Array = coded.dictionary

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    @property
    def doc(self) -> np.ndarray:
        """The number of the text of each occurrence."""
        return np.repeat(np.arange(len(self.starts) - 1), self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64 bits for each distinct word."""
        return hash64(self.distinct.to_pylist(), seed)


def hash64(strings: list, seed: int = 0) -> np.ndarray:
    one = xxhash.xxh3_64_intdigest
    return np.fromiter((one(s, seed) for s in strings), np.uint64, len(strings))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def rolled(word_hashes: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """A 64-bit hash for every ``n`` consecutive words; the last n-1 places are left out."""
    count = len(word_hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    factor = mixed(np.array([seed * 2 + 1], np.uint64))[0] | np.uint64(1)
    out = word_hashes[:count].copy()
    for k in range(1, n):
        out *= factor
        out += word_hashes[k : k + count]
    return mixed(out)


def sums(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Sums of values[start:stop]; exact for integers."""
    kind = np.float64 if values.dtype.kind == "f" else np.int64
    total = np.concatenate([np.zeros(1, kind), np.cumsum(values, dtype=kind)])
    return total[np.maximum(stops, starts)] - total[starts]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... for each pair, in a row."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) - np.repeat(ends - lengths - starts, lengths)


def pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences by byte planes, compressed: the high planes are mostly zeros."""
    v = values.astype(np.uint64)
    return planes(np.diff(v, prepend=np.uint64(0)))


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data, np.uint64), dtype=np.uint64)


def planes(values: np.ndarray) -> bytes:
    """Any numbers by byte planes, compressed."""
    width = values.dtype.itemsize
    raw = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unplanes(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def sparse(buckets: np.ndarray, shares: np.ndarray) -> tuple[bytes, bytes]:
    """Features of one example, small enough that a driver holds thousands: shares are kept to three digits."""
    return planes(np.diff(buckets.astype(np.uint32), prepend=np.uint32(0))), planes((shares * 1024).astype(np.float16))


def unsparse(buckets: bytes, shares: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(unplanes(buckets, np.uint32), dtype=np.uint32).astype(np.int64), unplanes(shares, np.float16).astype(np.float64) / 1024


_FOLDERS: list[tuple] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a local master (tests) gets a folder under /tmp; on a cluster that is an error, since executors
    would write to their own disks.  Results are read from the folder later, so it stays until the driver's Python ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not set_dir.isDefined() and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = set_dir.get() if set_dir.isDefined() else "file:///tmp/checkpoints"
    folder = f"{base.rstrip('/')}/weftline-{uuid.uuid4().hex}"
    if not _FOLDERS:
        atexit.register(_discard_all)
    _FOLDERS.append((spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), folder))
    return folder


def _discard_all() -> None:
    """Deletes the folders made here through the file system that Spark uses; one that can't be deleted any more is left."""
    for jvm, configuration, folder in _FOLDERS:
        with contextlib.suppress(Exception):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(configuration).delete(path, True)


def kept(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes a table to a shared folder and reads it again, which cuts the lineage."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, folder: str, name: str) -> None:
    """Deletes a kept table that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Frees shuffle files of stages whose results are written: they go when the driver's JVM has collected their handles."""
    for _ in range(2):  # a second time for what the first has made unreachable
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))

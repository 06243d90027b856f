"""A table of committed files, as a Spark data source: for audits, counters and other records that must be there once or not at all.

Tasks write Parquet files under names of their own; a commit is one small manifest that lists them, and readers read what
manifests list.  So a failed or lost task, a second attempt or a job that ends early leaves nothing that is ever read; its files are
deleted where that is still possible.  A batch has a name, and a manifest's name is its batch's: a batch that comes again
after a failure finds its manifest and changes nothing.

``path`` may be anything that Arrow's file systems open (local and object stores, HDFS with its client library).
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..config import ConfigError

DATA, COMMITS = "data", "commits"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path within it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


class _File(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


def write_file(path: str, batches: Iterator[pa.RecordBatch]) -> Written:
    """A task's rows in a file of its own; none for no rows."""
    system, root = opened(path)
    name, rows, writer = "", 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        if writer is None:
            name = f"{uuid.uuid4().hex}.parquet"
            system.create_dir(f"{root}/{DATA}", recursive=True)
            writer = pq.ParquetWriter(f"{root}/{DATA}/{name}", batch.schema, filesystem=system)
        writer.write_batch(batch)
        rows += batch.num_rows
    if writer is not None:
        writer.close()
    return Written(name, rows)


def discard(path: str, messages: list[Written | None]) -> None:
    system, root = opened(path)
    for m in messages:
        if m is not None and m.name:
            with contextlib.suppress(OSError):
                system.delete_file(f"{root}/{DATA}/{m.name}")


def commit_files(path: str, batch: str, messages: list[Written | None]) -> bool:
    """Makes the files part of the table, at once; False, and no change, where the batch is there already."""
    system, root = opened(path)
    final = f"{root}/{COMMITS}/{batch}.json"
    system.create_dir(f"{root}/{COMMITS}", recursive=True)
    if system.get_file_info(final).type != fs.FileType.NotFound:
        discard(path, messages)
        return False
    held = [m for m in messages if m is not None and m.name]
    temporary = f"{root}/{COMMITS}/.{uuid.uuid4().hex}"
    with system.open_output_stream(temporary) as out:
        out.write(json.dumps({"files": [m.name for m in held], "rows": sum(m.rows for m in held)}).encode())
    system.move(temporary, final)
    return True


def committed_files(path: str) -> list[str]:
    """The files of all commits, by batch."""
    system, root = opened(path)
    found = system.get_file_info(fs.FileSelector(f"{root}/{COMMITS}", allow_not_found=True))
    names: list[str] = []
    for info in sorted(found, key=lambda f: f.base_name):
        if info.base_name.endswith(".json"):
            with system.open_input_stream(info.path) as f:
                names += json.loads(f.read())["files"]
    return names


class CommittedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, batch: str):
        self.path, self.batch = path, batch

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return write_file(self.path, iterator)

    def commit(self, messages: list[Written | None]) -> None:
        commit_files(self.path, self.batch, messages)

    def abort(self, messages: list[Written | None]) -> None:
        discard(self.path, messages)


class CommittedStreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str, writer: str):
        self.path, self.writer = path, writer

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return write_file(self.path, iterator)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        commit_files(self.path, f"{self.writer}-{batchId:012d}", messages)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        discard(self.path, messages)


class CommittedReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.names = path, schema.names

    def partitions(self) -> list[InputPartition]:
        return [_File(name) for name in committed_files(self.path)] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        system, root = opened(self.path)
        with pq.ParquetFile(f"{root}/{DATA}/{partition.name}", filesystem=system) as file:
            yield from file.iter_batches(columns=self.names)


class CommittedSource(DataSource):
    """``df.write.format("committed").mode("append").option("path", p).save()``, with ``batch`` as the commit's name (default: a new one);
    ``writeStream`` alike, with ``writer`` to tell several streams into one table apart; ``spark.read.format("committed").schema(s)``."""

    @classmethod
    def name(cls) -> str:
        return "committed"

    @property
    def path(self) -> str:
        if not self.options.get("path"):
            raise ConfigError("option path is required")
        return self.options["path"].rstrip("/")

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        files = committed_files(self.path)
        if not files:
            raise ConfigError("the table has no rows yet: give a schema")
        system, root = opened(self.path)
        return from_arrow_schema(pq.read_schema(f"{root}/{DATA}/{files[0]}", filesystem=system))

    def reader(self, schema: StructType) -> DataSourceReader:
        return CommittedReader(self.path, schema)

    def writer(self, schema: StructType, overwrite: bool) -> CommittedWriter:
        if overwrite:
            raise ConfigError("committed tables are appended to: use mode append")
        return CommittedWriter(self.path, self.options.get("batch") or uuid.uuid4().hex)

    def streamWriter(self, schema: StructType, overwrite: bool) -> CommittedStreamWriter:
        return CommittedStreamWriter(self.path, self.options.get("writer") or "stream")


def register(spark) -> None:
    """Makes the format known to a session; again does no harm."""
    spark.dataSource.register(CommittedSource)

"""Python data sources: lines of files, and rows as one JSON document.

Both work on any store that Arrow's file systems know and hold neither a file
nor all rows in memory.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return arrow_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (arrow_fs.LocalFileSystem(), path)


def known(path: str) -> bool:
    """Whether Arrow has a file system for the path."""
    try:
        opened(path)
    except (pa.ArrowException, OSError, ImportError):
        return False
    return True


def found_files(path: str) -> list[str]:
    """The files that a path names: itself, those of a folder, or those that a pattern in its last part matches. Hidden ones are left out."""
    store, at = opened(path)
    folder, _, last = at.rpartition("/")
    pattern = last if any(c in last for c in "*?[") else None
    info = store.get_file_info(folder if pattern else at)
    if info.type == arrow_fs.FileType.File:
        return [path]
    if info.type != arrow_fs.FileType.Directory:
        return []
    scheme = path[: len(path) - len(at)] if path.endswith(at) else ""
    inside = store.get_file_info(arrow_fs.FileSelector(folder if pattern else at))
    names = [x.path for x in inside if x.type == arrow_fs.FileType.File and x.base_name[0] not in "._" and (pattern is None or fnmatch(x.base_name, pattern))]
    return [scheme + x for x in sorted(names)]


def numbered_lines(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, str]]:
    """Lines of a binary stream from 1, without their ends (a line feed, a carriage return before it); a chunk at a time."""
    rest, line = b"", 0
    while data := stream.read(chunk):
        *whole, rest = (rest + data).split(b"\n")
        for x in whole:
            line += 1
            yield line, x.removesuffix(b"\r").decode("utf-8", "replace")
    if rest:
        yield line + 1, rest.removesuffix(b"\r").decode("utf-8", "replace")


@dataclass
class OneFile(InputPartition):
    path: str


class LineReader(DataSourceReader):
    """A partition for each file; a batch of lines at a time."""

    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def partitions(self) -> list[InputPartition]:
        return [OneFile(x) for x in found_files(self.path)]

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, OneFile):  # no file, no partition
            return
        store, at = opened(partition.path)
        name = at.rpartition("/")[2]
        label = name.rpartition(".")[0] or name
        batch: list[tuple[int, str]] = []

        def made() -> pa.RecordBatch:
            numbers, texts = zip(*batch, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([label] * len(batch)), pa.array(numbers, pa.int32()), pa.array(texts)], ["label", "line", "text"])

        with store.open_input_stream(at) as stream:
            for x in numbered_lines(stream):
                batch.append(x)
                if len(batch) == self.rows:
                    yield made()
                    batch.clear()
        if batch:
            yield made()


class LineSource(DataSource):
    """``spark.read.format("strandline_lines").load(path)``: label (a file's name without its ending), line, text of every line.

    Options: ``path``, a file, folder or pattern, and ``rows``, the lines in a
    batch. A file of any size is read in bounded memory.
    """

    @classmethod
    def name(cls) -> str:
        return "strandline_lines"

    def schema(self) -> str:
        return "label string, line int, text string"

    def reader(self, schema: StructType) -> LineReader:
        return LineReader(self.options["path"], int(self.options.get("rows", 8192)))


@dataclass
class Part(WriterCommitMessage):
    partition: int
    path: str
    rows: int


#: How rows stand in one file: what opens it, what is between rows, what closes it, and an empty one.
SHAPES = {"array": (b"[\n", b",\n", b"\n]\n", b"[]\n"), "json": (b"", b"\n", b"\n", b""), "text": (b"", b"\n", b"\n", b"")}


class DocumentWriter(DataSourceWriter):
    """Each task writes a part; the commit joins the parts in their order, a chunk at a time, and then moves the document to its place.

    Until then there is nothing at the path, and a task or job that fails
    leaves nothing behind.
    """

    def __init__(self, path: str, shape: str):
        if shape not in SHAPES:
            raise ValueError(f"unknown shape {shape!r}; there are {', '.join(SHAPES)}")
        self.path, self.shape = path.rstrip("/"), shape
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Part:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, at = opened(f"{self.parts}/{context.partitionId():06d}-{context.taskAttemptId()}")
        store.create_dir(at.rpartition("/")[0], recursive=True)
        rows, between = 0, SHAPES[self.shape][1]
        with store.open_output_stream(at) as out:
            for row in iterator:
                text = str(row[0] or "") if self.shape == "text" else json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str)
                out.write((between if rows else b"") + text.encode("utf-8", "replace"))
                rows += 1
        return Part(context.partitionId(), at, rows)

    def commit(self, messages: list[Part | None]) -> None:
        store, at = opened(self.path)
        _, parts = opened(self.parts)
        store.create_dir(parts, recursive=True)
        whole = f"{parts}/whole"
        opening, between, closing, empty = SHAPES[self.shape]
        with store.open_output_stream(whole) as out:
            filled = sorted((x for x in messages if x is not None and x.rows), key=lambda x: x.partition)
            for k, part in enumerate(filled):
                out.write(between if k else opening)
                with store.open_input_stream(part.path) as stream:
                    while data := stream.read(1 << 20):
                        out.write(data)
            out.write(closing if filled else empty)
        if store.get_file_info(at).type == arrow_fs.FileType.File:
            store.delete_file(at)
        store.move(whole, at)
        store.delete_dir(parts)

    def abort(self, messages: list[Part | None]) -> None:
        store, parts = opened(self.parts)
        if store.get_file_info(parts).type == arrow_fs.FileType.Directory:
            store.delete_dir(parts)


class DocumentSink(DataSource):
    """``rows.write.format("strandline_document").mode("append").save(path)``: all rows as one file, a row on each line, in the order of the partitions.

    Option ``shape``: ``array`` (a JSON array), ``json`` (JSON lines) or
    ``text`` (the first column as it is). A file that is already there is
    replaced.
    """

    @classmethod
    def name(cls) -> str:
        return "strandline_document"

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"], self.options.get("shape", "array"))


def register(spark: SparkSession) -> None:
    for source in (LineSource, DocumentSink):
        spark.dataSource.register(source)

"""Corpus files read in byte ranges: one large file is read by many tasks.

A data source for spark.read.format("lexiloom_corpus"). Files are cut into ranges of
split_bytes, wherever that falls. A range owns the documents that begin in it: it moves
to the first beginning at or after its start, and reads its last document to the end,
past its own. So every document is read once, whole, at any split size, and nothing is
shuffled. What a task holds is one document and one block of a file.

Stores: those that pyarrow's file systems know (local, HDFS, S3, GCS) by the path's
scheme; a path without one is local.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from lexiloom.operators.documents import ARTICLE

SCHEMAS = {"documents": "path string, at long, sentences array<string>", "articles": "path string, at long, article string"}
SPLIT_BYTES = 128 << 20
#: Bytes of ranges that one task reads, fewer where that would leave fewer tasks than these.
TASK_BYTES, LEAST_TASKS = 16 << 20, 64
#: Bytes read at a time, and bytes of rows in a batch.
BLOCK, BATCH = 1 << 20, 1 << 22
#: The characters that are stripped from lines.
STRIPPED = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it."""
    return pafs.FileSystem.from_uri(path) if re.match(r"[a-zA-Z][\w+.-]*:", path) else (pafs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int]]:
    """(file, bytes) of a file, of a directory's files, or of those whose name matches a pattern in the last part; hidden and marker files go."""
    store, inner = opened(path)
    folder, _, last = inner.rstrip("/").rpartition("/")
    if re.search(r"[*?\[]", last):
        found = [f for f in store.get_file_info(pafs.FileSelector(folder)) if fnmatchcase(f.base_name, last)]
    else:
        found = [store.get_file_info(inner)]
        if found[0].type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
    folders = [f for f in found if f.type == pafs.FileType.Directory]
    found += [f for d in folders for f in store.get_file_info(pafs.FileSelector(d.path))]
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.base_name[0] not in "._")


def lines_from(file: pa.NativeFile, at: int) -> Iterator[tuple[int, bytes, bool]]:
    """(position, line, whether a line break ends it) from a line's beginning on; a break at the very end begins no line."""
    file.seek(at)
    rest: list[bytes] = []
    while block := file.read(BLOCK):
        *whole, last = block.split(b"\n")
        for part in whole:
            line = b"".join([*rest, part])
            rest = []
            yield at, line, True
            at += len(line) + 1
        if last:
            rest.append(last)
    if rest:
        yield at, b"".join(rest), False


def blank(line: bytes) -> bool:
    return not line.decode("utf-8", "replace").strip(STRIPPED)


def line_before(file: pa.NativeFile, end: int) -> bytes:
    """The line whose break is at end - 1, as far back as it takes to see whether it is blank."""
    parts, at = [], end - 1
    while at > 0:
        size = min(BLOCK >> 4, at)
        file.seek(at - size)
        block = file.read(size)
        cut = block.rfind(b"\n")
        parts.insert(0, block[cut + 1 :])
        if cut >= 0 or re.search(rb"[!-~]", parts[0]):
            break
        at -= size
    return b"".join(parts)


def first_line(file: pa.NativeFile, start: int) -> int | None:
    """Where the first line at or after start begins; None if no line does."""
    if start == 0:
        return 0
    at = start - 1
    file.seek(at)
    while block := file.read(BLOCK):
        cut = block.find(b"\n")
        if cut >= 0:
            return at + cut + 1
        at += len(block)
    return None


def documents_in(file: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, list[str]]]:
    """(position, sentences) of the documents that begin in [start, end): blank lines end them, also with nothing before; lines are stripped. What no blank line ends is no document."""
    at = first_line(file, start)
    if at is None or at >= end:
        return
    own: list[str] | None = [] if at == 0 or blank(line_before(file, at)) else None
    begin = at
    for position, line, broken in lines_from(file, at):
        if own is None:
            if position >= end:
                return
        elif not blank(line):
            own.append(line.decode("utf-8", "replace").strip(STRIPPED))
        if blank(line) and broken:
            if own is not None:
                yield begin, own
            begin, own = position + len(line) + 1, []
            if begin >= end:
                return


def articles_in(file: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, str]]:
    """(position, article) of the articles whose marker's line begins in [start, end), each up to the next marker's line, without line breaks at its end."""
    at, marker = first_line(file, start), ARTICLE.encode()
    if at is None or at >= end:
        return
    own, begin = None, at
    for position, line, _ in lines_from(file, at):
        if line == marker:
            if own is not None:
                yield begin, "\n" + b"\n".join(own).decode("utf-8", "replace").rstrip("\n")
            own, begin = None, position
            if position >= end:
                return
            own = [line]
        elif own is not None:
            own.append(line)
        elif position >= end:
            return
    if own is not None:
        yield begin, "\n" + b"\n".join(own).decode("utf-8", "replace").rstrip("\n")


READERS: dict[str, Callable[[pa.NativeFile, int, int], Iterator[tuple]]] = {"documents": documents_in, "articles": articles_in}


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int


@dataclass
class ByteRanges(InputPartition):
    """What one task reads, range by range: a task of its own would cost more than a small range does."""

    ranges: list[ByteRange]


class CorpusReader(DataSourceReader):
    def __init__(self, path: str, kind: str, split_bytes: int):
        self.path, self.kind, self.split_bytes = path, kind, split_bytes

    def partitions(self) -> list[ByteRanges]:
        found = [ByteRange(f, at, min(at + self.split_bytes, size)) for f, size in listed(self.path) for at in range(0, size, self.split_bytes)]
        most = min(TASK_BYTES, sum(r.end - r.start for r in found) // LEAST_TASKS)
        out: list[ByteRanges] = []
        held = most
        for r in found:
            if held >= most:
                out.append(ByteRanges([]))
                held = 0
            out[-1].ranges.append(r)
            held += r.end - r.start
        return out or [ByteRanges([])]

    def read(self, partition: ByteRanges) -> Iterator[pa.RecordBatch]:
        for own in partition.ranges:
            yield from self._rows(own)

    def _rows(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        last = pa.field("sentences", pa.list_(pa.string())) if self.kind == "documents" else pa.field("article", pa.string())
        schema = pa.schema([pa.field("path", pa.string()), pa.field("at", pa.int64()), last])
        store, _ = opened(self.path)
        places, values, held = [], [], 0

        def batch() -> pa.RecordBatch:
            columns = [pa.array([partition.path] * len(places), pa.string()), pa.array(places, pa.int64()), pa.array(values, schema.field(2).type)]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        with store.open_input_file(partition.path) as file:
            for at, value in READERS[self.kind](file, partition.start, partition.end):
                places.append(at)
                values.append(value)
                held += len(value) if isinstance(value, str) else sum(map(len, value)) + 8 * len(value)
                if held >= BATCH:
                    yield batch()
                    places, values, held = [], [], 0
        if places:
            yield batch()


class CorpusSource(DataSource):
    """Options: path; kind, documents or articles; split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "lexiloom_corpus"

    def _kind(self) -> str:
        kind = self.options.get("kind", "documents")
        if kind not in SCHEMAS:
            raise ValueError(f"unknown kind {kind!r}: {' or '.join(SCHEMAS)}")
        return kind

    def schema(self) -> str:
        return SCHEMAS[self._kind()]

    def reader(self, schema: StructType) -> CorpusReader:
        kind, size = self._kind(), int(self.options.get("split_bytes", SPLIT_BYTES))
        if size < 1:
            raise ValueError("split_bytes must be at least 1")
        return CorpusReader(self.options["path"], kind, size)


def read_corpus(spark: SparkSession, path: str, kind: str = "documents", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, at, sentences) of text files whose blank lines end documents, or (path, at, article) of marked-up ones; at is the byte at which it begins, and orders a file's rows.

    The same rows at any split size. Text that is no UTF-8 has replacement characters.
    """
    spark.dataSource.register(CorpusSource)
    return spark.read.format(CorpusSource.name()).option("kind", kind).option("split_bytes", split_bytes).load(path)

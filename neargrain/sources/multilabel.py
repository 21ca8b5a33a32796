"""The text format of multi-label data as a data source: ``spark.read.format("multilabel")``.

A line is `label, label word:count word:count ...`. Files are read in byte ranges, each by a task, and
written by tasks whose files appear when all of them are complete.

    spark.dataSource.register(MultilabelSource)
    rows = spark.read.format("multilabel").option("columns", "labels").load(folder)
    rows.write.format("multilabel").mode("append").save(folder)
"""

from __future__ import annotations

import io
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of a range, bytes that are read at once, lines of a batch of rows, and bits of a place in a file.
RANGE_BYTES, READ_BYTES, BATCH_LINES, OFFSET_BITS = 64 << 20, 1 << 20, 4096, 43

_LABELS = "doc_id bigint, labels array<int>"
_ALL = f"{_LABELS}, words array<bigint>, counts array<bigint>"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; one without a scheme is local."""
    if "://" in path or path.startswith("file:"):
        scheme, rest = path.split(":", 1)
        if scheme == "file":
            return fs.LocalFileSystem(), "/" + rest.lstrip("/")
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _hidden(path: str) -> bool:
    return posixpath.basename(path)[:1] in "_."


@dataclass
class Range(InputPartition):
    """The lines that start in bytes ``start`` to ``end`` of the file with a number."""

    number: int
    path: str
    start: int
    end: int


def lines_of(files: fs.FileSystem, part: Range) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that start in a range; the last one may end after it."""
    at = part.start
    with io.BufferedReader(files.open_input_file(part.path), READ_BYTES) as file:
        if at:  # a line that starts at the range's first byte follows a line's end
            file.seek(at - 1)
            at += len(file.readline()) - 1
        while at < part.end and (line := file.readline()):
            yield at, line
            at += len(line)


def parsed(line: bytes, words: bool) -> tuple[list[int], list[int], list[int]]:
    """Labels, words and counts of a line; of a word that it has twice the last count stays. Tokens that
    are no whole numbers are left out."""
    *first, last = line.decode("utf-8", "replace").split(",")
    tokens = last.split()
    labels = [int(t) for t in map(str.strip, [*first, *tokens[:1]]) if _whole(t)]
    counts: dict[int, int] = {}
    if words:
        for token in tokens[1:]:
            word, _, count = token.partition(":")
            if _whole(word) and _whole(count):
                counts[int(word)] = int(count)
    return labels, list(counts), list(counts.values())


def _whole(token: str) -> bool:
    digits = token[1:] if token[:1] in ("-", "+") else token
    return digits.isascii() and digits.isdigit()


class MultilabelReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.words = options["path"], options.get("columns", "all") != "labels"
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        files, path = _opened(self.path)
        info = files.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(path))
        own = sorted((i.path, i.size) for i in found if i.type == fs.FileType.File and not _hidden(i.path))
        return [Range(n, p, start, min(start + self.range_bytes, size)) for n, (p, size) in enumerate(own) for start in range(0, size, self.range_bytes)]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file has a byte
            return
        files, _ = _opened(self.path)
        ids, rows = [], []

        def batch() -> pa.RecordBatch:
            lists = [pa.array(x, pa.list_(t)) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64()))]
            columns = [pa.array(ids, pa.int64()), *lists[: 3 if self.words else 1]]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "labels", "words", "counts"][: len(columns)])

        for at, line in lines_of(files, partition):
            if line.strip():
                ids.append((partition.number << OFFSET_BITS) + at)
                rows.append(parsed(line, self.words))
                if len(rows) == BATCH_LINES:
                    yield batch()
                    ids, rows = [], []
        if rows:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    hidden: str
    name: str


class MultilabelWriter(DataSourceArrowWriter):
    """Tasks write hidden files, which the reader doesn't see; they get their names when all are done."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        files, path = _opened(self.path)
        files.create_dir(path, recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{self.job}.txt"
        hidden = f"{path}/_{name}-{task.taskAttemptId()}"
        with files.open_output_stream(hidden) as out:
            for batch in iterator:
                columns = [batch.column(c).to_pylist() for c in ("labels", "words", "counts")]
                for labels, words, counts in zip(*columns):
                    head = ", ".join(map(str, labels or []))
                    out.write(" ".join([head, *(f"{w}:{c}" for w, c in zip(words or [], counts or []))]).encode() + b"\n")
        return Written(hidden, name)

    def commit(self, messages: list[Written | None]) -> None:
        files, path = _opened(self.path)
        old = [i.path for i in files.get_file_info(fs.FileSelector(path)) if i.type == fs.FileType.File and not _hidden(i.path)] if self.overwrite else []
        for m in messages:
            files.move(m.hidden, f"{path}/{m.name}")
        for gone in old:
            files.delete_file(gone)

    def abort(self, messages: list[Written | None]) -> None:
        files, _ = _opened(self.path)
        for m in messages:
            if m is not None and files.get_file_info(m.hidden).type == fs.FileType.File:
                files.delete_file(m.hidden)


class MultilabelSource(DataSource):
    """Options: ``columns`` (all, or labels: then words aren't parsed) and ``rangeBytes``. doc_id is a
    file's number and the line's place in it; it rises with both."""

    @classmethod
    def name(cls) -> str:
        return "multilabel"

    def schema(self) -> str:
        return _LABELS if self.options.get("columns", "all") == "labels" else _ALL

    def reader(self, schema) -> MultilabelReader:
        return MultilabelReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> MultilabelWriter:
        return MultilabelWriter(dict(self.options), overwrite)

"""A streaming source of files that are still being appended to.

Spark's own file source reads a path once.  This one keeps a byte offset for every file:
a micro-batch reads the lines completed since the last one, each exactly once, also over a
restart (offsets are in the query's checkpoint).  A last line without its line end waits
until it is complete.  Ranges are cut into partitions, so a large backlog is read by many
tasks; the driver lists the folder and looks for the last line end of files that grew.

The folder is any URI that ``pyarrow.fs`` opens and all executors see.  A file that became
shorter was replaced; it is left alone until it is longer than what was read of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "growing_lines"
SCHEMA = "session_id string, seq bigint, value string, header string, header_seq bigint"
_PARTITION_BYTES = 64 << 20
_BLOCK = 1 << 16
_BATCH_BYTES = 1 << 20


@dataclass
class Range(InputPartition):
    """Lines that begin in ``first`` <= byte < ``end`` of a file."""

    path: str
    first: int
    end: int

    def __post_init__(self):
        super().__init__(self.path)


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options):
        self.uri = options["path"]
        self.partition_bytes = int(options.get("partitionBytes", _PARTITION_BYTES))
        self.complete: dict[str, tuple[int, int]] = {}  # of each file: size, end of its last line

    def _open(self) -> tuple[fs.FileSystem, str]:
        if "://" in self.uri or self.uri.startswith("file:"):
            return fs.FileSystem.from_uri("file://" + self.uri[5:] if self.uri.startswith("file:/") and not self.uri.startswith("file://") else self.uri)
        return fs.LocalFileSystem(), self.uri

    def _session(self, path: str) -> str:
        scheme = self.uri.split("://")[0] if "://" in self.uri else "file"
        return f"file:{path}" if scheme == "file" else f"{scheme}://{path}"

    # -- driver

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        files, folder = self._open()
        for info in files.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True)):
            hidden = info.base_name.startswith((".", "_"))
            if info.type != fs.FileType.File or hidden:
                continue
            size, end = self.complete.get(info.path, (0, 0))
            if info.size > size:
                self.complete[info.path] = info.size, _last_line_end(files, info.path, end, info.size)
        return {path: end for path, (_, end) in self.complete.items() if end}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, last in end.items():
            for first in range(start.get(path, 0), last, self.partition_bytes):
                out.append(Range(path, first, min(first + self.partition_bytes, last)))
        return out

    # -- tasks

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        files, _ = self._open()
        with files.open_input_file(partition.path) as file:
            header, header_seq = _first_line(file)
            seq, value, held = [], [], 0
            for at, line in _lines(file, partition.first, partition.end):
                seq.append(at)
                value.append(line.decode("utf-8", "replace"))
                held += len(line)
                if held >= _BATCH_BYTES:
                    yield self._batch(partition.path, seq, value, header, header_seq)
                    seq, value, held = [], [], 0
            if seq:
                yield self._batch(partition.path, seq, value, header, header_seq)

    def _batch(self, path: str, seq: list, value: list, header: str, header_seq: int) -> pa.RecordBatch:
        n = len(seq)
        cols = [
            pa.array([self._session(path)] * n, pa.string()), pa.array(seq, pa.int64()), pa.array(value, pa.string()),
            pa.array([header] * n, pa.string()), pa.array([header_seq] * n, pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in SCHEMA.split(", ")])


def _last_line_end(files: fs.FileSystem, path: str, low: int, high: int) -> int:
    """End of the last complete line in the bytes from ``low`` to ``high``, or ``low``."""
    with files.open_input_file(path) as file:
        while high > low:
            at = max(low, high - _BLOCK)
            file.seek(at)
            found = file.read(high - at).rfind(b"\n")
            if found >= 0:
                return at + found + 1
            high = at
    return low


def _lines(file, first: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Place and text of the lines that begin in a range; the last may reach beyond it."""
    at = max(0, first - 1)
    file.seek(at)
    rest = b""
    skipping = first > 0  # the line that holds the byte before is another range's
    while True:
        block = file.read(_BLOCK)
        rest += block
        *whole, rest = rest.split(b"\n")
        for line in whole:
            if not skipping:
                if at >= end:
                    return
                yield at, line.removesuffix(b"\r")
            skipping = False
            at += len(line) + 1
        if not block or (at >= end and not skipping):
            return


def _first_line(file) -> tuple[str, int]:
    """The first line that is not blank, and its place."""
    for at, line in _lines(file, 0, 1 << 62):
        if line.strip():
            return line.decode("utf-8", "replace"), at
    return "", 0


class GrowingFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(dict(self.options))


def growing_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all files of a folder as they are completed: ``session_id`` (the file), ``seq``
    (the byte the line begins at), ``value``, and the file's first line with its place."""
    spark.dataSource.register(GrowingFiles)
    return spark.readStream.format(FORMAT).option("path", path).load()

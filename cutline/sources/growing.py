"""Logs that grow, as a data source of Spark: the same rows read at once or as a stream.

    growing.register(spark)
    spark.read.format("growing_log").option("lineSep", "\\r").load(folder)
    spark.readStream.format("growing_log").option("lineSep", "\\r").load(folder)

Rows: ``file`` (path below the folder), ``start`` (byte at which the line begins, so lines are in order and told apart without counting them) and ``line``. A file is read by ranges of
bytes, each by a task of its own; a line belongs to the range in which it begins. A last line without an end is still being written: it is kept back, and comes whole in a later batch. A stream's offset holds, of each file, the byte behind its last
whole line; a file that has become shorter was begun anew and is read from its start. Options: ``lineSep`` (one byte, a line end by default), ``rangeBytes`` (64 MB; smaller ranges become so large, 64 MB at most, that about ``RANGES`` hold all that is read at once), ``suffix`` (of the files to read). Paths may be
local or of any store that Arrow's file systems know. Bytes that aren't UTF-8 are replaced. An empty or absent file has no rows; a folder without files gives none.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME, SCHEMA = "growing_log", "file string, start bigint, line string"
#: Bytes of a range; ranges of one reading, where small ones would be more; bytes that are read at once; lines of one batch of rows.
RANGE, RANGES, READ, LINES = 64 << 20, 128, 1 << 20, 10_000


@dataclass
class Range(InputPartition):
    """Whole lines of a file that begin in these bytes."""

    file: str
    begin: int
    end: int
    known: int  # where whole lines end


class _Folder:
    """Files below a path, and the lines in a range of bytes."""

    def __init__(self, options: dict):
        self.path, self.sep = options["path"].rstrip("/"), options.get("lineSep", "\n").encode()
        self.step, self.suffix = int(options.get("rangeBytes", RANGE)), options.get("suffix", "")
        if len(self.sep) != 1:
            raise ValueError("lineSep must be one byte")

    def open(self):
        if "://" in self.path or self.path.startswith("file:"):
            return fs.FileSystem.from_uri(self.path)
        return fs.LocalFileSystem(), self.path

    def sizes(self) -> dict[str, int]:
        store, root = self.open()
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        names = {i.path[len(root) :].lstrip("/"): i.size for i in found if i.type == fs.FileType.File}
        return {n: s for n, s in sorted(names.items()) if n.endswith(self.suffix) and not any(p[0] in "._" for p in n.split("/"))}

    def whole(self, file: str, size: int, least: int = 0) -> int:
        """The byte behind the last line end before size, not below least: read backwards."""
        store, root = self.open()
        with store.open_input_file(f"{root}/{file}") as f:
            at = size
            while at > least:
                begin = max(least, at - READ)
                f.seek(begin)
                place = f.read(at - begin).rfind(self.sep)
                if place >= 0:
                    return begin + place + 1
                at = begin
        return least

    def ranges(self, fresh: dict[str, tuple[int, int]]) -> list[Range]:
        """The ranges of each file's bytes (begin, known): a task each, so they don't become more with the input before they are of full size."""
        size = sum(known - begin for begin, known in fresh.values())
        step = max(self.step, min(RANGE, -(-size // RANGES)))
        return [Range(file, at, min(at + step, known), known) for file, (begin, known) in fresh.items() for at in range(begin, known, step)] or [Range("", 0, 0, 0)]

    def lines(self, part: Range) -> Iterator[pa.RecordBatch]:
        store, root = self.open()
        starts: list[int] = []
        texts: list[str] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"file": pa.array([part.file] * len(starts), pa.string()), "start": pa.array(starts, pa.int64()), "line": pa.array(texts, pa.string())})

        with store.open_input_file(f"{root}/{part.file}") as f:
            at, held = part.begin, b""  # at: where held begins
            if at:  # the line that holds the byte before is another range's, unless it ends there
                f.seek(at - 1)
                inside = f.read(1) != self.sep
            else:
                inside = False
            f.seek(at)
            while at < part.end and (read := f.read(min(READ, part.known - at - len(held)))):
                *found, rest = (held + read).split(self.sep)
                for line in found:
                    if at >= part.end:
                        break
                    if not inside:
                        starts.append(at)
                        texts.append(line.decode("utf-8", "replace"))
                    inside = False
                    at += len(line) + 1
                    if len(starts) >= LINES:
                        yield batch()
                        starts, texts = [], []
                held = rest
        if starts:
            yield batch()


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = _Folder(options)

    def partitions(self):
        return self.folder.ranges({file: (0, self.folder.whole(file, size)) for file, size in self.folder.sizes().items()})

    def read(self, partition):
        if partition.known:
            yield from self.folder.lines(partition)


class _Stream(DataSourceStreamReader):
    """Offsets: {"files": JSON of file to the byte behind its last whole line}."""

    def __init__(self, options: dict):
        self.folder, self.last = _Folder(options), {}

    def initialOffset(self):
        return {"files": "{}"}

    def latestOffset(self):
        now = {}
        for file, size in self.folder.sizes().items():
            before = self.last.get(file, 0)
            if known := self.folder.whole(file, size, before if before <= size else 0):
                now[file] = known
        self.last = now
        return {"files": json.dumps(now, sort_keys=True)}

    def partitions(self, start, end):
        before, now = json.loads(start["files"]), json.loads(end["files"])
        return self.folder.ranges({file: (before.get(file, 0) if before.get(file, 0) <= known else 0, known) for file, known in now.items()})

    def read(self, partition):
        if partition.known:
            yield from self.folder.lines(partition)

    def commit(self, end):
        pass


class GrowingLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Batch(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GrowingLog)

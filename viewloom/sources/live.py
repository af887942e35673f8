"""Text logs that grow, as a stream.

Spark's file streams read a file once. ``read_live_logs`` keeps a byte position for each log instead: a batch holds the
whole lines that came since the last one. A last line without an end waits until it has one. A log that starts anew
(another first line, or fewer bytes than were read) is read from its start, and its lines are numbered behind those of
the old one. Positions are in the stream's checkpoint, so a restart repeats and loses nothing.

Files are opened with ``pyarrow.fs``, so a path may be local, shared, or in an object store (``s3://``, ``hdfs://``...).
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "run STRING, file STRING, line_no BIGINT, line STRING"
#: Bytes of a log that one task reads, and bytes that are read at once.
RANGE, BLOCK = 64 << 20, 1 << 20
#: Bytes of the first line that tell one log from the next under the same name.
HEAD = 256
FORMAT = "live_logs"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class Range(InputPartition):
    """Bytes of a log: the lines that start in [low, high); ``base`` is the number of the log's first byte."""

    def __init__(self, file: str, low: int, high: int, base: int):
        self.file, self.low, self.high, self.base = file, low, high, base


def last_line_end(file: pa.NativeFile, low: int, size: int) -> int:
    """The end of the last whole line between two positions; ``low`` if there is none."""
    high = size
    while high > low:
        start = max(low, high - BLOCK)
        file.seek(start)
        at = file.read(high - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        high = start
    return low


def whole_lines(file: pa.NativeFile, low: int, high: int) -> Iterator[tuple[int, bytes]]:
    """(position, line) of the lines that start in [low, high), without their ends."""
    at, rest = low, b""
    if low:
        # a line belongs to the range in which it starts
        file.seek(low - 1)
        rest = file.read(BLOCK)
        while (end := rest.find(b"\n")) < 0:
            more = file.read(BLOCK)
            if not more:
                return
            at, rest = at + len(rest), more
        at, rest = at + end, rest[end + 1 :]
    else:
        file.seek(0)
    while at < high:
        end = rest.find(b"\n")
        if end < 0:
            more = file.read(BLOCK)
            if not more:
                return
            rest += more
            continue
        lines = rest.split(b"\n")
        rest = lines.pop()
        for line in lines:
            if at >= high:
                return
            yield at, line
            at += len(line) + 1


class LiveLogs(DataSource):
    """Options: ``path``, a folder with one folder for each run; ``name``, a pattern for their logs (default
    ``log.txt``); ``state``, a file in a shared folder that keeps the numbering across restarts."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LiveReader(self.options)


class LiveReader(DataSourceStreamReader):
    """Offsets are {log: [first line's digest, number of its first byte, bytes read]}."""

    def __init__(self, options: dict):
        self.path, self.pattern, self.state = options["path"].rstrip("/"), options.get("name", "log.txt"), options.get("state")
        self.known: dict[str, list] = {}
        if self.state:
            files, place = opened(self.state)
            if files.get_file_info(place).type == fs.FileType.File:
                with files.open_input_stream(place) as file:
                    self.known = json.loads(file.read())

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        files, root = opened(self.path)
        out = {file: list(known) for file, known in self.known.items()}
        for info in files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if info.type == fs.FileType.File and fnmatch.fnmatch(info.base_name, self.pattern) and info.size:
                before = self.known.get(info.path)
                if before and info.size == before[2]:
                    continue
                with files.open_input_file(info.path) as file:
                    head = file.read(HEAD).split(b"\n", 1)
                    if len(head) == 1 and info.size < HEAD:
                        continue  # not even its first line is whole
                    told = hashlib.blake2b(head[0], digest_size=8).hexdigest()
                    base, low = (before[1], before[2]) if before else (0, 0)
                    if before and (told != before[0] or info.size < low):
                        base, low = base + low, 0
                    end = last_line_end(file, low, info.size)
                if end > low or before:
                    out[info.path] = [told, base, end] if end > low else before
        self.known = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        found = []
        for file, (told, base, high) in sorted(end.items()):
            low, before = 0, start.get(file)
            if before and before[0] == told:
                # after a restart without ``state`` only the start knows the log's number
                low, base = (before[2], before[1]) if before[2] <= high else (0, max(base, before[1] + before[2]))
                if file in self.known and self.known[file][0] == told:
                    self.known[file][1] = base
            found += [Range(file, k, min(k + RANGE, high), base) for k in range(low, high, RANGE)]
        self._remember(self.known or end)
        return found

    def _remember(self, logs: dict) -> None:
        """The numbering as of a batch that is about to run; a batch that runs again finds the same."""
        if self.state:
            files, place = opened(self.state)
            with files.open_output_stream(place) as file:
                file.write(json.dumps(logs).encode())

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        files, root = opened(self.path)
        run = partition.file.rsplit("/", 2)[-2]
        names, numbers, lines, size = ["run", "file", "line_no", "line"], [], [], 0

        def told():
            texts = [t.decode("utf-8", "replace").rstrip() for t in lines]
            columns = [[run] * len(texts), [partition.file] * len(texts), list(numbers), texts]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        with files.open_input_file(partition.file) as file:
            for at, line in whole_lines(file, partition.low, partition.high):
                numbers.append(partition.base + at)
                lines.append(line)
                size += len(line)
                if size >= BLOCK:
                    yield told()
                    numbers, lines, size = [], [], 0
        if lines:
            yield told()


def read_live_logs(spark: SparkSession, path: str, name: str = "log.txt", state: str | None = None) -> DataFrame:
    """(run, file, line_no, line) of ``{path}/{run}/{name}`` as the logs grow; white space at a line's end is dropped.

    ``line_no`` grows along a log but has gaps: it is the byte position of the line, behind all bytes of the logs that
    had this name before. A log that was replaced while the stream stood still continues its numbers only with
    ``state``. Listing is the driver's: each batch lists the folder and opens the logs whose size changed.
    """
    # executors need no copy of this module
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(LiveLogs)
    reader = spark.readStream.format(FORMAT).option("path", path).option("name", name)
    return (reader.option("state", state) if state else reader).load()

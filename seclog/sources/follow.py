"""Text logs that grow and rotate, as batch or stream: each line once, with an id that does not depend on how it was read.

A file is known by a digest of its first line, so it keeps its identity when it grows, is renamed or copied; a place in
it is a byte position. The offsets of a stream are byte positions per file, its partitions byte ranges.
"""

from __future__ import annotations

import fnmatch
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from seclog.sources.text import _BLANK

SCHEMA = "file_id string, position long, size long, line string, file string, arrived timestamp"
#: Bytes of a first line that make the identity, and bytes before a position that must be unchanged to go on from it.
HEAD, TAIL = 4096, 1024
READ = 1 << 20
#: Lines and bytes in a batch of rows.
ROWS, BYTES = 8192, 4 << 20
#: Tasks to which the ranges of a batch are dealt if they are short, and bytes that a task reads at most of such ranges.
TASKS, OWN = 128, 64 << 20


@dataclass(frozen=True)
class Found:
    """A file as a listing shows it: its lines end at ``end``; ``tail`` is a digest of the bytes before that."""

    key: str
    path: str
    end: int
    tail: str
    arrived: float


@dataclass
class Span:
    """The lines of a file that start in ``begin <= position < stop``; a line starts at ``first``, none after ``end``."""

    key: str
    path: str
    first: int
    begin: int
    stop: int
    end: int
    arrived: float


@dataclass
class Spans(InputPartition):
    """Ranges that a task reads one after the other."""

    spans: list[Span]


class LogFolder:
    """The files of a folder, or one file, wherever ``pyarrow.fs`` can read."""

    def __init__(self, path: str, pattern: str = "*") -> None:
        from pyarrow import fs

        if path.startswith("file:") and not path.startswith("file://"):
            path = path.removeprefix("file:")
        self.store, self.place = fs.FileSystem.from_uri(path)
        self.place, self.pattern = self.place.rstrip("/"), pattern
        self._known: dict[str, tuple[tuple, str | None, int, str]] = {}

    def _listed(self) -> list:
        from pyarrow import fs

        info = self.store.get_file_info(self.place)
        if info.type == fs.FileType.Directory:
            found = self.store.get_file_info(fs.FileSelector(self.place, recursive=True, allow_not_found=True))
        else:
            found = [info]
        hidden = lambda x: any(part.startswith(("_", ".")) and "=" not in part for part in x.path.removeprefix(self.place).split("/"))
        return [x for x in found if x.type == fs.FileType.File and x.size and not hidden(x) and fnmatch.fnmatch(x.base_name, self.pattern)]

    def bytes_at(self, path: str, begin: int, n: int) -> bytes:
        with self.store.open_input_file(path) as f:
            f.seek(begin)
            return f.read(n)

    def identity(self, path: str, whole: bool = False) -> str | None:
        """Digest of the first line; None while that is not complete, unless ``whole`` says that it will not grow."""
        head = self.bytes_at(path, 0, HEAD)
        line = head.split(b"\n", 1)[0]
        if len(line) == len(head) < HEAD and not whole:
            return None
        return hashlib.sha256(line).hexdigest()[:32]

    def tail(self, path: str, end: int) -> str:
        return hashlib.sha256(self.bytes_at(path, max(end - TAIL, 0), min(end, TAIL))).hexdigest()[:32]

    def _complete(self, path: str, size: int) -> int:
        """Where the last line that ends in a newline ends."""
        at = size
        while at:
            begin = max(at - (1 << 16), 0)
            newline = self.bytes_at(path, begin, at - begin).rfind(b"\n")
            if newline >= 0:
                return begin + newline + 1
            at = begin
        return 0

    def files(self, whole: bool) -> list[Found]:
        """One entry per different file, the longest of those that are copies of each other's start.

        Files that share their first line and then differ are told apart by their paths. ``whole``: a last line
        without newline counts. Files that did not change since the last listing are not opened again.
        """
        known, groups = {}, {}
        for x in self._listed():
            state = (x.size, x.mtime_ns)
            if x.path in self._known and self._known[x.path][0] == state:
                known[x.path] = self._known[x.path]
            else:
                end = x.size if whole else self._complete(x.path, x.size)
                known[x.path] = state, self.identity(x.path, whole), end, self.tail(x.path, end)
            _, key, end, tail = known[x.path]
            if key is not None and end:
                groups.setdefault(key, []).append(Found(key, x.path, end, tail, x.mtime_ns / 1e9))
        self._known = known
        out = []
        for key, same in groups.items():
            kept: list[Found] = []
            for f in sorted(same, key=lambda f: (-f.end, f.path)):
                if not any(self.tail(longer.path, f.end) == f.tail for longer in kept):
                    kept.append(f if not kept else Found(f"{key}@{f.path}", f.path, f.end, f.tail, f.arrived))
            out += kept
        return out

    def located(self, key: str, path: str, whole: bool) -> str:
        """Where the file with this identity lies now: it may have been rotated away since it was listed."""
        try:
            if self.identity(path, whole) == key.split("@")[0]:
                return path
        except FileNotFoundError:
            pass
        for f in self.files(whole):
            if f.key == key:
                return f.path
        raise FileNotFoundError(f"{path}: gone, and no other file starts with the same line")


def spans(found: Found, begin: int, chunk: int) -> list[Span]:
    """The lines from ``begin`` on, in ranges of ``chunk`` bytes."""
    return [Span(found.key, found.path, begin, at, min(at + chunk, found.end), found.end, found.arrived) for at in range(begin, found.end, chunk)]


def dealt(spans: list[Span]) -> list[Spans]:
    """Ranges in order, short ones dealt to about ``TASKS`` tasks of at most ``OWN`` bytes: a task costs more than a short range."""
    room = min(OWN, sum(s.stop - s.begin for s in spans) // TASKS)
    out, held = [], 0
    for span in spans:
        size = span.stop - span.begin
        if not out or held + size > room:
            out.append(Spans([]))
            held = 0
        out[-1].spans.append(span)
        held += size
    return out


def read_span(folder: LogFolder, span: Span, whole: bool) -> Iterator[pa.RecordBatch]:
    """Rows of a range, empty lines too, so that the ranges of a file cover it."""
    path = folder.located(span.key, span.path, whole)
    arrived = datetime.fromtimestamp(span.arrived, timezone.utc)
    schema = pa.schema([("file_id", pa.string()), ("position", pa.int64()), ("size", pa.int64()), ("line", pa.string()), ("file", pa.string()), ("arrived", pa.timestamp("us", "UTC"))])

    def batch(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
        n = len(rows)
        at, sizes, lines = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([span.key] * n), pa.array(at, pa.int64()), pa.array(sizes, pa.int64()), pa.array(lines), pa.array([path] * n), pa.array([arrived] * n, pa.timestamp("us", "UTC"))], schema=schema)

    rows, held = [], 0
    # a line that starts before the range belongs to the range before: begin one byte earlier, skip to the first newline
    at = span.begin if span.begin == span.first else span.begin - 1
    skip = at < span.begin
    with folder.store.open_input_file(path) as f:
        f.seek(at)
        rest, read_to = b"", at
        while at < span.stop:
            more = f.read(min(READ, span.end - read_to))
            read_to += len(more)
            *lines, rest = (rest + more).split(b"\n")
            if not more:
                lines, rest = [rest] if rest else [], b""
            for raw in lines:
                size = min(len(raw) + 1, span.end - at)
                if skip:
                    skip = False
                elif at < span.stop:
                    rows.append((at, size, raw.decode("utf-8", "ignore").replace("�", "").strip(_BLANK)))
                    held += size
                    if len(rows) >= ROWS or held >= BYTES:
                        yield batch(rows)
                        rows, held = [], 0
                at += size
            if not more:
                break
    if rows:
        yield batch(rows)


class _Batch(DataSourceReader):
    def __init__(self, folder: LogFolder, chunk: int) -> None:
        self.folder, self.chunk = folder, chunk

    def partitions(self) -> list[Spans]:
        return dealt([s for f in self.folder.files(whole=True) for s in spans(f, 0, self.chunk)]) or [Spans([])]

    def read(self, partition: Spans) -> Iterator[pa.RecordBatch]:
        for span in partition.spans:
            yield from read_span(self.folder, span, True)


class _Stream(DataSourceStreamReader):
    """Offsets are {file: [path, end, tail, arrived]}; lines without a newline wait until they are complete."""

    def __init__(self, folder: LogFolder, chunk: int) -> None:
        self.folder, self.chunk = folder, chunk

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {f.key: [f.path, f.end, f.tail, f.arrived] for f in self.folder.files(whole=False)}

    def partitions(self, start: dict, end: dict) -> list[Spans]:
        out = []
        for key, (path, stop, tail, arrived) in end.items():
            begin = 0
            if key in start:
                _, begin, before, _ = start[key]
                if stop < begin or (stop > begin and self.folder.tail(self.folder.located(key, path, False), begin) != before):
                    begin = 0  # cut short and written anew with the same first line
            out += spans(Found(key, path, stop, tail, arrived), begin, self.chunk)
        return dealt(out)

    def read(self, partition: Spans) -> Iterator[pa.RecordBatch]:
        for span in partition.spans:
            yield from read_span(self.folder, span, False)


class FollowedLogs(DataSource):
    """Options: ``path`` (a file or a folder, searched in depth), ``pattern`` of file names, ``chunk`` bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "followed_logs"

    def schema(self) -> str:
        return SCHEMA

    def _parts(self) -> tuple[LogFolder, int]:
        return LogFolder(self.options["path"], self.options.get("pattern", "*")), int(self.options.get("chunk", 64 << 20))

    def reader(self, schema) -> DataSourceReader:
        return _Batch(*self._parts())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(*self._parts())


def _register(spark: SparkSession) -> None:
    # workers that plan and read need the classes themselves where the package is not installed
    from pyspark import cloudpickle

    from seclog.sources import follow

    cloudpickle.register_pickle_by_value(follow)
    try:
        spark.dataSource.register(FollowedLogs)
    finally:
        cloudpickle.unregister_pickle_by_value(follow)


def lines_of(raw: DataFrame) -> DataFrame:
    """Non-empty lines with ``event_id``, a hash of file identity, position and line.

    It is the same whether the lines come by batch or stream, in how many ranges and under which file name.
    """
    return raw.filter(F.length("line") > 0).withColumn("event_id", F.xxhash64("file_id", "position", "line"))


def read_grown_lines(spark: SparkSession, path: str, pattern: str = "*", chunk: int = 64 << 20) -> DataFrame:
    """(file_id, position, size, line, file, arrived) of all lines of the files that are there, empty ones too.

    Files that are copies of the start of another count once. An unfinished last line is a line. Compressed files are
    not looked into.
    """
    _register(spark)
    return spark.read.format("followed_logs").option("pattern", pattern).option("chunk", chunk).load(path)


def follow_lines(spark: SparkSession, path: str, pattern: str = "*", chunk: int = 64 << 20) -> DataFrame:
    """The same as a stream that goes on where each file was left, also if it was renamed meanwhile.

    Only finished lines are taken. A file that was cut short and written anew is read from its start. Files that are
    gone are forgotten; if one comes back, it is read again (``streaming.replays`` drops such lines).
    """
    _register(spark)
    return spark.readStream.format("followed_logs").option("pattern", pattern).option("chunk", chunk).load(path)

"""Lines of log files with their byte offsets, as a table or as a stream.

``spark.read.format("log_lines").load(path)`` cuts files into byte ranges. A range begins at the first line that starts in it and ends with the
last one that does, so a line is read once, by one task, wherever the cuts fall; its position is where it starts, and ``next`` is where
the line after it does. Nothing has to be counted or joined. ``path`` is a file, a folder or a pattern (``*`` within one name, ``**`` over
folders), or several of them, on any file system that Arrow opens. Lines end at \\n, \\r\\n or \\r; broken UTF-8 becomes U+FFFD.

``spark.readStream.format("log_lines")`` reads what has been added since the last trigger: offsets are one position a file, and a last line
without an end waits until it has one.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, pos bigint, next bigint, raw string"
CHUNK = 1 << 20
#: a task takes one range up to so many tasks, then more of them, up to so many bytes
TASKS, TASK_BYTES = 256, 64 << 20
_END = re.compile(rb"\r\n|\n|\r")


class Ranges(InputPartition):
    """Spans (file, first, last, size) that one task reads in byte ranges of ``split``; ``size`` is where the files end for this read."""

    def __init__(self, parts: list[tuple[str, int, int, int]], split: int):
        self.parts, self.split = parts, split


def _opened(path: str):
    """The file system and the place in it of a plain path, of ``file:`` in any form, or of an address that Arrow knows."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


def _pattern(path: str) -> re.Pattern:
    out = ""
    for piece in re.split(r"(\*\*|\*|\?)", path):
        out += {"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(piece) or re.escape(piece)
    return re.compile(out)


def found(paths: list[str]) -> dict[str, int]:
    """Size of every file that the paths name; hidden files of folders and patterns are left out."""
    out = {}
    for path in paths:
        wild = re.search(r"[*?]", path)
        base = path if not wild else path[:path.rindex("/", 0, wild.start()) + 1]
        system, place = _opened(base)
        # file names keep the way they were asked for: a plain path or a URI
        prefix = base[:len(base.rstrip("/")) - len(place.rstrip("/"))] if base.rstrip("/").endswith(place.rstrip("/")) else ""
        info = system.get_file_info(place)
        if info.type == pafs.FileType.File and not wild:
            out[prefix + place] = info.size
            continue
        keep = _pattern(path) if wild else None
        for f in system.get_file_info(pafs.FileSelector(place, allow_not_found=bool(wild), recursive=True)):
            name = prefix + f.path
            if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")) and (keep is None or keep.fullmatch(name)):
                out[name] = f.size
    return out


def lines(read, first: int, last: int, size: int) -> Iterator[tuple[int, int, bytes]]:
    """(pos, next, line) of the lines that start in [first, last). ``read(offset, n)`` gives at most n bytes; the file counts as ended at
    ``size``. At most a chunk and one line are held."""
    at = max(first - 2, 0)
    held, base = b"", at  # bytes from ``base`` on
    start = 0 if first == 0 else None  # where the current line starts; None until a line start is known
    done = 0
    step = last - at + 256  # a short range asks for little more than it is; a line that goes on, for twice as much each time
    while True:
        more = read(base + len(held), min(CHUNK, step, size - base - len(held)))
        held, step = held + more, max(last - base - len(held) - len(more), 2 * step)
        ended = not more
        for end in _END.finditer(held, done):
            if end.group() == b"\r" and end.end() == len(held) and not ended:
                break  # the rest of this line end may be in the next chunk
            done = end.end()
            if start is not None and first <= start < last:
                yield start, base + end.end(), held[start - base:end.start()]
            start = base + end.end()
            if start >= last:
                return
        if ended:
            if start is not None and first <= start < last and start < base + len(held):
                yield start, base + len(held), held[start - base:]
            return
        drop = len(held) - 2 if start is None else start - base
        if drop > 0:
            held, base, done = held[drop:], base + drop, max(done - drop, 0)
        if held and (start is None or start < base + len(held)):
            done = max(done, len(held) - 1)  # only a \r at the end is looked at again


def _buffered(handle, end: int):
    """``read(offset, n)`` for ranges up to ``end`` that follow on each other: the file is read in chunks, whatever the ranges ask for."""
    base, held = 0, b""

    def read(offset, n):
        nonlocal base, held
        if n <= 0:
            return b""
        if not base <= offset <= offset + n <= base + len(held):
            base, held = offset, handle.read_at(max(n, min(CHUNK, end - offset + 256)), offset)
        return held[offset - base:offset - base + n]

    return read


def _batches(parts: list[tuple[str, int, int, int]], split: int) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for path, first, last, size in parts:
        system, place = _opened(path)
        with system.open_input_file(place) as handle:
            read = _buffered(handle, min(last, size))
            for at in range(first, last, split):
                for pos, after, line in lines(read, at, min(at + split, last), size):
                    rows.append((path, pos, after, line.decode("utf-8", "replace")))
                    held += len(line) + 100
                    if held > 4 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["file", "pos", "next", "raw"])


def _packed(parts: list[tuple[str, int, int, int]], split: int) -> list[Ranges]:
    """Tasks of ranges of at most ``split`` bytes, small files together. Beyond ``TASKS`` ranges a task takes several that follow on each
    other, so that short ranges do not make a task each."""
    total = sum(last - first for _, first, last, _ in parts)
    share = split * max(1, min(-(-total // (TASKS * split)), TASK_BYTES // split))
    out, held, load = [], [], 0
    for path, first, last, size in parts:
        for a in range(first, last, share):
            z = min(a + share, last)
            if held and load + z - a > share:
                out.append(Ranges(held, split))
                held, load = [], 0
            held.append((path, a, z, size))
            load += z - a
    return out + ([Ranges(held, split)] if held else [])


class _Options:
    def __init__(self, options):
        given = options.get("paths") or json.dumps([options["path"]] if options.get("path") else [])
        self.paths = json.loads(given)
        if not self.paths:
            raise ValueError("log_lines needs a path")
        self.split = int(options.get("splitbytes", options.get("splitBytes", 64 << 20)))
        if self.split < 1:
            raise ValueError("splitBytes must be positive")


class LinesReader(DataSourceReader, _Options):
    def __init__(self, options):
        _Options.__init__(self, options)

    def partitions(self):
        return _packed([(path, 0, size, size) for path, size in sorted(found(self.paths).items())], self.split) or [Ranges([], self.split)]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        yield from _batches(partition.parts, partition.split)


class LinesStream(DataSourceStreamReader, _Options):
    def __init__(self, options):
        _Options.__init__(self, options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {path: end for path, size in found(self.paths).items() if (end := self._complete(path, size))}

    @staticmethod
    def _complete(path: str, size: int) -> int:
        """Where the last line that has an end does end."""
        system, place = _opened(path)
        with system.open_input_file(place) as handle:
            while size:
                first = max(0, size - CHUNK)
                at = handle.read_at(size - first, first).rfind(b"\n")
                if at >= 0:
                    return first + at + 1
                size = first
        return 0

    def partitions(self, start: dict, end: dict):
        return _packed([(path, start.get(path, 0), last, last) for path, last in sorted(end.items()) if last > start.get(path, 0)], self.split) or [Ranges([], self.split)]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        yield from _batches(partition.parts, partition.split)

    def commit(self, end: dict) -> None:
        pass


class LogLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LinesReader:
        return LinesReader(self.options)

    def streamReader(self, schema) -> LinesStream:
        return LinesStream(self.options)


def _set(reader, path, split_bytes):
    paths = [path] if isinstance(path, (str, os.PathLike)) else list(path)
    return reader.format("log_lines").option("paths", json.dumps([str(p) for p in paths])).option("splitBytes", str(split_bytes))


def read(spark: SparkSession, path, split_bytes: int = 64 << 20) -> DataFrame:
    spark.dataSource.register(LogLines)
    return _set(spark.read, path, split_bytes).load()


def stream(spark: SparkSession, path, split_bytes: int = 64 << 20) -> DataFrame:
    spark.dataSource.register(LogLines)
    return _set(spark.readStream, path, split_bytes).load()

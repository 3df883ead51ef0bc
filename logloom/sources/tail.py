"""Following log files that still grow, as a streaming source by byte offsets.

What is read from a file ends where its last entry begins: an entry is passed on once another
one has begun after it, or once the file has not changed for `quiet` seconds. A file that has
become shorter is read from its start.

    spark.dataSource.register(LogTail)
    spark.readStream.format("logtail").option("path", "/logs").load()
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "value string, file string, mtime timestamp, block bigint, seq bigint"
#: Bytes of a file that one task reads, and seconds after which a file counts as quiet.
PIECE, QUIET = 64 << 20, 5.0


class Span(InputPartition):
    def __init__(self, path: str, start: int, end: int, mtime: float):
        self.path, self.start, self.end, self.mtime = path, start, end, mtime


def _system(folder: str):
    """The file system of a folder, and its path there."""
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def log_files(folder: str, suffix: str = ".log"):
    """The log files of a folder in order of time and name."""
    from pyarrow import fs

    system, path = _system(folder)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted((f for f in found if f.is_file and f.base_name.endswith(suffix)), key=lambda f: (f.mtime_ns, f.path))


def _last_entry(system, path: str, start: int, end: int) -> int:
    """Where the last line that begins with '[' begins in a stretch of a file; its start if none does."""
    with system.open_input_file(path) as f:
        high = end
        while high > start:
            low = max(start, high - (1 << 20))
            f.seek(max(low - 1, 0))
            held = f.read(high - max(low - 1, 0) + 1)
            at = held.rfind(b"\n[")
            if at >= 0:
                return max(low - 1, 0) + at + 1
            high = low
    return start


class _Reader(DataSourceStreamReader):
    def __init__(self, folder: str, suffix: str, quiet: float, piece: int):
        self.folder, self.suffix, self.quiet, self.piece = folder, suffix, quiet, piece
        self.at: dict[str, list] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        system, _ = _system(self.folder)
        for f in log_files(self.folder, self.suffix):
            start = self.at.get(f.path, [0, 0])[0]
            start = 0 if f.size < start else start
            still = time.time() - f.mtime_ns / 1e9 >= self.quiet
            end = f.size if still or f.size == start else _last_entry(system, f.path, start, f.size)
            self.at[f.path] = [end, f.mtime_ns / 1e9]
        return {"files": json.dumps(self.at, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        old, new = json.loads(start["files"]), json.loads(end["files"])
        self.at = {**new, **self.at}
        out, (system, _) = [], _system(self.folder)
        for path, (stop, mtime) in new.items():
            at = old.get(path, [0, 0])[0]
            at = 0 if stop < at else at
            while at < stop:
                cut = stop if stop - at <= self.piece else _last_entry(system, path, at, at + self.piece)
                cut = cut if cut > at else stop
                out.append(Span(path, at, cut, mtime))
                at = cut
        return out

    def read(self, span: Span) -> Iterator[tuple]:
        from datetime import datetime, timezone

        system, _ = _system(self.folder)
        with system.open_input_file(span.path) as f:
            f.seek(span.start)
            text = f.read(span.end - span.start).decode("utf-8", "replace")
        when, name = datetime.fromtimestamp(span.mtime, timezone.utc), span.path.rsplit("/", 1)[-1]
        for n, piece in enumerate(("\n" + text).split("\n[")):
            if n:  # what stands before the first entry belongs to none
                yield ("[" + piece, name, when, span.start, n)

    def commit(self, end: dict) -> None:
        pass


class LogTail(DataSource):
    """Options: path (a folder), suffix (of its log files, .log), quiet (seconds), piece (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "logtail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["path"], self.options.get("suffix", ".log"), float(self.options.get("quiet", QUIET)), int(self.options.get("piece", PIECE)))


def tail_entries(spark: SparkSession, path: str, quiet: float = QUIET, suffix: str = ".log") -> DataFrame:
    """value, file, ord as of read_entries(), of a folder's files as they grow."""
    from logloom.sources.logs import entries_of

    spark.dataSource.register(LogTail)
    return entries_of(spark.readStream.format("logtail").option("path", path).option("quiet", str(quiet)).option("suffix", suffix).load())

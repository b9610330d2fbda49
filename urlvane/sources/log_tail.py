"""Tail of appended line logs as a stream: a Python data source with byte offsets.

Spark's file source follows new files; this one also follows bytes that writers append to files it has read. The
offset is the number of bytes taken per file, always just behind a line end, so that an incomplete last line waits
until it is whole. Long stretches are cut into partitions by bytes; a partition owns the lines that begin in it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "urlvane_log_tail"
#: Bytes of a partition, and of one look for a line end.
PARTITION_BYTES = 32 << 20
BLOCK_BYTES = 1 << 16


@dataclass
class Stretch(InputPartition):
    file: str
    first: int
    last: int
    end: int  # bytes of the file that may be read


def _folder(path: str):
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str, partition_bytes: int):
        self.path, self.partition_bytes = path, partition_bytes

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        store, root = _folder(self.path)
        ends = {}
        for info in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            hidden = any(part[:1] in ("_", ".") for part in info.path[len(root):].strip("/").split("/"))
            if info.is_file and not hidden:
                ends[info.path] = self._line_end(store, info.path, info.size)
        return {"files": json.dumps(ends, sort_keys=True)}

    def _line_end(self, store, file: str, size: int) -> int:
        """Bytes up to and with the last line end of the file."""
        with store.open_input_file(file) as stream:
            while size > 0:
                first = max(0, size - BLOCK_BYTES)
                at = stream.read_at(size - first, first).rfind(b"\n")
                if at >= 0:
                    return first + at + 1
                size = first
        return 0

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        taken, upto = json.loads(start["files"]), json.loads(end["files"])
        out = []
        for file, last in upto.items():
            first = taken.get(file, 0)
            if last < first:  # the file was begun anew
                first = 0
            out += [Stretch(file, at, min(at + self.partition_bytes, last), last) for at in range(first, last, self.partition_bytes)]
        return out

    def read(self, partition: Stretch) -> Iterator:
        import pyarrow as pa

        store, _ = _folder(self.path)
        with store.open_input_file(partition.file) as stream:
            at = partition.first
            if at and stream.read_at(1, at - 1) != b"\n":  # the line began before
                at = self._after_line(stream, at, partition.end)
            while at < partition.last:
                data = stream.read_at(min(max(partition.last - at, 1), PARTITION_BYTES), at)
                cut = data.rfind(b"\n") + 1
                if not cut:  # one line longer than the stretch
                    data = stream.read_at(self._after_line(stream, at, partition.end) - at, at)
                    cut = len(data)
                lines = data[:cut].split(b"\n")[:-1]
                places, place = [], at
                for line in lines:
                    places.append(place)
                    place += len(line) + 1
                values = [line.removesuffix(b"\r").decode("utf-8", "replace") for line in lines]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([partition.file] * len(values), pa.string()), pa.array(places, pa.int64()), pa.array(values, pa.string())],
                    ["file", "at", "value"])
                at += cut

    def _after_line(self, stream, at: int, end: int) -> int:
        while at < end:
            found = stream.read_at(min(BLOCK_BYTES, end - at), at).find(b"\n")
            if found >= 0:
                return at + found + 1
            at = min(at + BLOCK_BYTES, end)
        return end

    def commit(self, end: dict) -> None:
        pass


class LogTail(DataSource):
    """Rows (file, at, value): each whole line of the files below `path`, with the byte it begins at."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "file string, at long, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["path"], int(self.options.get("partitionBytes", PARTITION_BYTES)))


def tail_lines(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """The lines of a folder's logs as a stream, appended ones included. Names that begin with `_` or `.` are passed over."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format(NAME).option("path", path).option("partitionBytes", partition_bytes).load()

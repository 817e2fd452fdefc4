"""Streams over text files that grow.

Spark's file stream takes a file once, as it is when it is first seen; a log that a
device goes on writing to needs a position per file. ``GrowingLines`` is a data source
whose offset is a number of bytes for each file of a folder: what lies between two offsets
is cut into byte ranges, and each task reads the lines that begin in its range. The
position never stands inside a line, so that a line which is half written waits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of a file that a task reads, and that are looked through at once for a line's end.
RANGE, STEP = 64 << 20, 1 << 16


class Piece(InputPartition):
    """Lines of ``path`` that begin in ``start .. end``; ``first``: one begins at ``start``."""

    def __init__(self, path: str, start: int, end: int, first: bool):
        self.path, self.start, self.end, self.first = path, start, end, first


def last_line_end(file, size: int) -> int:
    """Bytes of ``file`` up to its last line mark."""
    at = size
    while at > 0:
        begin = max(0, at - STEP)
        file.seek(begin)
        mark = file.read(at - begin).rfind(b"\n")
        if mark >= 0:
            return begin + mark + 1
        at = begin
    return 0


class GrowingReader(DataSourceStreamReader):
    def __init__(self, path: str, suffix: str, size: int):
        self.path, self.suffix, self.size = path, suffix, size

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, folder = fs.FileSystem.from_uri(self.path)
        out = {}
        for f in sorted(store.get_file_info(fs.FileSelector(folder, allow_not_found=True)), key=lambda f: f.path):
            if f.is_file and f.path.endswith(self.suffix) and not f.base_name.startswith(("_", ".")) and f.size:
                with store.open_input_file(f.path) as file:
                    out[f.base_name] = last_line_end(file, f.size)
        return out

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out = []
        for name, to in end.items():
            since = start.get(name, 0)
            since = since if since <= to else 0  # a file that was written anew
            for at in range(since, to, self.size):
                out.append(Piece(name, at, min(at + self.size, to), at == since))
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(self.path)
        at = partition.start
        with store.open_input_file(f"{folder}/{partition.path}") as file:
            file.seek(at if partition.first else at - 1)
            rest = b""
            if not partition.first:  # the line that began before is another task's
                while (mark := rest.find(b"\n")) < 0:
                    chunk = file.read(STEP)
                    if not chunk:
                        return
                    rest += chunk
                at, rest = at - 1 + mark + 1, rest[mark + 1 :]
            while at < partition.end:
                chunk = file.read(1 << 20)
                *lines, rest = (rest + chunk).split(b"\n")
                starts = []
                for line in lines:
                    starts.append(at)
                    at += len(line) + 1
                many = sum(s < partition.end for s in starts)
                if many:
                    texts = [x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines[:many]]
                    yield pa.record_batch({"value": pa.array(texts, pa.string()), "file": pa.array([partition.path] * many, pa.string()), "at": pa.array(starts[:many], pa.int64())})
                if not chunk:
                    return


class GrowingLines(DataSource):
    """``value`` (a line), ``file`` and ``at`` (its first byte) of the files in ``path``
    that end in ``suffix``. ``path`` is a folder in any store that Arrow opens."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "value string, file string, at long"

    def streamReader(self, schema: StructType) -> GrowingReader:
        return GrowingReader(self.options["path"], self.options.get("suffix", ""), int(self.options.get("rangeBytes", RANGE)))


def stream_lines(spark: SparkSession, path: str, suffix: str = "", range_bytes: int = RANGE) -> DataFrame:
    """Lines of all files in ``path`` and of what is appended to them later, each once over
    stops and restarts of a query."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").option("suffix", suffix).option("rangeBytes", str(range_bytes)).load(path)

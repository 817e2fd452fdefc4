"""Incremental pulls per boundary as a stream.

``BoundaryPulls`` reads a Parquet table that lies in a folder per boundary. Its offset is
the time and id of the newest row of each boundary, so that a query that is stopped goes
on where each boundary was, and a boundary that is new is pulled as a whole. Newest rows
are found from the files' statistics and the row groups that hold the latest time alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


class Pull(InputPartition):
    """Rows of a file after ``since`` and up to ``to``: (time, id), or None."""

    def __init__(self, path: str, boundary: str, since: tuple | None, to: tuple):
        self.path, self.boundary, self.since, self.to = path, boundary, since, to


class PullReader(DataSourceStreamReader):
    def __init__(self, path: str, key: str, time: str, id_col: str, schema: StructType):
        self.path, self.key, self.time, self.id_col, self.names = path, key, time, id_col, schema.fieldNames()

    def initialOffset(self) -> dict:
        return {}

    def files(self) -> list[tuple[str, str]]:
        store, folder = fs.FileSystem.from_uri(self.path)
        out = []
        for f in store.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True)):
            parent = f.path.rsplit("/", 2)[-2]
            if f.is_file and f.path.endswith(".parquet") and not f.base_name.startswith(("_", ".")) and parent.startswith(f"{self.key}="):
                out.append((unquote(parent.split("=", 1)[1]), f.path))
        return sorted(out)

    def latest_of(self, store, path: str) -> tuple | None:
        """(time, id) of the newest row of a file."""
        with pq.ParquetFile(path, filesystem=store) as file:
            at = file.schema_arrow.get_field_index(self.time)
            stats = [file.metadata.row_group(i).column(at).statistics for i in range(file.num_row_groups)]
            tops = [s.max if s is not None and s.has_min_max else None for s in stats]
            known = [t for t in tops if t is not None]
            best = None
            for i, top in enumerate(tops):
                if top is None or top == max(known):
                    rows = file.read_row_group(i, columns=[self.time, self.id_col])
                    time = pc.max(rows[self.time])
                    if time.is_valid:
                        newest = (time.as_py(), pc.max(rows.filter(pc.equal(rows[self.time], time))[self.id_col]).as_py())
                        best = newest if best is None else max(best, newest)
            return best

    def latestOffset(self) -> dict:
        store, _ = fs.FileSystem.from_uri(self.path)
        out: dict = {}
        for boundary, path in self.files():
            newest = self.latest_of(store, path)
            if newest is not None:
                was = out.get(boundary)
                out[boundary] = max(newest, was) if was else newest
        return {b: {"time": t, "id": i} for b, (t, i) in out.items()}

    def partitions(self, start: dict, end: dict) -> list[Pull]:
        pair = lambda offset: (offset["time"], offset["id"])
        out = []
        for boundary, path in self.files():
            since = pair(start[boundary]) if boundary in start else None
            if boundary in end and since != pair(end[boundary]):
                out.append(Pull(path, boundary, since, pair(end[boundary])))
        return out

    def read(self, partition: Pull) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)
        t, i = pc.field(self.time), pc.field(self.id_col)
        up_to = (t < partition.to[0]) | ((t == partition.to[0]) & (i <= partition.to[1]))
        if partition.since:
            up_to &= (t > partition.since[0]) | ((t == partition.since[0]) & (i > partition.since[1]))
        found = ds.dataset(partition.path, filesystem=store, format="parquet").scanner(columns=[c for c in self.names if c != self.key], filter=up_to)
        for batch in found.to_batches():
            if batch.num_rows:
                columns = {c: batch.column(c) for c in batch.schema.names} | {self.key: pa.array([partition.boundary] * batch.num_rows, pa.string())}
                yield pa.record_batch([columns[c] for c in self.names], names=self.names)


class BoundaryPulls(DataSource):
    @classmethod
    def name(cls) -> str:
        return "boundary_pulls"

    def streamReader(self, schema: StructType) -> PullReader:
        return PullReader(self.options["path"], self.options["key"], self.options["time"], self.options["id"], schema)


def stream_pulls(spark: SparkSession, path: str, schema: StructType, key: str = "boundary", time: str = "modified_at", id_col: str = "id") -> DataFrame:
    """Rows of the table in ``path`` as they come, each once over stops of a query: those
    after the boundary's last pull, by whole-number ``time``, then ``id_col``. ``schema``
    has the table's columns, the boundary (``key``, the folders' name) as a string."""
    spark.dataSource.register(BoundaryPulls)
    reader = spark.readStream.format("boundary_pulls").schema(schema)
    return reader.option("key", key).option("time", time).option("id", id_col).load(path)

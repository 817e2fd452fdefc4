"""GeoJSON collections of any size (A4, A10).

``GeoJsonFeatures`` is a data source that cuts a collection into byte ranges: a task takes
the features that begin in its range, found by how a feature object begins. A file whose
first feature does not begin with its type is read by one task. The properties of the
first feature are the columns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

RANGE, STEP = 32 << 20, 1 << 20
FEATURE = re.compile(rb'\{\s*"type"\s*:\s*"Feature"\s*[,}]')
#: Where the list of features begins, and a feature's longest possible beginning.
LIST, HEAD = re.compile(rb'"features"\s*:\s*\['), 256


class Span(InputPartition):
    """Features of a file that begin in ``start .. end``; ``whole``: all, parsed at once."""

    def __init__(self, path: str, start: int, end: int, whole: bool):
        self.path, self.start, self.end, self.whole = path, start, end, whole


def files_of(path: str) -> list[tuple[str, int]]:
    store, at = fs.FileSystem.from_uri(path)
    info = store.get_file_info(at)
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted((f.path, f.size) for f in found if f.is_file and f.size and not f.base_name.startswith(("_", ".")))


def first_feature(file, size: int) -> tuple[int, bool, dict] | None:
    """Where the list of features begins, whether its first one begins with its type, and
    that feature; None without features."""
    data, at = b"", 0
    while True:
        found = LIST.search(data)
        if found:
            begin = re.match(rb"\s*", data[found.end() :]).end() + found.end()
            if data[begin : begin + 1] == b"]":
                return None
            try:
                feature, _ = json.JSONDecoder().raw_decode(data[begin:].decode("utf-8", "ignore"))
                return begin, FEATURE.match(data, begin) is not None, feature
            except ValueError:
                pass
        if at >= size:
            return None
        file.seek(at)
        data += file.read(max(STEP, len(data)))
        at = len(data)


def schema_of(feature: dict) -> StructType:
    kinds = {bool: BooleanType(), int: DoubleType(), float: DoubleType()}
    fields = [StructField(k, kinds.get(type(v), StringType())) for k, v in (feature.get("properties") or {}).items()]
    return StructType([*fields, StructField("geometry_type", StringType()), StructField("coordinates", StringType())])


def as_row(feature: dict, schema: StructType) -> tuple:
    """Values as their column has them; one of another kind is null, or text."""
    props, shape = feature.get("properties") or {}, feature.get("geometry") or {}
    out = []
    for f in schema.fields[:-2]:
        x = props.get(f.name)
        if f.dataType == StringType():
            out.append(x if x is None or isinstance(x, str) else json.dumps(x, separators=(",", ":")))
        elif f.dataType == BooleanType():
            out.append(x if isinstance(x, bool) else None)
        else:
            try:
                number = None if x is None or isinstance(x, bool) else float(x)
            except (TypeError, ValueError):
                number = None
            kind = f.dataType.typeName()
            out.append(int(number) if number is not None and kind in ("integer", "long", "short") else number)
    spots = shape.get("coordinates")
    return (*out, shape.get("type"), None if spots is None else json.dumps(spots, separators=(",", ":")))


class GeoJsonReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, size: int):
        self.path, self.schema, self.size = path, schema, size

    def partitions(self) -> list[Span]:
        store, _ = fs.FileSystem.from_uri(self.path)
        out = []
        for path, size in files_of(self.path):
            with store.open_input_file(path) as file:
                head = first_feature(file, size)
            if head is None:
                continue
            if not head[1]:
                out.append(Span(path, 0, size, True))
                continue
            out += [Span(path, at, min(at + self.size, size), False) for at in range(head[0], size, self.size)]
        return out or [Span("", 0, 0, False)]  # a plan needs one

    def read(self, partition: Span) -> Iterator[tuple]:
        if not partition.path:
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(partition.path) as file:
            if partition.whole:
                for feature in json.load(file)["features"]:
                    yield as_row(feature, self.schema)
                return
            file.seek(partition.start)
            data, at, decode = b"", partition.start, json.JSONDecoder().raw_decode
            while True:
                found = FEATURE.search(data)
                if found is None or found.start() + HEAD > len(data):
                    more = file.read(STEP)
                    if more:
                        keep = found.start() if found else max(0, len(data) - HEAD)
                        at, data = at + keep, data[keep:] + more
                        if found is None and at >= partition.end:
                            return
                        continue
                    if found is None:
                        return
                if at + found.start() >= partition.end:
                    return
                text = data[found.start() :]
                while True:
                    try:
                        feature, used = decode(text.decode("utf-8", "ignore"))
                        break
                    except ValueError:
                        more = file.read(max(STEP, len(text)))
                        if not more:
                            raise ValueError(f"a feature of {partition.path} at byte {at + found.start()} does not end") from None
                        text += more
                yield as_row(feature, self.schema)
                used = len(text.decode("utf-8", "ignore")[:used].encode())
                at, data = at + found.start() + used, text[used:]


class GeoJsonFeatures(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geojson_features"

    def schema(self) -> StructType:
        store, _ = fs.FileSystem.from_uri(self.options["path"])
        for path, size in files_of(self.options["path"]):
            with store.open_input_file(path) as file:
                head = first_feature(file, size)
            if head is not None:
                return schema_of(head[2])
        return schema_of({})

    def reader(self, schema: StructType) -> GeoJsonReader:
        return GeoJsonReader(self.options["path"], schema, int(self.options.get("rangeBytes", RANGE)))


def read_features(spark: SparkSession, path: str, properties: str | None = None, range_bytes: int = RANGE) -> DataFrame:
    """A row per feature of the collections in ``path`` (a file or a folder, in a store that
    Arrow opens): its properties, geometry_type and coordinates as JSON (A4). Columns are
    the first feature's properties, or ``properties`` (DDL)."""
    spark.dataSource.register(GeoJsonFeatures)
    reader = spark.read.format("geojson_features").option("rangeBytes", str(range_bytes))
    if properties is not None:
        reader = reader.schema(f"{properties}, geometry_type string, coordinates string")
    return reader.load(path)


def write_features(df: DataFrame, path: str, code: str = "code") -> None:
    """Rows (``lat`` and ``lon`` as a point, the rest as properties) as collections sorted
    by code (A10): every file of the folder is one, with the centre and the count of all
    rows in its head."""
    df = df.withColumns({c: F.col(c).cast("double") for c in ("lat", "lon")})
    props = F.struct(*[c for c in df.columns if c not in ("lat", "lon")])
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), point.alias("geometry")), {"ignoreNullFields": "false"})
    whole = df.agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("n")).first()
    head = json.dumps({"center": [whole["lon"], whole["lat"]], "count": whole["n"]})

    def collection(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some = False
        for b in batches:
            for at in range(0, len(b), 1024):
                lines = b["value"].iloc[at : at + 1024]
                opening = "," if some else '{"type":"FeatureCollection","metadata":' + head + ',"features":['
                yield pd.DataFrame({"value": [opening, ",\n".join(lines)]})
                some = True
        if some:
            yield pd.DataFrame({"value": ["]}"]})

    sorted_ = df.withColumn("__value", feature).orderBy(code).select(F.col("__value").alias("value"))
    sorted_.mapInPandas(collection, "value string").write.mode("overwrite").text(path)

"""LAS point files as a splittable Spark data source.

A path is a file or a folder.  Headers make the partitions: stretches of records,
up to ``READ_BYTES`` of them to a partition, each one read of its byte range.
Comparisons of x, y and z with a value are pushed down: a file whose header
bounds they exclude is not read, and the reader keeps the points that pass.
LAS 1.2 to 1.4, point formats 0 to 10; compressed (LAZ) files are an error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from tellurian.sources.geotiff import open_path, register

#: Bytes of records to a partition, and records decoded at a time.
READ_BYTES = 64 << 20
CHUNK = 1 << 18
SCHEMA = "path string, x double, y double, z double, classification int"

_KEPT = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}


class LasError(ValueError):
    """A file that is not, or not a whole, LAS file that can be read."""


@dataclass(frozen=True)
class Header:
    path: str
    offset: int
    kind: int
    size: int
    count: int
    scale: tuple[float, float, float]
    shift: tuple[float, float, float]
    low: tuple[float, float, float]
    high: tuple[float, float, float]

    def may_hold(self, f: Filter) -> bool:
        """Whether a point inside the bounds can pass the filter; bounds are rounded to the scale, so that one step is allowed."""
        k = "xyz".index(f.attribute[0])
        lo, hi = self.low[k] - abs(self.scale[k]), self.high[k] + abs(self.scale[k])
        if type(f) is EqualTo:
            return lo <= f.value <= hi
        return hi >= f.value if type(f) in (GreaterThan, GreaterThanOrEqual) else lo <= f.value


def header(path: str) -> Header:
    fs, name = open_path(path)
    with fs.open_input_file(name) as file:
        head, size = file.read(375), file.size()
    if head[:4] != b"LASF" or len(head) < 227:
        raise LasError(f"{path} is not a LAS file")
    if head[104] & 128:
        raise LasError(f"{path} is compressed; unpack LAZ files first")
    offset, kind = struct.unpack_from("<I", head, 96)[0], head[104] & 63
    record, count = struct.unpack_from("<HI", head, 105)
    if head[25] >= 4 and len(head) >= 255 and count == 0:
        count = struct.unpack_from("<Q", head, 247)[0]
    if record < 20 or offset + count * record > size:
        raise LasError(f"{path} ends before its points do")
    scale, shift = struct.unpack_from("<3d", head, 131), struct.unpack_from("<3d", head, 155)
    bounds = struct.unpack_from("<6d", head, 179)
    return Header(path, offset, kind, record, count, scale, shift, bounds[1::2], bounds[::2])


def files_of(path: str) -> list[str]:
    fs, name = open_path(path)
    info = fs.get_file_info(name)
    if info.type == pafs.FileType.NotFound:
        raise LasError(f"There is no file {path}")
    if info.type == pafs.FileType.File:
        return [path]
    found = sorted(i.base_name for i in fs.get_file_info(pafs.FileSelector(name)) if i.is_file and i.base_name.lower().endswith((".las", ".laz")))
    return [f"{path.rstrip('/')}/{n}" for n in found]


class LasReader(DataSourceReader):
    """See the module."""

    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.bytes = options["path"], int(options.get("partition_bytes", READ_BYTES))
        self.names = [f.name for f in schema.fields]
        self.kept: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _KEPT and f.attribute in (("x",), ("y",), ("z",)) and f.value is not None:
                self.kept.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in files_of(self.path):
            h = header(path)
            if h.count and all(map(h.may_hold, self.kept)):
                step = max(1, self.bytes // h.size)
                out += [InputPartition((h, at, min(step, h.count - at))) for at in range(0, h.count, step)]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing to read
            return
        h, first, count = partition.value
        fs, name = open_path(h.path)
        class_at, class_bits = (16, 255) if h.kind >= 6 else (15, 31)
        with fs.open_input_file(name) as file:
            file.seek(h.offset + first * h.size)
            for at in range(0, count, CHUNK):
                n = min(CHUNK, count - at)
                data = file.read(n * h.size)
                if len(data) < n * h.size:
                    raise LasError(f"{h.path} ends before its points do")
                rows = np.frombuffer(data, np.uint8).reshape(n, h.size)
                whole = np.ascontiguousarray(rows[:, :12]).view("<i4")
                columns = {k: whole[:, i] * h.scale[i] + h.shift[i] for i, k in enumerate("xyz")}
                keep = np.logical_and.reduce([np.ones(n, bool), *[_KEPT[type(f)](columns[f.attribute[0]], f.value) for f in self.kept]])
                columns = {k: pa.array(v[keep]) for k, v in columns.items()}
                columns |= {"classification": pa.array((rows[keep, class_at] & class_bits).astype(np.int32)), "path": pa.array([h.path] * int(keep.sum()), pa.string())}
                yield pa.RecordBatch.from_arrays([columns[k] for k in self.names], self.names)


class LasSource(DataSource):
    """``spark.read.format("las")``; option ``partition_bytes`` sets the bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> LasReader:
        return LasReader(dict(self.options), schema)


def read_las(spark: SparkSession, path: str, partition_bytes: int = READ_BYTES) -> DataFrame:
    """Points (path, x, y, z, classification) of a LAS file or a folder of them."""
    register(spark, LasSource)
    return spark.read.format("las").option("partition_bytes", partition_bytes).load(path)

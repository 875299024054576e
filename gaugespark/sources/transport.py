"""SAS transport files (version 5) as a Spark data source: one file over many tasks, filters pushed into them.

    spark.dataSource.register(TransportSource)
    spark.read.format("transport").option("path", path).option("rows", 100000).load()

A partition is a range of rows, which stand at fixed places, so a task reads its
own bytes only. Numbers are base-16 floats and are decoded here, a column of a
range at a time. Filters are pushed where the session sets
spark.sql.python.filterPushdown.enabled. Paths may be any that pyarrow.fs opens.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

_RECORD, _NAME_BYTES = 80, 140
#: First bytes of missing numbers whose others are zero: ".", "_" and letters.
_MISSING = np.zeros(256, bool)
_MISSING[[0x2E, 0x5F, *range(0x41, 0x5B)]] = True
_COMPARED = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}


class Field(NamedTuple):
    name: str
    is_text: bool
    first: int
    length: int


class Layout(NamedTuple):
    """Where rows begin in a file, how long one is, how many there are, and what they hold."""

    begins: int
    width: int
    rows: int
    fields: tuple[Field, ...]


def _opened(path: str):
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    return store.open_input_file(inner)


def layout_of(path: str) -> Layout:
    """The layout told by a file's header records."""
    with _opened(path) as file:
        size, at = file.size(), 0

        def record(length: int = _RECORD) -> bytes:
            nonlocal at
            file.seek(at)
            at += length
            return file.read(length)

        while at < size and not record().startswith(b"HEADER RECORD*******NAMESTR"):
            pass
        if at >= size:
            raise ValueError(f"{path} has no header of names")
        file.seek(at - _RECORD)
        many = int(file.read(_RECORD)[54:58])
        names = record(-(-many * _NAME_BYTES // _RECORD) * _RECORD)
        fields = []
        for k in range(many):
            told = names[k * _NAME_BYTES : (k + 1) * _NAME_BYTES]
            number = lambda a, b, told=told: int.from_bytes(told[a:b], "big")
            fields.append(Field(told[8:16].decode("latin-1").strip().upper(), number(0, 2) == 2, number(84, 88), number(4, 6)))
        record()  # the header of the rows
        width = sum(f.length for f in fields)
        rows = (size - at) // width
        # the last record is filled with blanks, which are no rows
        tail = min(rows, _RECORD // width + 1)
        file.seek(at + (rows - tail) * width)
        last = file.read(tail * width)
        while tail and not last[(tail - 1) * width : tail * width].strip(b" "):
            tail, rows = tail - 1, rows - 1
        return Layout(at, width, rows, tuple(fields))


def numbers(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of base-16 floats (a row of 2 to 8 bytes each), and which of them are missing."""
    wide = np.zeros((len(cells), 8), np.uint8)
    wide[:, : cells.shape[1]] = cells
    bits = wide.view(">u8").ravel().astype(np.uint64)
    fraction = (bits & np.uint64((1 << 56) - 1)).astype(np.float64)
    power = 4 * ((bits >> np.uint64(56)).astype(np.int64) & 127) - 4 * 64 - 56
    value = np.ldexp(fraction, power) * np.where(bits >> np.uint64(63), -1.0, 1.0)
    return value + 0.0, _MISSING[wide[:, 0]] & (fraction == 0)


class _Rows(InputPartition):
    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


class TransportReader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows, self.layout, self.pushed = path, rows, layout_of(path), []

    def partitions(self) -> list[InputPartition]:
        return [_Rows(k, min(k + self.rows, self.layout.rows)) for k in range(0, self.layout.rows, self.rows)] or [_Rows(0, 0)]

    def _kept(self, columns: dict[str, pa.Array], n: int) -> np.ndarray:
        keep = np.ones(n, bool)
        for one in self.pushed:
            column = columns[one.attribute[0]]
            known = column.is_valid().to_numpy(zero_copy_only=False)
            if isinstance(one, IsNull):
                keep &= ~known
                continue
            keep &= known
            if isinstance(one, IsNotNull):
                continue
            values = np.array(column.to_pylist(), object) if pa.types.is_string(column.type) else column.fill_null(0.0).to_numpy()
            keep &= np.isin(values, list(one.value)) if isinstance(one, In) else _COMPARED[type(one)](values, one.value).astype(bool)
        return keep

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        width, step = self.layout.width, 1 << 16
        with _opened(self.path) as file:
            for first in range(partition.first, partition.end, step):
                n = min(step, partition.end - first)
                file.seek(self.layout.begins + first * width)
                table = np.frombuffer(file.read(n * width), np.uint8).reshape(n, width)
                columns = {}
                for f in self.layout.fields:
                    cells = np.ascontiguousarray(table[:, f.first : f.first + f.length])
                    if f.is_text:
                        told = [c.decode("latin-1").rstrip(" \x00") or None for c in cells.view(f"S{f.length}").ravel().tolist()] if f.length else [None] * n
                        columns[f.name] = pa.array(told, pa.string())
                    else:
                        value, missing = numbers(cells)
                        columns[f.name] = pa.array(value, mask=missing)
                keep = self._kept(columns, n)
                yield pa.RecordBatch.from_pydict({name: c.filter(pa.array(keep)) for name, c in columns.items()})


class PushingReader(TransportReader):
    """The reader of sessions that push filters."""

    def pushFilters(self, filters: list) -> Iterator:
        """Comparisons of one column with a value are made here, all others by Spark."""
        known = {f.name: f for f in self.layout.fields}
        for one in filters:
            field = known.get(one.attribute[0]) if len(getattr(one, "attribute", ())) == 1 else None
            if field and (isinstance(one, (IsNull, IsNotNull, EqualTo, In)) or (type(one) in _COMPARED and not field.is_text)):
                self.pushed.append(one)
            else:
                yield one


class TransportSource(DataSource):
    """Options: path, rows (of a partition, 250000 if not told), and push (true where the session pushes filters)."""

    @classmethod
    def name(cls) -> str:
        return "transport"

    def schema(self) -> StructType:
        return StructType([StructField(f.name, StringType() if f.is_text else DoubleType()) for f in layout_of(self.options["path"]).fields])

    def reader(self, schema: StructType) -> TransportReader:
        kind = PushingReader if self.options.get("push", "false") == "true" else TransportReader
        return kind(self.options["path"], int(self.options.get("rows", 250_000)))


def transport(spark: SparkSession, path: str, rows: int = 250_000) -> DataFrame:
    """The rows of a transport file, upper-cased columns; blank texts and missing numbers are null."""
    spark.dataSource.register(TransportSource)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("transport").option("path", path).option("rows", rows).option("push", push).load()

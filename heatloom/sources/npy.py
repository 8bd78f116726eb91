"""Rasters in .npy files as a data source: row ranges of a file are tasks of their own, and only the bytes that are asked for are read.

`read_raster`, or `spark.dataSource.register(NpySource)` with spark.sql.python.filterPushdown.enabled on, then `spark.read.format("npy").option(...)`:
path: a file, or with `slot` (minutes) the folders to look in, first match wins, separated by `;`;
value: the column's name (default h); rows: rows of a task (default 256).
In each folder the slot's own file `<prefix>_HHMM.npy` comes before that of its hour, `<prefix>_HH.npy`. A slot without a file is an
empty raster. Limits on row (and on col) that Spark pushes down skip bytes: the rest of a row is jumped over.
Files must be in a folder that the driver and all tasks can open."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Cells of a batch.
BATCH = 1 << 18


def slot_file(folders: list[str], prefix: str, slot: int) -> str | None:
    """The first file for a slot of the day: by folder, the slot's own before its hour's."""
    names = [f"{prefix}_{slot // 60:02d}{slot % 60:02d}.npy", f"{prefix}_{slot // 60:02d}.npy"]
    return next((p for d in folders for n in names if os.path.exists(p := os.path.join(d, n))), None)


@dataclass
class Layout:
    """Where the numbers of a two-dimensional file lie."""

    path: str
    offset: int
    shape: tuple[int, int]
    dtype: np.dtype


def layout_of(path: str) -> Layout:
    with open(path, "rb") as f:
        version = np.lib.format.read_magic(f)
        shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        if len(shape) != 2 or fortran or dtype.hasobject:
            raise ValueError(f"{path}: not a raster in rows of plain numbers")
        return Layout(path, f.tell(), shape, dtype)


@dataclass
class Rows(InputPartition):
    layout: Layout
    first: int
    stop: int
    left: int
    right: int


@dataclass
class NpyReader(DataSourceReader):
    """Cells (row, col, value) of one raster."""

    options: dict
    limits: dict = field(default_factory=lambda: {"row": [0, 1 << 31], "col": [0, 1 << 31]})

    def path(self) -> str | None:
        slot = self.options.get("slot")
        return self.options["path"] if slot is None else slot_file(self.options["path"].split(";"), self.options.get("prefix", "shade"), int(slot))

    def pushFilters(self, filters: list) -> Iterator:
        """Limits on row and col stay here, all others go back."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name not in self.limits or not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In)):
                yield f
                continue
            own = self.limits[name]
            if isinstance(f, In):
                own[0], own[1] = max(own[0], min(f.value)), min(own[1], max(f.value) + 1)
                yield f  # the limits bound it only
            elif isinstance(f, EqualTo):
                own[0], own[1] = max(own[0], f.value), min(own[1], f.value + 1)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                own[0] = max(own[0], f.value + isinstance(f, GreaterThan))
            else:
                own[1] = min(own[1], f.value + isinstance(f, LessThanOrEqual))

    def partitions(self) -> list[InputPartition]:
        path = self.path()
        if path is None:
            return []
        layout, step = layout_of(path), int(self.options.get("rows", 256))
        (first, stop), (left, right) = self.limits["row"], self.limits["col"]
        stop, right = min(stop, layout.shape[0]), min(right, layout.shape[1])
        return [Rows(layout, a, min(a + step, stop), left, right) for a in range(first, stop, step)] if left < right else []

    def read(self, partition: Rows | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file, or nothing inside the limits
            return
        p, size = partition, partition.layout.dtype.itemsize
        width = p.right - p.left
        at_once = max(1, BATCH // width)
        with open(p.layout.path, "rb") as f:
            for a in range(p.first, p.stop, at_once):
                rows, stop = [], min(a + at_once, p.stop)
                for r in range(a, stop):
                    f.seek(p.layout.offset + (r * p.layout.shape[1] + p.left) * size)
                    rows.append(np.frombuffer(f.read(width * size), p.layout.dtype))
                row, col = np.repeat(np.arange(a, stop, dtype=np.int32), width), np.tile(np.arange(p.left, p.right, dtype=np.int32), stop - a)
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(col), pa.array(np.concatenate(rows).astype(float))], ["row", "col", self.options.get("value", "h")])


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return f"row int, col int, `{self.options.get('value', 'h')}` double"

    def reader(self, schema) -> DataSourceReader:
        return NpyReader(dict(self.options))


def read_raster(spark: SparkSession, path: str, value: str = "h", rows: int = 256, slot: int | None = None, prefix: str = "shade") -> DataFrame:
    """row, col, value of a .npy raster; with a slot, of its file in the first of the folders (path, separated by `;`) that has one."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # off by default; only sources in Python ask for it
    spark.dataSource.register(NpySource)
    reader = spark.read.format("npy").option("path", path).option("value", value).option("rows", rows).option("prefix", prefix)
    return (reader if slot is None else reader.option("slot", slot)).load()

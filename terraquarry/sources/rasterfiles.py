"""Raster files as a data source: windows of GeoTIFF files are read, and rasters are written, by the tasks.

``read_windows`` makes one partition of each window of each file. Filters on anything but the
values (band, path, place, bounds) are decided on the files' directories, so that no other
window is opened; a task seeks to the blocks that its window touches and reads no more.
``write_rasters`` lets every task write into a folder of its own below the target; files are
moved into place when all tasks have ended well, and are gone if one has not. Paths are those
of a file system that the driver and all executors have mounted.
"""

from __future__ import annotations

import contextlib
import operator
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from terraquarry.sources import geotiff

FORMAT = "terraquarry_raster"
#: A window: its file and band (the file's name without its ending), place, size, bounds in the file's coordinates (null without an affine), georeferencing, bytes that were read for it, values by row.
WINDOW = (
    "path string, folder string, band string, row_off int, col_off int, height int, width int, west double, south double, east double, north double, "
    "dtype string, crs string, affine array<double>, nodata double, n_read long, data array<float>"
)
_FIELDS = [f.split()[0] for f in WINDOW.split(", ")]
_COMPARE = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


def local_path(path: str) -> str:
    """A path without the scheme of local files; any other scheme is an error."""
    scheme, mark, rest = path.partition(":")
    if not mark or "/" in scheme:
        return path
    if scheme != "file":
        raise ValueError(f"{path}: windows are read from mounted file systems only")
    return "/" + rest.lstrip("/")


def _files(path: str, ending: str = ".tif") -> Iterator[str]:
    if os.path.isfile(path):
        yield path
    for folder, inner, names in os.walk(path):
        inner.sort()
        yield from (os.path.join(folder, n) for n in sorted(names) if n.endswith(ending) and not n.startswith(("_", ".")))


@dataclass
class WindowPartition(InputPartition):
    """One window of one file: the columns of WINDOW but the last two."""

    row: dict

    def __init__(self, row: dict):
        self.row = row


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.side = local_path(options["path"]), int(options.get("window", 256))
        if self.side < 1:
            raise ValueError("window must be positive")
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 (a name of the interface)
        for f in filters:
            known = isinstance(f, (*_COMPARE, In, IsNotNull)) and len(f.attribute) == 1 and f.attribute[0] in _FIELDS[:-2] and f.attribute[0] != "affine"
            if known:
                self.filters.append(f)
            else:
                yield f

    def _wanted(self, row: dict) -> bool:
        for f in self.filters:
            value = row[f.attribute[0]]
            if value is None:
                return False
            if isinstance(f, In):
                if value not in f.value:
                    return False
            elif not isinstance(f, IsNotNull) and not _COMPARE[type(f)](value, f.value):
                return False
        return True

    def partitions(self) -> list[WindowPartition]:
        out = []
        for path in _files(self.path):
            folder, _, name = path.rpartition("/")
            with open(path, "rb") as file:
                head = geotiff.header(geotiff.Seeking(file))
            a = head["affine"]
            for row in range(0, head["height"], self.side):
                for column in range(0, head["width"], self.side):
                    high, wide = min(self.side, head["height"] - row), min(self.side, head["width"] - column)
                    moved = a and [a[0], a[1], a[2] + a[0] * column, a[3], a[4], a[5] + a[4] * row]
                    bounds = (moved[2], moved[5] + high * a[4], moved[2] + wide * a[0], moved[5]) if a else (None,) * 4
                    values = ("file:" + path, "file:" + folder, name.rpartition(".")[0], row, column, high, wide, *bounds, head["dtype"], head["crs"], moved, head["nodata"])
                    found = dict(zip(_FIELDS, values, strict=False))
                    if self._wanted(found):
                        out.append(WindowPartition(found))
        return out or [WindowPartition({})]

    def read(self, partition: WindowPartition) -> Iterator[pa.RecordBatch]:
        if not partition.row:
            return
        row = partition.row
        values, n_read = _read(local_path(row["path"]), row["row_off"], row["col_off"], row["height"], row["width"])
        own = row | {"n_read": n_read, "data": values.astype(np.float32).ravel()}
        types = {"int": pa.int32(), "double": pa.float64(), "string": pa.string(), "long": pa.int64(), "array<double>": pa.list_(pa.float64()), "array<float>": pa.list_(pa.float32())}
        yield pa.RecordBatch.from_arrays([pa.array([own[n]], types[f.split()[1]]) for n, f in zip(_FIELDS, WINDOW.split(", "), strict=True)], names=_FIELDS)


def _read(path: str, row: int, column: int, height: int, width: int) -> tuple[np.ndarray, int]:
    with open(path, "rb") as file:
        data = geotiff.Seeking(file)
        return geotiff.window(data, geotiff.header(data), row, column, height, width), data.n_read


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]
    folder: str


class _Writer(DataSourceArrowWriter):
    """Rows of ``name`` and either ``content`` or a raster (height, width, dtype, data, and crs, affine, nodata, gcps where there are such columns)."""

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.path, self.block, self.overwrite = local_path(options["path"]), int(options["block"]) if options.get("block") else None, overwrite
        self.columns = schema.names
        self.pending = os.path.join(self.path, f"_pending-{uuid.uuid4().hex}")
        if "name" not in self.columns or not ("content" in self.columns or {"height", "width", "dtype", "data"} <= set(self.columns)):
            raise ValueError("rasters need name, and content or height, width, dtype and data")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        context = TaskContext.get()
        folder = os.path.join(self.pending, f"{context.partitionId()}-{context.taskAttemptId()}")
        os.makedirs(folder, exist_ok=True)
        names = []
        for batch in iterator:
            for at in range(batch.num_rows):
                row = {n: batch.column(i)[at] for i, n in enumerate(self.columns)}
                name = row["name"].as_py()
                if not name or os.path.isabs(name) or ".." in name.split("/"):
                    raise ValueError(f"{name!r} is no name of a file below the target")
                target = os.path.join(folder, name)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(target, "xb") as file:
                    file.write(self._content(row))
                names.append(name)
        return _Written(names, folder)

    def _content(self, row: dict[str, pa.Scalar]) -> bytes:
        if "content" in row:
            return row["content"].as_py()
        plain = lambda n: row[n].as_py() if n in row else None
        values = row["data"].values.to_numpy(zero_copy_only=False).astype(plain("dtype")).reshape(plain("height"), plain("width"))
        points = [tuple(p.values()) for p in plain("gcps") or ()]
        return geotiff.encode(values, plain("affine"), plain("crs") if plain("affine") or not points else None, plain("nodata"), points, self.block)

    def commit(self, messages: list[_Written | None]) -> None:
        try:
            names = [n for m in messages if m for n in m.names]
            if len(set(names)) < len(names):
                raise ValueError("two rasters have one name")
            there = [n for n in names if os.path.exists(os.path.join(self.path, n))]
            if there and not self.overwrite:
                raise FileExistsError(f"{there[0]} is there already")
            for m in messages:
                for n in m.names if m else ():
                    target = os.path.join(self.path, n)
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    os.replace(os.path.join(m.folder, n), target)
        finally:
            shutil.rmtree(self.pending, ignore_errors=True)

    def abort(self, messages: list[_Written | None]) -> None:
        shutil.rmtree(self.pending, ignore_errors=True)
        with contextlib.suppress(OSError):
            os.rmdir(self.path)  # only where nothing else is in it


class RasterFiles(DataSource):
    """``spark.read.format("terraquarry_raster")`` and ``df.write.format("terraquarry_raster")``; option ``window``: the side of windows, ``block``: that of written blocks."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return WINDOW

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options, schema, overwrite)


def read_windows(spark: SparkSession, path: str, window: int = 256) -> DataFrame:
    """The windows (WINDOW) of the GeoTIFF files under a path: filter them by band, place or bounds before using ``data``."""
    spark.dataSource.register(RasterFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(FORMAT).option("window", window).load(path)


def write_rasters(rows: DataFrame, path: str, block: int | None = 256, overwrite: bool = False) -> None:
    """Write rasters (see ``_Writer``) as files below a path: all of them, or none where a task fails or (without ``overwrite``) a name is taken."""
    rows.sparkSession.dataSource.register(RasterFiles)
    writer = rows.write.format(FORMAT).mode("overwrite" if overwrite else "append").option("path", path)
    (writer.option("block", block) if block else writer).save()


def at_windows(rows: DataFrame) -> DataFrame:
    """Adds ``data`` (array<float>, by row) to rows of path, w_row_off, w_col_off, w_height, w_width: each reads its own window of its file."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                found = [_read(local_path(p), *place)[0].astype(np.float32).ravel() for p, *place in zip(*(part.column(names.index(c)).to_pylist() for c in ("path", "w_row_off", "w_col_off", "w_height", "w_width")), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(pa.float32()))], names=[*names, "data"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, data array<float>")

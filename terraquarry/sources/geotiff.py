"""Single-band GeoTIFF files as rows: a codec for plain and deflated strips or tiles, in NumPy.

Classic TIFF with one sample of 8, 16 or 32 bits (whole or floating numbers). Georeferencing is
read from pixel scale and tie points, the coordinate system as an EPSG code. Anything else is a
ValueError, which tells the file's path.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: sizes of field types, and sample formats by kind of number.
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
_KINDS = {1: "u", 2: "i", 3: "f"}
_PLAIN, _DEFLATE, _OLD_DEFLATE = 1, 8, 32946


def _fields(data: bytes) -> tuple[str, dict[int, tuple | bytes]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack(order + "I", data[4:8])
    (count,) = struct.unpack(order + "H", data[at : at + 2])
    out: dict[int, tuple | bytes] = {}
    for i in range(count):
        entry = data[at + 2 + 12 * i : at + 14 + 12 * i]
        tag, kind, n = struct.unpack(order + "HHI", entry[:8])
        size = _SIZES.get(kind, 1) * n
        raw = entry[8 : 8 + size] if size <= 4 else data[(p := struct.unpack(order + "I", entry[8:])[0]) : p + size]
        out[tag] = bytes(raw) if kind not in _CODES else struct.unpack(f"{order}{n}{_CODES[kind]}", raw)
    return order, out


class Seeking:
    """A file that is sliced like bytes: each slice is one seek and read, and ``n_read`` counts what was read."""

    def __init__(self, file):
        self.file, self.n_read = file, 0

    def __getitem__(self, part: slice) -> bytes:
        self.file.seek(part.start or 0)
        out = self.file.read(part.stop - (part.start or 0))
        self.n_read += len(out)
        return out


def header(data) -> dict:
    """What a file's directory says: height, width, dtype, crs, affine, nodata, gcps (pixel column and row, lon, lat, elevation), and how its blocks lie.

    ``data`` is bytes or ``Seeking``: only the directory is read.
    """
    order, f = _fields(data)
    width, height = f[256][0], f[257][0]
    if f.get(277, (1,))[0] != 1:
        raise ValueError("more than one band")
    kind = np.dtype(f"{order}{_KINDS[f.get(339, (1,))[0]]}{f.get(258, (1,))[0] // 8}")
    packing, predictor = f.get(259, (1,))[0], f.get(317, (1,))[0]
    if packing not in (_PLAIN, _DEFLATE, _OLD_DEFLATE) or predictor not in (1, 2) or (predictor == 2 and kind.kind == "f"):
        raise ValueError(f"compression {packing} with predictor {predictor} is not supported")
    tiled = 322 in f
    affine, gcps = None, []
    if 33550 in f and 33922 in f:
        (sx, sy, *_), (i, j, _, x, y, _) = f[33550], f[33922][:6]
        affine = [sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy]
    elif 33922 in f:
        gcps = [(p[0], p[1], p[3], p[4], p[5]) for p in zip(*[iter(f[33922])] * 6, strict=True)]
    keys = {k[0]: k[3] for k in zip(*[iter(f.get(34735, ()))] * 4, strict=True)}
    code = keys.get(3072) or keys.get(2048)
    nodata = f.get(42113)
    return {
        "height": height, "width": width, "dtype": str(kind.newbyteorder("=")), "crs": f"EPSG:{code}" if code else None, "affine": affine, "gcps": gcps,
        "nodata": float(nodata.split(b"\0")[0]) if nodata else None,
        "blocks": {
            "kind": kind.str, "packed": packing != _PLAIN, "summed": predictor == 2, "wide": f[322][0] if tiled else width, "high": f[323][0] if tiled else min(height, f.get(278, (height,))[0]),
            "places": list(zip(*((f[324], f[325]) if tiled else (f[273], f[279])), strict=True)),
        },
    }


def window(data, head: dict, row: int, column: int, height: int, width: int) -> np.ndarray:
    """Some rows and columns of a file's values: only the blocks that they touch are read and unpacked. What lies outside the raster is 0."""
    b = head["blocks"]
    kind, wide, high = np.dtype(b["kind"]), b["wide"], b["high"]
    across = -(-head["width"] // wide)
    out = np.zeros((height, width), kind.newbyteorder("="))
    bottom, right = min(row + height, head["height"]), min(column + width, head["width"])
    for y in range(max(row, 0) // high, -(-bottom // high)):
        for x in range(max(column, 0) // wide, -(-right // wide)):
            start, size = b["places"][y * across + x]
            raw = data[start : start + size]
            block = np.frombuffer(zlib.decompress(raw) if b["packed"] else raw, kind).reshape(-1, wide).astype(out.dtype)
            if b["summed"]:
                block = np.cumsum(block, axis=1, dtype=out.dtype)
            top, left = max(y * high, row), max(x * wide, column)
            low, far = min(y * high + len(block), bottom), min((x + 1) * wide, right)
            out[top - row : low - row, left - column : far - column] = block[top - y * high : low - y * high, left - x * wide : far - x * wide]
    return out


def decode(data: bytes) -> dict:
    """``header`` of a file that is held whole, and its values as a matrix: ``data``."""
    head = header(data)
    values = window(data, head, 0, 0, head["height"], head["width"])
    return {k: v for k, v in head.items() if k != "blocks"} | {"data": values}


def encode(values: np.ndarray, affine: list[float] | None = None, crs: str | None = None, nodata: float | None = None, gcps: list[tuple] = (), block: int | None = None) -> bytes:
    """A deflated file: one strip, or with ``block`` (a multiple of 16) square blocks. ``affine`` without rotation; ``gcps`` as ``header`` gives them, in degrees."""
    values = np.ascontiguousarray(values, values.dtype.newbyteorder("<"))
    if values.ndim != 2 or values.dtype.kind not in "uif" or values.dtype.itemsize > 4:
        raise ValueError(f"can't write {values.dtype} of {values.ndim} dimensions")
    height, width = values.shape
    if block is None:
        bodies = [zlib.compress(values.tobytes())]
    else:
        if block < 16 or block % 16:
            raise ValueError("block must be a multiple of 16")
        filled = np.pad(values, ((0, -height % block), (0, -width % block)))
        bodies = [zlib.compress(filled[y : y + block, x : x + block].tobytes()) for y in range(0, height, block) for x in range(0, width, block)]
    starts, body = [], b""
    for one in bodies:
        starts.append(8 + len(body))
        body += one + b"\0" * (len(one) % 2)
    sizes = tuple(len(one) for one in bodies)
    laid = [(273, 4, tuple(starts)), (278, 4, (height,)), (279, 4, sizes)] if block is None else [(322, 4, (block,)), (323, 4, (block,)), (324, 4, tuple(starts)), (325, 4, sizes)]
    kind = {v: k for k, v in _KINDS.items()}[values.dtype.kind]
    fields: list[tuple[int, int, tuple | bytes]] = [
        (256, 4, (width,)), (257, 4, (height,)), (258, 3, (8 * values.dtype.itemsize,)), (259, 3, (_DEFLATE,)), (262, 3, (1,)),
        (277, 3, (1,)), *laid, (339, 3, (kind,)),
    ]
    if affine is not None:
        if affine[1] or affine[3]:
            raise ValueError("a rotated affine can't be written")
        fields += [(33550, 12, (affine[0], -affine[4], 0.0)), (33922, 12, (0.0, 0.0, 0.0, affine[2], affine[5], 0.0))]
    elif gcps:
        fields.append((33922, 12, tuple(float(x) for c, r, lon, lat, z in gcps for x in (c, r, 0.0, lon, lat, z))))
    code = int(crs.partition(":")[2]) if crs else 4326 if gcps else None
    if code:
        geographic = code == 4326
        fields.append((34735, 3, (1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, code)))
    if nodata is not None:
        fields.append((42113, 2, f"{nodata:g}".encode() + b"\0"))
    start = 8 + len(body)
    extra_at = start + 2 + 12 * len(fields) + 4
    table, extra = struct.pack("<H", len(fields)), b""
    for tag, kind, value in sorted(fields, key=lambda x: x[0]):
        raw = value if kind == 2 else struct.pack(f"<{len(value)}{_CODES[kind]}", *value)
        count = len(raw) // _SIZES[kind]
        place = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", extra_at + len(extra))
        table += struct.pack("<HHI", tag, kind, count) + place
        extra += (raw + b"\0" * (len(raw) % 2)) if len(raw) > 4 else b""
    return struct.pack("<2sHI", b"II", 42, start) + body + table + struct.pack("<I", 0) + extra


RASTER = "path string, folder string, filename string, n_bytes long, sha256 string, height int, width int, dtype string, crs string, affine array<double>, nodata double, data array<float>"


def rasters(spark: SparkSession, path: str, pattern: str = "*.tif", values: bool = True) -> DataFrame:
    """A row per file under a path at any depth: RASTER; without ``values``, data is null. Files are read and decoded by the tasks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    hashed = files.select("path", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    found = decode(row["content"])
                except (ValueError, KeyError, zlib.error, struct.error) as error:
                    raise ValueError(f"{row['path']}: {error}") from error
                folder, _, name = row["path"].rpartition("/")
                data = found["data"].astype(np.float32).ravel() if values else None
                columns = [[row["path"]], [folder], [name], [row["n_bytes"]], [row["sha256"]], [found["height"]], [found["width"]], [found["dtype"]], [found["crs"]], [found["affine"]], [found["nodata"]], [data]]
                types = [pa.string()] * 3 + [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.float64()), pa.float64(), pa.list_(pa.float32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in RASTER.split(", ")])

    return hashed.mapInArrow(run, RASTER)


def encoded(rows: DataFrame) -> DataFrame:
    """Adds ``content`` (the file's bytes), n_bytes and sha256 to rasters: height, width, dtype, data, and crs, affine, nodata or null; ``gcps`` (see ``header``) where a column has them."""
    names = rows.columns
    used = ["height", "width", "dtype", "data", "crs", "affine", "nodata", *["gcps"] * ("gcps" in names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = []
            for r in batch.select(used).to_pylist():
                values = np.array(r["data"], r["dtype"]).reshape(r["height"], r["width"])
                points = [tuple(p.values()) for p in r.get("gcps") or ()]
                contents.append(encode(values, r["affine"], r["crs"] if r["affine"] or not points else None, r["nodata"], points))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(contents, pa.binary())], names=[*names, "content"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    made = rows.mapInArrow(run, f"{schema}, content binary")
    return made.withColumns({"n_bytes": F.length("content").cast("long"), "sha256": F.sha2("content", 256)})

"""Raster files as tables: GeoTIFF strips and classic NetCDF variables.

Files are read through Spark's binary source, so any file system that Spark
knows will do, and decoded in row stripes, one Arrow batch per stripe.  Decoders
follow the public formats (TIFF 6.0 with GeoTIFF tags; NetCDF classic).  NetCDF-4
files are HDF5 and are read with h5py where that is installed.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STRIPE = 256
#: TIFF tags.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PREDICTOR, SAMPLE_FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 317, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS, NODATA_TAG = 33550, 33922, 34735, 42113
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 11: "f", 12: "d"}
KINDS = {1: "u", 2: "i", 3: "f"}


@dataclass
class Grid:
    """A decoded band with what places it on the map."""

    values: np.ndarray
    left: float
    top: float
    rez: float
    nodata: float | None
    epsg: int | None = None


def tiff_tags(raw: bytes) -> tuple[str, dict[int, tuple]]:
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack(order + "H", raw[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack(order + "I", raw[4:8])[0]
    tags = {}
    for k in range(struct.unpack(order + "H", raw[at : at + 2])[0]):
        tag, kind, n = struct.unpack(order + "HHI", raw[at + 2 + 12 * k : at + 10 + 12 * k])
        if kind not in TYPES:
            continue
        size = struct.calcsize(order + TYPES[kind]) * n
        pos = at + 10 + 12 * k
        if size > 4:
            pos = struct.unpack(order + "I", raw[pos : pos + 4])[0]
        data = raw[pos : pos + size]
        tags[tag] = (data.split(b"\0")[0],) if kind == 2 else struct.unpack(order + TYPES[kind] * n, data)
    return order, tags


def decode_tiff(raw: bytes) -> Grid:
    """The first band of a stripped TIFF, uncompressed or deflated."""
    order, t = tiff_tags(raw)
    if STRIP_OFFSETS not in t:
        raise ValueError("tiled TIFF files are not read")
    w, h, bits, n = t[WIDTH][0], t[HEIGHT][0], t[BITS][0], t.get(SAMPLES, (1,))[0]
    kind, how = t.get(SAMPLE_FORMAT, (1,))[0], t.get(COMPRESSION, (1,))[0]
    if how not in (1, 8, 32946) or t.get(PREDICTOR, (1,))[0] != 1:
        raise ValueError(f"TIFF compression {how} is not read")
    dtype = np.dtype(f"{order}{KINDS[kind]}{bits // 8}")
    parts = [raw[a : a + b] for a, b in zip(t[STRIP_OFFSETS], t[STRIP_BYTES])]
    data = b"".join(parts if how == 1 else map(zlib.decompress, parts))
    values = np.frombuffer(data, dtype, count=w * h * n).reshape(h, w, n)[:, :, 0]
    scale, tie = t.get(PIXEL_SCALE, (1.0, 1.0, 0.0)), t.get(TIE_POINT, (0.0,) * 6)
    text = t.get(NODATA_TAG, (b"",))[0].strip()
    keys = t.get(GEO_KEYS, ())
    epsg = next((keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i] == 3072), None)
    return Grid(values, tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0], float(text) if text else None, epsg)


def encode_tiff(bands: np.ndarray, left: float, top: float, rez: float, nodata: float, compress: bool = True) -> bytes:
    """A striped multi-band TIFF from an array (band, row, column)."""
    n, h, w = bands.shape
    data = np.ascontiguousarray(np.moveaxis(bands, 0, 2)).astype(bands.dtype.newbyteorder("<"))
    strips = [data[r : r + STRIPE].tobytes() for r in range(0, h, STRIPE)]
    strips = [zlib.compress(s) for s in strips] if compress else strips
    bits = bands.dtype.itemsize * 8
    kind = {"u": 1, "b": 1, "i": 2, "f": 3}[bands.dtype.kind]
    offsets, at = [], 8
    for s in strips:
        offsets.append(at)
        at += len(s)
    text = f"{nodata:g}".encode() + b"\0"
    tags = [
        (WIDTH, "I", [w]), (HEIGHT, "I", [h]), (BITS, "H", [bits] * n), (COMPRESSION, "H", [8 if compress else 1]), (262, "H", [1]), (STRIP_OFFSETS, "I", offsets),
        (SAMPLES, "H", [n]), (ROWS_PER_STRIP, "I", [STRIPE]), (STRIP_BYTES, "I", [len(s) for s in strips]), (SAMPLE_FORMAT, "H", [kind] * n),
        (PIXEL_SCALE, "d", [rez, rez, 0.0]), (TIE_POINT, "d", [0.0, 0.0, 0.0, left, top, 0.0]), (NODATA_TAG, "c", [text]),
    ]
    codes = {v: k for k, v in TYPES.items()}
    at += at % 2
    tail, entries = b"", b""
    end = at + 2 + 12 * len(tags) + 4
    for tag, c, values in tags:
        packed = values[0] if c == "c" else struct.pack("<" + c * len(values), *values)
        count = len(packed) if c == "c" else len(values)
        if len(packed) > 4:
            place = struct.pack("<I", end + len(tail))
            tail += packed + b"\0" * (len(packed) % 2)
        else:
            place = packed.ljust(4, b"\0")
        entries += struct.pack("<HHI", tag, codes[c], count) + place
    body = b"".join(strips)
    head = b"II*\0" + struct.pack("<I", at)
    return head + body + b"\0" * (at - 8 - len(body)) + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0" + tail


def decode_netcdf(raw: bytes, variable: str) -> Grid:
    """A two-dimensional variable of a NetCDF file with coordinate variables ``x`` and ``y``."""
    if raw[:4] == b"\x89HDF":
        found = _from_hdf(raw, variable)
    elif raw[:3] == b"CDF":
        found = _from_classic(raw, (variable, "x", "y"))
    else:
        raise ValueError("not a NetCDF file")
    values, x, y = (found[k] for k in (variable, "x", "y"))
    rez = abs(float(x[1] - x[0])) if len(x) > 1 else 1.0
    if len(y) > 1 and y[1] > y[0]:
        values, y = values[::-1], y[::-1]
    return Grid(values, float(x.min()) - rez / 2, float(y.max()) + rez / 2, rez, None)


def _from_hdf(raw: bytes, variable: str) -> dict[str, np.ndarray]:
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("NetCDF-4 files need h5py") from e
    with h5py.File(BytesIO(raw)) as f:
        return {k: f[k][...] for k in (variable, "x", "y")}


def _from_classic(raw: bytes, wanted: tuple[str, ...]) -> dict[str, np.ndarray]:
    at, wide = 4, raw[3] == 2
    kinds = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}

    def number() -> int:
        nonlocal at
        at += 4
        return struct.unpack(">I", raw[at - 4 : at])[0]

    def name() -> str:
        nonlocal at
        n = number()
        out = raw[at : at + n].decode()
        at += -(-n // 4) * 4
        return out

    def attributes() -> None:
        nonlocal at
        number()
        for _ in range(number()):
            name()
            kind, n = number(), number()
            at += -(-n * np.dtype(kinds[kind]).itemsize // 4) * 4

    number()  # records
    number()
    sizes = []
    for _ in range(number()):
        name()
        sizes.append(number())
    attributes()
    number()
    out = {}
    for _ in range(number()):
        v = name()
        shape = [sizes[number()] for _ in range(number())]
        attributes()
        kind, _ = number(), number()
        begin = number()
        if wide:
            begin = begin << 32 | number()
        if v in wanted:
            out[v] = np.frombuffer(raw, kinds[kind], int(np.prod(shape)), begin).reshape(shape).astype("f8")
    return out


def read_raster(spark: SparkSession, path: str, variable: str | None = None) -> DataFrame:
    """``(x, y, value)`` of cell centres; NaN and the file's no-data value become null."""

    def points(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for raw in batch.column(0):
                data = raw.as_buffer().to_pybytes()
                g = decode_tiff(data) if variable is None else decode_netcdf(data, variable)
                h, w = g.values.shape
                x = g.left + (np.arange(w) + 0.5) * g.rez
                for r in range(0, h, STRIPE):
                    v = g.values[r : r + STRIPE].astype("f8")
                    y = g.top - (np.arange(r, r + len(v)) + 0.5) * g.rez
                    gone = np.isnan(v) | (v == (np.nan if g.nodata is None else g.nodata))
                    yield pa.RecordBatch.from_arrays([pa.array(np.tile(x, len(v))), pa.array(np.repeat(y, w)), pa.array(v.ravel(), mask=gone.ravel())], names=["x", "y", "value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(points, "x double, y double, value double")


def read_header(spark: SparkSession, path: str, layer: str, variable: str | None = None) -> DataFrame:
    """The header row of a raster file."""

    def header(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for raw in batch.column(0):
                data = raw.as_buffer().to_pybytes()
                g = decode_tiff(data) if variable is None else decode_netcdf(data, variable)
                h, w = g.values.shape
                row = {"layer": layer, "left": g.left, "bottom": g.top - h * g.rez, "right": g.left + w * g.rez, "top": g.top, "rez": g.rez, "width": w, "height": h, "epsg": g.epsg, "nodata": g.nodata}
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("layer", pa.string()), *((k, pa.float64()) for k in ("left", "bottom", "right", "top", "rez")), *((k, pa.int32()) for k in ("width", "height", "epsg")), ("nodata", pa.float64())]))

    out = spark.read.format("binaryFile").load(path).select("content")
    return out.mapInArrow(header, "layer string, left double, bottom double, right double, top double, rez double, width int, height int, epsg int, nodata double").select("layer", F.lit(None).cast("date").alias("acq_date"), "left", "bottom", "right", "top", "rez", "width", "height", "epsg", "nodata")

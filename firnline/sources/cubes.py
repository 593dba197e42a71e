"""Cubes of several file formats as long tables, by a Python data source: spark.read.format("velocity_cube").

option("kind"): "netcdf3" (classic format), "zarr" (version 2, one partition for each chunk in space), "geotiff" (stripped
or tiled, uncompressed or deflated; a date pair in the name). The files lie on a path that every executor reads; a cluster
without such a mount reads them by `from_binary` through Spark's own binaryFile reader instead.
"""

from __future__ import annotations

import io
import json
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "layer_id long, xi int, yi int, x double, y double, name string, value double"
_NC = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}


class NetCdf3:
    """Variables of a file in the classic format (64-bit offsets as well)."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 4
        if data[:3] != b"CDF" or data[3] not in (1, 2):
            raise ValueError("not a classic NetCDF file")
        self.wide = data[3] == 2
        self.records = self._int()
        self.dims = self._list(10, lambda: (self._name(), self._int()))
        self.attrs = dict(self._list(12, self._attribute))
        self.vars = dict(self._list(11, self._variable))

    def _int(self) -> int:
        self.at += 4
        return struct.unpack_from(">i", self.data, self.at - 4)[0]

    def _name(self) -> str:
        n = self._int()
        out = self.data[self.at : self.at + n].decode()
        self.at += -(-n // 4) * 4
        return out

    def _list(self, tag: int, item) -> list:
        found, n = self._int(), self._int()
        return [item() for _ in range(n)] if found == tag else []

    def _attribute(self):
        name, kind, n = self._name(), self._int(), self._int()
        size = n * np.dtype(_NC[kind]).itemsize
        raw = self.data[self.at : self.at + size]
        self.at += -(-size // 4) * 4
        return name, raw.decode("utf-8", "replace") if kind == 2 else np.frombuffer(raw, _NC[kind])

    def _variable(self):
        name = self._name()
        dims = [self._int() for _ in range(self._int())]
        attrs, kind, size = dict(self._list(12, self._attribute)), self._int(), self._int()
        begin = struct.unpack_from(">q" if self.wide else ">i", self.data, self.at)[0]
        self.at += 8 if self.wide else 4
        return name, (dims, attrs, _NC[kind], size, begin)

    def read(self, name: str) -> tuple[list[str], np.ndarray]:
        dims, attrs, kind, size, begin = self.vars[name]
        lengths = [self.dims[d][1] for d in dims]
        names = [self.dims[d][0] for d in dims]
        kind = np.dtype(kind)
        if dims and lengths[0] == 0:  # the record dimension: one slab for each record, of all record variables
            inner = int(np.prod(lengths[1:], dtype=int))
            stride = sum(v[3] for v in self.vars.values() if v[0] and self.dims[v[0][0]][1] == 0)
            stride = inner * kind.itemsize if sum(1 for v in self.vars.values() if v[0] and self.dims[v[0][0]][1] == 0) == 1 else stride
            slabs = [np.frombuffer(self.data, kind, inner, begin + r * stride) for r in range(self.records)]
            out = np.stack(slabs).reshape([self.records, *lengths[1:]]) if slabs else np.empty([0, *lengths[1:]], kind)
        else:
            out = np.frombuffer(self.data, kind, int(np.prod(lengths, dtype=int)), begin).reshape(lengths)
        out = out.astype(float) if kind.kind != "S" else out
        fill = attrs.get("_FillValue")
        if fill is not None and kind.kind != "S":
            out = np.where(out == float(fill[0]), np.nan, out)
        return names, out


def write_netcdf3(dims: dict[str, int], variables: dict[str, tuple[tuple[str, ...], np.ndarray]], attrs: dict[str, str] | None = None) -> bytes:
    """A classic file of double variables; the inverse of NetCdf3 for small result cubes."""
    text = lambda s: struct.pack(">i", len(s.encode())) + s.encode().ljust(-(-len(s.encode()) // 4) * 4, b"\0")
    order = list(dims)
    head = b"CDF\x02" + struct.pack(">i", 0) + struct.pack(">ii", 10, len(dims)) + b"".join(text(d) + struct.pack(">i", n) for d, n in dims.items())
    attrs = attrs or {}
    head += struct.pack(">ii", 12 if attrs else 0, len(attrs)) + b"".join(text(k) + struct.pack(">i", 2) + text(v) for k, v in attrs.items())
    head += struct.pack(">ii", 11, len(variables))
    entries = [text(n) + struct.pack(">i", len(d)) + b"".join(struct.pack(">i", order.index(x)) for x in d) + struct.pack(">ii", 0, 0) for n, (d, _) in variables.items()]
    begin = len(head) + sum(len(e) + 16 for e in entries)
    body = b""
    for entry, (_, values) in zip(entries, variables.values(), strict=True):
        raw = np.ascontiguousarray(values, ">f8").tobytes()
        head += entry + struct.pack(">iiq", 6, len(raw), begin + len(body))
        body += raw
    return head + body


def _decode(raw: bytes, compressor: dict | None) -> bytes:
    if not compressor:
        return raw
    kind = compressor["id"]
    if kind in ("zlib", "gzip"):
        return zlib.decompress(raw, 47)
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read()
    raise ValueError(f"no codec for {kind}")


class Zarr2:
    """Arrays of a version 2 store in a folder, chunk by chunk."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def meta(self, name: str) -> dict:
        with open(os.path.join(self.folder, name, ".zarray")) as f:
            return json.load(f)

    def chunk(self, name: str, index: tuple[int, ...], meta: dict) -> np.ndarray:
        separator = meta.get("dimension_separator", ".")
        where = os.path.join(self.folder, name, separator.join(map(str, index)))
        shape = meta["chunks"]
        if not os.path.exists(where):
            fill = meta["fill_value"]
            return np.full(shape, np.nan if fill in (None, "NaN") else float(fill))
        with open(where, "rb") as f:
            out = np.frombuffer(_decode(f.read(), meta["compressor"]), meta["dtype"]).reshape(shape, order=meta["order"]).astype(float)
        fill = meta["fill_value"]
        return out if fill in (None, "NaN") else np.where(out == float(fill), np.nan, out)

    def all(self, name: str) -> np.ndarray:
        meta = self.meta(name)
        counts = [-(-n // c) for n, c in zip(meta["shape"], meta["chunks"], strict=True)]
        out = np.full([c * s for c, s in zip(counts, meta["chunks"], strict=True)], np.nan)
        for index in np.ndindex(*counts):
            out[tuple(slice(i * c, (i + 1) * c) for i, c in zip(index, meta["chunks"], strict=True))] = self.chunk(name, index, meta)
        return out[tuple(slice(0, n) for n in meta["shape"])]


class GeoTiff:
    """Band 1 of a file, with the coordinates of pixel centres."""

    SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8}

    def __init__(self, data: bytes) -> None:
        self.data, self.order = data, "<" if data[:2] == b"II" else ">"
        at = struct.unpack_from(self.order + "I", data, 4)[0]
        self.tags = {}
        for i in range(struct.unpack_from(self.order + "H", data, at)[0]):
            tag, kind, n = struct.unpack_from(self.order + "HHI", data, at + 2 + 12 * i)
            size = self.SIZES.get(kind, 1) * n
            where = at + 10 + 12 * i
            if size > 4:
                where = struct.unpack_from(self.order + "I", data, where)[0]
            raw = data[where : where + size]
            code = {1: "B", 3: "H", 4: "I", 11: "f", 12: "d", 8: "h", 9: "i"}.get(kind)
            self.tags[tag] = list(struct.unpack(self.order + code * n, raw)) if code else raw

    def read(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = self.tags
        width, height = t[256][0], t[257][0]
        kind = {1: "u", 2: "i", 3: "f"}[t.get(339, [1])[0]]
        dtype = np.dtype(f"{self.order}{kind}{t[258][0] // 8}")
        tiled = 322 in t
        tw, th = (t[322][0], t[323][0]) if tiled else (width, t.get(278, [height])[0])
        across = -(-width // tw)
        out = np.full((-(-height // th) * th, across * tw), np.nan)
        compression = t.get(259, [1])[0]
        if compression not in (1, 8, 32946) or t.get(317, [1])[0] != 1:
            raise ValueError("only plain or deflated bands without a predictor")
        for k, (at, n) in enumerate(zip(t[324 if tiled else 273], t[325 if tiled else 279], strict=True)):
            raw = self.data[at : at + n]
            part = np.frombuffer(zlib.decompress(raw) if compression != 1 else raw, dtype).reshape(-1, tw)
            out[k // across * th : k // across * th + len(part), k % across * tw : (k % across + 1) * tw] = part
        out = out[:height, :width]
        if 42113 in t:
            out = np.where(out == float(t[42113].rstrip(b"\0")), np.nan, out)
        sx, sy = t[33550][:2]
        i, j, _, x0, y0, _ = t[33922][:6]
        return out, x0 + (np.arange(width) - i + 0.5) * sx, y0 - (np.arange(height) - j + 0.5) * sy


def long_rows(layer: int, values: np.ndarray, x: np.ndarray, y: np.ndarray, name: str, xi0: int = 0, yi0: int = 0) -> pa.RecordBatch:
    """Non-missing cells of one layer."""
    yi, xi = np.nonzero(~np.isnan(values))
    n = len(xi)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, layer)), pa.array((xi + xi0).astype(np.int32)), pa.array((yi + yi0).astype(np.int32)), pa.array(x[xi]), pa.array(y[yi]), pa.array([name] * n, pa.string()), pa.array(values[yi, xi])],
        names=["layer_id", "xi", "yi", "x", "y", "name", "value"],
    )


def _cube_batches(dims: list[str], values: np.ndarray, x, y, name, xi0=0, yi0=0):
    """Any order of dimensions; the one that is neither x nor y counts layers."""
    layer = next((d for d in dims if d not in ("x", "y")), None)
    order = [dims.index(d) for d in (layer, "y", "x") if d]
    values = values.transpose(order)
    for k, v in enumerate(values if layer else values[None]):
        yield long_rows(k, v, x, y, name, xi0, yi0)


def _netcdf_batches(data: bytes, names: list[str]):
    cube = NetCdf3(data)
    x, y = cube.read("x")[1], cube.read("y")[1]
    for name in names:
        dims, values = cube.read(name)
        yield from _cube_batches(dims, values, x, y, name)


class Chunk(InputPartition):
    def __init__(self, path: str, name: str, index: tuple[int, ...] | None = None) -> None:
        super().__init__((path, name, index))


class CubeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.kind = options["path"].removeprefix("file://"), options.get("kind", "netcdf3")
        self.names = options.get("variables", "vx,vy").split(",")

    def partitions(self):
        if self.kind != "zarr":
            files = sorted(os.path.join(self.path, f) for f in os.listdir(self.path)) if os.path.isdir(self.path) else [self.path]
            return [Chunk(f, n) for f in files for n in self.names]
        out = []
        for name in self.names:
            meta = Zarr2(self.path).meta(name)
            out += [Chunk(self.path, name, index) for index in np.ndindex(*[-(-n // c) for n, c in zip(meta["shape"], meta["chunks"], strict=True)])]
        return out

    def read(self, partition):
        path, name, index = partition.value
        if self.kind == "zarr":
            store = Zarr2(path)
            meta = store.meta(name)
            values = store.chunk(name, index, meta)
            begin = [i * c for i, c in zip(index, meta["chunks"], strict=True)]
            keep = tuple(slice(0, min(c, n - b)) for c, n, b in zip(meta["chunks"], meta["shape"], begin, strict=True))
            values = values[keep]
            x, y = (store.all(d)[b : b + n] for d, b, n in (("x", begin[2], values.shape[2]), ("y", begin[1], values.shape[1])))
            for k, v in enumerate(values):
                yield long_rows(begin[0] + k, v, x, y, name, begin[2], begin[1])
            return
        with open(path, "rb") as f:
            data = f.read()
        if self.kind == "geotiff":
            values, x, y = GeoTiff(data).read()
            yield long_rows(0, values, x, y, os.path.basename(path))
        else:
            yield from _netcdf_batches(data, [name])


class VelocityCube(DataSource):
    @classmethod
    def name(cls) -> str:
        return "velocity_cube"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CubeReader:
        return CubeReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VelocityCube)


def from_binary(spark: SparkSession, where: str, kind: str = "netcdf3", variables: tuple[str, ...] = ("vx", "vy")) -> DataFrame:
    """The same rows by way of Spark's own reader, for stores that only Spark can open: one file in memory at a time."""

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if kind == "geotiff":
                    values, x, y = GeoTiff(data).read()
                    yield long_rows(0, values, x, y, path.rpartition("/")[2])
                else:
                    yield from _netcdf_batches(data, list(variables))

    return spark.read.format("binaryFile").load(where).select("path", "content").mapInArrow(run, SCHEMA)


def dates_of_name(name) -> list:
    """Columns date1 and date2 from a name that holds two dates of eight digits."""
    from pyspark.sql import functions as F

    return [F.to_date(F.regexp_extract(name, r"(\d{8}).*?(\d{8})", i), "yyyyMMdd").alias(f"date{i}") for i in (1, 2)]


def wide(long: DataFrame, names: tuple[str, ...] = ("vx", "vy")) -> DataFrame:
    """One row for each pixel and layer, one column for each variable."""
    return long.groupBy("layer_id", "xi", "yi", "x", "y").pivot("name", list(names)).agg({"value": "first"})


def numbered_name(names: list[str], name: str) -> str:
    """`name`, or the first of name_1, name_2, ... that isn't taken."""
    taken, stem = set(names), re.sub(r"_\d+$", "", name)
    if name not in taken:
        return name
    k = 1
    while f"{stem}_{k}" in taken:
        k += 1
    return f"{stem}_{k}"

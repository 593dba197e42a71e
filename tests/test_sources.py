import json
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from firnline.operators import series
from firnline.plans import bridge
from firnline.operators import network
from firnline.sources import cubes, sinks


def cube():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(4, 3, 5))
    v[1, 2, 3] = np.nan
    return v, np.arange(5) * 100.0 + 50, 900.0 - np.arange(3) * 100


def test_netcdf(spark, tmp_path):
    v, x, y = cube()
    data = cubes.write_netcdf3({"t": 4, "y": 3, "x": 5}, {"x": (("x",), x), "y": (("y",), y), "vx": (("t", "y", "x"), v), "vy": (("t", "y", "x"), -v)}, {"author": "é"})
    (tmp_path / "a.nc").write_bytes(data)
    assert cubes.NetCdf3(data).attrs["author"] == "é"
    cubes.register(spark)
    for df in (spark.read.format("velocity_cube").option("path", str(tmp_path / "a.nc")).load(), cubes.from_binary(spark, f"file://{tmp_path}/a.nc")):
        rows = cubes.wide(df).collect()
        assert len(rows) == 59
        for r in rows:
            assert r.vx == v[r.layer_id, r.yi, r.xi] == -r.vy and (r.x, r.y) == (x[r.xi], y[r.yi])


def test_zarr(spark, tmp_path):
    v, x, y = cube()
    for name, a, chunks in (("vx", v, [4, 2, 3]), ("vy", -v, [4, 2, 3]), ("x", x, [5]), ("y", y, [3])):
        os.makedirs(tmp_path / name)
        (tmp_path / name / ".zarray").write_text(json.dumps({"shape": a.shape, "chunks": chunks, "dtype": "<f8", "order": "C", "fill_value": "NaN", "compressor": {"id": "zlib"}}))
        for index in np.ndindex(*[-(-n // c) for n, c in zip(a.shape, chunks, strict=True)]):
            part = np.full(chunks, np.nan)
            own = a[tuple(slice(i * c, (i + 1) * c) for i, c in zip(index, chunks, strict=True))]
            part[tuple(slice(0, n) for n in own.shape)] = own
            (tmp_path / name / ".".join(map(str, index))).write_bytes(zlib.compress(part.tobytes()))
    cubes.register(spark)
    df = spark.read.format("velocity_cube").option("path", str(tmp_path)).option("kind", "zarr").load()
    assert df.rdd.getNumPartitions() == 8
    rows = cubes.wide(df).collect()
    assert len(rows) == 59 and all(r.vx == v[r.layer_id, r.yi, r.xi] and (r.x, r.y) == (x[r.xi], y[r.yi]) for r in rows)


def tiff(a):
    raw = zlib.compress(np.ascontiguousarray(a, "<f4").tobytes())
    scale, tie = struct.pack("<3d", 100, 100, 0), struct.pack("<6d", 0, 0, 0, 1000, 2000, 0)
    nodata = b"-9999\0"
    at = 8 + len(raw) + len(scale) + len(tie) + len(nodata)
    s, t, n = 8 + len(raw), 8 + len(raw) + len(scale), 8 + len(raw) + len(scale) + len(tie)
    tags = [(256, 3, 1, a.shape[1]), (257, 3, 1, a.shape[0]), (258, 3, 1, 32), (259, 3, 1, 8), (273, 4, 1, 8), (278, 3, 1, a.shape[0]), (279, 4, 1, len(raw)), (339, 3, 1, 3), (33550, 12, 3, s), (33922, 12, 6, t), (42113, 2, 6, n)]
    return b"II*\0" + struct.pack("<I", at) + raw + scale + tie + nodata + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *x) for x in tags) + b"\0" * 4


def test_geotiff(spark, tmp_path):
    a = np.arange(12.0).reshape(3, 4)
    a[1, 1] = -9999
    (tmp_path / "vx_20200101_20200113.tif").write_bytes(tiff(a))
    df = cubes.from_binary(spark, f"file://{tmp_path}", "geotiff").select("*", *cubes.dates_of_name(F.col("name")))
    rows = df.collect()
    assert len(rows) == 11 and all(r.value == a[r.yi, r.xi] and r.x == 1050 + 100 * r.xi and r.y == 1950 - 100 * r.yi for r in rows)
    assert str(rows[0].date1) == "2020-01-01" and str(rows[0].date2) == "2020-01-13"


def test_sinks(spark, sf, tmp_path):
    ilf = network.mean_rates(bridge.obs(spark, sf))
    cum = series.cumulative(ilf)
    sinks.write_table(cum, f"file://{tmp_path}/t", tile=400)
    again = spark.read.parquet(f"file://{tmp_path}/t")
    assert again.count() == cum.count() and again.schema["dx"].metadata == {"units": "m"}
    with pytest.raises(Exception, match="exists"):
        sinks.write_table(cum, f"file://{tmp_path}/t", tile=400)
    sinks.write_csv(cum, f"file://{tmp_path}/c")
    sinks.split(cum, f"file://{tmp_path}/s", 2)
    assert spark.read.parquet(f"file://{tmp_path}/s").select("part").distinct().count() == 2
    data = cubes.NetCdf3(sinks.cube_bytes(cum, "dx", source="test"))
    assert np.nansum(data.read("dx")[1]) == pytest.approx(cum.agg(F.sum("dx")).first()[0])
    with pytest.raises(ValueError, match="cells"):
        sinks.cube_bytes(cum, "dx", most=10)
    assert cubes.numbered_name(["a", "a_1"], "a") == "a_2" and json.loads(sinks.sidecar(cum, n=1))["n"] == 1

"""Results written as tables, with what a cube's attributes would say beside them."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cubes import write_netcdf3

UNITS = {"vx": "m/y", "vy": "m/y", "dx": "m", "dy": "m", "result_dx": "m", "result_dy": "m", "error_x": "m/y", "error_y": "m/y"}


def described(df: DataFrame) -> DataFrame:
    """df with units and days since 1970 noted in the columns' metadata."""
    for field in df.schema.fields:
        note = {"units": UNITS[field.name]} if field.name in UNITS else {"calendar": "days since 1970-01-01"} if field.dataType.typeName() == "date" else None
        if note:
            df = df.withMetadata(field.name, note)
    return df


def write_table(df: DataFrame, where: str, tile: int | None = None, mode: str = "errorifexists") -> None:
    """Parquet, in folders by tiles of `tile` units in space if asked: a later crop reads only its tiles."""
    out = described(df)
    if tile:
        cell = lambda c: F.floor(F.col(c) / tile).cast("int")
        out = out.withColumns({"tile_x": cell("x"), "tile_y": cell("y")}).repartition("tile_x", "tile_y").sortWithinPartitions("x", "y")
        out.write.mode(mode).option("compression", "zstd").partitionBy("tile_x", "tile_y").parquet(where)
    else:
        out.write.mode(mode).option("compression", "zstd").parquet(where)


def write_csv(df: DataFrame, where: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(where, header=True)


def split(df: DataFrame, where: str, parts: int, dim: str = "x") -> None:
    """Equal shares of the distinct coordinates in a folder each; coordinates of one axis are few."""
    from pyspark.sql import Window as W

    share = df.select(dim).distinct().select(dim, F.ntile(parts).over(W.orderBy(dim)).alias("part"))
    df.join(F.broadcast(share), dim).write.partitionBy("part").parquet(where)


def cube_bytes(series: DataFrame, value: str, most: int = 50_000_000, **attrs: str) -> bytes:
    """A small result cube value[date2, y, x] as a classic NetCDF file; refuses more than `most` cells."""
    sizes = series.agg(*[F.count_distinct(c).alias(c) for c in ("x", "y", "date2")]).first()
    cells = sizes["x"] * sizes["y"] * sizes["date2"]
    if cells > most:
        raise ValueError(f"{cells} cells: write tables instead")
    rows = series.select("x", "y", F.unix_date("date2").alias("t"), value).toArrow()
    x, y, t = (np.unique(rows.column(c).to_numpy()) for c in ("x", "y", "t"))
    cube = np.full((len(t), len(y), len(x)), np.nan)
    cube[tuple(np.searchsorted(a, rows.column(c).to_numpy()) for a, c in ((t, "t"), (y, "y"), (x, "x")))] = rows.column(value).to_numpy()
    return write_netcdf3({"date2": len(t), "y": len(y), "x": len(x)}, {"x": (("x",), x), "y": (("y",), y), "date2": (("date2",), t), value: (("date2", "y", "x"), cube)}, {"Conventions": "CF-1.11", **attrs})


def sidecar(df: DataFrame, **facts) -> str:
    """What a table holds, as JSON: columns, their notes and further facts."""
    return json.dumps({"columns": [{"name": f.name, "type": f.dataType.simpleString(), **f.metadata} for f in described(df).schema.fields], **facts}, default=str)

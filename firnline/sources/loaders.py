"""Standardisation of producers' schemas to `obs`, by a registry of DataFrame -> DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# producers' sensor labels and their standard names.
SENSORS = {
    "L7": "Landsat-7",
    "L8": "Landsat-8",
    "L9": "Landsat-9",
    "landsat-8": "Landsat-8",
    "L8.": "Landsat-8",
    "LS8": "Landsat-8",
    "LS7": "Landsat-7",
    "LS9": "Landsat-9",
    "S1": "Sentinel-1",
    "S1A": "Sentinel-1",
    "S1B": "Sentinel-1",
    "Sen-1": "Sentinel-1",
    "S2": "Sentinel-2",
    "S2A": "Sentinel-2",
    "S2B": "Sentinel-2",
    "Sen-2": "Sentinel-2",
    "Pleiades": "Pleiades",
}

Loader = Callable[[DataFrame], DataFrame]
_loaders: dict[str, Loader] = {}


def register_loader(author: str, loader: Loader) -> None:
    """From now on `load(df, author)` standardises with `loader`."""
    _loaders[author] = loader


def load(df: DataFrame, author: str | None = None) -> DataFrame:
    """Standard columns of a producer's table; the generic loader for unknown authors."""
    return standardise(_loaders.get(author or "", generic)(df))


def sensor_name(raw: Column | str) -> Column:
    """The standard name of a sensor; an unknown one is kept, trimmed."""
    raw = F.trim(F.col(raw) if isinstance(raw, str) else raw)
    names = F.create_map(*[F.lit(x) for pair in SENSORS.items() for x in pair])
    return F.coalesce(F.element_at(names, raw), raw)


def mask_zero(df: DataFrame) -> DataFrame:
    """Zero in either component stands for missing."""
    gone = (F.col("vx") == 0) | (F.col("vy") == 0)
    return df.withColumns({c: F.when(~gone, F.col(c)) for c in ("vx", "vy")})


def _optional(df: DataFrame, name: str, default) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def generic(df: DataFrame) -> DataFrame:
    """vx, vy, date1 and date2 are required; the rest has defaults."""
    missing = {"vx", "vy", "date1", "date2"} - set(df.columns)
    if missing:
        raise ValueError(f"required columns are missing: {sorted(missing)}")
    df = df.withColumns({"errorx": _optional(df, "errorx", 1.0), "errory": _optional(df, "errory", 1.0), "source": _optional(df, "source", "Unknown"), "sensor": sensor_name(_optional(df, "sensor_raw" if "sensor_raw" in df.columns else "sensor", "Unknown"))})
    return mask_zero(df)


def itslive(df: DataFrame) -> DataFrame:
    """mission_img1 and satellite_img1 name the sensor; v{x,y}_error the errors; acquisition dates the pair."""
    return df.withColumns({"sensor": sensor_name(F.concat(F.trim("mission_img1"), F.trim("satellite_img1"))), "errorx": F.col("vx_error"), "errory": F.col("vy_error"), "date1": F.to_date("acquisition_date_img1"), "date2": F.to_date("acquisition_date_img2"), "source": F.lit("ITS_LIVE")})


def mjd_to_date(mjd: Column | str) -> Column:
    return F.date_add(F.lit("1858-11-17").cast("date"), F.col(mjd) if isinstance(mjd, str) else mjd)


def date_to_mjd(date: Column | str) -> Column:
    return F.datediff(date, F.lit("1858-11-17").cast("date"))


def mjd_layers(df: DataFrame) -> DataFrame:
    """Dates are modified Julian days, errors are given once for each layer."""
    return df.withColumns({"date1": mjd_to_date("date1"), "date2": mjd_to_date("date2"), "errorx": F.col("error_vx"), "errory": F.col("error_vy"), "sensor": sensor_name("sensor")})


def dates_in_text(df: DataFrame, sensor: str = "Pleiades") -> DataFrame:
    """`time` holds both dates; the second component counts southwards."""
    parts = F.split("time", " ")
    return df.withColumns({"date1": F.to_date(parts[0]), "date2": F.to_date(parts[1]), "vy": -F.col("vy"), "sensor": F.lit(sensor), "errorx": F.lit(1.0), "errory": F.lit(1.0), "source": F.lit("IGE")})


def regular_result(df: DataFrame) -> DataFrame:
    """A result cube read again: errors, sensor and source are optional."""
    return df.withColumns({"errorx": _optional(df, "errorx", 1.0), "errory": _optional(df, "errory", 1.0), "sensor": _optional(df, "sensor", "Unknown"), "source": _optional(df, "source", "Unknown")})


for _name, _loader in {"ITS_LIVE": itslive, "IGE_MJD": mjd_layers, "IGE_TEXT": dates_in_text, "IGE": regular_result}.items():
    register_loader(_name, _loader)


def standardise(df: DataFrame) -> DataFrame:
    """Adds temporal_baseline and mid_date, and default errors."""
    baseline = F.datediff("date2", "date1")
    if "errorx" not in df.columns:
        df = df.withColumns({"errorx": F.lit(1.0), "errory": F.lit(1.0)})
    return df.withColumns({"temporal_baseline": baseline, "mid_date": mid_date()})


def mid_date() -> Column:
    """Half-way between the dates, to half a day."""
    return F.timestamp_add("HOUR", 12 * F.datediff("date2", "date1"), F.col("date1").cast("timestamp_ntz"))


def central_date() -> Column:
    """Half-way between the dates, in whole days."""
    return F.expr("date_add(date1, cast(datediff(date2, date1) div 2 as int))")


def attach_layers(obs: DataFrame, layers: DataFrame) -> DataFrame:
    """Variables that are given once for each layer, at all of its pixels."""
    return obs.join(layers, "layer_id", "left")


def error_to_confidence(df: DataFrame, error: str, into: str) -> DataFrame:
    """1 for the least error of the table, 0 for the largest; 1 everywhere if they are equal."""
    ends = df.agg(F.min(error).alias("_low"), F.max(error).alias("_high"))
    spread = F.col("_high") - F.col("_low")
    # one row, whatever the table
    return df.crossJoin(F.broadcast(ends)).withColumn(into, F.when(spread == 0, 1.0).otherwise(1 - (F.col(error) - F.col("_low")) / F.nullif(spread, F.lit(0.0)))).drop("_low", "_high")


def merge(cubes: list[DataFrame]) -> DataFrame:
    """Rows of all cubes, columns by name."""
    out = cubes[0]
    for cube in cubes[1:]:
        out = out.unionByName(cube, allowMissingColumns=True)
    return out


def first_of_repeated(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first by `order`."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def provenance(obs: DataFrame) -> DataFrame:
    """The sensors and sources of a cube as one sentence each."""
    listed = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ", ")  # noqa: E731  a handful of labels
    return obs.agg(listed("sensor").alias("sensors"), listed("source").alias("sources"), F.count("*").alias("n_obs"))

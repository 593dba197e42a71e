"""What figures are drawn from, as DataFrames; drawing is left to the reader's tool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import YEAR
from ..sources.loaders import central_date
from .network import rank_ranges
from .outliers import speed


def series_view(df: DataFrame, kind: str, unit: int = YEAR) -> DataFrame:
    """date, vx, vy, vv and half-width of the bar of any frame. kind: "obs", "invert" or "interp"."""
    if kind == "invert":
        days = F.datediff("date2", "date1")
        df = df.withColumns({f"v{c}": F.col(f"result_d{c}") / days * unit for c in "xy"})
    half = (F.datediff("date2", "date1") / 2).alias("half_days")
    return df.select("x", "y", "date1", "date2", central_date().alias("date"), half, "vx", "vy", F.round(speed(), 2).alias("vv"))


def overlay(obs: DataFrame, result: DataFrame, kind: str = "interp") -> DataFrame:
    """Observations and results in one frame, by the column `layer`."""
    return series_view(obs, "obs").withColumn("layer", F.lit("obs")).unionByName(series_view(result, kind).withColumn("layer", F.lit(kind)))


def direction_view(df: DataFrame) -> DataFrame:
    """Direction (from the x axis, counter-clockwise) of every row and its mean by pixel."""
    angle = F.pmod(F.degrees(F.atan2("vy", "vx")) + 360, F.lit(360.0))
    by = W.partitionBy("x", "y")
    return df.select("x", "y", "date1", "date2", angle.alias("direction")).withColumn("mean_direction", F.avg("direction").over(by))


def confidence_view(rlf: DataFrame, quality: DataFrame) -> DataFrame:
    """vv with its error and confidence interval t * error."""
    df = rlf.join(quality.select("x", "y", F.greatest("t_x", "t_y").alias("t")), ["x", "y"])
    vv = speed()
    error = F.sqrt(F.pow(F.col("vx") / F.nullif(vv, F.lit(0.0)) * F.col("error_x"), 2) + F.pow(F.col("vy") / F.nullif(vv, F.lit(0.0)) * F.col("error_y"), 2))
    return df.select("x", "y", "date1", "date2", vv.alias("vv"), error.alias("error_v"), (error * F.col("t")).alias("interval"))


def reconstruction(obs: DataFrame, ilf: DataFrame, unit: int = YEAR) -> DataFrame:
    """Every observation with the velocity that the inverted series gives it, and the difference: cumulative sums at both
    dates, so no observation meets each of its epochs."""
    by = W.partitionBy("x", "y").orderBy("k")
    cum = ilf.select("x", "y", "k", *[F.sum(f"result_d{c}").over(by).alias(f"c{c}") for c in "xy"])
    at = lambda name, end: cum.select("x", "y", (F.col("k") + 1).cast("int").alias(end), *[F.col(f"c{c}").alias(f"{name}{c}") for c in "xy"])
    rows = rank_ranges(obs.where("vx is not null and vy is not null")).join(at("a", "lo"), ["x", "y", "lo"], "left").join(at("b", "hi"), ["x", "y", "hi"])
    back = lambda c: (F.col(f"b{c}") - F.coalesce(f"a{c}", F.lit(0.0))) * unit / F.col("temporal_baseline")
    return rows.select("x", "y", "date1", "date2", "sensor", "source", "vx", "vy", back("x").alias("model_vx"), back("y").alias("model_vy")).withColumns({f"residual_v{c}": F.col(f"v{c}") - F.col(f"model_v{c}") for c in "xy"})


def cumulative_view(ilf: DataFrame) -> DataFrame:
    """Running displacement and its length."""
    from .series import cumulative

    return cumulative(ilf).withColumn("dv", F.sqrt(F.pow("dx", F.lit(2)) + F.pow("dy", F.lit(2))))


def annual_curves(df: DataFrame, value: str, date: str = "date2", normalise: bool = False) -> DataFrame:
    """value by day of the year, one curve for each year; normalised to [0, 1] within a year if asked."""
    rows = df.select("x", "y", F.year(date).alias("year"), F.dayofyear(date).alias("day"), F.col(value).alias("v"))
    if normalise:
        by = W.partitionBy("x", "y", "year")
        low, high = F.min("v").over(by), F.max("v").over(by)
        rows = rows.withColumn("v", (F.col("v") - low) / F.nullif(high - low, F.lit(0.0)))
    return rows

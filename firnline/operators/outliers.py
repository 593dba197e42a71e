"""Outlier rejection by statistics of each pixel. All filters share one partitioning by pixel, so a chain of them
shuffles once. A filter is a function of a frame that adds the boolean `inlier`; NULL observations are no inliers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_pixel():
    return W.partitionBy("x", "y")


def speed():
    return F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))


def _flag(df: DataFrame, condition, *helpers: str) -> DataFrame:
    return df.withColumn("inlier", F.coalesce(condition, F.lit(False))).drop(*helpers)


def _z(column, limit: float):
    """Within `limit` population deviations of the mean; nothing is if they are all equal."""
    return F.abs((column - F.avg(column).over(by_pixel())) / F.nullif(F.stddev_pop(column).over(by_pixel()), F.lit(0.0))) < limit


def z_score(df: DataFrame, limit: float = 2.0) -> DataFrame:
    return _flag(df, _z(F.col("vx"), limit) & _z(F.col("vy"), limit))


def _with_mad(df: DataFrame, *columns: str) -> DataFrame:
    """Adds the median and the median absolute deviation of columns, in two passes over one partitioning."""
    df = df.withColumns({f"_med_{c}": F.median(c).over(by_pixel()) for c in columns})
    return df.withColumns({f"_mad_{c}": F.median(F.abs(F.col(c) - F.col(f"_med_{c}"))).over(by_pixel()) for c in columns})


def _mz(column: str, limit: float):
    return F.abs(0.6745 * (F.col(column) - F.col(f"_med_{column}")) / F.nullif(F.col(f"_mad_{column}"), F.lit(0.0))) < limit


def mz_score(df: DataFrame, limit: float = 3.5) -> DataFrame:
    df = _with_mad(df, "vx", "vy")
    return _flag(df, _mz("vx", limit) & _mz("vy", limit), "_med_vx", "_med_vy", "_mad_vx", "_mad_vy")


def magnitude(df: DataFrame, limit: float = 1000.0) -> DataFrame:
    return _flag(df, speed() < limit)


def median_magnitude(df: DataFrame, times: float = 3.0) -> DataFrame:
    middle = F.median(speed()).over(by_pixel())
    return _flag(df.withColumn("_m", middle), (speed() > F.col("_m") / times) & (speed() < F.col("_m") * times), "_m")


def error(df: DataFrame, limit: float = 100.0, as_before: bool = False) -> DataFrame:
    """Errors below the limit; as_before compares the velocities, as older results did."""
    a, b = ("vx", "vy") if as_before else ("errorx", "errory")
    return _flag(df, (F.col(a) < limit) & (F.col(b) < limit))


def _to_median(df: DataFrame, angle: float):
    df = df.withColumns({"_mx": F.median("vx").over(by_pixel()), "_my": F.median("vy").over(by_pixel())})
    size = F.sqrt(F.col("_mx") * F.col("_mx") + F.col("_my") * F.col("_my"))
    dot = F.col("_mx") * F.col("vx") + F.col("_my") * F.col("vy")
    return df, size, dot / F.nullif(size * speed(), F.lit(0.0)) > math.cos(math.radians(angle))


def median_angle(df: DataFrame, angle: float = 45.0, slow: float = 10.0, limit: float = 3.0) -> DataFrame:
    """Within an angle of the median vector; where that is slow, the deviation of the magnitude decides."""
    df, size, near = _to_median(df, angle)
    return _flag(df, F.when(size > slow, near).otherwise(_z(speed(), limit)), "_mx", "_my")


def coherence():
    """Length of the mean unit vector of a pixel; missing layers count in the denominator."""
    unit = lambda c: F.coalesce(F.sum(F.col(c) / F.nullif(speed(), F.lit(0.0))).over(by_pixel()), F.lit(0.0))
    return F.sqrt(F.pow(unit("vx"), 2) + F.pow(unit("vy"), 2)) / F.count(F.lit(1)).over(by_pixel())


def vvc_angle(df: DataFrame, vvc: float = 0.3, angle: float = 45.0, limit: float = 2.0) -> DataFrame:
    """Coherent pixels by the angle to the median vector, others by the deviation of the magnitude."""
    df, _, near = _to_median(df.withColumn("_vvc", coherence()), angle)
    return _flag(df, F.when(F.col("_vvc") > vvc, near).otherwise(_z(speed(), limit)), "_mx", "_my", "_vvc")


def vvc_angle_mz(df: DataFrame, vvc: float = 0.3, angle: float = 45.0, limit: float = 3.5) -> DataFrame:
    df = _with_mad(df.withColumns({"_vvc": coherence(), "_vv": speed()}), "_vv")
    df, _, near = _to_median(df, angle)
    return _flag(df, F.when(F.col("_vvc") > vvc, near).otherwise(_mz("_vv", limit)), "_mx", "_my", "_vvc", "_vv", "_med__vv", "_mad__vv")


def azimuth(vx="vx", vy="vy"):
    """Degrees from the y axis, clockwise, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(vx, vy)) + 360, F.lit(360.0))


def flow_angle(df: DataFrame, direction: DataFrame, angle: float = 45.0, limit: float = 3.0) -> DataFrame:
    """Within an angle of direction(x, y, direction); without one, the deviation of the magnitude decides."""
    df = df.join(direction.select("x", "y", "direction"), ["x", "y"], "left")
    off = F.abs(F.pmod(azimuth() - F.col("direction") + 180, F.lit(360.0)) - 180)
    return _flag(df, F.when(F.col("direction").isNotNull(), off < angle).otherwise(_z(speed(), limit)), "direction")


FILTERS = {"z_score": z_score, "mz_score": mz_score, "magnitude": magnitude, "median_magnitude": median_magnitude, "error": error, "median_angle": median_angle, "vvc_angle": vvc_angle, "vvc_angle_mzscore": vvc_angle_mz, "flow_angle": flow_angle}


def delete_outliers(df: DataFrame, steps: int | float | str | dict, exempt: DataFrame | None = None, **more) -> DataFrame:
    """vx and vy of outliers become NULL. steps: a limit of the errors, a filter's name, or names with their limits,
    applied in order on what the ones before left. exempt(x, y): pixels that keep all observations."""
    if isinstance(steps, (int, float)):
        steps = {"error": steps}
    if isinstance(steps, str):
        steps = {steps: None}
    if exempt is not None:
        df = df.join(exempt.select("x", "y", F.lit(True).alias("_exempt")).distinct(), ["x", "y"], "left")
    for name, limit in steps.items():
        arguments = limit if isinstance(limit, dict) else {} if limit is None else {"angle" if name in ("median_angle", "flow_angle") else "times" if name == "median_magnitude" else "limit": limit}
        if name == "flow_angle":
            arguments = {"direction": more["direction"]} | arguments
        df = FILTERS[name](df, **arguments)
        keep = F.col("inlier") | F.coalesce(F.col("_exempt"), F.lit(False)) if exempt is not None else F.col("inlier")
        df = df.withColumns({c: F.when(keep, F.col(c)) for c in ("vx", "vy")}).drop("inlier")
    return df.drop("_exempt") if exempt is not None else df


def widen_baseline(obs: DataFrame, start: int = 180, step: int = 30, times: int = 3, most: int = 500) -> DataFrame:
    """x, y, baseline: the least of start, start + step, ... up to `most` with at least `times` observations below it
    for each distinct date pair's epoch; `most` if none has."""
    limits = obs.sparkSession.range(0, (most - start) // step + 1).select((start + F.col("id") * step).cast("int").alias("baseline"))
    counts = obs.where("vx is not null").groupBy("x", "y", "temporal_baseline").agg(F.count("*").alias("n"))
    epochs = obs.select("x", "y", F.explode(F.array("date1", "date2")).alias("d")).groupBy("x", "y").agg((F.count_distinct("d") - 1).alias("k"))
    sums = counts.crossJoin(F.broadcast(limits)).where("temporal_baseline < baseline").groupBy("x", "y", "baseline").agg(F.sum("n").alias("n"))
    enough = sums.join(epochs, ["x", "y"]).where(F.col("n") >= times * F.col("k")).groupBy("x", "y").agg(F.min("baseline").alias("baseline"))
    return epochs.join(enough, ["x", "y"], "left").select("x", "y", F.coalesce("baseline", F.lit(most)).alias("baseline"))

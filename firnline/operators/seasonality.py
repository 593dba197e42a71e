"""Seasonal signals: fixed-frequency sines by normal equations, yearly statistics, local variability, spectra."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kernels as K

FREQUENCY = 1 / 365.25


def sine_fixed(df: DataFrame, day: str, value: str, frequency: float = FREQUENCY) -> DataFrame:
    """x, y, amplitude, phase, offset: least squares of offset + a sin + b cos, by sums over each pixel alone."""
    a = 2 * math.pi * frequency
    s, c, v = F.sin(a * F.col(day)), F.cos(a * F.col(day)), F.col(value)
    sums = {"n": F.count(v), "s": F.sum(s), "c": F.sum(c), "ss": F.sum(s * s), "cc": F.sum(c * c), "sc": F.sum(s * c), "v": F.sum(v), "sv": F.sum(s * v), "cv": F.sum(c * v)}
    m = df.where(f"{value} is not null").groupBy("x", "y").agg(*[e.alias(k) for k, e in sums.items()])
    # means removed, two unknowns are left
    m = m.selectExpr("x", "y", "n", "s / n as ms", "c / n as mc", "v / n as mv", "ss - s * s / n as ss", "cc - c * c / n as cc", "sc - s * c / n as sc", "sv - s * v / n as sv", "cv - c * v / n as cv")
    m = m.withColumn("det", F.nullif(F.expr("ss * cc - sc * sc"), F.lit(0.0)))
    m = m.selectExpr("x", "y", "(sv * cc - cv * sc) / det as a", "(cv * ss - sv * sc) / det as b", "ms", "mc", "mv")
    return m.selectExpr("x", "y", "sqrt(a * a + b * b) as amplitude", "atan2(b, a) as phase", "mv - a * ms - b * mc as offset")


def annual(df: DataFrame, date: str, value: str) -> DataFrame:
    """x, y, year: least, largest, mean, median, spread, amplitude, day of the largest, number of peaks."""
    by = W.partitionBy("x", "y").orderBy(date)
    v = F.col(value)
    df = df.where(f"{value} is not null").withColumn("peak", ((v > F.lag(v).over(by)) & (v > F.lead(v).over(by))).cast("int"))
    return df.groupBy("x", "y", F.year(date).alias("year")).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_pop(v).alias("std"), ((F.max(v) - F.min(v)) / 2).alias("amplitude"), F.dayofyear(F.max_by(date, F.struct(v.alias("v"), (-F.unix_date(date)).alias("d")))).alias("max_day"), F.coalesce(F.sum("peak"), F.lit(0)).alias("nb_peaks"))


def rolling_std(df: DataFrame, day: str, value: str, days: int = 3) -> DataFrame:
    """df with std: sample deviation within `days` days on either side."""
    by = W.partitionBy("x", "y").orderBy(day).rangeBetween(-days, days)
    return df.withColumn("std", F.stddev_samp(value).over(by))


def local_std(raw: DataFrame, centres: DataFrame, days: int = 3) -> DataFrame:
    """x, y, day, std: population deviation of raw(x, y, day, v) strictly within `days` of centres(x, y, day). Centres are
    set out over their days, so the join is by equality."""
    spread = F.explode(F.sequence(F.col("day") - days + 1, F.col("day") + days - 1)).alias("at")
    near = centres.select("x", "y", "day", spread).join(raw.select("x", "y", F.col("day").alias("at"), "v"), ["x", "y", "at"])
    return near.groupBy("x", "y", "day").agg(F.stddev_pop("v").alias("std"))


def containing_std(obs: DataFrame, centres: DataFrame, value: str = "vx", width: int = 512) -> DataFrame:
    """x, y, day, std: population deviation of the observations whose dates lie on both sides of centres(x, y, day).
    Both are dealt into stretches of `width` days; the dates are compared within a stretch."""
    d1, d2 = F.unix_date("date1"), F.unix_date("date2")
    bins = F.explode(F.sequence(F.floor(d1 / width), F.floor(d2 / width))).alias("bin")
    own = obs.where(f"{value} is not null").select("x", "y", d1.alias("d1"), d2.alias("d2"), F.col(value).alias("v"), bins)
    at = centres.select("x", "y", "day", F.floor(F.col("day") / width).alias("bin"))
    return at.join(own, ["x", "y", "bin"]).where("d1 < day and day < d2").groupBy("x", "y", "day").agg(F.stddev_pop("v").alias("std"))


def interpolated_residual(raw: DataFrame, series: DataFrame) -> DataFrame:
    """x, y, day, r: raw(x, y, day, v) less series(x, y, day, v), the latter linear between its days."""
    known = F.struct("day", "v")
    both = series.select("x", "y", "day", known.alias("s"), F.lit(None).cast("double").alias("v")).unionByName(raw.select("x", "y", "day", F.lit(None).cast(series.select(known.alias("s")).schema["s"].dataType).alias("s"), "v"))
    by = W.partitionBy("x", "y").orderBy("day")
    back, ahead = F.last("s", True).over(by.rangeBetween(W.unboundedPreceding, 0)), F.first("s", True).over(by.rangeBetween(0, W.unboundedFollowing))
    rows = both.select("x", "y", "day", "v", back.alias("b"), ahead.alias("a")).where("v is not null and a is not null and b is not null")
    t = F.when(F.col("a.day") == F.col("b.day"), 0.0).otherwise((F.col("day") - F.col("b.day")) / F.nullif((F.col("a.day") - F.col("b.day")).cast("double"), F.lit(0.0)))
    return rows.select("x", "y", "day", (F.col("v") - F.col("b.v") - t * (F.col("a.v") - F.col("b.v"))).alias("r"))


def amplitude_to_variability(amplitude: DataFrame, spread: DataFrame) -> DataFrame:
    """x, y, a_to_var: 1 less the median local deviation over the amplitude, at least 0."""
    s = spread.groupBy("x", "y").agg(F.median("std").alias("s"))
    return amplitude.join(s, ["x", "y"]).select("x", "y", F.greatest(F.lit(0.0), 1 - F.col("s") / F.nullif(F.abs("amplitude"), F.lit(0.0))).alias("a_to_var"))


def _series(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    pdf = pdf.dropna(subset=["day", "v"]).groupby("day", as_index=False)["v"].mean().sort_values("day")
    return pdf["day"].to_numpy(float), pdf["v"].to_numpy(float)


def spectrum_peak(df: DataFrame) -> DataFrame:
    """x, y, frequency, amplitude of the highest peak of df(x, y, day, v); frequencies by day."""

    def run(pdf):
        t, v = _series(pdf)
        if len(t) < 4:
            return pd.DataFrame(columns=["x", "y", "frequency", "amplitude"], dtype=object)
        step = float(np.median(np.diff(t)))
        f, a = K.spectrum(np.interp(np.arange(t[0], t[-1] + step / 2, step), t, v), step)
        i = int(a[1:].argmax()) + 1
        return pd.DataFrame({"x": [pdf["x"].iloc[0]], "y": [pdf["y"].iloc[0]], "frequency": [f[i]], "amplitude": [a[i]]})

    return df.groupBy("x", "y").applyInPandas(run, "x double, y double, frequency double, amplitude double")


def filtered(df: DataFrame, low_days: float | None = 547.0, high_days: float = 182.0, order: int = 4) -> DataFrame:
    """x, y, day, v of df(x, y, day, v), passed by a filter between two periods in days (or below one frequency)."""

    def run(pdf):
        t, v = _series(pdf)
        if len(t) < 4:
            return pd.DataFrame(columns=["x", "y", "day", "v"], dtype=object)
        step = float(np.median(np.diff(t)))
        grid = np.arange(t[0], t[-1] + step / 2, step)
        half = 0.5 / step
        sections = K.butterworth(None if low_days is None else min(0.98, 1 / low_days / half), min(0.99, 1 / high_days / half), order)
        out = K.run_sections(sections, np.interp(grid, t, v))
        return pd.DataFrame({"x": pdf["x"].iloc[0], "y": pdf["y"].iloc[0], "day": grid, "v": out})

    return df.groupBy("x", "y").applyInPandas(run, "x double, y double, day double, v double")


def sine_free(df: DataFrame, frequency: float | None = None, harmonics: int = 1) -> DataFrame:
    """x, y, amplitude, frequency, phase, offset, rmse of df(x, y, day, v)."""

    def run(pdf):
        t, v = _series(pdf)
        names = ["x", "y", "amplitude", "frequency", "phase", "offset", "rmse"]
        if len(t) < 5:
            return pd.DataFrame(columns=list(names), dtype=object)
        return pd.DataFrame([[pdf["x"].iloc[0], pdf["y"].iloc[0], *K.fit_sine(t, v, frequency, harmonics)]], columns=names)

    return df.groupBy("x", "y").applyInPandas(run, "x double, y double, amplitude double, frequency double, phase double, offset double, rmse double")

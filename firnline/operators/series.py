"""Cumulative displacement and resampling on a regular grid."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..schema import RLF, YEAR


def by_date():
    return W.partitionBy("x", "y").orderBy("date2").rowsBetween(W.unboundedPreceding, W.currentRow)


def cumulative(ilf: DataFrame, values: tuple[str, ...] = ("result_dx", "result_dy")) -> DataFrame:
    """x, y, ref_date, date2 and running sums dx, dy (and of further values, under their names); NULL counts 0."""
    first = F.min("date1").over(W.partitionBy("x", "y")).alias("ref_date")
    sums = [F.sum(F.coalesce(F.col(v), F.lit(0.0))).over(by_date()).alias(v.removeprefix("result_")) for v in values]
    return ilf.select("x", "y", first, "date2", *sums)


def on_global_axis(cum: DataFrame) -> DataFrame:
    """x, y, date2, dx, dy on every date that any pixel has; NULL where a pixel has none."""
    axis = cum.select("date2").distinct()
    pixels = cum.select("x", "y").distinct()
    return pixels.crossJoin(F.broadcast(axis)).join(cum.select("x", "y", "date2", "dx", "dy"), ["x", "y", "date2"], "left")


def reference_dates(ilf: DataFrame) -> DataFrame:
    return ilf.groupBy("x", "y").agg(F.min("date1").alias("ref_date"))


def bounds(obs: DataFrame) -> DataFrame:
    """first_date: the second of all dates in order, repeats counted; last_date: the last."""
    dates = obs.select(F.explode(F.array("date1", "date2")).alias("d"))
    low = dates.orderBy("d").limit(2).agg(F.max("d").alias("first_date"))
    return low.crossJoin(dates.agg(F.max("d").alias("last_date")))


def grid_starts(ilf: DataFrame, interval: int = 30, redundancy: int = 5, start: str | None = None) -> DataFrame:
    """x, y, date1, date2 of the regular windows: from the first multiple of the redundancy beyond the first date2 to
    the last one before the last date2, days counted from `start` (the pixel's first date2 by default)."""
    ends = ilf.groupBy("x", "y").agg(F.min("date2").alias("a"), F.max("date2").alias("b"))
    origin = F.lit(start).cast("date") if start else F.col("a")
    a, b = F.datediff("a", origin), F.datediff("b", origin)
    first = a + (redundancy - F.pmod(a, F.lit(redundancy)))
    step = interval // redundancy * redundancy
    n = ends.select("x", "y", origin.alias("origin"), first.alias("g"), (b - 1 - step).alias("last")).where("g <= last")
    g = n.select("x", "y", "origin", F.explode(F.sequence(F.col("g"), F.col("last"), F.lit(redundancy))).alias("g"))
    return g.select("x", "y", F.date_add("origin", F.col("g")).alias("date1"), F.date_add("origin", F.col("g") + step).alias("date2"))


def resample_nearest(ilf: DataFrame, interval: int = 30, redundancy: int = 5) -> DataFrame:
    """rlf by the cumulative value of the nearest date (half-way, the earlier).

    Each date of the series is set out to the grid's dates that are nearest to it, and a window's end is so many rows on:
    all of it runs on one partitioning by pixel, without a join. The grid is that of `grid_starts`."""
    step = interval // redundancy * redundancy
    pixel = W.partitionBy("x", "y")
    by = pixel.orderBy("day")
    cum = cumulative(ilf).select("x", "y", "dx", "dy", F.unix_date("date2").alias("day"))
    first, last = F.min("day").over(pixel).alias("a"), F.max("day").over(pixel).alias("b")
    dates = cum.select("*", F.lag("day").over(by).alias("before"), F.lead("day").over(by).alias("after"), first, last)
    # grid dates are a + j * redundancy; twice a date is compared with a sum of two, so half days do no harm
    half = lambda other: F.floor((F.col("day") + F.col(other) - 2 * F.col("a")) / (2 * redundancy))
    end = F.floor((F.col("b") - F.col("a") - 1) / redundancy)
    low = F.greatest(F.lit(1).cast("long"), F.coalesce(half("before") + 1, F.lit(1).cast("long")))
    high = F.least(end, F.coalesce(half("after"), end))
    cells = dates.select("x", "y", "a", "dx", "dy", low.alias("low"), high.alias("high")).where("low <= high")
    points = cells.select("x", "y", "a", "dx", "dy", F.explode(F.sequence("low", "high")).alias("j"))
    on = lambda c: F.lead(c, step // redundancy).over(pixel.orderBy("j"))
    day = lambda more: F.date_from_unix_date((F.col("a") + F.col("j") * redundancy + more).cast("int"))
    speed = lambda c: ((on(c) - F.col(c)) * YEAR / interval).alias(f"v{c[1]}")
    rows = points.select("x", "y", day(0).alias("date1"), day(step).alias("date2"), speed("dx"), speed("dy"), on("j").alias("to"))
    return rows.where("to is not null").drop("to")


def resample_frame(pdf: pd.DataFrame, interval: int = 30, redundancy: int | None = 5, option: str = "spline", unit: int = YEAR, first: str | None = None, last: str | None = None) -> pd.DataFrame:
    """One pixel's ilf to its regular series; empty if there are too few points."""
    names = ["x", "y", "date1", "date2", "vx", "vy", "xcount_x", "xcount_y", "error_x", "error_y"]
    empty = pd.DataFrame(columns=list(names), dtype=object)
    pdf = pdf.dropna(subset=["result_dx", "result_dy"]).sort_values("date2")
    if len(pdf) <= (1 if option == "nearest" else 3):
        return empty
    day = lambda c: pd.to_datetime(pdf[c]).to_numpy().astype("datetime64[D]").astype(np.int64)
    d2 = day("date2")
    origin = int(np.datetime64(first, "D").astype(np.int64)) if first else int(d2[0])
    x = (d2 - origin).astype(float)
    every = redundancy or interval
    grid = np.arange(x[0] + (every - x[0] % every), x[-1], every)
    step = max(1, int(interval / every))
    if len(grid) <= 1 or step >= len(grid):
        return empty
    function = K.INTERPOLATORS[option]
    rate = unit / interval

    def difference(column):
        if column not in pdf or pdf[column].isna().all():
            return np.full(len(grid) - step, np.nan)
        value = function(x, np.cumsum(pdf[column].fillna(0).to_numpy(float)), grid)
        return value[step:] - value[:-step]

    date = lambda v: pd.Series((origin + v.astype(np.int64)).astype("datetime64[D]").astype("datetime64[ns]")).dt.date
    out = pd.DataFrame({"date1": date(grid[:-step]), "date2": date(grid[step:]), "vx": difference("result_dx") * rate, "vy": difference("result_dy") * rate})
    for c in "xy":
        out[f"xcount_{c}"] = np.maximum(difference(f"xcount_{c}"), 0)
        out[f"error_{c}"] = difference(f"error_{c}") * rate
    if first or last:  # windows beyond the pixel's own dates have no values
        begin, end = np.datetime64(out["date1"].iloc[0], "D"), np.datetime64(out["date2"].iloc[-1], "D")
        head = np.arange(np.datetime64(first, "D"), begin, every) if first else []
        tail = np.arange(end + every, np.datetime64(last, "D") + every, every) - interval if last and end < np.datetime64(last, "D") else []
        pad = [pd.Timestamp(d) for d in [*head, *tail]]
        if pad:
            blank = pd.DataFrame({"date1": [p.date() for p in pad], "date2": [(p + pd.Timedelta(days=interval)).date() for p in pad]})
            out = pd.concat([out, blank]).sort_values("date1", ignore_index=True)
    out.insert(0, "x", float(pdf["x"].iloc[0]))
    out.insert(1, "y", float(pdf["y"].iloc[0]))
    return out[names]


def resample(ilf: DataFrame, interval: int = 30, redundancy: int | None = 5, option: str = "spline", unit: int = YEAR, first: str | None = None, last: str | None = None) -> DataFrame:
    """rlf: velocities over windows of `interval` days, one every `redundancy` days."""
    if option not in K.INTERPOLATORS:
        raise ValueError(f"option is one of {sorted(K.INTERPOLATORS)}")
    return ilf.groupBy("x", "y").applyInPandas(lambda pdf: resample_frame(pdf, interval, redundancy, option, unit, first, last), RLF)


def at_dates(ilf: DataFrame, wanted: DataFrame, option: str = "spline", unit: int = YEAR) -> DataFrame:
    """Velocities over the pairs of wanted(x, y, date1, date2) that lie within the pixel's series."""

    def run(a, b):
        names = ["x", "y", "date1", "date2", "vx", "vy"]
        a = a.sort_values("date2")
        if len(a) <= 3 or not len(b):
            return pd.DataFrame(columns=list(names), dtype=object)
        day = lambda s: pd.to_datetime(s).to_numpy().astype("datetime64[D]").astype(float)
        x, d1, d2 = day(a["date2"]), day(b["date1"]), day(b["date2"])
        ok = (d1 > x[0]) & (d2 < x[-1])
        out = b[["x", "y", "date1", "date2"]].reset_index(drop=True)
        for c in "xy":
            cum = np.cumsum(a[f"result_d{c}"].to_numpy(float))
            out[f"v{c}"] = (K.INTERPOLATORS[option](x, cum, d2) - K.INTERPOLATORS[option](x, cum, d1)) * unit / np.maximum(d2 - d1, 1)
        return out[ok]

    return ilf.groupBy("x", "y").cogroup(wanted.groupBy("x", "y")).applyInPandas(run, "x double, y double, date1 date, date2 date, vx double, vy double")

"""Aggregates over pixels, dates, areas and profiles that tell how good or how coherent a cube is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .network import mean_covering
from .outliers import azimuth, speed
from .select import where_computed

#: Points of a profile up to which all executors hold it.
POINTS = 10_000


def mean_velocity(obs: DataFrame) -> DataFrame:
    """x, y, vx, vy, vv: temporal means; vv is the length of the mean vector."""
    m = obs.groupBy("x", "y").agg(F.avg("vx").alias("vx"), F.avg("vy").alias("vy"))
    return m.withColumn("vv", speed())


def coherence(obs: DataFrame) -> DataFrame:
    """x, y, vvc: length of the mean unit vector; missing layers count in the denominator."""
    unit = lambda c: F.coalesce(F.sum(F.col(c) / F.nullif(speed(), F.lit(0.0))), F.lit(0.0))
    return obs.groupBy("x", "y").agg((F.sqrt(F.pow(unit("vx"), 2) + F.pow(unit("vy"), 2)) / F.count(F.lit(1))).alias("vvc"))


def flow_direction(obs: DataFrame, slow: float = 1.0) -> DataFrame:
    """x, y, direction: azimuth of the mean vector weighted by baselines (all layers' in the denominator); NULL if slow."""
    mean = lambda c: F.sum(F.col(c) * F.col("temporal_baseline")) / F.sum("temporal_baseline")
    m = obs.groupBy("x", "y").agg(mean("vx").alias("vx"), mean("vy").alias("vy"))
    return m.select("x", "y", F.when(slow <= speed(), azimuth()).alias("direction"))


def static_median(obs: DataFrame, area: DataFrame) -> DataFrame:
    """mid_date and the medians of vx and vy over area(x, y)."""
    return obs.join(area.select("x", "y").distinct(), ["x", "y"], "left_semi").groupBy("mid_date").agg(F.median("vx").alias("vx"), F.median("vy").alias("vy"))


def static_nmad(obs: DataFrame, area: DataFrame) -> DataFrame:
    """mid_date and 1.483 times the median absolute deviation of vx and vy over area(x, y), in two passes."""
    own = obs.join(area.select("x", "y").distinct(), ["x", "y"], "left_semi")
    middle = own.groupBy("mid_date").agg(F.median("vx").alias("mx"), F.median("vy").alias("my"))
    off = own.join(middle, "mid_date")
    spread = lambda c: (1.483 * F.median(F.abs(F.col(f"v{c}") - F.col(f"m{c}")))).alias(f"v{c}")
    return off.groupBy("mid_date").agg(spread("x"), spread("y"))


def heatmap(obs: DataFrame, profile: DataFrame, resolution: float, variable: str = "vv", method: str = "mean") -> DataFrame:
    """distance, month, date (the middle of the month) and `variable` (vx, vy or vv) along profile(distance, x, y), one
    point for each distance.

    A layer is what one sensor and source give for one pair of dates; its value at a point is the mean over the pixels
    within `resolution` of it. A month has the mean or median of the layers that touch it (both ends count). Months are
    the whole ones between the first and last date of the cube; those without a value at a point have no row.

    Points meet pixels by cells of the grid and layers are set out into their months, so all joins are by equality."""
    value = speed() if variable == "vv" else F.col(variable)
    cell = lambda c: F.floor(F.col(c) / resolution)
    points = profile.select("distance", F.col("x").alias("px"), F.col("y").alias("py"), cell("x").alias("cx"), cell("y").alias("cy"))
    for c in ("cx", "cy"):
        points = points.withColumn(c, F.explode(F.array(*[F.col(c) + i for i in (-1, 0, 1)])))
    own = obs.select("date1", "date2", "sensor", "source", "x", "y", value.alias("v"), cell("x").alias("cx"), cell("y").alias("cy"))
    own = where_computed(own, F.col("v").isNotNull())
    if profile.limit(POINTS + 1).count() <= POINTS:  # so the observations aren't dealt by cells, of which they may have few
        points = F.broadcast(points)
    near = own.join(points, ["cx", "cy"]).where((F.abs(F.col("x") - F.col("px")) <= resolution) & (F.abs(F.col("y") - F.col("py")) <= resolution))
    layers = near.groupBy("distance", "date1", "date2", "sensor", "source").agg(F.avg("v").alias("v"))
    month = lambda d: F.trunc(d, "MM")
    # a layer that begins on the first of a month touches the month before as well
    before = lambda d: month(F.date_sub(d, 1))
    span = obs.agg(F.add_months(before(F.min("date1")), 1).alias("first"), F.add_months(month(F.max("date2")), -1).alias("last"))  # one row
    low, high = F.greatest(before("date1"), "first"), F.least(month("date2"), "last")
    months = layers.crossJoin(F.broadcast(span)).where(low <= high).select("distance", "v", F.explode(F.sequence(low, high, F.expr("interval 1 month"))).alias("month"))
    how = F.avg if method == "mean" else F.median
    out = months.groupBy("distance", "month").agg(how("v").alias(variable))
    after = F.add_months("month", 1)
    middle = F.date_sub(after, F.floor(F.datediff(after, "month") / 2).cast("int"))
    return out.select("distance", "month", middle.alias("date"), variable)


def pivot_heatmap(cells: DataFrame, distances: list[float], variable: str = "vv") -> DataFrame:
    """One row for each month, one column for each distance."""
    return cells.groupBy("month").pivot("distance", distances).agg(F.first(variable))


def moving_average(obs: DataFrame) -> DataFrame:
    """x, y, k, e_start, e_end, vx, vy: mean velocity of the observations over each epoch."""
    return mean_covering(obs).drop("delta")


def rmse(series: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """x, y, rmse over both components, against truth(x, y, date1, date2, vx, vy), or against rest."""
    if truth is None:
        both = F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")
        return series.groupBy("x", "y").agg(F.sqrt(F.avg(both / 2)).alias("rmse"))
    t = truth.select("x", "y", "date1", "date2", F.col("vx").alias("tx"), F.col("vy").alias("ty"))
    both = F.pow(F.col("vx") - F.col("tx"), 2) + F.pow(F.col("vy") - F.col("ty"), 2)
    return series.join(t, ["x", "y", "date1", "date2"]).groupBy("x", "y").agg(F.sqrt(F.avg(both / 2)).alias("rmse"))


def pair_spread(obs: DataFrame) -> DataFrame:
    """Means over date pairs of the mean and population deviation of vx and vy within a pair."""
    pairs = obs.groupBy("date1", "date2").agg(*[f(c).alias(f"{n}_{c}") for c in ("vx", "vy") for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    return pairs.agg(*[F.avg(c).alias(c) for c in ("mean_vx", "std_vx", "mean_vy", "std_vy")])


def residual_groups(residuals: DataFrame, value: str = "r") -> DataFrame:
    """sensor, source, n and quartiles of residuals, for box plots."""
    quartile = lambda q: F.percentile(value, F.lit(q)).alias(f"q{int(100 * q)}")
    return residuals.groupBy("sensor", "source").agg(F.count(value).alias("n"), quartile(0.25), quartile(0.5), quartile(0.75))


def vector_error(df: DataFrame) -> DataFrame:
    """df with error_v: the error of the speed, from those of the components."""
    return df.withColumn("error_v", F.sqrt(F.pow(F.col("vx") / F.nullif(speed(), F.lit(0.0)) * F.col("errorx"), 2) + F.pow(F.col("vy") / F.nullif(speed(), F.lit(0.0)) * F.col("errory"), 2)))

"""Selections in space, time and by label, and lookups of pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def subset(df: DataFrame, xmin: float, xmax: float, ymin: float, ymax: float) -> DataFrame:
    """Bounds are part of the box."""
    return df.where(F.col("x").between(xmin, xmax) & F.col("y").between(ymin, ymax))


def buffer_pixels(df: DataFrame, i: int, j: int, r: int) -> DataFrame:
    """Pixel indices from i - r to i + r - 1, and likewise for j."""
    return df.where((F.col("xi") >= i - r) & (F.col("xi") < i + r) & (F.col("yi") >= j - r) & (F.col("yi") < j + r))


def buffer_point(df: DataFrame, x: float, y: float, r: float) -> DataFrame:
    return subset(df, x - r, x + r, y - r, y + r)


def pick_date(df: DataFrame, first: str, last: str) -> DataFrame:
    """Pairs within the two dates."""
    return df.where((F.col("date1") >= F.lit(first).cast("date")) & (F.col("date2") <= F.lit(last).cast("date")))


def pick_sensor(df: DataFrame, sensors: list[str]) -> DataFrame:
    return df.where(F.col("sensor").isin(*sensors))


def pick_baseline(df: DataFrame, least: int, most: int) -> DataFrame:
    return df.where(F.col("temporal_baseline").between(least, most))


def where_computed(df: DataFrame, condition: Column) -> DataFrame:
    """Rows of df where the condition holds, tested on its columns as they are computed once.

    A filter that Spark moves below them repeats their expressions, and those that they build on several times; the
    resulting method can be too long for the JVM to compile. It isn't moved below the number of the partition."""
    return df.withColumn("_part", F.spark_partition_id()).where(condition & (F.col("_part") >= 0)).drop("_part")


def drop_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows without NULL or NaN in any of the columns, all by default."""
    whole = F.lit(True)
    for name, kind in df.dtypes:
        if columns is None or name in columns:
            whole = whole & F.col(f"`{name}`").isNotNull()
            if kind in ("double", "float"):
                whole = whole & ~F.isnan(f"`{name}`")
    return where_computed(df, whole)


def in_ring(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd rule: crossings of the ray to the right of a point, over a ring of literal corners."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 == y2:
            continue
        spans = (y > min(y1, y2)) & (y <= max(y1, y2))
        crossings = crossings + F.when(spans & (x < x1 + (y - y1) * ((x2 - x1) / (y2 - y1))), 1).otherwise(0)
    return crossings % 2 == 1


def mask_polygon(df: DataFrame, ring: list[tuple[float, float]], invert: bool = False) -> DataFrame:
    """Rows inside the ring (outside, if invert). The bounding box goes first, so files can be skipped."""
    inside = in_ring(F.col("x"), F.col("y"), ring)
    if invert:
        return df.where(~inside)
    xs, ys = zip(*ring, strict=True)
    return df.where(F.col("x").between(min(xs), max(xs)) & F.col("y").between(min(ys), max(ys)) & inside)


def nearest_pixel(df: DataFrame, x: float, y: float) -> DataFrame:
    """All rows of the pixel nearest to a point; ties to the smaller x, then y."""
    away = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)
    one = df.agg(F.min_by(F.struct("x", "y"), F.struct(away.alias("d"), F.col("x"), F.col("y"))).alias("p")).select("p.x", "p.y")
    return df.join(F.broadcast(one), ["x", "y"])  # one row


def bilinear_pixel(df: DataFrame, x: float, y: float, step: float, keys: list[str], values: list[str]) -> DataFrame:
    """Values at a point from the four pixels around it, for each layer that has all of them."""
    fx, fy = F.abs(F.col("x") - x) / step, F.abs(F.col("y") - y) / step
    near = df.where((F.abs(F.col("x") - x) < step) & (F.abs(F.col("y") - y) < step)).withColumn("_w", (1 - fx) * (1 - fy))
    out = near.groupBy(*keys).agg(F.count_distinct("x", "y").alias("corners"), *[(F.sum(F.col(v) * F.col("_w")) / F.sum("_w")).alias(v) for v in values])
    return out


def align_nearest(df: DataFrame, grid: DataFrame) -> DataFrame:
    """Rows moved to the nearest cell of a grid(x, y): each axis has its own map, of one row for each coordinate."""
    out = df
    for axis in ("x", "y"):
        own, to = df.select(axis).distinct(), grid.select(F.col(axis).alias("_to")).distinct()
        # axes are short: the number of columns or rows of a raster
        near = own.crossJoin(F.broadcast(to)).groupBy(axis).agg(F.min_by("_to", F.struct(F.abs(F.col(axis) - F.col("_to")).alias("d"), F.col("_to"))).alias(f"{axis}_to"))
        out = out.join(F.broadcast(near), axis)
    return out.drop("x", "y").withColumnsRenamed({"x_to": "x", "y_to": "y"})

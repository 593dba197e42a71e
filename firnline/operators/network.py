"""The network of overlapping observations: epochs, the incidence of observations on them, weights and regularisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ordered():
    return W.partitionBy("x", "y").orderBy("k")


def epochs(obs: DataFrame) -> DataFrame:
    """x, y, k (from 0), e_start, e_end, delta: the stretches between consecutive distinct dates of a pixel."""
    dates = obs.select("x", "y", F.explode(F.array("date1", "date2")).alias("d")).where("d is not null").distinct()
    by = W.partitionBy("x", "y").orderBy("d")
    rows = dates.select("x", "y", (F.row_number().over(by) - 1).alias("k"), F.col("d").alias("e_start"), F.lead("d").over(by).alias("e_end"))
    return rows.where("e_end is not null").withColumn("delta", F.datediff("e_end", "e_start"))


def rank_ranges(obs: DataFrame) -> DataFrame:
    """obs with lo and hi: it covers the epochs lo <= k < hi. Dates are epoch ends, so two equi-joins do."""
    dates = obs.select("x", "y", F.explode(F.array("date1", "date2")).alias("d")).where("d is not null").distinct()
    rank = dates.withColumn("r", F.row_number().over(W.partitionBy("x", "y").orderBy("d")) - 1)
    lo, hi = (rank.select("x", "y", F.col("d").alias(c), F.col("r").alias(n)) for c, n in (("date1", "lo"), ("date2", "hi")))
    return obs.join(lo, ["x", "y", "date1"]).join(hi, ["x", "y", "date2"])


def design_matrix(obs: DataFrame) -> DataFrame:
    """One row for each cell that is 1: obs columns, k. Only for diagnosis; the solver keeps (lo, hi)."""
    return rank_ranges(obs).where("lo < hi").withColumn("k", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)))


def covered(obs: DataFrame, values: dict[str, Column]) -> DataFrame:
    """x, y, k, e_start, e_end, delta of each epoch and, under its name, the sum of each value over the observations that
    cover it.

    An observation adds its value at date1 and takes it off at date2; a running sum does the rest, so the rows grow with
    the observations and not with the epochs that they cover. What is exchanged is summed by date before, and a date's
    place in the window is its rank: nothing is joined. Without one of its dates an observation covers nothing."""
    whole = F.col("date1").isNotNull() & F.col("date2").isNotNull()
    at = lambda sign, d: F.struct(F.col(d).alias("d"), *[F.when(whole, sign * v).alias(n) for n, v in values.items()])
    marks = obs.select("x", "y", F.explode(F.array(at(1, "date1"), at(-1, "date2"))).alias("m")).where("m.d is not null")
    sums = marks.groupBy("x", "y", "m.d").agg(*[F.coalesce(F.sum(f"m.{n}"), F.lit(0)).alias(n) for n in values])
    by = W.partitionBy("x", "y").orderBy("d")
    rank, end = (F.row_number().over(by) - 1).alias("k"), F.lead("d").over(by).alias("e_end")
    rows = sums.select("x", "y", rank, F.col("d").alias("e_start"), end, *[F.sum(n).over(by).alias(n) for n in values])
    return rows.where("e_end is not null").withColumn("delta", F.datediff("e_end", "e_start"))


def contributions(weighted: DataFrame, weight: str = "w") -> DataFrame:
    """x, y, k, xcount: sum of the weights of the observations that cover an epoch."""
    return covered(weighted, {"xcount": F.col(weight)}).select("x", "y", "k", "xcount")


def initial_weights(obs: DataFrame, error: str = "errorx", apriori: bool = True, confidence: bool = False, decorrelation: int | None = 180) -> DataFrame:
    """obs with w: from errors (scaled to 1 for the least and 0 for the largest of a pixel), or confidences, times 0 for
    baselines beyond `decorrelation`. Errors that are all 1, or all equal, weigh 1."""
    by = W.partitionBy("x", "y")
    low, high = F.min(error).over(by), F.max(error).over(by)
    spread = high - low
    scaled = F.col(error) if confidence else F.when(spread == 0, 1.0).otherwise(1 - (F.col(error) - low) / F.nullif(spread, F.lit(0.0)))
    w = F.when((low == 1) & (high == 1), 1.0).otherwise(scaled) if apriori else F.lit(1.0)
    if decorrelation is not None:
        w = w * F.when(F.col("temporal_baseline") > decorrelation, 0.0).otherwise(1.0)
    return obs.withColumn("w", w)


def tukey(z, c: float = 4.685):
    """Tukey's biweight of a standardised residual."""
    u = z / c
    return F.when(F.abs(z) <= c, F.pow(1 - u * u, 2)).otherwise(0.0)


def tukey_weights(df: DataFrame, residual: str = "r", c: float = 4.685) -> DataFrame:
    """df with w: biweights of residuals over their scaled median absolute deviation by pixel; 1 if that is 0."""
    by = W.partitionBy("x", "y")
    df = df.withColumn("_m", F.median(residual).over(by))
    df = df.withColumn("_s", F.median(F.abs(F.col(residual) - F.col("_m"))).over(by) / 0.6745)
    return df.withColumn("w", F.when(F.col("_s") == 0, 1.0).otherwise(tukey(F.col(residual) / F.nullif(F.col("_s"), F.lit(0.0)), c))).drop("_m", "_s")


def first_order(epochs_: DataFrame, value: str) -> DataFrame:
    """x, y, k, row: change of rate from one epoch to the next."""
    rate = F.col(value) / F.col("delta")
    return epochs_.select("x", "y", "k", (F.lead(rate).over(ordered()) - rate).alias("row")).where("row is not null")


def second_order(epochs_: DataFrame, value: str) -> DataFrame:
    """x, y, k, row: second difference of the rate, at epochs with neighbours on both sides."""
    rate = F.col(value) / F.col("delta")
    return epochs_.select("x", "y", "k", (F.lag(rate).over(ordered()) - 2 * rate + F.lead(rate).over(ordered())).alias("row")).where("row is not null")


def acceleration(apriori: DataFrame, value: str) -> DataFrame:
    """x, y, k, accel: change of an a-priori velocity to the next epoch."""
    return apriori.select("x", "y", "k", (F.lead(value).over(ordered()) - F.col(value)).alias("accel")).where("accel is not null")


def mean_covering(obs: DataFrame) -> DataFrame:
    """x, y, k, e_start, e_end, delta, vx, vy: means of the observations that cover an epoch; epochs without any are left out."""
    known = obs.where("vx is not null and vy is not null")
    sums = covered(known, {"vx": F.col("vx"), "vy": F.col("vy"), "n": F.lit(1).cast("long")}).where("n > 0")
    return sums.select("x", "y", "k", "e_start", "e_end", "delta", *[(F.col(c) / F.col("n")).alias(c) for c in ("vx", "vy")])


def mean_rates(obs: DataFrame) -> DataFrame:
    """x, y, k, date1, date2, delta, result_dx, result_dy: displacement of each epoch at the mean velocity of the
    observations that cover it; a quick estimate."""
    value = lambda c: (F.col(f"v{c}") * F.col("delta") / 365).alias(f"result_d{c}")
    return mean_covering(obs).select("x", "y", "k", F.col("e_start").alias("date1"), F.col("e_end").alias("date2"), "delta", value("x"), value("y"))

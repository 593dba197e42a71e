"""Choice of the regularisation coefficient: sweeps over coefficients and selection by their measures."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kernels as K
from .invert import Inversion, _batch, _dates, by_pixel, invert_series
from .series import resample_frame


def sweep(obs: DataFrame, coefs: list[float], method: str = "vvc", p: Inversion | None = None, interval: int = 30, redundancy: int = 5, option: str = "spline", truth: DataFrame | None = None) -> DataFrame:
    """x, y, coef, measure. method: "vvc" (coherence of the series), "stable_ground" (root mean square speed) or
    "ground_truth" (root mean square difference to truth). A pixel is read once for all coefficients."""
    p = p or Inversion()

    schema = "x double, y double, coef double, measure double"

    def measure(o, pixel, other):
        rows = []
        wanted = pd.DataFrame({"date1": _dates(other[1].astype(np.int64)), "date2": _dates(other[2].astype(np.int64)), "vx_t": other[3], "vy_t": other[4]})
        for coef in coefs:
            ilf, _ = invert_series(o, pixel["x"], pixel["y"], Inversion(**{**p.__dict__, "coef": float(coef)}))
            rlf = resample_frame(ilf, interval, redundancy, option)
            v = rlf[["vx", "vy"]].to_numpy(float)
            if not len(v):
                continue
            size = np.hypot(v[:, 0], v[:, 1])
            if method == "vvc":
                m = float(np.hypot(*np.nansum(v / np.where(size > 0, size, np.nan)[:, None], axis=0)) / len(v))
            elif method == "stable_ground":
                m = float(np.sqrt((v**2).mean()))
            else:
                joined = rlf.merge(wanted, on=["date1", "date2"])
                if not len(joined):
                    continue
                m = float(np.sqrt(((joined[["vx", "vy"]].to_numpy(float) - joined[["vx_t", "vy_t"]].to_numpy(float)) ** 2).mean()))
            rows.append((pixel["x"], pixel["y"], float(coef), m))
        yield _batch(pd.DataFrame(rows, columns=["x", "y", "coef", "measure"], dtype=float), schema)

    beside = None
    if method == "ground_truth":
        day = lambda c: F.unix_date(F.col(c).cast("date"))
        beside = truth.select("x", "y", F.lit(0.0).alias("day"), day("date1").alias("d1"), day("date2").alias("d2"), "vx", "vy")
    return by_pixel(obs, measure, schema, beside=beside)


def select_coefs(measures: DataFrame, method: str = "vvc", how: str = "min-max relative", threshold: float = 95.0, mean_angle: float | None = None, mean_disp: tuple[float, float] | None = None) -> DataFrame:
    """x, y, best_measure, best_coef, good_measure, good_coefs (in order) of measures(x, y, coef, measure).

    vvc wants large measures, the others small ones. how: "min-max relative", "max relative", "absolute", "curvature",
    "vvc_angle_thresh", "vvc_disp_thresh". Ties go to the smaller coefficient."""
    if how == "vvc_disp_thresh":
        vx, vy = mean_disp
        a, b = (vx - threshold, vy + threshold), (vx + threshold, vy - threshold)
        threshold, how = math.acos((a[0] * b[0] + a[1] * b[1]) / (math.hypot(*a) * math.hypot(*b))), "vvc_angle_thresh"
    if how == "vvc_angle_thresh":
        threshold, how, method = abs(math.sin(mean_angle) / (2 * math.sqrt(2 * (1 + math.cos(mean_angle)))) * threshold), "absolute", "vvc"
    up = method == "vvc"
    keys = ["x", "y"]
    best = F.max("measure") if up else F.min("measure")
    worst = F.min("measure") if up else F.max("measure")
    at = F.max_by("coef", F.struct("measure", (-F.col("coef")).alias("c"))) if up else F.min_by("coef", F.struct("measure", "coef"))
    ends = measures.groupBy(*keys).agg(best.alias("best_measure"), worst.alias("worst"), at.alias("best_coef"))
    if how == "curvature":
        by = W.partitionBy(*keys).orderBy("coef")
        m = measures.withColumn("s", F.lag("measure").over(by) / 4 + F.col("measure") / 2 + F.lead("measure").over(by) / 4)
        width = (F.lead("coef").over(by) - F.lag("coef").over(by)) / 2
        m = m.withColumn("bend", (F.lead("s").over(by) - 2 * F.col("s") + F.lag("s").over(by)) / (width * width)).where("bend is not null")
        turn = F.max_by("measure", F.struct("bend", (-F.col("coef")).alias("c"))) if up else F.min_by("measure", F.struct("bend", "coef"))
        ends = ends.join(m.groupBy(*keys).agg(turn.alias("good_measure")), keys)
    else:
        sign = -1 if up else 1
        good = {
            "min-max relative": F.col("best_measure") + sign * (1 - threshold / 100) * F.abs(F.col("worst") - F.col("best_measure")),
            "max relative": (1 + sign * threshold / 100) * F.col("best_measure"),
            "absolute": F.col("best_measure") + sign * threshold,
        }[how]
        ends = ends.withColumn("good_measure", good)
    joined = measures.join(ends, keys)
    ok = F.col("measure") > F.col("good_measure") if up else F.col("measure") < F.col("good_measure")
    listed = F.sort_array(F.collect_list(F.when(ok, F.col("coef"))))  # the coefficients tried: a few
    return joined.groupBy(*keys, "best_measure", "best_coef", "good_measure").agg(listed.alias("good_coefs"))


def saturation_coef(curve: DataFrame, share: float = 0.95) -> DataFrame:
    """gain, scale, coef of the mean measure by coefficient: where gain (1 - exp(-coef / scale)) has nearly risen."""
    mean = curve.groupBy("coef").agg(F.avg("measure").alias("measure"))

    def run(pdf):
        pdf = pdf.sort_values("coef")
        return pd.DataFrame([K.saturation(pdf["coef"].to_numpy(float), pdf["measure"].to_numpy(float), share)], columns=["gain", "scale", "coef"])

    return mean.groupBy(F.lit(1).alias("_")).applyInPandas(run, "gain double, scale double, coef double")

"""The whole chain in few calls: preparation, inversion and resampling of a cube or of one pixel."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from .operators import invert as V
from .operators import outliers, select, series
from .schema import ILF


@dataclass
class Chain:
    """Parameters of all steps."""

    outliers: dict = field(default_factory=dict)
    smooth: str = "savgol"
    window: int = 3
    inversion: V.Inversion = field(default_factory=V.Inversion)
    interval: int = 30
    redundancy: int | None = 5
    option: str = "spline"


def prior_field(obs: DataFrame, chain: Chain) -> DataFrame:
    """x, y, mid_day, vx, vy: smoothed in time by pixel, then averaged over neighbours on the same day. The days of all
    pixels' epochs differ, so each is rounded to the day first."""
    p = chain.inversion
    rows = V.smooth_pixels(obs, chain.smooth, p.t_win, p.sigma, p.order, p.short).withColumn("day", F.floor("mid_day"))
    pixels = obs.select("x", "y", "xi", "yi").distinct()
    near = V.spatial_mean(rows.join(pixels, ["x", "y"]).groupBy("xi", "yi", "day").agg(F.avg("vx").alias("vx"), F.avg("vy").alias("vy")), ["vx", "vy"], ["day"], chain.window)
    return near.join(pixels, ["xi", "yi"]).select("x", "y", F.col("day").cast("double").alias("mid_day"), "vx", "vy")


def prepare(obs: DataFrame, chain: Chain, **more) -> tuple[DataFrame, DataFrame | None]:
    """Observations without outliers, and the a-priori field if the inversion wants one."""
    obs = outliers.delete_outliers(obs, chain.outliers, **more) if chain.outliers else obs
    wants = chain.inversion.regu in ("1accelnotnull", "directionxy") or chain.inversion.solver == "LSMR_ini"
    return obs, prior_field(obs, chain) if wants and "xi" in obs.columns else None


def process(obs: DataFrame, chain: Chain | None = None, returned: str = "interp", flags: DataFrame | None = None, **more) -> DataFrame:
    """returned: "raw" (prepared observations), "invert" or "interp"."""
    chain = chain or Chain()
    obs, prior = prepare(obs, chain, **more)
    if returned == "raw":
        return obs
    ilf = V.invert_with_prior(obs, prior, chain.inversion) if prior is not None and flags is None else V.invert(obs, chain.inversion, flags)
    return ilf if returned == "invert" else series.resample(ilf, chain.interval, chain.redundancy, chain.option)


def one_pixel(obs: DataFrame, x: float, y: float, chain: Chain | None = None, halo: float | None = None) -> dict[str, DataFrame]:
    """obs, invert and interp of the pixel nearest to a point; halo: how far around it the pixel is looked for. Only its
    neighbours within the chain's window are smoothed, and it alone is inverted."""
    chain = chain or Chain()
    near = select.buffer_point(obs, x, y, halo) if halo else obs
    keys = [c for c in ("x", "y", "xi", "yi") if c in obs.columns]
    own = F.broadcast(select.nearest_pixel(near, x, y).select(*keys).distinct())  # one row
    of_pixel = lambda df: df.join(own.select("x", "y"), ["x", "y"])
    if "xi" in keys:
        at, reach = own.select(F.col("xi").alias("_xi"), F.col("yi").alias("_yi")), chain.window // 2
        close = (F.abs(F.col("xi") - F.col("_xi")) <= reach) & (F.abs(F.col("yi") - F.col("_yi")) <= reach)
        obs, prior = prepare(obs.join(F.broadcast(at), close).drop("_xi", "_yi"), chain)
    else:
        obs, prior = prepare(of_pixel(obs), chain)
    mine = of_pixel(obs)
    ilf = V.invert(mine, chain.inversion) if prior is None else V.invert_with_prior(mine, of_pixel(prior), chain.inversion)
    return {"obs": of_pixel(near), "invert": ilf, "interp": series.resample(ilf, chain.interval, chain.redundancy, chain.option)}


def register_sql(spark: SparkSession, p: V.Inversion | None = None) -> None:
    """SELECT * FROM invert(TABLE(obs) PARTITION BY (x, y)); the table needs the columns of `invert.NEEDED`."""
    p = p or V.Inversion(regu="1", solver="LS")

    class Invert:
        def __init__(self):
            self.rows, self.all = [], V.Observations()
            self.pixel = None

        def eval(self, row):
            self.rows.append([row[c] for c in V.NEEDED])
            if len(self.rows) == V.BLOCK:
                self.store()

        def store(self):
            if self.rows:
                self.pixel = self.pixel or self.rows[0][:2]
                V.add_frame(self.all, pd.DataFrame(self.rows, columns=list(V.NEEDED)))
                self.rows = []

        def terminate(self):
            self.store()
            if not self.all.n:
                return
            out, _ = V.invert_series(self.all, *map(float, self.pixel), p)
            for r in out.astype(object).where(out.notna(), None).itertuples(index=False):
                yield tuple(r)

    spark.udtf.register("invert", udtf(Invert, returnType=ILF))

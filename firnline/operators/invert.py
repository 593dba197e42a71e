"""Robust regularised inversion of overlapping displacements, as a grouped operator over pixels.

Per pixel and component: least of |W (A X - Y)|^2 + coef^2 |mu X - a|^2 by exact solves, reweighted by Tukey's biweight
until the mean change of X is small in both components. Pixels are independent, so tasks scale with their number.

Spark sorts a pixel's observations and hands them over in batches; the kernel keeps them in a file beyond HELD bytes and
reads them block by block, some times for each solve. What a solve needs are sums over the observations of each pair of
dates, and exact medians found by counting. So a worker's memory is O(block + k^2) for k epochs, however many
observations a pixel has; its file is 36 bytes for each of them.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..schema import ILF, QUALITY, YEAR

#: Observations that are worked on at once, and bytes of a pixel's observations that stay in memory.
BLOCK, HELD = 1 << 16, 16 << 20
_ROW = np.dtype([("pair", "<i4"), ("v", "<f8", 2), ("e", "<f8", 2)])


class Observations:
    """One pixel's observations, which can be read in blocks again and again. d1, d2: its distinct pairs of day numbers;
    count and total (2 x pairs): observations of each pair, and sums of their velocities."""

    def __init__(self) -> None:
        near = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        self.file = tempfile.SpooledTemporaryFile(max_size=HELD, dir=near if os.path.isdir(near) else None)
        self.n, self.low, self.high = 0, np.full(2, np.inf), np.full(2, -np.inf)
        self.number: dict[int, int] = {}
        self.count, self.total = np.zeros(0, np.int64), np.zeros((2, 0))

    def add(self, d1: np.ndarray, d2: np.ndarray, v: np.ndarray, error: np.ndarray) -> None:
        """More of them. v, error: 2 x n."""
        if not len(d1):
            return
        codes, at = np.unique(d1.astype(np.int64) << 32 | d2.astype(np.int64) & 0xFFFFFFFF, return_inverse=True)
        rows = np.empty(len(d1), _ROW)
        rows["pair"] = np.array([self.number.setdefault(c, len(self.number)) for c in codes.tolist()])[at]
        rows["v"], rows["e"] = v.T, error.T
        self.file.seek(0, os.SEEK_END)
        self.file.write(rows.tobytes())
        self.n += len(rows)
        self.low, self.high = np.minimum(self.low, error.min(1)), np.maximum(self.high, error.max(1))
        more = len(self.number) - len(self.count)
        if more:
            self.count, self.total = np.pad(self.count, (0, more)), np.pad(self.total, ((0, 0), (0, more)))
        np.add.at(self.count, rows["pair"], 1)
        for c in range(2):
            np.add.at(self.total[c], rows["pair"], v[c])

    @property
    def d1(self) -> np.ndarray:
        return np.array(list(self.number), np.int64) >> 32

    @property
    def d2(self) -> np.ndarray:
        return np.array(list(self.number), np.int64).astype(np.int32).astype(np.int64)

    def blocks(self) -> Iterator[np.ndarray]:
        """In the order in which they were added. One reader at a time."""
        at, size = 0, BLOCK * _ROW.itemsize
        while at < self.n * _ROW.itemsize:
            self.file.seek(at)
            yield np.frombuffer(self.file.read(size), _ROW)
            at += size

    def close(self) -> None:
        self.file.close()


@dataclass
class Inversion:
    """Parameters; names of `regu` and `solver` as in `kernels`."""

    regu: str = "1accelnotnull"
    solver: str = "LSMR_ini"
    coef: float = 100.0
    apriori_weight: bool = False
    apriori_weight_again: bool = False
    confidence: bool = False
    iterate: bool = True
    threshold: float = 0.1
    most_iterations: int = 10
    decorrelation: int | None = 180
    unit: int = YEAR
    contribution: bool = True
    errors: bool = False
    smoother: str = "gaussian"
    t_win: int = 90
    sigma: float = 3
    order: int = 3
    short: int = 180
    by_flag: dict = field(default_factory=dict)


@dataclass
class Solution:
    epochs: np.ndarray
    delta: np.ndarray
    x: np.ndarray  # 2 x k
    n: int
    iterations: int
    normr: list
    xcount: np.ndarray
    each: Callable[[], Iterator[tuple]]  # a block, the weights of its first and last solve and its residuals, all 2 x m
    error: np.ndarray | None = None
    sigma0: tuple = (None, None)
    t: tuple = (None, None)

    @property
    def first_weights(self) -> np.ndarray:
        return np.concatenate([x[1] for x in self.each()], axis=1)

    @property
    def weights(self) -> np.ndarray:
        return np.concatenate([x[2] for x in self.each()], axis=1)

    @property
    def residual(self) -> np.ndarray:
        return np.concatenate([x[3] for x in self.each()], axis=1)


def invert_arrays(d1, d2, v, error, p: Inversion, prior=None) -> Solution | None:
    """d1, d2: day numbers; v: 2 x n velocities per unit; prior: 2 x k velocities per unit at the epochs' centres."""
    o = Observations()
    o.add(d1, d2, v, error)
    return invert_observations(o, p, prior)


def invert_observations(o: Observations, p: Inversion, prior=None) -> Solution | None:
    """prior: 2 x k velocities per unit at the epochs' centres."""
    d1, d2, n = o.d1, o.d2, o.n
    days = np.unique(np.concatenate([d1, d2]))
    k = len(days) - 1
    if k < 1 or not n:
        return None
    delta = np.diff(days).astype(float)
    lo, hi = np.searchsorted(days, d1), np.searchsorted(days, d2)
    baseline = (d2 - d1).astype(float)
    target = [None, None]
    if prior is not None and p.regu == "1accelnotnull":
        target = [np.diff(c) / p.unit for c in prior]
    ini = [c / p.unit * delta for c in prior] if prior is not None and p.solver == "LSMR_ini" else [None, None]
    joint = p.regu == "directionxy"
    if joint:
        if prior is None:
            raise ValueError("directionxy needs an a-priori velocity")
        mu = K.direction_rows(delta, prior[0] / p.unit, prior[1] / p.unit)
    else:
        mu = K.regularisation(p.regu, delta)

    def measured(b):
        return b["v"].T * baseline[b["pair"]] / p.unit

    def by_error(b, decorrelation):
        at = baseline[b["pair"]]
        return np.stack([K.initial_weights(e, at, p.apriori_weight, p.confidence, decorrelation, ends) for e, ends in zip(b["e"].T, zip(o.low, o.high, strict=True), strict=True)])

    def left(x):
        """Residuals of a block at x."""
        model = np.stack([K.forward(lo, hi, c) for c in x])
        return lambda b: measured(b) - model[:, b["pair"]]

    def first(b):
        return by_error(b, p.decorrelation)

    def robust(x):
        residual = left(x)
        middle = K.medians(lambda: (residual(b) for b in o.blocks()), n)[:, None]
        scale = K.medians(lambda: (np.abs(residual(b) - middle) for b in o.blocks()), n) / 0.6745

        def weight(b):
            r = residual(b)
            w = np.stack([np.ones(len(b)) if s == 0 else K.biweight(c / s) for c, s in zip(r, scale, strict=True)])
            return w * by_error(b, None) if p.apriori_weight_again else w

        return weight

    def summed(parts) -> np.ndarray:
        """Sums over the observations of each pair. parts(b): rows of values of a block."""
        out = None
        for b in o.blocks():
            rows = parts(b)
            out = np.zeros((len(rows), len(lo))) if out is None else out
            for total, row in zip(out, rows, strict=True):
                np.add.at(total, b["pair"], row)
        return out

    def normal(c, w2, w2y):
        return K.normal_matrix(lo, hi, w2, k), K.right_side(lo, hi, w2y, k)

    def squares(b, w):
        w2 = w(b) ** 2
        return [*w2, *(w2 * measured(b))]

    def solve(w, start):
        if p.solver == "L1" and not joint:
            out = []
            for c in range(2):

                def sums(x, c=c):
                    if x is None:
                        s = summed(lambda b: squares(b, w))
                        return normal(c, s[c], s[2 + c])
                    model = K.forward(lo, hi, x)

                    def parts(b):
                        y = measured(b)[c]
                        w2 = K.absolute_weights(w(b)[c], y - model[b["pair"]])
                        return w2, w2 * y

                    return normal(c, *summed(parts))

                out.append(K.solve_l1_sums(sums, mu, p.coef, target[c]))
            return np.stack(out)
        s = summed(lambda b: squares(b, w))
        if joint:
            a = np.zeros((2 * k, 2 * k))
            b = np.zeros(2 * k)
            for c in range(2):
                at = slice(c * k, (c + 1) * k)
                a[at, at], b[at] = normal(c, s[c], s[2 + c])
            a += p.coef**2 * mu.T @ mu
            b += p.coef**2 * mu.T @ np.ones(k)
            return np.linalg.lstsq(a, b, rcond=1e-12)[0].reshape(2, k)
        return np.stack([K.solve_sums(*normal(c, s[c], s[2 + c]), mu, p.coef, target[c], start[c]) for c in range(2)])

    w, x = first, solve(first, ini)
    count = 1
    while p.iterate and n >= k and count < p.most_iterations:
        w = robust(x)
        new = solve(w, x if p.solver == "LSMR_ini" else [None, None])
        change = np.abs(new - x).mean(1)
        x, count = new, count + 1
        if (change <= p.threshold).all():
            break
    residual, free = left(x), n - k

    def last(b):
        r, weight = residual(b), w(b)
        spread = np.maximum(r**2, (b["e"].T * baseline[b["pair"]] / p.unit) ** 2)
        return [*weight, *(weight * r) ** 2, *weight**2, *(weight**4 * spread), *(r**2 * weight)]

    s = summed(last).reshape(5, 2, -1)
    normr = []
    for c in range(2):
        own = mu @ (x.reshape(-1) if joint else x[c]) - (1.0 if joint else 0.0 if target[c] is None else target[c])
        normr += [float(np.sqrt(s[1, c].sum())), float(np.linalg.norm(own))]
    xcount = np.stack([K.right_side(lo, hi, s[0, c], k) for c in range(2)]) if p.contribution else np.ones((2, k))
    out = Solution(days, delta, x, n, count, normr, xcount, lambda: ((b, first(b), w(b), residual(b)) for b in o.blocks()))
    if p.errors and not joint:
        spread, sigma, t = [], [], []
        for c in range(2):
            s2 = float(s[4, c].sum() / free) if free > 0 else float("nan")
            inverse = np.linalg.pinv(K.normal_matrix(lo, hi, s[2, c], k) + p.coef**2 * mu.T @ mu, hermitian=True)
            middle = inverse @ K.normal_matrix(lo, hi, s[3, c], k) @ inverse
            spread.append(np.sqrt(np.maximum(middle.diagonal(), 0)))
            sigma.append(s2**0.5)
            t.append(K.t_quantile(0.975, free))
        out.error, out.sigma0, out.t = np.stack(spread), tuple(sigma), tuple(t)
    return out


def _days(dates: pd.Series) -> np.ndarray:
    return pd.to_datetime(dates).to_numpy().astype("datetime64[D]").astype(np.int64)


def _dates(days: np.ndarray):
    return pd.Series(days.astype("datetime64[D]").astype("datetime64[ns]")).dt.date


def prior_arrays(d1, d2, count, total, p: Inversion) -> np.ndarray:
    """Smoothed velocities at the epochs' centres, from the short pairs of the pixel itself. count, total (2 x pairs):
    observations of each pair of day numbers, and sums of their velocities."""
    days = np.unique(np.concatenate([d1, d2]))
    centre = (days[:-1] + days[1:]) // 2
    short = d2 - d1 < p.short
    if not short.any():
        short = np.ones(len(d1), bool)
    t, at = np.unique((d1 + (d2 - d1) // 2)[short], return_inverse=True)
    held = np.bincount(at, count[short])
    return np.stack([K.smooth(p.smoother, t, np.bincount(at, c[short]) / held, centre, p.t_win, p.sigma, p.order) for c in total])


def invert_series(o: Observations, x: float, y: float, p: Inversion, prior: np.ndarray | None = None) -> tuple[pd.DataFrame, Solution | None]:
    """One pixel's observations to its series. prior: mid_day, vx, vy (3 x m, by day) of a smoothed field; the nearest in
    time counts."""
    needs = p.regu in ("1accelnotnull", "directionxy") or p.solver == "LSMR_ini"
    own = None
    if needs and o.n:
        if prior is not None and prior.shape[1]:
            days = np.unique(np.concatenate([o.d1, o.d2]))
            centre = (days[:-1] + days[1:]) / 2
            own = np.stack([K.nearest(prior[0], c, centre) if len(c) > 1 else np.full(len(centre), float(c[0])) for c in prior[1:]])
        else:
            own = prior_arrays(o.d1, o.d2, o.count, o.total, p)
    s = invert_observations(o, p, own)
    names = ["x", "y", "k", "date1", "date2", "result_dx", "result_dy", "xcount_x", "xcount_y", "error_x", "error_y"]
    if s is None:
        return pd.DataFrame(columns=list(names), dtype=object), None
    k = len(s.delta)
    out = pd.DataFrame({"k": np.arange(k), "date1": _dates(s.epochs[:-1]), "date2": _dates(s.epochs[1:]), "result_dx": s.x[0], "result_dy": s.x[1], "xcount_x": s.xcount[0], "xcount_y": s.xcount[1]})
    for i, c in enumerate("xy"):
        out[f"error_{c}"] = s.error[i] if s.error is not None else np.nan
    out.insert(0, "x", x)
    out.insert(1, "y", y)
    return out[names], s


def add_frame(o: Observations, pdf: pd.DataFrame) -> None:
    """The usable rows of a frame of NEEDED columns."""
    pdf = pdf.dropna(subset=["date1", "date2", "vx", "vy", "errorx", "errory"])
    o.add(_days(pdf["date1"]), _days(pdf["date2"]), *(pdf[c].to_numpy(float).T for c in (["vx", "vy"], ["errorx", "errory"])))


NEEDED = ("x", "y", "date1", "date2", "vx", "vy", "errorx", "errory")
_KINDS = {"double": pa.float64(), "int": pa.int32(), "date": pa.date32(), "array<double>": pa.list_(pa.float64())}


def _batch(df: pd.DataFrame, schema: str) -> pa.RecordBatch:
    """NaN becomes NULL."""
    return pa.RecordBatch.from_pandas(df, pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in schema.split(", ")]), preserve_index=False)


def by_pixel(obs: DataFrame, use: Callable[[Observations, dict, np.ndarray], Iterator[pa.RecordBatch]], schema: str, more: tuple = (), beside: DataFrame | None = None) -> DataFrame:
    """use(observations, pixel, other) for each pixel with observations that have all their values, in the order of dates
    and values; pixel: x, y and the columns `more`. beside(x, y, day, d1, d2, vx, vy): a few rows for each pixel that come
    to it as the columns of `other` (5 x m), by day."""
    real = ("vx", "vy", "errorx", "errory")
    whole = F.col("date1").isNotNull() & F.col("date2").isNotNull()
    for c in real:
        whole = whole & F.col(c).isNotNull() & ~F.isnan(c)
    day = lambda c: F.unix_date(F.col(c).cast("date"))
    rows = obs.where(whole).select("x", "y", *more, F.lit(None).cast("double").alias("day"), day("date1").alias("d1"), day("date2").alias("d2"), *[F.col(c).cast("double").alias(c) for c in real])
    if beside is not None:
        zero = F.lit(0.0)
        rows = rows.unionByName(beside.select("x", "y", F.col("day").cast("double").alias("day"), "d1", "d2", "vx", "vy", zero.alias("errorx"), zero.alias("errory")))
    # the number is there for the order: Spark sorts a pixel's rows, beyond memory if need be
    order = W.partitionBy("x", "y").orderBy(F.col("day").asc_nulls_last(), "d1", "d2", *real)
    rows = rows.withColumn("number", F.row_number().over(order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o, pixel, other = Observations(), {}, [np.zeros((5, 0))]
        try:
            for b in batches:
                if not b.num_rows:
                    continue
                pixel = pixel or {c: b.column(c)[0].as_py() for c in ("x", "y", *more)}
                day, d1, d2, vx, vy, ex, ey = (b.column(c).to_numpy(zero_copy_only=False) for c in ("day", "d1", "d2", *real))
                own = np.isnan(day.astype(float))
                if not own.all():
                    other.append(np.stack([c[~own].astype(float) for c in (day, d1, d2, vx, vy)]))
                o.add(d1[own], d2[own], np.stack([vx[own], vy[own]]), np.stack([ex[own], ey[own]]))
            if o.n:
                yield from use(o, pixel, np.concatenate(other, axis=1))
        finally:
            o.close()

    return rows.groupBy("x", "y").applyInArrow(run, schema)


def _parameters(p: Inversion, pixel: dict) -> Inversion:
    """By flag: {flag: {"regu": ..., "coef": ...}}."""
    if not p.by_flag or pixel.get("flag") is None:
        return p
    return Inversion(**{**p.__dict__, **p.by_flag.get(int(pixel["flag"]), {})})


def invert(obs: DataFrame, p: Inversion | None = None, flags: DataFrame | None = None) -> DataFrame:
    """ilf: displacement of every epoch of every pixel. flags(x, y, flag) choose parameters by p.by_flag."""
    p = p or Inversion()
    rows = obs.select(*NEEDED)
    if flags is not None:
        rows = rows.join(F.broadcast(flags.select("x", "y", "flag")) if _small(flags) else flags.select("x", "y", "flag"), ["x", "y"])

    def run(o, pixel, other):
        yield _batch(invert_series(o, pixel["x"], pixel["y"], _parameters(p, pixel))[0], ILF)

    return by_pixel(rows, run, ILF, () if flags is None else ("flag",))


def _small(df: DataFrame, rows: int = 100_000) -> bool:
    """Whether a table has at most so many rows; it reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def invert_with_prior(obs: DataFrame, prior: DataFrame, p: Inversion | None = None) -> DataFrame:
    """ilf with a smoothed field prior(x, y, mid_day, vx, vy), brought to each pixel by one exchange of both."""
    p = p or Inversion()
    none = F.lit(0)
    beside = prior.where("mid_day is not null").select("x", "y", F.col("mid_day").alias("day"), none.alias("d1"), none.alias("d2"), "vx", "vy")

    def run(o, pixel, other):
        yield _batch(invert_series(o, pixel["x"], pixel["y"], p, other[[0, 3, 4]])[0], ILF)

    return by_pixel(obs, run, ILF, beside=beside)


def quality(obs: DataFrame, p: Inversion | None = None) -> DataFrame:
    """One row for each pixel: sizes, iterations, residual norms, and with p.errors the spread and t quantile."""
    p = p or Inversion()

    def run(o, pixel, other):
        _, s = invert_series(o, pixel["x"], pixel["y"], p)
        if s is not None:
            yield _batch(pd.DataFrame([{**pixel, "n_obs": s.n, "n_epoch": len(s.delta), "n_iter": s.iterations, "normr": s.normr, "sigma0_x": s.sigma0[0], "sigma0_y": s.sigma0[1], "t_x": s.t[0], "t_y": s.t[1]}]), QUALITY)

    return by_pixel(obs, run, QUALITY)


DIAGNOSIS = "x double, y double, date1 date, date2 date, vx double, vy double, weightini_x double, weightini_y double, weightlast_x double, weightlast_y double, residu_x double, residu_y double"


def diagnosis(obs: DataFrame, p: Inversion | None = None) -> DataFrame:
    """Weights of the first and last solve and residuals of every observation; NULL where a pixel has no epoch."""
    p = p or Inversion()

    def run(o, pixel, other):
        _, s = invert_series(o, pixel["x"], pixel["y"], p)
        none = lambda b: np.full((2, len(b)), np.nan)
        day = lambda d: pa.array(d.astype(np.int32)).view(pa.date32())
        names = [c.split()[0] for c in DIAGNOSIS.split(", ")]
        for b, *values in s.each() if s is not None else ((b, none(b), none(b), none(b)) for b in o.blocks()):
            columns = [*(np.full(len(b), pixel[c]) for c in "xy"), day(o.d1[b["pair"]]), day(o.d2[b["pair"]]), *b["v"].T, *(c for v in values for c in v)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(np.ascontiguousarray(c), pa.float64(), from_pandas=True) for c in columns], names=names)

    return by_pixel(obs, run, DIAGNOSIS)


def smooth_pixels(obs: DataFrame, method: str = "savgol", t_win: int = 90, sigma: float = 3, order: int = 3, short: int = 180) -> DataFrame:
    """x, y, mid_day, vx, vy: smoothed velocities at the centres of each pixel's epochs (days since 1970).

    Values of one day are averaged before they are smoothed, so a pixel's pairs of dates with their sums are enough."""
    p = Inversion(smoother=method, t_win=t_win, sigma=sigma, order=order, short=short)
    day = lambda c: F.unix_date(F.col(c).cast("date"))
    known = obs.where("date1 is not null and date2 is not null and vx is not null and vy is not null and not isnan(vx) and not isnan(vy)")
    pairs = known.groupBy("x", "y", day("date1").alias("d1"), day("date2").alias("d2")).agg(F.count("*").alias("n"), F.sum("vx").alias("vx"), F.sum("vy").alias("vy"))

    def run(pdf):
        pdf = pdf.sort_values(["d1", "d2"])
        d1, d2 = (pdf[c].to_numpy(np.int64) for c in ("d1", "d2"))
        v = prior_arrays(d1, d2, pdf["n"].to_numpy(), pdf[["vx", "vy"]].to_numpy(float).T, p)
        days = np.unique(np.concatenate([d1, d2]))
        return pd.DataFrame({"x": float(pdf["x"].iloc[0]), "y": float(pdf["y"].iloc[0]), "mid_day": (days[:-1] + days[1:]) / 2, "vx": v[0], "vy": v[1]})

    return pairs.groupBy("x", "y").applyInPandas(run, "x double, y double, mid_day double, vx double, vy double")


def spatial_mean(df: DataFrame, values: list[str], keys: list[str], size: int = 3) -> DataFrame:
    """xi, yi, keys and the mean of values over size x size pixels around each; pixels beyond the edge repeat it.

    Each row goes to its neighbours by offsets, so the join is one exchange on (xi, yi, keys)."""
    half = size // 2
    ends = df.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("xi", "yi") for f in (F.min, F.max)])
    offsets = F.explode(F.sequence(F.lit(-half), F.lit(half)))
    cells = df.select("xi", "yi").distinct()
    around = cells.withColumn("dx", offsets).withColumn("dy", offsets).crossJoin(F.broadcast(ends))  # one row of ends
    clamp = lambda c, d: F.least(F.greatest(F.col(c) + F.col(d), F.col(f"min_{c}")), F.col(f"max_{c}"))
    around = around.select("xi", "yi", clamp("xi", "dx").alias("nx"), clamp("yi", "dy").alias("ny"))
    own = df.select(F.col("xi").alias("nx"), F.col("yi").alias("ny"), *keys, *values)
    return around.join(own, ["nx", "ny"]).groupBy("xi", "yi", *keys).agg(*[F.avg(v).alias(v) for v in values])

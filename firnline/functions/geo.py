"""Map projections as column expressions: polar stereographic and transverse Mercator of the WGS 84 ellipsoid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

A, FLAT = 6378137.0, 1 / 298.257223563
E2 = FLAT * (2 - FLAT)
ECC = math.sqrt(E2)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


class Polar:
    """Polar stereographic with a latitude of true scale (Snyder, 21-33 to 21-41)."""

    def __init__(self, true_lat: float, lon0: float) -> None:
        self.sign = 1 if true_lat > 0 else -1
        lat, self.lon0 = math.radians(abs(true_lat)), math.radians(lon0)
        self.tc = math.tan(math.pi / 4 - lat / 2) / ((1 - ECC * math.sin(lat)) / (1 + ECC * math.sin(lat))) ** (ECC / 2)
        self.mc = math.cos(lat) / math.sqrt(1 - E2 * math.sin(lat) ** 2)

    def forward(self, lon, lat) -> tuple[Column, Column]:
        lat, lon = F.radians(_col(lat)) * self.sign, F.radians(_col(lon))
        s = F.sin(lat) * ECC
        t = F.tan(math.pi / 4 - lat / 2) / F.pow((1 - s) / (1 + s), ECC / 2)
        rho, d = t * (A * self.mc / self.tc), lon - self.lon0
        return rho * F.sin(d), -rho * F.cos(d) * self.sign

    def inverse(self, x, y) -> tuple[Column, Column]:
        x, y = _col(x), _col(y)
        t = F.sqrt(x * x + y * y) * (self.tc / (A * self.mc))
        chi = math.pi / 2 - 2 * F.atan(t)
        lat = chi + _series(chi)
        return F.degrees(F.pmod(F.atan2(x, -y * self.sign) + self.lon0 + math.pi, F.lit(2 * math.pi)) - math.pi), F.degrees(lat) * self.sign


def _series(chi: Column) -> Column:
    """Geodetic less conformal latitude."""
    e4, e6, e8 = E2**2, E2**3, E2**4
    terms = (E2 / 2 + 5 * e4 / 24 + e6 / 12 + 13 * e8 / 360, 7 * e4 / 48 + 29 * e6 / 240 + 811 * e8 / 11520, 7 * e6 / 120 + 81 * e8 / 1120, 4279 * e8 / 161280)
    out = F.lit(0.0)
    for i, c in enumerate(terms):
        out = out + F.sin(chi * (2 * i + 2)) * c
    return out


class Utm:
    """Universal transverse Mercator by Krueger's series in the third flattening."""

    def __init__(self, zone: int, south: bool) -> None:
        n = FLAT / (2 - FLAT)
        self.a = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        self.alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
        self.beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
        self.lon0, self.north = math.radians(6 * zone - 183), 10_000_000.0 if south else 0.0

    def forward(self, lon, lat) -> tuple[Column, Column]:
        lat, d = F.radians(_col(lat)), F.radians(_col(lon)) - self.lon0
        s = F.sin(lat)
        t = F.sinh(F.atanh(s) - ECC * F.atanh(s * ECC))
        xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
        e, n = eta, xi
        for i, c in enumerate(self.alpha, 1):
            e = e + F.cos(xi * (2 * i)) * F.sinh(eta * (2 * i)) * c
            n = n + F.sin(xi * (2 * i)) * F.cosh(eta * (2 * i)) * c
        return e * (0.9996 * self.a) + 500_000.0, n * (0.9996 * self.a) + self.north

    def inverse(self, x, y) -> tuple[Column, Column]:
        xi0, eta0 = (_col(y) - self.north) / (0.9996 * self.a), (_col(x) - 500_000.0) / (0.9996 * self.a)
        xi, eta = xi0, eta0
        for i, c in enumerate(self.beta, 1):
            xi = xi - F.sin(xi0 * (2 * i)) * F.cosh(eta0 * (2 * i)) * c
            eta = eta - F.cos(xi0 * (2 * i)) * F.sinh(eta0 * (2 * i)) * c
        chi = F.asin(F.sin(xi) / F.cosh(eta))
        return F.degrees(F.atan2(F.sinh(eta), F.cos(xi)) + self.lon0), F.degrees(chi + _series(chi))


class LonLat:
    def forward(self, lon, lat):
        return _col(lon), _col(lat)

    inverse = forward


def projection(epsg: int):
    """4326, 3413, 3031, 326xx and 327xx."""
    if epsg == 4326:
        return LonLat()
    if epsg == 3413:
        return Polar(70, -45)
    if epsg == 3031:
        return Polar(-71, 0)
    if 32601 <= epsg <= 32660 or 32701 <= epsg <= 32760:
        return Utm(epsg % 100, epsg > 32700)
    raise ValueError(f"no formulas for EPSG:{epsg}")


def transform(df: DataFrame, source: int, target: int, x: str = "x", y: str = "y", to: tuple[str, str] = ("x_to", "y_to")) -> DataFrame:
    lon, lat = projection(source).inverse(x, y)
    df = df.withColumns({"_lon": lon, "_lat": lat})
    a, b = projection(target).forward("_lon", "_lat")
    return df.withColumns({to[0]: a, to[1]: b}).drop("_lon", "_lat")


def lonlat_grid(df: DataFrame, source: int) -> DataFrame:
    """x, y, lon, lat of the distinct pixels."""
    return transform(df.select("x", "y").distinct(), source, 4326, to=("lon", "lat"))


def reproject_velocity(df: DataFrame, source: int, target: int, unit: int = 365) -> DataFrame:
    """vx and vy in the target's axes: both ends of each displacement are transformed and differenced."""
    moved = lambda c: F.col(c) + F.col(f"v{c}") * F.col("temporal_baseline") / unit
    df = transform(df, source, target, to=("_x0", "_y0")).withColumns({"_xe": moved("x"), "_ye": moved("y")})
    df = transform(df, source, target, "_xe", "_ye", ("_x1", "_y1"))
    back = lambda c: (F.col(f"_{c}1") - F.col(f"_{c}0")) / F.nullif(F.col("temporal_baseline"), F.lit(0)) * unit
    return df.withColumns({"vx": back("x"), "vy": back("y")}).drop("_x0", "_y0", "_x1", "_y1", "_xe", "_ye")


def subset_in(df: DataFrame, epsg: int, box_epsg: int, xmin: float, xmax: float, ymin: float, ymax: float) -> DataFrame:
    """Rows within the bounds of a box's four corners, given in another system; the corners are one row."""
    corners = df.sparkSession.createDataFrame([(float(a), float(b)) for a in (xmin, xmax) for b in (ymin, ymax)], "cx double, cy double")
    ends = transform(corners, box_epsg, epsg, "cx", "cy").agg(F.min("x_to").alias("a"), F.max("x_to").alias("b"), F.min("y_to").alias("c"), F.max("y_to").alias("d"))
    return df.crossJoin(F.broadcast(ends)).where("x between a and b and y between c and d").drop("a", "b", "c", "d")


def profile_points(line: DataFrame, spacing: float) -> DataFrame:
    """distance, x, y every `spacing` along the polyline line(i, x, y): segments by window, points by sequence."""
    from pyspark.sql import Window as W

    by = W.orderBy("i")  # the corners of one line
    seg = line.select("x", "y", F.lead("x").over(by).alias("x2"), F.lead("y").over(by).alias("y2"), "i").where("x2 is not null")
    seg = seg.withColumn("len", F.sqrt(F.pow(F.col("x2") - F.col("x"), 2) + F.pow(F.col("y2") - F.col("y"), 2)))
    seg = seg.withColumn("start", F.sum("len").over(by) - F.col("len"))
    first, last = F.ceil(F.col("start") / spacing), F.ceil((F.col("start") + F.col("len")) / spacing) - 1
    pts = seg.where(first <= last).select("*", F.explode(F.sequence(first, last)).alias("n"))
    t = (F.col("n") * spacing - F.col("start")) / F.col("len")
    return pts.select((F.col("n") * spacing).cast("double").alias("distance"), (F.col("x") + t * (F.col("x2") - F.col("x"))).alias("x"), (F.col("y") + t * (F.col("y2") - F.col("y"))).alias("y"))


def store_url(url: Column | str) -> Column:
    """https://bucket.s3.amazonaws.com/key to s3://bucket/key; other hosts fail."""
    url = _col(url)
    host = F.parse_url(url, F.lit("HOST"))
    bad = F.raise_error(F.concat(F.lit("not a bucket's address: "), url))
    return F.when(host.rlike(r"^[^.]+\.s3(\.[a-z0-9-]+)?\.amazonaws\.com$"), F.concat(F.lit("s3://"), F.split(host, r"\.")[0], F.parse_url(url, F.lit("PATH")))).otherwise(bad)


def granules_at(catalogue: DataFrame, lon: float, lat: float) -> DataFrame:
    """Features of a GeoJSON catalogue (features: properties, geometry of one ring) whose bounds hold a point."""
    one = catalogue.select(F.explode("features").alias("f")).select("f.properties", F.col("f.geometry.coordinates")[0].alias("ring"))
    side = lambda i, f: f(F.transform("ring", lambda p: p[i]))
    return one.where((side(0, F.array_min) <= lon) & (side(0, F.array_max) >= lon) & (side(1, F.array_min) <= lat) & (side(1, F.array_max) >= lat)).select("properties")

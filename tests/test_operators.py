import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from firnline.functions import geo
from firnline.operators import invert as V
from firnline.operators import optimise, outliers, select, series
from firnline.plans import bridge, catalogue
from firnline.sources import loaders

SQL_QUERIES = sorted(catalogue.oracle_sql())


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def table(df):
    df = df.reindex(sorted(df.columns), axis=1)
    show = lambda v: "~" if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)) else f"{v:.4f}" if isinstance(v, (float, np.floating)) else pd.Timestamp(v).isoformat() if hasattr(v, "isoformat") else str(v)
    return list(df.columns), sorted(tuple(map(show, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", SQL_QUERIES)
def test_query_equals_sql(spark, duck, sf, name):
    assert table(catalogue.queries()[name](spark, sf).toPandas()) == table(duck.execute(catalogue.oracle_sql()[name]).df())


@pytest.fixture(scope="session")
def obs(spark, sf):
    return bridge.obs(spark, sf).cache()


def test_bridge_totals(obs):
    r = obs.agg(F.count("*"), F.count("vx"), F.sum("vx"), F.sum("vy"), F.sum("temporal_baseline"), F.sum("errorx")).first()
    np.testing.assert_allclose(list(r), [6000, 5886, 1510176.96673, -96119.516329, 866892, 36275], rtol=1e-9)


def test_inverse_does_not_depend_on_partitioning(obs):
    p = V.Inversion(regu="1", solver="LS")
    a, b = (V.invert(o, p).orderBy("x", "y", "k").toPandas() for o in (obs, obs.repartition(7)))
    pd.testing.assert_frame_equal(a, b)


def test_warm_start_has_the_same_minimum(obs):
    some = obs.where("xi = 1 and yi = 1")
    a, b = (V.invert(some, V.Inversion(solver=s, iterate=False, decorrelation=None)).orderBy("k").toPandas() for s in ("LSMR_ini", "LS"))
    np.testing.assert_allclose(a["result_dx"], b["result_dx"], atol=1e-6)


def test_constant_field_through_the_whole_chain(obs):
    flat = obs.withColumns({"vx": F.lit(100.0), "vy": F.lit(-40.0)})
    rlf = series.resample(V.invert(flat, V.Inversion(regu="1", solver="LS"))).agg(F.min("vx"), F.max("vx"), F.min("vy"), F.max("vy")).first()
    np.testing.assert_allclose(list(rlf), [100, 100, -40, -40], atol=1e-6)


def test_filters_keep_order_free_masks(obs):
    for name in ("z_score", "mz_score", "median_angle", "vvc_angle"):
        f = outliers.FILTERS[name]
        a, b = (f(o).agg(F.sum(F.col("inlier").cast("int")), F.bit_xor(F.xxhash64("x", "date1", "date2", "vx", "inlier"))).first() for o in (obs, obs.orderBy(F.desc("date2"))))
        assert a == b


def test_exempt_pixels_keep_everything(obs):
    still = obs.where("xi = 0").select("x", "y").distinct()
    out = outliers.delete_outliers(obs, {"magnitude": 100.0, "median_angle": 30.0, "median_magnitude": 2.0}, exempt=still)
    a, b = (o.where("xi = 0").agg(F.count("vx")).first()[0] for o in (obs, out))
    assert a == b and out.agg(F.count("vx")).first()[0] < obs.agg(F.count("vx")).first()[0]
    assert outliers.delete_outliers(obs, 5.0).agg(F.max("errorx")).first()[0] > 5


def test_short_series_give_no_windows():
    ilf = pd.DataFrame({"x": [0.0] * 3, "y": [0.0] * 3, "date1": pd.to_datetime(["2020-01-01", "2020-02-01", "2020-03-01"]), "date2": pd.to_datetime(["2020-02-01", "2020-03-01", "2020-04-01"]), "result_dx": [1.0] * 3, "result_dy": [1.0] * 3})
    assert len(series.resample_frame(ilf)) == 0 and len(series.resample_frame(ilf, option="nearest")) > 0
    padded = series.resample_frame(ilf, option="nearest", first="2020-01-01", last="2020-06-01")
    assert padded["vx"].isna().any() and str(padded["date2"].max()) >= "2020-06-01"


def test_pushed_filters(spark, sf):
    plan = bridge.raw(spark, sf).where("temporal_baseline < 100").select("x", "vx")._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "l_tax" not in plan


@pytest.mark.parametrize(("epsg", "lon", "lat"), [(32632, 7.5, 45.9), (32720, -65.0, -20.0), (3413, -40.0, 72.0), (3031, 100.0, -75.0), (4326, 3.0, 4.0)])
def test_projections_round_trip(spark, epsg, lon, lat):
    p = geo.projection(epsg)
    df = spark.createDataFrame([(lon, lat)], "lon double, lat double")
    x, y = p.forward("lon", "lat")
    a, b = p.inverse("x", "y")
    r = df.select(x.alias("x"), y.alias("y")).select("x", "y", a.alias("lon"), b.alias("lat")).first()
    np.testing.assert_allclose([r.lon, r.lat], [lon, lat], atol=1e-8)


def test_projection_values(spark):
    df = spark.createDataFrame([(9.0, 0.0, -45.0, 90.0, 70.0)], "a double, b double, c double, d double, e double")
    x, y = geo.projection(32632).forward("a", "b")
    px, py = geo.projection(3413).forward("c", "d")
    qx, qy = geo.projection(3413).forward("c", "e")
    r = df.select(x, y, px, py, qx, qy).first()
    np.testing.assert_allclose(r[:4], [500000, 0, 0, 0], atol=1e-6)
    # scale is true at 70 degrees: the distance from the pole is the radius of that parallel on WGS 84
    flat = 1 / 298.257223563
    s = np.sin(np.radians(70))
    radius = 6378137 * np.cos(np.radians(70)) / np.sqrt(1 - flat * (2 - flat) * s * s)
    np.testing.assert_allclose(r[4:], [0, -radius], atol=1e-3)
    with pytest.raises(ValueError, match="no formulas"):
        geo.projection(2154)


def test_profile_and_catalogue(spark):
    line = spark.createDataFrame([(0, 0.0, 0.0), (1, 30.0, 40.0), (2, 30.0, 60.0)], "i int, x double, y double")
    got = [tuple(r) for r in geo.profile_points(line, 20.0).orderBy("distance").collect()]
    np.testing.assert_allclose(got, [(0, 0, 0), (20, 12, 16), (40, 24, 32), (60, 30, 50)])
    urls = spark.createDataFrame([("https://data.s3.amazonaws.com/a/b.zarr",)], "u string")
    assert urls.select(geo.store_url("u")).first()[0] == "s3://data/a/b.zarr"
    with pytest.raises(Exception, match="not a bucket"):
        spark.createDataFrame([("https://example.com/a",)], "u string").select(geo.store_url("u")).collect()


def test_loader_registry(spark):
    loaders.register_loader("mine", lambda d: d.withColumns({"vx": F.col("speed"), "vy": F.lit(1.0), "date1": F.to_date("a"), "date2": F.to_date("b"), "sensor": F.lit("S"), "source": F.lit("T")}))
    r = loaders.load(spark.createDataFrame([(2.0, "2020-01-01", "2020-01-13")], "speed double, a string, b string"), "mine").first()
    assert r.temporal_baseline == 12 and r.errorx == 1.0
    with pytest.raises(ValueError, match="missing"):
        loaders.load(spark.range(1))


def test_ring_and_nearest(spark):
    df = spark.createDataFrame([(float(x), float(y)) for x in range(5) for y in range(5)], "x double, y double")
    ring = [(0.5, 0.5), (3.5, 0.5), (3.5, 3.5), (2.5, 1.5), (0.5, 3.5)]
    got = {(r.x, r.y) for r in select.mask_polygon(df, ring).collect()}
    assert (2.0, 3.0) not in got and (1.0, 1.0) in got and (3.0, 1.0) in got
    assert select.nearest_pixel(df, 2.4, 3.6).collect() == [(2.0, 4.0)]


def test_selection_by_direction(spark):
    m = spark.createDataFrame([(0.0, 0.0, float(c), v) for c, v in ((10, 0.5), (20, 0.8), (30, 0.9), (40, 0.91))], "x double, y double, coef double, measure double")
    r = optimise.select_coefs(m, "vvc", "vvc_angle_thresh", threshold=0.5, mean_angle=0.3).first()
    assert r.best_coef == 40 and r.good_coefs[-1] == 40
    s = optimise.select_coefs(m, "stable_ground", "min-max relative", 50.0).first()
    assert s.best_coef == 10 and s.good_coefs == [10.0]


@pytest.mark.parametrize("name", ["invert_l1", "invert_directionxy", "coef_sweep_stable", "coef_saturation"])
def test_queries_take_every_pixel_and_default_iterations(spark, sf, monkeypatch, name):
    used = []
    monkeypatch.setattr(catalogue.V, "invert", lambda obs, p: used.append(p) or obs)  # what reaches the kernels
    monkeypatch.setattr(catalogue.O, "sweep", lambda obs, coefs, method, p: used.append(p) or obs)
    monkeypatch.setattr(catalogue.O, "saturation_coef", lambda curve: curve)
    got = catalogue.queries()[name](spark, sf)
    assert got.select("x", "y").distinct().count() == 40 and got.count() == catalogue.bridge.obs(spark, sf).count()
    assert [p.most_iterations for p in used] == [catalogue.V.Inversion().most_iterations]


def test_a_worker_grows_little_with_the_observations_of_a_pixel(spark):
    """One pixel with 600,000 observations of a few dates: the worker's memory stays far below what they take."""
    from pyspark.sql import functions as F

    from firnline.operators import invert as V

    day = lambda c: F.date_add(F.lit("2000-01-01").cast("date"), c)
    n = F.col("id")
    obs = spark.range(600_000).select(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), day((n % 20 * 12).cast("int")).alias("date1"), day((n % 20 * 12 + n % 3 * 12 + 12).cast("int")).alias("date2"), (50 + F.rand(1)).alias("vx"), (20 + F.rand(2)).alias("vy"), F.lit(1.0).alias("errorx"), F.lit(1.0).alias("errory"))

    def used(o, pixel, other):
        import resource

        import pyarrow as pa

        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        s = V.invert_series(o, pixel["x"], pixel["y"], V.Inversion(regu="1", solver="LS"))[1]
        grown = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before
        yield pa.RecordBatch.from_arrays([pa.array([float(s.n)]), pa.array([float(o.file._rolled)]), pa.array([grown / 1024])], names=["n", "rolled", "grown"])

    row = V.by_pixel(obs, used, "n double, rolled double, grown double").first()
    assert row.n == 600_000 and row.rolled and row.grown < 60


@pytest.mark.parametrize("name", ["dropna_rows", "heatmap_mean", "heatmap_median"])
def test_filters_do_not_compute_velocities_anew(spark, sf, name):
    """A filter below the columns that it tests would hold their expressions, some of them several times."""
    from firnline.plans import catalogue

    plan = catalogue.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "SIN(" in line]

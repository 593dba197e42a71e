import numpy as np
import pytest
from pyspark.sql import functions as F

from firnline import api
from firnline.functions import kernels as K
from firnline.operators import invert as V
from firnline.operators import views
from firnline.plans import bridge

EXACT = V.Inversion(regu="1", solver="LS")


@pytest.fixture(scope="module")
def obs(spark, sf):
    return bridge.obs(spark, sf).where("xi < 3 and yi < 3").cache()


def test_chain_and_one_pixel(obs):
    chain = api.Chain(outliers={"mz_score": 3.5}, smooth="gaussian")
    rlf = api.process(obs, chain)
    assert rlf.select("x", "y").distinct().count() == 9 and rlf.where("vx is null").count() == 0
    got = api.one_pixel(obs, 500110.0, 4999890.0, chain, halo=150)
    assert [tuple(r) for r in got["invert"].select("x", "y").distinct().collect()] == [(500100.0, 4999900.0)]
    assert got["interp"].count() > 0 and api.process(obs, chain, "raw").count() == obs.count()


def test_sql_surface(spark, obs):
    api.register_sql(spark)
    obs.select(*V.NEEDED).createOrReplaceTempView("some_obs")
    a = spark.sql("SELECT * FROM invert(TABLE(some_obs) PARTITION BY (x, y))").orderBy("x", "y", "k").toPandas()
    b = V.invert(obs, EXACT).orderBy("x", "y", "k").toPandas()
    np.testing.assert_allclose(a["result_dx"].astype(float), b["result_dx"].astype(float))


def test_views(obs):
    ilf = V.invert(obs, EXACT).cache()
    back = views.reconstruction(obs, ilf)
    want = V.diagnosis(obs, EXACT).select("x", "y", "date1", "date2", "vx", "residu_x")
    got = back.join(want, ["x", "y", "date1", "date2", "vx"]).select(F.max(F.abs(F.col("residual_vx") * F.datediff("date2", "date1") / 365 - F.col("residu_x")))).first()[0]
    assert got < 1e-6
    assert views.overlay(obs, ilf, "invert").select("layer").distinct().count() == 2
    assert views.direction_view(obs).where("direction < 0 or direction >= 360").count() == 0
    p = V.Inversion(regu="1", solver="LS", errors=True)
    from firnline.operators import series

    assert views.confidence_view(series.resample(V.invert(obs, p)), V.quality(obs, p)).where("interval >= 0").count() > 0
    assert views.annual_curves(views.cumulative_view(ilf), "dv", normalise=True).where("v < 0 or v > 1").count() == 0


def test_diagnostics():
    lo, hi = np.array([0, 0, 1, 0, 2]), np.array([1, 2, 2, 3, 3])
    y, w, mu = np.array([1.0, 2.1, 0.9, 3.3, 1.2]), np.ones(5), K.regularisation("1", np.array([10.0, 20, 10]))
    h = K.hat_matrix(lo, hi, w, mu, 2.0)
    r = y - K.forward(lo, hi, K.solve(lo, hi, y, w, mu, 2.0))
    np.testing.assert_allclose(y - h @ y, r, atol=1e-9)
    assert K.cross_validation(h, r, w) > 0 and np.isfinite(K.studentised(h, r, w, external=True)).all()
    assert K.system_properties(lo, hi, w, mu, 2.0)["convex"]

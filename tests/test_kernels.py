import numpy as np
import pytest

from firnline.functions import kernels as K
from firnline.operators import invert
from firnline.operators.invert import Inversion, invert_arrays

DELTA = np.array([16, 16, 65, 24, 31, 64, 8, 8.0])
LO, HI = np.array([(0, 1), (0, 1), (0, 2), (1, 2), (1, 2), (0, 5), (0, 6), (3, 4), (0, 7), (0, 8)]).T
Y = np.array([4, 5, 9, 4, 3, 40, 60, 7, 62, 66.0])
GOLD = {
    1: (
        [4.747835, 3.751855, 15.511941, 6.996986, 8.993249, 19.962526, 2.098389, 3.908929],
        [0.270791, 0.893908, 0.616745, 0.897172, 0.265436, 0.999994, 0.997826, 0.999984, 0.993251, 0.998628],
        [5.771143, 5.769053, 3.989699, 4.989684, 3.989699, 2.989705, 1.991879, 0.998628],
    ),
    100: (
        [4.291799, 4.284171, 17.548879, 6.617537, 8.737743, 18.539277, 2.331909, 2.340283],
        [0.988575, 0.933648, 0.975951, 0.989163, 0.7904, 0.726923, 0.999949, 0.980413, 0.983461, 0.782902],
        [6.391409, 6.248749, 3.493235, 4.473648, 3.493235, 2.766312, 1.766363, 0.782902],
    ),
}


@pytest.mark.parametrize("coef", [1, 100])
def test_golden_network(coef):
    x = K.solve(LO, HI, Y, np.ones(10), K.regularisation("1", DELTA), coef)
    w = K.robust_weights(Y - K.forward(LO, HI, x))
    for got, want in zip((x, w, K.right_side(LO, HI, w, 8)), GOLD[coef], strict=True):
        np.testing.assert_allclose(got, want, atol=1e-6)


def test_normal_matrix_is_the_dense_one():
    a = np.array([[lo <= k < hi for k in range(8)] for lo, hi in zip(LO, HI, strict=True)], float)
    w = np.linspace(0.1, 1, 10)
    np.testing.assert_allclose(K.normal_matrix(LO, HI, w, 8), a.T @ np.diag(w) @ a)
    np.testing.assert_allclose(K.right_side(LO, HI, w, 8), a.T @ w)
    np.testing.assert_allclose(K.forward(LO, HI, DELTA), a @ DELTA)


@pytest.mark.parametrize("regu", ["1", "2"])
@pytest.mark.parametrize("coef", [1.0, 100.0, 500.0])
def test_constant_velocity_comes_back(regu, coef):
    days = np.concatenate([[0], np.cumsum(DELTA)]).astype(int)
    d1, d2 = days[LO], days[HI]
    v = np.stack([np.full(10, 50.0), np.full(10, -20.0)])
    s = invert_arrays(d1, d2, v, np.ones((2, 10)), Inversion(regu=regu, solver="LS", coef=coef))
    np.testing.assert_allclose(s.x * 365 / s.delta, [[50.0] * 8, [-20.0] * 8], atol=1e-6)


def test_solution_satisfies_the_normal_equations():
    mu, w = K.regularisation("1", DELTA), np.linspace(0.2, 1, 10)
    x = K.solve(LO, HI, Y, w, mu, 30.0)
    r = K.right_side(LO, HI, w * w * (Y - K.forward(LO, HI, x)), 8) - 900 * mu.T @ mu @ x
    assert abs(r).max() < 1e-8


def test_least_absolute_residuals_ignore_an_outlier():
    lo, hi = np.zeros(5, int), np.ones(5, int)
    x = K.solve_l1(lo, hi, np.array([1, 1, 1, 1, 50.0]), np.ones(5), np.zeros((0, 1)), 1.0)
    assert abs(x[0] - 1) < 1e-3


def test_degenerate_networks():
    one = invert_arrays(np.array([0]), np.array([12]), np.array([[10.0], [5.0]]), np.ones((2, 1)), Inversion(regu="1", solver="LS"))
    np.testing.assert_allclose(one.x[:, 0] * 365 / 12, [10, 5])
    assert invert_arrays(np.zeros(0, int), np.zeros(0, int), np.zeros((2, 0)), np.zeros((2, 0)), Inversion()) is None
    assert (K.robust_weights(np.full(5, 3.0)) == 1).all()
    assert (K.initial_weights(np.full(4, 2.0), np.arange(4), True, False, None) == 1).all()
    with pytest.raises(ValueError, match="regularisation"):
        K.regularisation("3", DELTA)


def test_cubic_reproduces_cubics():
    x, at = np.arange(8.0) ** 1.3, np.linspace(-1, 15, 40)
    np.testing.assert_allclose(K.cubic(x, x**3 - 2 * x * x + 1, at), at**3 - 2 * at * at + 1, atol=1e-9)
    assert K.nearest(np.array([0.0, 10]), np.array([1.0, 2]), np.array([5.0, 5.1, -3, 30])).tolist() == [1, 2, 1, 2]


def test_smoothing_spline_meets_its_target():
    x = np.arange(60.0)
    y = np.sin(x / 8) * 10 + np.random.Generator(np.random.PCG64(1)).normal(size=60)
    r = ((K.smoothing_cubic(x, y, x) - y) ** 2).sum()
    assert 50 < r <= 60.01


def test_smoothers():
    v = np.arange(200.0)
    for f in (K.gaussian, K.running_median, K.savgol):
        assert abs(f(np.full(200, 4.0)) - 4).max() < 1e-9
    assert abs(K.savgol(v**2, 91) - v**2).max() < 1e-7
    assert abs(K.lowess(v, 3 * v + 1, 0.3) - (3 * v + 1)).max() < 1e-8
    assert (K.savgol(v[:50], 90) == 0).all()
    t = np.array([0, 0, 50, 100])
    assert abs(K.smooth("gaussian", t, np.array([1.0, 3, 2, 2]), np.array([0, 50])) - 2).max() < 1e-9


def test_t_quantile():
    for freedom, want in ((3, 3.182446), (10, 2.228139), (100, 1.983972)):
        assert abs(K.t_quantile(0.975, freedom) - want) < 1e-5


def test_signals():
    t = np.arange(0, 2000, 5.0)
    amplitude, f, phase, offset, rmse = K.fit_sine(t, 3 * np.sin(2 * np.pi * t / 365.25 + 0.4) + 7)
    np.testing.assert_allclose([amplitude, 1 / f, phase, offset], [3, 365.25, 0.4, 7], atol=1e-6)
    z = np.exp(1j * np.pi * np.array([0.01, 0.2, 0.6]))
    h = abs(np.prod([(b[0] + b[1] / z + b[2] / z**2) / (1 + b[4] / z + b[5] / z**2) for b in K.butterworth(0.1, 0.4)], axis=0))
    assert h[0] < 1e-3 and abs(h[1] - 1) < 1e-2 and h[2] < 0.1
    low = K.run_sections(K.butterworth(None, 0.05), np.sin(t / 300) + 0.3 * np.sin(t * 2))
    assert abs(low[50:-50] - np.sin(t / 300)[50:-50]).max() < 0.05
    c = np.array([1, 10, 50, 100, 500.0])
    assert abs(K.saturation(c, 0.9 * (1 - np.exp(-c / 30)))[1] - 30) < 1


def test_saturation_of_a_curve_that_falls_again():
    c = np.array([1.0, 5, 10, 50, 100, 500])
    v = np.array([0.1, 0.4, 0.6, 0.9, 0.95, 0.8])
    gain, scale, coef = K.saturation(c, v)
    assert gain == 0.95  # the largest, not the last
    model = gain * (1 - np.exp(-c / scale))
    assert coef == c[v > model.max() - 0.05 * (model.max() - model.min())][0]


@pytest.mark.parametrize("p", [Inversion(regu="1", solver="LS", errors=True), Inversion(), Inversion(regu="1", solver="L1", apriori_weight=True, apriori_weight_again=True)])
def test_blocks_in_a_file_give_the_same_series(p, monkeypatch):
    """A pixel's observations read block by block from a file, and medians by counting: as from memory."""
    rng = np.random.default_rng(3)
    d1 = 12 * rng.integers(0, 12, 900)
    d2 = d1 + 12 * rng.integers(1, 6, 900)
    v, error = 50 + rng.normal(size=(2, 900)), rng.uniform(1, 4, (2, 900))
    prior = np.full((2, len(np.unique([*d1, *d2])) - 1), 50.0)
    want = invert_arrays(d1, d2, v, error, p, prior)
    monkeypatch.setattr(invert, "BLOCK", 64)
    monkeypatch.setattr(invert, "HELD", 1000)
    medians = K.medians
    monkeypatch.setattr(K, "medians", lambda parts, n: medians(parts, n, held=40))
    got = invert_arrays(d1, d2, v, error, p, prior)
    assert got.iterations == want.iterations
    for name in ("x", "xcount", "weights", "first_weights", "residual", "normr") + (("error",) if p.errors else ()):
        np.testing.assert_allclose(getattr(got, name), getattr(want, name), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("n", [1000, 1001])
def test_medians_by_counting_are_exact(n):
    rng = np.random.default_rng(n)
    x = np.stack([rng.normal(size=n), rng.integers(-2, 3, n), np.repeat([1.0, -2.0], [n // 2, n - n // 2]), np.zeros(n)])
    assert (K.medians(lambda: iter(np.array_split(x, 7, axis=1)), n, held=50) == np.median(x, axis=1)).all()

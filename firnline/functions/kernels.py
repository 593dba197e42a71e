"""NumPy kernels of one pixel: least squares, robust weights, splines, smoothers and signal functions."""

from __future__ import annotations

import math

import numpy as np

C_TUKEY = 4.685


# ---- linear system ------------------------------------------------------------------------------------------------------
def normal_matrix(lo: np.ndarray, hi: np.ndarray, w2: np.ndarray, k: int) -> np.ndarray:
    """A' W^2 A for rows of consecutive ones: cell (i, j) sums the weights of ranges that hold both, so a 2-D
    difference array and two running sums are enough, in O(n + k^2)."""
    d = np.zeros((k + 1, k + 1))
    np.add.at(d, (lo, lo), w2)
    np.add.at(d, (lo, hi), -w2)
    np.add.at(d, (hi, lo), -w2)
    np.add.at(d, (hi, hi), w2)
    return d.cumsum(0).cumsum(1)[:k, :k]


def right_side(lo: np.ndarray, hi: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """A' v."""
    d = np.zeros(k + 1)
    np.add.at(d, lo, values)
    np.add.at(d, hi, -values)
    return d.cumsum()[:k]


def forward(lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A x."""
    s = np.concatenate([[0.0], np.cumsum(x)])
    return s[hi] - s[lo]


def regularisation(kind: str, delta: np.ndarray) -> np.ndarray:
    """Rows that penalise changes of rate ("1", "1accelnotnull") or of its slope ("2")."""
    k = len(delta)
    if kind in ("1", "1accelnotnull"):
        m = np.zeros((max(k - 1, 0), k))
        i = np.arange(k - 1)
        m[i, i], m[i, i + 1] = -1 / delta[:-1], 1 / delta[1:]
        return m
    if kind == "2":
        m = np.zeros((k, k))
        i = np.arange(1, k - 1)
        m[i, i - 1], m[i, i], m[i, i + 1] = 1 / delta[:-2], -2 / delta[1:-1], 1 / delta[2:]
        return m
    raise ValueError("regularisation is one of '1', '1accelnotnull', '2', 'directionxy'")


def direction_rows(delta: np.ndarray, mean_x: np.ndarray, mean_y: np.ndarray) -> np.ndarray:
    """Rows on both components at once: the rate projected on an a-priori vector, over its squared length."""
    size = np.maximum(mean_x**2 + mean_y**2, 1e-12)
    return np.hstack([np.diag(mean_x / delta / size), np.diag(mean_y / delta / size)])


def solve(lo, hi, y, w, mu, coef, target=None, x0=None, extra=None) -> np.ndarray:
    """Least of |W (A x - y)|^2 + coef^2 |mu x - target|^2, nearest to x0 where that is not unique."""
    k = mu.shape[1]
    return solve_sums(normal_matrix(lo, hi, w * w, k), right_side(lo, hi, w * w * y, k), mu, coef, target, x0, extra)


def solve_sums(normal, right, mu, coef, target=None, x0=None, extra=None) -> np.ndarray:
    """The same from A' W^2 A and A' W^2 y."""
    n = normal + coef**2 * mu.T @ mu
    b = right
    if target is not None:
        b = b + coef**2 * mu.T @ target
    if x0 is not None:
        b = b - n @ x0
    try:
        if extra is not None:
            raise np.linalg.LinAlgError
        factor = np.linalg.cholesky(n)
        if factor.diagonal().min() < 1e-9 * factor.diagonal().max():
            raise np.linalg.LinAlgError
        x = np.linalg.solve(factor.T, np.linalg.solve(factor, b))
    except np.linalg.LinAlgError:
        x = np.linalg.lstsq(n, b, rcond=1e-12)[0]
    return x if x0 is None else x0 + x


def solve_l1(lo, hi, y, w, mu, coef, target=None, rounds: int = 60) -> np.ndarray:
    """Least of the absolute residuals, by reweighted squares."""

    def sums(x):
        w2 = w * w if x is None else absolute_weights(w, y - forward(lo, hi, x))
        return normal_matrix(lo, hi, w2, mu.shape[1]), right_side(lo, hi, w2 * y, mu.shape[1])

    return solve_l1_sums(sums, mu, coef, target, rounds)


def absolute_weights(w: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Squared weights under which squares are absolute residuals."""
    return np.where(w > 0, w / np.maximum(np.abs(w * residual), 1e-6), 0.0)


def solve_l1_sums(sums, mu, coef, target=None, rounds: int = 60) -> np.ndarray:
    """The same from sums(x): A' W^2 A and A' W^2 y under absolute_weights at x, or under the given ones for None."""
    x = solve_sums(*sums(None), mu, coef, target)
    t = np.zeros(mu.shape[0]) if target is None else target
    for _ in range(rounds):
        v = 1 / np.sqrt(np.maximum(np.abs(coef * (mu @ x - t)), 1e-6))
        new = solve_sums(*sums(x), mu * v[:, None] * math.sqrt(coef), 1.0, t * v * math.sqrt(coef))
        if np.abs(new - x).max() < 1e-9:
            break
        x = new
    return x


def biweight(z: np.ndarray, c: float = C_TUKEY) -> np.ndarray:
    return np.where(np.abs(z) <= c, (1 - (z / c) ** 2) ** 2, 0.0)


def robust_weights(residual: np.ndarray) -> np.ndarray:
    scale = np.median(np.abs(residual - np.median(residual))) / 0.6745
    return np.ones(len(residual)) if scale == 0 else biweight(residual / scale)


def initial_weights(error, baseline, apriori: bool, confidence: bool, decorrelation: int | None, ends: tuple | None = None) -> np.ndarray:
    """ends: the least and the largest error of the pixel, if these are not all its observations."""
    low, high = ends or (error.min(), error.max())
    if apriori and not low == high == 1:
        spread = high - low
        w = error.copy() if confidence else np.ones(len(error)) if spread == 0 else 1 - (error - low) / spread
    else:
        w = np.ones(len(error))
    return w if decorrelation is None else w * (baseline <= decorrelation)


def medians(parts, n: int, held: int = 1 << 18) -> np.ndarray:
    """The median of each row of what parts() gives, pieces of n columns in all, exactly and as often as needed anew.

    Up to `held` columns are put together. Of more, the bits of the two middle values are found from the highest on, by
    counts of the values that begin like them; once few do, those are sorted."""
    if n <= held:
        return np.median(np.concatenate(list(parts()), axis=1), axis=1)
    middle = ((n - 1) // 2, n // 2)
    start: dict = {}  # of a row and rank: the bits found, how many, the rank among values that begin so, and how many do
    for x in parts():
        start = {(c, r): (np.uint64(0), 0, r, n) for c in range(len(x)) for r in middle}
        break
    while any(bits < 64 and many > held // 4 for _, bits, _, many in start.values()):
        counts = {at: np.zeros(1 << 16, np.int64) for at in start}
        for x in parts():
            for c, row in enumerate(x):
                key = _sortable(row)
                for (own, r), (head, bits, _, _) in start.items():
                    if own == c and bits < 64:
                        some = key if not bits else key[key >> np.uint64(64 - bits) == head]
                        counts[own, r] += np.bincount((some >> np.uint64(48 - bits) & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16)
        for at, (head, bits, rank, _) in start.items():
            if bits < 64:
                upto = np.cumsum(counts[at])
                b = int(np.searchsorted(upto, rank, "right"))
                start[at] = (head << np.uint64(16) | np.uint64(b), bits + 16, rank - int(upto[b] - counts[at][b]), int(counts[at][b]))
    found: dict = {at: [] for at in start}
    for x in parts():
        for c, row in enumerate(x):
            key = _sortable(row)
            for (own, r), (head, bits, _, _) in start.items():
                if own == c and bits < 64:
                    found[own, r].append(row[key >> np.uint64(64 - bits) == head])
    value = {at: np.sort(np.concatenate(found[at]))[rank] if bits < 64 else _unsorted(head) for at, (head, bits, rank, _) in start.items()}
    return np.array([np.mean([value[c, r] for r in middle]) for c in range(len(start) // len(set(middle)))])


_SIGN = np.uint64(1 << 63)


def _sortable(v: np.ndarray) -> np.ndarray:
    """Numbers in the order of the values."""
    key = np.ascontiguousarray(v, float).view(np.uint64)
    return np.where(key & _SIGN, ~key, key | _SIGN)


def _unsorted(key: np.uint64) -> float:
    return float(np.array([key & ~_SIGN if key & _SIGN else ~key], np.uint64).view(float)[0])


# ---- diagnostics -------------------------------------------------------------------------------------------------------
def hat_matrix(lo, hi, w, mu, coef) -> np.ndarray:
    """Weighted observations to their fitted values: W A (A' W^2 A + coef^2 mu' mu)^-1 A' W."""
    k = mu.shape[1]
    a = ((np.arange(k) >= lo[:, None]) & (np.arange(k) < hi[:, None])) * w[:, None]
    return a @ np.linalg.pinv(normal_matrix(lo, hi, w * w, k) + coef**2 * mu.T @ mu, hermitian=True) @ a.T


def cross_validation(hat: np.ndarray, residual: np.ndarray, w: np.ndarray) -> float:
    """Generalised cross-validation score of a weighted fit."""
    n = len(residual)
    return float(n * ((w * residual) ** 2).sum() / max(n - hat.trace(), 1e-12) ** 2)


def studentised(hat: np.ndarray, residual: np.ndarray, w: np.ndarray, external: bool = False) -> np.ndarray:
    """Residuals over their standard deviations; external: each deviation without the observation itself."""
    r, free = w * residual, max(len(residual) - hat.trace(), 1e-12)
    left = np.maximum(1 - hat.diagonal(), 1e-12)
    spread = (r**2).sum() / free
    if external:
        spread = np.maximum((free * spread - r**2 / left) / max(free - 1, 1e-12), 1e-30)
    return r / np.sqrt(np.maximum(spread, 1e-30) * left)


def system_properties(lo, hi, w, mu, coef) -> dict:
    """Condition and rank of the normal matrix, and whether the objective is strictly convex."""
    n = normal_matrix(lo, hi, w * w, mu.shape[1]) + coef**2 * mu.T @ mu
    values = np.linalg.eigvalsh(n)
    return {"rank": int(np.linalg.matrix_rank(n, hermitian=True)), "condition": float(values[-1] / max(values[0], 1e-300)), "convex": bool(values[0] > 1e-12 * values[-1])}


# ---- distribution ------------------------------------------------------------------------------------------------------
def _beta_fraction(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_fraction(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f = c = 1.0
    d = 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            top = 1.0
        elif i % 2 == 0:
            top = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            top = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + top * d) or 1e-30)
        c = (1 + top / c) or 1e-30
        f *= c * d
        if abs(1 - c * d) < 1e-13:
            break
    return front * (f - 1)


def t_quantile(p: float, freedom: float) -> float:
    """Quantile of Student's distribution for p > 1/2, by bisection."""
    if freedom <= 0:
        return float("nan")
    low, high = 0.0, 1e4
    for _ in range(120):
        mid = (low + high) / 2
        cdf = 1 - 0.5 * _beta_fraction(freedom / 2, 0.5, freedom / (freedom + mid * mid))
        low, high = (mid, high) if cdf < p else (low, mid)
    return (low + high) / 2


# ---- splines -----------------------------------------------------------------------------------------------------------
def cubic(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Not-a-knot cubic through at least four points; the end pieces go on beyond the ends."""
    n = len(x)
    h, s = np.diff(x), np.diff(y) / np.diff(x)
    a = np.zeros((3, n))  # bands of the system for the slopes
    b = np.zeros(n)
    a[0, 2:] = h[:-1]
    a[1, 1:-1] = 2 * (h[:-1] + h[1:])
    a[2, :-2] = h[1:]
    b[1:-1] = 3 * (h[1:] * s[:-1] + h[:-1] * s[1:])
    a[1, 0], a[0, 1] = h[1], h[0] + h[1]
    b[0] = ((h[0] + 2 * (h[0] + h[1])) * h[1] * s[0] + h[0] ** 2 * s[1]) / (h[0] + h[1])
    a[1, -1], a[2, -2] = h[-2], h[-1] + h[-2]
    b[-1] = (h[-1] ** 2 * s[-2] + (2 * (h[-1] + h[-2]) + h[-1]) * h[-2] * s[-1]) / (h[-1] + h[-2])
    for i in range(1, n):  # Thomas; a[0] is above, a[2] below the diagonal
        f = a[2, i - 1] / a[1, i - 1]
        a[1, i] -= f * a[0, i]
        b[i] -= f * b[i - 1]
    d = np.empty(n)
    d[-1] = b[-1] / a[1, -1]
    for i in range(n - 2, -1, -1):
        d[i] = (b[i] - a[0, i + 1] * d[i + 1]) / a[1, i]
    j = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    t = (at - x[j]) / h[j]
    return y[j] * (1 + 2 * t) * (1 - t) ** 2 + h[j] * d[j] * t * (1 - t) ** 2 + y[j + 1] * t * t * (3 - 2 * t) + h[j] * d[j + 1] * t * t * (t - 1)


def smoothing_cubic(x: np.ndarray, y: np.ndarray, at: np.ndarray, target: float | None = None) -> np.ndarray:
    """Natural cubic smoothing spline with the largest penalty whose squared residuals sum to at most `target`
    (the number of points by default)."""
    n = len(x)
    target = float(n) if target is None else target
    h = np.diff(x)
    q, r = np.zeros((n, n - 2)), np.zeros((n - 2, n - 2))
    i = np.arange(n - 2)
    q[i, i], q[i + 1, i], q[i + 2, i] = 1 / h[:-1], -1 / h[:-1] - 1 / h[1:], 1 / h[1:]
    r[i, i] = (h[:-1] + h[1:]) / 3
    r[i[:-1], i[:-1] + 1] = r[i[:-1] + 1, i[:-1]] = h[1:-1] / 6

    def fitted(p):
        return y - p * q @ np.linalg.solve(r + p * q.T @ q, q.T @ y)

    low, high = -12.0, 14.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if ((fitted(10**mid) - y) ** 2).sum() <= target else (low, mid)
    return cubic(x, fitted(10**low), at)


def nearest(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Value of the nearest point; half-way, the earlier one."""
    j = np.clip(np.searchsorted(x, at), 1, len(x) - 1)
    return np.where(at - x[j - 1] <= x[j] - at, y[j - 1], y[j])


INTERPOLATORS = {"spline": cubic, "spline_smooth": smoothing_cubic, "nearest": nearest}


# ---- smoothers: (daily values, window, sigma, order) -> values -----------------------------------------------------------
def _mirror(v: np.ndarray, left: int, right: int) -> np.ndarray:
    """Reflection about the edges, edge values repeated, as often as the window needs."""
    n = len(v)
    i = np.arange(-left, n + right) % (2 * n)
    return v[np.where(i < n, i, 2 * n - 1 - i)]


def gaussian(v, window=90, sigma=3, order=3):
    w = np.exp(-0.5 * (np.arange(-window, window + 1) / sigma) ** 2)
    return np.convolve(_mirror(v, window, window), w / w.sum(), "valid")


def running_median(v, window=90, sigma=3, order=3):
    half = window // 2
    return np.median(np.lib.stride_tricks.sliding_window_view(_mirror(v, half, window - half - 1), window), axis=1)


def savgol(v, window=90, sigma=3, order=3):
    """Local polynomials by least squares; the first and last half window follow the polynomial of the end window.
    A grid shorter than the window gives zeros."""
    if len(v) < window:
        return np.zeros(len(v))
    powers = np.vander(np.arange(window) - (window - 1) / 2, order + 1, increasing=True)
    half, first = window // 2, (window - 1) // 2  # an even window gives its middle to the earlier day
    out = np.empty(len(v))
    out[first : first + len(v) - window + 1] = np.convolve(v, np.linalg.pinv(powers)[0][::-1], "valid")
    head, tail = (np.linalg.lstsq(powers, part, rcond=None)[0] for part in (v[:window], v[-window:]))
    out[:half], out[-half:] = powers[:half] @ head, powers[-half:] @ tail
    return out


def lowess(t: np.ndarray, v: np.ndarray, share: float, rounds: int = 3) -> np.ndarray:
    """Locally weighted lines over the nearest share of points, with robust rounds."""
    n = len(t)
    k = min(n, max(2, int(share * n + 1e-10)))
    robust, out = np.ones(n), np.zeros(n)
    for _ in range(rounds + 1):
        for i in range(n):
            a = max(0, min(i - k // 2, n - k))
            while a + k < n and t[a + k] - t[i] < t[i] - t[a]:
                a += 1
            while a > 0 and t[i] - t[a - 1] < t[a + k - 1] - t[i]:
                a -= 1
            d = np.abs(t[a : a + k] - t[i])
            w = (1 - np.minimum(d / max(d.max(), 1e-12), 1) ** 3) ** 3 * robust[a : a + k]
            total = w.sum()
            if total <= 0:
                out[i] = v[i]
                continue
            mt, mv = (w * t[a : a + k]).sum() / total, (w * v[a : a + k]).sum() / total
            var = (w * (t[a : a + k] - mt) ** 2).sum()
            out[i] = mv + ((w * (t[a : a + k] - mt) * (v[a : a + k] - mv)).sum() / var * (t[i] - mt) if var > 1e-12 else 0.0)
        r = np.abs(v - out)
        s = np.median(r)
        if s == 0:
            break
        robust = np.where(r < 6 * s, (1 - np.minimum(r / (6 * s), 1) ** 2) ** 2, 0.0)
    return out


def independent(v, t=None, seed: int = 0):
    """The first of two independent components of (value, time), scaled back to the values: a fixed-point search from
    a seeded start."""
    n = len(v)
    x = np.vstack([v, np.arange(n) if t is None else t]).astype(float)
    mean = x.mean(1, keepdims=True)
    e, u = np.linalg.eigh(np.cov(x - mean))
    white = (u / np.sqrt(np.maximum(e, 1e-12))).T @ (x - mean)
    w = np.random.Generator(np.random.PCG64(seed)).normal(size=2)
    for _ in range(200):
        w /= np.linalg.norm(w)
        p = w @ white
        new = (white * np.tanh(p)).mean(1) - (1 - np.tanh(p) ** 2).mean() * w
        new /= np.linalg.norm(new)
        if abs(abs(new @ w) - 1) < 1e-9:
            break
        w = new
    s = w @ white
    scale = (s @ (v - v.mean())) / max(s @ s, 1e-12)
    return v.mean() + scale * s


SMOOTHERS = {"gaussian": gaussian, "median": running_median, "savgol": savgol}


def smooth(method: str, t: np.ndarray, v: np.ndarray, t_out: np.ndarray, window: int = 90, sigma: float = 3, order: int = 3) -> np.ndarray:
    """Observations at days t (values at one day are averaged), linearly onto a daily grid, smoothed, at t_out."""
    ok = ~np.isnan(v)
    t, v = t[ok], v[ok]
    if not len(t):
        return np.zeros(len(t_out))
    days, at = np.unique(t, return_inverse=True)
    v = np.bincount(at, v) / np.bincount(at)
    grid = np.arange(days[0], days[-1] + 1)
    if method == "lowess":
        v = lowess(days.astype(float), v, min(1.0, 60 / max(len(grid), 1)))
        daily = np.interp(grid, days, v)
    elif method == "ica":
        daily = np.interp(grid, days, independent(v, days))
    else:
        daily = SMOOTHERS[method](np.interp(grid, days, v), window, sigma, order)
    return daily[np.clip(t_out - grid[0], 0, len(grid) - 1).astype(int)]


# ---- signals -----------------------------------------------------------------------------------------------------------
def butterworth(low: float | None, high: float, order: int = 4) -> list[np.ndarray]:
    """Second-order sections (b0 b1 b2 1 a1 a2) of a digital filter; frequencies are fractions of half the sampling rate."""
    warp = lambda f: 4 * math.tan(math.pi * f / 2)  # noqa: E731  bilinear, at rate 2
    poles = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    if low is None:
        p, z, gain = poles * warp(high), np.zeros(0, complex), warp(high) ** order
    else:
        a, b = warp(low), warp(high)
        bw, w0 = b - a, math.sqrt(a * b)
        half = poles * bw / 2
        root = np.sqrt(half * half - w0 * w0 + 0j)
        p, z, gain = np.concatenate([half + root, half - root]), np.zeros(order, complex), bw**order
    zeros = np.concatenate([(4 + z) / (4 - z), -np.ones(len(p) - len(z))])
    gain = gain * (np.prod(4 - z) / np.prod(4 - p)).real
    p = (4 + p) / (4 - p)
    p = p[np.lexsort([p.real, np.abs(p.imag)])]
    up = p[p.imag > 1e-12]
    real = np.sort(p[np.abs(p.imag) <= 1e-12].real)
    ones, minus = int((zeros.real > 0).sum()), int((zeros.real < 0).sum())
    out = []
    pairs = [(-2 * x.real, abs(x) ** 2) for x in up] + [(-(a + b), a * b) for a, b in zip(real[::2], real[1::2], strict=False)]
    for a1, a2 in pairs:
        if ones and minus:
            num, ones, minus = (1.0, 0.0, -1.0), ones - 1, minus - 1
        elif minus >= 2:
            num, minus = (1.0, 2.0, 1.0), minus - 2
        else:
            num, ones = (1.0, -2.0, 1.0), ones - 2
        out.append(np.array([*num, 1.0, a1, a2]))
    out[0][:3] *= gain
    return out


def run_sections(sections, v: np.ndarray) -> np.ndarray:
    """Forward and backward pass, so nothing is delayed; the ends are mirrored with changed sign."""
    edge = min(len(v) - 1, 3 * (2 * len(sections) + 1))
    x = np.concatenate([2 * v[0] - v[edge:0:-1], v, 2 * v[-1] - v[-2 : -edge - 2 : -1]]) if edge > 0 else v
    for _ in range(2):
        for b0, b1, b2, _, a1, a2 in sections:
            y = np.empty(len(x))
            # start as if the first value had always been there
            level = x[0] * (b0 + b1 + b2) / (1 + a1 + a2)
            s2 = b2 * x[0] - a2 * level
            s1 = b1 * x[0] - a1 * level + s2
            for i, u in enumerate(x):
                o = b0 * u + s1
                s1, s2 = b1 * u - a1 * o + s2, b2 * u - a2 * o
                y[i] = o
            x = y
        x = x[::-1]
    return x[edge : len(x) - edge] if edge > 0 else x


def spectrum(v: np.ndarray, step: float, pad: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and amplitudes of a Hann-windowed series, padded to `pad` times its length."""
    n = len(v)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / max(n - 1, 1))
    a = np.abs(np.fft.rfft((v - v.mean()) * w, pad * n)) * 2 / max(w.sum(), 1e-12)
    return np.fft.rfftfreq(pad * n, step), a


def fit_sine(t: np.ndarray, v: np.ndarray, f: float | None = None, harmonics: int = 1) -> tuple[float, float, float, float, float]:
    """Amplitude, frequency, phase, offset and root mean square error of A sin(2 pi f t + phase) + offset; harmonics
    are fitted besides. A free frequency starts at the spectrum's peak and is refined by Gauss-Newton."""

    def linear(freq):
        m = np.column_stack([np.ones(len(t)), *[g(2 * np.pi * freq * h * t) for h in range(1, harmonics + 1) for g in (np.sin, np.cos)]])
        c = np.linalg.lstsq(m, v, rcond=None)[0]
        return c, v - m @ c

    if f is None:
        step = np.median(np.diff(t)) if len(t) > 1 else 1.0
        grid = np.arange(t[0], t[-1] + step / 2, step)
        freq, amp = spectrum(np.interp(grid, t, v), step)
        f = freq[1:][amp[1:].argmax()]
        for _ in range(30):
            c, r = linear(f)
            slope = 2 * np.pi * t * (c[1] * np.cos(2 * np.pi * f * t) - c[2] * np.sin(2 * np.pi * f * t))
            m = np.column_stack([np.ones(len(t)), np.sin(2 * np.pi * f * t), np.cos(2 * np.pi * f * t), slope])
            move = np.linalg.lstsq(m, r, rcond=None)[0][3]
            f += move
            if abs(move) < 1e-12:
                break
    c, r = linear(f)
    return float(np.hypot(c[1], c[2])), float(f), float(np.arctan2(c[2], c[1])), float(c[0]), float(np.sqrt((r**2).mean()))


def saturation(c: np.ndarray, v: np.ndarray, share: float = 0.95) -> tuple[float, float, float]:
    """gain (the largest value), scale and the first c whose value exceeds what gain (1 - exp(-c / scale)) reaches after
    `share` of its range; NaN if none does."""
    gain, a = float(v.max()), float(max(c[len(c) // 2], 1e-9))
    for _ in range(100):
        e = np.exp(-c / a)
        slope = -gain * e * c / a**2
        move = (slope @ (v - gain * (1 - e))) / max(slope @ slope, 1e-30)
        a = max(a + np.clip(move, -a / 2, a), 1e-9)
        if abs(move) < 1e-10 * a:
            break
    model = gain * (1 - np.exp(-c / a))
    above = np.flatnonzero(v > model.min() + share * (model.max() - model.min()))
    return gain, a, float(c[above[0]]) if len(above) else float("nan")

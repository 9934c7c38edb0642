"""Special functions and small numerical routines on numpy only."""

from __future__ import annotations

import math

import numpy as np

_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: np.ndarray | float) -> np.ndarray:
    """log Gamma for positive arguments (Lanczos)."""
    x = np.asarray(x, float) - 1.0
    s = np.full_like(x, _LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        s = s + c / (x + i)
    t = x + 7.5
    return 0.5 * math.log(2 * math.pi) + (x + 0.5) * np.log(t) - t + np.log(s)


def _shifted(x: np.ndarray | float, step, tail) -> np.ndarray:
    """Recurrence up to 12, then an asymptotic series."""
    x = np.atleast_1d(np.asarray(x, float)).copy()
    out = np.zeros_like(x)
    while (low := x < 12).any():
        out[low] += step(x[low])
        x[low] += 1
    return out + tail(x)


def digamma(x: np.ndarray | float) -> np.ndarray:
    tail = lambda z: np.log(z) - 1 / (2 * z) - 1 / (12 * z**2) + 1 / (120 * z**4) - 1 / (252 * z**6) + 1 / (240 * z**8)
    return _shifted(x, lambda z: -1 / z, tail)


def trigamma(x: np.ndarray | float) -> np.ndarray:
    tail = lambda z: 1 / z + 1 / (2 * z**2) + 1 / (6 * z**3) - 1 / (30 * z**5) + 1 / (42 * z**7) - 1 / (30 * z**9)
    return _shifted(x, lambda z: 1 / z**2, tail)


def tetragamma(x: np.ndarray | float) -> np.ndarray:
    tail = lambda z: -1 / z**2 - 1 / z**3 - 1 / (2 * z**4) + 1 / (6 * z**6) - 1 / (6 * z**8) + 3 / (10 * z**10)
    return _shifted(x, lambda z: -2 / z**3, tail)


def inverse_trigamma(y: float) -> float:
    """The x > 0 with trigamma(x) = y, by Newton steps on 1/trigamma."""
    if y > 1e7:
        return 1 / math.sqrt(y)
    if y < 1e-6:
        return 1 / y
    x = 0.5 + 1 / y
    for _ in range(60):
        t = float(trigamma(x)[0])
        step = t * (1 - t / y) / float(tetragamma(x)[0])
        x += step
        if -step / x < 1e-10:
            break
    return x


def incomplete_beta(a: np.ndarray | float, b: np.ndarray | float, x: np.ndarray | float) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction (modified Lentz)."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    a, b, x = a.ravel().copy(), b.ravel().copy(), np.clip(x.ravel(), 0, 1)
    swap = x > (a + 1) / (a + b + 2)
    a2, b2, x2 = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(log_gamma(a2 + b2) - log_gamma(a2) - log_gamma(b2) + a2 * np.log(x2) + b2 * np.log1p(-x2)) / a2
    tiny = 1e-300
    c, d = np.ones_like(x2), 1 - (a2 + b2) * x2 / (a2 + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (b2 - m) * x2 / ((a2 + 2 * m - 1) * (a2 + 2 * m)), -(a2 + m) * (a2 + b2 + m) * x2 / ((a2 + 2 * m) * (a2 + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    value = np.where((x2 <= 0), 0.0, front * h)
    return np.clip(np.where(swap, 1 - value, value), 0, 1)


def student_t_two_sided(t: np.ndarray | float, df: np.ndarray | float) -> np.ndarray:
    """Two-sided p-values; normal tails for infinite degrees of freedom."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    shape, t, df = t.shape, t.ravel(), df.ravel()
    finite = np.isfinite(df)
    out = 2 * normal_sf(np.abs(t))
    if finite.any():
        out[finite] = incomplete_beta(df[finite] / 2, 0.5, df[finite] / (df[finite] + t[finite] ** 2))
    return out.reshape(shape)


def f_sf(f: np.ndarray | float, d1: float, d2: float) -> np.ndarray:
    f = np.asarray(f, float)
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def normal_pdf(x: np.ndarray | float) -> np.ndarray:
    return np.exp(-0.5 * np.asarray(x, float) ** 2) / math.sqrt(2 * math.pi)


def normal_cdf(x: np.ndarray | float) -> np.ndarray:
    return 1 - normal_sf(x)


def normal_sf(x: np.ndarray | float) -> np.ndarray:
    return np.vectorize(lambda v: 0.5 * math.erfc(v / math.sqrt(2)), otypes=[float])(np.asarray(x, float))


def normal_logcdf(x: np.ndarray | float) -> np.ndarray:
    x = np.asarray(x, float)
    low = x < -20
    with np.errstate(divide="ignore"):
        out = np.log(normal_cdf(np.where(low, 0, x)))
    return np.where(low, -0.5 * x**2 - np.log(np.where(low, -x, 1)) - 0.5 * math.log(2 * math.pi), out)


_MILLS: list[np.ndarray] = []


def inverse_mills(x: np.ndarray) -> np.ndarray:
    """Normal density over distribution function: cubic Hermite interpolation (steps of 1/1024, error below 1e-13), far tails by series."""
    if not _MILLS:
        at = np.arange(-36 * 1024, 40 * 1024 + 2) / 1024
        m = np.array([math.exp(-0.5 * v * v) * math.sqrt(2 / math.pi) / math.erfc(-v / math.sqrt(2)) for v in at])
        d = -m * (at + m) / 1024
        _MILLS.append(np.stack([m, d, np.append(3 * np.diff(m) - 2 * d[:-1] - d[1:], 0.0), np.append(d[:-1] + d[1:] - 2 * np.diff(m), 0.0)], axis=1))
    x = np.asarray(x, float)
    place = (np.clip(x, -36.0, 40.0) + 36.0) * 1024
    i = place.astype(np.int32)
    t = place - i
    c = np.take(_MILLS[0], i, axis=0)
    out = ((c[..., 3] * t + c[..., 2]) * t + c[..., 1]) * t + c[..., 0]
    far = x < -36.0
    if far.any():
        u = 1 / x[far] ** 2
        out[far] = -x[far] / (1 - u * (1 - 3 * u * (1 - 5 * u * (1 - 7 * u * (1 - 9 * u)))))
    return out


def normal_quantile(p: np.ndarray | float) -> np.ndarray:
    """Inverse normal distribution function: bisection start, Newton finish."""
    p = np.atleast_1d(np.asarray(p, float))
    lo, hi = np.full(p.shape, -40.0), np.full(p.shape, 40.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = normal_cdf(mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return np.where(p <= 0, -np.inf, np.where(p >= 1, np.inf, (lo + hi) / 2))


# ---- reproducible draws ------------------------------------------------------------------------------------------------


def uniforms(seed: int, index: np.ndarray) -> np.ndarray:
    """Counter-based uniforms in (0, 1): draw ``i`` depends on the seed and ``i`` only (SplitMix64, 52-bit midpoints)."""
    z = (np.uint64(seed & (2**64 - 1)) + (np.asarray(index, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52


def normals(seed: int, index: np.ndarray) -> np.ndarray:
    """Counter-based normal draws: index pairs (2k, 2k+1) share one Box-Muller transform."""
    index = np.asarray(index, dtype=np.int64)
    pair = index // 2
    u, v = uniforms(seed, 2 * pair), uniforms(seed, 2 * pair + 1)
    r = np.sqrt(-2 * np.log(u))
    return r * np.where(index % 2 == 0, np.cos(2 * np.pi * v), np.sin(2 * np.pi * v))


# ---- smoothing and fits --------------------------------------------------------------------------------------------------


def lowess(x: np.ndarray, y: np.ndarray, span: float = 2 / 3, rounds: int = 3) -> np.ndarray:
    """Locally weighted linear fit with robustness rounds, evaluated at x."""
    n = len(x)
    k = min(n, max(2, int(math.ceil(span * n))))
    order = np.argsort(x, kind="stable")
    xs, ys, fit, robust = x[order], y[order], np.empty(n), np.ones(n)
    for _ in range(rounds + 1):
        lo = 0
        for i in range(n):
            while lo + k < n and xs[lo + k] - xs[i] < xs[i] - xs[lo]:
                lo += 1
            xx, yy, rr = xs[lo : lo + k], ys[lo : lo + k], robust[lo : lo + k]
            h = max(xs[i] - xx[0], xx[-1] - xs[i])
            w = rr * ((1 - np.clip(np.abs(xx - xs[i]) / h, 0, 1) ** 3) ** 3 if h > 0 else np.ones(len(xx)))
            sw = w.sum()
            if sw <= 0:
                fit[i] = ys[i]
                continue
            mx, my = w @ xx / sw, w @ yy / sw
            var = w @ (xx - mx) ** 2
            fit[i] = my + ((w @ ((xx - mx) * (yy - my))) / var * (xs[i] - mx) if var > 1e-12 * sw else 0.0)
        res = np.abs(ys - fit)
        s = np.median(res)
        if s <= 0:
            break
        robust = (1 - np.clip(res / (6 * s), 0, 1) ** 2) ** 2
    out = np.empty(n)
    out[order] = fit
    return out


def huber_line(x: np.ndarray, y: np.ndarray, k: float = 1.345, rounds: int = 50, tol: float = 1e-8) -> tuple[float, float]:
    """Intercept and slope of a Huber regression by reweighting; (0, 1) for fewer than five points or a degenerate slope."""
    if len(x) < 5 or np.ptp(x) == 0:
        return 0.0, 1.0
    w, a, b = np.ones(len(x)), 0.0, 1.0
    for _ in range(rounds):
        mx, my = w @ x / w.sum(), w @ y / w.sum()
        var = w @ (x - mx) ** 2
        if var <= 0:
            return 0.0, 1.0
        nb = (w @ ((x - mx) * (y - my))) / var
        na = my - nb * mx
        moved = abs(na - a) + abs(nb - b)
        a, b = na, nb
        r = y - a - b * x
        s = np.median(np.abs(r - np.median(r))) / 0.6745
        if s <= 0 or moved < tol:
            break
        u = np.abs(r) / s
        w = np.where(u <= k, 1.0, k / np.maximum(u, k))
    return (a, b) if abs(b) > 1e-6 else (0.0, 1.0)


def two_gaussians(x: np.ndarray, rounds: int = 200, tol: float = 1e-7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and standard deviations of a two-component mixture, the lower mean first (EM from the quartiles)."""
    x = np.asarray(x, float)
    mu, sd = np.quantile(x, [0.25, 0.75]), np.full(2, max(x.std() / 2, 1e-6))
    w, last = np.full(2, 0.5), -np.inf
    for _ in range(rounds):
        dens = w * np.exp(-0.5 * ((x[:, None] - mu) / sd) ** 2) / (sd * math.sqrt(2 * math.pi)) + 1e-300
        like = np.log(dens.sum(axis=1)).sum()
        resp = dens / dens.sum(axis=1, keepdims=True)
        n = resp.sum(axis=0) + 1e-12
        w, mu = n / len(x), (resp * x[:, None]).sum(axis=0) / n
        sd = np.sqrt(np.maximum((resp * (x[:, None] - mu) ** 2).sum(axis=0) / n, 1e-12))
        if abs(like - last) < tol * abs(like):
            break
        last = like
    order = np.argsort(mu)
    return w[order], mu[order], sd[order]

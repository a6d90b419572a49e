"""Distribution functions and small exact tests on NumPy alone, for tables of a few arms."""

from __future__ import annotations

from math import erf, erfc, exp, inf, lgamma, log, log1p, pi, sqrt

import numpy as np


def normal_cdf(x: float) -> float:
    return 0.5 * erfc(-x / sqrt(2))


def normal_ppf(p: float) -> float:
    """Inverse normal by bisection."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if normal_cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def gamma_sf(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = exp(-x + a * log(x) - lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-17 * abs(total):
            k += 1
            term *= x / k
            total += term
        return 1 - front * total
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 1000):
        num = -i * (i - a)
        b += 2
        d = 1 / (num * d + b)
        c = b + num / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def f_sf(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def t_sf2(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def t_ppf(p: float, df: float) -> float:
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_sf2(mid, df) / 2 < p else (lo, mid)
    return (lo + hi) / 2


def chi2_sf(x: float, df: float) -> float:
    return gamma_sf(df / 2, x / 2)


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(120)
_erf = np.vectorize(erf)


def _range_cdf(w: np.ndarray, k: int) -> np.ndarray:
    """Distribution of the range of k standard normal values."""
    z = _NODES * 8.0
    cdf = lambda v: 0.5 * (1 + _erf(v / sqrt(2)))
    dens = np.exp(-z * z / 2) / sqrt(2 * pi)
    inner = np.maximum(cdf(z)[None, :] - cdf(z[None, :] - w[:, None]), 0) ** (k - 1)
    return np.clip(k * 8.0 * (inner * dens * _WEIGHTS).sum(axis=1), 0, 1)


def studentized_range_sf(q: float, k: int, df: float) -> float:
    """Upper tail of the studentised range by quadrature over the scale."""
    if q <= 0:
        return 1.0
    sd = 1 / sqrt(2 * df)
    lo, hi = max(1e-6, 1 - 8 * sd), 1 + 8 * sd
    s = (hi + lo) / 2 + (hi - lo) / 2 * _NODES
    logd = log(2) + df / 2 * log(df / 2) - lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    return float(np.clip(1 - ((hi - lo) / 2 * _WEIGHTS * np.exp(logd) * _range_cdf(q * s, k)).sum(), 0, 1))


def wilcoxon(diff: np.ndarray) -> tuple[float, float | None]:
    """Smaller rank sum and two-sided p: exact for up to 50 untied differences, else normal with tie correction."""
    d = diff[diff != 0]
    n = len(d)
    if not n:
        return 0.0, None
    a = np.abs(d)
    values, inverse, counts = np.unique(a, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    up = float(ranks[d > 0].sum())
    w = min(up, n * (n + 1) / 2 - up)
    if n <= 50 and len(values) == n:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[: len(ways) - r].copy()
        return w, min(1.0, 2 * float(ways[: int(w) + 1].sum()) / 2.0**n)
    var = n * (n + 1) * (2 * n + 1) / 24 - float((counts**3 - counts).sum()) / 48
    return w, 2 * normal_cdf((w - n * (n + 1) / 4) / sqrt(var))


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a 2x2 table."""
    n, r, col = a + b + c + d, a + b, a + c
    lc = lambda m, k: lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1)
    logp = np.array([lc(r, x) + lc(n - r, col - x) - lc(n, col) for x in range(max(0, r + col - n), min(r, col) + 1)])
    own = logp[a - max(0, r + col - n)]
    return float(min(1.0, np.exp(logp[logp <= own + 1e-7]).sum()))


def shapiro_wilk(x: np.ndarray) -> tuple[float, float]:
    """W and p by Royston's approximation (4 to 5,000 values; the polynomial coefficients are his fixed values)."""
    x = np.sort(np.asarray(x, float))
    n = len(x)
    m = np.array([normal_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    mm = float(m @ m)
    u = 1 / sqrt(n)
    a = np.zeros(n)
    c = m / sqrt(mm)
    an = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, c[-1]], u)
    if n > 5:
        an1 = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, c[-2]], u)
        phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * an**2 - 2 * an1**2)
        a[2:-2] = m[2:-2] / sqrt(phi)
        a[-2], a[1] = an1, -an1
    else:
        phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * an**2)
        a[1:-1] = m[1:-1] / sqrt(phi)
    a[-1], a[0] = an, -an
    w = float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum())
    w = min(w, 1 - 1e-15)
    if n <= 11:
        g = -2.273 + 0.459 * n
        mu = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n)
        sd = exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
        y = -log(g - log(1 - w)) if g > log(1 - w) else inf
    else:
        ln = log(n)
        mu = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln)
        sd = exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
        y = log(1 - w)
    return w, 1 - normal_cdf((y - mu) / sd)


def censored_normal_fit(n: float, s: float, q: float, floors: np.ndarray, counts: np.ndarray, shift: float = 0.0) -> tuple[float, float, float]:
    """``mu, sigma, loss`` of a normal sample of which some values are only known to lie at or below a floor.

    n, s and q are count, sum and sum of squares of the exact values. Golden-section rounds over mu and log sigma.
    """
    mean = s / n if n else float(np.average(floors, weights=counts))
    sd = sqrt(max(q / n - mean * mean, 1e-6)) if n else 1.0

    def loss(mu: float, ls: float) -> float:
        sg = exp(ls)
        exact = n * ls + (q - 2 * mu * s + n * mu * mu) / (2 * sg * sg)
        tail = sum(c * log(max(normal_cdf((f - mu) / sg), 1e-300)) for f, c in zip(floors, counts))
        return exact - tail

    mu, ls, step = mean + shift * sd, log(sd) + 0.3 * shift, 0.5
    best = loss(mu, ls)
    while step > 1e-9:
        moved = False
        for dm, dl in ((step * sd, 0), (-step * sd, 0), (0, step), (0, -step)):
            v = loss(mu + dm, ls + dl)
            if v < best - 1e-13:
                mu, ls, best, moved = mu + dm, ls + dl, v, True
        step = step * 1.2 if moved else step / 2
    return mu, exp(ls), best

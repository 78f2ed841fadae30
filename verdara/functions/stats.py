"""Probabilities that Spark SQL lacks, as Arrow-batched scalar functions in constant memory per case.

Binomial tails come from the regularised incomplete beta function by its continued fraction, so their cost grows with the
root of the number of trials and their memory not at all. Densities use deviances instead of factorials and keep
full precision for any size. Cases that occur repeatedly are computed once.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

_TINY = 1e-300
#: log(n!) less Stirling's formula for n from 1 to 15, where the series isn't precise enough; 0 is never asked for.
_SMALL = np.array([0.0] + [math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) for n in range(1, 16)])


def _stirling_rest(n: np.ndarray) -> np.ndarray:
    x = np.maximum(n, 16.0)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / x**2) / x**2) / x**2) / x
    return np.where(n < 16, _SMALL[np.minimum(n, 15).astype(np.int64)], series)


def _deviance(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """x log(x / mean) + mean - x, without cancellation where both are close."""
    with np.errstate(all="ignore"):
        v = (x - mean) / (x + mean)
        total, term, square = (x - mean) * v, 2 * x * v, v * v
        for j in range(1, 40):
            term = term * square
            total = total + term / (2 * j + 1)
        return np.where(np.abs(v) < 0.1, total, x * np.log(np.maximum(x, _TINY) / mean) + mean - x)


def log_binomial(x: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Logarithm of P(Bin(n, p) = x) for whole 0 <= x <= n and 0 < p < 1."""
    x, n, p = np.broadcast_arrays(np.asarray(x, float), np.asarray(n, float), np.asarray(p, float))
    y = n - x
    inside = (x > 0) & (y > 0)
    a, b, m = np.where(inside, x, 1.0), np.where(inside, y, 1.0), np.where(inside, n, 2.0)
    log = _stirling_rest(m) - _stirling_rest(a) - _stirling_rest(b) - _deviance(a, m * p) - _deviance(b, m * (1 - p)) + 0.5 * np.log(m / (2 * math.pi * a * b))
    return np.where(inside, log, np.where(x > 0, n * np.log(p), n * np.log1p(-p)))


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function for whole a, b >= 1, by Lentz' evaluation of the continued fraction."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    swap = x > (a + 1) / (a + b + 2)
    a[swap], b[swap], x[swap] = b[swap].copy(), a[swap].copy(), 1 - x[swap]
    front = np.exp(log_binomial(a, a + b, x)) * b / (a + b)
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
    out, going = d.copy(), np.arange(len(x))
    m = 1
    while len(going) and m < 100_000_000:
        p, q, z = a[going], b[going], x[going]
        for step in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            down, up = 1 + step * d[going], 1 + step / c[going]
            d[going] = 1 / np.where(np.abs(down) < _TINY, _TINY, down)
            c[going] = np.where(np.abs(up) < _TINY, _TINY, up)
            change = d[going] * c[going]
            out[going] *= change
        going = going[np.abs(change - 1) > 1e-15]
        m += 1
    value = np.clip(front * out, 0, 1)
    return np.where(swap, 1 - value, value)


def tail(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P(Bin(n, p) <= k): 1 without trials or from k = n on, 0 below 0; p of 0 and 1 included."""
    k, n, p = (np.asarray(v, float) for v in np.broadcast_arrays(k, n, p))
    out = np.where((n <= 0) | (k >= n) | ((p <= 0) & (k >= 0)), 1.0, 0.0)
    open_ = np.flatnonzero((n > 0) & (k >= 0) & (k < n) & (p > 0) & (p < 1))
    if len(open_):
        cases, back = np.unique(np.stack((k[open_], n[open_], p[open_])), axis=1, return_inverse=True)
        out[open_] = incomplete_beta(cases[1] - cases[0], cases[0] + 1, 1 - cases[2])[back.ravel()]
    return out


def binomial_quantile(u: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Least k with P(Bin(n, p) <= k) >= u, by bisection."""
    low, high = np.full(len(u), -1, np.int64), np.asarray(n, np.int64).copy()
    while (high - low > 1).any():
        middle = (low + high) // 2
        reached = tail(middle, n, p) >= u
        low, high = np.where(reached | (high - low <= 1), low, middle), np.where(reached & (high - low > 1), middle, high)
    return high


def hypergeometric_quantile(u: np.ndarray, total: np.ndarray, marked: int, drawn: np.ndarray) -> np.ndarray:
    """Least x with P(X <= x) >= u for the marked ones among ``drawn`` of ``total``; draws are worked on in runs of bounded size."""
    out = np.zeros(len(u), np.int64)
    at, run = 0, len(u)
    if not marked:
        return out
    while at < len(u):
        t, d = total[at : at + run].astype(float), drawn[at : at + run].astype(float)
        share = np.clip(d / np.maximum(t, 1), 0, 1)
        spread = np.sqrt(marked * share * (1 - share))
        least, most = np.maximum(0, d - (t - marked)), np.minimum(marked, d)
        first = np.maximum(least, np.floor(marked * share - 10 * spread - 40))  # the rest has less than 1e-22 of the mass
        width = int((np.minimum(most, np.ceil(marked * share + 10 * spread + 40)) - first).max()) + 1
        if width * len(t) > 1 << 22 and len(t) > 1:
            run = max(1, (1 << 22) // width)
            continue
        # Neighbours differ by a plain ratio; only the density at the mean is computed on its own.
        x = first[:, None] + np.arange(width)
        step = (x[:, :-1] >= least[:, None]) & (x[:, 1:] <= most[:, None])
        up, down = (marked - x[:, :-1]) * (d[:, None] - x[:, :-1]), x[:, 1:] * (t - marked - d)[:, None] + x[:, 1:] ** 2
        log = np.zeros_like(x)
        np.cumsum(np.log(np.where(step, up, 1.0) / np.where(step, down, 1.0)), 1, out=log[:, 1:])
        middle = np.clip(np.round(marked * share), first, np.minimum(most, first + width - 1))
        q, at_middle = np.clip(share, 1e-12, 1 - 1e-12), (middle - first).astype(np.int64)
        known = log_binomial(middle, marked, q) + log_binomial(d - middle, t - marked, q) - log_binomial(d, t, q)
        fits = (x >= least[:, None]) & (x <= most[:, None])
        cdf = np.cumsum(np.where(fits, np.exp(log - (log[np.arange(len(t)), at_middle] - known)[:, None]), 0.0), 1)
        out[at : at + run] = np.minimum(first + (cdf < np.minimum(u[at : at + run], 1 - 1e-12)[:, None]).sum(1), most)
        at += len(t)
    return out


def uniform(keys: list[str]) -> np.ndarray:
    """The numbers in (0, 1) that ``guarantee.draw`` takes from the same keys."""
    return np.array([(int(hashlib.md5(k.encode()).hexdigest()[:8], 16) + 0.5) / 4294967296.0 for k in keys])


@F.pandas_udf(DoubleType())
def binomial_tail(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series(tail(k.to_numpy(), n.to_numpy(), p.to_numpy()))


@F.pandas_udf(StructType([StructField("low", DoubleType()), StructField("high", DoubleType())]))
def clopper_pearson(k: pd.Series, n: pd.Series, alpha: pd.Series) -> pd.DataFrame:
    """Exact interval of a share of k in n; NULL without trials or with k outside 0 to n."""
    k_, n_, a = k.to_numpy(float), n.to_numpy(float), alpha.to_numpy(float)
    sound = (n_ > 0) & (k_ >= 0) & (k_ <= n_)
    ends = []
    for count, upper in ((k_ - 1, False), (k_, True)):  # P(X >= k) at the lower end and P(X <= k) at the upper one are alpha / 2
        low, high = np.zeros(len(k_)), np.ones(len(k_))
        for _ in range(60):
            middle = (low + high) / 2
            below = tail(count, n_, middle)
            right = below > a / 2 if upper else 1 - below < a / 2
            low, high = np.where(right, middle, low), np.where(right, high, middle)
        ends.append(np.where(sound, np.where(count < 0, 0.0, np.where(count >= n_, 1.0, high)), np.nan))
    return pd.DataFrame({"low": ends[0], "high": ends[1]}).astype(object).where(np.isfinite(np.stack(ends, 1)), None)


@F.pandas_udf(DoubleType())
def upper_bound(k: pd.Series, n: pd.Series, delta: pd.Series) -> pd.Series:
    """Clopper-Pearson upper limit of a share, by bisection on the tail; 1 where k is outside 0 to n - 1."""
    a, b, d = (s.to_numpy(float) for s in (k, n, delta))
    low, high = np.zeros(len(a)), np.ones(len(a))
    for _ in range(60):
        middle = (low + high) / 2
        above = tail(a, b, middle) > d
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return pd.Series(np.where((a >= 0) & (a < b), high, 1.0))


@F.pandas_udf(DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    return x.map(math.erfc)

"""Distribution functions over numpy arrays, from power series and continued fractions.

Missing arguments and those outside of a function's domain give NaN, which the SQL functions return as missing.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd

_EPS = 1e-16


def log_gamma(z: np.ndarray) -> np.ndarray:
    """Stirling's series, after the recurrence has brought z to 12 or more."""
    z = np.asarray(z, float).copy()
    product = np.ones_like(z)
    while (low := z < 12).any():
        product[low] *= z[low]
        z[low] += 1
    w = 1 / (z * z)
    tail = (1 / 12 - w * (1 / 360 - w * (1 / 1260 - w * (1 / 1680 - w * (1 / 1188 - w * 691 / 360360))))) / z
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + tail - np.log(product)


def _settled(value_at: Callable[[int], np.ndarray]) -> np.ndarray:
    """A continued fraction, cut at twice the depth until its values stay."""
    depth, before = 32, value_at(16)
    while True:
        now = value_at(depth)
        if depth >= 1 << 17 or not (np.abs(now - before) > 4 * _EPS * np.abs(now)).any():
            return now
        depth, before = 2 * depth, now


def gamma_tails(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The regularised lower and upper incomplete gamma functions, each precise where it is small."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    lower = np.array(np.where((a > 0) & (x <= 0), 0.0, np.nan))
    upper = np.array(1 - lower)
    inside = (a > 0) & (x > 0)
    with np.errstate(all="ignore"):
        for small in (True, False):
            at = np.flatnonzero(inside & ((x <= a + 1) == small))
            if not len(at):
                continue
            s, v = a.flat[at], x.flat[at]
            weight = np.exp(s * np.log(v) - v - log_gamma(s + 1))  # the density's power and exponential, over a
            if small:  # 1 + v/(s+1) + v^2/((s+1)(s+2)) + ...
                term, total, k = np.ones_like(v), np.ones_like(v), 0
                while (term > _EPS * total).any():
                    k += 1
                    term = term * v / (s + k)
                    total = total + term
                lower.flat[at] = np.minimum(weight * total, 1)
                upper.flat[at] = 1 - lower.flat[at]
            else:  # v+1-s - 1(1-s)/(v+3-s - 2(2-s)/(v+5-s - ...)), from its inner end

                def fraction(depth: int, s=s, v=v) -> np.ndarray:
                    out = v + 2 * depth + 1 - s
                    for k in range(depth, 0, -1):
                        out = v + 2 * k - 1 - s - k * (k - s) / out
                    return out

                upper.flat[at] = np.where(np.isinf(v), 0.0, weight * s / _settled(fraction))
                lower.flat[at] = 1 - upper.flat[at]
    return lower, upper


def beta_inc(a, b, x) -> np.ndarray:
    """The regularised incomplete beta function; its argument is mirrored to where the fraction settles fast."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x))))
    ok = (a > 0) & (b > 0)
    out = np.array(np.where(ok & (x <= 0), 0.0, np.where(ok & (x >= 1), 1.0, np.nan)))
    at = np.flatnonzero(ok & (x > 0) & (x < 1))
    if len(at):
        p, q, v = a.flat[at], b.flat[at], x.flat[at]
        turn = v * (p + q + 2) > p + 1
        p, q, v = np.where(turn, q, p), np.where(turn, p, q), np.where(turn, 1 - v, v)
        weight = np.exp(p * np.log(v) + q * np.log1p(-v) + log_gamma(p + q) - log_gamma(p + 1) - log_gamma(q))

        def fraction(depth: int) -> np.ndarray:
            out = np.zeros_like(v)
            for k in range(depth, -1, -1):  # coefficients come in pairs, the odd one inside
                even = k * (q - k) / ((p + 2 * k - 1) * (p + 2 * k)) if k else 0.0
                odd = -(p + k) * (p + q + k) / ((p + 2 * k) * (p + 2 * k + 1))
                out = odd * v / (1 + out)
                if k:
                    out = even * v / (1 + out)
            return 1 + out

        value = weight / _settled(fraction)
        out.flat[at] = np.where(turn, 1 - value, value)
    return out


def probnorm(x) -> np.ndarray:
    x = np.asarray(x, float)
    lower, upper = gamma_tails(np.full(x.shape, 0.5), x * x / 2)
    return np.where(x < 0, upper / 2, (1 + lower) / 2)


def probit(p) -> np.ndarray:
    """Halley's steps on the smaller tail, from a first guess by its logarithm."""
    p = np.asarray(p, float)
    tail = np.where((p > 0) & (p < 1), np.minimum(p, 1 - p), np.nan)
    t = np.sqrt(-2 * np.log(tail))
    z = np.maximum(t - (2.30753 + 0.27061 * t) / (1 + t * (0.99229 + 0.04481 * t)), 0)
    for _ in range(5):
        excess = (probnorm(-z) - tail) * np.sqrt(2 * np.pi) * np.exp(z * z / 2)
        z = z + excess / (1 + z * excess / 2)
    return np.where(p < 0.5, -z, z)


def probt(x, df) -> np.ndarray:
    x, df = np.broadcast_arrays(np.asarray(x, float), np.asarray(df, float))
    with np.errstate(divide="ignore", invalid="ignore"):
        tail = beta_inc(df / 2, np.full(x.shape, 0.5), np.where(df > 0, df / (df + x * x), np.nan)) / 2
    return np.where(x > 0, 1 - tail, tail)


def probf(x, a, b) -> np.ndarray:
    x, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, a, b)))
    with np.errstate(invalid="ignore"):
        return beta_inc(a / 2, b / 2, np.where(x <= 0, np.where(np.isnan(x), np.nan, 0.0), a * x / (a * x + b)))


def probchi(x, df) -> np.ndarray:
    return gamma_tails(np.asarray(df, float) / 2, np.asarray(x, float) / 2)[0]


def t_quantile(p: float, df: float) -> float:
    """Newton's steps from the normal quantile; for p above a half they rise to the root, as the distribution is concave there."""
    if p < 0.5:
        return -t_quantile(1 - p, df)
    t = float(probit(p))
    height = float(np.exp(log_gamma(np.array((df + 1) / 2)) - log_gamma(np.array(df / 2)))) / np.sqrt(df * np.pi)
    for _ in range(100):
        step = (p - float(probt(t, df))) / (height * (1 + t * t / df) ** (-(df + 1) / 2))
        t += step
        if abs(step) < 1e-14 * (1 + abs(t)):
            break
    return t


def chi_quantile(p: float, df: float) -> float:
    low, high = 0.0, df + 10.0
    while float(probchi(high, df)) < p:
        low, high = high, 2 * high
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if float(probchi(mid, df)) < p else (low, mid)
    return (low + high) / 2


def register(spark) -> None:
    """The functions as SQL functions over Arrow batches; Spark has none of its own for these."""
    from pyspark.sql.functions import pandas_udf

    def probnorm_(x: pd.Series) -> pd.Series:
        return pd.Series(probnorm(x.to_numpy(float)))

    def probit_(x: pd.Series) -> pd.Series:
        return pd.Series(probit(x.to_numpy(float)))

    def probt_(x: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series(probt(x.to_numpy(float), a.to_numpy(float)))

    def probf_(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(probf(x.to_numpy(float), a.to_numpy(float), b.to_numpy(float)))

    def probchi_(x: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series(probchi(x.to_numpy(float), a.to_numpy(float)))

    for f in (probnorm_, probit_, probt_, probf_, probchi_):
        spark.udf.register(f"rowloom_{f.__name__[:-1]}", pandas_udf(f, "double"))

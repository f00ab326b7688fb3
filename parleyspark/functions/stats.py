"""p-values for already aggregated rows.

Spark has no erfc, lgamma or incomplete beta. These helpers see one row per
comparison, never one per record.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as ST


def log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def _outward(first: float, ratio, count: int) -> float:
    """first * (1 + r(0) + r(0) r(1) + ...), at most count terms more, until terms no longer matter.

    Ratios fall below one and keep falling, so the sum needs a few standard deviations of terms at most.
    """
    total, term, at = first, first, 0
    while at < count and term > 1e-18 * total:
        k = np.arange(at, min(at + 8192, count), dtype=float)
        terms = term * np.cumprod(ratio(k))
        total, term, at = total + float(terms.sum()), float(terms[-1]), at + len(k)
    return total


def binomial_two_sided(k: int, n: int) -> float:
    """Exact two-sided test of k successes in n fair trials."""
    if n == 0:
        return 1.0
    low = min(k, n - k)
    if 2 * low == n:
        return 1.0
    first = math.exp(log_choose(n, low) - n * math.log(2))
    return min(1.0, 2 * _outward(first, lambda i: (low - i) / (n - low + i + 1), low))


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Sum of the tables no more likely than the observed one.

    Probabilities rise to the mode and fall after it: one tail starts at the observed table, the other at the
    first table beyond the mode that is no more likely, found by halving.
    """
    r1, r2, c1 = a + b, c + d, a + c
    total = log_choose(r1 + r2, c1)
    lp = lambda x: log_choose(r1, x) + log_choose(r2, c1 - x) - total
    least, most = max(0, c1 - r2), min(r1, c1)
    observed, mode = lp(a) + 1e-7, (r1 + 1) * (c1 + 1) // (r1 + r2 + 2)

    def edge(inner: int, outer: int) -> int | None:
        """The table nearest to the mode between inner and outer that is no more likely than the observed one."""
        if lp(outer) > observed:
            return None
        while inner != outer:
            half = (inner + outer) // 2 if outer > inner else -(-(inner + outer) // 2)
            if lp(half) <= observed:
                outer = half
            else:
                inner = half + (1 if outer > inner else -1)
        return outer

    mode = min(max(mode, least), most)
    low, high = edge(mode, least), edge(mode, most)
    if low == high and low is not None:  # the mode itself: every table counts
        return 1.0
    tails = 0.0
    if low is not None:
        tails += _outward(math.exp(lp(low)), lambda i: (low - i) * (r2 - c1 + low - i) / ((r1 - low + i + 1) * (c1 - low + i + 1)), low - least)
    if high is not None:
        tails += _outward(math.exp(lp(high)), lambda i: (r1 - high - i) * (c1 - high - i) / ((high + i + 1) * (r2 - c1 + high + i + 1)), most - high)
    return min(1.0, tails)


def chi2_one_df(x: float) -> float:
    return math.erfc(math.sqrt(max(x, 0.0) / 2))


def normal_upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def correlation_p(r: float, n: int) -> float:
    """Two-sided t test of a correlation."""
    if n < 3:
        return 1.0
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    t2 = r * r * df / (1 - r * r)
    return incomplete_beta(df / 2, 0.5, df / (df + t2))


def _series(fn, *cols):
    missing = lambda v: v is None or v != v
    return pd.Series([None if any(missing(v) for v in row) else fn(*row) for row in zip(*cols)], dtype="float64")


@F.pandas_udf(ST.DoubleType())
def binomial_p(k: pd.Series, n: pd.Series) -> pd.Series:
    return _series(lambda a, b: binomial_two_sided(int(a), int(b)), k, n)


@F.pandas_udf(ST.DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return _series(lambda *v: fisher_two_sided(*map(int, v)), a, b, c, d)


@F.pandas_udf(ST.DoubleType())
def chi2_p(x: pd.Series) -> pd.Series:
    return _series(chi2_one_df, x)


@F.pandas_udf(ST.DoubleType())
def upper_normal_p(z: pd.Series) -> pd.Series:
    return _series(normal_upper, z)


@F.pandas_udf(ST.DoubleType())
def corr_p(r: pd.Series, n: pd.Series) -> pd.Series:
    return _series(lambda a, b: correlation_p(float(a), int(b)), r, n)


@F.pandas_udf(ST.StructType([ST.StructField("low", ST.DoubleType()), ST.StructField("high", ST.DoubleType())]))
def bootstrap_ci(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Percentile interval of a share over 4000 resamples of n 0/1 flags.

    A resample of flags depends on (k, n) only, so the flags stay where they
    are and the resampling draws binomial counts.
    """
    import numpy as np

    out = []
    for ki, ni in zip(k, n):
        if not ni:
            out.append((0.0, 0.0))
            continue
        draws = np.random.default_rng(0).binomial(int(ni), ki / ni, size=4000) / ni
        out.append(tuple(np.percentile(draws, [2.5, 97.5])))
    return pd.DataFrame(out, columns=["low", "high"])

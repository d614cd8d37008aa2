"""Distribution functions that Spark lacks: numpy on Arrow batches, for small tables of statistics."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

STANDARD = NormalDist()


def z_of(level: float) -> float:
    """Two-sided normal quantile of a confidence level."""
    return STANDARD.inv_cdf(0.5 + level / 2)


def gamma_cdf(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function: a series below a + 1, a continued fraction above."""
    if not x > 0:
        return 0.0
    if math.isinf(x):
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-17 * abs(total):
            n += 1
            term *= x / n
            total += term
        return min(1.0, front * total)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        k = -i * (i - a)
        b += 2
        d = 1 / ((k * d + b) or tiny)
        c = (b + k / c) or tiny
        h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return 1 - front * h


def chi2_sf(x: float, df: float) -> float:
    return 1.0 if not x > 0 else 1 - gamma_cdf(df / 2, x / 2)


def gamma_quantile(p: float, a: float) -> float:
    """x with gamma_cdf(a, x) = p, by halving."""
    if a <= 0 or p <= 0:
        return 0.0
    low, high = 0.0, max(1.0, a)
    while gamma_cdf(a, high) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if gamma_cdf(a, mid) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def _rowwise(f, *columns: pd.Series) -> pd.Series:
    return pd.Series([None if any(v is None or v != v for v in row) else float(f(*row)) for row in zip(*columns, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def _chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return _rowwise(chi2_sf, x, df)


@F.pandas_udf(DoubleType())
def _norm_cdf(x: pd.Series) -> pd.Series:
    known = x.to_numpy(dtype="float64", na_value=np.nan)
    return pd.Series(0.5 * np.array([math.erfc(v) for v in -known / math.sqrt(2)], dtype="float64")).where(~np.isnan(known))


@F.pandas_udf(DoubleType())
def _norm_quantile(p: pd.Series) -> pd.Series:
    return _rowwise(lambda v: -np.inf if v <= 0 else np.inf if v >= 1 else STANDARD.inv_cdf(v), p)


@F.pandas_udf(DoubleType())
def _gamma_quantile(p: pd.Series, a: pd.Series) -> pd.Series:
    return _rowwise(gamma_quantile, p, a)


def chi2_p(x: Column, df: Column) -> Column:
    """Upper tail of a chi-square statistic."""
    return _chi2_p(x.cast("double"), df.cast("double"))


def norm_cdf(x: Column) -> Column:
    return _norm_cdf(x.cast("double"))


def norm_quantile(p: Column) -> Column:
    return _norm_quantile(p.cast("double"))


def two_sided_p(z: Column) -> Column:
    return 2 * norm_cdf(-F.abs(z))


def gamma_quantile_of(p: Column, a: Column) -> Column:
    return _gamma_quantile(p.cast("double"), a.cast("double"))

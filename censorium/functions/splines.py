"""Spline bases as columns: natural cubic, restricted cubic and penalised B-splines, with knots at exact quantiles.

A basis is a few truncated powers of the value, combined by a small matrix that is worked out on the driver;
evaluation stays in Spark expressions.  Null values give null columns.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from censorium.functions.prefix import running


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float]:
    """Exact quantiles with linear interpolation (type 7): running counts of distinct values by ranges; only the values asked for reach the driver."""
    counts = df.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)").groupBy("v").agg(F.count("*").cast("double").alias("n"))
    run = running(counts, order="v", sums={"upto": F.col("n")})
    n = counts.agg(F.sum("n")).first()[0]
    if not n:
        raise ValueError(f"{column} has no values")
    at = [min(max(s, 0.0), 1.0) * (n - 1) for s in shares]
    places = sorted({float(f(a)) for a in at for f in (math.floor, math.ceil)})
    found = run.withColumn("_k", F.explode(F.array(*(F.lit(k) for k in places)))).where("_k >= upto - n and _k < upto").select("_k", "v").collect()
    value = {r["_k"]: r["v"] for r in found}
    return [value[float(math.floor(a))] * (1 - (a - math.floor(a))) + value[float(math.ceil(a))] * (a - math.floor(a)) for a in at]


def _power(x: Column, knot: float, k: int = 3) -> Column:
    return F.pow(F.greatest(x - float(knot), x * 0.0), F.lit(float(k)))


def _mix(parts: Sequence[Column], weights: Sequence[float]) -> Column:
    return reduce(lambda a, b: a + b, (p * float(w) for p, w in zip(parts, weights, strict=True)))


def natural_parts(x: Column, knots: Sequence[float]) -> list[Column]:
    """1, x and K - 2 cubic pieces that are linear beyond the outer knots."""
    last, before = knots[-1], knots[-2]
    d = lambda k: (_power(x, k) - _power(x, last)) / float(last - k)
    return [x * 0.0 + 1.0, x, *(d(k) - d(before) for k in knots[:-2])]


def _natural_at(v: float, knots: Sequence[float]) -> list[float]:
    up = lambda k: max(v - k, 0.0) ** 3
    d = lambda k: (up(k) - up(knots[-1])) / (knots[-1] - k)
    return [1.0, v, *(d(k) - d(knots[-2]) for k in knots[:-2])]


def natural_slopes(x: Column, knots: Sequence[float]) -> list[Column]:
    """Derivatives of ``natural_parts``."""
    last, before = knots[-1], knots[-2]
    d = lambda k: 3 * (_power(x, k, 2) - _power(x, last, 2)) / float(last - k)
    return [x * 0.0, x * 0.0 + 1.0, *(d(k) - d(before) for k in knots[:-2])]


def natural_knots(df: DataFrame, column: str, *, df_count: int = 3, knots: Sequence[float] = (), boundary: tuple[float, float] | None = None, intercept: bool = False) -> list[float]:
    """Boundary and inner knots: boundaries at the 5 % and 95 % quantiles, inner ones at even quantiles of the values between them; equal knots are one."""
    low, high = boundary or tuple(quantiles(df, column, [0.05, 0.95]))
    if not low < high:
        raise ValueError("boundary knots are two different values")
    inner = [float(k) for k in knots]
    count = df_count - (2 if intercept else 1)
    if count < 0:
        raise ValueError("too few degrees of freedom")
    if not inner and count:
        inside = df.where((F.col(column) > low) & (F.col(column) < high))
        inner = quantiles(inside, column, [(i + 1) / (count + 1) for i in range(count)])
    return sorted({float(low), *inner, float(high)})


def natural_heights(x: Column, knots: Sequence[float], *, intercept: bool = False) -> list[Column]:
    """Natural cubic basis whose coefficients are the heights at the knots; without ``intercept`` the first knot has height 0."""
    inverse = np.linalg.inv(np.array([_natural_at(k, knots) for k in knots]))
    parts = natural_parts(x, knots)
    return [_mix(parts, inverse[:, j]) for j in range(0 if intercept else 1, len(knots))]


def restricted_cubic(x: Column, knots: Sequence[float]) -> list[Column]:
    """K - 2 cubic pieces, linear beyond the outer knots, on the scale of the value cubed."""
    last, before = knots[-1], knots[-2]
    span = last - before
    return [_power(x, k) - _power(x, before) * float((last - k) / span) + _power(x, last) * float((before - k) / span) for k in knots[:-2]]


def bspline(x: Column, *, pieces: int, degree: int = 3, boundary: tuple[float, float]) -> list[Column]:
    """``pieces + degree`` B-splines on even knots, null outside the boundary: differences of truncated powers."""
    low, high = boundary
    width = (high - low) / pieces
    ways = [(-1) ** i * math.comb(degree + 1, i) / math.factorial(degree) for i in range(degree + 2)]
    inside = (x >= float(low)) & (x <= float(high))

    def one(j: int) -> Column:
        u = (x - float(low)) / float(width) - float(j - degree)
        return F.when(inside, _mix([_power(u, i, degree) for i in range(degree + 2)], ways))

    return [one(j) for j in range(pieces + degree)]


def difference_penalty(n: int, order: int = 2) -> np.ndarray:
    """D'D of differences between neighbouring coefficients."""
    d = np.diff(np.eye(n), n=order, axis=0)
    return d.T @ d

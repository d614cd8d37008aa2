"""Flexible parametric models: log cumulative hazard as a natural spline of log time, and penalised spline terms of the Cox model.

Every step of a fit is one aggregation of p + p(p+1)/2 + 1 sums over rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from censorium.functions import splines
from censorium.functions.prefix import cuts_of
from censorium.operators.cox import CoxFit, _rows, _step


@dataclass
class FlexibleFit:
    #: Coefficients of the spline (constant first), then of the covariates.
    coefficients: np.ndarray
    covariance: np.ndarray
    log_likelihood: float
    iterations: int
    knots: list[float]
    names: list[str]

    @property
    def std_errors(self) -> np.ndarray:
        return np.sqrt(np.diag(self.covariance))


def _sum(parts: Sequence[Column], weights: Sequence[float]) -> Column:
    return splines._mix(parts, weights)


def flexible_fit(df: DataFrame, *, time: str, status: str, x: Sequence[str] = (), entry: str | None = None, weight: str | None = None, inner: int = 2, knots: Sequence[float] | None = None, eps: float = 1e-10, most: int = 50) -> FlexibleFit:
    """log H(t | x) = s(log t) + x b with s a natural cubic spline, by Newton steps.

    ``knots`` of log time, or by default the range of log event times and ``inner`` even quantiles between; with no inner knot it
    is the Weibull model.  Rows with a null time, status, covariate or weight, with a time of 0 or less, or with entry >= time drop out;
    a null or negative entry is 0.  A table without events raises ValueError.
    """
    rows = df.dropna(subset=[time, status, *x, *([weight] if weight else [])]).where(F.col(time) > 0)
    if entry:
        rows = rows.where(F.col(entry).isNull() | (F.col(entry) < F.col(time)))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    first = F.when(F.col(entry) > 0, F.log(F.col(entry).cast("double"))) if entry else F.lit(None).cast("double")
    rows = rows.select(F.log(F.col(time).cast("double")).alias("_u"), first.alias("_e"), (F.col(status) != 0).cast("double").alias("_d"), w.alias("_w"), *(F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(x))).persist()
    try:
        events, exposure = rows.agg(F.sum(F.col("_w") * F.col("_d")), F.sum(F.col("_w") * F.exp("_u"))).first()
        if not events:
            raise ValueError("no events")
        if knots is None:
            knots = sorted(set(splines.quantiles(rows.where("_d > 0"), "_u", [i / (inner + 1) for i in range(inner + 2)])))
            if len(knots) < 2:
                knots = [knots[0] - 1, knots[0] + 1]
        k, p = len(knots), len(knots) + len(x)
        cov = [F.col(f"_x{i}") for i in range(len(x))]
        z = splines.natural_parts(F.col("_u"), knots) + cov
        z0 = splines.natural_parts(F.col("_e"), knots) + cov
        slope = splines.natural_slopes(F.col("_u"), knots) + [F.lit(0.0)] * len(x)
        wide = rows.select("_u", "_e", "_d", "_w", *(c.alias(f"z{i}") for i, c in enumerate(z)), *(c.alias(f"s{i}") for i, c in enumerate(slope)), *(c.alias(f"e{i}") for i, c in enumerate(z0)))
        pairs = [(i, j) for i in range(p) for j in range(i, p)]
        col = lambda s: [F.col(f"{s}{i}") for i in range(p)]

        def step(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            eta, rise = _sum(col("z"), beta), _sum(col("s"), beta)
            at = wide.withColumns({"_h": F.exp(eta), "_r": rise, "_h0": F.when(F.col("_e").isNotNull(), F.exp(_sum(col("e"), beta))).otherwise(0.0), "_eta": eta})
            # where the spline falls the likelihood is zero
            ll = F.col("_d") * (F.when(F.col("_r") > 0, F.log("_r")) + F.col("_eta") - F.col("_u")) - F.col("_h") + F.col("_h0")
            late = lambda i: F.coalesce(F.col(f"e{i}"), F.lit(0.0))
            u = [F.col("_d") * (F.col(f"z{i}") + F.col(f"s{i}") / F.col("_r")) - F.col("_h") * F.col(f"z{i}") + F.col("_h0") * late(i) for i in range(p)]
            info = [F.col("_d") * F.col(f"s{i}") * F.col(f"s{j}") / (F.col("_r") * F.col("_r")) + F.col("_h") * F.col(f"z{i}") * F.col(f"z{j}") - F.col("_h0") * late(i) * late(j) for i, j in pairs]
            got = at.agg(F.count_if((F.col("_d") > 0) & (F.col("_r") <= 0)), F.sum(F.col("_w") * ll), *(F.sum(F.col("_w") * c) for c in (*u, *info))).first()
            if got[0]:
                return -np.inf, np.zeros(p), np.eye(p)
            matrix = np.zeros((p, p))
            for (i, j), v in zip(pairs, got[2 + p :], strict=True):
                matrix[i, j] = matrix[j, i] = v
            return got[1], np.array(got[2 : 2 + p]), matrix

        beta = np.zeros(p)
        beta[0], beta[1] = np.log(events / exposure), 1.0
        ll, score, info = step(beta)
        n = 0
        for n in range(1, most + 1):
            move = np.linalg.solve(_lifted(info), score)
            found = step(beta + move)
            while not found[0] >= ll - abs(ll) * eps and np.abs(move).max() > eps:
                move = move / 2
                found = step(beta + move)
            done = abs(found[0] - ll) <= eps * max(1.0, abs(found[0]))
            beta, (ll, score, info) = beta + move, found
            if done:
                break
        return FlexibleFit(beta, np.linalg.pinv(info, hermitian=True), ll, n, [float(v) for v in knots], [*(f"spline_{i}" for i in range(k)), *x])
    finally:
        rows.unpersist()


def _lifted(info: np.ndarray) -> np.ndarray:
    """info, lifted where it isn't positive."""
    values, vectors = np.linalg.eigh(info)
    return (vectors * np.maximum(values, 1e-10 * max(values.max(), 1.0))) @ vectors.T


def flexible_predict(df: DataFrame, fit: FlexibleFit, *, at: str, x: Sequence[str] = ()) -> DataFrame:
    """df with ``cum_hazard``, ``hazard`` and ``surv`` at the time ``at``: null for null times or covariates, 0, null and 1 for times of 0 or less."""
    u = F.when(F.col(at) > 0, F.log(F.col(at).cast("double")))
    cov = [F.col(c).cast("double") for c in x]
    eta = _sum(splines.natural_parts(u, fit.knots) + cov, fit.coefficients)
    rise = _sum(splines.natural_slopes(u, fit.knots), fit.coefficients[: len(fit.knots)])
    known = F.col(at).isNotNull()
    for c in x:
        known = known & F.col(c).isNotNull()
    h = F.when(known, F.when(F.col(at) > 0, F.exp(eta)).otherwise(0.0))
    return df.withColumn("cum_hazard", h).withColumns({"hazard": F.when(F.col(at) > 0, F.col("cum_hazard") * rise / F.col(at)), "surv": F.exp(-F.col("cum_hazard"))})


@dataclass
class SplineTerm:
    fit: CoxFit
    #: Effective degrees of freedom of the spline and its penalty.
    df: float
    penalty: float
    boundary: tuple[float, float]
    pieces: int
    log_likelihood: float

    def value(self, x: Column) -> Column:
        """Fitted log hazard at x, up to a constant; null outside the boundary."""
        b = self.fit.coefficients[: self.pieces + 2]
        return splines._mix(splines.bspline(x, pieces=self.pieces, boundary=self.boundary)[1:], b)


def spline_term(
    data: DataFrame, *, time: str, status: str, term: str, x: Sequence[str] = (), df: float = 4.0, penalty: float | None = None, pieces: int | None = None, boundary: tuple[float, float] | None = None, ties: str = "efron", strata: Sequence[str] = (), eps: float = 1e-9, most: int = 30
) -> SplineTerm:
    """Cox model with a penalised cubic B-spline of ``term`` (second differences) and covariates ``x``.

    The penalty is given, or found so that the spline has ``df`` effective degrees of freedom: the trace of the unpenalised
    information times the inverse of the penalised.  Values outside the boundary, by default the range, and nulls drop out.
    """
    pieces = pieces or max(4, round(2.5 * df))
    if boundary is None:
        boundary = tuple(data.dropna(subset=[time, status, term, *x]).agg(F.min(F.col(term).cast("double")), F.max(F.col(term).cast("double"))).first())
        if boundary[0] is None or not boundary[0] < boundary[1]:
            raise ValueError(f"{term} has no two different values")
    n = pieces + 2  # the first of pieces + 3 columns is what a constant adds
    cols = splines.bspline(F.col(term).cast("double"), pieces=pieces, boundary=boundary)[1:]
    made = data.select(F.col(time), F.col(status), *strata, *(c.alias(f"_b{i}") for i, c in enumerate(cols)), *(F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(x)))
    names = [f"_b{i}" for i in range(n)] + [f"_x{i}" for i in range(len(x))]
    rows = _rows(made, time, status, names, strata, None, None).persist()
    shape = np.zeros((len(names), len(names)))
    shape[:n, :n] = splines.difference_penalty(n + 1)[1:, 1:]
    how = dict(time=time, status=status, strata=strata, entry=None, weight=None, ties=ties, cuts=cuts_of(rows.withColumn("_t", F.col(time).cast("double")), "_t"))

    def free(info: np.ndarray, lam: float) -> float:
        return float(np.trace((info @ np.linalg.pinv(info + lam * shape, hermitian=True))[:n, :n]))

    def solve_penalty(info: np.ndarray) -> float:
        low, high = -12.0, 12.0
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if free(info, 10**mid) > df else (low, mid)
        return 10 ** ((low + high) / 2)

    try:
        beta, lam = np.zeros(len(names)), penalty
        ll, score, info = _step(rows, beta, 0.0, names, None, **how)
        null, step = ll, 0
        for step in range(1, most + 1):
            lam = penalty if penalty is not None else solve_penalty(info)
            inner = lambda b, value: value - lam * b @ shape @ b / 2
            move = np.linalg.pinv(info + lam * shape, hermitian=True) @ (score - lam * shape @ beta)
            found = _step(rows, beta + move, 0.0, names, None, **how)
            while not inner(beta + move, found[0]) >= inner(beta, ll) - eps * abs(ll) and np.abs(move).max() > eps:
                move = move / 2
                found = _step(rows, beta + move, 0.0, names, None, **how)
            done = np.abs(move).max() <= 1e-6 * max(1.0, np.abs(beta).max()) or abs(inner(beta + move, found[0]) - inner(beta, ll)) <= eps * abs(ll)
            beta, (ll, score, info) = beta + move, found
            if done:
                break
        hold = np.linalg.pinv(info + lam * shape, hermitian=True)
        fit = CoxFit(beta, hold @ info @ hold, ll, step, null, names=[*(f"{term}_{i}" for i in range(n)), *x], ties=ties)
        return SplineTerm(fit, free(info, lam), float(lam), boundary, pieces, ll)
    finally:
        rows.unpersist()

"""Additive hazards (Aalen): least squares of the events of each time on the covariates of those at risk.

Matrices of moments over the risk set are running sums over distinct event times; each time's small system is
solved where its row lies, and cumulative coefficients are running sums again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from censorium.functions.prefix import running
from censorium.functions.riskset import timeline
from censorium.functions.special import chi2_sf

TESTS = ("aalen", "nrisk", "variance")


@dataclass
class AdditiveFit:
    #: (time, n_risk, n_event, coef_<name>, cum_<name>, weight_<name>) at each event time that could be solved; names: intercept and covariates.
    steps: DataFrame
    statistic: np.ndarray
    variance: np.ndarray
    names: list[str]
    n_times: int

    @property
    def chi_square(self) -> float:
        """Of all covariates together, without the intercept."""
        k = len(self.statistic) - len(self.names) + 1
        u, v = self.statistic[k:], self.variance[k:, k:]
        return float(u @ np.linalg.pinv(v) @ u)

    @property
    def p(self) -> float:
        return chi2_sf(self.chi_square, len(self.names) - 1)


def _moments(df: DataFrame, time: str, status: str, x: Sequence[str], entry: str | None, weight: str | None) -> DataFrame:
    p = len(x)
    rows = df.dropna(subset=[time, status, *x, *([weight] if weight else [])])
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    had = (F.col(status) != 0).cast("double")
    v = [F.col(c).cast("double") for c in x]
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    at = {"k": had, "d": had * w, "dd": had * w * w, **{f"x{i}": had * w * v[i] for i in range(p)}, **{f"xx{i}": had * w * w * v[i] for i in range(p)}, **{f"o{i}_{j}": had * w * w * v[i] * v[j] for i, j in pairs}}
    leaving = {"n_risk": w, **{f"s{i}": w * v[i] for i in range(p)}, **{f"s{i}_{j}": w * v[i] * v[j] for i, j in pairs}}
    return timeline(rows, time=time, entry=entry, keys=(), at=at, leaving=leaving).where("k > 0")


def _square(rows: pd.DataFrame, stem: str, p: int) -> np.ndarray:
    out = np.zeros((len(rows), p, p))
    for i in range(p):
        for j in range(i, p):
            out[:, i, j] = out[:, j, i] = rows[f"{stem}{i}_{j}"]
    return out


def additive_fit(df: DataFrame, *, time: str, status: str, x: Sequence[str], entry: str | None = None, weight: str | None = None, least: int | None = None, test: str = "aalen", tolerance: float = 1e-7) -> AdditiveFit:
    """Aalen's model for right-censored or (entry, time] rows, with weights.

    As many event times are kept, from the first on, as have ``least`` (3 a covariate, by default) or more at risk; of these, times whose covariates
    are collinear to ``tolerance`` are left out.  ``test`` weighs coefficients by the inverse of their least-squares
    variance (aalen), by the risk set (nrisk), or takes events' distances from the mean (variance).  Rows with a null time, status,
    covariate or weight, or with entry >= time, drop out; an empty table has no steps and a zero statistic.
    """
    if test not in TESTS:
        raise ValueError(f"test is one of {TESTS}")
    p, names = len(x), ["intercept", *x]
    least = 3 * p if least is None else least
    at = running(_moments(df, time, status, x, entry, weight), order="time", sums={"_rank": F.lit(1.0)})
    kept = at.agg(F.sum((F.col("n_risk") >= least).cast("long"))).first()[0] or 0
    q = p + 1 if test != "variance" else p
    fields = ["time", "n_risk", "n_event", *(f"coef_{i}" for i in range(p + 1)), *(f"weight_{i}" for i in range(p + 1)), *(f"u{i}" for i in range(q)), *(f"v{i}_{j}" for i in range(q) for j in range(q))]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            n = rows["n_risk"].to_numpy()
            mean = np.stack([rows[f"s{i}"] / n for i in range(p)], axis=1) if p else np.zeros((len(rows), 0))
            cov = _square(rows, "s", p) / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
            scale = np.abs(cov).max(axis=(1, 2), initial=0.0)
            good = (np.linalg.matrix_rank(cov / np.where(scale > 0, scale, 1)[:, None, None], tol=tolerance, hermitian=True) == p) & ((scale > 0) | (p == 0))
            rows, n, mean, cov = rows[good], n[good], mean[good], cov[good]
            inverse = np.linalg.inv(cov)
            d, dx = rows["d"].to_numpy(), np.stack([rows[f"x{i}"] for i in range(p)], axis=1) if p else mean
            # coefficients are linear in (d, dx - d mean), and so is what each event adds
            line = np.zeros((len(rows), p + 1, p + 1))
            line[:, 0, 0] = 1 / n
            line[:, 1:, 1:] = inverse / n[:, None, None]
            line[:, 0, 1:] = -np.einsum("ti,tij->tj", mean, inverse) / n[:, None]
            own = np.concatenate([d[:, None], dx - d[:, None] * mean], axis=1)
            coef = np.einsum("tij,tj->ti", line, own)
            quad = np.einsum("ti,tij,tj->t", mean, inverse, mean)
            weight = np.concatenate([(n / (1 + quad))[:, None], n[:, None] / np.einsum("tii->ti", inverse)], axis=1)
            # squares of events about the mean, summed over the events of a time
            dd, ddx = rows["dd"].to_numpy(), np.stack([rows[f"xx{i}"] for i in range(p)], axis=1) if p else mean
            second = np.zeros((len(rows), p + 1, p + 1))
            second[:, 0, 0] = dd
            second[:, 0, 1:] = second[:, 1:, 0] = ddx - dd[:, None] * mean
            second[:, 1:, 1:] = _square(rows, "o", p) - mean[:, :, None] * ddx[:, None, :] - ddx[:, :, None] * mean[:, None, :] + dd[:, None, None] * mean[:, :, None] * mean[:, None, :]
            if test == "variance":
                u, v = own[:, 1:], second[:, 1:, 1:]
            else:
                w = weight if test == "aalen" else np.repeat(n[:, None], p + 1, axis=1)
                u = coef * w
                v = np.einsum("tij,tjk,tlk->til", line, second, line) * w[:, :, None] * w[:, None, :]
            yield pd.DataFrame(np.concatenate([rows["time"].to_numpy()[:, None], n[:, None], d[:, None], coef, weight, u, v.reshape(len(rows), q * q)], axis=1), columns=fields)

    solved = at.where(F.col("_rank") <= kept).mapInPandas(solve, T.StructType([T.StructField(f, T.DoubleType()) for f in fields]))
    total = solved.agg(F.count("*"), *(F.coalesce(F.sum(f), F.lit(0.0)) for f in fields[-q - q * q :])).first()
    run = running(solved, order="time", sums={f"cum_{i}": F.col(f"coef_{i}") for i in range(p + 1)})
    steps = run.select("time", "n_risk", "n_event", *(F.col(f"{k}_{i}").alias(f"{k}_{n}") for k in ("coef", "cum", "weight") for i, n in enumerate(names)))
    return AdditiveFit(steps, np.array(total[1 : 1 + q]), np.array(total[1 + q :]).reshape(q, q), names, int(total[0]))

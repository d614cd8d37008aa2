"""Parametric models of log time (accelerated failure time): y = x b + scale * e, right-, left- and interval-censored rows.

Newton steps on (b, log scale); a step is one Spark aggregation.  Distributions of e: extreme (Weibull, exponential
with the scale fixed at 1, Rayleigh at 1/2), normal (log-normal) and logistic (log-logistic); gaussian, logistic and extreme on the time itself.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from censorium.functions.special import norm_cdf, norm_quantile

#: Name to (distribution of e, on log time, fixed scale).
FAMILIES = {"weibull": ("extreme", True, None), "exponential": ("extreme", True, 1.0), "rayleigh": ("extreme", True, 0.5), "lognormal": ("normal", True, None), "loglogistic": ("logistic", True, None), "gaussian": ("normal", False, None), "logistic": ("logistic", False, None), "extreme": ("extreme", False, None)}


@dataclass
class TimeFit:
    names: list[str]
    family: str
    coefficients: np.ndarray
    scale: float
    covariance: np.ndarray
    log_likelihood: float
    iterations: int

    @property
    def std_errors(self) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, np.diag(self.covariance)))

    def predictor(self) -> Column:
        out = F.lit(float(self.coefficients[0]))
        for c, b in zip(self.names, self.coefficients[1:], strict=True):
            out = out + F.col(c).cast("double") * float(b)
        return out


def _family(name: str) -> tuple[str, bool, float | None]:
    if name not in FAMILIES:
        raise ValueError(f"family is one of {sorted(FAMILIES)}")
    return FAMILIES[name]


def curve_at(z: Column, kind: str) -> Column:
    """P(e > z)."""
    if kind == "extreme":
        return F.exp(-F.exp(z))
    if kind == "logistic":
        return 1 / (1 + F.exp(z))
    return norm_cdf(-z)


def _terms(z: Column, kind: str) -> dict[str, Column]:
    """Log density and log upper tail of e at z with first and second derivatives."""
    if kind == "extreme":
        e = F.exp(z)
        return {"f": z - e, "f1": 1 - e, "f2": -e, "s": -e, "s1": -e, "s2": -e}
    if kind == "logistic":
        p = 1 / (1 + F.exp(-z))
        return {"f": z - 2 * F.log1p(F.exp(z)), "f1": 1 - 2 * p, "f2": -2 * p * (1 - p), "s": -F.log1p(F.exp(z)), "s1": -p, "s2": -p * (1 - p)}
    tail = F.greatest(F.lit(1e-300), norm_cdf(-z))
    m = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) / tail
    return {"f": -z * z / 2 - 0.5 * math.log(2 * math.pi), "f1": -z, "f2": F.lit(-1.0), "s": F.log(tail), "s1": -m, "s2": m * (z - m)}


def prepared(df: DataFrame, *, time: str, status: str, x: Sequence[str], logged: bool, weight: str | None, also: Sequence[str] = ()) -> DataFrame:
    """``_y``, ``_d``, ``_x0`` ..., ``_w`` and ``_id0`` ... of the rows that take part."""
    known = df.dropna(subset=[time, status, *x, *([weight] if weight else [])])
    t = F.col(time).cast("double")
    return (known.where(t > 0) if logged else known).select((F.log(t) if logged else t).alias("_y"), (F.col(status) != 0).alias("_d"), *(F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(x)), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"), *(F.col(c).alias(f"_id{i}") for i, c in enumerate(also)))


def step_sums(rows: DataFrame, v: Sequence[Column], lp: Column, log_scale: Column, kind: str, logged: bool, keys: Sequence[str] = ()) -> DataFrame:
    """Log likelihood ``ll``, score ``u*`` and information ``i*`` by keys at a predictor and log scale, which may differ from row to row."""
    p = len(v)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    made = rows.withColumn("_s", F.exp(log_scale)).withColumn("_ls", log_scale).withColumn("_z", (F.col("_y") - lp) / F.col("_s"))
    k = _terms(F.col("_z"), kind)
    pick = lambda a, b: F.when(F.col("_d"), a).otherwise(b)
    # one projection for the derivatives, one aggregation of products
    made = made.select("*", pick(k["f"] - F.col("_ls") - (F.col("_y") if logged else 0.0), k["s"]).alias("_l"), pick(k["f1"], k["s1"]).alias("_g1"), pick(k["f2"], k["s2"]).alias("_h2"))
    w, g, h, z, sigma = F.col("_w"), F.col("_g1"), F.col("_h2"), F.col("_z"), F.col("_s")
    one = F.when(F.col("_d"), F.lit(1.0)).otherwise(F.lit(0.0))
    sums = [F.sum(w * F.col("_l")).alias("ll")]
    sums += [F.sum(-w * g * v[i] / sigma).alias(f"u{i}") for i in range(p)] + [F.sum(w * (-g * z - one)).alias("us")]
    sums += [F.sum(-w * h * v[i] * v[j] / (sigma * sigma)).alias(f"i{i}_{j}") for i, j in pairs]
    sums += [F.sum(-w * (h * z + g) * v[i] / sigma).alias(f"is{i}") for i in range(p)] + [F.sum(-w * (h * z * z + g * z)).alias("iss")]
    return made.groupBy(*keys).agg(*sums) if keys else made.agg(*sums)


def parts(got: Row, p: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Value, score and information of a row of ``step_sums``."""
    u, info = np.zeros(p + 1), np.zeros((p + 1, p + 1))
    for i in range(p):
        u[i] = got[f"u{i}"] or 0.0
        info[i, p] = info[p, i] = got[f"is{i}"] or 0.0
        for j in range(i, p):
            info[i, j] = info[j, i] = got[f"i{i}_{j}"] or 0.0
    u[p], info[p, p] = got["us"] or 0.0, got["iss"] or 0.0
    return got["ll"] or 0.0, u, info


def time_fit(df: DataFrame, *, time: str, status: str, x: Sequence[str] = (), family: str = "weibull", weight: str | None = None, scale: float | None = None, most: int = 50, eps: float = 1e-9) -> TimeFit:
    """Maximum likelihood for right-censored rows; null rows, and times that aren't positive where the logarithm is modelled, drop out."""
    kind, logged, fixed = _family(family)
    fixed = scale if scale is not None else fixed
    rows = prepared(df, time=time, status=status, x=x, logged=logged, weight=weight).persist()
    p = len(x) + 1
    v = [F.lit(1.0), *(F.col(f"_x{i}") for i in range(p - 1))]

    def step(beta: np.ndarray, log_scale: float) -> tuple[float, np.ndarray, np.ndarray]:
        lp = F.lit(0.0)
        for c, b in zip(v, beta, strict=True):
            lp = lp + c * float(b)
        return parts(step_sums(rows, v, lp, F.lit(float(log_scale)), kind, logged).first(), p)

    try:
        first = rows.agg(F.avg("_y").alias("m"), F.stddev_pop("_y").alias("s")).first()
        beta = np.zeros(p)
        beta[0], log_scale = first["m"] or 0.0, math.log(fixed or max(first["s"] or 1.0, 1e-3))
        free = p if fixed is not None else p + 1
        ll, u, info = step(beta, log_scale)
        n = 0
        for n in range(1, most + 1):
            h = info[:free, :free]
            values, vectors = np.linalg.eigh(h)
            move = vectors @ ((vectors.T @ u[:free]) / np.maximum(np.abs(values), 1e-8 * max(1.0, np.abs(values).max())))
            size = 1.0
            while True:
                nb, ns = beta + size * move[:p], log_scale + (size * move[p] if free > p else 0.0)
                found = step(nb, ns)
                if (np.isfinite(found[0]) and found[0] >= ll - 1e-12 * abs(ll)) or size < 1e-6:
                    break
                size /= 2
            done = abs(found[0] - ll) <= eps * max(1.0, abs(ll))
            beta, log_scale, (ll, u, info) = nb, ns, found
            if done:
                break
        return TimeFit(list(x), family, beta, math.exp(log_scale), np.linalg.pinv(info[:free, :free], hermitian=True), ll, n)
    finally:
        rows.unpersist()


def predicted(df: DataFrame, fit: TimeFit, *, quantiles: Sequence[float] = ()) -> DataFrame:
    """df with ``lp``, ``response`` and, if asked, ``quantiles`` (array, in order) of the predicted time."""
    kind, logged, _ = _family(fit.family)
    out = df.withColumn("lp", fit.predictor())
    response = F.exp("lp") if logged else F.col("lp")
    out = out.withColumn("response", response)
    if not quantiles:
        return out
    def e(q: float) -> Column:
        if kind == "extreme":
            return F.lit(math.log(-math.log1p(-q)))
        return F.lit(math.log(q / (1 - q))) if kind == "logistic" else norm_quantile(F.lit(q))

    values = [F.col("lp") + e(q) * float(fit.scale) for q in quantiles]
    return out.withColumn("quantiles", F.array(*(F.exp(v) if logged else v for v in values)))


def predicted_curve(df: DataFrame, fit: TimeFit, *, time: str) -> DataFrame:
    """df with ``surv``, the predicted probability of lasting beyond each row's time."""
    kind, logged, _ = _family(fit.family)
    t = F.col(time).cast("double")
    z = ((F.log(t) if logged else t) - fit.predictor()) / float(fit.scale)
    return df.withColumn("surv", curve_at(z, kind))


def time_residuals(df: DataFrame, fit: TimeFit, *, time: str, status: str) -> DataFrame:
    """df with ``response``, ``working`` (standardised) and ``martingale``, ``deviance`` residuals of right-censored rows."""
    kind, logged, _ = _family(fit.family)
    t, d = F.col(time).cast("double"), F.col(status) != 0
    out = df.withColumn("_lp", fit.predictor()).withColumn("_z", ((F.log(t) if logged else t) - F.col("_lp")) / float(fit.scale))
    k = _terms(F.col("_z"), kind)
    out = out.withColumns({"response": t - (F.exp("_lp") if logged else F.col("_lp")), "working": F.col("_z") * float(fit.scale), "martingale": d.cast("double") + k["s"]})
    m = F.col("martingale")
    dev = F.signum(m) * F.sqrt(F.greatest(F.lit(0.0), -2 * (m + F.when(d, F.log(F.greatest(F.lit(1e-300), 1 - m))).otherwise(F.lit(0.0)))))
    return out.withColumn("deviance", dev).drop("_lp", "_z")

"""Cure models: some subjects never have the event.

``mixture``: P(T > t) = 1 - p + p S(t), p from a link of the first predictor, S one of the distributions of
``aft`` at the second.  ``promotion``: P(T > t) = exp(-m (1 - S(t))), or with a dispersion k
(1 + k m (1 - S(t))) ** (-1 / k), m the exponential of the first predictor; k = 1 is the geometric form.

A step is one Spark aggregation.  It has the log likelihood, its gradient and two informations: that of the
observed data and, for the mixture, that of the completed data (each row susceptible with its probability
given what was seen).  Newton steps use the first; where it has no maximum to go to, the second makes it a step of
the EM algorithm.  No step lowers the likelihood.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from censorium.functions.special import norm_cdf
from censorium.operators.aft import _family, _terms, curve_at

LINKS = ("logit", "probit", "cloglog")
#: Where the standardised log time is cut so that exp doesn't overflow; the probability beyond is 0 in doubles anyway.
FAR = 300.0


@dataclass
class CureFit:
    """``cure``: intercept and coefficients of ``cure_names``; ``location``: those of ``names`` on log time, as in ``aft``."""

    model: str
    family: str
    link: str
    dispersion: float
    cure_names: list[str]
    names: list[str]
    cure: np.ndarray
    location: np.ndarray
    scale: float
    covariance: np.ndarray
    log_likelihood: float
    n: float
    iterations: int
    converged: bool
    trace: list[float]

    @property
    def n_parameters(self) -> int:
        return len(self.covariance)

    @property
    def aic(self) -> float:
        return 2 * self.n_parameters - 2 * self.log_likelihood

    @property
    def bic(self) -> float:
        return self.n_parameters * math.log(max(self.n, 1.0)) - 2 * self.log_likelihood

    @property
    def std_errors(self) -> np.ndarray:
        """Of cure, location and, unless fixed, log scale."""
        return np.sqrt(np.maximum(0.0, np.diag(self.covariance)))


def _predictor(names: Sequence[str], beta: Sequence[float]) -> Column:
    out = F.lit(float(beta[0]))
    for c, b in zip(names, beta[1:], strict=True):
        out = out + F.col(c).cast("double") * float(b)
    return out


def _link(eta: Column, link: str) -> dict[str, Column]:
    """log p and log(1 - p) with first and second derivatives in the predictor."""
    if link == "logit":
        p = 1 / (1 + F.exp(-eta))
        soft = lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
        return {"p": -soft(-eta), "p1": 1 - p, "p2": -p * (1 - p), "q": -soft(eta), "q1": -p, "q2": -p * (1 - p)}
    if link == "probit":
        density = F.exp(-eta * eta / 2) / math.sqrt(2 * math.pi)
        up, down = F.greatest(F.lit(1e-300), norm_cdf(eta)), F.greatest(F.lit(1e-300), norm_cdf(-eta))
        m, k = density / up, density / down
        return {"p": F.log(up), "p1": m, "p2": -m * (eta + m), "q": F.log(down), "q1": -k, "q2": -k * (k - eta)}
    u = F.exp(F.least(eta, F.lit(FAR)))
    r = F.when(u < 1e-9, F.lit(1.0)).otherwise(u / F.expm1(u))
    return {"p": F.log(-F.expm1(-u)), "p1": r, "p2": r * (1 - u - r), "q": -u, "q1": -u, "q2": -u}


def _mixture(rows: DataFrame, kind: str, link: str) -> DataFrame:
    k, c = _terms(F.col("_z"), kind), _link(F.col("_eta"), link)
    d = F.col("_d")
    made = rows.withColumns({f"_k{n}": v for n, v in k.items()} | {f"_c{n}": v for n, v in c.items()})
    gap = F.col("_cq") - F.col("_cp") - F.col("_ks")  # log odds of being cured among those without the event
    made = made.withColumn("_gap", gap).withColumn("_in", F.when(d, F.lit(1.0)).otherwise(1 / (1 + F.exp("_gap"))))
    w, v = F.col("_in"), F.col("_in") * (1 - F.col("_in"))
    q = F.col("_cp1") - F.col("_cq1")
    alive = F.greatest(F.col("_cq"), F.col("_cp") + F.col("_ks")) + F.log1p(F.exp(-F.abs("_gap")))
    first = F.when(d, F.col("_kf1")).otherwise(w * F.col("_ks1"))
    second = F.when(d, F.col("_kf2")).otherwise(w * F.col("_ks2"))
    ee = w * F.col("_cp2") + (1 - w) * F.col("_cq2")
    return made.withColumns({
        "_l": F.when(d, F.col("_cp") + F.col("_kf") - F.col("_ls") - F.col("_y")).otherwise(alive),
        "_e": w * F.col("_cp1") + (1 - w) * F.col("_cq1"), "_ee": ee + v * q * q, "_eec": ee,
        "_t": first, "_tt": second + v * F.col("_ks1") * F.col("_ks1"), "_ttc": second, "_et": v * q * F.col("_ks1"),
    })


def _promotion(rows: DataFrame, kind: str, dispersion: float) -> DataFrame:
    k = _terms(F.col("_z"), kind)
    d, phi = F.col("_d").cast("double"), float(dispersion)
    made = rows.withColumns({f"_k{n}": k[n] for n in ("f", "f1", "f2", "s")} | {"_m": F.exp(F.least(F.col("_eta"), F.lit(FAR)))})
    made = made.withColumn("_u", F.col("_m") * -F.expm1("_ks")).withColumn("_mf", F.col("_m") * F.exp("_kf"))
    u, mf = F.col("_u"), F.col("_mf")
    g1 = (1 + d * phi) / (1 + phi * u)
    g2 = -phi * g1 / (1 + phi * u)
    g0 = u if phi == 0 else (1 / phi + d) * F.log1p(phi * u)
    known = lambda c: F.when(F.col("_d"), c).otherwise(F.lit(0.0))
    ee, tt = -(g2 * u * u + g1 * u), known(F.col("_kf2")) - g2 * mf * mf - g1 * mf * F.col("_kf1")
    return made.withColumns({
        "_l": known(F.col("_eta") + F.col("_kf") - F.col("_ls") - F.col("_y")) - g0,
        "_e": d - g1 * u, "_ee": ee, "_eec": ee, "_t": known(F.col("_kf1")) - g1 * mf, "_tt": tt, "_ttc": tt, "_et": -(g2 * u + g1) * mf,
    })


def _rows(df: DataFrame, *, time: str, status: str, cure_x: Sequence[str], x: Sequence[str], weight: str | None, keys: Sequence[str] = ()) -> DataFrame:
    known = df.dropna(subset=[time, status, *cure_x, *x, *([weight] if weight else [])])
    t = F.col(time).cast("double")
    return known.where(t > 0).select(*(F.col(c).alias(f"_key{i}") for i, c in enumerate(keys)), F.log(t).alias("_y"), (F.col(status) != 0).alias("_d"), *(F.col(c).cast("double").alias(f"_a{i}") for i, c in enumerate(cure_x)), *(F.col(c).cast("double").alias(f"_b{i}") for i, c in enumerate(x)), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"))


def _sums(rows: DataFrame, keys: Sequence[str], model: str, kind: str, link: str, dispersion: float, cure: Sequence[float], location: Sequence[float], log_scale: float) -> DataFrame:
    m, p = len(cure), len(location)
    placed = rows.withColumns({"_eta": _predictor([f"_a{i}" for i in range(m - 1)], cure), "_ls": F.lit(float(log_scale)), "_sc": F.lit(math.exp(log_scale))})
    placed = placed.withColumn("_z", F.least((F.col("_y") - _predictor([f"_b{i}" for i in range(p - 1)], location)) / F.col("_sc"), F.lit(FAR)))
    made = _mixture(placed, kind, link) if model == "mixture" else _promotion(placed, kind, dispersion)
    z, s, w = F.col("_z"), F.col("_sc"), F.col("_w")
    # derivatives in both predictors and the log scale
    made = made.withColumns({"_g1": -F.col("_t") / s, "_g2": -z * F.col("_t") - F.col("_d").cast("double"), "_i01": F.col("_et") / s, "_i02": z * F.col("_et")} | {f"_i{n}{c}": v for c, tt in (("", F.col("_tt")), ("c", F.col("_ttc"))) for n, v in (("11", -tt / (s * s)), ("12", -(tt * z + F.col("_t")) / s), ("22", -(tt * z * z + F.col("_t") * z)))})
    made = made.withColumns({"_g0": F.col("_e"), "_i00": -F.col("_ee"), "_i00c": -F.col("_eec")})
    parts = [(0, F.lit(1.0)), *((0, F.col(f"_a{i}")) for i in range(m - 1)), (1, F.lit(1.0)), *((1, F.col(f"_b{i}")) for i in range(p - 1)), (2, F.lit(1.0))]
    sums = [F.sum(w).alias("n"), F.sum(w * F.col("_l")).alias("ll")]
    sums += [F.sum(w * F.col(f"_g{a}") * v).alias(f"u{i}") for i, (a, v) in enumerate(parts)]
    for i, (a, v) in enumerate(parts):
        for j, (b, y) in enumerate(parts[i:], i):
            sums.append(F.sum(w * F.col(f"_i{a}{b}") * v * y).alias(f"i{i}_{j}"))
            if (a == 0) == (b == 0):
                sums.append(F.sum(w * F.col(f"_i{a}{b}c") * v * y).alias(f"c{i}_{j}"))
    return made.groupBy(*keys).agg(*sums) if keys else made.agg(*sums)


def _matrices(got: Row, size: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    known = got.asDict()
    u = np.array([known[f"u{i}"] or 0.0 for i in range(size)])
    info, whole = np.zeros((size, size)), np.zeros((size, size))
    for i in range(size):
        for j in range(i, size):
            info[i, j] = info[j, i] = known[f"i{i}_{j}"] or 0.0
            whole[i, j] = whole[j, i] = known.get(f"c{i}_{j}") or 0.0
    return known["ll"] or 0.0, u, info, whole


def _check(model: str, link: str, dispersion: float) -> None:
    if model not in ("mixture", "promotion"):
        raise ValueError("model is mixture or promotion")
    if link not in LINKS:
        raise ValueError(f"link is one of {LINKS}")
    if dispersion < 0:
        raise ValueError("dispersion is not negative")


def _logged(family: str) -> tuple[str, float | None]:
    kind, logged, fixed = _family(family)
    if not logged:
        raise ValueError("cure models take families on log time")
    return kind, fixed


def cure_score(df: DataFrame, *, time: str, status: str, cure: Sequence[float], location: Sequence[float], scale: float, cure_x: Sequence[str] = (), x: Sequence[str] = (), keys: Sequence[str] = (), model: str = "mixture", family: str = "weibull", link: str = "logit", dispersion: float = 0.0, weight: str | None = None) -> DataFrame:
    """By keys: ``n``, the log likelihood ``ll`` at given coefficients and its gradient ``u0`` ...: cure part, location, log scale.

    Rows with a null, and times that aren't positive, drop out; null keys are a group; an empty table has no row by keys and one row of nulls without.
    """
    _check(model, link, dispersion)
    kind, _ = _logged(family)
    rows = _rows(df, time=time, status=status, cure_x=cure_x, x=x, weight=weight, keys=keys)
    made = _sums(rows, [f"_key{i}" for i in range(len(keys))], model, kind, link, dispersion, cure, location, math.log(scale))
    return made.select(*(F.col(f"_key{i}").alias(c) for i, c in enumerate(keys)), "n", "ll", *(f"u{i}" for i in range(len(cure) + len(location) + 1)))


def cure_fit(df: DataFrame, *, time: str, status: str, cure_x: Sequence[str] = (), x: Sequence[str] = (), model: str = "mixture", family: str = "weibull", link: str = "logit", dispersion: float = 0.0, weight: str | None = None, most: int = 100, eps: float = 1e-9) -> CureFit:
    """Maximum likelihood of a cure model; ``cure_x`` act on the share with the event (mixture) or the rate of causes (promotion), ``x`` on log time.

    Rows with a null, and times that aren't positive, drop out.  If the likelihood has no maximum (no plateau in the data), steps
    end at ``most`` and ``converged`` is false.  A table without rows gives the starting values, log likelihood 0.
    """
    _check(model, link, dispersion)
    kind, fixed = _logged(family)
    m, p = len(cure_x) + 1, len(x) + 1
    free = m + p + (fixed is None)
    rows = _rows(df, time=time, status=status, cure_x=cure_x, x=x, weight=weight).persist()

    def step(at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        return _matrices(_sums(rows, (), model, kind, link, dispersion, at[:m], at[m : m + p], at[-1]).first(), m + p + 1)

    try:
        start = rows.agg(F.sum("_w").alias("n"), F.avg(F.when(F.col("_d"), F.col("_y"))).alias("y"), F.avg(F.col("_d").cast("double")).alias("d")).first()
        at = np.zeros(m + p + 1)
        share = min(0.95, max(0.05, start["d"] or 0.5))
        at[0] = {"mixture": {"logit": math.log(share / (1 - share)), "probit": 0.0, "cloglog": math.log(-math.log1p(-share))}[link], "promotion": math.log(-math.log1p(-share))}[model]
        at[m], at[-1] = start["y"] or 0.0, math.log(fixed or 1.0)
        ll, u, info, whole = step(at)
        trace, done, n = [ll], False, 0
        for n in range(1, most + 1):
            h = info[:free, :free]
            values, vectors = np.linalg.eigh(h)
            if values.min() <= 1e-10 * max(1.0, values.max()) and model == "mixture":
                values, vectors = np.linalg.eigh(whole[:free, :free])
            move = np.zeros(m + p + 1)
            move[:free] = vectors @ ((vectors.T @ u[:free]) / np.maximum(np.abs(values), 1e-8 * max(1.0, np.abs(values).max())))
            size = min(1.0, 4.0 / max(4.0, np.abs(move).max()))
            while True:
                found = step(at + size * move)
                rises = np.isfinite(found[0]) and found[0] >= ll - 1e-13 * abs(ll)
                if rises or size < 1e-7:
                    break
                size /= 2
            if not rises:
                break
            done = abs(found[0] - ll) <= eps * max(1.0, abs(ll)) and np.abs(size * move).max() <= 1e-5 * max(1.0, np.abs(at).max())
            at, (ll, u, info, whole) = at + size * move, found
            trace.append(ll)
            if done:
                break
        covariance = np.linalg.pinv(info[:free, :free], hermitian=True)
        return CureFit(model, family, link, float(dispersion), list(cure_x), list(x), at[:m], at[m : m + p], math.exp(at[-1]), covariance, ll, start["n"] or 0.0, n, done, trace)
    finally:
        rows.unpersist()


def _cured(fit: CureFit) -> Column:
    eta = _predictor(fit.cure_names, fit.cure)
    if fit.model == "mixture":
        return F.exp(_link(eta, fit.link)["q"])
    return _bounded(F.exp(eta), fit.dispersion)


def _bounded(u: Column, dispersion: float) -> Column:
    return F.exp(-u) if dispersion == 0 else F.exp(-F.log1p(dispersion * u) / dispersion)


def cure_predicted(df: DataFrame, fit: CureFit, *, time: str) -> DataFrame:
    """df with ``cured`` (the share without the event for ever), ``surv`` (P(T > time)) and ``cured_given`` (P(cured | T > time)).

    Nulls give nulls; at times up to 0 ``surv`` is 1.
    """
    kind, _ = _logged(fit.family)
    t = F.col(time).cast("double")
    z = F.least((F.log(F.when(t > 0, t)) - _predictor(fit.names, fit.location)) / float(fit.scale), F.lit(FAR))
    later = F.when(t <= 0, F.lit(1.0)).when(t > 0, curve_at(z, kind))
    if fit.model == "mixture":
        surv = F.col("cured") + (1 - F.col("cured")) * later
    else:
        surv = _bounded(F.exp(_predictor(fit.cure_names, fit.cure)) * (1 - later), fit.dispersion)
    return df.withColumn("cured", _cured(fit)).withColumn("surv", surv).withColumn("cured_given", F.when(F.col("surv") > 0, F.least(F.lit(1.0), F.col("cured") / F.col("surv"))))


def compare_cure(spark: SparkSession, fits: Sequence[CureFit]) -> DataFrame:
    """One row a fit, best first by Akaike's criterion: ``(model, family, link, dispersion, n_parameters, log_likelihood, aic, bic, converged)``."""
    rows = [(f.model, f.family, f.link if f.model == "mixture" else None, f.dispersion if f.model == "promotion" else None, f.n_parameters, float(f.log_likelihood), float(f.aic), float(f.bic), bool(f.converged)) for f in fits]
    return spark.createDataFrame(rows, "model string, family string, link string, dispersion double, n_parameters int, log_likelihood double, aic double, bic double, converged boolean").orderBy("aic", "model", "family")

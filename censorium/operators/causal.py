"""Effects of a treatment: propensity and censoring weights, weighted Cox, standardised curves, targeted estimates.

Logistic and linear fits are Newton steps whose sums Spark makes; p + p(p+1)/2 of them reach the driver a step.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from censorium.functions.prefix import as_of, running
from censorium.functions.special import chi2_sf, norm_cdf, z_of
from censorium.operators.cox import CoxFit, base_hazard, cox_fit
from censorium.operators.metrics import FLOOR, censor_curve


@dataclass
class LinearFit:
    names: list[str]
    coefficients: np.ndarray
    covariance: np.ndarray
    log_likelihood: float

    def predictor(self, replace: dict[str, Column] | None = None) -> Column:
        """Intercept plus coefficients times columns, some replaced by other expressions."""
        out = F.lit(float(self.coefficients[0]))
        for c, b in zip(self.names, self.coefficients[1:], strict=True):
            out = out + (replace or {}).get(c, F.col(c).cast("double")) * float(b)
        return out


def _moments(rows: DataFrame, x: Sequence[str], weight: Column, gap: Column, ll: Column) -> tuple[np.ndarray, np.ndarray, float]:
    v = [F.lit(1.0), *(F.col(c).cast("double") for c in x)]
    p = len(v)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    got = rows.agg(F.sum(ll).alias("ll"), *(F.sum(gap * v[i]).alias(f"u{i}") for i in range(p)), *(F.sum(weight * v[i] * v[j]).alias(f"h{i}_{j}") for i, j in pairs)).first()
    h = np.zeros((p, p))
    for i, j in pairs:
        h[i, j] = h[j, i] = got[f"h{i}_{j}"] or 0.0
    return np.array([got[f"u{i}"] or 0.0 for i in range(p)]), h, got["ll"] or 0.0


def logistic_fit(df: DataFrame, *, outcome: str, x: Sequence[str], weight: str | None = None, most: int = 25, eps: float = 1e-8) -> LinearFit:
    """Logistic regression by Newton steps; rows with a null drop out."""
    rows = df.dropna(subset=[outcome, *x, *([weight] if weight else [])]).select(*dict.fromkeys([outcome, *x, *([weight] if weight else [])])).persist()
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    try:
        fit = LinearFit(list(x), np.zeros(len(x) + 1), np.zeros((0, 0)), float("nan"))
        for _ in range(most):
            eta = fit.predictor()
            p = 1 / (1 + F.exp(-eta))
            # log(1 + exp(eta)) without overflow
            ll = w * (F.col(outcome) * eta - F.greatest(eta, F.lit(0.0)) - F.log1p(F.exp(-F.abs(eta))))
            u, h, value = _moments(rows, x, w * p * (1 - p), w * (F.col(outcome) - p), ll)
            cov = np.linalg.pinv(h, hermitian=True)
            move = cov @ u
            done = np.isfinite(fit.log_likelihood) and abs(value - fit.log_likelihood) <= eps * (abs(value) + eps)
            fit = LinearFit(fit.names, fit.coefficients if done else fit.coefficients + move, cov, value)
            if done:
                break
        return fit
    finally:
        rows.unpersist()


def linear_fit(df: DataFrame, *, outcome: str, x: Sequence[str], weight: str | None = None) -> LinearFit:
    """Least squares by one aggregation; covariance by the residual variance."""
    rows = df.dropna(subset=[outcome, *x, *([weight] if weight else [])])
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    y = F.col(outcome).cast("double")
    u, h, yy = _moments(rows, x, w, w * y, w * y * y)
    inverse = np.linalg.pinv(h, hermitian=True)
    beta = inverse @ u
    n = h[0, 0]
    rss = max(0.0, yy - beta @ u)
    return LinearFit(list(x), beta, inverse * rss / max(1.0, n - len(beta)), -n / 2 * (np.log(max(rss, 1e-300) / n) + 1 + np.log(2 * np.pi)) if n else float("nan"))


def propensity(df: DataFrame, *, treatment: str, x: Sequence[str], trim: float = 0.01) -> DataFrame:
    """df with ``propensity`` of treatment, kept inside [trim, 1 - trim]."""
    fit = logistic_fit(df, outcome=treatment, x=x)
    return df.withColumn("propensity", F.least(F.lit(1 - trim), F.greatest(F.lit(trim), 1 / (1 + F.exp(-fit.predictor())))))


def treatment_weights(df: DataFrame, *, treatment: str, x: Sequence[str], stabilized: bool = True, trim: float = 0.01) -> DataFrame:
    """df with ``iptw``: 1 / probability of the treatment received, times its overall share if stabilized."""
    scored = propensity(df, treatment=treatment, x=x, trim=trim)
    treated = F.col(treatment) == 1
    if not stabilized:
        return scored.withColumn("iptw", F.when(treated, 1 / F.col("propensity")).otherwise(1 / (1 - F.col("propensity"))))
    share = df.agg(F.avg(F.col(treatment).cast("double")).alias("_share"))
    both = scored.crossJoin(F.broadcast(share))  # one row
    return both.withColumn("iptw", F.when(treated, F.col("_share") / F.col("propensity")).otherwise((1 - F.col("_share")) / (1 - F.col("propensity")))).drop("_share")


def history_weights(df: DataFrame, *, subject: str, visit: str, treatment: str, x: Sequence[str], stabilized: bool = True, trim: float = 0.01) -> DataFrame:
    """``(subject, visit, weight)``: product over visits up to here of the weights of the treatments received (one pooled model)."""
    from pyspark.sql import Window

    each = treatment_weights(df, treatment=treatment, x=x, stabilized=stabilized, trim=trim)
    w = Window.partitionBy(subject).orderBy(visit).rowsBetween(Window.unboundedPreceding, 0)
    return each.select(subject, visit, F.product("iptw").over(w).alias("weight"))


def marginal_structural(df: DataFrame, *, time: str, status: str, treatment: str, x_outcome: Sequence[str] = (), x_treatment: Sequence[str], stabilized: bool = True, trim: float = 0.01) -> CoxFit:
    """Weighted Cox fit of the treatment (and ``x_outcome``) by inverse probability of treatment."""
    rows = treatment_weights(df.dropna(subset=[time, status, treatment, *x_outcome, *x_treatment]), treatment=treatment, x=x_treatment, stabilized=stabilized, trim=trim)
    return cox_fit(rows, time=time, status=status, x=[treatment, *x_outcome], weight="iptw")


def censoring_weights(df: DataFrame, *, time: str, status: str, x: Sequence[str] = (), stabilized: bool = True, trim: float = FLOOR) -> DataFrame:
    """df with ``ipcw`` = 1 / P(uncensored up to the row's time): Kaplan–Meier without covariates, else a Cox model of the censoring.

    ``stabilized`` multiplies by the marginal Kaplan–Meier of the censoring.  Probabilities are at least ``trim``.
    """
    rows = df.dropna(subset=[time, status, *x])
    g = censor_curve(rows, time=time, status=status, events_first=False)
    out = as_of(rows, g, at=time, step="time", values=["censor_surv"])
    marginal = F.greatest(F.coalesce("censor_surv", F.lit(1.0)), F.lit(trim))
    if not x:
        return out.withColumn("ipcw", F.lit(1.0) if stabilized else 1 / marginal).drop("censor_surv")
    turned = rows.withColumn("_c", (F.col(status) == 0).cast("int"))
    fit = cox_fit(turned, time=time, status="_c", x=x)
    base = base_hazard(turned, time=time, status="_c", x=x, coefficients=fit.coefficients).select("time", "cum_hazard")
    looked = as_of(out, base, at=time, step="time", values=["cum_hazard"])
    lp = F.lit(0.0)
    for c, b in zip(x, fit.coefficients, strict=True):
        lp = lp + F.col(c).cast("double") * float(b)
    own = F.greatest(F.exp(-F.coalesce("cum_hazard", F.lit(0.0)) * F.exp(lp)), F.lit(trim))
    return looked.withColumn("ipcw", (marginal if stabilized else F.lit(1.0)) / own).drop("censor_surv", "cum_hazard")


def weighted_incidence(df: DataFrame, *, time: str, status: str, weight: str, times: Sequence[float]) -> DataFrame:
    """``(at, surv)``: 1 less the weighted share of rows with an event by the time."""
    w = F.col(weight)
    sums = df.dropna(subset=[time, status, weight]).agg(F.sum(w).alias("_w"), *(F.sum(F.when((F.col(time) <= t) & (F.col(status) != 0), w).otherwise(0.0)).alias(f"_{i}") for i, t in enumerate(times)))
    return sums.select("_w", F.explode(F.array(*(F.struct(F.lit(float(t)).alias("at"), F.col(f"_{i}").alias("e")) for i, t in enumerate(times)))).alias("x")).select("x.at", (1 - F.try_divide("x.e", "_w")).alias("surv"))


def weighted_difference(df: DataFrame, *, outcome: str, treatment: str, weight: str, level: float = 0.95) -> DataFrame:
    """One row: weighted mean outcome of the treated less that of the others, its error (weighted variances) and limits."""
    w, y, t = F.col(weight), F.col(outcome).cast("double"), F.col(treatment) == 1
    part = lambda c, n: [F.sum(F.when(c, w)).alias(f"w{n}"), F.sum(F.when(c, w * y)).alias(f"y{n}"), F.sum(F.when(c, w * y * y)).alias(f"q{n}"), F.sum(F.when(c, w * w)).alias(f"v{n}")]
    s = df.dropna(subset=[outcome, treatment, weight]).agg(*part(t, 1), *part(~t, 0))
    mean = lambda n: F.col(f"y{n}") / F.col(f"w{n}")
    var = lambda n: (F.col(f"q{n}") / F.col(f"w{n}") - mean(n) * mean(n)) * F.col(f"v{n}") / (F.col(f"w{n}") * F.col(f"w{n}"))
    z = z_of(level)
    out = s.select(mean(1).alias("treated"), mean(0).alias("control"), (mean(1) - mean(0)).alias("difference"), F.sqrt(var(1) + var(0)).alias("std_err"))
    return out.withColumns({"lower": F.col("difference") - z * F.col("std_err"), "upper": F.col("difference") + z * F.col("std_err")})


def standardized_curves(df: DataFrame, *, time: str, status: str, treatment: str, x: Sequence[str], times: Sequence[float], ties: str = "breslow") -> DataFrame:
    """``(at, treated, control)``: mean predicted curves of all rows were everyone, or no one, treated (Cox outcome model)."""
    rows = df.dropna(subset=[time, status, treatment, *x])
    names = [treatment, *x]
    fit = cox_fit(rows, time=time, status=status, x=names, ties=ties)
    base = base_hazard(rows, time=time, status=status, x=names, coefficients=fit.coefficients, ties=ties)
    at = base.agg(*(F.max(F.when(F.col("time") <= t, F.col("cum_hazard"))).alias(f"h{i}") for i, t in enumerate(times)))
    lp = F.lit(0.0)
    for c, b in zip(x, fit.coefficients[1:], strict=True):
        lp = lp + F.col(c).cast("double") * float(b)
    beside = rows.select(F.exp(lp).alias("_r")).crossJoin(F.broadcast(at))  # one row of hazards
    risk = float(np.exp(fit.coefficients[0]))
    sums = beside.agg(*(F.avg(F.exp(-F.coalesce(f"h{i}", F.lit(0.0)) * F.col("_r") * k)).alias(f"{n}{i}") for i in range(len(times)) for n, k in (("t", risk), ("c", 1.0))))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(float(t)).alias("at"), F.col(f"t{i}").alias("treated"), F.col(f"c{i}").alias("control")) for i, t in enumerate(times)))).alias("x")).select("x.*")


def standardized_mean_difference(curves: DataFrame, *, tau: float) -> DataFrame:
    """One row: trapezoid restricted means of ``standardized_curves`` (1 at time 0) up to tau, and their difference."""
    rows = curves.where(F.col("at") <= tau).unionByName(curves.limit(1).select(F.lit(0.0).alias("at"), F.lit(1.0).alias("treated"), F.lit(1.0).alias("control"))).groupBy("at").agg(F.max("treated").alias("treated"), F.max("control").alias("control"))
    near = running(rows, order="at", maxima={"_t0": F.col("at"), "_a": F.struct("at", "treated", "control")}, strict=True).where("_t0 is not null")
    dt = F.col("at") - F.col("_t0")
    out = near.agg(F.sum(dt * (F.col("treated") + F.col("_a.treated")) / 2).alias("treated"), F.sum(dt * (F.col("control") + F.col("_a.control")) / 2).alias("control"))
    return out.withColumn("difference", F.col("treated") - F.col("control"))


def targeted_effect(df: DataFrame, *, outcome: str, treatment: str, x: Sequence[str], trim: float = 0.01, level: float = 0.95) -> DataFrame:
    """One row: targeted mean difference of an outcome: logistic propensity, linear outcome on x, one clever-covariate step, influence-function error."""
    rows = propensity(df.dropna(subset=[outcome, treatment, *x]), treatment=treatment, x=x, trim=trim)
    q = linear_fit(rows, outcome=outcome, x=x)
    p, y, t = F.col("propensity"), F.col(outcome).cast("double"), F.col(treatment) == 1
    h1, h0 = 1 / p, -1 / (1 - p)
    h = F.when(t, h1).otherwise(h0)
    q0 = q.predictor()
    step = rows.agg(F.coalesce(F.try_divide(F.sum(h * (y - q0)), F.sum(h * h)), F.lit(0.0)).alias("_e"))
    beside = rows.crossJoin(F.broadcast(step))  # one row
    one, zero = q0 + F.col("_e") * h1, q0 + F.col("_e") * h0
    part = F.when(t, (y - one) / p).otherwise(-(y - zero) / (1 - p)) + one - zero
    s = beside.agg(F.count("*").cast("double").alias("n"), F.avg(one - zero).alias("effect"), F.sum(part).alias("s"), F.sum(part * part).alias("ss"))
    var = (F.col("ss") - 2 * F.col("effect") * F.col("s") + F.col("n") * F.col("effect") * F.col("effect")) / (F.col("n") * (F.col("n") - 1))
    z = z_of(level)
    out = s.select("n", "effect", F.sqrt(var).alias("std_err"))
    return out.withColumns({"lower": F.col("effect") - z * F.col("std_err"), "upper": F.col("effect") + z * F.col("std_err"), "p": 2 * norm_cdf(-F.abs(F.col("effect") / F.col("std_err")))})


def partialled_effect(df: DataFrame, *, outcome: str, treatment: str, x: Sequence[str], row: str, folds: int = 5, level: float = 0.95) -> DataFrame:
    """One row: double machine learning with linear nuisance fits: residual outcome on residual treatment, cross-fitted over ``folds`` by a hash of ``row``."""
    rows = df.dropna(subset=[outcome, treatment, *x, row]).withColumn("_fold", F.pmod(F.xxhash64(row), F.lit(folds)).cast("int"))
    y, t = F.lit(None).cast("double"), F.lit(None).cast("double")
    for k in range(folds):
        rest = rows.where(F.col("_fold") != k)
        fy, ft = linear_fit(rest, outcome=outcome, x=x), linear_fit(rest, outcome=treatment, x=x)
        y = F.when(F.col("_fold") == k, F.col(outcome) - fy.predictor()).otherwise(y)
        t = F.when(F.col("_fold") == k, F.col(treatment) - ft.predictor()).otherwise(t)
    res = rows.select(y.alias("y"), t.alias("t"))
    s = res.agg(F.count("*").cast("double").alias("n"), F.sum(F.col("t") * F.col("y")).alias("ty"), F.sum(F.col("t") * F.col("t")).alias("tt")).withColumn("effect", F.try_divide("ty", "tt"))
    beside = res.crossJoin(F.broadcast(s))  # one row
    psi = F.col("t") * (F.col("y") - F.col("effect") * F.col("t"))
    z = z_of(level)
    out = beside.agg(F.max("n").alias("n"), F.max("effect").alias("effect"), (F.sqrt(F.sum(psi * psi)) / F.max("tt")).alias("std_err"))
    return out.withColumns({"lower": F.col("effect") - z * F.col("std_err"), "upper": F.col("effect") + z * F.col("std_err")})


def instrumented_cox(df: DataFrame, *, time: str, status: str, treatment: str, instruments: Sequence[str], x: Sequence[str] = (), ties: str = "breslow") -> tuple[CoxFit, tuple[float, int, float]]:
    """Cox fit on the treatment's linear projection on instruments and covariates, and the first stage's Wald test of the instruments."""
    rows = df.dropna(subset=[time, status, treatment, *instruments, *x])
    first = linear_fit(rows, outcome=treatment, x=[*instruments, *x])
    k = len(instruments)
    b, v = first.coefficients[1 : 1 + k], first.covariance[1 : 1 + k, 1 : 1 + k]
    stat = float(b @ np.linalg.pinv(v) @ b)
    fit = cox_fit(rows.withColumn("_fitted", first.predictor()), time=time, status=status, x=["_fitted", *x], ties=ties)
    return fit, (stat, k, chi2_sf(stat, k))


def mediated_effects(df: DataFrame, *, time: str, status: str, treatment: str, mediator: str, x: Sequence[str] = (), ties: str = "breslow") -> dict[str, float]:
    """Total, direct and indirect (product of coefficients) log hazard ratios, and the share mediated kept inside [-1, 2]."""
    rows = df.dropna(subset=[time, status, treatment, mediator, *x])
    alpha = linear_fit(rows, outcome=mediator, x=[treatment, *x]).coefficients[1]
    outcome = cox_fit(rows, time=time, status=status, x=[treatment, mediator, *x], ties=ties).coefficients
    direct, indirect = float(outcome[0]), float(alpha * outcome[1])
    total = direct + indirect
    return {"total": total, "direct": direct, "indirect": indirect, "share": float(np.clip(indirect / total, -1, 2)) if total else 0.0}

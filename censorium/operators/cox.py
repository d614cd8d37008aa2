"""Proportional hazards by Newton steps, each one Spark aggregation, and what follows from a fit.

At a time with D events of weight, sums over the risk set are S0, S1, S2 (of r, r x, r x x') and over the events
E0, E1, E2.  Breslow uses S; Efron takes the mean over l = 0 .. D-1 of S - (l/D) E.  Both need only six scalars a
time, sums over l of powers of l/D over powers of S0 - (l/D) E0, so no row is made per event.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from censorium.functions.lineage import cut
from censorium.functions.prefix import as_of, cuts_of, join_keys, running
from censorium.functions.riskset import timeline
from censorium.functions.special import chi2_p, chi2_sf, two_sided_p, z_of

TIES = ("efron", "breslow")
#: Distinct times that are given to all tasks at most; more meet the rows by a shuffle.
MOST_TIMES = 50_000


@dataclass
class CoxFit:
    coefficients: np.ndarray
    covariance: np.ndarray
    log_likelihood: float
    iterations: int
    null_log_likelihood: float = float("nan")
    score_statistic: float = float("nan")
    names: list[str] = field(default_factory=list)
    ties: str = "breslow"
    #: Subtracted from the linear predictor before exp, so that it can't overflow.
    shift: float = 0.0

    @property
    def std_errors(self) -> np.ndarray:
        return np.sqrt(np.diag(self.covariance))

    @property
    def wald_statistic(self) -> float:
        return float(self.coefficients @ np.linalg.pinv(self.covariance) @ self.coefficients)

    @property
    def ratio_statistic(self) -> float:
        return 2 * (self.log_likelihood - self.null_log_likelihood)

    def tests(self) -> dict[str, tuple[float, int, float]]:
        """Likelihood-ratio, Wald and score statistics with degrees of freedom and p."""
        p = len(self.coefficients)
        return {n: (x, p, chi2_sf(x, p)) for n, x in (("ratio", self.ratio_statistic), ("wald", self.wald_statistic), ("score", self.score_statistic))}

    def table(self, spark, level: float = 0.95) -> DataFrame:
        """One row per covariate: coefficient, hazard ratio with limits, error, z and p."""
        z = z_of(level)
        rows = [(n, float(b), float(np.exp(b)), float(s), float(np.exp(b - z * s)), float(np.exp(b + z * s)), float(b / s) if s else None) for n, b, s in zip(self.names, self.coefficients, self.std_errors, strict=True)]
        return spark.createDataFrame(rows, "name string, coefficient double, hazard_ratio double, std_err double, lower double, upper double, z double").withColumn("p", two_sided_p(F.col("z")))


def _total(x: Sequence[str], beta: Sequence[float], offset: str | None = None) -> Column:
    out = F.coalesce(F.col(offset).cast("double"), F.lit(0.0)) if offset else F.lit(0.0)
    for c, b in zip(x, beta, strict=True):
        out = out + F.col(c).cast("double") * float(b)
    return out


def linear_predictor(df: DataFrame, *, x: Sequence[str], coefficients: Sequence[float], offset: str | None = None, name: str = "lp") -> DataFrame:
    return df.withColumn(name, _total(x, coefficients, offset))


def _rows(df: DataFrame, time: str, status: str, x: Sequence[str], strata: Sequence[str], entry: str | None, weight: str | None) -> DataFrame:
    """Rows that take part: none with a null time, status, covariate or weight, or with entry >= time; a null stratum is a stratum, a null entry is before all times."""
    rows = df.dropna(subset=[time, status, *x, *([weight] if weight else [])])
    return rows.where(F.col(entry).isNull() | (F.col(entry) < F.col(time))) if entry else rows


#: Scalars of a time by Efron: sums over l of log(S0 - f E0) and of f^i / (S0 - f E0)^j, f = l / D; the last TERMS of them one by one.
TERMS = 64
_SUMS = f"""aggregate(sequence(greatest(0, cast(_k as int) - {TERMS}), cast(_k as int) - 1), named_struct('l', 0D, 'a', 0D, 'af', 0D, 'b', 0D, 'bf', 0D, 'bff', 0D), (s, i) -> named_struct(
 'l', s.l + ln(s0 - i / _k * e0), 'a', s.a + 1 / (s0 - i / _k * e0), 'af', s.af + i / _k / (s0 - i / _k * e0),
 'b', s.b + 1 / pow(s0 - i / _k * e0, 2), 'bf', s.bf + i / _k / pow(s0 - i / _k * e0, 2), 'bff', s.bff + pow(i / _k, 2) / pow(s0 - i / _k * e0, 2)))"""


def _first_sums() -> Column:
    """The sums over the terms before the last TERMS, however many: the formula of Euler and Maclaurin.

    From the first to the last of these the value v falls by E0 / D a term and stays above TERMS of such steps, so the
    corrections that are left out are below 1e-15.  Where E0 is a tiny share of S0, sums with f are a series in that share.
    """
    n, k, s0, e0 = F.col("_k") - TERMS, F.col("_k"), F.col("s0"), F.col("e0")
    u = e0 / k
    top, low = s0, s0 - (n - 1) * u
    x = (n - 1) * u / low
    # log(1 + x) / x
    phi = F.when(x > 0, F.log1p(x) / x).otherwise(F.lit(1.0))
    gap = lambda j: F.pow(low, -j) - F.pow(top, -j)
    ln = (n - 1) * (F.log(top) - 1 + phi) + (F.log(low) + F.log(top)) / 2 - u / 12 * gap(1) + F.pow(u, 3) / 360 * gap(3) - F.pow(u, 5) / 1260 * gap(5)
    a = (n - 1) / low * phi + (1 / low + 1 / top) / 2 + u / 12 * gap(2) - F.pow(u, 3) / 120 * gap(4) + F.pow(u, 5) / 252 * gap(6)
    b = (n - 1) / (low * top) + (F.pow(low, -2) + F.pow(top, -2)) / 2 + u / 6 * gap(3) - F.pow(u, 3) / 30 * gap(5) + F.pow(u, 5) / 42 * gap(7)
    share = e0 / s0
    m1, m2 = n * (n - 1) / 2 / k, n * (n - 1) * (2 * n - 1) / 6 / k / k
    m3, m4 = F.pow(n * (n - 1) / 2 / k, 2) / k, n * (n - 1) * (2 * n - 1) * (3 * n * n - 3 * n - 1) / 30 / F.pow(k, 4)
    tiny = share < 1e-4
    af = F.when(tiny, (m1 + m2 * share + m3 * share * share + m4 * F.pow(share, 3)) / s0).otherwise((s0 * a - n) / e0)
    bf = F.when(tiny, (m1 + 2 * m2 * share + 3 * m3 * share * share + 4 * m4 * F.pow(share, 3)) / (s0 * s0)).otherwise((s0 * b - a) / e0)
    bff = F.when(tiny, (m2 + 2 * m3 * share + 3 * m4 * share * share) / (s0 * s0)).otherwise((s0 * s0 * b - 2 * s0 * a + n) / (e0 * e0))
    return F.struct(ln.alias("l"), a.alias("a"), af.alias("af"), b.alias("b"), bf.alias("bf"), bff.alias("bff"))


def _efron_sums(line: DataFrame) -> DataFrame:
    """With ``_q``; the number of events may be any, as a time's work is bounded."""
    line = line.withColumns({"_q1": F.when(F.col("d") > 0, F.expr(_SUMS)), "_q0": F.when((F.col("d") > 0) & (F.col("_k") > TERMS), _first_sums())})
    both = F.struct(*((F.col(f"_q1.{n}") + F.coalesce(F.col(f"_q0.{n}"), F.lit(0.0))).alias(n) for n in ("l", "a", "af", "b", "bf", "bff")))
    return line.withColumn("_q", F.when(F.col("d") > 0, both)).drop("_q0", "_q1")


def _breslow_sums() -> Column:
    """The same with f = 0: all terms of a time are equal."""
    k, s0, zero = F.col("_k"), F.col("s0"), F.lit(0.0)
    return F.struct((k * F.log(s0)).alias("l"), (k / s0).alias("a"), zero.alias("af"), (k / (s0 * s0)).alias("b"), zero.alias("bf"), zero.alias("bff"))


def risk_sums(rows: DataFrame, *, time: str, status: str, x: Sequence[str], lp: Column, strata: Sequence[str], entry: str | None, weight: str | None, ties: str, second: bool = True, cuts: Sequence[float] | None = None, late: Column | None = None, grown: DataFrame | None = None, once: bool = False) -> DataFrame:
    """One row per (strata, time): event sums ``d _k e xj e0 e1_j e2_jk``, risk-set sums ``s0 s1_j s2_jk`` and, at event times, the scalars ``q``.

    ``d`` is the weight of events, ``_k`` their number.  ``q.*`` are already times d / _k.  Rows with a ``late`` weight come back
    to the risk set after their time, with that weight times ``_grown`` of the table ``grown (time, _grown)``.
    """
    if ties not in TIES:
        raise ValueError(f"ties is one of {TIES}")
    p = len(x)
    v = [F.col(c).cast("double") for c in x]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    had = (F.col(status) != 0).cast("double")
    r = w * F.exp(lp)
    pairs = [(i, j) for i in range(p) for j in range(i, p)] if second else []
    at = {"d": had * w, "_k": had, "e": had * w * lp, "n_censor": (1 - had) * w, **{f"x{i}": had * w * v[i] for i in range(p)}}
    at |= {"e0": had * r, **{f"e1_{i}": had * r * v[i] for i in range(p)}, **{f"e2_{i}_{j}": had * r * v[i] * v[j] for i, j in pairs}}
    leaving = {"s0": r, "n_risk": w, **{f"s1_{i}": r * v[i] for i in range(p)}, **{f"s2_{i}_{j}": r * v[i] * v[j] for i, j in pairs}}
    if late is not None:
        at |= {f"_l{n}": late * c for n, c in leaving.items()}
    line = timeline(rows, time=time, entry=entry, keys=strata, at=at, leaving=leaving, cuts=cuts, once=once)
    if late is not None:
        line = running(line, order="time", keys=strata, sums={f"_b{n}": F.col(f"_l{n}") for n in leaving}, strict=True, keep_bin=True).join(grown, "time")
        line = line.withColumns({n: F.col(n) + F.col("_grown") * F.col(f"_b{n}") for n in leaving}).drop(*(f"_{k}{n}" for n in leaving for k in "lb"))
    line = _efron_sums(line) if ties == "efron" else line.withColumn("_q", F.when(F.col("d") > 0, _breslow_sums()))
    scale = F.col("d") / F.col("_k")
    return line.withColumn("q", F.when(F.col("d") > 0, F.struct(*((F.col(f"_q.{n}") * scale).alias(n) for n in ("l", "a", "af", "b", "bf", "bff"))))).drop("_q")


def _means(p: int) -> list[Column]:
    """Sum over l of the weighted mean of covariate i in the risk set, times D / number of events."""
    return [F.col(f"s1_{i}") * F.col("q.a") - F.col(f"e1_{i}") * F.col("q.af") for i in range(p)]


def _second(i: int, j: int) -> Column:
    s1i, s1j, e1i, e1j = F.col(f"s1_{i}"), F.col(f"s1_{j}"), F.col(f"e1_{i}"), F.col(f"e1_{j}")
    outer = s1i * s1j * F.col("q.b") - (s1i * e1j + e1i * s1j) * F.col("q.bf") + e1i * e1j * F.col("q.bff")
    return F.col(f"s2_{i}_{j}") * F.col("q.a") - F.col(f"e2_{i}_{j}") * F.col("q.af") - outer


def _step(rows: DataFrame, beta: np.ndarray, shift: float, x: Sequence[str], offset: str | None, **how) -> tuple[float, np.ndarray, np.ndarray]:
    """Log partial likelihood, score and information at beta: p + p(p+1)/2 + 1 sums come to the driver."""
    p = len(x)
    sums = risk_sums(rows, x=x, lp=_total(x, beta, offset) - float(shift), **how).where("d > 0")
    means = _means(p)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    got = sums.agg(F.sum(F.col("e") - F.col("q.l")).alias("ll"), *(F.sum(F.col(f"x{i}") - means[i]).alias(f"u{i}") for i in range(p)), *(F.sum(_second(i, j)).alias(f"i{i}_{j}") for i, j in pairs)).first()
    info = np.zeros((p, p))
    for i, j in pairs:
        info[i, j] = info[j, i] = got[f"i{i}_{j}"] or 0.0
    return got["ll"] or 0.0, np.array([got[f"u{i}"] or 0.0 for i in range(p)]), info


def cox_fit(
    df: DataFrame, *, time: str, status: str, x: Sequence[str], strata: Sequence[str] = (), entry: str | None = None, weight: str | None = None, offset: str | None = None, ties: str = "breslow", start: Sequence[float] | None = None, eps: float = 1e-9, most: int = 20
) -> CoxFit:
    """Cox model for right-censored or (entry, time] rows with weights, offset and strata; ties by Breslow or Efron.

    Rows with a null time, status, covariate or weight drop out.  A step brings p + p(p+1)/2 + 1 sums to
    the driver, whatever the size of the input; risk-set sums run over distinct times.  Covariates are centred
    and the linear predictor shifted by its maximum, so exp can't overflow.
    """
    own = _rows(df, time, status, x, strata, entry, weight)
    kept = own.select(*dict.fromkeys([time, status, *strata, *(c for c in (entry, weight, offset) if c)]), *(F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(x))).persist()
    how = dict(time=time, status=status, strata=strata, entry=entry, weight=weight, ties=ties, cuts=cuts_of(kept.withColumn("_t", F.col(time).cast("double")), "_t"))
    try:
        return newton(centred(kept, len(x)), names=x, offset=offset, start=start, eps=eps, most=most, **how)
    finally:
        kept.unpersist()


def centred(rows: DataFrame, p: int) -> DataFrame:
    """Columns ``_c0``, ... less their means, which changes no fit but keeps products of large values from cancelling."""
    names = [f"_c{i}" for i in range(p)]
    means = rows.agg(*(F.coalesce(F.avg(c), F.lit(0.0)) for c in names)).first() if p else []
    return rows.withColumns({c: F.col(c) - float(m) for c, m in zip(names, means, strict=True)})


def newton(rows: DataFrame, *, names: Sequence[str], offset: str | None, start: Sequence[float] | None, eps: float, most: int, ties: str, **how) -> CoxFit:
    """Newton steps with halving on the columns ``_c0``, ... of rows, a step being one aggregation."""
    p = len(names)
    x = [f"_c{i}" for i in range(p)]

    def step(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float]:
        top = rows.agg(F.max(_total(x, beta, offset))).first()[0] or 0.0 if np.any(beta) or offset else 0.0
        return (*_step(rows, beta, top, x, offset, ties=ties, **how), top)

    beta = np.zeros(p) if start is None else np.asarray(start, dtype=float)
    ll, score, info, shift = step(beta)
    null, first = ll, float(score @ np.linalg.pinv(info) @ score)
    n = 0
    for n in range(1, most + 1):
        move = np.linalg.pinv(info, rcond=1e-12, hermitian=True) @ score
        new = beta + move
        found = step(new)
        while found[0] < ll - abs(ll) * eps and np.abs(move).max() > eps:
            move /= 2
            new = beta + move
            found = step(new)
        done = abs(found[0] - ll) <= eps * max(1.0, abs(found[0]))
        beta, (ll, score, info, shift) = new, found
        if done:
            break
    return CoxFit(beta, np.linalg.pinv(info, rcond=1e-12, hermitian=True), ll, n, null, first, list(names), ties, float(shift))


def _top(rows: DataFrame, lp: Column) -> float:
    """The greatest linear predictor: taken off before exp, it cancels in everything but the hazard at 0."""
    return rows.agg(F.max(lp)).first()[0] or 0.0


def cox_detail(df: DataFrame, *, time: str, status: str, x: Sequence[str], coefficients: Sequence[float], strata: Sequence[str] = (), entry: str | None = None, weight: str | None = None, offset: str | None = None, ties: str = "breslow") -> DataFrame:
    """Per event time at given coefficients: n_risk, n_event, hazard increment, its variance part, means ``mean_<x>`` and ``score_<x>``."""
    rows = _rows(df, time, status, x, strata, entry, weight)
    lp = _total(x, coefficients, offset)
    top = _top(rows, lp)
    at = risk_sums(rows, time=time, status=status, x=x, lp=lp - top, strata=strata, entry=entry, weight=weight, ties=ties, second=False).where("d > 0")
    means = _means(len(x))
    back = F.exp(F.lit(-top))
    return at.select(*strata, "time", "n_risk", F.col("d").alias("n_event"), (F.col("q.a") * back).alias("hazard"), (F.col("q.b") * back * back).alias("hazard_var"), *((m / F.col("d")).alias(f"mean_{c}") for m, c in zip(means, x, strict=True)), *((F.col(f"x{i}") - m).alias(f"score_{c}") for i, (m, c) in enumerate(zip(means, x, strict=True))))


def base_hazard(df: DataFrame, *, time: str, status: str, lp: str | None = None, x: Sequence[str] = (), coefficients: Sequence[float] = (), strata: Sequence[str] = (), entry: str | None = None, weight: str | None = None, ties: str = "breslow", centered: bool = False, entries: bool = False, **how) -> DataFrame:
    """Cumulative baseline hazard at every distinct time, by stratum, at lp = 0 (``centered``: at the mean lp), and exp of its negative.

    ``entries``: at times of entry too; ``how``: ``cuts`` and ``once`` of the timeline.
    """
    rows = df.withColumn("_lp", F.col(lp).cast("double") if lp else _total(x, coefficients))
    rows = _rows(rows, time, status, ["_lp"], strata, entry, weight)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    top, mean = rows.agg(F.coalesce(F.max("_lp"), F.lit(0.0)), F.coalesce(F.sum(w * F.col("_lp")) / F.sum(w), F.lit(0.0))).first()
    line = risk_sums(rows, time=time, status=status, x=[], lp=F.col("_lp") - top, strata=strata, entry=entry, weight=weight, ties=ties, second=False, **how)
    line = line.where("d > 0 or n_censor > 0") if entry and not entries else line
    hazard = F.coalesce(F.col("q.a"), F.lit(0.0)) * F.exp(F.lit((mean if centered else 0.0) - top))
    out = running(line.withColumn("hazard", hazard), order="time", keys=strata, sums={"cum_hazard": F.col("hazard")})
    out = out.select(*strata, "time", "n_risk", F.col("d").alias("n_event"), "hazard", "cum_hazard")
    return out.withColumn("surv", F.exp(-F.col("cum_hazard")))


def predict(df: DataFrame, *, x: Sequence[str], fit: CoxFit, baseline: DataFrame | None = None, at: str | None = None, strata: Sequence[str] = ()) -> DataFrame:
    """df with ``lp``, ``risk`` = exp(lp) and, with a baseline and a time column, ``expected`` events and ``surv`` by then."""
    out = linear_predictor(df, x=x, coefficients=fit.coefficients).withColumn("risk", F.exp("lp"))
    if baseline is None:
        return out
    found = as_of(out, baseline, at=at, step="time", values=["cum_hazard"], keys=strata)
    return found.withColumn("expected", F.coalesce("cum_hazard", F.lit(0.0)) * F.col("risk")).withColumn("surv", F.exp(-F.col("expected"))).drop("cum_hazard")


def residuals(
    df: DataFrame, *, time: str, status: str, x: Sequence[str], coefficients: Sequence[float], strata: Sequence[str] = (), entry: str | None = None, weight: str | None = None, offset: str | None = None, ties: str = "breslow"
) -> DataFrame:
    """Rows that take part with ``martingale``, ``deviance``, ``score_<x>`` and, on events, ``schoenfeld_<x>`` (null elsewhere).

    Every row looks up its stop (and entry) time in the table of times, which is written: equi-joins, no pairs of rows; few times go to the
    rows, so that rows aren't dealt out by them.
    """
    p = len(x)
    rows = _rows(df, time, status, x, strata, entry, weight)
    lp = _total(x, coefficients, offset)
    lp = lp - _top(rows, lp)
    line = risk_sums(rows, time=time, status=status, x=x, lp=lp, strata=strata, entry=entry, weight=weight, ties=ties, second=False)
    zero = F.lit(0.0)
    q = lambda n: F.coalesce(F.col(f"q.{n}"), zero)
    s1, e1 = [F.col(f"s1_{i}") for i in range(p)], [F.col(f"e1_{i}") for i in range(p)]
    # sums over l of the hazard, and of hazard times mean; those who die there count 1 - l/D of each
    h, hx = q("a"), [s1[i] * q("b") - e1[i] * q("bf") for i in range(p)]
    own, own_x = q("a") - q("af"), [s1[i] * (q("b") - q("bf")) - e1[i] * (q("bf") - q("bff")) for i in range(p)]
    made = line.withColumns({"_h": h, "_own": own, **{f"_hx{i}": hx[i] for i in range(p)}, **{f"_ox{i}": own_x[i] for i in range(p)}, **{f"_m{i}": _means(p)[i] / F.col("d") for i in range(p)}})
    run = running(made, order="time", keys=strata, sums={"_cum": F.col("_h"), **{f"_X{i}": F.col(f"_hx{i}") for i in range(p)}})
    steps = run.select(*strata, F.col("time").alias("_t"), "_cum", "_h", "_own", *(f"_{k}{i}" for i in range(p) for k in ("X", "hx", "ox", "m")))
    keys, steps = [*strata, "_t"], cut(steps, "steps")
    few = steps.limit(MOST_TIMES + 1).count() <= MOST_TIMES
    out = join_keys(rows.withColumn("_t", F.col(time).cast("double")), steps, keys, "left", few=few)
    past, past_x = zero, [zero] * p
    if entry:
        before = steps.select(*strata, "_t", F.col("_cum").alias("_cum0"), *(F.col(f"_X{i}").alias(f"_Y{i}") for i in range(p)))
        out = join_keys(out.withColumn("_t", F.col(entry).cast("double")), before, keys, "left", few=few)
        past, past_x = F.coalesce("_cum0", zero), [F.coalesce(F.col(f"_Y{i}"), zero) for i in range(p)]
    had = F.col(status) != 0
    risk = F.exp(lp)
    lived = F.when(had, F.col("_cum") - F.col("_h") + F.col("_own")).otherwise(F.col("_cum")) - past
    lived_x = [F.when(had, F.col(f"_X{i}") - F.col(f"_hx{i}") + F.col(f"_ox{i}")).otherwise(F.col(f"_X{i}")) - past_x[i] for i in range(p)]
    m = had.cast("double") - risk * lived
    v = [F.col(c).cast("double") for c in x]
    out = out.withColumn("martingale", m)
    made = {"deviance": F.signum("martingale") * F.sqrt(F.greatest(zero, -2 * (F.col("martingale") + F.when(had, F.log(F.greatest(F.lit(1e-300), 1 - F.col("martingale")))).otherwise(zero))))}
    for i, c in enumerate(x):
        made[f"score_{c}"] = F.when(had, v[i] - F.col(f"_m{i}")).otherwise(zero) - risk * (v[i] * lived - lived_x[i])
        made[f"schoenfeld_{c}"] = F.when(had, v[i] - F.col(f"_m{i}"))
    out = out.withColumns(made)
    return out.drop("_t", "_cum", "_h", "_own", "_cum0", *(f"_{k}{i}" for i in range(p) for k in ("X", "hx", "ox", "m", "Y")))


def dfbeta(rows: DataFrame, fit: CoxFit, *, scaled: bool = False) -> DataFrame:
    """Rows of ``residuals`` with ``dfbeta_<x>``: score residuals times the covariance (``scaled``: over the standard errors)."""
    v, se = fit.covariance, fit.std_errors
    made = {}
    for j, c in enumerate(fit.names):
        total = F.lit(0.0)
        for i, o in enumerate(fit.names):
            total = total + F.col(f"score_{o}") * float(v[i, j])
        made[f"dfbeta_{c}"] = total / float(se[j]) if scaled else total
    return rows.withColumns(made)


def robust_covariance(rows: DataFrame, fit: CoxFit, *, cluster: str | None = None, weight: str | None = None) -> np.ndarray:
    """Sandwich covariance from the rows of ``residuals``: outer products of dfbeta, summed by cluster first; p(p+1)/2 sums reach the driver."""
    names = [f"dfbeta_{c}" for c in fit.names]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    d = dfbeta(rows, fit).select(*((w * F.col(n)).alias(n) for n in names), *([F.col(cluster).alias("_c")] if cluster else []))
    if cluster:
        d = d.groupBy("_c").agg(*(F.sum(n).alias(n) for n in names))
    p = len(names)
    got = d.agg(*(F.sum(F.col(names[i]) * F.col(names[j])).alias(f"_{i}_{j}") for i in range(p) for j in range(i, p))).first()
    out = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            out[i, j] = out[j, i] = got[f"_{i}_{j}"] or 0.0
    return out


def scaled_schoenfeld(rows: DataFrame, fit: CoxFit, *, events: int) -> DataFrame:
    """Events of ``residuals`` with ``scaled_<x>`` = beta + events * residual times covariance."""
    out = rows.where(F.col(f"schoenfeld_{fit.names[0]}").isNotNull())
    made = {}
    for j, c in enumerate(fit.names):
        total = F.lit(float(fit.coefficients[j]))
        for i, o in enumerate(fit.names):
            total = total + F.col(f"schoenfeld_{o}") * float(fit.covariance[i, j] * events)
        made[f"scaled_{c}"] = total
    return out.withColumns(made)


def hazards_test(df: DataFrame, *, time: str, status: str, fit: CoxFit, transform: str = "identity", strata: Sequence[str] = (), entry: str | None = None) -> DataFrame:
    """``(term, chi_square, df, p)`` of the test of proportional hazards per covariate and over all (term GLOBAL).

    Correlation of scaled Schoenfeld residuals with a transform of time: identity, log or rank (of event times).
    """
    rows = residuals(df, time=time, status=status, x=fit.names, coefficients=fit.coefficients, strata=strata, entry=entry, ties=fit.ties).where(F.col(f"schoenfeld_{fit.names[0]}").isNotNull())
    t = F.col(time).cast("double")
    if transform == "log":
        rows = rows.withColumn("_g", F.log(t))
    elif transform == "rank":
        counts = rows.groupBy(t.alias("_t")).agg(F.count("*").cast("double").alias("_c"))
        ranks = running(counts, order="_t", sums={"_r": F.col("_c")}).select("_t", (F.col("_r") - (F.col("_c") - 1) / 2).alias("_g"))
        rows = join_keys(rows.withColumn("_t", t), ranks, ["_t"])
    elif transform == "identity":
        rows = rows.withColumn("_g", t)
    else:
        raise ValueError("transform is identity, log or rank")
    p, names = len(fit.names), [f"schoenfeld_{c}" for c in fit.names]
    got = rows.agg(F.count("*").alias("n"), F.sum("_g").alias("g"), F.sum(F.col("_g") * F.col("_g")).alias("gg"), *(F.sum(n).alias(f"r{i}") for i, n in enumerate(names)), *(F.sum(F.col("_g") * F.col(n)).alias(f"gr{i}") for i, n in enumerate(names))).first()
    n = got["n"]
    spread = got["gg"] - got["g"] ** 2 / n if n else 0.0
    u = np.array([got[f"gr{i}"] - got["g"] / n * got[f"r{i}"] for i in range(p)]) if n else np.zeros(p)
    v = fit.covariance * n
    per = [(c, float((u @ v[:, j]) ** 2 / (v[j, j] * spread)) if spread else None, 1) for j, c in enumerate(fit.names)]
    per.append(("GLOBAL", float(u @ v @ u / spread) if spread else None, p))
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("chi_square", T.DoubleType()), T.StructField("df", T.IntegerType())])
    return df.sparkSession.createDataFrame(per, schema).withColumn("p", chi2_p(F.col("chi_square"), F.col("df")))


def cause_specific(df: DataFrame, *, time: str, cause: str, x: Sequence[str], of: int, **how) -> CoxFit:
    """Cox fit for one cause of failure, others censored."""
    return cox_fit(df.withColumn("_of", (F.col(cause) == of).cast("int")), time=time, status="_of", x=x, **how)


def wald_test(fit: CoxFit, contrast: np.ndarray | None = None) -> tuple[float, int, float]:
    """Statistic, degrees of freedom and p of L b = 0 (all coefficients by default)."""
    c = np.eye(len(fit.coefficients)) if contrast is None else np.atleast_2d(contrast)
    gap, v = c @ fit.coefficients, c @ fit.covariance @ c.T
    x = float(gap @ np.linalg.pinv(v) @ gap)
    return x, len(c), chi2_sf(x, len(c))


def compare_nested(fits: Sequence[CoxFit]) -> list[tuple[float, int, float]]:
    """Sequential likelihood-ratio tests of nested fits, smallest first."""
    out = []
    for a, b in zip(fits, fits[1:], strict=False):
        x, df = 2 * (b.log_likelihood - a.log_likelihood), len(b.coefficients) - len(a.coefficients)
        out.append((x, df, chi2_sf(x, df)))
    return out


def recurrent(df: DataFrame, *, subject: str, start: str, stop: str, status: str, x: Sequence[str], model: str = "andersen-gill", number: str | None = None, ties: str = "efron") -> tuple[CoxFit, np.ndarray]:
    """Recurrent events: fit and covariance clustered by subject.

    ``andersen-gill``: (start, stop] rows; ``pwp-total`` and ``pwp-gap``: strata by event number, on total or gap
    time; ``wlw``: strata by event number, everyone at risk from 0; ``gap``: one stratum on gap time.
    """
    models = ("andersen-gill", "pwp-total", "pwp-gap", "wlw", "gap")
    if model not in models:
        raise ValueError(f"model is one of {models}")
    rows, strata, entry, time = df, [], None, stop
    if model in ("pwp-total", "pwp-gap", "wlw"):
        if number is None:
            raise ValueError("name the column of the event number")
        strata = [number]
    if model in ("andersen-gill", "pwp-total"):
        entry = start
    if model in ("pwp-gap", "gap"):
        rows, time = df.withColumn("_gap", F.greatest(F.lit(0.001), F.col(stop) - F.col(start))), "_gap"
    fit = cox_fit(rows, time=time, status=status, x=x, strata=strata, entry=entry, ties=ties)
    res = residuals(rows, time=time, status=status, x=x, coefficients=fit.coefficients, strata=strata, entry=entry, ties=ties)
    return fit, robust_covariance(res, fit, cluster=subject)


def landmark_fits(df: DataFrame, *, time: str, status: str, x: Sequence[str], at: Sequence[float], horizon: float | None = None, ties: str = "efron") -> dict[float, CoxFit]:
    """A Cox fit for each landmark on the rows still under observation, with the clock reset and, if given, events after the horizon censored."""
    out = {}
    for t in at:
        rows = df.where(F.col(time) > t).withColumn("_t", F.col(time).cast("double") - t)
        if horizon is not None:
            rows = rows.withColumns({"_e": F.when(F.col("_t") <= horizon, F.col(status)).otherwise(F.lit(0)), "_t": F.least("_t", F.lit(float(horizon)))})
        else:
            rows = rows.withColumn("_e", F.col(status))
        out[float(t)] = cox_fit(rows, time="_t", status="_e", x=x, ties=ties)
    return out

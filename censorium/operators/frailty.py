"""Shared frailty: a random effect of each cluster in the Cox model, gamma or normal on the log scale.

The effects are a table, one row a cluster; no cluster's rows meet and no effect reaches the driver.  Each round takes one Newton
step of the coefficients given the effects, sums the hazard that each cluster has been under, and from its
events and that sum finds the cluster's effect and, over all clusters, the variance that makes the
marginal likelihood largest.  Few times of the hazard go to the rows, so that only clusters' sums are shuffled.  Rounds of this kind never lower the marginal likelihood of the gamma model (EM).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from censorium.functions.lineage import cut
from censorium.functions.prefix import cuts_of, join_keys
from censorium.operators.cox import MOST_TIMES, CoxFit, _rows, _step, _total, base_hazard, residuals

KINDS = ("gamma", "normal")
#: Variances that are looked at, and their number a look.
WIDEST, GRID = (1e-4, 1e2), 200


@dataclass
class FrailtyFit:
    fit: CoxFit
    variance: float
    #: Marginal log likelihood on the scale of the partial likelihood (exact for gamma, Laplace's for normal), round by round.
    history: list[float]
    #: (cluster, effect, n_event, expected): the effect on the log scale, and the events expected without it.
    effects: DataFrame
    kind: str

    @property
    def log_likelihood(self) -> float:
        return self.history[-1]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma of positive numbers: Stirling's series at x + 8."""
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return series - sum(np.log(x + i) for i in range(8))


def _start(d, e, variance, least, most, log):
    """Where Newton steps for the mode of a normal effect begin: to the right of the root, or at 0 on its left."""
    return most(d * 0.0, least(d * variance, log(most(d, d * 0.0 + 1e-300) / most(e, e * 0.0 + 1e-300))))


def _effect(kind: str, d: Column, e: Column, variance: float) -> Column:
    """The log effect of a cluster with d events where e were expected: log of the gamma mean, or the normal mode."""
    if kind == "gamma":
        return F.log((d + 1 / variance) / (e + 1 / variance))
    start = _start(d, e, variance, F.least, F.greatest, F.log)
    return F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, lambda b, _: b + (d - e * F.exp(b) - b / variance) / (e * F.exp(b) + 1 / variance))


def _gains(kind: str, d: np.ndarray, e: np.ndarray, variance: np.ndarray) -> np.ndarray:
    """Logs of the likelihoods of clusters, averaged over their effects, summed, for each variance."""
    d, e, v = d[:, None], e[:, None], 1 / variance[None, :]
    if kind == "gamma":
        return (log_gamma(d + v) - log_gamma(v) + v * np.log(v) - (d + v) * np.log(e + v)).sum(axis=0)
    b = _start(d, e, variance[None, :], np.minimum, np.maximum, np.log)
    for _ in range(60):
        b = b + (d - e * np.exp(b) - b * v) / (e * np.exp(b) + v)
    return (d * b - e * np.exp(b) - b * b * v / 2 - np.log(1 + e * np.exp(b) / v) / 2).sum(axis=0)


def _looked(sums: DataFrame, kind: str, grid: np.ndarray) -> tuple[np.ndarray, float]:
    """Gains at each variance of the grid, and the predictors of all events: one aggregation of clusters (d, e, _plain)."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            parts = [_gains(kind, rows["d"].to_numpy()[i : i + 4096], rows["e"].to_numpy()[i : i + 4096], grid) for i in range(0, len(rows), 4096)]
            yield pd.DataFrame({"k": np.arange(len(grid) + 1), "gain": np.append(np.sum(parts, axis=0), rows["_plain"].sum())})

    got = {r["k"]: r["gain"] for r in sums.select("d", "e", "_plain").mapInPandas(look, "k int, gain double").groupBy("k").agg(F.sum("gain").alias("gain")).collect()}
    return np.array([got.get(k, 0.0) for k in range(len(grid))]), got.get(len(grid), 0.0)


def _best(grid: np.ndarray, gains: np.ndarray) -> tuple[float, float]:
    """The variance with the greatest gain and that gain, by a parabola through the best three."""
    k = int(np.argmax(gains))
    if 0 < k < len(grid) - 1:
        a, b, c = gains[k - 1 : k + 2]
        if a - 2 * b + c < 0:
            off = (a - c) / (a - 2 * b + c) / 2
            return float(grid[k] * (grid[k + 1] / grid[k]) ** off), float(b - (a - c) * off / 4)
    return float(grid[k]), float(gains[k])


def frailty_fit(
    df: DataFrame, *, time: str, status: str, x: Sequence[str], cluster: str, kind: str = "gamma", variance: float | None = None, strata: Sequence[str] = (), entry: str | None = None, offset: str | None = None, eps: float = 1e-7, most: int = 200
) -> FrailtyFit:
    """Cox model with a shared effect of each ``cluster``; ``variance`` is estimated unless given.  Ties by Breslow.

    Rows with a null time, status or covariate, or with entry >= time, drop out; a null cluster is a cluster, a null entry before all
    times, a null offset 0.  Errors of the coefficients allow for the effects (the information of both, with that among effects taken as
    diagonal).  Without events, or in an empty table, the coefficients stay 0.
    """
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}")
    p = len(x)
    own = _rows(df, time, status, x, strata, entry, None)
    off = F.coalesce(F.col(offset).cast("double"), F.lit(0.0)) if offset else F.lit(0.0)
    means = own.agg(*(F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)) for c in x)).first() if p else []
    base = own.select(
        F.col(cluster).alias("_g"), F.col(time).cast("double").alias("_t"), (F.col(status) != 0).cast("int").alias("_d"), off.alias("_off0"), *((F.col(entry).cast("double").alias("_a"),) if entry else ()),
        *(F.col(c).alias(f"_k{i}") for i, c in enumerate(strata)), *((F.col(c).cast("double") - float(m)).alias(f"_v{i}") for i, (c, m) in enumerate(zip(x, means, strict=True))),
    ).persist()
    xs, keys = [f"_v{i}" for i in range(p)], [f"_k{i}" for i in range(len(strata))]
    how = dict(time="_t", status="_d", strata=keys, entry="_a" if entry else None)
    cuts = cuts_of(base, "_t")

    def placed(effects: DataFrame | None) -> DataFrame:
        if effects is None:
            return base.withColumn("_off", F.col("_off0"))
        beside = join_keys(base, effects.select("_g", "b"), ["_g"])
        return beside.withColumn("_off", F.col("_off0") + F.col("b")).drop("b")

    try:
        beta, effects, history, theta, step = np.zeros(p), None, [], variance, 0
        for step in range(1, most + 1):
            rows = placed(effects)
            partial, score, info = _step(rows, beta, 0.0, xs, "_off", weight=None, ties="breslow", cuts=cuts, once=True, **how)
            if step == 1:
                null, first = partial, float(score @ np.linalg.pinv(info) @ score)
            move = np.linalg.pinv(info, rcond=1e-12, hermitian=True) @ score
            beta = beta + move
            # the hazard at these coefficients and effects, and what each cluster was under without its effect
            with_lp = rows.withColumn("_lp", _total(xs, beta, "_off"))
            hazard = base_hazard(with_lp, lp="_lp", ties="breslow", entries=True, cuts=cuts, once=True, **how)
            line = cut(hazard.select(*keys, F.col("time").alias("_at"), "n_event", "hazard", "cum_hazard"), "hazard")
            few = line.limit(MOST_TIMES + 1).count() <= MOST_TIMES
            # the hazard has a row at every time of the rows: equi-joins
            under = with_lp
            for name, at in (("_h1", "_t"), ("_h0", "_a"))[: 2 if entry else 1]:
                under = join_keys(under.withColumn("_at", F.col(at)), line.select(*keys, "_at", F.col("cum_hazard").alias(name)), [*keys, "_at"], "left", few=few)
            lived = F.coalesce("_h1", F.lit(0.0)) - (F.coalesce("_h0", F.lit(0.0)) if entry else F.lit(0.0))
            plain = _total(xs, beta, "_off0")
            sums = cut(under.groupBy("_g").agg(F.sum("_d").cast("double").alias("d"), F.sum(F.exp(plain) * lived).alias("e"), F.sum(F.when(F.col("_d") > 0, plain).otherwise(0.0)).alias("_plain")), "clusters")
            if variance is None:
                near = (theta / 3, theta * 3) if theta else WIDEST
                grid = np.exp(np.linspace(*np.log(np.clip(near, *WIDEST)), GRID))
            else:
                grid = np.array([variance])
            gains, said = _looked(sums, kind, grid)
            theta, gain = _best(grid, gains)
            jumps = line.agg(F.sum(F.when(F.col("n_event") > 0, F.col("n_event") * (F.log("hazard") - F.log("n_event") + 1)))).first()[0] or 0.0
            history.append(float(jumps + said + gain))
            effects = sums.withColumn("b", _effect(kind, F.col("d"), F.col("e"), theta))
            if step > 1 and abs(history[-1] - history[-2]) <= eps * max(1.0, abs(history[-1])) and np.abs(move).max(initial=0.0) <= max(eps, 1e-6) * max(1.0, np.abs(beta).max(initial=0.0)):
                break
        covariance = np.zeros((p, p))
        if p:
            final = placed(effects)
            _, _, info = _step(final, beta, 0.0, xs, "_off", weight=None, ties="breslow", cuts=cuts, once=True, **how)
            covariance = np.linalg.pinv(info - _crossed(final, effects, beta, xs, kind, theta, how), hermitian=True)
        fit = CoxFit(beta, covariance, partial, step, null, first, list(x), "breslow")
        return FrailtyFit(fit, float(theta), history, effects.select(F.col("_g").alias(cluster), F.col("b").alias("effect"), F.col("d").cast("long").alias("n_event"), F.col("e").alias("expected")), kind)
    finally:
        base.unpersist()


def _crossed(rows: DataFrame, effects: DataFrame, beta: np.ndarray, xs: Sequence[str], kind: str, theta: float, how: dict) -> np.ndarray:
    """Sum over clusters of the information between coefficients and effect, squared, over that of the effect."""
    p = len(xs)
    # what a row's score has paid for the time it was at risk is its information with the cluster's effect
    paid = residuals(rows, x=xs, coefficients=beta, offset="_off", ties="breslow", **how)
    each = paid.groupBy("_g").agg(*(F.sum(F.coalesce(F.col(f"schoenfeld_{c}"), F.lit(0.0)) - F.col(f"score_{c}")).alias(f"c{i}") for i, c in enumerate(xs)))
    both = join_keys(each, effects.select("_g", "b", "e"), ["_g"])
    own = F.col("e") * F.exp("b") + (F.exp("b") / theta if kind == "gamma" else F.lit(1 / theta))
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    got = both.agg(*(F.coalesce(F.sum(F.col(f"c{i}") * F.col(f"c{j}") / own), F.lit(0.0)) for i, j in pairs)).first()
    out = np.zeros((p, p))
    for (i, j), v in zip(pairs, got, strict=True):
        out[i, j] = out[j, i] = v
    return out

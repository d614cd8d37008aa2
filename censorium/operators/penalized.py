"""Penalised Cox models: each outer step is one Spark aggregation (score and information); the small inner problem is solved on the driver."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from censorium.functions.prefix import cuts_of
from censorium.operators.cox import _rows, _step, _total, cox_fit


@dataclass
class PenalizedFit:
    names: list[str]
    penalty: float
    coefficients: np.ndarray
    log_likelihood: float
    iterations: int

    @property
    def nonzero(self) -> list[str]:
        return [n for n, b in zip(self.names, self.coefficients, strict=True) if b]


def _standard(df: DataFrame, x: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    got = df.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(x)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(x)), F.count("*").alias("n")).first()
    return np.array([got[f"m{i}"] or 0.0 for i in range(len(x))]), np.array([got[f"s{i}"] or 1.0 for i in range(len(x))])


def _soft(v: float, by: float) -> float:
    return float(np.sign(v) * max(abs(v) - by, 0.0))


def _inner(beta: np.ndarray, score: np.ndarray, info: np.ndarray, l1: float, l2: float, groups: Sequence[int] | None) -> np.ndarray:
    """Minimise the quadratic model of the loss plus l1 |b| + l2 b^2 / 2 by coordinate descent (by blocks for groups)."""
    new, target = beta.copy(), info @ beta + score
    if groups is None:
        for _ in range(1000):
            old = new.copy()
            for j in range(len(new)):
                if info[j, j] > 0:
                    new[j] = _soft(target[j] - info[j] @ new + info[j, j] * new[j], l1) / (info[j, j] + l2)
            if np.abs(new - old).max() < 1e-10:
                break
        return new
    places = [np.flatnonzero(np.array(groups) == g) for g in sorted(set(groups))]
    steps = [np.linalg.eigvalsh(info[np.ix_(p, p)]).max() + l2 for p in places]
    for _ in range(5000):
        old = new.copy()
        for p, step in zip(places, steps, strict=True):
            if step > 0:
                v = new[p] + (target[p] - info[p] @ new - l2 * new[p]) / step
                size = np.linalg.norm(v)
                new[p] = v * max(0.0, 1 - l1 * np.sqrt(len(p)) / step / size) if size else 0.0
        if np.abs(new - old).max() < 1e-9:
            break
    return new


def elastic_net(
    df: DataFrame, *, time: str, status: str, x: Sequence[str], penalties: Sequence[float], mix: float = 1.0, groups: Sequence[int] | None = None, weight: str | None = None, ties: str = "breslow", most: int = 25, eps: float = 1e-6
) -> list[PenalizedFit]:
    """Fits along penalties (largest first, each starting from the one before): loss / n + penalty (mix |b| + (1 - mix) b^2 / 2).

    Covariates are standardised inside; coefficients come back on their own scale.  ``mix`` 1 is the lasso, 0 ridge; with ``groups``
    the first term is the groups' norms.
    """
    rows = _rows(df, time, status, x, [], None, weight)
    mean, sd = _standard(rows, x)
    scaled = rows.select(*dict.fromkeys([time, status, *([weight] if weight else [])]), *(((F.col(c) - float(mean[i])) / float(sd[i] or 1.0)).alias(f"_x{i}") for i, c in enumerate(x))).persist()
    names = [f"_x{i}" for i in range(len(x))]
    how = dict(time=time, status=status, strata=[], entry=None, weight=weight, ties=ties, cuts=cuts_of(scaled.withColumn("_t", F.col(time).cast("double")), "_t"))
    out: list[PenalizedFit] = []
    try:
        n = scaled.count()
        beta = np.zeros(len(x))

        def step(b: np.ndarray) -> tuple:
            top = (scaled.agg(F.max(_total(names, b))).first()[0] or 0.0) if b.any() else 0.0
            return _step(scaled, b, top, names, None, **how)

        ll, score, info = step(beta)
        for lam in sorted(penalties, reverse=True):
            l1, l2 = lam * mix * n, lam * (1 - mix) * n
            size = lambda b: l1 * (np.abs(b).sum() if groups is None else sum(np.sqrt((np.array(groups) == g).sum()) * np.linalg.norm(b[np.array(groups) == g]) for g in set(groups))) + l2 * b @ b / 2  # noqa: B023, E731
            done = 0
            for done in range(1, most + 1):
                new = _inner(beta, score, info, l1, l2, groups)
                found = step(new)
                while found[0] - size(new) < ll - size(beta) - 1e-9 * abs(ll) and np.abs(new - beta).max() > eps:
                    new = (new + beta) / 2
                    found = step(new)
                moved = np.abs(new - beta).max()
                beta, (ll, score, info) = new, found
                if moved < eps:
                    break
            out.append(PenalizedFit(list(x), float(lam), beta / sd, ll, done))
        return out
    finally:
        scaled.unpersist()


def largest_penalty(df: DataFrame, *, time: str, status: str, x: Sequence[str], mix: float = 1.0, ties: str = "breslow") -> float:
    """The smallest penalty at which all coefficients are 0."""
    rows = _rows(df, time, status, x, [], None, None)
    mean, sd = _standard(rows, x)
    scaled = rows.select(time, status, *(((F.col(c) - float(mean[i])) / float(sd[i] or 1.0)).alias(f"_x{i}") for i, c in enumerate(x)))
    _, score, _ = _step(scaled, np.zeros(len(x)), 0.0, [f"_x{i}" for i in range(len(x))], None, time=time, status=status, strata=[], entry=None, weight=None, ties=ties)
    return float(np.abs(score).max() / max(1, rows.count()) / max(mix, 1e-3))


def penalty_path(df: DataFrame, *, time: str, status: str, x: Sequence[str], mix: float = 1.0, steps: int = 20, ratio: float = 0.01, ties: str = "breslow") -> list[PenalizedFit]:
    """``elastic_net`` over a geometric sequence from the largest penalty down."""
    top = largest_penalty(df, time=time, status=status, x=x, mix=mix, ties=ties)
    return elastic_net(df, time=time, status=status, x=x, mix=mix, penalties=list(top * np.geomspace(1, ratio, steps)), ties=ties)


def cross_validated(df: DataFrame, *, time: str, status: str, x: Sequence[str], penalties: Sequence[float], row: str, folds: int = 5, mix: float = 1.0, ties: str = "breslow") -> list[tuple[float, float, float]]:
    """(penalty, mean, standard error) of the held-out log partial likelihood (whole less training part), folds by a hash of ``row``."""
    rows = df.withColumn("_fold", F.pmod(F.xxhash64(row), F.lit(folds)))
    how = dict(time=time, status=status, strata=[], entry=None, weight=None, ties=ties)
    scores = {float(p): [] for p in penalties}
    for k in range(folds):
        part = rows.where(F.col("_fold") != k)
        for f in elastic_net(part, time=time, status=status, x=x, penalties=penalties, mix=mix, ties=ties):
            whole, inside = (_step(_rows(d, time, status, x, [], None, None), f.coefficients, 0.0, x, None, **how)[0] for d in (rows, part))
            scores[f.penalty].append(whole - inside)
    return [(p, float(np.mean(s)), float(np.std(s) / np.sqrt(len(s)))) for p, s in sorted(scores.items(), reverse=True)]


def ridge(df: DataFrame, *, time: str, status: str, x: Sequence[str], penalty: float, ties: str = "breslow") -> PenalizedFit:
    return elastic_net(df, time=time, status=status, x=x, penalties=[penalty], mix=0.0, ties=ties)[0]


def group_lasso(df: DataFrame, *, time: str, status: str, x: Sequence[str], groups: Sequence[int], penalty: float, ties: str = "breslow") -> PenalizedFit:
    return elastic_net(df, time=time, status=status, x=x, penalties=[penalty], groups=groups, ties=ties)[0]


def screened(df: DataFrame, *, time: str, status: str, x: Sequence[str], keep: int, ties: str = "breslow") -> list[tuple[str, float]]:
    """The ``keep`` covariates with the largest marginal |z|, one Cox fit each."""
    z = []
    for c in x:
        fit = cox_fit(df, time=time, status=status, x=[c], ties=ties)
        z.append((c, float(abs(fit.coefficients[0]) / fit.std_errors[0]) if fit.std_errors[0] else 0.0))
    return sorted(z, key=lambda v: (-v[1], v[0]))[:keep]


def selection_frequency(df: DataFrame, *, time: str, status: str, x: Sequence[str], penalty: float, row: str, draws: int = 20, share: float = 0.5, ties: str = "breslow") -> dict[str, float]:
    """How often the lasso keeps each covariate on subsamples drawn by a hash of ``row``."""
    hits = dict.fromkeys(x, 0)
    for d in range(draws):
        part = df.where(F.pmod(F.xxhash64(row, F.lit(d)), F.lit(1 << 20)) < int(share * (1 << 20)))
        for c in elastic_net(part, time=time, status=status, x=x, penalties=[penalty], ties=ties)[0].nonzero:
            hits[c] += 1
    return {c: h / draws for c, h in hits.items()}

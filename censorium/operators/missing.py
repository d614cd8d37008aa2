"""Missing covariates: patterns, imputation by regression, pooling, and shifts of imputed values."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from censorium.operators.causal import linear_fit
from censorium.operators.cox import CoxFit, cox_fit


def patterns(df: DataFrame, *, columns: Sequence[str]) -> DataFrame:
    """``(pattern, n, monotone)``: 1 for each missing column, in order; monotone if nothing follows a missing one."""
    code = F.concat(*(F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns))
    return df.groupBy(code.alias("pattern")).agg(F.count("*").alias("n")).withColumn("monotone", ~F.col("pattern").contains("10"))


def missing_shares(df: DataFrame, *, columns: Sequence[str]) -> DataFrame:
    """``(column, percent)`` missing."""
    sums = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(f"_{i}") for i, c in enumerate(columns)))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), (100 * F.col(f"_{i}")).alias("percent")) for i, c in enumerate(columns)))).alias("x")).select("x.*")


def imputed(df: DataFrame, *, column: str, x: Sequence[str], row: str, seed: int = 0) -> DataFrame:
    """df with nulls of ``column`` drawn around its regression on x: residual spread times a normal deviate made from a hash of ``row`` and the seed."""
    fit = linear_fit(df, outcome=column, x=x)
    known = df.dropna(subset=[column, *x])
    spread = known.agg(F.stddev_pop(F.col(column) - fit.predictor()).alias("s")).first()["s"] or 0.0
    u = lambda k: (F.pmod(F.xxhash64(row, F.lit(seed), F.lit(k)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    normal = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * np.pi * u(2))
    return df.withColumn(column, F.when(F.col(column).isNull(), fit.predictor() + normal * float(spread)).otherwise(F.col(column).cast("double")))


def pooled(fits: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Rubin's rules: mean estimate and total covariance of (estimate, covariance) pairs."""
    b = np.array([e for e, _ in fits])
    within = np.mean([v for _, v in fits], axis=0)
    gap = b - b.mean(axis=0)
    between = gap.T @ gap / max(1, len(fits) - 1)
    return b.mean(axis=0), within + (1 + 1 / len(fits)) * between


def imputed_cox(df: DataFrame, *, time: str, status: str, x: Sequence[str], missing: str, row: str, imputations: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Cox estimates over several imputations of one column, pooled."""
    others = [c for c in x if c != missing]
    fits: list[CoxFit] = [cox_fit(imputed(df, column=missing, x=others, row=row, seed=s), time=time, status=status, x=x) for s in range(imputations)]
    return pooled([(f.coefficients, f.covariance) for f in fits])


def pattern_fits(df: DataFrame, *, time: str, status: str, x: Sequence[str], pattern: str) -> tuple[np.ndarray, dict]:
    """A Cox fit for each dropout pattern, and their mean by pattern size."""
    sizes = {r[pattern]: r["n"] for r in df.dropna(subset=[time, status, pattern, *x]).groupBy(pattern).agg(F.count("*").alias("n")).collect()}
    fits = {k: cox_fit(df.where(F.col(pattern) == F.lit(k)), time=time, status=status, x=x) for k in sorted(sizes, key=str)}
    total = sum(sizes.values())
    return sum((fits[k].coefficients * sizes[k] / total for k in fits), np.zeros(len(x))), fits


def shifted_fits(df: DataFrame, *, time: str, status: str, x: Sequence[str], dropped: str, deltas: Sequence[float]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(delta, estimate, error) of Cox fits in which the times of dropped-out rows are multiplied by exp(-delta)."""
    out = []
    for d in deltas:
        rows = df.withColumn("_t", F.when(F.col(dropped) != 0, F.col(time) * float(np.exp(-d))).otherwise(F.col(time).cast("double")))
        fit = cox_fit(rows, time="_t", status=status, x=x)
        out.append((float(d), fit.coefficients, fit.std_errors))
    return out


def tipping_point(fits: Sequence[tuple[float, np.ndarray, np.ndarray]], *, index: int, target: float = 0.0) -> float | None:
    """The delta at which a coefficient crosses the target, between the two fits around it."""
    for (d0, b0, _), (d1, b1, _) in zip(fits, fits[1:], strict=False):
        if (b0[index] - target) * (b1[index] - target) <= 0 and b0[index] != b1[index]:
            return float(d0 + (target - b0[index]) * (d1 - d0) / (b1[index] - b0[index]))
    return None

"""Comparison of groups: the weighted log-rank family for any number of groups and strata, trend, hazard ratio, risk difference."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from censorium.functions.lineage import cut
from censorium.functions.prefix import join_keys, running
from censorium.functions.riskset import timeline
from censorium.functions.special import chi2_p, norm_cdf, z_of
from censorium.operators.curves import _exactly_two, kaplan_meier

WEIGHTS = ("logrank", "wilcoxon", "tarone-ware", "peto", "fleming-harrington")


def _weight(name: str, rho: float, gamma: float) -> Column:
    """Weight at a time by the number at risk and the pooled curve just before it."""
    if name not in WEIGHTS:
        raise ValueError(f"weights are one of {WEIGHTS}")
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_before")))
    if name == "wilcoxon":
        return F.col("_n")
    if name == "tarone-ware":
        return F.sqrt("_n")
    if name == "peto":
        return s
    if name == "fleming-harrington" and (rho or gamma):
        return F.pow(s, F.lit(float(rho))) * F.pow(1 - s, F.lit(float(gamma)))
    return F.lit(1.0)


def _cells(df: DataFrame, time: str, status: str, group: str, strata: Sequence[str], entry: str | None, weights: str, rho: float, gamma: float) -> DataFrame:
    """One row per (strata, time with events, group): ``_d _n _w _g _dg _ng``, groups without anybody at risk left out."""
    rows = df.where(F.col(time).isNotNull() & F.col(status).isNotNull() & F.col(group).isNotNull())
    if entry:
        rows = rows.where(F.col(entry).isNull() | (F.col(entry) < F.col(time)))
    one = F.lit(1.0)
    d = (F.col(status) != 0).cast("double")
    by_group = rows.groupBy(*strata, group, F.col(time).cast("double").alias("time")).agg(F.sum(d).alias("_dg"))
    pooled = timeline(rows, time=time, entry=entry, keys=strata, at={"_d": d}, leaving={"_n": one})
    if weights == "peto" or (weights == "fleming-harrington" and (rho or gamma)):
        factor = F.when(F.col("_n") > 0, 1 - F.col("_d") / F.col("_n")).otherwise(F.lit(1.0))
        pooled = running(pooled, order="time", keys=strata, products={"_before": factor}, strict=True)
    else:
        pooled = pooled.withColumn("_before", F.lit(1.0)).drop("_bin")
    # a row per event time, read several times below
    pooled = cut(pooled.withColumn("_w", _weight(weights, rho, gamma)).where("_d > 0"), "event-times")
    # at risk of each group at every event time of the stratum: exits at or after it less entries at or after it
    groups = rows.select(*strata, group).distinct()
    grid = join_keys(pooled, groups, strata) if strata else pooled.crossJoin(F.broadcast(groups))  # groups are few by their nature
    moves = rows.select(*strata, group, F.col(time).cast("double").alias("time"), one.alias("_m"))
    if entry:
        moves = moves.unionByName(rows.where(F.col(entry).isNotNull()).select(*strata, group, F.col(entry).cast("double").alias("time"), F.lit(-1.0).alias("_m")))
    line = moves.groupBy(*strata, group, "time").agg(F.sum("_m").alias("_m")).withColumn("_at", F.lit(0))
    asked = grid.select(*strata, group, "time").withColumns({"_m": F.lit(0.0), "_at": F.lit(1)})
    both = line.unionByName(asked).groupBy(*strata, group, "time").agg(F.sum("_m").alias("_m"), F.max("_at").alias("_at"))
    risk = running(both, order="time", keys=[*strata, group], sums={"_ng": F.col("_m")}, reverse=True).where("_at = 1").select(*strata, group, "time", "_ng")
    keys = [*strata, group, "time"]
    out = join_keys(join_keys(grid, risk, keys), by_group, keys, "left")
    return out.withColumn("_dg", F.coalesce("_dg", F.lit(0.0))).where("_ng > 0")


def _scale() -> Column:
    """Hypergeometric factor d (n - d) / (n - 1) / n^2, 0 where only one is at risk."""
    return F.when(F.col("_n") > 1, F.col("_d") * (F.col("_n") - F.col("_d")) / (F.col("_n") - 1) / F.col("_n") / F.col("_n")).otherwise(F.lit(0.0))


def logrank_components(
    df: DataFrame, *, time: str, status: str, group: str, strata: Sequence[str] = (), entry: str | None = None, weights: str = "fleming-harrington", rho: float = 0.0, gamma: float = 0.0
) -> DataFrame:
    """``(group, n, observed, expected, covariance)`` summed over strata, groups in order; ``covariance``: map of group value (as text) to covariance.

    Rows with null time, status or group drop out; a null stratum is a stratum.  ``entry``: at risk from then on (delayed entry).
    """
    at = _cells(df, time, status, group, strata, entry, weights, rho, gamma)
    keys = [*strata, "time"]
    w2 = F.col("_w") * F.col("_w") * _scale()
    sums = at.groupBy(group).agg(F.sum(F.col("_w") * F.col("_dg")).alias("observed"), F.sum(F.col("_w") * F.col("_d") * F.col("_ng") / F.col("_n")).alias("expected"))
    other = at.select(*keys, F.col(group).alias("_h"), F.col("_ng").alias("_nh"))
    pair = join_keys(at, other, keys)
    v = F.sum(w2 * F.col("_ng") * (F.when(F.col(group) == F.col("_h"), F.col("_n")).otherwise(F.lit(0.0)) - F.col("_nh")))
    cov = pair.groupBy(group, "_h").agg(v.alias("_v")).groupBy(group).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("_h").cast("string"), "_v")))).alias("covariance"))
    rows = df.where(F.col(time).isNotNull() & F.col(status).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"))
    found = rows.join(sums, group, "left").join(cov, group, "left")
    return found.select(group, "n", F.coalesce("observed", F.lit(0.0)).alias("observed"), F.coalesce("expected", F.lit(0.0)).alias("expected"), "covariance").orderBy(group)


def _solved(spark: SparkSession, rows: list, group: str) -> DataFrame:
    """chi-square of observed less expected by the pseudo-inverse of the covariance: K groups, a few rows."""
    import numpy as np

    names = [str(r[group]) for r in rows]
    gap = np.array([r["observed"] - r["expected"] for r in rows])
    v = np.array([[(r["covariance"] or {}).get(n, 0.0) for n in names] for r in rows]) if rows else np.zeros((0, 0))
    k = len(rows)
    chi = float(gap[:-1] @ np.linalg.pinv(v[:-1, :-1], rcond=1e-10, hermitian=True) @ gap[:-1]) if k > 1 else None
    return spark.createDataFrame([(k, float(chi) if chi is not None else None, max(0, k - 1))], T.StructType([T.StructField("groups", T.IntegerType()), T.StructField("chi_square", T.DoubleType()), T.StructField("df", T.IntegerType())]))


def logrank_test(df: DataFrame, *, time: str, status: str, group: str, strata: Sequence[str] = (), entry: str | None = None, weights: str = "logrank", rho: float = 0.0, gamma: float = 0.0) -> DataFrame:
    """One row ``(groups, chi_square, df, p)`` of the K-group test; K rows of components come to the driver for it.

    ``weights`` is one of WEIGHTS; with fewer than two groups the statistic is null.
    """
    rows = logrank_components(df, time=time, status=status, group=group, strata=strata, entry=entry, weights=weights, rho=rho, gamma=gamma).collect()
    return _solved(df.sparkSession, rows, group).withColumn("p", chi2_p(F.col("chi_square"), F.col("df")))


def logrank(df: DataFrame, *, time: str, status: str, group: str, rho: float = 0.0, gamma: float = 0.0, strata: Sequence[str] = (), entry: str | None = None, weights: str = "fleming-harrington") -> DataFrame:
    """One row for two groups: observed and expected events of the larger group value, variance, chi-square.

    Weights are S^rho (1 - S)^gamma of the pooled curve S just before t (both 0: log-rank; rho 1: Peto–Peto),
    or another of WEIGHTS.  Another number of groups is an error: see ``logrank_test``.
    """
    at = _cells(df, time, status, group, strata, entry, weights, rho, gamma)
    names = df.where(F.col(time).isNotNull() & F.col(status).isNotNull() & F.col(group).isNotNull()).agg(F.max(group).alias("_high"), F.count_distinct(group).alias("_k"))
    high = at.join(F.broadcast(names), F.col(group) == F.col("_high"))  # one row
    e = F.col("_d") * F.col("_ng") / F.col("_n")
    v = F.col("_w") * F.col("_w") * _scale() * F.col("_ng") * (F.col("_n") - F.col("_ng"))
    total = high.agg(F.sum(F.col("_w") * F.col("_dg")).alias("observed"), F.sum(F.col("_w") * e).alias("expected"), F.sum(v).alias("variance"))
    checked = total.crossJoin(F.broadcast(names)).where(_exactly_two(group)).drop("_high", "_k")
    gap = F.col("observed") - F.col("expected")
    return checked.withColumn("chi_square", F.try_divide(gap * gap, "variance"))


def logrank_trend(df: DataFrame, *, time: str, status: str, group: str, scores: Mapping | None = None, strata: Sequence[str] = ()) -> DataFrame:
    """One row ``(statistic, variance, z, chi_square, p)`` of the test for trend over ordered groups (scores 0, 1, ... by default)."""
    at = _cells(df, time, status, group, strata, None, "logrank", 0.0, 0.0)
    if scores is None:
        order = at.select(group).distinct().agg(F.sort_array(F.collect_list(group)).alias("_names"))
        scored = at.crossJoin(F.broadcast(order)).withColumn("_s", (F.array_position("_names", F.col(group)) - 1).cast("double"))  # one row of group values
    else:
        scored = at.withColumn("_s", F.coalesce(*(F.when(F.col(group) == F.lit(k), F.lit(float(v))) for k, v in scores.items())))
    keys = [*strata, "time"]
    per = scored.groupBy(*keys).agg(F.max("_d").alias("_d"), F.max("_n").alias("_n"), F.sum(F.col("_s") * (F.col("_dg") - F.col("_d") * F.col("_ng") / F.col("_n"))).alias("_u"), F.sum(F.col("_ng") * F.col("_s")).alias("_a"), F.sum(F.col("_ng") * F.col("_s") * F.col("_s")).alias("_b"))
    out = per.agg(F.sum("_u").alias("statistic"), F.sum(_scale() * F.col("_n") * (F.col("_b") - F.col("_a") * F.col("_a") / F.col("_n"))).alias("variance"))
    z = F.try_divide(F.col("statistic"), F.sqrt("variance"))
    return out.select("statistic", "variance", z.alias("z"), (z * z).alias("chi_square"), (2 * norm_cdf(-F.abs(z))).alias("p"))


def hazard_ratio(df: DataFrame, *, time: str, status: str, group: str, level: float = 0.95) -> DataFrame:
    """One row for two groups: one-step (Peto) hazard ratio of the smaller group value against the larger, exp of (O - E) / V, with limits and p."""
    one = logrank(df, time=time, status=status, group=group)
    log, se, z = -F.try_divide(F.col("observed") - F.col("expected"), "variance"), F.try_divide(F.lit(1.0), F.sqrt("variance")), z_of(level)
    out = one.select(log.alias("log_hr"), se.alias("std_err"))
    return out.select("log_hr", "std_err", F.exp("log_hr").alias("hazard_ratio"), F.exp(F.col("log_hr") - z * F.col("std_err")).alias("lower"), F.exp(F.col("log_hr") + z * F.col("std_err")).alias("upper"), (2 * norm_cdf(-F.abs(F.col("log_hr") / F.col("std_err")))).alias("p"))


def risk_difference(df: DataFrame, *, time: str, status: str, group: str, horizon: float, level: float = 0.95) -> DataFrame:
    """One row for two groups: the curve at the horizon in the larger group value less that in the smaller, its error and limits, number needed to treat.

    A group without times up to the horizon is at 1.  The limits of the number needed to treat are given only
    if both limits of the difference have one sign.  Another number of groups is an error.
    """
    km = kaplan_meier(df.where(F.col(group).isNotNull()), time=time, status=status, keys=[group])
    until = F.max(F.when(F.col("time") <= horizon, F.struct("time", "surv", "std_err")))
    at = km.groupBy(group).agg(until.alias("e")).select(group, F.coalesce("e.surv", F.lit(1.0)).alias("s"), F.coalesce("e.std_err", F.lit(0.0)).alias("se"))
    both = at.agg(F.count("*").alias("_k"), F.max_by("s", group).alias("high"), F.min_by("s", group).alias("low"), F.sqrt(F.sum(F.col("se") * F.col("se"))).alias("std_err")).where(_exactly_two(group))
    z, d = z_of(level), F.col("difference")
    out = both.withColumn("difference", F.col("high") - F.col("low")).withColumns({"lower": d - z * F.col("std_err"), "upper": d + z * F.col("std_err"), "nnt": F.when(F.abs(d) >= 1e-10, 1 / F.abs(d)).otherwise(F.lit(float("inf")))})
    same = F.col("lower") * F.col("upper") > 0
    ends = (F.abs(1 / F.col("lower")), F.abs(1 / F.col("upper")))
    return out.select("low", "high", "difference", "std_err", "lower", "upper", "nnt", F.when(same, F.least(*ends)).alias("nnt_lower"), F.when(same, F.greatest(*ends)).alias("nnt_upper"))

"""Conformal bounds of predicted times: scores time - prediction of rows with an event, quantiles as running sums over scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from censorium.functions.prefix import as_of, join_keys, running
from censorium.functions.special import z_of
from censorium.operators.metrics import censor_curve

#: Floor of the censoring curve in weights (fixed value).
TRIM = 0.01


def weighted_quantile(df: DataFrame, *, value: str, q: Column, weight: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, quantile)``: where the running weight over ascending values reaches q times the total, between the two values around it.

    Equal values are one step.  ``q`` may use ``_n``, the group's number of rows.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.where(F.col(value).isNotNull())
    steps = rows.groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.sum(w).alias("w"))
    totals = rows.groupBy(*keys).agg(F.sum(w).alias("_w"), F.count("*").cast("double").alias("_n"))
    run = running(steps, order="v", keys=keys, sums={"until": F.col("w")}, keep_bin=True)
    run = running(run, order="v", keys=keys, maxima={"before": F.col("v")}, strict=True)
    both = join_keys(run, totals, keys, few=not keys).withColumn("_target", F.least(F.lit(1.0), q) * F.col("_w"))
    reached = F.col("until") >= F.col("_target") - 1e-12
    inner = F.when(F.col("before").isNull() | (F.abs(F.col("until") - F.col("_target")) < 1e-10), F.col("v")).otherwise(F.col("before") + (F.col("_target") - (F.col("until") - F.col("w"))) / F.col("w") * (F.col("v") - F.col("before")))
    found = both.groupBy(*keys).agg(F.min(F.when(reached, F.struct("v", inner.alias("x")))).alias("_f"), F.max("v").alias("_top"), F.max("_n").cast("long").alias("n"))
    return found.select(*keys, "n", F.coalesce("_f.x", "_top").alias("quantile"))


def scores(df: DataFrame, *, time: str, status: str, prediction: str, weighted: bool = True) -> DataFrame:
    """Rows with an event, with ``score`` = time - prediction and ``weight`` = 1 / max(G(time-), TRIM)."""
    rows = df.dropna(subset=[time, status, prediction])
    events = rows.where(F.col(status) != 0).withColumn("score", F.col(time) - F.col(prediction))
    if not weighted:
        return events.withColumn("weight", F.lit(1.0))
    g = censor_curve(rows, time=time, status=status)
    looked = as_of(events, g, at=time, step="time", values=["censor_surv"], strict=True)
    return looked.withColumn("weight", 1 / F.greatest(F.coalesce("censor_surv", F.lit(1.0)), F.lit(TRIM))).drop("censor_surv")


def calibrate(df: DataFrame, *, time: str, status: str, prediction: str, coverage: float = 0.9, weighted: bool = True, importance: str | None = None) -> DataFrame:
    """One row ``(n, threshold, n_effective)``: the weighted quantile of scores at level (1 - coverage)(1 + 1/n).

    ``importance`` multiplies the weights (covariate shift).
    """
    s = scores(df, time=time, status=status, prediction=prediction, weighted=weighted)
    if importance:
        s = s.withColumn("weight", F.col("weight") * F.col(importance))
    q = weighted_quantile(s, value="score", weight="weight", q=(1 - coverage) * (1 + 1 / F.col("_n")))
    size = s.agg(F.try_divide(F.pow(F.sum("weight"), 2), F.sum(F.col("weight") * F.col("weight"))).alias("n_effective"))
    return q.crossJoin(F.broadcast(size)).select("n", F.col("quantile").alias("threshold"), "n_effective")  # one row each


def lower_bounds(df: DataFrame, calibration: DataFrame, *, prediction: str) -> DataFrame:
    """df with ``lower_bound`` = max(prediction - threshold, 0)."""
    return df.crossJoin(F.broadcast(calibration.select(F.col("threshold").alias("_q")))).withColumn("lower_bound", F.greatest(F.lit(0.0), F.col(prediction) - F.col("_q"))).drop("_q")  # one row


def calibrate_by_group(df: DataFrame, *, time: str, status: str, prediction: str, group: str, coverage: float = 0.9, least: int = 10) -> DataFrame:
    """``(group, n, threshold)``: quantiles of scores by group; groups with fewer than ``least`` events take the quantile over all (group null)."""
    s = scores(df, time=time, status=status, prediction=prediction, weighted=False)
    level = (1 - coverage) * (1 + 1 / F.col("_n"))
    own = weighted_quantile(s.where(F.col(group).isNotNull()), value="score", q=level, keys=[group])
    whole = weighted_quantile(s, value="score", q=level).select(F.col("n").alias("_n"), F.col("quantile").alias("_all"))
    named = own.crossJoin(F.broadcast(whole)).select(group, "n", F.when(F.col("n") >= least, F.col("quantile")).otherwise(F.col("_all")).alias("threshold"))  # one row
    return named.unionByName(whole.select(F.lit(None).cast(own.schema[group].dataType).alias(group), F.col("_n").alias("n"), F.col("_all").alias("threshold")))


def bounds_by_group(df: DataFrame, calibration: DataFrame, *, prediction: str, group: str) -> DataFrame:
    """df with ``lower_bound`` by its group's threshold; unknown and null groups take that over all."""
    whole = calibration.where(F.col(group).isNull()).select(F.col("threshold").alias("_all"))
    own = calibration.where(F.col(group).isNotNull()).select(group, F.col("threshold").alias("_own"))
    out = df.join(own, group, "left").crossJoin(F.broadcast(whole))  # one row
    return out.withColumn("lower_bound", F.greatest(F.lit(0.0), F.col(prediction) - F.coalesce("_own", "_all"))).drop("_own", "_all")


def calibrate_two_sided(df: DataFrame, *, time: str, status: str, prediction: str, coverage: float = 0.9) -> DataFrame:
    """One row ``(n, lower, upper)``: quantiles of prediction - time and of time - prediction at level (1 - (1 - coverage)/2)(n + 1)/n."""
    s = scores(df, time=time, status=status, prediction=prediction, weighted=False).withColumn("_down", -F.col("score"))
    level = (1 - (1 - coverage) / 2) * (F.col("_n") + 1) / F.col("_n")
    low = weighted_quantile(s, value="_down", q=level).select("n", F.col("quantile").alias("lower"))
    high = weighted_quantile(s, value="score", q=level).select(F.col("quantile").alias("upper"))
    return low.crossJoin(F.broadcast(high))  # one row each


def two_sided_bounds(df: DataFrame, calibration: DataFrame, *, prediction: str) -> DataFrame:
    """df with ``lower_bound`` and ``upper_bound``."""
    out = df.crossJoin(F.broadcast(calibration.select(F.col("lower").alias("_l"), F.col("upper").alias("_u"))))  # one row
    return out.withColumns({"lower_bound": F.greatest(F.lit(0.0), F.col(prediction) - F.col("_l")), "upper_bound": F.col(prediction) + F.col("_u")}).drop("_l", "_u")


def coverage(df: DataFrame, *, time: str, status: str, lower: str, upper: str | None = None, level: float = 0.95) -> DataFrame:
    """One row over rows with an event: share inside the bounds with normal limits, mean bound and mean width."""
    rows = df.dropna(subset=[time, status, lower])
    had = F.col(status) != 0
    inside = F.col(time) >= F.col(lower)
    if upper:
        inside = inside & (F.col(time) <= F.col(upper))
    out = rows.agg(F.sum(had.cast("long")).alias("n_events"), F.avg(F.when(had, inside.cast("double"))).alias("coverage"), F.avg(lower).alias("mean_lower"), (F.avg(F.col(upper) - F.col(lower)) if upper else F.lit(None).cast("double")).alias("mean_width"))
    half = z_of(level) * F.sqrt(F.col("coverage") * (1 - F.col("coverage")) / F.col("n_events"))
    return out.withColumns({"coverage_lower": F.greatest(F.lit(0.0), F.col("coverage") - half), "coverage_upper": F.least(F.lit(1.0), F.col("coverage") + half)})


def widths(df: DataFrame, *, lower: str, upper: str, prediction: str) -> DataFrame:
    """One row: mean, standard deviation and quartiles of widths, and the mean width relative to the prediction."""
    w = F.col(upper) - F.col(lower)
    return df.dropna(subset=[lower, upper, prediction]).agg(F.avg(w).alias("mean_width"), F.stddev_samp(w).alias("std_width"), *(F.percentile(w, p).alias(n) for p, n in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))), F.avg(F.try_divide(w, F.col(prediction))).alias("relative_width"))

"""Reliability of units: scales of a curve, residual life, warranty, renewal, growth; and quality-adjusted time."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from censorium.functions.prefix import join_keys, running
from censorium.functions.special import norm_cdf, norm_quantile, z_of
from censorium.operators.curves import kaplan_meier

SCALES = ("surv", "cumhaz", "cloglog", "loglogistic", "probit")


def on_scale(df: DataFrame, *, surv: str, scale: str = "cumhaz", std_err: str | None = None, level: float = 0.95) -> DataFrame:
    """df with ``estimate`` of a curve on a scale of SCALES and, given its error, ``estimate_std_err``, ``lower`` and ``upper`` there.

    Values that a scale can't hold (0 or 1) are null.
    """
    if scale not in SCALES:
        raise ValueError(f"scale is one of {SCALES}")
    s = F.col(surv).cast("double")
    open_ = (s > 0) & (s < 1)
    quantile = norm_quantile(F.when(open_, 1 - s))
    estimate = {"surv": s, "cumhaz": F.when(s > 0, -F.log(s)), "cloglog": F.when(open_, F.log(-F.log(s))), "loglogistic": F.when(open_, F.log((1 - s) / s)), "probit": quantile}[scale]
    out = df.withColumn("estimate", estimate)
    if std_err is None:
        return out
    e, z = F.col(std_err).cast("double"), z_of(level)
    density = F.exp(-0.5 * F.col("estimate") * F.col("estimate")) / math.sqrt(2 * math.pi)
    se = {"surv": e, "cumhaz": e / s, "cloglog": e / (s * -F.log(s)), "loglogistic": e / (s * (1 - s)), "probit": e / density}[scale]
    fine = F.lit(True) if scale == "surv" else (e > 0) & ((s > 0) if scale == "cumhaz" else open_)
    out = out.withColumn("estimate_std_err", F.when(fine, se))
    low, high = F.col("estimate") - z * F.col("estimate_std_err"), F.col("estimate") + z * F.col("estimate_std_err")
    if scale in ("surv", "cumhaz"):
        low = F.greatest(F.lit(0.0), low)
    if scale == "surv":
        high = F.least(F.lit(1.0), high)
    missing = F.col("estimate_std_err").isNull()
    return out.withColumns({"lower": F.when(~missing, low), "upper": F.when(~missing, high)})


def from_scale(df: DataFrame, *, estimate: str, scale: str) -> DataFrame:
    """The curve value ``surv`` of an estimate on a scale."""
    if scale not in SCALES:
        raise ValueError(f"scale is one of {SCALES}")
    e = F.col(estimate).cast("double")
    back: Column = {"surv": e, "cumhaz": F.exp(-e), "cloglog": F.exp(-F.exp(e)), "loglogistic": 1 / (1 + F.exp(e)), "probit": 1 - norm_cdf(e)}[scale]
    return df.withColumn("surv", back)


def failure_probability(df: DataFrame, *, surv: str) -> DataFrame:
    return df.withColumn("failure", 1 - F.col(surv))


def conditional_reliability(curve: DataFrame, *, time: str, surv: str, given: float, keys: Sequence[str] = ()) -> DataFrame:
    """The curve divided by its value at ``given`` (1 before the first time), with the clock set to zero there; null where that is 0."""
    at = curve.groupBy(*keys).agg(F.max(F.when(F.col(time) <= given, F.struct(time, surv))).alias("_g"))
    both = join_keys(curve, at, keys, few=not keys)
    base = F.coalesce(F.col(f"_g.{surv}"), F.lit(1.0))
    return both.withColumns({surv: F.try_divide(F.col(surv), base), time: F.col(time) - given}).drop("_g")


def residual_life(curve: DataFrame, *, time: str, surv: str, at: float) -> DataFrame:
    """One row: trapezoid area of the curve from its first time at or after ``at``, over its value there.

    The area is a sum over rows: each value counts half the time between its neighbours, which running maxima and minima give.
    """
    rows = curve.where(F.col(time) >= at).select(F.col(time).cast("double").alias("t"), F.col(surv).cast("double").alias("s"))
    near = running(rows, order="t", maxima={"_before": F.col("t")}, strict=True, keep_bin=True)
    near = running(near, order="t", maxima={"_after": -F.col("t")}, reverse=True, strict=True)
    left, right = F.col("t") - F.coalesce("_before", F.col("t")), F.coalesce(-F.col("_after"), F.col("t")) - F.col("t")
    area = near.agg(F.sum(F.col("s") * (left + right) / 2).alias("_a"))
    base = curve.agg(F.max(F.when(F.col(time) <= at, F.struct(F.col(time), F.col(surv).cast("double").alias("s")))).alias("_g"))
    s0 = F.coalesce("_g.s", F.lit(1.0))
    return area.crossJoin(F.broadcast(base)).select(F.when(s0 > 0, F.coalesce("_a", F.lit(0.0)) / s0).otherwise(F.lit(0.0)).alias("residual_life"))  # one row


def warranty(df: DataFrame, *, time: str, status: str, units: int, period: float, cost: float, discount: float = 0.0, points: int = 100) -> DataFrame:
    """``(time, failures, cost)`` on a grid over the warranty period: expected failures of so many units and their discounted cost."""
    km = kaplan_meier(df, time=time, status=status)
    grid = [period * i / points for i in range(points + 1)]
    at = km.agg(*(F.min(F.when(F.col("time") <= t, F.col("surv"))).alias(f"_{i}") for i, t in enumerate(grid)))
    long = at.select(F.explode(F.array(*(F.struct(F.lit(t).alias("time"), F.coalesce(F.col(f"_{i}"), F.lit(1.0)).alias("s")) for i, t in enumerate(grid)))).alias("x")).select("x.*")
    failures = units * (1 - F.col("s"))
    return long.select("time", failures.alias("failures"), (failures * cost * F.exp(-discount * F.col("time"))).alias("cost"))


def renewal(df: DataFrame, *, time: str, status: str, horizon: float, repair: float = 0.0) -> DataFrame:
    """One row: mean time between failures, expected renewals by the horizon (horizon / mean), their variance, availability."""
    out = df.where(F.col(time).isNotNull() & (F.col(status) != 0)).agg(F.avg(time).alias("_m"), F.var_samp(time).alias("_v"))
    m = F.coalesce("_m", F.lit(float(horizon)))
    out = out.select(m.alias("mtbf"), F.coalesce("_v", m * m).alias("_v"))
    return out.select("mtbf", F.try_divide(F.lit(float(horizon)), F.col("mtbf")).alias("renewals"), F.try_divide(horizon * F.col("_v"), F.pow("mtbf", 3)).alias("renewal_variance"), (F.col("mtbf") / (F.col("mtbf") + repair) if repair > 0 else F.lit(1.0)).alias("availability"))


def growth(df: DataFrame, *, cumulative_time: str) -> DataFrame:
    """One row: growth rate 1 - slope of ln(failure number) on ln(cumulative time), first and last mean time between failures.

    Failure numbers are running counts over distinct times (equal times take consecutive numbers, whose mean logarithm enters).
    """
    rows = df.where(F.col(cumulative_time).isNotNull()).groupBy(F.col(cumulative_time).cast("double").alias("t")).agg(F.count("*").alias("c"))
    run = running(rows, order="t", sums={"_before": F.col("c")}, strict=True)
    logs = F.aggregate(F.sequence(F.lit(1), F.col("c").cast("int")), F.lit(0.0), lambda s, i: s + F.log(F.col("_before") + i))
    x = F.log(F.greatest(F.lit(1e-10), F.col("t")))
    sums = run.agg(F.sum("c").alias("n"), F.sum(F.col("c") * x).alias("x"), F.sum(F.col("c") * x * x).alias("xx"), F.sum(logs).alias("y"), F.sum(x * logs).alias("xy"), F.min("t").alias("first"), F.max("t").alias("last"))
    slope = F.coalesce(F.try_divide(F.col("xy") - F.col("x") * F.col("y") / F.col("n"), F.col("xx") - F.col("x") * F.col("x") / F.col("n")), F.lit(1.0))
    return sums.select("n", (1 - slope).alias("growth_rate"), F.col("first").alias("initial_mtbf"), (F.col("last") / F.col("n")).alias("final_mtbf"))


def quality_adjusted_time(df: DataFrame, *, time: str, status: str, utilities: Sequence[tuple[float, float]], discount: float = 0.03, horizon: float, keys: Sequence[str] = ()) -> DataFrame:
    """Per group: trapezoid area of the curve times utility up to the horizon (``qaly``), discounted, and without utility (``life_years``).

    ``utilities`` holds (from time, utility) steps.  Periods lie between distinct times, requested horizon included; each
    takes the utility at its start and the discount at its middle.
    """
    km = kaplan_meier(df, time=time, status=status, keys=keys).where(F.col("time") <= horizon).select(*keys, "time", "surv")
    ends = df.where(F.col(time).isNotNull() & F.col(status).isNotNull()).select(*keys).distinct() if keys else df.limit(1).select(F.lit(1).alias("_x")).drop("_x")
    fixed = [0.0, float(horizon), *(t for t, _ in utilities if 0 < t < horizon)]
    marks = ends.withColumn("time", F.explode(F.array(*(F.lit(float(t)) for t in sorted(set(fixed))))))
    line = km.unionByName(marks.withColumn("surv", F.lit(None).cast("double"))).groupBy(*keys, "time").agg(F.min("surv").alias("surv"))
    run = running(line, order="time", keys=keys, maxima={"_low": -F.col("surv")}, keep_bin=True)
    run = run.withColumn("_s", F.coalesce(-F.col("_low"), F.lit(1.0)))
    before = running(run, order="time", keys=keys, maxima={"_t0": F.col("time"), "_low0": -F.col("_s")}, strict=True).where("_t0 is not null")
    s0 = -F.col("_low0")
    utility = F.lit(1.0)
    for t, u in sorted(utilities):
        utility = F.when(F.col("_t0") >= t, F.lit(float(u))).otherwise(utility)
    area, middle = (s0 + F.col("_s")) / 2 * (F.col("time") - F.col("_t0")), (F.col("time") + F.col("_t0")) / 2
    out = before.groupBy(*keys).agg(F.sum(area * utility).alias("qaly"), F.sum(area * utility * F.pow(F.lit(1 + discount), -middle)).alias("discounted_qaly"), F.sum(area).alias("life_years"))
    return out.withColumn("mean_utility", F.try_divide("qaly", "life_years"))


def cost_effectiveness(df: DataFrame, *, qaly_treated: str, qaly_control: str, cost_treated: str, cost_control: str, threshold: float) -> DataFrame:
    """df with differences, ``icer``, ``net_monetary_benefit`` and ``cost_effective`` at a willingness to pay."""
    q, c = F.col(qaly_treated) - F.col(qaly_control), F.col(cost_treated) - F.col(cost_control)
    return df.withColumns({"qaly_difference": q, "cost_difference": c}).withColumns({"icer": F.try_divide(F.col("cost_difference"), F.col("qaly_difference")), "net_monetary_benefit": threshold * F.col("qaly_difference") - F.col("cost_difference")}).withColumn("cost_effective", F.col("net_monetary_benefit") > 0)


def time_without_toxicity(df: DataFrame, *, time: str, toxicity_start: str, toxicity_end: str, relapse: str, tau: float, utility_toxicity: float = 0.5, utility_relapse: float = 0.5, keys: Sequence[str] = ()) -> DataFrame:
    """Mean time with toxicity, without either, and after relapse up to tau, and their utility-weighted sum, by group."""
    obs = F.least(F.col(time).cast("double"), F.lit(float(tau)))
    begin, end = F.greatest(F.lit(0.0), F.col(toxicity_start)), F.least(F.coalesce(F.col(toxicity_end).cast("double"), obs), obs)
    tox = F.when(F.col(toxicity_start).isNotNull(), F.greatest(F.lit(0.0), end - begin)).otherwise(F.lit(0.0))
    rel = F.when(F.col(relapse) < obs, obs - F.col(relapse)).otherwise(F.lit(0.0))
    out = df.where(F.col(time).isNotNull()).groupBy(*keys).agg(F.avg(tox).alias("toxicity"), F.avg(F.greatest(F.lit(0.0), obs - tox - rel)).alias("free"), F.avg(rel).alias("relapse"), F.avg(obs).alias("total"))
    return out.withColumn("qtwist", utility_toxicity * F.col("toxicity") + F.col("free") + utility_relapse * F.col("relapse"))


def toxicity_sensitivity(df: DataFrame, *, utilities_toxicity: Sequence[float], utilities_relapse: Sequence[float], **how) -> DataFrame:
    """``time_without_toxicity`` over a grid of utilities, from one aggregation."""
    means = time_without_toxicity(df, **how)
    grid = F.array(*(F.struct(F.lit(float(a)).alias("utility_toxicity"), F.lit(float(b)).alias("utility_relapse")) for a in utilities_toxicity for b in utilities_relapse))
    out = means.drop("qtwist").withColumn("_u", F.explode(grid)).select("*", "_u.*").drop("_u")
    return out.withColumn("qtwist", F.col("utility_toxicity") * F.col("toxicity") + F.col("free") + F.col("utility_relapse") * F.col("relapse"))

"""Curves: Kaplan–Meier, Nelson–Aalen, life table, quantiles, restricted mean, cumulative incidence, and what is read off them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from censorium.functions.prefix import as_of, join_keys, running
from censorium.functions.riskset import cells
from censorium.functions.special import norm_cdf, z_of

KINDS = ("plain", "log", "log-log", "logit", "arcsin", "none")


def confidence_limits(p: Column, se: Column, *, kind: str = "log", level: float = 0.95) -> tuple[Column, Column]:
    """Limits of a probability by interval type; where se <= 0 or p is 0 or 1 both are p.

    ``se`` is the error of p itself (not of its logarithm).
    """
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}")
    if kind == "none":
        return F.lit(None).cast("double"), F.lit(None).cast("double")
    z = z_of(level)
    inside = (se > 0) & (p > 0) & (p < 1)
    if kind == "plain":
        ends = (p - z * se, p + z * se)
    elif kind == "log":
        ends = tuple(F.exp(F.log(p) + s * z * se / p) for s in (-1, 1))
    elif kind == "log-log":
        ends = tuple(F.exp(-F.exp(F.log(-F.log(p)) - s * z * se / (p * F.log(p)))) for s in (1, -1))
        ends = (F.least(*ends), F.greatest(*ends))
    elif kind == "logit":
        ends = tuple(1 - 1 / (1 + F.exp(F.log(p / (1 - p)) + s * z * se / (p * (1 - p)))) for s in (-1, 1))
    else:
        half = 0.5 * z * se / F.sqrt(p * (1 - p))
        ends = (F.pow(F.sin(F.greatest(F.lit(0.0), F.asin(F.sqrt(p)) - half)), 2), F.pow(F.sin(F.least(F.lit(1.5707963267948966), F.asin(F.sqrt(p)) + half)), 2))
    return tuple(F.when(inside, F.greatest(F.lit(0.0), F.least(F.lit(1.0), e))).otherwise(p) for e in ends)


def _ratio(d: str, n: str) -> Column:
    return F.when(F.col(n) > 0, F.col(d) / F.col(n)).otherwise(F.lit(0.0))


def curve_of_counts(at: DataFrame, *, keys: Sequence[str] = (), level: float = 0.95, kind: str = "log") -> DataFrame:
    """Estimates from ``(keys, time, n_event, n_risk, ...)``: curve, Greenwood error, limits, cumulative hazard and its variance."""
    hazard = _ratio("n_event", "n_risk")
    term = F.when((F.col("n_risk") > F.col("n_event")) & (F.col("n_event") > 0), F.col("n_event") / (F.col("n_risk") * (F.col("n_risk") - F.col("n_event")))).otherwise(F.lit(0.0))
    square = F.when(F.col("n_risk") > 0, F.col("n_event") / (F.col("n_risk") * F.col("n_risk"))).otherwise(F.lit(0.0))
    out = running(at, order="time", keys=keys, products={"surv": 1 - hazard}, sums={"_g": term, "cum_hazard": hazard, "cum_hazard_var": square})
    out = out.withColumn("std_err", F.col("surv") * F.sqrt("_g"))
    lower, upper = confidence_limits(F.col("surv"), F.col("std_err"), kind=kind, level=level)
    return out.withColumns({"lower": lower, "upper": upper}).drop("_g")


def kaplan_meier(
    df: DataFrame, *, time: str, status: str, keys: Sequence[str] = (), weight: str | None = None, entry: str | None = None, level: float = 0.95, kind: str = "log", reverse: bool = False
) -> DataFrame:
    """One row per group and distinct time: risk set, events, curve, Greenwood error, limits of one of KINDS, cumulative hazard.

    ``reverse`` swaps events and censorings.  Rows with null time or status drop out, null groups are a group.
    """
    at = cells(df, time=time, status=status, keys=keys, weight=weight, entry=entry, keep_bin=not reverse)
    if reverse:
        # those who had the event are no longer at risk of being censored at the same time
        at = at.withColumns({"n_event": F.col("n_censor"), "n_censor": F.col("n_event"), "n_risk": F.col("n_risk") - F.col("n_event")})
    return curve_of_counts(at, keys=keys, level=level, kind=kind)


def nelson_aalen(df: DataFrame, *, time: str, status: str, keys: Sequence[str] = (), weight: str | None = None, level: float = 0.95) -> DataFrame:
    """Cumulative hazard, its variance and normal limits (floored at 0), and the curve that follows from it."""
    km = kaplan_meier(df, time=time, status=status, keys=keys, weight=weight)
    half = z_of(level) * F.sqrt("cum_hazard_var")
    return km.select(*keys, "time", "n_risk", "n_event", "cum_hazard", "cum_hazard_var", F.greatest(F.lit(0.0), F.col("cum_hazard") - half).alias("lower"), (F.col("cum_hazard") + half).alias("upper"), F.exp(-F.col("cum_hazard")).alias("surv"))


def quantile_time(df: DataFrame, *, time: str, status: str, keys: Sequence[str] = (), q: float = 0.5) -> DataFrame:
    """First time at which the curve is at most 1 - q, per group; null if it stays above."""
    km = kaplan_meier(df, time=time, status=status, keys=keys)
    return km.groupBy(*keys).agg(F.min(F.when(F.col("surv") <= 1 - q + 1e-12, F.col("time"))).alias("quantile"))


def quantile_limits(df: DataFrame, *, time: str, status: str, keys: Sequence[str] = (), q: float = 0.5, level: float = 0.95) -> DataFrame:
    """Quantile with limits: first event times at which the plain lower and upper limits of the curve reach 1 - q."""
    km = kaplan_meier(df, time=time, status=status, keys=keys, kind="plain", level=level).where("n_event > 0")
    first = lambda c, n: F.min(F.when(F.col(c) <= 1 - q + 1e-12, F.col("time"))).alias(n)
    return km.groupBy(*keys).agg(first("surv", "quantile"), first("lower", "lower"), first("upper", "upper"))


def at_times(df: DataFrame, *, time: str, status: str, times: Sequence[float], keys: Sequence[str] = (), level: float = 0.95, kind: str = "plain") -> DataFrame:
    """The curve at requested times (the last event time at or before each): before the first event it is 1 and everyone is at risk."""
    km = kaplan_meier(df, time=time, status=status, keys=keys, level=level, kind=kind)
    per = [F.struct(F.lit(float(t)).alias("at"), F.max(F.when((F.col("time") <= t) & (F.col("n_event") > 0), F.struct("time", "surv", "std_err", "lower", "upper"))).alias("s"), F.max(F.when(F.col("time") > t, F.col("n_risk"))).alias("n")) for t in times]
    rows = km.groupBy(*keys).agg(*(p.alias(f"_{i}") for i, p in enumerate(per)))
    rows = rows.select(*keys, F.explode(F.array(*(F.col(f"_{i}") for i in range(len(per))))).alias("x"))
    known = lambda c, otherwise: F.coalesce(F.col(f"x.s.{c}"), F.lit(otherwise)).alias(c)
    return rows.select(*keys, F.col("x.at").alias("time"), F.coalesce("x.n", F.lit(0.0)).alias("n_after"), known("surv", 1.0), known("std_err", 0.0), known("lower", 1.0), known("upper", 1.0))


def step_values(steps: DataFrame, requests: DataFrame, *, step: str, value: str, at: str, initial: float, keys: Sequence[str] = ()) -> DataFrame:
    """requests with the right-continuous step function's value at each request; ``initial`` before the first step."""
    return as_of(requests, steps, at=at, step=step, values=[value], keys=keys).withColumn(value, F.coalesce(value, F.lit(initial)))


def restricted_mean(df: DataFrame, *, time: str, status: str, tau: float, keys: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """Area under the curve from 0 to tau with its variance, error and limits, per group.

    The variance adds up d A^2 / (n (n - d)) over event times, A being the area from there to tau.
    """
    km = kaplan_meier(df, time=time, status=status, keys=keys)
    events = km.where((F.col("n_event") > 0) & (F.col("time") <= tau)).select(*keys, "time", "surv", "n_event", "n_risk")
    known = running(events, order="time", keys=keys, products={"_before": 1 - F.col("n_event") / F.col("n_risk")}, strict=True, keep_bin=True)
    fall = F.col("_before") - F.col("surv")
    # area under the curve from t to tau: S(t) (tau - t) less what each later fall takes away
    later = running(known, order="time", keys=keys, sums={"_lost": fall * (tau - F.col("time"))}, reverse=True, strict=True)
    area = F.col("surv") * (tau - F.col("time")) - F.col("_lost")
    term = F.when(F.col("n_risk") > F.col("n_event"), F.col("n_event") * area * area / (F.col("n_risk") * (F.col("n_risk") - F.col("n_event")))).otherwise(F.lit(0.0))
    sums = later.groupBy(*keys).agg(F.sum(fall * (tau - F.col("time"))).alias("_all"), F.sum(term).alias("_v"))
    everyone = km.groupBy(*keys).agg(F.count("*").alias("_n"))
    out = join_keys(everyone, sums, keys, "left") if keys else everyone.crossJoin(F.broadcast(sums))  # one row each
    z = z_of(level)
    rmst, variance = F.lit(float(tau)) - F.coalesce("_all", F.lit(0.0)), F.coalesce("_v", F.lit(0.0))
    return out.select(*keys, rmst.alias("rmst"), variance.alias("variance"), F.sqrt(variance).alias("std_err"), (rmst - z * F.sqrt(variance)).alias("lower"), (rmst + z * F.sqrt(variance)).alias("upper"))


def restricted_mean_difference(df: DataFrame, *, time: str, status: str, group: str, tau: float, level: float = 0.95) -> DataFrame:
    """One row for two groups: difference (larger group value less smaller) and ratio of restricted means, with errors, limits and p."""
    per = restricted_mean(df.where(F.col(group).isNotNull()), time=time, status=status, tau=tau, keys=[group])
    both = per.agg(F.count("*").alias("_k"), F.min_by("rmst", group).alias("low"), F.max_by("rmst", group).alias("high"), F.min_by("variance", group).alias("_v0"), F.max_by("variance", group).alias("_v1"))
    both = both.where(_exactly_two(group))
    z, se, ratio_se = z_of(level), F.sqrt(F.col("_v0") + F.col("_v1")), F.sqrt(F.col("_v0") / (F.col("low") * F.col("low")) + F.col("_v1") / (F.col("high") * F.col("high")))
    diff, ratio = F.col("high") - F.col("low"), F.col("high") / F.col("low")
    return both.select("low", "high", diff.alias("difference"), se.alias("std_err"), (diff - z * se).alias("lower"), (diff + z * se).alias("upper"), (2 * norm_cdf(-F.abs(diff / se))).alias("p"), ratio.alias("ratio"), (ratio * F.exp(-z * ratio_se)).alias("ratio_lower"), (ratio * F.exp(z * ratio_se)).alias("ratio_upper"))


def _exactly_two(group: str) -> Column:
    """A condition that fails the query unless there are two groups (or none)."""
    return F.when(F.col("_k").isin(0, 2), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{group} must have two values, not "), F.col("_k").cast("string"))).cast("boolean"))


def life_table(df: DataFrame, *, time: str, status: str, width: float | None = None, breaks: Sequence[float] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Actuarial table by intervals of equal width or by ascending ``breaks`` (the last interval is closed): half of those censored count as exposed.

    Intervals without rows carry the curve on; times outside of the breaks drop out.
    """
    rows = df.where(F.col(time).isNotNull() & F.col(status).isNotNull())
    if breaks is not None:
        b = [float(x) for x in breaks]
        place = F.coalesce(*(F.when((F.col(time) >= x) & ((F.col(time) < y) if i < len(b) - 2 else (F.col(time) <= y)), F.lit(x)) for i, (x, y) in enumerate(zip(b, b[1:], strict=False))))
        rows = rows.withColumn("_start", place).where("_start is not null")
        starts = F.array(*(F.lit(x) for x in b[:-1]))
    else:
        rows = rows.withColumn("_start", (F.floor(F.col(time) / width) * width).cast("double"))
        starts = F.transform(F.sequence(F.round(F.col("_first") / width).cast("long"), F.round(F.col("_last") / width).cast("long")), lambda i: i * float(width))
    counts = rows.groupBy(*keys, F.col("_start").alias("start")).agg(F.sum((F.col(status) != 0).cast("double")).alias("n_event"), F.sum((F.col(status) == 0).cast("double")).alias("n_censor"))
    spans = counts.groupBy(*keys).agg(F.min("start").alias("_first"), F.max("start").alias("_last")).select(*keys, F.explode(starts).alias("start"))
    at = join_keys(spans, counts, [*keys, "start"], "left").fillna(0.0, ["n_event", "n_censor"])
    known = running(at, order="start", keys=keys, sums={"n_enter": F.col("n_event") + F.col("n_censor")}, reverse=True, keep_bin=True)
    known = known.withColumn("n_exposed", F.col("n_enter") - F.col("n_censor") / 2).withColumn("hazard", F.when(F.col("n_exposed") > 0, F.col("n_event") / F.col("n_exposed")).otherwise(F.lit(0.0)))
    left = F.col("n_exposed") - F.col("n_event")
    out = running(known, order="start", keys=keys, products={"surv": 1 - F.col("hazard")}, sums={"_g": F.when(left > 0, F.col("n_event") / (F.col("n_exposed") * left)).otherwise(F.lit(0.0))})
    return out.withColumn("std_err", F.col("surv") * F.sqrt("_g")).drop("_g")


def cumulative_incidence(df: DataFrame, *, time: str, cause: str, keys: Sequence[str] = (), level: float = 0.95, with_variance: bool = True) -> DataFrame:
    """Aalen–Johansen incidence of each cause (0: censored): one row per group, time of that cause, and cause.

    ``variance`` is the delta-method variance; limits are plain, clamped to [0, 1].  Without it only the causes' own times are visited.
    """
    rows = df.where(F.col(time).isNotNull() & F.col(cause).isNotNull()).withColumn("_any", (F.col(cause) != 0).cast("int"))
    base = cells(rows, time=time, status="_any", keys=keys, keep_bin=True)
    before = running(base, order="time", keys=keys, products={"before": 1 - _ratio("n_event", "n_risk")}, strict=True).select(*keys, "time", "n_risk", "before", F.col("n_event").alias("n_all"))
    by_cause = rows.where(F.col(cause) != 0).groupBy(*keys, F.col(time).cast("double").alias("time"), F.col(cause).alias("cause")).agg(F.count("*").cast("double").alias("n_event"))
    if not with_variance:
        own = join_keys(by_cause, before, [*keys, "time"]).withColumn("_step", F.col("before") * F.col("n_event") / F.col("n_risk"))
        return running(own, order="time", keys=[*keys, "cause"], sums={"incidence": F.col("_step")}).select(*keys, "time", "cause", "n_event", "n_risk", "incidence")
    # every cause has a row at every event time, so that its variance can run over all of them
    causes = by_cause.select("cause").distinct()
    times = before.where("n_all > 0")
    grid = times.crossJoin(F.broadcast(causes))  # one row per cause of failure
    at = join_keys(grid, by_cause, [*keys, "time", "cause"], "left").withColumn("n_event", F.coalesce("n_event", F.lit(0.0)))
    step = F.col("before") * F.col("n_event") / F.col("n_risk")
    every = [*keys, "cause"]
    known = running(at, order="time", keys=every, sums={"incidence": step}, keep_bin=True)
    # Var F(t) = sum over s <= t of (F(t) - F(s))^2 a + S(s-)^2 b - 2 (F(t) - F(s)) S(s-) c, opened up into running sums
    n, d, k, s, f = (F.col(c) for c in ("n_risk", "n_all", "n_event", "before", "incidence"))
    a = F.when(n > d, d / (n * (n - d))).otherwise(F.lit(0.0))
    b = s * s * k * (n - k) / (n * n * n)
    c = s * k / (n * n)
    parts = running(known, order="time", keys=every, sums={"_a": a, "_af": a * f, "_aff": a * f * f, "_b": b, "_c": c, "_cf": c * f})
    t = F.col("incidence")
    variance = F.greatest(F.lit(0.0), t * t * F.col("_a") - 2 * t * F.col("_af") + F.col("_aff") + F.col("_b") - 2 * t * F.col("_c") + 2 * F.col("_cf"))
    z = z_of(level)
    out = parts.where("n_event > 0").withColumn("variance", variance)
    half = z * F.sqrt("variance")
    return out.select(*keys, "time", "cause", "n_event", "n_risk", "incidence", "variance", F.greatest(F.lit(0.0), t - half).alias("lower"), F.least(F.lit(1.0), t + half).alias("upper"))


def landmark(df: DataFrame, *, time: str, at: float) -> DataFrame:
    """Rows still under observation after the landmark, with the clock set to zero there."""
    return df.where(F.col(time) > at).withColumn(time, F.col(time) - at)


def landmarks(df: DataFrame, *, time: str, at: Sequence[float]) -> DataFrame:
    """``landmark`` for several landmarks in one pass: rows are repeated, with the column ``landmark``."""
    marks = F.filter(F.array(*(F.lit(float(x)) for x in sorted(set(at)))), lambda x: x < F.col(time))
    return df.withColumn("landmark", F.explode(marks)).withColumn(time, F.col(time) - F.col("landmark"))


def conditional_curve(df: DataFrame, *, time: str, status: str, given: float, target: float, keys: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """The curve at ``target`` of those who reached ``given``, per group, with plain limits; null where nobody did."""
    if target < given:
        raise ValueError("target is before given")
    km = kaplan_meier(df, time=time, status=status, keys=keys)
    last = lambda t: F.max(F.when(F.col("time") <= t, F.struct("time", "surv", "std_err")))
    both = km.groupBy(*keys).agg(last(given).alias("g"), last(target).alias("t"))
    at = lambda x: F.coalesce(F.col(f"{x}.surv"), F.lit(1.0))
    greenwood = lambda x: F.coalesce(F.pow(F.try_divide(F.col(f"{x}.std_err"), F.col(f"{x}.surv")), 2), F.lit(0.0))
    cond = F.try_divide(at("t"), at("g"))
    out = both.select(*keys, cond.alias("surv"), (cond * F.sqrt(F.abs(greenwood("t") - greenwood("g")))).alias("std_err"))
    z = z_of(level)
    return out.withColumns({"lower": F.greatest(F.lit(0.0), F.col("surv") - z * F.col("std_err")), "upper": F.least(F.lit(1.0), F.col("surv") + z * F.col("std_err"))})


def curve_from_hazard(at: DataFrame, *, time: str, hazard: str, keys: Sequence[str] = ()) -> DataFrame:
    """Cumulative hazard and exp(-cumulative hazard) from increments, one row per (keys, time)."""
    return running(at, order=time, keys=keys, sums={"cum_hazard": F.col(hazard)}).withColumn("surv", F.exp(-F.col("cum_hazard")))


def curve_from_cum_hazard(at: DataFrame, *, cum_hazard: str) -> DataFrame:
    """exp(-cumulative hazard)."""
    return at.withColumn("surv", F.exp(-F.col(cum_hazard)))


def average_curve(curves: DataFrame, *, curve: str, time: str, surv: str, std_err: str | None = None, weight: str | None = None, keys: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """Weighted mean of step curves on the union of their times, per group; a curve before its first time is 1.

    With ``std_err`` the mean's error takes the curves as independent.  ``curve`` names a curve inside its
    group; ``weight`` is constant on a curve.  No grid of curves and times is made: each curve
    contributes its changes, which add up over time.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    e = F.col(std_err) if std_err else F.lit(0.0)
    order = Window.partitionBy(*keys, curve).orderBy(time)
    change = lambda x, first: x - F.coalesce(F.lag(x).over(order), F.lit(first))
    steps = curves.withColumns({"_w": w, "_ds": w * change(F.col(surv), 1.0), "_dv": w * w * change(e * e, 0.0), "_new": F.when(F.row_number().over(order) == 1, w).otherwise(F.lit(0.0))})
    total = steps.groupBy(*keys).agg(F.sum("_new").alias("_total"))
    at = steps.groupBy(*keys, F.col(time).cast("double").alias("time")).agg(F.sum("_ds").alias("_ds"), F.sum("_dv").alias("_dv"))
    run = running(at, order="time", keys=keys, sums={"_s": F.col("_ds"), "_v": F.col("_dv")})
    out = join_keys(run, total, keys, few=not keys)
    mean, se = 1 + F.col("_s") / F.col("_total"), F.sqrt(F.greatest(F.lit(0.0), F.col("_v"))) / F.col("_total")
    found = out.select(*keys, "time", mean.alias("surv"), *([se.alias("std_err")] if std_err else []))
    if not std_err:
        return found
    z = z_of(level)
    return found.withColumns({"lower": F.greatest(F.lit(0.0), F.col("surv") - z * F.col("std_err")), "upper": F.least(F.lit(1.0), F.col("surv") + z * F.col("std_err"))})


def pseudo_values(df: DataFrame, *, time: str, status: str, times: Sequence[float], kind: str = "surv") -> DataFrame:
    """df with ``at`` and ``pseudo`` for each requested time: estimate + n * influence of the row.

    ``kind`` is surv, cumhaz or rmst.  Rows with null time or status drop out.  The influence of row i on the cumulative
    hazard is its event over the risk set less the hazard it lived through, d / n^2, up to then.
    """
    if kind not in ("surv", "cumhaz", "rmst"):
        raise ValueError("kind is surv, cumhaz or rmst")
    rows = df.where(F.col(time).isNotNull() & F.col(status).isNotNull())
    at = cells(rows, time=time, status=status, keep_bin=True)
    n, d = F.col("n_risk"), F.col("n_event")
    greenwood = F.when(n > d, d / (n * (n - d))).otherwise(F.lit(0.0)) if kind != "cumhaz" else d / (n * n)
    own = 1 / (n - d) if kind != "cumhaz" else 1 / n
    run = running(at, order="time", products={"_s": 1 - d / n}, sums={"_h": d / n, "_q": greenwood}, keep_bin=True)
    run = run.withColumn("_own", F.when((n > d) | F.lit(kind == "cumhaz"), own).otherwise(F.lit(0.0)))
    total = rows.agg(F.count("*").alias("_n"))
    horizon = F.array(*(F.lit(float(t)) for t in times))
    if kind == "rmst":
        return _rmst_pseudo(rows, run, total, horizon, time, status)
    wanted = rows.withColumn("at", F.explode(horizon)).withColumn("_u", F.least(F.col(time).cast("double"), F.col("at")))
    looked = as_of(wanted, run, at="_u", step="time", values=["_q", "_own"])
    curve = as_of(looked.withColumnsRenamed({"_q": "_lived", "_own": "_mine"}), run, at="at", step="time", values=["_s", "_h"])
    had = (F.col(status) != 0) & (F.col(time) <= F.col("at"))
    lived, mine = F.coalesce("_lived", F.lit(0.0)), F.when(had, F.coalesce("_mine", F.lit(0.0))).otherwise(F.lit(0.0))
    out = curve.crossJoin(F.broadcast(total))  # one row
    if kind == "cumhaz":
        value = F.coalesce("_h", F.lit(0.0)) + F.col("_n") * (mine - lived)
    else:
        # with the hazard lived through, which includes the own time, an event counts 1/(n-d) - d/(n(n-d)) = 1/n
        value = F.coalesce("_s", F.lit(1.0)) * (1 - F.col("_n") * (mine - lived))
    return out.withColumn("pseudo", value).drop("_u", "_lived", "_mine", "_s", "_h", "_n")


def _rmst_pseudo(rows: DataFrame, run: DataFrame, total: DataFrame, horizon: Column, time: str, status: str) -> DataFrame:
    """Pseudo-values of the restricted mean: the integral of those of the curve, by running sums over its falls."""
    n, d = F.col("n_risk"), F.col("n_event")
    steps = running(run, order="time", products={"_b": 1 - d / n}, strict=True, keep_bin=True)
    gain = F.when(n > d, d / (n * (n - d))).otherwise(F.lit(0.0))
    fall, jump = F.col("_b") - F.col("_s"), F.col("_s") * F.col("_q") - F.col("_b") * (F.col("_q") - gain)
    steps = running(steps, order="time", sums={"_f": fall, "_ft": fall * F.col("time"), "_g": jump, "_gt": jump * F.col("time")})
    cols = ["_f", "_ft", "_g", "_gt", "_q", "_own"]
    wanted = rows.withColumn("at", F.explode(horizon)).withColumn("_u", F.least(F.col(time).cast("double"), F.col("at")))
    here = as_of(wanted, steps, at="_u", step="time", values=cols).withColumnsRenamed({c: f"_u{c}" for c in cols})
    both = as_of(here, steps, at="at", step="time", values=["_f", "_ft"]).crossJoin(F.broadcast(total))  # one row
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    whole = F.col("at") - (F.col("at") * z("_f") - z("_ft"))
    until = F.col("_u") - (F.col("_u") * z("_u_f") - z("_u_ft"))
    lived = F.col("_u") * z("_u_g") - z("_u_gt") + z("_u_q") * (whole - until)
    event = F.when((F.col(status) != 0) & (F.col(time) <= F.col("at")), z("_u_own")).otherwise(F.lit(0.0))
    value = whole - F.col("_n") * (event * (whole - until) - lived)
    return both.withColumn("pseudo", value).drop("_u", "_f", "_ft", "_n", *(f"_u{c}" for c in cols))

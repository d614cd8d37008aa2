"""Predictions against outcomes: Brier scores, calibration, discrimination, decision curves, groups, selection of models, drift.

Rows with a null in a column that is used drop out, on both sides of every ratio.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from censorium.functions.lineage import cut
from censorium.functions.prefix import as_of, join_keys, running
from censorium.functions.riskset import cells
from censorium.functions.special import chi2_p, norm_cdf, z_of

#: Floor of the censoring curve in inverse weights (fixed value).
FLOOR = 0.01


def _known(df: DataFrame, *columns: str | None) -> DataFrame:
    return df.dropna(subset=[c for c in dict.fromkeys(columns) if c])


def _weight(weight: str | None) -> Column:
    return F.col(weight).cast("double") if weight else F.lit(1.0)


def censor_curve(df: DataFrame, *, time: str, status: str, keys: Sequence[str] = (), weight: str | None = None, events_first: bool = True) -> DataFrame:
    """``(keys, time, censor_surv)``: Kaplan–Meier of the censoring; ``events_first``: those with an event at t are no longer at risk of being censored there."""
    at = cells(df, time=time, status=status, keys=keys, weight=weight, keep_bin=True)
    left = F.col("n_risk") - F.col("n_event") if events_first else F.col("n_risk")
    g = running(at, order="time", keys=keys, products={"censor_surv": F.when(left > 0, 1 - F.col("n_censor") / left).otherwise(F.lit(1.0))})
    # a row per distinct time, read by several joins: written once, so that plans stay small
    return cut(g.select(*keys, "time", "censor_surv"), "censoring")


def brier_score(df: DataFrame, *, prediction: str, outcome: str, weight: str | None = None) -> DataFrame:
    """Weighted mean squared difference of prediction and 0/1 outcome."""
    w = _weight(weight)
    gap = F.col(prediction) - F.col(outcome)
    return _known(df, prediction, outcome, weight).agg(F.try_divide(F.sum(w * gap * gap), F.sum(w)).alias("brier"))


def integrated_brier(scores: DataFrame, *, time: str, score: str) -> DataFrame:
    """One row: mean of scores over times weighted by half the span of their neighbours (ends: the span to their one neighbour; a single time: 1).

    ``scores`` holds one row a requested time, so the window sees only those.
    """
    w = Window.orderBy(time)
    before, after = F.col(time) - F.lag(time).over(w), F.lead(time).over(w) - F.col(time)
    width = F.when(before.isNull() & after.isNull(), F.lit(1.0)).when(before.isNull(), after).when(after.isNull(), before).otherwise((before + after) / 2)
    return _known(scores, time, score).withColumn("_w", width).agg(F.try_divide(F.sum(F.col("_w") * F.col(score)), F.sum("_w")).alias("integrated_brier"))


def censored_brier(df: DataFrame, *, time: str, status: str, predictions: str, times: Sequence[float], weight: str | None = None) -> DataFrame:
    """``(at, n, brier)`` per requested time: inverse-censoring-weighted Brier score of the predicted curve ``predictions[i]`` at ``times[i]``.

    Rows censored before the time are passed over; events weigh 1 / G(T-), the rest 1 / G(at); normalised by the sum of weights.
    """
    rows = _known(df, time, status, predictions, weight)
    g = censor_curve(rows, time=time, status=status, weight=weight)
    t = F.col(time).cast("double")
    long = rows.select(t.alias("_t"), (F.col(status) != 0).alias("_d"), _weight(weight).alias("_w"), F.posexplode(predictions).alias("_i", "_p")).where(F.col("_i") < len(times))
    long = long.withColumn("at", F.array(*(F.lit(float(x)) for x in times))[F.col("_i")]).where("_d or _t >= at").where("_p is not null")
    gone = F.col("_d") & (F.col("_t") <= F.col("at"))
    # an event looks just before its own time, the rest at the requested time
    early = as_of(long.where(gone), g, at="_t", step="time", values=["censor_surv"], strict=True)
    late = as_of(long.where(~gone), g, at="at", step="time", values=["censor_surv"])
    both = early.withColumn("_y", F.lit(0.0)).unionByName(late.withColumn("_y", F.lit(1.0))).withColumn("_v", F.col("_w") / F.coalesce("censor_surv", F.lit(1.0)))
    gap = F.col("_p") - F.col("_y")
    return both.groupBy("at").agg(F.count("*").alias("n"), F.try_divide(F.sum(F.col("_v") * gap * gap), F.sum("_v")).alias("brier"))


def calibration(df: DataFrame, *, prediction: str, outcome: str, bins: int = 10) -> DataFrame:
    """Rows, mean prediction and mean outcome by bins of equal width in [0, 1]."""
    rows = _known(df, prediction, outcome)
    b = F.least(F.lit(bins - 1), F.floor(F.col(prediction) * bins)).cast("int")
    return rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(prediction).alias("mean_prediction"), F.avg(F.col(outcome).cast("double")).alias("mean_outcome"))


def _positions(rows: DataFrame, order: str, name: str = "_n") -> DataFrame:
    """Distinct values of ``order`` with their count, the rows before them (``_before``) and the total (``_total``)."""
    counts = rows.groupBy(order).agg(F.count("*").alias(name))
    total = rows.agg(F.count("*").alias("_total"))
    return running(counts, order=order, sums={"_before": F.col(name)}, strict=True).crossJoin(F.broadcast(total))  # one row


def calibration_groups(df: DataFrame, *, prediction: str, outcome: str, groups: int = 10) -> DataFrame:
    """``(group, n, predicted, observed, low, high)`` by groups of equal count in the order of the prediction, the first ones one larger if it doesn't divide.

    Rows of equal prediction are alike: where a group ends inside them, each side takes its share of their outcomes.
    """
    rows = _known(df, prediction, outcome).select(F.col(prediction).cast("double").alias("p"), F.col(outcome).cast("double").alias("y"))
    sums = rows.groupBy("p").agg(F.count("*").alias("_n"), F.sum("y").alias("_y"))
    total = rows.agg(F.count("*").alias("_total"))
    at = running(sums, order="p", sums={"_before": F.col("_n")}, strict=True).crossJoin(F.broadcast(total))  # one row
    size, extra = F.floor(F.col("_total") / groups), F.col("_total") % groups
    edge = lambda g: g * size + F.least(g, extra)
    first = F.expr(f"filter(sequence(0, {groups - 1}), g -> (g + 1) * floor(_total / {groups}) + least(g + 1, _total % {groups}) > _before and g * floor(_total / {groups}) + least(g, _total % {groups}) < _before + _n)")
    parts = at.withColumn("group", F.explode(first))
    share = F.least(edge(F.col("group") + 1), F.col("_before") + F.col("_n")) - F.greatest(edge(F.col("group")), F.col("_before"))
    parts = parts.withColumn("_s", share)
    out = parts.groupBy("group").agg(F.sum("_s").cast("long").alias("n"), F.sum(F.col("p") * F.col("_s")).alias("_p"), F.sum(F.col("_y") * F.col("_s") / F.col("_n")).alias("_y"), F.min("p").alias("low"), F.max("p").alias("high"))
    return out.select("group", "n", (F.col("_p") / F.col("n")).alias("predicted"), (F.col("_y") / F.col("n")).alias("observed"), "low", "high")


def calibration_line(groups: DataFrame) -> DataFrame:
    """One row from ``calibration_groups``: least-squares slope and intercept of observed on predicted, Hosmer–Lemeshow statistic, df and p."""
    term = F.when((F.col("predicted") > 0) & (F.col("predicted") < 1), F.pow(F.col("n") * (F.col("observed") - F.col("predicted")), 2) / (F.col("n") * F.col("predicted") * (1 - F.col("predicted")))).otherwise(F.lit(0.0))
    out = groups.agg(F.coalesce(F.regr_slope("observed", "predicted"), F.lit(1.0)).alias("slope"), F.avg("observed").alias("_o"), F.avg("predicted").alias("_p"), F.sum(term).alias("chi_square"), F.greatest(F.lit(1), F.count("*") - 2).cast("int").alias("df"))
    return out.select("slope", (F.col("_o") - F.col("slope") * F.col("_p")).alias("intercept"), "chi_square", "df").withColumn("p", chi2_p(F.col("chi_square"), F.col("df")))


def calibration_summary(df: DataFrame, *, prediction: str, outcome: str) -> DataFrame:
    """One row: calibration in the large (mean outcome less mean prediction), slope and intercept over rows, Spiegelhalter's z and p."""
    rows = _known(df, prediction, outcome)
    p, y = F.col(prediction).cast("double"), F.col(outcome).cast("double")
    top, bottom = F.sum((y - p) * (1 - 2 * p)), F.sum((1 - 2 * p) * (1 - 2 * p) * p * (1 - p))
    out = rows.agg(F.count("*").alias("n"), (F.avg(y) - F.avg(p)).alias("in_the_large"), F.regr_slope(y, p).alias("slope"), F.regr_intercept(y, p).alias("intercept"), F.try_divide(top, F.sqrt(bottom)).alias("spiegelhalter_z"))
    return out.withColumn("p", 2 * norm_cdf(-F.abs("spiegelhalter_z")))


def risk_groups(df: DataFrame, *, risk: str, event: str, groups: int = 3) -> DataFrame:
    """``(group, n, event_rate, median_risk)``: cut points are the scores at places g n / groups; a score at a cut point goes up."""
    rows = _known(df, risk, event).withColumn("_r", F.col(risk).cast("double"))
    at = _positions(rows, "_r")
    place = lambda g: F.floor(F.lit(g) * F.col("_total") / groups)
    cuts = at.agg(*(F.min(F.when(F.col("_before") + F.col("_n") > place(g), F.col("_r"))).alias(f"_c{g}") for g in range(1, groups)))
    code = sum((F.when(F.col("_r") >= F.col(f"_c{g}"), 1).otherwise(0) for g in range(1, groups)), F.lit(0))
    graded = rows.crossJoin(F.broadcast(cuts)).withColumn("group", code)  # one row of cut points
    per = graded.groupBy("group", "_r").agg(F.count("*").alias("_n"), F.sum((F.col(event) != 0).cast("double")).alias("_e"))
    run = running(per, order="_r", keys=["group"], sums={"_until": F.col("_n")})
    totals = per.groupBy("group").agg(F.sum("_n").alias("n"), F.sum("_e").alias("_events"))
    both = join_keys(run, totals, ["group"])
    middle = F.min(F.when(F.col("_until") > F.floor(F.col("n") / 2), F.col("_r")))
    return both.groupBy("group").agg(F.max("n").alias("n"), (F.max("_events") / F.max("n")).alias("event_rate"), middle.alias("median_risk"))


def one_calibration(df: DataFrame, *, time: str, status: str, prediction: str, at: float, groups: int = 10) -> DataFrame:
    """One row: chi-square of events by ``at`` against predictions in groups of equal count (``calibration_groups``), df, p."""
    rows = _known(df, time, status, prediction).withColumn("_y", ((F.col(status) != 0) & (F.col(time) <= at)).cast("int"))
    per = calibration_groups(rows.withColumn("_p", 1 - F.col(prediction)), prediction="_p", outcome="_y", groups=groups)
    term = F.pow(F.col("n") * (F.col("observed") - F.col("predicted")), 2) / (F.col("n") * F.col("predicted") * (1 - F.col("predicted")))
    out = per.agg(F.sum(F.when((F.col("predicted") > 0) & (F.col("predicted") < 1), term).otherwise(F.lit(0.0))).alias("chi_square"), (F.count("*") - 1).cast("int").alias("df"))
    return out.withColumn("p", chi2_p(F.col("chi_square"), F.col("df")))


def distribution_calibration(df: DataFrame, *, prediction: str, status: str, bins: int = 10) -> DataFrame:
    """One row: chi-square of events' predicted curve values over bins of equal width in [0, 1], df and p (1 below 2 events a bin)."""
    rows = _known(df, prediction, status).where(F.col(status) != 0)
    counts = rows.groupBy(F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col(prediction) * bins))).alias("bin")).agg(F.count("*").cast("double").alias("c"))
    sums = counts.agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("cc"))
    # sum over all bins of (c - n/b)^2 / (n/b) = b sum c^2 / n - n
    enough = F.col("n") >= 2 * bins
    out = sums.select(F.coalesce("n", F.lit(0.0)).cast("long").alias("n"), F.when(enough, bins * F.col("cc") / F.col("n") - F.col("n")).otherwise(F.lit(0.0)).alias("chi_square"), F.lit(bins - 1).alias("df"))
    return out.withColumn("p", F.when(F.col("n") >= 2 * bins, chi2_p(F.col("chi_square"), F.col("df"))).otherwise(F.lit(1.0)))


def population_stability(reference: DataFrame, current: DataFrame, *, column: str, low: float, high: float, bins: int = 10, floor: float = 1e-4) -> DataFrame:
    """Population stability index over bins of equal width; empty shares count as ``floor``; nulls take no part."""
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(column) - low) / (high - low) * bins))).cast("int").alias("bin")
    side = lambda df, r: _known(df, column).select(b, F.lit(r).alias("r"), F.lit(1 - r).alias("c"))
    counts = side(reference, 1).union(side(current, 0)).groupBy("bin").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    totals = counts.agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"))
    shares = counts.crossJoin(F.broadcast(totals)).select(F.greatest(F.col("r") / F.col("nr"), F.lit(floor)).alias("p"), F.greatest(F.col("c") / F.col("nc"), F.lit(floor)).alias("q"))  # one row of totals
    return shares.agg(F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p"))).alias("psi"))


def pooled_stability(reference: DataFrame, current: DataFrame, *, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """``(feature, psi, severity)``: bins of equal width over the range of both, 0.001 added to every count; severity by 0.1, 0.2, 0.3 (fixed values)."""
    stack = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns)))
    side = lambda df, r: df.select(stack.alias("x")).select("x.*").where("v is not null").select("feature", "v", F.lit(r).alias("r"))
    both = side(reference, 1).union(side(current, 0))
    ranges = both.groupBy("feature").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    placed = both.join(F.broadcast(ranges), "feature").withColumn("bin", F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / width)).cast("int")).otherwise(F.lit(0)))  # a row per feature
    counts = placed.groupBy("feature", "bin").agg(F.sum("r").alias("r"), F.sum(1 - F.col("r")).alias("c"))
    totals = counts.groupBy("feature").agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"))
    grid = totals.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    every = join_keys(grid, counts, ["feature", "bin"], "left").fillna(0, ["r", "c"])
    p, q = (F.col("r") + 0.001) / (F.col("nr") + 0.001 * bins), (F.col("c") + 0.001) / (F.col("nc") + 0.001 * bins)
    out = every.groupBy("feature").agg(F.sum((q - p) * F.log(q / p)).alias("psi")).join(ranges, "feature")
    value = F.when(F.col("hi") - F.col("lo") < 1e-10, F.lit(0.0)).otherwise(F.col("psi"))
    out = out.select("feature", value.alias("psi"))
    return out.withColumn("severity", F.when(F.col("psi") < 0.1, "none").when(F.col("psi") < 0.2, "low").when(F.col("psi") < 0.3, "moderate").otherwise("high"))


def kolmogorov_smirnov(reference: DataFrame, current: DataFrame, *, column: str, with_p: bool = False) -> DataFrame:
    """Largest gap of the two distribution functions, over ranges of distinct values; ``with_p``: and 2 exp(-2 lambda^2)."""
    side = lambda df, r: df.where(F.col(column).isNotNull()).select(F.col(column).alias("v"), F.lit(r).alias("r"), F.lit(1 - r).alias("c"))
    at = side(reference, 1).union(side(current, 0)).groupBy("v").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    run = running(at, order="v", sums={"r": F.col("r"), "c": F.col("c")}).select("r", "c")
    totals = at.agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"))
    gaps = run.crossJoin(F.broadcast(totals))  # one row of totals
    out = gaps.agg(F.max(F.abs(F.try_divide("r", "nr") - F.try_divide("c", "nc"))).alias("ks"), F.max("nr").alias("_a"), F.max("nc").alias("_b"))
    en = F.sqrt(F.col("_a") * F.col("_b") / (F.col("_a") + F.col("_b")))
    lam = (en + 0.12 + 0.11 / en) * F.col("ks")
    return out.select("ks", *([F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * F.exp(-2 * lam * lam))).alias("p")] if with_p else []))


TIME_WEIGHTS = ("n", "S", "S/G", "n/G2", "I")


def _time_weights(rows: DataFrame, kind: str, keys: Sequence[str], weight: str | None, floor: float) -> DataFrame:
    """``(keys, time, _tw)``: weight of pairs by the time of their event (curves just before it)."""
    at = cells(rows, time="time", status="d", keys=keys, weight=weight, keep_bin=True)
    left = F.col("n_risk") - F.col("n_event")
    both = running(at, order="time", keys=keys, products={"_S": 1 - F.col("n_event") / F.col("n_risk"), "_G": F.when(left > 0, 1 - F.col("n_censor") / left).otherwise(F.lit(1.0))}, strict=True)
    total = rows.groupBy(*keys).agg(F.sum(_weight(weight)).alias("_W"))
    both = join_keys(both, total, keys, few=not keys)
    s, g, r, w = (F.col(c) for c in ("_S", "_G", "n_risk", "_W"))
    g = F.greatest(g, F.lit(floor)) if floor else g
    tw = {"n": F.lit(1.0), "S": w * s / r, "S/G": w * s / (g * r), "n/G2": 1 / (g * g), "I": 1 / r}[kind]
    return cut(both.select(*keys, "time", tw.alias("_tw")), "time-weights")


def concordance(
    df: DataFrame, *, time: str, status: str, risk: str, weight: str | None = None, keys: Sequence[str] = (), time_weight: str = "n", tau: float | None = None, against: str = "all", later_only: bool = False, event_weight: str | None = None, pooled: bool = True
) -> DataFrame:
    """Harrell's C: concordant, discordant and risk-tied pairs, pairs of events tied in time (``tied_time``, ``tied_both``), and the index; exact.

    A pair counts if one has an event and the other is later, or censored at the same time (not if ``later_only``).
    With ``keys`` pairs are made inside strata and added up (``pooled``) or given one row a stratum.  ``weight`` multiplies
    over the pair, ``time_weight`` is one of TIME_WEIGHTS, ``event_weight`` a column that weighs a pair by its event's row, ``tau`` leaves
    out later events, ``against`` compares with ``all``, only ``events`` or only ``censored`` rows.

    No pair is made: two different ranks agree down to one binary digit and differ in it, so
    for each digit rows are added up by (higher digits, time), and a running sum over
    later times counts the pairs that part at that digit.  Rows with a null drop out.
    """
    if time_weight not in TIME_WEIGHTS or against not in ("all", "events", "censored"):
        raise ValueError(f"time_weight is one of {TIME_WEIGHTS}, against is all, events or censored")
    plain = weight is None and time_weight == "n" and event_weight is None
    known = _known(df, time, status, risk, weight, event_weight)
    base = known.select(*keys, F.col(time).cast("double").alias("time"), F.col(risk).cast("double").alias("risk"), (F.col(status) != 0).cast("int").alias("d"), _weight(weight).alias("w"), _weight(event_weight).alias("v"))
    rows = base
    if time_weight != "n":
        rows = join_keys(rows, _time_weights(base, time_weight, keys, "w" if weight else None, 0.0), [*keys, "time"])
    tw = F.col("_tw") if time_weight != "n" else F.lit(1.0)
    had = F.col("d") * F.col("w")
    scored = had * F.col("v") * tw * ((F.col("time") <= tau).cast("int") if tau is not None else F.lit(1))
    other = {"all": F.col("w"), "events": had, "censored": F.col("w") - had}[against]
    still = {"all": F.col("w") - had, "events": F.lit(0.0), "censored": F.col("w") - had}[against] if not later_only else F.lit(0.0)
    sums = rows.groupBy(*keys, "time", "risk").agg(F.sum(scored).alias("e"), F.sum(other).alias("n"), F.sum(still).alias("c"), F.sum(had).alias("h"), F.sum(had * had).alias("hs"))
    # cells of time and risk are read several times below
    sums = cut(sums, "cells")
    ranks = running(sums.select("risk").distinct(), order="risk", sums={"rank": F.lit(1.0)}).select("risk", (F.col("rank") - 1).cast("long").alias("rank"))
    top = ranks.agg(F.coalesce(F.length(F.bin(F.max("rank"))), F.lit(1)).alias("_digits"))
    # digit -1: equal ranks
    ranked = sums.join(ranks, "risk").crossJoin(F.broadcast(top))  # one row
    parts = ranked.select(*keys, "time", "e", "n", "c", "rank", F.explode(F.sequence(F.lit(-1), F.col("_digits") - 1)).alias("digit"))
    bit = F.when(F.col("digit") < 0, F.lit(0)).otherwise(F.getbit("rank", F.greatest("digit", F.lit(0))))
    group = [*keys, "digit", "prefix"]
    at = parts.withColumn("bit", bit).groupBy(*keys, "digit", F.expr("shiftright(rank, digit + 1)").alias("prefix"), "time").agg(*(F.sum(F.when(F.col("bit") == b, F.col(c)).otherwise(0.0)).alias(f"{c}{b}") for c in "enc" for b in (0, 1)))
    run = running(at, order="time", keys=group, sums={"l0": F.col("n0"), "l1": F.col("n1")}, reverse=True, strict=True)
    beyond = lambda b: F.col(f"l{b}") + F.col(f"c{b}")
    split = F.col("digit") >= 0
    counted = run.select(*keys, F.when(split, F.col("e1") * beyond(0)).otherwise(0.0).alias("up"), F.when(split, F.col("e0") * beyond(1)).otherwise(0.0).alias("down"), F.when(~split, F.col("e0") * beyond(0)).otherwise(0.0).alias("same"))
    by = [] if pooled else list(keys)
    total = counted.groupBy(*by).agg(F.sum("up").alias("concordant"), F.sum("down").alias("discordant"), F.sum("same").alias("tied_risk"))
    # pairs of events at one time: all, and those of equal risk too
    of_time = sums.groupBy(*keys, "time").agg(F.sum("h").alias("h"), F.sum(F.col("h") * F.col("h")).alias("hh"), F.sum("hs").alias("ss"))
    ties = of_time.groupBy(*by).agg(F.sum((F.col("h") * F.col("h") - F.col("ss")) / 2).alias("_pairs"), F.sum((F.col("hh") - F.col("ss")) / 2).alias("tied_both"))
    out = join_keys(total, ties, by, few=not by)
    kind = "long" if plain else "double"
    cast = lambda c: F.round(F.col(c)).cast(kind) if plain else F.col(c)
    out = out.withColumns({c: cast(c) for c in ("concordant", "discordant", "tied_risk", "tied_both")}).withColumn("tied_time", (F.round(F.col("_pairs")) if plain else F.col("_pairs")).cast(kind) - F.col("tied_both")).drop("_pairs")
    index = F.try_divide(F.col("concordant") + F.col("tied_risk") / 2, F.col("concordant") + F.col("discordant") + F.col("tied_risk"))
    return out.select(*by, "concordant", "discordant", "tied_risk", "tied_time", "tied_both", index.alias("c_index"))


def censored_concordance(df: DataFrame, *, time: str, status: str, risk: str, tau: float | None = None) -> DataFrame:
    """Uno's C: pairs of an event (by ``tau``) and a later row weigh 1 / max(G, FLOOR)^2 at the event's time."""
    rows = _known(df, time, status, risk)
    g = censor_curve(rows, time=time, status=status, events_first=False)
    looked = as_of(rows, g, at=time, step="time", values=["censor_surv"])
    floored = F.greatest(F.coalesce("censor_surv", F.lit(1.0)), F.lit(FLOOR))
    return concordance(looked.withColumn("_uno", 1 / (floored * floored)), time=time, status=status, risk=risk, event_weight="_uno", tau=tau, later_only=True)


def concordance_parts(df: DataFrame, *, time: str, status: str, risk: str, tau: float | None = None) -> DataFrame:
    """``(part, concordant, discordant, tied_risk, c_index)`` for pairs of two events and of an event and a censored row."""
    out = None
    for part in ("events", "censored"):
        one = concordance(df, time=time, status=status, risk=risk, tau=tau, against=part).select(F.lit(part).alias("part"), "concordant", "discordant", "tied_risk", "c_index")
        out = one if out is None else out.union(one)
    return out


def compare_concordance(df: DataFrame, *, time: str, status: str, risk_1: str, risk_2: str, tau: float | None = None) -> DataFrame:
    """One row: Uno's C of two scores on the same rows, and their difference."""
    rows = _known(df, time, status, risk_1, risk_2)
    a = censored_concordance(rows, time=time, status=status, risk=risk_1, tau=tau).select(F.col("c_index").alias("c_1"))
    b = censored_concordance(rows, time=time, status=status, risk=risk_2, tau=tau).select(F.col("c_index").alias("c_2"))
    return a.crossJoin(b).withColumn("difference", F.col("c_1") - F.col("c_2"))  # one row each


def truncated_concordance(df: DataFrame, *, time: str, status: str, risk: str, landmark: float, horizon: float) -> DataFrame:
    """C among rows still there after the landmark, with times cut at the horizon and later events censored."""
    t = F.col(time).cast("double")
    rows = _known(df, time, status, risk).where(t > landmark).withColumns({"_e": F.when(t <= horizon, F.col(status)).otherwise(F.lit(0)), "_t": F.least(t, F.lit(float(horizon)))})
    return concordance(rows, time="_t", status="_e", risk=risk)


def roc(df: DataFrame, *, score: str, label: str) -> DataFrame:
    """``(threshold, true_positive, false_positive, tpr, fpr, youden)`` per distinct score, scores at or above it being positive."""
    rows = _known(df, score, label)
    at = rows.groupBy(F.col(score).cast("double").alias("threshold")).agg(F.sum((F.col(label) != 0).cast("double")).alias("p"), F.sum((F.col(label) == 0).cast("double")).alias("n"))
    totals = at.agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    run = running(at, order="threshold", sums={"true_positive": F.col("p"), "false_positive": F.col("n")}, reverse=True).crossJoin(F.broadcast(totals))  # one row
    tpr, fpr = F.try_divide("true_positive", "_p"), F.try_divide("false_positive", "_n")
    return run.select("threshold", "true_positive", "false_positive", tpr.alias("tpr"), fpr.alias("fpr"), (tpr - fpr).alias("youden"))


def roc_area(df: DataFrame, *, score: str, label: str) -> DataFrame:
    """One row: area under the ROC curve (ties half), and the threshold with the largest Youden index."""
    rows = _known(df, score, label)
    at = rows.groupBy(F.col(score).cast("double").alias("threshold")).agg(F.sum((F.col(label) != 0).cast("double")).alias("p"), F.sum((F.col(label) == 0).cast("double")).alias("n"))
    run = running(at, order="threshold", sums={"below": F.col("n")}, strict=True)
    area = run.agg(F.try_divide(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)), F.sum("p") * F.sum("n")).alias("auc"))
    best = roc(df, score=score, label=label).agg(F.max(F.struct("youden", "threshold")).alias("b"))
    return area.crossJoin(F.broadcast(best)).select("auc", F.col("b.threshold").alias("threshold"), F.col("b.youden").alias("youden"))  # one row


def auc_at(df: DataFrame, *, time: str, status: str, marker: str, times: Sequence[float], censored: bool = True) -> DataFrame:
    """``(at, auc, n_cases, n_controls, std_err)``: cases have their event by the time, controls are still there after it; ties count half.

    ``censored``: cases weigh 1 / max(G(T), FLOOR), G being the censoring curve; else 1.
    """
    rows = _known(df, time, status, marker)
    if censored:
        g = censor_curve(rows, time=time, status=status, events_first=False)
        rows = as_of(rows, g, at=time, step="time", values=["censor_surv"])
    w = 1 / F.greatest(F.coalesce("censor_surv", F.lit(1.0)), F.lit(FLOOR)) if censored else F.lit(1.0)
    t = F.col(time).cast("double")
    long = rows.select(t.alias("_t"), (F.col(status) != 0).alias("_d"), F.col(marker).cast("double").alias("m"), w.alias("_w"), F.explode(F.array(*(F.lit(float(x)) for x in times))).alias("at"))
    case, control = F.col("_d") & (F.col("_t") <= F.col("at")), F.col("_t") > F.col("at")
    per = long.where(case | control).groupBy("at", "m").agg(F.sum(F.when(case, F.col("_w")).otherwise(0.0)).alias("p"), F.sum(F.when(control, 1.0).otherwise(0.0)).alias("n"), F.sum(F.when(case, 1.0).otherwise(0.0)).alias("k"))
    run = running(per, order="m", keys=["at"], sums={"below": F.col("n")}, strict=True)
    out = run.groupBy("at").agg(F.try_divide(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)), F.sum("p") * F.sum("n")).alias("auc"), F.sum("k").cast("long").alias("n_cases"), F.sum("n").cast("long").alias("n_controls"))
    variance = F.col("auc") * (1 - F.col("auc")) / F.sqrt(F.col("n_cases") * F.col("n_controls"))
    return out.withColumn("std_err", F.sqrt(variance))


def integrated_auc(aucs: DataFrame) -> DataFrame:
    """One row from ``auc_at``: mean and trapezoid mean over times (the window sees one row a requested time)."""
    w = Window.orderBy("at")
    rows = aucs.withColumns({"_dt": F.col("at") - F.lag("at").over(w), "_m": (F.col("auc") + F.lag("auc").over(w)) / 2})
    return rows.agg(F.avg("auc").alias("mean_auc"), F.coalesce(F.try_divide(F.sum(F.col("_dt") * F.col("_m")), F.sum("_dt")), F.avg("auc")).alias("integrated_auc"))


def decision_curve(df: DataFrame, *, prediction: str, time: str, status: str, horizon: float, thresholds: Sequence[float] | None = None) -> DataFrame:
    """Per threshold: net benefit of the model, of treating all and none, and interventions avoided; outcome: event by the horizon.

    Predictions are counted once by the thresholds they reach; then each threshold is a running sum over those counts.
    """
    cuts = sorted(thresholds) if thresholds is not None else [i / 100 for i in range(1, 100)]
    y = ((F.col(status) != 0) & (F.col(time) <= horizon)).cast("double")
    rows = _known(df, prediction, time, status)
    reached = F.size(F.filter(F.array(*(F.lit(float(c)) for c in cuts)), lambda c: c <= F.col(prediction)))
    counts = rows.groupBy(reached.alias("k")).agg(F.sum(y).alias("y"), F.count("*").cast("double").alias("n"))
    whole = F.sum("n").alias("_n"), F.sum("y").alias("_y")
    sums = counts.agg(*whole, *(F.sum(F.when(F.col("k") > i, F.struct("y", "n")["y"])).alias(f"t{i}") for i in range(len(cuts))), *(F.sum(F.when(F.col("k") > i, F.col("n"))).alias(f"a{i}") for i in range(len(cuts))))
    long = sums.select("_n", "_y", F.explode(F.array(*(F.struct(F.lit(float(c)).alias("threshold"), F.coalesce(F.col(f"t{i}"), F.lit(0.0)).alias("tp"), F.coalesce(F.col(f"a{i}"), F.lit(0.0)).alias("pos")) for i, c in enumerate(cuts)))).alias("x")).select("_n", "_y", "x.*")
    odds = F.col("threshold") / (1 - F.col("threshold"))
    nb = F.col("tp") / F.col("_n") - (F.col("pos") - F.col("tp")) / F.col("_n") * odds
    everyone = F.col("_y") / F.col("_n") - (F.col("_n") - F.col("_y")) / F.col("_n") * odds
    out = long.where("_n > 0").select("threshold", nb.alias("net_benefit"), everyone.alias("net_benefit_all"), F.lit(0.0).alias("net_benefit_none"))
    avoided = F.when(F.col("net_benefit_all") > 0, F.greatest(F.lit(0.0), (F.col("net_benefit") - F.col("net_benefit_all")) / F.col("net_benefit_all"))).otherwise(F.lit(0.0))
    return out.withColumn("interventions_avoided", avoided)


def compare_decision_curves(df: DataFrame, *, predictions: Sequence[str], time: str, status: str, horizon: float, thresholds: Sequence[float] | None = None) -> DataFrame:
    """``(model_1, model_2, mean_difference)`` of net benefit over the thresholds, for each pair of prediction columns."""
    curves = [decision_curve(df, prediction=p, time=time, status=status, horizon=horizon, thresholds=thresholds).select("threshold", F.col("net_benefit").alias(f"_{i}")) for i, p in enumerate(predictions)]
    both = curves[0]
    for c in curves[1:]:
        both = both.join(c, "threshold")
    pairs = [(i, j) for i in range(len(predictions)) for j in range(i + 1, len(predictions))]
    sums = both.agg(*(F.avg(F.col(f"_{i}") - F.col(f"_{j}")).alias(f"d{i}_{j}") for i, j in pairs))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(predictions[i]).alias("model_1"), F.lit(predictions[j]).alias("model_2"), F.col(f"d{i}_{j}").alias("mean_difference")) for i, j in pairs))).alias("x")).select("x.*")


def utility_at(df: DataFrame, *, prediction: str, time: str, status: str, horizon: float, threshold: float) -> DataFrame:
    """One row at one threshold: sensitivity, specificity, predictive values, net benefit, number needed to treat."""
    y = (F.col(status) != 0) & (F.col(time) <= horizon)
    pos = F.col(prediction) >= threshold
    n = lambda c: F.sum(c.cast("double"))
    out = _known(df, prediction, time, status).agg(n(pos & y).alias("tp"), n(pos & ~y).alias("fp"), n(~pos & y).alias("fn"), n(~pos & ~y).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    total, nb = tp + fp + fn + tn, F.col("net_benefit")
    out = out.withColumns({"sensitivity": F.try_divide(tp, tp + fn), "specificity": F.try_divide(tn, tn + fp), "ppv": F.try_divide(tp, tp + fp), "npv": F.try_divide(tn, tn + fn), "net_benefit": tp / total - fp / total * (threshold / (1 - threshold))})
    return out.withColumn("nnt", F.when(nb > 0, 1 / nb).otherwise(F.lit(float("inf"))))


def log_likelihood_loss(df: DataFrame, *, time: str, status: str, predictions: str, times: Sequence[float], weight: str | None = None) -> DataFrame:
    """One row: right-censored log loss of predicted curves ``predictions[i]`` at ascending ``times[i]``.

    An event costs -ln of the curve's fall over its interval, a censored row -ln of the curve at its time, each at least 1e-7.
    """
    at = F.array(*(F.lit(float(x)) for x in times))
    t, s = F.col(time).cast("double"), F.col(predictions)
    below = F.size(F.filter(at, lambda x: x < t))
    upto = F.size(F.filter(at, lambda x: x <= t))
    i = F.least(below, F.lit(len(times) - 1))
    fall = F.when(i == 0, 1 - F.element_at(s, 1)).otherwise(F.element_at(s, F.greatest(i, F.lit(1))) - F.element_at(s, F.greatest(i, F.lit(0)) + 1))
    stay = F.when(upto == 0, F.lit(1.0)).otherwise(F.element_at(s, F.greatest(upto, F.lit(1))))
    had, w = F.col(status) != 0, _weight(weight)
    cost = -F.log(F.greatest(F.lit(1e-7), F.when(had, fall).otherwise(stay)))
    out = _known(df, time, status, predictions, weight).agg(F.sum(w * cost).alias("loss"), F.try_divide(F.sum(w * cost), F.sum(w)).alias("mean_loss"), F.sum(had.cast("long")).alias("n_events"), F.sum((~had).cast("long")).alias("n_censored"), F.sum(F.when(had, w * cost).otherwise(0.0)).alias("event_part"), F.sum(F.when(~had, w * cost).otherwise(0.0)).alias("censored_part"))
    return out


def subgroups(df: DataFrame, *, time: str, status: str, risk: str, group: str, least: int = 1) -> DataFrame:
    """``(group, n, event_rate, c_index)`` of groups with at least ``least`` rows."""
    rows = _known(df, time, status, risk, group)
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"), F.avg((F.col(status) != 0).cast("double")).alias("event_rate")).where(F.col("n") >= least)
    index = concordance(rows, time=time, status=status, risk=risk, keys=[group], pooled=False).select(group, "c_index")
    return join_keys(sizes, index, [group], "left")


def performance_by_period(df: DataFrame, *, time: str, status: str, risk: str, period: str, threshold: float = 0.05, least: int = 20) -> DataFrame:
    """``subgroups`` by period, with the change of the index since the first period and whether it fell by more than the threshold."""
    per = subgroups(df, time=time, status=status, risk=risk, group=period, least=least)
    first = per.agg(F.min_by("c_index", period).alias("_first"))
    out = per.crossJoin(F.broadcast(first)).withColumn("change", F.col("c_index") - F.col("_first")).drop("_first")  # one row
    return out.withColumn("degraded", F.col("change") < -threshold)


def fairness(df: DataFrame, *, time: str, status: str, risk: str, group: str, horizon: float) -> DataFrame:
    """One row over groups: gap of high-risk shares (demographic parity), of true-positive rates among events by the horizon, and of C.

    High risk is above the median score (the score at place n / 2).
    """
    rows = _known(df, time, status, risk, group).withColumn("_r", F.col(risk).cast("double"))
    at = _positions(rows, "_r")
    median = at.agg(F.min(F.when(F.col("_before") + F.col("_n") > F.floor(F.col("_total") / 2), F.col("_r"))).alias("_m"))
    high = F.col("_r") > F.col("_m")
    y = (F.col(status) != 0) & (F.col(time) <= horizon)
    per = rows.crossJoin(F.broadcast(median)).groupBy(group).agg(F.avg(high.cast("double")).alias("_h"), F.try_divide(F.sum((high & y).cast("double")), F.sum(y.cast("double"))).alias("_tpr"))  # one row
    index = concordance(rows, time=time, status=status, risk=risk, keys=[group], pooled=False).select(group, "c_index")
    both = join_keys(per, index, [group], "left")
    gap = lambda c: (F.max(c) - F.min(c))
    return both.agg(F.count("*").alias("groups"), gap("_h").alias("demographic_parity"), gap("_tpr").alias("equal_opportunity"), gap("c_index").alias("c_index_gap"))


def information_criteria(fits: DataFrame, *, log_likelihood: str, parameters: str, rows: str, events: str | None = None) -> DataFrame:
    """fits with aic, aicc, bic (by rows, and by events if given) and, over all rows of fits, deltas and Akaike weights."""
    ll, k, n = F.col(log_likelihood), F.col(parameters), F.col(rows)
    out = fits.withColumns({"aic": 2 * k - 2 * ll, "bic": k * F.log(n) - 2 * ll})
    out = out.withColumn("aicc", F.when(n - k - 1 > 0, F.col("aic") + 2 * k * (k + 1) / (n - k - 1)).otherwise(F.lit(float("inf"))))
    if events:
        out = out.withColumn("bic_events", k * F.log(F.col(events)) - 2 * ll)
    best = out.agg(F.min("aic").alias("_a"), F.min("bic").alias("_b"))
    out = out.crossJoin(F.broadcast(best)).withColumns({"delta_aic": F.col("aic") - F.col("_a"), "delta_bic": F.col("bic") - F.col("_b")}).drop("_a", "_b")  # one row
    total = out.agg(F.sum(F.exp(-F.col("delta_aic") / 2)).alias("_t"))
    return out.crossJoin(F.broadcast(total)).withColumn("akaike_weight", F.exp(-F.col("delta_aic") / 2) / F.col("_t")).drop("_t")  # one row


def fold_score(folds: DataFrame, *, score: str) -> DataFrame:
    """Mean and population standard deviation of fold scores."""
    return folds.agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.count(score).alias("folds"))


def pooled_effect(df: DataFrame, *, effect: str, std_err: str) -> DataFrame:
    """One row of fixed and random effects (DerSimonian–Laird), Q, tau squared and I squared over studies.

    Studies with a null or an error that isn't positive drop out.
    """
    e, w = F.col(effect).cast("double"), 1 / (F.col(std_err) * F.col(std_err))
    rows = df.where(F.col(effect).isNotNull() & (F.col(std_err) > 0)).select(e.alias("e"), w.alias("w"))
    first = rows.agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sww"), F.sum(F.col("w") * F.col("e")).alias("swe"), F.count("*").alias("k"))
    fixed = first.withColumn("fixed", F.try_divide("swe", "sw"))
    beside = rows.crossJoin(F.broadcast(fixed))  # one row
    gap = F.col("e") - F.col("fixed")
    q = fixed.crossJoin(F.broadcast(beside.agg(F.sum(F.col("w") * gap * gap).alias("q"))))
    tau2 = F.coalesce(F.greatest(F.lit(0.0), F.try_divide(F.col("q") - (F.col("k") - 1), F.col("sw") - F.col("sww") / F.col("sw"))), F.lit(0.0))
    known = q.withColumn("tau2", tau2).withColumn("i2", F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("q") - (F.col("k") - 1), "q"), F.lit(0.0))))
    v = 1 / (1 / F.col("w") + F.col("tau2"))
    random = rows.crossJoin(F.broadcast(known.select("tau2"))).agg((F.sum(v * F.col("e")) / F.sum(v)).alias("random"), F.sqrt(1 / F.sum(v)).alias("random_std_err"))
    return known.crossJoin(F.broadcast(random)).select("k", "fixed", F.sqrt(1 / F.col("sw")).alias("fixed_std_err"), "q", "tau2", "i2", "random", "random_std_err")


def forest(df: DataFrame, *, study: str, effect: str, std_err: str, level: float = 0.95) -> DataFrame:
    """``(study, effect, lower, upper, weight)`` of each study under random effects, and a last row "pooled"."""
    z = z_of(level)
    rows = df.where(F.col(effect).isNotNull() & (F.col(std_err) > 0))
    pooled = pooled_effect(rows, effect=effect, std_err=std_err)
    each = rows.crossJoin(F.broadcast(pooled.select("tau2", "random_std_err")))  # one row
    share = F.pow(F.col("random_std_err"), 2) / (F.col(std_err) * F.col(std_err) + F.col("tau2"))
    ends = lambda e, s: ((e - z * s).alias("lower"), (e + z * s).alias("upper"))
    studies = each.select(F.col(study).cast("string").alias("study"), F.col(effect).cast("double").alias("effect"), *ends(F.col(effect), F.col(std_err)), share.alias("weight"))
    return studies.union(pooled.where("k > 0").select(F.lit("pooled"), "random", *ends(F.col("random"), F.col("random_std_err")), F.lit(1.0)))


def forest_of_coefficients(df: DataFrame, *, name: str, coefficient: str, std_err: str, level: float = 0.95) -> DataFrame:
    """``(name, hazard_ratio, lower, upper, p)`` per coefficient."""
    z, b, s = z_of(level), F.col(coefficient), F.col(std_err)
    return df.select(F.col(name).alias("name"), F.exp(b).alias("hazard_ratio"), F.exp(b - z * s).alias("lower"), F.exp(b + z * s).alias("upper"), (2 * norm_cdf(-F.abs(b / s))).alias("p"))


def small_study_test(df: DataFrame, *, effect: str, std_err: str) -> DataFrame:
    """Egger's regression of effect / error on 1 / error: intercept, its error and t, with k - 2 degrees of freedom."""
    x, y = 1 / F.col(std_err), F.col(effect) / F.col(std_err)
    rows = df.where(F.col(effect).isNotNull() & (F.col(std_err) > 0)).select(x.alias("x"), y.alias("y"))
    out = rows.agg(F.count("*").alias("k"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"), F.sum(F.col("x") * F.col("x")).alias("xx"))
    sse = F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("sxy"))
    se = F.sqrt(sse / (F.col("k") - 2) * F.col("xx") / (F.col("k") * F.col("sxx")))
    return out.select("k", "intercept", se.alias("std_err"), F.try_divide(F.col("intercept"), se).alias("t"), (F.col("k") - 2).alias("df"))

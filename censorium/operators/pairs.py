"""Concordance row by row, with delayed entry: pairs, influence and variances, without making a pair.

A row with (entry, time] is at risk at t if its time is later than t and its entry isn't at t or later; so the rows at risk with a lower
risk than that of an event are counted in two dimensions, with a plus at their times and a minus at their entries.  Two different
ranks of risk agree down to one binary digit and differ in it, which turns a count into running sums, one for each digit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from censorium.functions.lineage import cut
from censorium.functions.prefix import join_keys, running


def _dominated(points: DataFrame, queries: DataFrame, keys: Sequence[str], digits: Column, *, later: bool) -> DataFrame:
    """queries ``(keys, place, rank)`` with ``less``, ``same``, ``more``: weight ``w`` of points ``(keys, place, rank, w)`` at later (or earlier) places of less, equal and more rank."""
    wanted = queries.select(*keys, "place", "_rank").distinct().withColumns({"w": F.lit(0.0), "_asked": F.lit(1)})
    both = points.groupBy(*keys, "place", "_rank").agg(F.sum("w").alias("w")).withColumn("_asked", F.lit(0)).unionByName(wanted)
    parts = both.withColumn("digit", F.explode(F.sequence(F.lit(-1), digits - 1)))
    bit = F.when(F.col("digit") < 0, F.lit(0)).otherwise(F.getbit("_rank", F.greatest("digit", F.lit(0))))
    parts = parts.withColumns({"bit": bit, "prefix": F.expr("shiftright(_rank, digit + 1)")})
    group = [*keys, "digit", "prefix"]
    at = parts.groupBy(*group, "place").agg(*(F.sum(F.when(F.col("bit") == b, F.col("w")).otherwise(0.0)).alias(f"w{b}") for b in (0, 1)))
    # points and queries never share a place
    run = running(at, order="place", keys=group, sums={"l0": F.col("w0"), "l1": F.col("w1")}, reverse=later, strict=True).select(*group, "place", "l0", "l1")
    found = join_keys(parts.where("_asked = 1"), run, [*group, "place"])
    split = F.col("digit") >= 0
    return found.groupBy(*keys, "place", "_rank").agg(
        F.sum(F.when(split & (F.col("bit") == 1), F.col("l0")).otherwise(0.0)).alias("less"), F.sum(F.when(split, F.lit(0.0)).otherwise(F.col("l0"))).alias("same"), F.sum(F.when(split & (F.col("bit") == 0), F.col("l1")).otherwise(0.0)).alias("more")
    )


def concordance_rows(df: DataFrame, *, time: str, status: str, risk: str, entry: str | None = None, weight: str | None = None, keys: Sequence[str] = (), ties_follow: bool | None = None) -> DataFrame:
    """Rows that take part with ``concordant``, ``discordant``, ``tied_risk``: weights of the pairs that a row is in.

    A pair is an event and a row at risk at its time: entry < t < time, and also time = t without an event if ``ties_follow`` (by default
    without ``entry`` only).  Pairs weigh the product of weights; ``keys`` are strata.  Rows with a null time, status,
    risk or weight, or with entry >= time, drop out; a null entry is before all times, a null key is a stratum.
    """
    follow = ties_follow if ties_follow is not None else entry is None
    rows = df.dropna(subset=[time, status, risk, *([weight] if weight else [])])
    if entry:
        rows = rows.where(F.col(entry).isNull() | (F.col(entry) < F.col(time)))
    made = {"_t": F.col(time).cast("double"), "_x": F.col(risk).cast("double"), "_d": F.col(status) != 0, "_w": F.col(weight).cast("double") if weight else F.lit(1.0), **({"_a": F.coalesce(F.col(entry).cast("double"), F.lit(float("-inf")))} if entry else {})}
    rows = rows.withColumns(made)
    ranks = running(rows.select("_x").distinct(), order="_x", sums={"_rank": F.lit(1.0)}).select("_x", (F.col("_rank") - 1).cast("long").alias("_rank"))
    stops = rows.select(F.col("_t").alias("_v"))
    places = running((stops.unionByName(rows.select(F.col("_a").alias("_v"))) if entry else stops).distinct(), order="_v", sums={"pos": F.lit(1.0)}).select("_v", F.col("pos").cast("long").alias("pos"))
    rows = rows.join(ranks, "_x").join(places.select(F.col("_v").alias("_t"), F.col("pos").alias("_pt")), "_t")
    rows = rows.join(places.select(F.col("_v").alias("_a"), F.col("pos").alias("_pa")), "_a") if entry else rows.withColumn("_pa", F.lit(None).cast("long"))
    digits = F.lit(int((ranks.agg(F.max("_rank")).first()[0] or 0)).bit_length() or 1)
    cells = cut(rows.groupBy(*keys, "_pt", "_pa", "_rank", "_d").agg(F.sum("_w").alias("w")), "pairs")
    # events stand at 2 p, asks of events at 2 p + 1, rows at 2 p (at 2 p + 2 if they follow ties), entries at 2 p + 2
    events = cells.where("_d").select(*keys, (2 * F.col("_pt")).alias("place"), "_rank", "w")
    late = (F.lit(follow) & ~F.col("_d")).cast("long")
    risks = cells.select(*keys, (2 * F.col("_pt") + 2 * late).alias("place"), "_rank", "w").unionByName(cells.where("_pa is not null").select(*keys, (2 * F.col("_pa") + 2).alias("place"), "_rank", (-F.col("w")).alias("w")))
    asks = cells.where("_d").select(*keys, (2 * F.col("_pt") + 1).alias("place"), "_rank")
    of_event = _dominated(risks, asks, keys, digits, later=True)
    asked = cells.select(*keys, (2 * F.col("_pt") - 1 + 2 * late).alias("place"), "_rank").unionByName(cells.where("_pa is not null").select(*keys, (2 * F.col("_pa") + 1).alias("place"), "_rank"))
    of_risk = cut(_dominated(events, asked, keys, digits, later=False), "asked")

    def beside(left: DataFrame, found: DataFrame, place: Column, name: str) -> DataFrame:
        own = found.withColumnsRenamed({"place": f"_at{name}", **{c: f"{c}{name}" for c in ("less", "same", "more")}})
        return join_keys(left.withColumn(f"_at{name}", place), own, [*keys, f"_at{name}", "_rank"], "left")

    out = beside(rows, of_event, F.when(F.col("_d"), 2 * F.col("_pt") + 1), "_e")
    out = beside(out, of_risk, 2 * F.col("_pt") - 1 + 2 * late, "_s")
    out = beside(out, of_risk, 2 * F.col("_pa") + 1, "_b")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    # an event is concordant with those of less risk, a row at risk with events of more
    pairs = {n: F.col("_w") * (zero(f"{a}_e") + zero(f"{b}_s") - zero(f"{b}_b")) for n, a, b in (("concordant", "less", "more"), ("discordant", "more", "less"), ("tied_risk", "same", "same"))}
    return out.select(*df.columns, *(c.alias(n) for n, c in pairs.items()))


def concordance_variance(df: DataFrame, *, time: str, status: str, risk: str, entry: str | None = None, weight: str | None = None, keys: Sequence[str] = (), cluster: str | None = None, ties_follow: bool | None = None) -> DataFrame:
    """One row: pairs, ``c_index``, its ``variance`` from influence (summed by ``cluster``, if given) and ``conditional_variance``.

    The influence of a row on C is ((c - d) - (c + d + t) D) / (2 pairs), D being Somers' index.  The conditional variance is that of the ranks of
    events in their risk sets when risk says nothing.  Without pairs all but the counts are null.
    """
    rows = cut(concordance_rows(df, time=time, status=status, risk=risk, entry=entry, weight=weight, keys=keys, ties_follow=ties_follow), "rows")
    total = rows.agg(*(F.coalesce(F.sum(c) / 2, F.lit(0.0)).alias(c) for c in ("concordant", "discordant", "tied_risk")))
    pairs = F.col("_c") + F.col("_d") + F.col("_t")
    beside = rows.crossJoin(F.broadcast(total.toDF("_c", "_d", "_t")))  # one row
    somers = (F.col("_c") - F.col("_d")) / pairs
    one = F.when(pairs > 0, ((F.col("concordant") - F.col("discordant")) - (F.col("concordant") + F.col("discordant") + F.col("tied_risk")) * somers) / (2 * pairs))
    own = beside.select(*([F.col(cluster).alias("_cluster")] if cluster else []), one.alias("_i"))
    if cluster:
        own = own.groupBy("_cluster").agg(F.sum("_i").alias("_i"))
    variance = own.agg(F.sum(F.col("_i") * F.col("_i")).alias("variance"))
    by_chance = _conditional(rows, time, status, risk, entry, weight, keys)
    out = total.crossJoin(variance).crossJoin(by_chance)  # one row each
    n = F.col("concordant") + F.col("discordant") + F.col("tied_risk")
    return out.select("concordant", "discordant", "tied_risk", F.try_divide(F.col("concordant") + F.col("tied_risk") / 2, n).alias("c_index"), "variance", F.try_divide(F.col("_z"), 4 * n * n).alias("conditional_variance"))


def _conditional(rows: DataFrame, time: str, status: str, risk: str, entry: str | None, weight: str | None, keys: Sequence[str]) -> DataFrame:
    """Sum over event times of deaths times the mean square of (lower - higher) ranks: (W^3 - sum of cubed weights of equal risks) / 3 W.

    The cubes change only when a row of that risk comes or goes.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    line = rows.select(*keys, F.col(time).cast("double").alias("time"), F.col(risk).cast("double").alias("_x"), w.alias("w"), F.when(F.col(status) != 0, w).otherwise(0.0).alias("d"))
    if entry:
        line = line.unionByName(rows.where(F.col(entry).isNotNull()).select(*keys, F.col(entry).cast("double").alias("time"), F.col(risk).cast("double").alias("_x"), (-w).alias("w"), F.lit(0.0).alias("d")))
    sums = line.groupBy(*keys, "_x", "time").agg(F.sum("w").alias("w"), F.sum("d").alias("d"))
    run = running(sums, order="time", keys=[*keys, "_x"], sums={"k": F.col("w")}, reverse=True)
    before = F.col("k") - F.col("w")
    at = run.groupBy(*keys, "time").agg(F.sum("w").alias("w"), F.sum("d").alias("d"), F.sum(F.pow("k", F.lit(3)) - F.pow(before, F.lit(3))).alias("cube"))
    whole = running(at, order="time", keys=keys, sums={"W": F.col("w"), "cubes": F.col("cube")}, reverse=True)
    return whole.where("d > 0 and W > 0").agg(F.coalesce(F.sum(F.col("d") * (F.pow("W", F.lit(3)) - F.col("cubes")) / 3 / F.col("W")), F.lit(0.0)).alias("_z"))

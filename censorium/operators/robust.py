"""Infinitesimal-jackknife influence and clustered variance of survival curves.

On the log scale a row's influence on a curve at t is its event over those left, less what the curve's variance process C has
gathered while the row was at risk.  A cluster's influence is therefore A(t) - C(t) R(t), with A and R steps that change only
at its own times: A² , A R and R² summed over clusters are running sums of their changes, so the
variance at all times needs no table of clusters by times.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from censorium.functions.lineage import cut
from censorium.functions.prefix import as_of, join_keys, running
from censorium.functions.riskset import cells
from censorium.operators.curves import confidence_limits

KINDS = {"s": "surv", "h": "cum_hazard"}


def _rows(df: DataFrame, time: str, status: str, cluster: str | None, keys: Sequence[str], weight: str | None, entry: str | None) -> DataFrame:
    rows = df.where(F.col(time).isNotNull() & F.col(status).isNotNull())
    if entry:
        rows = rows.where(F.col(entry).isNull() | (F.col(entry) < F.col(time)))
    first = F.coalesce(F.col(entry).cast("double"), F.lit(float("-inf"))) if entry else F.lit(float("-inf"))
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    return rows.select(*keys, *([F.col(cluster).alias("_cluster")] if cluster else []), first.alias("_from"), F.col(time).cast("double").alias("_to"), (F.col(status) != 0).cast("double").alias("_d"), w.alias("_w"))


def _processes(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, time, n_risk, n_event, surv, cum_hazard, _cs, _ch, _as, _ah)``: variance processes, and what an event adds."""
    at = cells(rows, time="_to", status="_d", keys=keys, weight="_w", entry="_from", keep_bin=True)
    left = F.col("n_risk") - F.col("n_event")
    d = F.col("n_event")
    # when all die the curve is zero and so is its error
    gone = F.when(left > 1e-9 * F.col("n_risk"), 1 / left).otherwise(F.lit(0.0))
    out = running(at, order="time", keys=keys, products={"surv": 1 - d / F.col("n_risk")}, sums={"cum_hazard": d / F.col("n_risk"), "_cs": d / F.col("n_risk") * gone, "_ch": d / (F.col("n_risk") * F.col("n_risk"))})
    # read several times below, one row a time
    return cut(out.withColumns({"_as": gone, "_ah": 1 / F.col("n_risk")}), "processes")


def _changes(rows: DataFrame, line: DataFrame, keys: Sequence[str], entry: str | None) -> DataFrame:
    """``(keys, _cluster, time, _r, _s, _h)``: changes of R and of both A at the own times of each row."""
    steps = line.select(*keys, F.col("time").alias("_at"), "_cs", "_ch", "_as", "_ah")
    own = [c for c in ("_cluster",) if c in rows.columns]
    come = as_of(rows, steps, at="_from", step="_at", values=["_cs", "_ch"], keys=keys) if entry else rows.withColumns({"_cs": F.lit(0.0), "_ch": F.lit(0.0)})
    w = F.col("_w")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    come = come.select(*keys, *own, "_from", "_to", "_d", "_w", (w * zero("_cs")).alias("_es"), (w * zero("_ch")).alias("_eh"))
    both = join_keys(come, steps.withColumnRenamed("_at", "_to"), [*keys, "_to"])
    d = F.col("_d")
    return both.withColumns({"_ls": w * (d * F.col("_as") - F.col("_cs")), "_lh": w * (d * F.col("_ah") - F.col("_ch"))}).drop("_cs", "_ch", "_as", "_ah")


def _steps_of_clusters(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Running A and R of each cluster at its own times, with their changes."""
    came = changes.select(*keys, "_cluster", F.col("_from").alias("time"), F.col("_w").alias("_r"), F.col("_es").alias("_s"), F.col("_eh").alias("_h"))
    went = changes.select(*keys, "_cluster", F.col("_to").alias("time"), (-F.col("_w")).alias("_r"), F.col("_ls").alias("_s"), F.col("_lh").alias("_h"))
    sums = cut(came.unionByName(went).groupBy(*keys, "_cluster", "time").agg(*(F.sum(c).alias(c) for c in ("_r", "_s", "_h"))), "clusters")
    return running(sums, order="time", keys=[*keys, "_cluster"], sums={"R": F.col("_r"), "As": F.col("_s"), "Ah": F.col("_h")})


def _squares(r0: Column, a0: Column, r1: Column, a1: Column, k: str) -> list[Column]:
    return [(a1 * a1 - a0 * a0).alias(f"aa{k}"), (a1 * r1 - a0 * r0).alias(f"ar{k}")]


def robust_curve(df: DataFrame, *, time: str, status: str, cluster: str | None = None, keys: Sequence[str] = (), weight: str | None = None, entry: str | None = None, level: float = 0.95, kind: str = "log") -> DataFrame:
    """One row per group and distinct time: risk set, events, Kaplan–Meier and cumulative hazard with robust errors and limits.

    The error is the root of the sum over clusters (rows, without ``cluster``) of squared influence.  A null cluster is a cluster, a null weight 1, a null entry
    before all times; rows with a null time or status, or entry >= time, drop out.  A cluster of any size is summed by ranges.
    """
    rows = _rows(df, time, status, cluster, keys, weight, entry)
    line = _processes(rows, keys)
    changes = _changes(rows, line, keys, entry)
    if cluster:
        at = _steps_of_clusters(changes, keys)
        r1, r0 = F.col("R"), F.col("R") - F.col("_r")
        made = at.select(*keys, "time", *(c for k, n in (("s", "_s"), ("h", "_h")) for c in _squares(r0, F.col(f"A{k}") - F.col(n), r1, F.col(f"A{k}"), k)), (r1 * r1 - r0 * r0).alias("rr"))
    else:
        zero, w = F.lit(0.0), F.col("_w")
        came = changes.select(*keys, F.col("_from").alias("time"), *(c for k in "sh" for c in _squares(zero, zero, w, F.col(f"_e{k}"), k)), (w * w).alias("rr"))
        went = changes.select(*keys, F.col("_to").alias("time"), *(c for k in "sh" for c in _squares(w, F.col(f"_e{k}"), zero, F.col(f"_e{k}") + F.col(f"_l{k}"), k)), (-w * w).alias("rr"))
        made = came.unionByName(went)
    names = ["aas", "ars", "aah", "arh", "rr"]
    sums = cut(made.groupBy(*keys, "time").agg(*(F.sum(n).alias(n) for n in names)), "squares")
    total = running(sums, order="time", keys=keys, sums={n: F.col(n) for n in names})
    out = join_keys(line, total.select(*keys, "time", *names), [*keys, "time"])
    v = {k: F.sqrt(F.greatest(F.lit(0.0), F.col(f"aa{k}") - 2 * F.col(f"_c{k}") * F.col(f"ar{k}") + F.col(f"_c{k}") * F.col(f"_c{k}") * F.col("rr"))) for k in "sh"}
    out = out.select(*keys, "time", "n_risk", "n_event", "surv", "cum_hazard", (F.col("surv") * v["s"]).alias("std_err"), v["h"].alias("cum_hazard_std_err"))
    lower, upper = confidence_limits(F.col("surv"), F.col("std_err"), kind=kind, level=level)
    return out.withColumns({"lower": lower, "upper": upper})


def curve_influence(df: DataFrame, *, time: str, status: str, cluster: str, times: Sequence[float], keys: Sequence[str] = (), weight: str | None = None, entry: str | None = None) -> DataFrame:
    """``(keys, cluster, time, influence_surv, influence_cum_hazard)`` for each cluster at the given times.

    To leave out a cluster moves an estimate by about minus its influence.  Nulls as in ``robust_curve``.
    """
    rows = _rows(df, time, status, cluster, keys, weight, entry)
    line = _processes(rows, keys)
    steps = cut(_steps_of_clusters(_changes(rows, line, keys, entry), keys).select(*keys, "_cluster", F.col("time").alias("_at"), "R", "As", "Ah"), "steps")
    asked = rows.select(*keys, "_cluster").distinct().withColumn("time", F.explode(F.array(*(F.lit(float(t)) for t in times))))
    found = as_of(asked, steps, at="time", step="_at", values=["R", "As", "Ah"], keys=[*keys, "_cluster"])
    found = as_of(found, line.select(*keys, F.col("time").alias("_at"), "surv", "_cs", "_ch"), at="time", step="_at", values=["surv", "_cs", "_ch"], keys=keys)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return found.select(
        *keys, F.col("_cluster").alias(cluster), "time", (-F.coalesce("surv", F.lit(1.0)) * (zero("As") - zero("_cs") * zero("R"))).alias("influence_surv"), (zero("Ah") - zero("_ch") * zero("R")).alias("influence_cum_hazard")
    )

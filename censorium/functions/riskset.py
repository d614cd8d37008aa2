"""Risk sets over aggregated (group, time) cells.

Rows are aggregated to distinct times first, with map-side combining; what runs over time are
prefix sums by ranges (``prefix.running``), so no task sees all times of a group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from censorium.functions.lineage import cut
from censorium.functions.prefix import binned, running


def timeline(rows: DataFrame, *, time: str, entry: str | None, keys: Sequence[str], at: Mapping[str, Column], leaving: Mapping[str, Column], cuts: Sequence[float] | None = None, once: bool = False) -> DataFrame:
    """One row per (keys, time): sums ``at`` over rows that end there, and ``leaving`` over all rows at risk there.

    A row is at risk at t if entry < t <= time; a null entry is before all times, and a row with entry >= time,
    which is never at risk, drops out.  Times of entry have rows too, with zeros ``at``.
    ``once``: the sums by time, which are looked at twice, are written rather than made twice.
    """
    if entry:
        rows = rows.where(F.col(entry).isNull() | (F.col(entry) < F.col(time)))
    out = rows.select(*keys, F.col(time).cast("double").alias("time"), *(c.alias(n) for n, c in at.items()), *(c.alias(n) for n, c in leaving.items()))
    if entry:
        came = rows.where(F.col(entry).isNotNull()).select(*keys, F.col(entry).cast("double").alias("time"), *(F.lit(0.0).alias(n) for n in at), *((-c).alias(n) for n, c in leaving.items()))
        out = out.unionByName(came)
    sums = out.groupBy(*keys, "time").agg(*(F.sum(n).alias(n) for n in (*at, *leaving)))
    if once:
        sums = cut(sums, "timeline")
    return running(binned(sums, "time", cuts=cuts), order="time", keys=keys, sums={n: F.col(n) for n in leaving}, reverse=True, keep_bin=True)


def cells(df: DataFrame, *, time: str, status: str, keys: Sequence[str] = (), weight: str | None = None, entry: str | None = None, keep_bin: bool = False, cuts: Sequence[float] | None = None) -> DataFrame:
    """``(keys, time, n_event, n_censor, n_risk)``: subjects are at risk at t if entry < t <= time.

    Rows with null time or status drop out; events come before censorings at equal times; null keys are a group.
    """
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    d = (F.col(status) != 0).cast("double")
    rows = df.where(F.col(time).isNotNull() & F.col(status).isNotNull())
    line = timeline(rows, time=time, entry=entry, keys=keys, at={"n_event": w * d, "n_censor": w * (1 - d)}, leaving={"n_risk": w}, cuts=cuts)
    if entry:
        line = line.where("n_event > 0 or n_censor > 0")
    out = line.select(*keys, "time", "n_event", "n_censor", "n_risk", "_bin")
    return out if keep_bin else out.drop("_bin")

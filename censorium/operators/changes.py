"""Change points of many series at once: the best segmentation by pruned dynamic programming, or repeated best splits.

A point of a series is the mean of the values at one order value, so samples at one time are one point.  Costs of a segment
come from running sums: ``l2`` is the sum of squares about its mean, ``normal`` n (1 + log variance) with a
floor of the variance, ``poisson`` the deviance of counts (negative values drop out).  A segmentation costs the sum over its segments and
``penalty`` a change; segments have at least ``least`` points.  Costs that need medians aren't offered.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from censorium.functions.lineage import cut
from censorium.functions.prefix import join_keys, number, running

COSTS = ("l2", "normal", "poisson")
#: Points of a series that a task sees at once.
BLOCK = 20_000
#: Floor of the variance of ``normal``.
FLOOR = 1e-9
#: Rows of a table of segments up to which it is broadcast.
FEW = 100_000


def _check(cost: str, penalty: float, least: int) -> None:
    if cost not in COSTS:
        raise ValueError(f"cost is one of {COSTS}")
    if penalty < 0 or least < 1:
        raise ValueError("penalty is not negative and least is positive")


def _points(df: DataFrame, order: str, value: str, keys: Sequence[str], cost: str) -> DataFrame:
    """``(keys, at, _at, v, _i, _a, _b)``: points with their number from 1 and running sums of value and square, about the mean of the series (not for counts)."""
    rows = df.select(*keys, F.col(order).alias("at"), number(df, order).alias("_at"), F.col(value).cast("double").alias("v")).where("_at is not null and v is not null and not isnan(v)")
    if cost == "poisson":
        rows = rows.where("v >= 0")
    at = cut(rows.groupBy(*keys, "_at").agg(F.min("at").alias("at"), F.avg("v").alias("v")), "points")
    middle = F.col("_m") if cost != "poisson" else F.lit(0.0)
    means = at.groupBy(*keys).agg(F.avg("v").alias("_m"))
    x = F.col("v") - middle
    both = _beside(at, means, keys) if keys else join_keys(at, means, keys, few=True)
    return running(both.withColumn("_x", x), order="_at", keys=keys, sums={"_i": F.lit(1.0), "_a": F.col("_x"), "_b": F.col("_x") * F.col("_x")}).drop("_m", "_x").withColumn("_i", F.col("_i").cast("long"))


def _beside(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join with one row a key; broadcast if these are few, so that a long series stays spread out."""
    right = cut(right, "beside")
    return join_keys(left, right, keys, few=right.limit(FEW + 1).count() <= FEW)


def _cost(n: Column, a: Column, b: Column, kind: str) -> Column:
    square = F.greatest(b - a * a / n, F.lit(0.0))
    if kind == "l2":
        return square
    if kind == "normal":
        v = square / n
        return n * F.when(v >= FLOOR, 1 + F.log(v)).otherwise(float(np.log(FLOOR)) + v / FLOOR)
    return F.when(a > 0, -2 * a * F.log(a / n)).otherwise(F.lit(0.0))


def _costs(n: np.ndarray, a: np.ndarray, b: np.ndarray, kind: str) -> np.ndarray:
    square = np.maximum(b - a * a / n, 0.0)
    if kind == "l2":
        return square
    if kind == "normal":
        v = square / n
        return n * np.where(v >= FLOOR, 1 + np.log(np.maximum(v, FLOOR)), np.log(FLOOR) + v / FLOOR)
    return np.where(a > 0, -2 * a * np.log(np.maximum(a, 1e-300) / n), 0.0)


def _advance(state: dict, i: np.ndarray, a: np.ndarray, b: np.ndarray, kind: str, penalty: float, least: int) -> tuple[dict, list[int]]:
    """The live last changes after points ``i``, and the changes that all of them share, which are final.

    A last change s that is no better than t as the end of a segment never is again once t may be one, ``least`` points on.
    """
    live = [np.array(state[k], dtype=float) for k in ("pos", "best", "a", "b", "dead")]
    chains = [tuple(c) for c in state["chains"]]
    for t, at, bt in zip(i.tolist(), a.tolist(), b.tolist(), strict=True):
        pos, best, sa, sb, dead = live
        stays = dead > t
        if not stays.all():
            live = [x[stays] for x in live]
            chains = [c for c, s in zip(chains, stays.tolist(), strict=True) if s]
            pos, best, sa, sb, dead = live
        may = pos <= t - least
        if not may.any():
            continue
        total = np.where(may, best + _costs(np.maximum(t - pos, 1.0), at - sa, bt - sb, kind), np.inf)
        k = int(np.argmin(total))
        f = total[k] + penalty
        live[4] = np.where(may & (total >= f), np.minimum(dead, t + least), dead)
        live = [np.append(x, y) for x, y in zip(live, (t, f, at, bt, np.inf), strict=True)]
        chains.append((*chains[k], int(pos[k])) if pos[k] > 0 else chains[k])
    shared = 0
    if chains:
        while all(len(c) > shared and c[shared] == chains[0][shared] for c in chains):
            shared += 1
    done = list(chains[0][:shared]) if chains else []
    kept = dict(zip(("pos", "best", "a", "b", "dead"), (x.tolist() for x in live), strict=True))
    return kept | {"chains": [list(c[shared:]) for c in chains]}, done


def _final(state: dict, n: int) -> list[int]:
    """The changes of the segmentation that ends at the last point, beyond those already given."""
    return [int(c) for p, c in zip(state["pos"], state["chains"], strict=True) if p == n for c in c]


def _pruned(points: DataFrame, keys: Sequence[str], cost: str, penalty: float, least: int, block: int) -> DataFrame:
    """``(keys, _i)`` of the last points before changes: series advance side by side, a block of points a round; a round's state is a table."""
    ids = [f"_k{j}" for j in range(len(keys))]
    made = points.select(*(F.col(k).alias(c) for k, c in zip(keys, ids, strict=True)), "_i", "_a", "_b", F.floor((F.col("_i") - 1) / block).cast("long").alias("_block"))
    made = made.withColumn("_key", F.to_json(F.struct(*ids), {"ignoreNullFields": "false"}) if ids else F.lit("{}"))
    names = points.select(*(F.col(k).alias(c) for k, c in zip(keys, ids, strict=True)), F.to_json(F.struct(*[F.col(k).alias(c) for k, c in zip(keys, ids, strict=True)]), {"ignoreNullFields": "false"}).alias("_key")).distinct() if ids else None
    made = cut(made.drop(*ids).repartitionByRange("_block", "_key", "_i"), "series")
    sizes = cut(made.groupBy("_key").agg(F.max("_i").alias("_n")), "sizes")
    last = sizes.agg(F.max("_n")).first()[0] or 0
    shape = "_key string, _i long, pos array<double>, best array<double>, a array<double>, b array<double>, dead array<double>, chains array<array<long>>"
    fields = ("pos", "best", "a", "b", "dead", "chains")
    fresh = {"pos": [0.0], "best": [-penalty], "a": [0.0], "b": [0.0], "dead": [float("inf")], "chains": [[]]}

    def advance(rows: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_i")
        key = rows["_key"].iloc[0] if len(rows) else before["_key"].iloc[0]
        if not len(rows):
            return pd.DataFrame(columns=["_key", "_i", *fields])
        state = {f: list(before[f].iloc[0]) for f in fields} if len(before) else fresh
        n = int(rows["_n"].iloc[0])
        state, done = _advance(state, rows["_i"].to_numpy(), rows["_a"].to_numpy(), rows["_b"].to_numpy(), cost, penalty, least)
        if int(rows["_i"].iloc[-1]) == n:
            done, state = done + _final(state, n), None
        out = [(key, int(i), *[None] * len(fields)) for i in done]
        if state is not None:
            out.append((key, None, *(state[f] for f in fields)))
        return pd.DataFrame(out, columns=["_key", "_i", *fields], dtype=object)

    spark, found, state = points.sparkSession, [], None
    for j in range(-(-last // block)):
        part = join_keys(made.where(F.col("_block") == j), sizes, ["_key"])
        before = state if state is not None else spark.createDataFrame([], shape)
        step = cut(part.groupBy("_key").cogroup(before.groupBy("_key")).applyInPandas(advance, shape), "changes")
        found.append(step.where("_i is not null").select("_key", "_i"))
        state = step.where("_i is null")
    every = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "_key string, _i long")
    if names is None:
        return every.select("_i")
    return join_keys(every, names, ["_key"]).select(*(F.col(c).alias(k) for k, c in zip(keys, ids, strict=True)), "_i")


def _split(points: DataFrame, keys: Sequence[str], cost: str, penalty: float, least: int) -> DataFrame:
    """``(keys, _i)``: each round splits all open segments of all series at their best point, while that gains more than the penalty."""
    spark = points.sparkSession
    open_rows = cut(points.select(*keys, "_i", "_a", "_b", F.lit(0).cast("long").alias("_s")), "open")
    where = [*keys, "_s"]
    found: list[DataFrame] = []
    starts: DataFrame | None = None
    ends = F.struct("_i", "_a", "_b")
    while True:
        edge = open_rows.groupBy(*where).agg(F.max(ends).alias("_hi"))
        if starts is not None:
            edge = join_keys(edge, starts, where)
        else:
            edge = edge.withColumn("_lo", F.struct(F.lit(0).cast("long").alias("_i"), F.lit(0.0).alias("_a"), F.lit(0.0).alias("_b")))
        both = _beside(open_rows, edge, where)
        between = lambda x, y: _cost((F.col(f"{y}._i") - F.col(f"{x}._i")).cast("double"), F.col(f"{y}._a") - F.col(f"{x}._a"), F.col(f"{y}._b") - F.col(f"{x}._b"), cost)
        may = both.withColumn("_me", ends).where((F.col("_i") - F.col("_lo._i") >= least) & (F.col("_hi._i") - F.col("_i") >= least))
        gain = between("_lo", "_hi") - between("_lo", "_me") - between("_me", "_hi") - penalty
        best = may.withColumn("_gain", gain).where("_gain > 0").groupBy(*where).agg(F.max(F.struct("_gain", (-F.col("_i")).alias("_o"), "_me", "_lo")).alias("_best"))
        best = cut(best.select(*where, F.col("_best._me").alias("_me"), F.col("_best._lo").alias("_lo")), "splits")
        if best.isEmpty():
            break
        found.append(best.select(*keys, F.col("_me._i").alias("_i")))
        starts = best.select(*where, "_lo").unionByName(best.select(*keys, F.col("_me._i").alias("_s"), F.col("_me").alias("_lo")))
        chosen = best.select(*where, F.col("_me._i").alias("_c"))
        open_rows = cut(_beside(open_rows, chosen, where).withColumn("_s", F.when(F.col("_i") > F.col("_c"), F.col("_c")).otherwise(F.col("_s"))).drop("_c"), "open")
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], points.select(*keys, "_i").schema)


def segments(df: DataFrame, *, order: str, value: str, keys: Sequence[str] = (), cost: str = "l2", penalty: float = 1.0, least: int = 2, method: str = "pruned", block: int = BLOCK) -> DataFrame:
    """``(keys, segment, start, stop, n, mean, cost)``: the segments of each series, from 0, with their first and last order value.

    ``pruned`` has the least total cost of all segmentations, exactly; series go side by side, a long one takes a round for each ``block`` points.
    ``splits`` takes best splits one after another, all segments of all series in a round, for series that are too long for that.
    Rows with null order or value drop out; a null key is a series; a series too short to split is one segment; an empty table has none.
    """
    _check(cost, penalty, least)
    if method not in ("pruned", "splits"):
        raise ValueError("method is pruned or splits")
    points = cut(_points(df, order, value, keys, cost), "summed")
    made = _pruned(points, keys, cost, penalty, least, block) if method == "pruned" else _split(points, keys, cost, penalty, least)
    flags = cut(made.select(*keys, F.col("_i").alias("_at")), "found")
    # the number of a segment: changes before the point, by one running sum
    marks = points.select(*keys, F.col("_i").cast("double").alias("_at"), F.lit(0.0).alias("_c")).unionByName(flags.select(*keys, (F.col("_at") + 1).cast("double").alias("_at"), F.lit(1.0).alias("_c")))
    marked = running(marks.groupBy(*keys, "_at").agg(F.max("_c").alias("_c")), order="_at", keys=keys, sums={"_g": F.col("_c")})
    placed = join_keys(points.withColumn("_p", F.col("_i").cast("double")), marked.select(*keys, F.col("_at").alias("_p"), F.col("_g").cast("long").alias("segment")), [*keys, "_p"])
    x = F.col("v")
    whole = F.sum(F.when(x > 0, 2 * x * F.log(x)).otherwise(F.lit(0.0))) if cost == "poisson" else F.lit(0.0)
    n = F.count("*").cast("double")
    about = _cost(n, F.sum(x), F.sum(x * x), cost) if cost == "poisson" else _cost(n, F.lit(0.0), F.var_pop("v") * n, cost)
    return placed.groupBy(*keys, "segment").agg(F.min(F.struct("_at", "at")).alias("_lo"), F.max(F.struct("_at", "at")).alias("_hi"), F.count("*").alias("n"), F.avg("v").alias("mean"), (about + whole).alias("cost")).select(*keys, "segment", F.col("_lo.at").alias("start"), F.col("_hi.at").alias("stop"), "n", "mean", "cost")


def change_points(df: DataFrame, *, order: str, value: str, keys: Sequence[str] = (), **how) -> DataFrame:
    """``(keys, at, before, after)``: the first order value after each change and the means of the segments on both sides; takes what ``segments`` takes."""
    made = cut(segments(df, order=order, value=value, keys=keys, **how), "segments")
    after = made.where("segment > 0").select(*keys, (F.col("segment") - 1).alias("segment"), F.col("start").alias("at"), F.col("mean").alias("after"))
    return join_keys(after, made.select(*keys, "segment", F.col("mean").alias("before")), [*keys, "segment"]).select(*keys, "at", "before", "after")

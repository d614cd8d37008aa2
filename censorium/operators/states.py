"""Multi-state and competing-risk histories: Nelson–Aalen of transitions, Aalen–Johansen, Markov rates, Fine–Gray."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from censorium.functions.lineage import cut
from censorium.functions.prefix import as_of, binned, cuts_of, join_keys, running
from censorium.functions.riskset import timeline
from censorium.operators.cox import CoxFit, centred, newton


def transition_hazards(df: DataFrame, *, entry: str, exit: str, from_state: str, to_state: str, event: str) -> DataFrame:
    """``(from, to, time, n_risk, n, hazard, cum_hazard, variance)`` per observed transition and time at which it happens.

    At risk in a state: rows of it with entry < time <= exit.  Rows with a null drop out.
    """
    rows = df.dropna(subset=[entry, exit, from_state, event])
    known = rows.select(F.col(from_state).alias("from"), F.col(to_state).alias("to"), F.col(entry).alias("_a"), F.col(exit).alias("_b"), (F.col(event) != 0).cast("double").alias("_e"))
    risk = timeline(known, time="_b", entry="_a", keys=["from"], at={"_n": F.col("_e")}, leaving={"n_risk": F.lit(1.0)}).where("_n > 0").select("from", "time", "n_risk")
    counts = known.where("_e > 0 and to is not null").groupBy("from", "to", F.col("_b").cast("double").alias("time")).agg(F.sum("_e").alias("n"))
    at = join_keys(counts, risk, ["from", "time"]).withColumn("hazard", F.col("n") / F.col("n_risk"))
    return running(at, order="time", keys=["from", "to"], sums={"cum_hazard": F.col("hazard"), "variance": F.col("n") / (F.col("n_risk") * F.col("n_risk"))})


def state_probabilities(hazards: DataFrame, *, initial: dict, times: Sequence[float] | None = None) -> DataFrame:
    """Aalen–Johansen occupation probabilities from ``transition_hazards``: ``(time, state, probability)``.

    Matrices of one time are multiplied in order of time.  The product runs by ranges: each range's matrices are multiplied in one
    task, the ranges' products (a few small matrices) give each range its start, and the ranges are run again from there.  States
    are few; what meets in a task is one range of times.
    """
    states = sorted({*initial, *(r[c] for r in hazards.select("from", "to").distinct().collect() for c in ("from", "to"))}, key=str)
    place = {s: i for i, s in enumerate(states)}
    k = len(states)
    spark = hazards.sparkSession
    codes = F.create_map(*(F.lit(x) for s, i in place.items() for x in (s, i)))
    steps = binned(hazards.select("time", codes[F.col("from")].alias("i"), codes[F.col("to")].alias("j"), "hazard"), "time")

    def matrices(pdf):
        m = np.eye(k)
        out = []
        for t, part in pdf.sort_values("time").groupby("time"):
            step = np.eye(k)
            for i, j, h in zip(part["i"], part["j"], part["hazard"], strict=True):
                step[i, j] += h
                step[i, i] -= h
            m = m @ step
            out.append((t, m.copy()))
        return out, m

    def total(pdf):
        import pandas as pd

        return pd.DataFrame({"_bin": [int(pdf["_bin"].iloc[0])], "m": [matrices(pdf)[1].ravel().tolist()]})

    products = {r["_bin"]: np.array(r["m"]).reshape(k, k) for r in steps.groupBy("_bin").applyInPandas(total, "_bin int, m array<double>").collect()}
    p = np.array([float(initial.get(s, 0.0)) for s in states])
    start = {}
    for b in sorted(products):
        start[b] = p.tolist()
        p = p @ products[b]

    def run(pdf):
        import pandas as pd

        first = np.array(start[int(pdf["_bin"].iloc[0])])
        rows = [(t, i, float(x)) for t, m in matrices(pdf)[0] for i, x in enumerate(first @ m)]
        return pd.DataFrame(rows, columns=["time", "i", "probability"])

    found = steps.groupBy("_bin").applyInPandas(run, "time double, i int, probability double")
    names = spark.createDataFrame([(i, s) for s, i in place.items()], ["i", "state"])
    out = found.join(F.broadcast(names.withColumn("i", F.col("i").cast("int"))), "i").select("time", "state", "probability")  # a row per state
    if times is None:
        return out
    grid = names.select("state").crossJoin(spark.createDataFrame([(float(t),) for t in times], "at double"))  # states times requested times
    looked = as_of(grid, out, at="at", step="time", values=["probability"], keys=["state"])
    begin = F.create_map(*(F.lit(x) for s in states for x in (s, float(initial.get(s, 0.0)))))
    return looked.select(F.col("at").alias("time"), "state", F.coalesce("probability", begin[F.col("state")]).alias("probability"))


def markov_rates(df: DataFrame, *, entry: str, exit: str, from_state: str, to_state: str, event: str) -> DataFrame:
    """``(from, to, transitions, time_at_risk, rate)`` of a time-homogeneous Markov model: transitions over time spent in the state."""
    rows = df.dropna(subset=[entry, exit, from_state, event])
    spent = rows.groupBy(F.col(from_state).alias("from")).agg(F.sum(F.col(exit) - F.col(entry)).cast("double").alias("time_at_risk"))
    moved = rows.where((F.col(event) != 0) & F.col(to_state).isNotNull()).groupBy(F.col(from_state).alias("from"), F.col(to_state).alias("to")).agg(F.count("*").alias("transitions"))
    return join_keys(moved, spent, ["from"]).select("from", "to", "transitions", "time_at_risk", F.try_divide("transitions", "time_at_risk").alias("rate"))


def markov_probabilities(rates: DataFrame, *, initial: dict, times: Sequence[float]) -> DataFrame:
    """``(time, state, probability)`` at requested times from ``markov_rates``: exponentials of the small generator matrix, on the driver."""
    rows = rates.select("from", "to", "rate").collect()
    states = sorted({*initial, *(r[c] for r in rows for c in ("from", "to"))}, key=str)
    place = {s: i for i, s in enumerate(states)}
    q = np.zeros((len(states), len(states)))
    for r in rows:
        if r["from"] != r["to"]:
            q[place[r["from"]], place[r["to"]]] += r["rate"] or 0.0
    np.fill_diagonal(q, q.diagonal() - q.sum(axis=1))
    p0 = np.array([float(initial.get(s, 0.0)) for s in states])
    out = [(float(t), s, float(x)) for t in times for s, x in zip(states, p0 @ _exponential(q * t), strict=True)]
    return rates.sparkSession.createDataFrame(out, ["time", "state", "probability"])


def _exponential(m: np.ndarray) -> np.ndarray:
    """Matrix exponential by scaling and squaring of a Taylor sum."""
    halvings = max(0, int(np.ceil(np.log2(max(1e-300, np.abs(m).sum(axis=1).max())))) + 4) if m.size else 0
    x = m / 2.0**halvings
    total = term = np.eye(len(m))
    for i in range(1, 20):
        term = term @ x / i
        total = total + term
    for _ in range(halvings):
        total = total @ total
    return total


def subdistribution_rows(df: DataFrame, *, time: str, cause: str, of: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """Rows for a Fine–Gray model of one cause: ``fg_start, fg_stop, fg_status, fg_weight`` beside the row's columns.

    A row that ends from another cause stays at risk with weight G(t-) / G(T-), G being the censoring curve of its group:
    one row up to T with weight 1, then one a run of equal weights between later censoring times.  Only censoring
    times that have an event of the cause after them start a new row.
    """
    rows = df.dropna(subset=[time, cause]).withColumn("_t", F.col(time).cast("double"))
    d, c = (F.col(cause) != 0).cast("double"), (F.col(cause) == 0).cast("double")
    at = timeline(rows, time="_t", entry=None, keys=keys, at={"d": d, "c": c, "o": (F.col(cause) == of).cast("double")}, leaving={"n": F.lit(1.0)})
    left = F.col("n") - F.col("d")
    g = running(at, order="time", keys=keys, products={"_cg": F.when(left > 0, 1 - F.col("c") / left).otherwise(F.lit(1.0))}, keep_bin=True)
    g = running(g, order="time", keys=keys, maxima={"last": F.when(F.col("o") > 0, F.col("time"))}, reverse=True)
    single = rows.where((F.col(cause) == 0) | (F.col(cause) == of)).withColumns({"fg_start": F.lit(0.0), "fg_stop": F.col("_t"), "fg_status": (F.col(cause) == of).cast("int"), "fg_weight": F.lit(1.0)}).drop("_t")
    others = rows.where((F.col(cause) != 0) & (F.col(cause) != of))
    own = as_of(others, g, at="_t", step="time", values=["_cg"], keys=keys, strict=True).withColumn("_cg", F.coalesce("_cg", F.lit(1.0))).withColumnRenamed("_cg", "_first")
    # censoring times with a later event of the cause, as one array per group: its length is that of the censoring curve, not of the data
    cuts = g.where("c > 0 and last > time").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("time", "_cg"))).alias("_cuts"))
    ends = g.groupBy(*keys).agg(F.max(F.when(F.col("o") > 0, F.col("time"))).alias("_end"))
    beside = join_keys(join_keys(own, ends, keys, few=not keys), cuts, keys, "left", few=bool(not keys)) if keys else own.crossJoin(F.broadcast(ends)).crossJoin(F.broadcast(cuts))
    later = F.filter(F.coalesce("_cuts", F.array().cast(cuts.schema["_cuts"].dataType)), lambda x: x["time"] >= F.col("_t"))
    starts = F.concat(F.array(F.struct(F.lit(0.0).alias("time"), F.col("_first").alias("_cg"))), later)
    parts = beside.withColumn("_later", starts).withColumn("_i", F.explode(F.sequence(F.lit(1), F.size("_later")))).withColumn("_x", F.element_at("_later", F.col("_i")))
    stop = F.when(F.col("_i") < F.size("_later"), F.element_at("_later", F.least(F.col("_i") + 1, F.size("_later")))["time"]).otherwise(F.greatest(F.col("_t"), F.coalesce("_end", F.col("_t"))))
    out = parts.withColumns({"fg_start": F.col("_x.time"), "fg_stop": stop, "fg_status": F.lit(0), "fg_weight": F.col("_x._cg") / F.col("_first")})
    return single.unionByName(out.where("fg_stop > fg_start").select(single.columns))


def fine_gray(df: DataFrame, *, time: str, cause: str, x: Sequence[str], of: int = 1, ties: str = "breslow", eps: float = 1e-9, most: int = 20) -> CoxFit:
    """Subdistribution hazards of one cause, with censoring weights G(t-) / G(T-) for rows that ended at T from another cause.

    At equal times events come before censorings.  The weight is a product, so sums over the risk set at t are those over rows with T >= t, and
    G(t-) times running sums of r / G(T-) over rows of other causes before t: no row is repeated.  Rows with a null drop out.
    """
    rows = df.dropna(subset=[time, cause, *x]).select(F.col(time).cast("double").alias("_t"), F.col(cause).alias("_cause"), *(F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(x)))
    d, c = (F.col("_cause") != 0).cast("double"), (F.col("_cause") == 0).cast("double")
    at = timeline(rows, time="_t", entry=None, keys=(), at={"d": d, "c": c}, leaving={"n": F.lit(1.0)})
    left = F.col("n") - F.col("d")
    g = running(at, order="time", products={"_grown": F.when(left > 0, 1 - F.col("c") / left).otherwise(F.lit(1.0))}, strict=True)
    g = cut(g.select("time", "_grown"), "censoring")
    other = (F.col("_cause") != 0) & (F.col("_cause") != of)
    # where all are censored nobody of another cause is left to come back
    late = F.when(other & (F.col("_grown") > 0), 1 / F.col("_grown")).otherwise(F.lit(0.0))
    kept = rows.join(g.withColumnRenamed("time", "_t"), "_t").select("_t", (F.col("_cause") == of).cast("int").alias("_s"), late.alias("_late"), *(f"_c{i}" for i in range(len(x)))).persist()
    try:
        return newton(centred(kept, len(x)), names=x, offset=None, start=None, eps=eps, most=most, ties=ties, time="_t", status="_s", strata=(), entry=None, weight=None, cuts=cuts_of(kept, "_t"), late=F.col("_late"), grown=g)
    finally:
        kept.unpersist()


def sojourn(df: DataFrame, *, entry: str, exit: str, state: str, event: str) -> DataFrame:
    """``(state, n, events, mean_time, rate)``: exponential sojourn times by state, censored rows counting their time."""
    rows = df.dropna(subset=[entry, exit, state, event])
    out = rows.groupBy(F.col(state).alias("state")).agg(F.count("*").alias("n"), F.sum((F.col(event) != 0).cast("double")).alias("events"), F.sum(F.col(exit) - F.col(entry)).cast("double").alias("_t"))
    return out.select("state", "n", "events", F.try_divide("_t", "events").alias("mean_time"), F.try_divide("events", "_t").alias("rate"))

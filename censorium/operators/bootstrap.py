"""Resampled fits and curves, all replicates in one pass.

No row is drawn or moved: a row's weight in a replicate comes from a hash of its identity, so it is the same however
the rows are partitioned and after a lost task.  Poisson(1) weights are the usual resampling of rows (or of clusters:
rows with equal ids share their weights), exponential weights are the Bayesian bootstrap.  A replicate is one more key of
the risk-set sums, made inside the task and combined there, so what is shuffled are distinct times times replicates.  For a Cox model weights are
drawn once: distinct rows beside each replicate are written, until ``lineage.clear``, and a Newton step
of all replicates is one scan of them (its sums by time are written too), of which n (p + p(p+1)/2 + 1) sums come to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from censorium.functions.lineage import cut
from censorium.functions.prefix import cuts_of
from censorium.functions.riskset import cells
from censorium.operators import aft, cox

KINDS = ("poisson", "exponential")
#: Bits of a draw; a digest has four.
BITS, DRAWS = 32, 4


def poisson_steps() -> list[int]:
    """Draws from which on the weight is 1, 2, ...: the distribution function of Poisson(1) in units of a draw."""
    total, out = 0.0, []
    for k in range(12):
        total += math.exp(-1) / math.factorial(k)
        out.append(math.floor(total * (1 << BITS)))
    return out


def replicates(df: DataFrame, *, ids: Sequence[str], n: int, kind: str = "poisson", seed: int = 0, weight: str | None = None, name: str = "_b", into: str = "_w") -> DataFrame:
    """df beside each of the replicates 0 .. n-1 in which it has a weight above 0: columns ``name`` and ``into``.

    ``weight`` multiplies; rows in which it is null drop out.  Rows with equal ids have equal weights, which resamples
    clusters; a null id is an empty one.  Columns of these names are replaced.
    """
    if kind not in KINDS or n < 1:
        raise ValueError(f"kind is one of {KINDS}, and there is at least one replicate")
    who = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ids), F.col("_draw_group").cast("string"))
    rows = (df.where(F.col(weight).isNotNull()) if weight else df).withColumn("_draw_group", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // DRAWS)))).withColumn("_draw_hash", F.md5(who))
    size = BITS // 4
    each = [F.struct((F.col("_draw_group") * DRAWS + j).cast("int").alias("b"), F.substring("_draw_hash", size * j + 1, size).alias("u")) for j in range(DRAWS)]
    rows = rows.withColumn("_draw", F.explode(F.array(*each))).where(F.col("_draw.b") < n)
    u = F.col("_draw.u")
    if kind == "poisson":
        # digits of equal number are in the order of their values; no draw reaches a step of 1 << BITS
        steps = [s for s in poisson_steps() if s < 1 << BITS]
        drawn = F.lit(float(len(steps)))
        for k, s in reversed(list(enumerate(steps))):
            drawn = F.when(u < f"{s:0{size}x}", F.lit(float(k))).otherwise(drawn)
    else:
        drawn = -F.log((F.conv(u, 16, 10).cast("double") + 0.5) / float(1 << BITS))
    if weight:
        drawn = drawn * F.col(weight).cast("double")
    out = rows.withColumn("_draw_weight", drawn).where("_draw_weight > 0").withColumns({name: F.col("_draw.b"), into: F.col("_draw_weight")})
    return out.drop("_draw_group", "_draw_hash", "_draw", "_draw_weight")


def places(n: int, level: float) -> tuple[int, int]:
    """Where the limits are among n values in order: the floors of n a/2 and n (1 - a/2), a = 1 - level."""
    if not 0 < level < 1:
        raise ValueError("level is between 0 and 1")
    a = 1 - level
    # a level such as 0.9 isn't exact in binary: a whole number stays one
    return min(n - 1, math.floor(n * a / 2 + 1e-9)), min(n - 1, math.floor(n * (1 - a / 2) + 1e-9))


def bootstrap_curve(df: DataFrame, *, time: str, status: str, ids: Sequence[str], times: Sequence[float], keys: Sequence[str] = (), n: int = 200, kind: str = "poisson", level: float = 0.95, weight: str | None = None, entry: str | None = None, seed: int = 0) -> DataFrame:
    """``(keys, time, n_replicates, mean, std_err, lower, upper)`` of the Kaplan-Meier curve at requested times.

    Rows with a null time or status drop out.  A replicate in which a group has no row says nothing of that group; before the first time of a
    replicate its curve is 1, after the last it keeps its value.  One value a replicate is brought together for a group and time.
    """
    own = df.where(F.col(time).isNotNull() & F.col(status).isNotNull()).select(*dict.fromkeys([*keys, *ids, time, status, *(c for c in (weight, entry) if c)]))
    # ranges are those of the data's times, so replicates are made once
    cuts = cuts_of(own.withColumn("_t", F.col(time).cast("double")), "_t")
    rows = replicates(own, ids=ids, n=n, kind=kind, seed=seed, weight=weight)
    # summed once and written, as risk sets look at it twice
    drawn = rows.groupBy(*dict.fromkeys([*keys, "_b", time, status, *([entry] if entry else [])])).agg(F.sum("_w").alias("_w"))
    at = cells(cut(drawn, "replicates"), time=time, status=status, keys=[*keys, "_b"], weight="_w", entry=entry, cuts=cuts)
    stays = F.when(F.col("n_event") > 0, F.greatest(F.lit(0.0), 1 - F.col("n_event") / F.col("n_risk"))).otherwise(F.lit(1.0))
    # only the risk sets run over time: the curve at a time is a product of what lies before
    per = at.groupBy(*keys, "_b").agg(*(F.product(F.when(F.col("time") <= t, stays).otherwise(F.lit(1.0))).alias(f"_{i}") for i, t in enumerate(times)))
    values = per.select(*keys, F.explode(F.array(*(F.struct(F.lit(float(t)).alias("time"), F.col(f"_{i}").alias("v")) for i, t in enumerate(times)))).alias("x")).select(*keys, "x.*")
    return _summary(values, [*keys, "time"], n, level)


def _summary(values: DataFrame, keys: Sequence[str], n: int, level: float) -> DataFrame:
    """Mean, standard deviation and limits of at most n values ``v`` of each key."""
    low, high = places(n, level)
    out = values.groupBy(*keys).agg(F.count("*").alias("n_replicates"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std_err"), F.array_sort(F.collect_list("v")).alias("_v"))
    m = F.col("n_replicates")
    a = 1 - level
    # groups that some replicates lack have fewer values
    at = lambda whole, share: F.when(m == n, F.lit(whole)).otherwise(F.least(m - 1, F.floor(m * share + 1e-9)).cast("int"))
    return out.select(*keys, "n_replicates", "mean", "std_err", F.get("_v", at(low, a / 2)).alias("lower"), F.get("_v", at(high, 1 - a / 2)).alias("upper"))


@dataclass
class Resampled:
    """A fit and those of its replicates; replicates that have no maximum are left out and counted."""

    names: list[str]
    coefficients: np.ndarray
    #: One row a replicate, in order of ``replicates``.
    samples: np.ndarray
    replicates: list[int]
    failed: int
    steps: int
    level: float

    @property
    def std_errors(self) -> np.ndarray:
        return self.samples.std(axis=0, ddof=1) if len(self.samples) > 1 else np.full(len(self.names), np.nan)

    def limits(self) -> tuple[np.ndarray, np.ndarray]:
        """Percentile limits (see ``places``)."""
        if not len(self.samples):
            return np.full(len(self.names), np.nan), np.full(len(self.names), np.nan)
        low, high = places(len(self.samples), self.level)
        ordered = np.sort(self.samples, axis=0)
        return ordered[low], ordered[high]

    def table(self, spark) -> DataFrame:
        """One row a coefficient: estimate, error and limits over replicates."""
        lower, upper = self.limits()
        rows = [(c, *(float(v) for v in r)) for c, *r in zip(self.names, self.coefficients, self.std_errors, lower, upper, strict=True)]
        return spark.createDataFrame(rows, "name string, coefficient double, std_err double, lower double, upper double")

    def sample_table(self, spark) -> DataFrame:
        rows = [(b, c, float(v)) for b, r in zip(self.replicates, self.samples, strict=True) for c, v in zip(self.names, r, strict=True)]
        return spark.createDataFrame(rows, "replicate int, name string, coefficient double")


Step = Callable[[Mapping[int, np.ndarray]], Mapping[int, tuple[float, np.ndarray, np.ndarray]]]


def _maximise(step: Step, start: np.ndarray, n: int, *, eps: float, most: int) -> tuple[dict[int, np.ndarray], int]:
    """Newton with halving of n likelihoods at once; ``step`` gives value, score and information at one point each.

    A replicate is done when its likelihood moves by less than eps, relatively; those that ``step`` doesn't know, aren't finite or don't get there are left out.
    """

    def move(u: np.ndarray, info: np.ndarray) -> np.ndarray:
        values, vectors = np.linalg.eigh(info)
        return vectors @ ((vectors.T @ u) / np.maximum(np.abs(values), 1e-10 * max(1e-300, np.abs(values).max())))

    fine = lambda found: found is not None and math.isfinite(found[0]) and np.isfinite(found[1]).all() and np.isfinite(found[2]).all()
    first = step({b: start for b in range(n)})
    at = {b: (start, *first[b]) for b in range(n) if fine(first.get(b))}
    size = dict.fromkeys(at, 1.0)
    done: dict[int, np.ndarray] = {}
    steps = 0
    for steps in range(1, most + 1):
        asked = {b: at[b][0] + size[b] * move(at[b][2], at[b][3]) for b in at if b not in done}
        found = step(asked)
        for b, theta in asked.items():
            before = at[b][1]
            if fine(found.get(b)) and found[b][0] >= before - 1e-10 * max(1.0, abs(before)):
                at[b], size[b] = (theta, *found[b]), 1.0
                if abs(found[b][0] - before) <= eps * max(1.0, abs(before)):
                    done[b] = theta
            elif size[b] < 1e-6:
                del at[b]
            else:
                size[b] /= 2
        if len(done) == len(at):
            break
    return done, steps


def _points(df: DataFrame, at: Mapping[int, np.ndarray]) -> DataFrame:
    """df's rows of the replicates in ``at``, with the point as the array ``_at``: one small row a replicate is broadcast."""
    points = df.sparkSession.createDataFrame([(b, [float(v) for v in theta]) for b, theta in at.items()], "_b int, _at array<double>")
    return df.join(F.broadcast(points), "_b")


def bootstrap_cox(
    df: DataFrame, *, time: str, status: str, x: Sequence[str], ids: Sequence[str], n: int = 200, kind: str = "poisson", level: float = 0.95, strata: Sequence[str] = (), entry: str | None = None, weight: str | None = None, seed: int = 0, eps: float = 1e-9, most: int = 30
) -> Resampled:
    """Cox model (Breslow ties) and its coefficients in n replicates, each started at those of the data.

    Rows with a null time, status, covariate or weight drop out, as in ``cox_fit``.  Replicates without events have no maximum.
    """
    names = [f"_c{i}" for i in range(len(x))]
    own = cox._rows(df, time, status, x, strata, entry, weight)
    plain = own.select(*dict.fromkeys([time, status, *strata, *ids, *(c for c in (entry, weight) if c)]), *(F.col(c).cast("double").alias(k) for c, k in zip(x, names, strict=True))).persist()
    try:
        kept = cox.centred(plain, len(x))
        # equal rows are one row with their weight, written once, and a step reads these
        alike = [*dict.fromkeys([time, status, *strata, *([entry] if entry else [])]), *names]
        data = cut(kept.groupBy(*alike).agg(F.sum(F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w")), "rows")
        how = dict(time=time, status=status, entry=entry, cuts=cuts_of(data.withColumn("_t", F.col(time).cast("double")), "_t"))
        whole = cox.newton(data, names=x, offset=None, start=None, eps=eps, most=most, strata=strata, weight="_w", ties="breslow", **how)
        rows = cut(replicates(kept, ids=ids, n=n, kind=kind, seed=seed, weight=weight).groupBy("_b", *alike).agg(F.sum("_w").alias("_w")), "replicates")
        ranges = data.agg(*(F.min(c) for c in names), *(F.max(c) for c in names)).first()
        p = len(x)
        pairs = [(i, j) for i in range(p) for j in range(i, p)]
        # a bound of each replicate's largest predictor, so that exp can't overflow and no pass is needed
        bound = lambda beta: float(sum(max(b * (ranges[i] or 0.0), b * (ranges[p + i] or 0.0)) for i, b in enumerate(beta)))

        def step(at: Mapping[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
            beside = _points(rows, {b: np.append(t, bound(t)) for b, t in at.items()})
            lp = sum((F.col(c) * F.get("_at", F.lit(i)) for i, c in enumerate(names)), F.lit(0.0)) - F.get("_at", F.lit(p))
            sums = cox.risk_sums(beside, x=names, lp=lp, strata=[*strata, "_b"], weight="_w", ties="breslow", once=True, **how).where("d > 0")
            means = cox._means(p)
            got = sums.groupBy("_b").agg(F.sum(F.col("e") - F.col("q.l")).alias("ll"), *(F.sum(F.col(f"x{i}") - means[i]).alias(f"u{i}") for i in range(p)), *(F.sum(cox._second(i, j)).alias(f"i{i}_{j}") for i, j in pairs))
            return {r["_b"]: _parts(r, p, pairs) for r in got.collect()}  # one row a replicate

        found, steps = _maximise(step, whole.coefficients, n, eps=eps, most=most)
        return _resampled(list(x), whole.coefficients, found, n, steps, level)
    finally:
        plain.unpersist()


def _parts(r, p: int, pairs: Sequence[tuple[int, int]]) -> tuple[float, np.ndarray, np.ndarray]:
    info = np.zeros((p, p))
    for i, j in pairs:
        info[i, j] = info[j, i] = _value(r[f"i{i}_{j}"])
    return _value(r["ll"]), np.array([_value(r[f"u{i}"]) for i in range(p)]), info


def _value(v: float | None) -> float:
    return math.nan if v is None else float(v)


def _resampled(names: list[str], coefficients: np.ndarray, found: Mapping[int, np.ndarray], n: int, steps: int, level: float) -> Resampled:
    at = sorted(found)
    samples = np.array([found[b] for b in at]).reshape(len(at), len(names))
    return Resampled(names, np.asarray(coefficients, dtype=float), samples, at, n - len(at), steps, level)


def bootstrap_aft(
    df: DataFrame, *, time: str, status: str, x: Sequence[str] = (), ids: Sequence[str], family: str = "weibull", n: int = 200, kind: str = "poisson", level: float = 0.95, weight: str | None = None, seed: int = 0, eps: float = 1e-9, most: int = 50
) -> Resampled:
    """A parametric model of time and its replicates: ``intercept``, the covariates and, unless the family fixes it, ``log_scale``.

    Rows drop out as in ``time_fit``.
    """
    distribution, logged, fixed = aft._family(family)
    whole = aft.time_fit(df, time=time, status=status, x=x, family=family, weight=weight, eps=eps, most=most)
    rows = aft.prepared(df, time=time, status=status, x=x, logged=logged, weight=weight, also=ids).persist()
    try:
        drawn = replicates(rows, ids=[f"_id{i}" for i in range(len(ids))], n=n, kind=kind, seed=seed, weight="_w")
        p = len(x) + 1
        free = p if fixed is not None else p + 1
        v = [F.lit(1.0), *(F.col(f"_x{i}") for i in range(p - 1))]

        def step(at: Mapping[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
            beside = _points(drawn, at if free > p else {b: np.append(t, math.log(fixed)) for b, t in at.items()})
            lp = sum((c * F.get("_at", F.lit(i)) for i, c in enumerate(v)), F.lit(0.0))
            got = aft.step_sums(beside, v, lp, F.get("_at", F.lit(p)), distribution, logged, keys=["_b"])
            return {r["_b"]: tuple(a if np.isscalar(a) else a[:free] if a.ndim == 1 else a[:free, :free] for a in aft.parts(r, p)) for r in got.collect()}  # one row a replicate

        own = whole.coefficients if fixed is not None else np.append(whole.coefficients, math.log(whole.scale))
        found, steps = _maximise(step, own, n, eps=eps, most=most)
        return _resampled(["intercept", *x, *([] if fixed is not None else ["log_scale"])], own, found, n, steps, level)
    finally:
        rows.unpersist()

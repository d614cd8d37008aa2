"""Interval-censored rows [left, right]: the non-parametric maximum-likelihood curve by self-consistency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from censorium.functions.lineage import cut
from censorium.functions.prefix import as_of, binned, join_keys, running


def support(df: DataFrame, *, left: str, right: str, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, lo, hi)``: the innermost intervals: a left end followed, with no end between, by a right end.

    A null right end is infinite.  An exact time is an interval with equal ends.  Distinct ends go by ranges.
    """
    rows = df.where(F.col(left).isNotNull()).select(*keys, F.col(left).cast("double").alias("l"), F.coalesce(F.col(right).cast("double"), F.lit(float("inf"))).alias("r"))
    # at one value a left end comes before a right end: intervals are closed
    ends = rows.select(*keys, F.col("l").alias("v"), F.lit(0).alias("k"), F.lit(True).alias("is_left")).union(rows.select(*keys, F.col("r").alias("v"), F.lit(1).alias("k"), F.lit(False).alias("is_left"))).distinct()
    line = ends.withColumn("o", F.struct("v", "k"))
    near = running(line.select(*keys, "o", "v", "k", "is_left"), order="o", keys=keys, maxima={"_before": F.struct("o", "is_left")}, strict=True)
    return near.where("not is_left and _before.is_left").select(*keys, F.col("_before.o.v").alias("lo"), F.col("v").alias("hi"))


def interval_curve(df: DataFrame, *, left: str, right: str, keys: Sequence[str] = (), weight: str | None = None, most: int = 200, eps: float = 1e-6) -> DataFrame:
    """``(keys, lo, hi, mass, surv)``: mass of each innermost interval and the curve after it.

    Rows are aggregated to distinct (left, right) first.  Steps pass sums over ranges of intervals through prefix sums, so a row
    looks up two of them instead of meeting each interval it covers; a step is a few joins of the distinct rows.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.where(F.col(left).isNotNull()).groupBy(*keys, F.col(left).cast("double").alias("l"), F.coalesce(F.col(right).cast("double"), F.lit(float("inf"))).alias("r")).agg(F.sum(w).alias("w"))
    inner = running(support(df, left=left, right=right, keys=keys), order="hi", keys=keys, sums={"i": F.lit(1.0)})
    inner = cut(inner, "intervals")
    counts = inner.groupBy(*keys).agg(F.count("*").alias("_k"))
    # places of the first and last innermost interval inside each row: those with lo >= l and hi <= r
    first = as_of(rows, inner.select(*keys, "lo", "i"), at="l", step="lo", values=["i"], keys=keys, strict=True).withColumn("a", F.coalesce("i", F.lit(0.0))).drop("i")
    placed = as_of(first, inner.select(*keys, "hi", "i"), at="r", step="hi", values=["i"], keys=keys).withColumn("b", F.coalesce("i", F.lit(0.0))).drop("i")
    placed = placed.select(*keys, "w", "a", "b").groupBy(*keys, "a", "b").agg(F.sum("w").alias("w")).where("b > a")
    placed = cut(placed, "rows")
    total = placed.groupBy(*keys).agg(F.sum("w").alias("_w"))
    mass = join_keys(inner, counts, keys, few=not keys).select(*keys, "i", (1 / F.col("_k")).alias("p"))
    for _ in range(most):
        cum = running(mass, order="i", keys=keys, sums={"c": F.col("p")}).select(*keys, "i", "c")
        at = lambda rows, col, name: join_keys(rows.withColumn("_i", F.col(col)), cum.select(*keys, F.col("i").alias("_i"), F.col("c").alias(name)), [*keys, "_i"], "left").drop("_i").fillna(0.0, [name])  # noqa: B023, E731
        share = at(at(placed, "a", "ca"), "b", "cb").withColumn("s", F.col("w") / F.greatest(F.col("cb") - F.col("ca"), F.lit(1e-300)))
        # each row adds s to all places a < i <= b: differences at the ends, then a running sum
        steps = share.select(*keys, (F.col("a") + 1).alias("i"), F.col("s")).union(share.select(*keys, (F.col("b") + 1).alias("i"), -F.col("s"))).groupBy(*keys, "i").agg(F.sum("s").alias("s"))
        both = join_keys(mass, steps, [*keys, "i"], "left").fillna(0.0, ["s"])
        run = running(binned(both, "i"), order="i", keys=keys, sums={"t": F.col("s")})
        new = join_keys(run, total, keys, few=not keys).select(*keys, "i", (F.col("p") * F.col("t") / F.col("_w")).alias("p"), F.abs(F.col("p") * F.col("t") / F.col("_w") - F.col("p")).alias("_d"))
        new = cut(new, "mass")
        moved = new.agg(F.max("_d")).first()[0] or 0.0
        mass = new.select(*keys, "i", "p")
        if moved < eps:
            break
    out = join_keys(inner, mass, [*keys, "i"])
    return running(out, order="i", keys=keys, sums={"_c": F.col("p")}).select(*keys, "lo", "hi", F.col("p").alias("mass"), F.greatest(F.lit(0.0), 1 - F.col("_c")).alias("surv"))

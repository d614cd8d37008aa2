"""What predictions depend on: accumulated and partial effects by quantile bins, permutation importance, change points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from censorium.functions.prefix import join_keys, running
from censorium.operators.metrics import concordance


def _binned(df: DataFrame, feature: str, bins: int, name: str = "_b") -> DataFrame:
    """df with the bin of a feature between exact quantiles (equal quantiles merge), and the bin's edges."""
    cuts = df.agg(F.array_distinct(F.percentile(F.col(feature).cast("double"), [i / bins for i in range(bins + 1)])).alias(f"{name}_e"))
    v = F.col(feature).cast("double")
    place = F.least(F.size(F.filter(f"{name}_e", lambda c: c <= v)) - 1, F.greatest(F.size(f"{name}_e") - 2, F.lit(0)))
    return df.where(F.col(feature).isNotNull()).crossJoin(F.broadcast(cuts)).withColumn(name, place)  # one row of edges


def accumulated_effect(df: DataFrame, *, feature: str, prediction: str, bins: int = 20) -> DataFrame:
    """``(bin, edge, n, effect)``: running sum over quantile bins of the bin's mean prediction, less its mean over the edges.

    A bin adds its mean prediction, not a difference of predictions at its edges, which would need the model.
    """
    rows = _binned(df.dropna(subset=[feature, prediction]), feature, bins)
    per = rows.groupBy("_b").agg(F.avg(prediction).alias("m"), F.count("*").alias("n"), F.first("_b_e").alias("e"))
    run = running(per, order="_b", sums={"c": F.col("m")})
    edges = run.select(F.col("_b").alias("bin"), F.element_at("e", F.col("_b") + 2).alias("edge"), "n", F.col("c").alias("effect"))
    first = run.where("_b = 0").select(F.lit(-1).alias("bin"), F.element_at("e", 1).alias("edge"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("effect"))
    both = edges.unionByName(first)
    mean = both.agg(F.avg("effect").alias("_m"))
    return both.crossJoin(F.broadcast(mean)).withColumn("effect", F.col("effect") - F.col("_m")).drop("_m")  # one row


def partial_means(df: DataFrame, *, features: Sequence[str], prediction: str, bins: int = 10) -> DataFrame:
    """Mean prediction and rows by the joint quantile bins of one or two features: columns ``b0 (, b1), n, mean``."""
    rows = df.dropna(subset=[*features, prediction])
    for i, f in enumerate(features):
        rows = _binned(rows, f, bins, f"b{i}").drop(f"b{i}_e")
    return rows.groupBy(*(f"b{i}" for i in range(len(features)))).agg(F.count("*").alias("n"), F.avg(prediction).alias("mean"))


def interaction(df: DataFrame, *, feature_1: str, feature_2: str, prediction: str, bins: int = 10) -> DataFrame:
    """One row ``(h2, h)``: share of the joint bins' variance that the sum of both features' own centred means doesn't explain."""
    rows = df.dropna(subset=[feature_1, feature_2, prediction])
    for i, f in enumerate((feature_1, feature_2)):
        rows = _binned(rows, f, bins, f"b{i}").drop(f"b{i}_e")
    y = F.col(prediction).cast("double")
    joint = rows.groupBy("b0", "b1").agg(F.count("*").alias("n"), F.avg(y).alias("m"))
    mean = rows.agg(F.avg(y).alias("_g"))
    one = [rows.groupBy(f"b{i}").agg(F.avg(y).alias(f"m{i}")) for i in range(2)]
    both = joint.join(one[0], "b0").join(one[1], "b1").crossJoin(F.broadcast(mean))  # one row
    gap = (F.col("m") - F.col("_g")) - (F.col("m0") - F.col("_g")) - (F.col("m1") - F.col("_g"))
    h2 = F.coalesce(F.try_divide(F.sum(F.col("n") * gap * gap), F.sum(F.col("n") * F.pow(F.col("m") - F.col("_g"), 2))), F.lit(0.0))
    return both.agg(h2.alias("h2")).withColumn("h", F.sqrt("h2"))


def permutation_importance(df: DataFrame, *, time: str, status: str, features: Sequence[str], coefficients: Sequence[float], row: str, repeats: int = 5, seed: int = 0) -> DataFrame:
    """``(feature, importance, std)``: fall of the concordance of a linear score when a feature's values are dealt out anew.

    A permutation joins rows in the order of one hash with rows in the order of another: places are running counts by ranges.
    """
    rows = df.dropna(subset=[time, status, row, *features])
    spark = rows.sparkSession
    score = F.lit(0.0)
    for c, b in zip(features, coefficients, strict=True):
        score = score + F.col(c).cast("double") * float(b)
    base = concordance(rows.withColumn("_s", score), time=time, status=status, risk="_s").first()["c_index"] or 0.0
    places = running(rows.select(F.col(row).alias("_r"), F.struct(F.xxhash64(row, F.lit(-1)), F.col(row)).alias("_o")), order="_o", sums={"_p": F.lit(1)}).select("_r", "_p")
    numbered = rows.join(places, rows[row] == F.col("_r")).drop("_r").persist()
    out = []
    try:
        for c, b in zip(features, coefficients, strict=True):
            falls = []
            for k in range(repeats):
                dealt = running(rows.select(F.col(c).cast("double").alias("_v"), F.struct(F.xxhash64(row, F.lit(seed), F.lit(k)), F.col(row)).alias("_o")), order="_o", sums={"_p": F.lit(1)}).select("_p", "_v")
                moved = numbered.join(dealt, "_p").withColumn("_s", score + (F.col("_v") - F.col(c)) * float(b))
                falls.append(base - (concordance(moved, time=time, status=status, risk="_s").first()["c_index"] or 0.0))
            mean = sum(falls) / len(falls)
            out.append((c, float(mean), float((sum((f - mean) ** 2 for f in falls) / len(falls)) ** 0.5)))
        return spark.createDataFrame(out, "feature string, importance double, std double")
    finally:
        numbered.unpersist()


def change_point(df: DataFrame, *, order: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, at, gain)``: the split of each series that lowers the sum of squares most, by running sums; null for series of one value."""
    rows = df.dropna(subset=[order, value]).groupBy(*keys, F.col(order).cast("double").alias("t")).agg(F.sum(value).cast("double").alias("v"), F.count("*").cast("double").alias("c"))
    total = rows.groupBy(*keys).agg(F.sum("v").alias("_v"), F.sum("c").alias("_c"))
    run = running(rows, order="t", keys=keys, sums={"s": F.col("v"), "n": F.col("c")})
    both = join_keys(run, total, keys, few=not keys).where("n < _c")
    gain = F.pow("s", 2) / F.col("n") + F.pow(F.col("_v") - F.col("s"), 2) / (F.col("_c") - F.col("n")) - F.pow("_v", 2) / F.col("_c")
    best = both.groupBy(*keys).agg(F.max(F.struct(gain.alias("gain"), (-F.col("t")).alias("t"))).alias("b"))
    return best.select(*keys, (-F.col("b.t")).alias("at"), F.col("b.gain").alias("gain"))

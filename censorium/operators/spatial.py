"""Regions and networks: smoothed rates and Moran's I over a sparse table of neighbours ``(a, b, w)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from censorium.functions.special import norm_cdf


def smoothed_rates(regions: DataFrame, neighbours: DataFrame, *, region: str, observed: str, expected: str, share: float) -> DataFrame:
    """``(region, raw, smoothed)``: observed / expected, and its weighted mean with that of the neighbours (own weight 1 - share)."""
    raw = regions.select(F.col(region).alias("region"), F.when(F.col(expected) > 0, F.col(observed) / F.col(expected)).otherwise(F.lit(0.0)).alias("raw"))
    beside = neighbours.where("w > 0").join(raw.withColumnsRenamed({"region": "b", "raw": "_r"}), "b")
    sums = beside.groupBy(F.col("a").alias("region")).agg(F.sum(F.col("w") * F.col("_r")).alias("_s"), F.sum("w").alias("_w"))
    out = raw.join(sums, "region", "left").fillna(0.0, ["_s", "_w"])
    return out.select("region", "raw", F.try_divide((1 - share) * F.col("raw") + share * F.col("_s"), (1 - share) + share * F.col("_w")).alias("smoothed"))


def morans_i(regions: DataFrame, neighbours: DataFrame, *, region: str, value: str) -> DataFrame:
    """One row: Moran's I, its expectation, z with variance n^2 / (W^2 (n - 1)), and p."""
    rows = regions.where(F.col(value).isNotNull()).select(F.col(region).alias("region"), F.col(value).cast("double").alias("v"))
    mean = rows.agg(F.avg("v").alias("_m"), F.count("*").cast("double").alias("_n"))
    gap = rows.crossJoin(F.broadcast(mean)).select("region", (F.col("v") - F.col("_m")).alias("z"), "_n")  # one row
    a, b = gap.select(F.col("region").alias("a"), F.col("z").alias("_za")), gap.select(F.col("region").alias("b"), F.col("z").alias("_zb"))
    pairs = neighbours.join(a, "a").join(b, "b").agg(F.sum("w").alias("_w"), F.sum(F.col("w") * F.col("_za") * F.col("_zb")).alias("_num"))
    squares = gap.agg(F.sum(F.col("z") * F.col("z")).alias("_den"), F.max("_n").alias("_n"))
    both = pairs.crossJoin(F.broadcast(squares))  # one row each
    i = F.when((F.col("_den") > 0) & (F.col("_w") > 0), F.col("_n") / F.col("_w") * F.col("_num") / F.col("_den")).otherwise(F.lit(0.0))
    e = -1 / (F.col("_n") - 1)
    z = (i - e) / F.sqrt(F.col("_n") * F.col("_n") / (F.col("_w") * F.col("_w") * (F.col("_n") - 1)))
    return both.select(i.alias("i"), e.alias("expected"), z.alias("z"), (2 * norm_cdf(-F.abs(z))).alias("p"))


def neighbour_means(nodes: DataFrame, neighbours: DataFrame, *, node: str, value: str, name: str = "peers") -> DataFrame:
    """nodes with the weighted mean of their neighbours' value (null without any) and ``degree``, for use as covariates."""
    other = nodes.select(F.col(node).alias("b"), F.col(value).cast("double").alias("_v"))
    sums = neighbours.where("w > 0").join(other, "b").groupBy(F.col("a").alias(node)).agg((F.sum(F.col("w") * F.col("_v")) / F.sum("w")).alias(name), F.count("*").alias("degree"))
    return nodes.join(sums, node, "left").fillna(0, ["degree"])

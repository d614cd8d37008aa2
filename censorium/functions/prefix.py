"""Running sums and products over an order, without a window that sees all rows.

Rows are dealt to at most BINS ranges of the order; a window runs inside each (keys, range), and
what the ranges before hold comes from one aggregated row a range.  The cuts are the order
values with the smallest hashes, so every evaluation of a plan finds the same ones.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINS = 64


def number(df: DataFrame, name: str) -> Column:
    """A column to compare by size as a double: dates and timestamps as microseconds."""
    if isinstance(df.schema[name].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    return F.col(name).cast("double")


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", few: bool = False) -> DataFrame:
    """Equi-join in which null keys are equal; ``few``: right has a bounded number of rows and is broadcast."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    if few:
        other = F.broadcast(other)
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return (left.join(other, on, how) if keys else left.crossJoin(other)).drop(*(f"_r_{k}" for k in keys))


def _cuts(df: DataFrame, order: str, bins: int) -> DataFrame:
    values = df.select(F.col(order).alias("_v")).where("_v is not null").distinct()
    return values.orderBy(F.xxhash64("_v"), "_v").limit(bins - 1).agg(F.sort_array(F.collect_list("_v")).alias("_cuts"))


def cuts_of(df: DataFrame, order: str, bins: int = BINS) -> list[float]:
    """The cuts of ``binned`` as numbers, for iterations that use them again and again."""
    return [float(v) for v in _cuts(df, order, bins).first()["_cuts"]]


def binned(df: DataFrame, order: str, bins: int = BINS, cuts: Sequence[float] | None = None) -> DataFrame:
    """With ``_bin``: the range of the order value, ascending."""
    if cuts is not None:
        edges = F.array(*(F.lit(c) for c in cuts)).cast("array<double>")
        return df.withColumn("_bin", F.size(F.filter(edges, lambda c: c <= F.col(order))))
    beside = df.crossJoin(F.broadcast(_cuts(df, order, bins)))  # one row of at most BINS values
    return beside.withColumn("_bin", F.size(F.filter("_cuts", lambda c: c <= F.col(order)))).drop("_cuts")


def running(
    df: DataFrame, *, order: str, keys: Sequence[str] = (), sums: Mapping[str, Column] | None = None, products: Mapping[str, Column] | None = None, maxima: Mapping[str, Column] | None = None, reverse: bool = False, strict: bool = False, keep_bin: bool = False
) -> DataFrame:
    """df with the running ``sums``, ``products`` and ``maxima`` up to each row (``strict``: before it), by keys, from the last row on if ``reverse``.

    Each (keys, order) is one row.  A df that already has ``_bin`` keeps its ranges.
    """
    rows = df if "_bin" in df.columns else binned(df, order)
    down = (lambda c: F.desc(c)) if reverse else F.asc
    w = Window.partitionBy(*keys, "_bin").orderBy(down(order)).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    before = Window.partitionBy(*keys).orderBy(down("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    kinds = [(n, c, F.sum, 0.0) for n, c in (sums or {}).items()] + [(n, c, F.product, 1.0) for n, c in (products or {}).items()] + [(n, c, F.max, None) for n, c in (maxima or {}).items()]
    totals = rows.groupBy(*keys, "_bin").agg(*(f(c).alias(n) for n, c, f, _ in kinds))
    offsets = totals.select(*keys, "_bin", *(f(n).over(before).alias(f"_o_{n}") for n, _, f, _ in kinds))
    inner = rows.withColumns({n: f(c).over(w) for n, c, f, _ in kinds})
    both = join_keys(inner, offsets, [*keys, "_bin"], few=not keys)
    whole = {}
    for n, _, f, zero in kinds:
        if zero is None:
            whole[n] = F.greatest(n, f"_o_{n}")
        else:
            x, o = F.coalesce(F.col(n), F.lit(zero)), F.coalesce(F.col(f"_o_{n}"), F.lit(zero))
            whole[n] = x * o if f is F.product else x + o
    out = both.withColumns(whole).drop(*(f"_o_{n}" for n, *_ in kinds))
    return out if keep_bin else out.drop("_bin")


def as_of(requests: DataFrame, steps: DataFrame, *, at: str, step: str, values: Sequence[str], keys: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """requests with the ``values`` of the last row of ``steps`` with step <= at (``strict``: step < at), by keys; null before the first.

    One union and one running maximum of (step, values): no range join.
    """
    kept = F.struct(number(steps, step).alias("_as_of"), *(F.col(v) for v in values))
    a = steps.select(*keys, number(steps, step).alias("_as_of"), F.lit(1 if strict else 0).alias("_side"), kept.alias("_kept"))
    wanted = requests.select(*keys, number(requests, at).alias("_as_of")).distinct().withColumn("_side", F.lit(0 if strict else 1)).withColumn("_kept", F.lit(None).cast(a.schema["_kept"].dataType))
    line = a.groupBy(*keys, "_as_of", "_side").agg(F.max("_kept").alias("_kept")).unionByName(wanted).withColumn("_place", F.struct("_as_of", "_side"))
    rows = binned(line, "_as_of")
    w = Window.partitionBy(*keys, "_bin").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*keys, "_bin").agg(F.max("_kept").alias("_top")).select(*keys, "_bin", F.max("_top").over(before).alias("_top"))
    found = join_keys(rows.withColumn("_found", F.max("_kept").over(w)), offsets, [*keys, "_bin"], few=not keys).where(F.col("_side") == (0 if strict else 1))
    looked = found.select(*keys, "_as_of", F.coalesce("_found", "_top").alias("_found"))
    asked = requests.withColumn("_as_of", number(requests, at))
    return join_keys(asked, looked.select(*keys, "_as_of", *(F.col(f"_found.{v}").alias(v) for v in values)), [*keys, "_as_of"], "left").drop("_as_of")

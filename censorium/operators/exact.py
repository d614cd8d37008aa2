"""Exact partial likelihood of tied event times, and conditional logistic regression.

The likelihood of d events at a time is exp(sum of their predictors) over the elementary symmetric polynomial of degree d of
exp(predictor) in the risk set.  A row is at risk over a range of event times.  Each range is cut into nodes of a binary
tree over the event times of the stratum, at most two a level, and the polynomial of an event time is the
product of those of its ancestors: no risk set is ever built.  Rows of one node that are equal are one
row with a count; large nodes are split and multiplied afterwards.  Only sums over event times reach the driver.

A polynomial takes work and space that grow with the square and the number of ties.  Strata of many ties and few different
rows a risk set have no polynomials: rows are added up to what the risk set gains and loses of each different row at each
event time, and the one coefficient that an event time needs is a sum over some points of a circle, whatever its degree.

Sets without times have one polynomial each: sets are dealt to groups of bounded size, whose number grows with the rows, by
one shuffle, and each group is summed at once.  Only sets too large for a group are cut into parts as nodes are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from censorium.functions.lineage import cut
from censorium.functions.prefix import as_of, running
from censorium.functions.symmetric import MOST_CELLS, Choices, chosen, copies, product
from censorium.operators.cox import CoxFit

#: Different rows of a node that are multiplied in one group, rows of a task, and tree levels whose event times meet in one task.
NODE_ROWS, TASK_ROWS, BLOCK_LEVELS = 4_096, 20_000, 8
#: Groups of whole sets: rows of one at most, and groups of a partition on average.
SET_ROWS, GROUPS = 80_000, 8
#: Ties from which a stratum may go without polynomials: its different rows then, changes of the risk set of a block, and event times of one.
TIES, DIFFERENT_ROWS, BLOCK_ROWS, BLOCK_TIMES = 8, 100_000, 200_000, 256
#: Cases of a set from which it goes without a polynomial.
SET_TIES = 32
#: Work for a different row of a risk set against that for a row, a level of the tree and a tie; different rows that an event time counts as besides its own.
POINTS, EACH_TIME = 3, 100
POLY = "_s string, level int, idx long, need int, log array<double>, mean array<double>, cov array<double>"


def _pieces(lo: Column, hi: Column) -> Column:
    """Tree nodes (level, idx) that make up the places lo .. hi - 1: at level l, node idx holds 2^l of them."""
    levels = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(hi, F.lit(1)) + 1)).cast("int"))

    def at(level: Column) -> Column:
        width = F.pow(F.lit(2.0), level).cast("long")
        a, b = F.floor((lo + width - 1) / width), F.floor(hi / width)
        node = lambda idx, there: F.when((a < b) & there, F.struct(level.cast("int").alias("level"), idx.cast("long").alias("idx")))
        return F.array(node(a, a % 2 == 1), node(b - 1, b % 2 == 1))

    return F.filter(F.flatten(F.transform(levels, at)), lambda n: n.isNotNull())


class _Prepared:
    """Rows by tree node and event times by block, in the form that every step reads."""

    def __init__(self, rows: DataFrame, times: DataFrame, p: int):
        """rows: (_s, lo, hi, x, off), times: (_s, place, d, xsum, osum)."""
        spark = rows.sparkSession
        top = times.agg(F.max("place")).first()[0] or 0
        levels = F.sequence(F.lit(0), F.lit(int(top).bit_length()))
        above = times.select("_s", "d", F.explode(F.transform(levels, lambda k: F.struct(k.cast("int").alias("level"), F.floor(F.col("place") / F.pow(F.lit(2.0), k)).cast("long").alias("idx")))).alias("n")).select("_s", "n.level", "n.idx", "d")
        needs = above.groupBy("_s", "level", "idx").agg(F.max("d").cast("int").alias("need"))
        cells = rows.select("_s", F.explode(_pieces(F.col("lo"), F.col("hi"))).alias("n"), "x", "off").groupBy("_s", "n.level", "n.idx", "x", "off").agg(F.count("*").alias("n"))
        sizes = cells.groupBy("_s", "level", "idx").agg(F.ceil(F.count("*") / NODE_ROWS).cast("int").alias("_parts"))
        keyed = cells.join(needs.join(sizes, ["_s", "level", "idx"]), ["_s", "level", "idx"])
        self.cells = keyed.withColumn("_part", F.pmod(F.xxhash64("x", "off"), F.col("_parts")).cast("int")).persist()
        self.times = times.withColumn("_block", F.floor(F.col("place") / 2**BLOCK_LEVELS)).persist()
        n, most = self.cells.agg(F.count("*"), F.max("_parts")).first()
        self.tasks, self.split, self.p, self.spark = max(1, -(-n // TASK_ROWS)), (most or 1) > 1, p, spark

    def close(self) -> None:
        self.cells.unpersist()
        self.times.unpersist()

    def middle(self) -> list[float]:
        """Means of the covariates and of the offset over different rows."""
        return [v or 0.0 for v in self.cells.agg(*(F.avg(F.col("x")[i]) for i in range(self.p)), F.avg("off")).first()]

    def polynomials(self, beta: np.ndarray, shift: float) -> DataFrame:
        p, b = self.p, [float(v) for v in beta]

        def fresh(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["_s", "level", "idx", "_part"], kind="stable")
            x = np.array(rows["x"].tolist(), dtype=float).reshape(len(rows), p)
            lp = x @ np.array(b) + rows["off"].to_numpy() - shift
            return _reduced(rows, ["_s", "level", "idx", "_part"], lambda at, most: copies(lp[at], x[at], rows["n"].to_numpy()[at], most))

        made = self.cells.groupBy(F.pmod(F.xxhash64("_s", "level", "idx", "_part"), F.lit(self.tasks)).alias("_task")).applyInPandas(fresh, POLY)
        if not self.split:
            return made
        again = lambda rows: _again(rows.sort_values(["_s", "level", "idx"], kind="stable"), p)
        return made.groupBy(F.pmod(F.xxhash64("_s", "level", "idx"), F.lit(self.tasks)).alias("_task")).applyInPandas(again, POLY)

    def step(self, beta: np.ndarray, shift: float) -> tuple[float, np.ndarray, np.ndarray]:
        """Log likelihood, score and information."""
        p, b = self.p, np.asarray(beta, dtype=float)
        low, high = F.col("idx"), F.col("level") - BLOCK_LEVELS
        width = F.pow(F.lit(2.0), F.greatest(high, F.lit(0))).cast("long")
        own = F.floor(low / F.pow(F.lit(2.0), -high)).cast("long")
        blocks = F.when(high > 0, F.sequence(low * width, (low + 1) * width - 1)).otherwise(F.array(own))
        polys = self.polynomials(b, shift).withColumn("_block", F.explode(blocks))
        task = F.pmod(F.xxhash64("_s", "_block"), F.lit(self.tasks)).alias("_task")
        out = _totals(p)

        def at_times(times: pd.DataFrame, polys: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros(1 + p + p * p)
            for at, made in _of_times(times, polys, p):
                rows = times.iloc[at]
                d, x = rows["d"].to_numpy(), np.array(rows["xsum"].tolist(), dtype=float).reshape(len(rows), p)
                i = np.arange(len(rows))
                total[0] += (x @ b + rows["osum"].to_numpy() - d * shift - made.log[i, d]).sum()
                total[1 : 1 + p] += (x - made.mean[i, d]).sum(axis=0)
                total[1 + p :] += made.cov[i, d].sum(axis=0).ravel()
            return pd.DataFrame([total], columns=out.fieldNames())

        parts = self.times.groupBy(task).cogroup(polys.groupBy(task)).applyInPandas(at_times, out)
        return _summed(parts, p)


class _Tied:
    """Changes of the risk sets and event times, by blocks of event times, of strata with many ties."""

    def __init__(self, changes: DataFrame, times: DataFrame, widths: DataFrame, p: int):
        """changes: (_s, place, x0.., _off, n), times: (_s, place, d, xsum, osum), widths: (_s, _width), event times of a block of the stratum."""
        self.p, self.spark = p, changes.sparkSession
        self.row = [*(f"x{i}" for i in range(p)), "_off"]
        block = F.floor(F.col("place") / F.col("_width"))
        self.times = times.join(widths, "_s").withColumn("_block", block).drop("_width").persist()
        moved = changes.join(widths, "_s").withColumn("_block", block).persist()
        n, blocks = self.times.agg(F.count("*"), F.max("_block")).first()
        self.changes, self.inputs = moved.drop("_width"), [self.times, moved]
        if blocks:  # what the blocks before leave is there from the start
            of = ["_s", *self.row]
            w = Window.partitionBy(*of).orderBy("_block")
            left = moved.groupBy(*of, "_block", "_width").agg(F.sum("n").alias("n")).select(*of, "_width", "_block", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("n"), F.lead("_block").over(w).alias("_next"))
            start = left.where("n != 0 and _next is not null").withColumn("_block", F.explode(F.sequence(F.col("_block") + 1, F.col("_next")))).withColumn("place", F.col("_block") * F.col("_width"))
            self.changes = self.changes.unionByName(start.drop("_width", "_next")).persist()
            self.inputs.append(self.changes)
        self.tasks = max(1, -(-self.changes.count() // TASK_ROWS), -(-n // BLOCK_TIMES))

    def close(self) -> None:
        for df in self.inputs:
            df.unpersist()

    def middle(self) -> list[float]:
        """Means of the covariates and of the offset over different rows."""
        return [v or 0.0 for v in self.changes.agg(*(F.avg(c) for c in self.row)).first()]

    def step(self, beta: np.ndarray, shift: float) -> tuple[float, np.ndarray, np.ndarray]:
        """Log likelihood, score and information."""
        row, b = self.row, np.asarray(beta, dtype=float)
        task = F.pmod(F.xxhash64("_s", "_block"), F.lit(self.tasks)).alias("_task")
        out = _totals(self.p)

        def at_times(times: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([_of_changes(times, changes, row, b, shift)], columns=out.fieldNames())

        return _summed(self.times.groupBy(task).cogroup(self.changes.groupBy(task)).applyInPandas(at_times, out), self.p)


def _of_changes(times: pd.DataFrame, changes: pd.DataFrame, row: list[str], beta: np.ndarray, shift: float) -> np.ndarray:
    """Sums of a step over event times, whose risk sets have what was gained up to them and not lost."""
    p = len(beta)
    total = np.zeros(1 + p + p * p)
    changed = {k: v.sort_values("place", kind="stable") for k, v in changes.groupby(["_s", "_block"], sort=False)}
    for k, at in times.groupby(["_s", "_block"], sort=False):
        here, at = changed[k], at.sort_values("place", kind="stable")
        # the same row is one, whenever it comes or goes
        cells, which = np.unique(here[row].to_numpy(dtype=float), axis=0, return_inverse=True)
        x, lp = cells[:, :p], cells[:, :p] @ beta + cells[:, p] - shift
        which, n, d = which.ravel(), here["n"].to_numpy(), at["d"].to_numpy()
        ends = np.searchsorted(here["place"].to_numpy(), at["place"].to_numpy(), side="right")
        count = np.zeros(len(cells), dtype=np.int64)
        for i, (first, end) in enumerate(zip(np.concatenate(([0], ends[:-1])), ends, strict=True)):
            np.add.at(count, which[first:end], n[first:end])
            some = np.flatnonzero(count)
            log, mean, cov = chosen(lp[some], x[some], count[some], int(d[i]))
            total[0] -= log
            total[1 : 1 + p] -= mean
            total[1 + p :] += cov.ravel()
        xsum = np.array(at["xsum"].tolist(), dtype=float).reshape(len(at), p)
        total[0] += (xsum @ beta + at["osum"].to_numpy() - d * shift).sum()
        total[1 : 1 + p] += xsum.sum(axis=0)
    return total


class _Both:
    """Strata with and without polynomials."""

    def __init__(self, parts: list[_Prepared | _Tied]):
        self.parts, self.spark = parts, parts[0].spark

    def close(self) -> None:
        for part in self.parts:
            part.close()

    def middle(self) -> list[float]:
        return self.parts[0].middle()

    def step(self, beta: np.ndarray, shift: float) -> tuple[float, np.ndarray, np.ndarray]:
        """Log likelihood, score and information."""
        return tuple(sum(v) for v in zip(*(part.step(beta, shift) for part in self.parts), strict=True))


class _Sets:
    """Rows of sets by group; sets in groups that are too large have tree nodes, one each."""

    def __init__(self, rows: DataFrame, p: int, keep: bool):
        """rows: (_s, _case, _x, _off); ``keep``: for more than one step."""
        self.p, self.spark, self.keep = p, rows.sparkSession, keep
        n = rows.count()
        groups = max(1, -(-n // TASK_ROWS))
        rows = rows.withColumn("_group", F.pmod(F.xxhash64("_s"), F.lit(groups)).cast("int"))
        self.large = None
        if n > SET_ROWS:
            large = cut(rows.groupBy("_group").count().where(F.col("count") > SET_ROWS).select("_group"), "large-groups")
            if not large.isEmpty():
                self.large = _of_large_sets(rows.join(F.broadcast(large), "_group", "left_semi"), p)
                rows = rows.join(F.broadcast(large), "_group", "left_anti")
        self.rows = rows.select("_group", "_s", "_case", *(F.col("_x")[i].alias(f"x{i}") for i in range(p)), "_off").repartition(-(-groups // GROUPS), "_group")
        if keep:
            self.rows = self.rows.persist()

    def close(self) -> None:
        if self.keep:
            self.rows.unpersist()
        if self.large:
            self.large.close()

    def middle(self) -> list[float]:
        got = self.rows.agg(*(F.avg(f"x{i}") for i in range(self.p)), F.avg("_off"), F.count("*")).first()
        return self.large.middle() if self.large and not got[-1] else [v or 0.0 for v in got[:-1]]

    def step(self, beta: np.ndarray, shift: float) -> tuple[float, np.ndarray, np.ndarray]:
        """Log likelihood, score and information."""
        p, b = self.p, np.asarray(beta, dtype=float)
        out = _totals(p)

        def of_group(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([_of_whole_sets(rows, b, shift)], columns=out.fieldNames())

        got = _summed(self.rows.groupBy("_group").applyInPandas(of_group, out), p)
        more = self.large.step(b, shift) if self.large else ()
        return tuple(u + v for u, v in zip(got, more, strict=True)) if more else got


def _of_whole_sets(rows: pd.DataFrame, beta: np.ndarray, shift: float) -> np.ndarray:
    """Sums of a step over the sets that these rows make up."""
    p = len(beta)
    total = np.zeros(1 + p + p * p)
    names = pd.factorize(rows["_s"])[0]
    cases = np.bincount(names, weights=rows["_case"].to_numpy()).astype(int)
    order = np.argsort(names, kind="stable")
    order = order[cases[names[order]] > 0]  # a set without a case says nothing
    x = rows[[f"x{i}" for i in range(p)]].to_numpy(dtype=float).reshape(len(rows), p)[order]
    lp, case, names = x @ beta + rows["_off"].to_numpy(dtype=float)[order] - shift, rows["_case"].to_numpy()[order] != 0, names[order]
    total[0], total[1 : 1 + p] = lp[case].sum(), x[case].sum(axis=0)
    tied = np.flatnonzero(cases[names] >= SET_TIES)
    for at in np.split(tied, np.flatnonzero(np.diff(names[tied])) + 1) if len(tied) else []:
        log, mean, cov = chosen(lp[at], x[at], np.ones(len(at), dtype=int), int(cases[names[at[0]]]))
        total[0] -= log
        total[1 : 1 + p] -= mean
        total[1 + p :] += cov.ravel()
    few = np.flatnonzero(cases[names] < SET_TIES)
    x, lp, names = x[few], lp[few], names[few]
    for at, most in _classes(cases[names]):
        own = names[at]
        made = product(own, copies(lp[at], x[at], np.ones(len(at), dtype=int), most), most)
        d = cases[own[np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))]]
        i = np.arange(len(d))
        total[0] -= made.log[i, d].sum()
        total[1 : 1 + p] -= made.mean[i, d].sum(axis=0)
        total[1 + p :] += made.cov[i, d].sum(axis=0).ravel()
    return total


def _totals(p: int) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in ("ll", *(f"u{i}" for i in range(p)), *(f"i{i}_{j}" for i in range(p) for j in range(p)))])


def _summed(parts: DataFrame, p: int) -> tuple[float, np.ndarray, np.ndarray]:
    got = parts.agg(*(F.sum(n).alias(n) for n in _totals(p).fieldNames())).first()
    v = np.array([x or 0.0 for x in got])
    return float(v[0]), v[1 : 1 + p], v[1 + p :].reshape(p, p)


def _classes(need: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Places of like need, rounded up to powers of two, so that little is padded."""
    power = np.ceil(np.log2(np.maximum(need, 1))).astype(int)
    for k in np.unique(power):
        at = np.flatnonzero(power == k)
        yield at, int(need[at].max())


def _reduced(rows: pd.DataFrame, keys: list[str], make) -> pd.DataFrame:
    """One polynomial a group of rows, which are sorted by ``keys``."""
    group = rows.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
    out = []
    for at, most in _classes(rows["need"].to_numpy()):
        made = product(group[at], make(at, most), most)
        first = at[np.flatnonzero(np.concatenate(([True], group[at][1:] != group[at][:-1])))]
        named = rows.iloc[first][["_s", "level", "idx", "need"]].reset_index(drop=True)
        out.append(named.assign(log=list(made.log), mean=list(made.mean.reshape(len(first), -1)), cov=list(made.cov.reshape(len(first), -1))))
    return pd.concat(out) if out else pd.DataFrame(columns=["_s", "level", "idx", "need", "log", "mean", "cov"])


def _read(rows: pd.DataFrame, most: int, p: int) -> Choices:
    n = len(rows)
    out = Choices(np.full((n, most + 1), -np.inf), np.zeros((n, most + 1, p)), np.zeros((n, most + 1, p, p)))
    for i, (log, mean, cov) in enumerate(zip(rows["log"], rows["mean"], rows["cov"], strict=True)):
        k = min(len(log), most + 1)
        out.log[i, :k], out.mean[i, :k], out.cov[i, :k] = log[:k], np.reshape(mean, (-1, p))[:k], np.reshape(cov, (-1, p, p))[:k]
    return out


def _again(rows: pd.DataFrame, p: int) -> pd.DataFrame:
    return _reduced(rows, ["_s", "level", "idx"], lambda at, most: _read(rows.iloc[at], most, p))


def _of_times(times: pd.DataFrame, polys: pd.DataFrame, p: int) -> Iterator[tuple[np.ndarray, Choices]]:
    """Polynomials of the risk sets of event times, in bounded portions of places in ``times``."""
    # a task has several blocks, each with its own copy of a node above them
    polys = polys.drop_duplicates(["_s", "level", "idx"]).reset_index(drop=True)
    where = pd.DataFrame({"_s": polys["_s"], "level": polys["level"], "idx": polys["idx"], "poly": np.arange(len(polys))})
    levels = sorted(polys["level"].unique())
    for at, most in _classes(times["d"].to_numpy()):
        portion = max(1, MOST_CELLS // ((most + 1) * (1 + p + p * p) * max(len(levels), 1)))
        for i in range(0, len(at), portion):
            some = at[i : i + portion]
            asked = pd.concat([pd.DataFrame({"time": np.arange(len(some)), "_s": times["_s"].to_numpy()[some], "level": k, "idx": times["place"].to_numpy()[some] >> k}) for k in levels])
            met = asked.merge(where, on=["_s", "level", "idx"]).sort_values("time", kind="stable")
            yield some, product(met["time"].to_numpy(), _read(polys.iloc[met["poly"].to_numpy()], most, p), most)


def _kept(df: DataFrame, x: Sequence[str], strata: Sequence[str], offset: str | None, others: Sequence[str]) -> DataFrame:
    rows = df.dropna(subset=[*x, *others])
    off = F.coalesce(F.col(offset).cast("double"), F.lit(0.0)) if offset else F.lit(0.0)
    return rows.withColumns({"_x": F.array(*(F.col(c).cast("double") for c in x)), "_off": off, "_s": F.to_json(F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(strata)))) if strata else F.lit("")})


def _event_sums(events: DataFrame, keys: Sequence[str], p: int) -> DataFrame:
    return events.groupBy(*keys).agg(F.count("*").cast("int").alias("d"), F.array(*(F.sum(F.col("_x")[i]) for i in range(p))).alias("xsum"), F.sum("_off").alias("osum"))


def _of_sets(df: DataFrame, case: str, x: Sequence[str], strata: Sequence[str], offset: str | None, keep: bool) -> _Sets:
    rows = _kept(df, x, strata, offset, [case])
    return _Sets(rows.select("_s", (F.col(case) != 0).cast("int").alias("_case"), "_x", "_off"), len(x), keep)


def _tied(rows: DataFrame, sums: DataFrame, p: int) -> DataFrame | None:
    """(_s, _width) of the strata that take less work without polynomials; rows: (_s, _x, _off), sums: (_s, d) by event time."""
    many = sums.groupBy("_s").agg(F.count("*").alias("_times"), F.max("d").alias("_d")).where(F.col("_d") >= TIES)
    many = cut(many, "tied-strata")
    if many.isEmpty():
        return None
    # a count to within some per cent: results don't depend on it
    seen = rows.join(many.select("_s"), "_s", "left_semi").groupBy("_s").agg(F.count("*").alias("_n"), F.approx_count_distinct(F.xxhash64("_x", "_off")).alias("_rows"))
    without = F.col("_times") * (F.col("_rows") + EACH_TIME) * POINTS <= F.col("_n") * F.log2(F.col("_times") + 1) * F.col("_d")
    width = F.greatest(F.lit(1), F.least(F.lit(BLOCK_TIMES), F.floor(BLOCK_ROWS / F.greatest("_rows", F.lit(1)))))
    found = cut(many.join(seen, "_s").where(without & (F.col("_rows") <= DIFFERENT_ROWS)).select("_s", width.cast("long").alias("_width")), "strata-without-polynomials")
    return None if found.isEmpty() else found


def _columns(p: int) -> list[Column]:
    return [*(F.col("_x")[i].alias(f"x{i}") for i in range(p)), F.col("_off")]


def _joined(rows: DataFrame, sums: DataFrame, p: int, tied, prepared) -> _Prepared | _Tied | _Both:
    """Strata of many ties by ``tied(rows, sums, widths)``, the others by ``prepared(rows, sums)``."""
    widths = _tied(rows, sums, p)
    if not widths:
        return prepared(rows, sums)
    there = widths.select("_s")
    parts, others = [tied(rows.join(there, "_s", "left_semi"), sums.join(there, "_s", "left_semi"), widths)], sums.join(there, "_s", "left_anti")
    if not others.isEmpty():
        parts.append(prepared(rows.join(there, "_s", "left_anti"), others))
    return _Both(parts) if len(parts) > 1 else parts[0]


def _of_large_sets(rows: DataFrame, p: int) -> _Prepared | _Tied | _Both:
    sums = cut(_event_sums(rows.where("_case != 0"), ["_s"], p).withColumn("place", F.lit(0).cast("long")), "event-times")

    def tied(rows: DataFrame, times: DataFrame, widths: DataFrame) -> _Tied:
        changes = rows.select("_s", *_columns(p)).groupBy("_s", *(f"x{i}" for i in range(p)), "_off").agg(F.count("*").alias("n"))
        return _Tied(changes.withColumn("place", F.lit(0).cast("long")), times, widths, p)

    def prepared(rows: DataFrame, times: DataFrame) -> _Prepared:
        met = rows.join(times.select("_s"), "_s", "left_semi")
        return _Prepared(met.select("_s", F.lit(0).cast("long").alias("lo"), F.lit(1).cast("long").alias("hi"), F.col("_x").alias("x"), F.col("_off").alias("off")), times, p)

    return _joined(rows, sums, p, tied, prepared)


def _of_survival(df: DataFrame, time: str, status: str, x: Sequence[str], strata: Sequence[str], entry: str | None, offset: str | None) -> _Prepared | _Tied | _Both:
    p = len(x)
    rows = _kept(df, x, strata, offset, [time, status]).withColumn("_t", F.col(time).cast("double"))
    if entry:
        rows = rows.where(F.col(entry).isNull() | (F.col(entry) < F.col(time)))
    sums = cut(_event_sums(rows.where(F.col(status) != 0), ["_s", "_t"], p).withColumn("_one", F.lit(1.0)), "events")
    never = F.lit(float("-inf"))
    rows = rows.select("_s", "_t", "_x", "_off", (F.coalesce(F.col(entry).cast("double"), never) if entry else never).alias("_e"))

    def ranked(sums: DataFrame) -> tuple[DataFrame, DataFrame]:
        # event times are read by each lookup and by each step
        times = cut(running(sums, order="_t", keys=["_s"], sums={"_rank": F.col("_one")}), "event-times")
        return times.select("_s", (F.col("_rank") - 1).cast("long").alias("place"), "d", "xsum", "osum"), times.select("_s", F.col("_t").alias("_at"), "_rank")

    def placed(rows: DataFrame, steps: DataFrame, at: str, name: str) -> DataFrame:
        return as_of(rows, steps, at=at, step="_at", values=["_rank"], keys=["_s"]).withColumn(name, F.coalesce("_rank", F.lit(0.0)).cast("long")).drop("_rank")

    def tied(rows: DataFrame, sums: DataFrame, widths: DataFrame) -> _Tied:
        times, steps = ranked(sums)
        of = [*(f"x{i}" for i in range(p)), "_off"]
        # a row comes after its entry and goes after its time; rows that are alike are one before places are looked up
        moves = F.explode(F.array(*(F.struct(F.col(c).alias("_v"), F.lit(n).cast("long").alias("n")) for c, n in (("_e", 1), ("_t", -1)))))
        moves = rows.select("_s", *_columns(p), moves.alias("_m")).select("_s", *of, "_m._v", "_m.n").groupBy("_s", "_v", *of).agg(F.sum("n").alias("n")).where("n != 0")
        changes = placed(cut(moves, "moves"), steps, "_v", "place").groupBy("_s", "place", *of).agg(F.sum("n").alias("n")).where("n != 0")
        return _Tied(changes, times, widths, p)

    def prepared(rows: DataFrame, sums: DataFrame) -> _Prepared:
        times, steps = ranked(sums)
        asked = placed(rows if entry else rows.drop("_e"), steps, "_t", "hi")
        asked = placed(cut(asked, "ranges"), steps, "_e", "lo") if entry else asked.withColumn("lo", F.lit(0).cast("long"))
        return _Prepared(asked.where("lo < hi").select("_s", "lo", "hi", F.col("_x").alias("x"), F.col("_off").alias("off")), times, p)

    return _joined(rows, sums, p, tied, prepared)


def _fit(ready: _Prepared | _Tied | _Both | _Sets, x: Sequence[str], start: Sequence[float] | None, eps: float, most: int) -> CoxFit:
    p = len(x)
    *means, off = ready.middle()
    means = np.array(means)
    step = lambda b: ready.step(b, float(means @ b + off))
    try:
        beta = np.zeros(p) if start is None else np.asarray(start, dtype=float)
        ll, score, info = step(beta)
        null, first, n = ll, float(score @ np.linalg.pinv(info) @ score), 0
        for n in range(1, most + 1):
            move = np.linalg.pinv(info, rcond=1e-12, hermitian=True) @ score
            found = step(beta + move)
            while found[0] < ll - abs(ll) * eps and np.abs(move).max() > eps:
                move /= 2
                found = step(beta + move)
            done = abs(found[0] - ll) <= eps * max(1.0, abs(found[0]))
            beta, (ll, score, info) = beta + move, found
            if done:
                break
        return CoxFit(beta, np.linalg.pinv(info, rcond=1e-12, hermitian=True), ll, n, null, first, list(x), "exact")
    finally:
        ready.close()


def exact_fit(df: DataFrame, *, time: str, status: str, x: Sequence[str], strata: Sequence[str] = (), entry: str | None = None, offset: str | None = None, start: Sequence[float] | None = None, eps: float = 1e-9, most: int = 20) -> CoxFit:
    """Proportional hazards with the exact partial likelihood of ties, for right-censored or (entry, time] rows, by strata.

    Rows with a null time, status or covariate, or with entry >= time, take no part; a null entry is before all times, a null stratum is
    a stratum.  An empty table has the log likelihood 0.  Weights have no exact likelihood and aren't taken.
    """
    return _fit(_of_survival(df, time, status, x, strata, entry, offset), x, start, eps, most)


def exact_likelihood(df: DataFrame, *, time: str, status: str, x: Sequence[str], coefficients: Sequence[float], strata: Sequence[str] = (), entry: str | None = None, offset: str | None = None) -> DataFrame:
    """One row: exact ``log_likelihood`` at given coefficients, ``score_<x>`` and ``info_<x>`` (the diagonal of the information)."""
    return _one_row(_of_survival(df, time, status, x, strata, entry, offset), x, coefficients)


def conditional_logistic(df: DataFrame, *, case: str, x: Sequence[str], strata: Sequence[str], offset: str | None = None, start: Sequence[float] | None = None, eps: float = 1e-9, most: int = 20) -> CoxFit:
    """Logistic regression given the number of cases of each stratum (matched sets of any size); ``hazard_ratio`` of its table is the odds ratio.

    Rows with a null case or covariate take no part; null strata are a stratum.  Sets without a case, or of cases only, say nothing.
    """
    return _fit(_of_sets(df, case, x, strata, offset, keep=True), x, start, eps, most)


def conditional_likelihood(df: DataFrame, *, case: str, x: Sequence[str], coefficients: Sequence[float], strata: Sequence[str], offset: str | None = None) -> DataFrame:
    """One row: the conditional ``log_likelihood`` at given coefficients, ``score_<x>`` and ``info_<x>``."""
    return _one_row(_of_sets(df, case, x, strata, offset, keep=False), x, coefficients)


def _one_row(ready: _Prepared | _Tied | _Both | _Sets, x: Sequence[str], coefficients: Sequence[float]) -> DataFrame:
    try:
        ll, score, info = ready.step(np.asarray(coefficients, dtype=float), 0.0)
    finally:
        ready.close()
    names = ["log_likelihood", *(f"score_{c}" for c in x), *(f"info_{c}" for c in x)]
    return ready.spark.createDataFrame([(ll, *map(float, score), *map(float, np.diag(info)))], ", ".join(f"`{n}` double" for n in names))

"""Queries on change points, and their SQL: dynamic programming over lists, and best splits, by recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from censorium.operators import changes


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderdate", "o_totalprice")
    return rows.groupBy(F.date_trunc("day", "o_orderdate").alias("day")).agg(F.count("*").alias("n"), (F.avg("o_totalprice") / 100000).alias("price"))


def order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of the daily number of orders."""
    got = changes.change_points(_days(spark, sf_dir), order="day", value="n", cost="poisson", penalty=7.0, least=7)
    return got.select("at", *(F.round(c, 6).alias(c) for c in ("before", "after")))


def price_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of equal mean and spread of the mean price by day."""
    got = changes.segments(_days(spark, sf_dir), order="day", value="price", cost="normal", penalty=8.0, least=5)
    return got.select("segment", "start", "stop", "n", *(F.round(c, 6).alias(c) for c in ("mean", "cost")))


def discount_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of the mean discount along quantity, by return flag and line status."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_linestatus", "l_quantity", (F.col("l_discount") * 1000).alias("v"))
    got = changes.change_points(rows, order="l_quantity", value="v", keys=["l_returnflag", "l_linestatus"], penalty=6.0, least=2)
    return got.select("l_returnflag", "l_linestatus", "at", *(F.round(c, 6).alias(c) for c in ("before", "after")))


def order_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily number of orders, split at its best points one after another."""
    got = changes.segments(_days(spark, sf_dir), order="day", value="n", penalty=22.0, least=7, method="splits")
    return got.select("segment", "start", "stop", "n", *(F.round(c, 6).alias(c) for c in ("mean", "cost")))


#: Cost of points lo + 1 to hi from lists of running sums, which begin with 0.
_LISTS = {
    "l2": "greatest(sb[{hi} + 1] - sb[{lo} + 1] - (sa[{hi} + 1] - sa[{lo} + 1]) ** 2 / ({hi} - {lo}), 0)",
    "poisson": "-2 * (sa[{hi} + 1] - sa[{lo} + 1]) * ln((sa[{hi} + 1] - sa[{lo} + 1]) / ({hi} - {lo}))",
    "normal": "({hi} - {lo}) * (1 + ln(greatest(sb[{hi} + 1] - sb[{lo} + 1] - (sa[{hi} + 1] - sa[{lo} + 1]) ** 2 / ({hi} - {lo}), 0) / ({hi} - {lo})))",
}
_DAYS = "v as (select '' as k, date_trunc('day', o_orderdate)::timestamp as pt, count(*)::double as n, avg(o_totalprice) / 100000 as price from orders where o_orderdate is not null group by 2)"


def _pruned(source: str, value: str, cost: str, penalty: float, least: int) -> str:
    """CTEs up to ``g``: points with the number of their segment."""
    middle = "0" if cost == "poisson" else f"avg({value}) over (partition by k)"
    total = f"best[s + 1] + {_LISTS[cost].format(lo='s', hi='(t + 1)')}"
    return f"""with recursive {source}, x as (select k, pt, {value} as v, {value} - {middle} as x, row_number() over (partition by k order by pt) as i from v where {value} is not null),
        c as (select *, sum(x) over w as a, sum(x * x) over w as b from x window w as (partition by k order by i)),
        q as (select k, max(i) as n, [0.0] || list(a order by i) as sa, [0.0] || list(b order by i) as sb from c group by k),
        dp as (select k, n, sa, sb, 0::bigint as t, [{-float(penalty)}]::double[] as best, [-1]::bigint[] as prev from q union all
            select k, n, sa, sb, t + 1, list_append(best, case when len(f) > 0 then list_min(f) + {float(penalty)} else 'inf'::double end), list_append(prev, case when len(f) > 0 then list_position(f, list_min(f)) - 1 else -1 end)
            from (select *, list_transform(range(0, t + 2 - {least}), lambda s: {total}) as f from dp where t < n)),
        e as (select k, prev, n from dp where t = n), bt as (select k, prev, prev[n + 1] as t from e union all select k, prev, prev[t + 1] from bt where t > 0),
        g as (select c.*, (select count(*) from bt where bt.k = c.k and bt.t > 0 and bt.t < c.i) as segment from c)"""


_SEGMENTS = "select segment, min(pt) as start, max(pt) as stop, count(*) as n, round(avg(v), 6) as mean, round({cost}, 6) as cost from g group by segment"
_CHANGES = 'm as (select k, segment, min(pt) as pt, avg(v) as mean from g group by k, segment) select {keys}a.pt as "at", round(b.mean, 6) as before, round(a.mean, 6) as after from m a join m b on a.k = b.k and a.segment = b.segment + 1'

SQL = {
    "order_changes": f"{_pruned(_DAYS, 'n', 'poisson', 7, 7)}, {_CHANGES.format(keys='')}",
    "price_segments": f"{_pruned(_DAYS, 'price', 'normal', 8, 5)} {_SEGMENTS.format(cost='count(*) * (1 + ln(var_pop(v)))')}",
    "discount_changes": f"{_pruned('''v as (select l_returnflag || '|' || l_linestatus as k, l_quantity as pt, avg(l_discount * 1000) as n from lineitem group by 1, 2)''', 'n', 'l2', 6, 2)}, {_CHANGES.format(keys='''split_part(a.k, '|', 1) as l_returnflag, split_part(a.k, '|', 2) as l_linestatus, ''')}",
    "order_splits": f"""with recursive {_DAYS}, x as (select pt, n as v, n - avg(n) over () as x, row_number() over (order by pt) as i from v), c as (select pt, v, i, sum(x) over (order by i) as a, sum(x * x) over (order by i) as b from x),
        z as (select 0::bigint as i, 0.0::double as a, 0.0::double as b union all select i, a, b from c),
        s as (select 0::bigint as lo, max(i) as hi from c union all
            select unnest([lo, m]), unnest([m, hi]) from (select lo, hi, -max(struct_pack(g := gain, m := -i)).m as m from
                (select s.lo, s.hi, m.i, (h.b - l.b - (h.a - l.a) ** 2 / (h.i - l.i)) - (m.b - l.b - (m.a - l.a) ** 2 / (m.i - l.i)) - (h.b - m.b - (h.a - m.a) ** 2 / (h.i - m.i)) - 22 as gain
                 from s join z l on l.i = s.lo join z h on h.i = s.hi join z m on m.i >= s.lo + 7 and m.i <= s.hi - 7) where gain > 0 group by lo, hi)),
        g as (select c.*, (select count(distinct lo) from s where lo > 0 and lo < c.i) as segment from c) {_SEGMENTS.format(cost='var_pop(v) * count(*)')}""",
}

QUERIES = [order_changes, price_segments, discount_changes, order_splits]

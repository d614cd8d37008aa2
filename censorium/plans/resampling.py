"""Queries on resampled curves and fits, and their SQL, which draws the same weights and makes its own Newton steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from censorium.operators import bootstrap
from censorium.plans.inference import Q, _r

#: Replicates of the curves and of the fits.
CURVES, FITS = 20, 12
TIMES = (10.0, 25.5, 49.0)
#: Steps of the SQL from 0 to the maximum.
STEPS = 7


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_linestatus", "l_discount", (F.col("l_returnflag") == "R").cast("int").alias("returned"))
    return rows.withColumn("open", (F.col("l_linestatus") == "O").cast("double"))


def bootstrap_km(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole orders are resampled."""
    got = bootstrap.bootstrap_curve(_lines(spark, sf_dir), keys=["l_linestatus"], ids=["l_orderkey"], times=TIMES, n=CURVES, **Q)
    return got.select("l_linestatus", "time", "n_replicates", *_r("mean", "std_err", "lower", "upper"))


def bayes_km(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Bayesian bootstrap by line, with 90 % limits."""
    got = bootstrap.bootstrap_curve(_lines(spark, sf_dir), ids=["l_orderkey", "l_linenumber"], times=TIMES, n=CURVES, kind="exponential", level=0.9, **Q)
    return got.select("time", "n_replicates", *_r("mean", "std_err", "lower", "upper"))


def bootstrap_hazard_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Cox coefficient in replicates of orders."""
    fit = bootstrap.bootstrap_cox(_lines(spark, sf_dir), x=["l_discount"], ids=["l_orderkey"], n=FITS, **Q)
    return fit.table(spark).select("name", *_r("coefficient", "std_err", "lower", "upper"))


def bootstrap_exponential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exponential model of two groups, each replicate's maximum in closed form."""
    fit = bootstrap.bootstrap_aft(_lines(spark, sf_dir), x=["open"], ids=["l_orderkey"], family="exponential", n=FITS, seed=3, **Q)
    return fit.table(spark).select("name", *_r("coefficient", "std_err", "lower", "upper"))


def _drawn(ids: str, n: int, kind: str = "poisson", seed: int = 0) -> str:
    """CTE ``w``: lines beside each replicate b with their weight w."""
    u = "('0x' || substr(h, 8 * j + 1, 8))::bigint"
    weight = f"len(list_filter({bootstrap.poisson_steps()!r}::bigint[], lambda s: u >= s))::double" if kind == "poisson" else f"-ln((u + 0.5) / {1 << bootstrap.BITS})"
    return f"""q as (select l_quantity as time, case when l_returnflag = 'R' then 1.0 else 0.0 end as d, l_discount::double as x, l_linestatus as k, g, md5('{seed}|' || {ids} || '|' || g) as h from lineitem, range(0, {-(-n // 4)}) as a(g)),
        u as (select time, d, x, k, 4 * g + j as b, {u} as u from q, range(0, 4) as c(j)), w as (select *, {weight} as w from u where b < {n})"""


def _curves(ids: str, key: str, kind: str, level: float) -> str:
    low, high = bootstrap.places(CURVES, level)
    k = f"{key}, " if key else ""
    return f"""with {_drawn(ids, CURVES, kind)}, c as (select {k}b, time, sum(w * d) as d, sum(sum(w)) over (partition by {k}b order by time desc) as n from w where w > 0 group by {k}b, time),
        v as (select {k}b, t as time, coalesce(product(greatest(0, 1 - d / n)) filter (c.time <= t), 1) as v from c, unnest({list(TIMES)!r}::double[]) as a(t) group by {k}b, t)
        select {"k as l_linestatus, " if key else ""}time, count(*) as n_replicates, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as std_err, round(list_sort(list(v))[{low + 1}], 6) as lower, round(list_sort(list(v))[{high + 1}], 6) as upper from v group by {k}time"""


def _newton() -> str:
    one = """r{n} as (select b, time, sum(wd) as d, sum(wd * x) as dx, sum(sum(w * exp(beta * x))) over o as s0, sum(sum(w * x * exp(beta * x))) over o as s1, sum(sum(w * x * x * exp(beta * x))) over o as s2 from c join b{n} using (b) group by b, time window o as (partition by b order by time desc)),
        b{m} as (select b, any_value(beta) + sum(dx - d * s1 / s0) / sum(d * (s2 / s0 - (s1 / s0) ** 2)) as beta from r{n} join b{n} using (b) where d > 0 group by b)"""
    return ", ".join(one.format(n=n, m=n + 1) for n in range(STEPS))


_LOW, _HIGH = bootstrap.places(FITS, 0.95)
_OVER = f"round(max(v) filter (b < 0), 6) as coefficient, round(stddev_samp(v) filter (b >= 0), 6) as std_err, round((list_sort(list(v) filter (b >= 0)))[{_LOW + 1}], 6) as lower, round((list_sort(list(v) filter (b >= 0)))[{_HIGH + 1}], 6) as upper"

SQL = {
    "bootstrap_km": _curves("l_orderkey", "k", "poisson", 0.95),
    "bayes_km": _curves("l_orderkey || '|' || l_linenumber", "", "exponential", 0.9),
    "bootstrap_hazard_ratio": f"""with {_drawn("l_orderkey", FITS)}, e as (select b, time, x, d, w from w union all select -1, time, x, d, 1 from q where g = 0), c as (select b, time, x, sum(w * d) as wd, sum(w) as w from e where w > 0 group by b, time, x), b0 as (select distinct b, 0.0::double as beta from c), {_newton()}
        select 'l_discount' as name, {_OVER} from (select b, beta as v from b{STEPS})""",
    "bootstrap_exponential": f"""with {_drawn("l_orderkey", FITS, seed=3)}, e as (select b, time, k, d, w from w union all select -1, time, k, d, 1 from q where g = 0), s as (select b, ln(sum(w * time) filter (k <> 'O') / sum(w * d) filter (k <> 'O')) as f, ln(sum(w * time) filter (k = 'O') / sum(w * d) filter (k = 'O')) as o from e group by b),
        v as (select b, 'intercept' as name, f as v from s union all select b, 'open', o - f from s) select name, {_OVER} from v group by name""",
}

QUERIES = [bootstrap_km, bayes_km, bootstrap_hazard_ratio, bootstrap_exponential]

"""Queries on curves with limits, comparisons of groups and Cox models, and their SQL.

``lineitem`` is right-censored data with ties (time l_quantity, event: returned), l_linestatus two groups, l_tax nine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from censorium.operators import compare, cox, curves

Q = dict(time="l_quantity", status="returned")
Z = 1.959963984540054
#: Coefficients at which the fixed-coefficient queries are evaluated.
BETA = (3.0, -2.0)
X = ("l_discount", "l_tax")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_linestatus", "l_discount", "l_tax", (F.col("l_returnflag") == "R").cast("int").alias("returned"))


def _r(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def km_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    km = curves.kaplan_meier(_lines(spark, sf_dir), keys=["l_linestatus"], **Q)
    out = {}
    for kind in ("plain", "log", "log-log", "logit", "arcsin"):
        low, high = curves.confidence_limits(F.col("surv"), F.col("std_err"), kind=kind)
        out |= {f"{kind.replace('-', '_')}_low": F.round(low, 6), f"{kind.replace('-', '_')}_high": F.round(high, 6)}
    return km.select("l_linestatus", "time", *(c.alias(n) for n, c in out.items()))


def km_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.kaplan_meier(_lines(spark, sf_dir), keys=["l_linestatus"], reverse=True, **Q).select("l_linestatus", "time", "n_risk", "n_event", *_r("surv"))


def km_null_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null times drop out, a null group is a group, delayed entry."""
    rows = _lines(spark, sf_dir).withColumns({"g": F.expr("nullif(l_linenumber % 3, 0)"), "t": F.expr("nullif(l_quantity, 7)"), "a": F.expr("nullif(l_linenumber, 2)") - 1})
    return curves.kaplan_meier(rows, time="t", status="returned", keys=["g"], entry="a").select("g", "time", "n_risk", "n_event", *_r("surv"))


def na_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.nelson_aalen(_lines(spark, sf_dir), keys=["l_linestatus"], **Q).where("n_event > 0").select("l_linestatus", "time", *_r("cum_hazard", "lower", "upper"))


def km_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.quantile_limits(_lines(spark, sf_dir), keys=["l_tax"], q=0.25, **Q)


def km_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.at_times(_lines(spark, sf_dir), keys=["l_linestatus"], times=[0.5, 10.0, 33.3, 80.0], **Q).select("l_linestatus", "time", "n_after", *_r("surv", "std_err", "lower", "upper"))


def rmst_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.restricted_mean(_lines(spark, sf_dir), keys=["l_tax"], tau=30.0, **Q).select("l_tax", *_r("rmst", "std_err", "lower", "upper"))


def rmst_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.restricted_mean_difference(_lines(spark, sf_dir), group="l_linestatus", tau=30.0, **Q).select(*_r("low", "high", "difference", "std_err", "ratio", "ratio_lower", "ratio_upper"))


def actuarial_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.life_table(_lines(spark, sf_dir), keys=["l_linestatus"], breaks=[0, 10, 25, 26, 50], **Q).select("l_linestatus", "start", "n_enter", "n_event", "n_censor", *_r("surv", "std_err"))


def incidence_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumn("cause", F.when(F.col("returned") == 0, 0).otherwise(1 + F.col("l_linenumber") % 2))
    return curves.cumulative_incidence(rows, time="l_quantity", cause="cause").select("time", "cause", "n_event", *_r("incidence"), F.round(F.col("variance") * 1e6, 4).alias("variance"))


def conditional_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.conditional_curve(_lines(spark, sf_dir), keys=["l_linestatus"], given=10.0, target=30.0, **Q).select("l_linestatus", *_r("surv", "std_err", "lower", "upper"))


def many_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = curves.landmarks(_lines(spark, sf_dir), time="l_quantity", at=[5, 20, 40])
    return curves.quantile_time(rows, keys=["landmark"], q=0.3, **Q)


def average_of_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    km = curves.kaplan_meier(_lines(spark, sf_dir), keys=["l_tax"], **Q)
    return curves.average_curve(km, curve="l_tax", time="time", surv="surv", std_err="std_err").select("time", *_r("surv", "std_err"))


def curve_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The step function of one group looked up at the (fractional) requests of orders."""
    km = curves.kaplan_meier(_lines(spark, sf_dir), keys=["l_linestatus"], **Q)
    asked = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_totalprice") % 60).alias("at"), F.when(F.col("o_orderkey") % 2 == 0, "F").otherwise("O").alias("l_linestatus"))
    return curves.step_values(km, asked, step="time", value="surv", at="at", initial=1.0, keys=["l_linestatus"]).select("o_orderkey", *_r("surv"))


def logrank_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine groups in two strata: observed, expected and own variance."""
    out = compare.logrank_components(_lines(spark, sf_dir), group="l_tax", strata=["l_linestatus"], **Q)
    return out.select("l_tax", "n", *_r("observed", "expected"), F.round(F.col("covariance")[F.col("l_tax").cast("string")], 6).alias("variance"))


def logrank_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in ("wilcoxon", "tarone-ware", "peto"):
        one = compare.logrank(_lines(spark, sf_dir), group="l_linestatus", weights=name, **Q).select(F.lit(name).alias("weights"), *_r("chi_square"))
        out = one if out is None else out.union(one)
    return out


def logrank_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumn("a", F.col("l_linenumber") - 1)
    return compare.logrank(rows, group="l_linestatus", entry="a", **Q).select(*_r("observed", "expected", "variance"))


def trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.logrank_trend(_lines(spark, sf_dir), group="l_tax", **Q).select(*_r("statistic", "variance", "chi_square"))


def peto_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.hazard_ratio(_lines(spark, sf_dir), group="l_linestatus", **Q).select(*_r("log_hr", "std_err", "hazard_ratio", "lower", "upper"))


def nnt_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.risk_difference(_lines(spark, sf_dir), group="l_linestatus", horizon=25.0, **Q).select(*_r("difference", "lower", "upper"))


def _detail(spark: SparkSession, sf_dir: str, ties: str) -> DataFrame:
    out = cox.cox_detail(_lines(spark, sf_dir), x=X, coefficients=BETA, ties=ties, **Q)
    return out.select("time", "n_risk", "n_event", F.round(F.col("hazard") * 1000, 6).alias("hazard"), *_r("mean_l_discount", "mean_l_tax"), F.round("score_l_discount", 4).alias("score_l_discount"))


def cox_detail_breslow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detail(spark, sf_dir, "breslow")


def cox_detail_efron(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detail(spark, sf_dir, "efron")


def cox_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline by stratum with delayed entry."""
    rows = _lines(spark, sf_dir).withColumn("a", F.col("l_linenumber") - 1)
    out = cox.base_hazard(rows, x=X, coefficients=BETA, strata=["l_linestatus"], entry="a", **Q)
    return out.select("l_linestatus", "time", "n_risk", "n_event", *_r("cum_hazard", "surv"))


def cox_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of residuals at fixed coefficients by group of tax."""
    rows = cox.residuals(_lines(spark, sf_dir), x=X, coefficients=BETA, **Q)
    return rows.groupBy("l_tax").agg(F.count("*").alias("n"), *(F.round(F.sum(c), 4).alias(c) for c in ("martingale", "deviance", "score_l_discount", "schoenfeld_l_discount")))


def cox_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the fitted coefficients (Efron, strata) the score is 0, and so are the sums of martingale and score residuals (Breslow)."""
    rows = _lines(spark, sf_dir)
    fit = cox.cox_fit(rows, x=X, strata=["l_linestatus"], ties="efron", **Q)
    detail = cox.cox_detail(rows, x=X, coefficients=fit.coefficients, strata=["l_linestatus"], ties="efron", **Q)
    a = detail.agg(F.round(F.sum("score_l_discount"), 2).alias("score_1"), F.round(F.sum("score_l_tax"), 2).alias("score_2"))
    b = cox.residuals(rows, x=X, coefficients=fit.coefficients, strata=["l_linestatus"], ties="efron", **Q).agg(F.round(F.sum("martingale"), 2).alias("martingale"), F.round(F.sum("score_l_tax"), 2).alias("residual_score"))
    return a.crossJoin(b).select(*((F.abs(c) + 0.0).alias(c) for c in ("score_1", "score_2", "martingale", "residual_score")))  # one row each


def pseudo_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean pseudo-values by group at two times; over all rows they average to the curve."""
    out = None
    for kind in ("surv", "cumhaz", "rmst"):
        one = curves.pseudo_values(_lines(spark, sf_dir), times=[10.0, 25.5], kind=kind, **Q).groupBy("at").agg(F.round(F.avg("pseudo"), 6).alias("mean"), F.round(F.max("pseudo"), 4).alias("top")).select(F.lit(kind).alias("kind"), "at", "mean", "top")
        out = one if out is None else out.union(one)
    return out


_CELLS = """
cells as (select l_linestatus, l_quantity as time, cast(count(*) filter (l_returnflag = 'R') as double) as d, cast(count(*) as double) as c from lineitem group by all),
risk as (select *, sum(c) over (partition by l_linestatus order by time desc) as n from cells),
km as (select *, product(1 - d / n) over w as s, sum(d / n) over w as h, sum(d / n / n) over w as hv, sum(case when n > d then d / (n * (n - d)) else 0 end) over w as g
       from risk window w as (partition by l_linestatus order by time)),
k as (select *, s * sqrt(g) as se from km)"""
_BY_TAX = _CELLS.replace("l_linestatus", "l_tax")
_ALL = """
cells as (select l_quantity as time, cast(count(*) filter (l_returnflag = 'R') as double) as d, cast(count(*) as double) as c from lineitem group by all),
risk as (select *, sum(c) over (order by time desc) as n from cells),
km as (select *, product(1 - d / n) over w as s, sum(d / n) over w as h, sum(case when n > d then d / (n * (n - d)) else 0 end) over w as g from risk window w as (order by time))"""


def _limits(low: str, high: str, name: str) -> str:
    clamp = lambda e: f"round(case when se > 0 and s > 0 and s < 1 then greatest(0.0, least(1.0, {e})) else s end, 6)"
    return f"{clamp(low)} as {name}_low, {clamp(high)} as {name}_high"


_RMST = f"""ev as (select l_tax, time, s, d, n, lead(time, 1, 30.0) over (partition by l_tax order by time) as nxt, coalesce(lag(s) over (partition by l_tax order by time), 1.0) as s0, coalesce(lag(time) over (partition by l_tax order by time), 0.0) as t0 from k where d > 0 and time <= 30),
ar as (select *, sum(s * (nxt - time)) over (partition by l_tax order by time desc) as a from ev),
rm as (select l_tax, sum(s0 * (time - t0)) + arg_max(s, time) * (30 - max(time)) as rmst, sum(case when n > d then d * a * a / (n * (n - d)) else 0 end) as v from ar group by 1)"""

_COX = f"""r as (select l_quantity as time, l_discount as x1, l_tax as x2, l_linestatus, l_linenumber, case when l_returnflag = 'R' then 1.0 else 0.0 end as d, exp({BETA[0]} * l_discount + {BETA[1]} * l_tax) as r from lineitem),
c0 as (select time, sum(d) as d, count(*) as c, sum(r) as r, sum(r * x1) as r1, sum(r * x2) as r2, sum(d * x1) as x1, sum(d * r) as e0, sum(d * r * x1) as e1, sum(d * r * x2) as e2 from r group by 1),
c as (select *, sum(c) over w as n, sum(r) over w as s0, sum(r1) over w as s1, sum(r2) over w as s2 from c0 window w as (order by time desc))"""

SQL = {
    "km_limits": f"""with {_CELLS} select l_linestatus, time, {_limits(f's - {Z} * se', f's + {Z} * se', 'plain')}, {_limits(f'exp(ln(s) - {Z} * se / s)', f'exp(ln(s) + {Z} * se / s)', 'log')},
        {_limits(f'exp(-exp(ln(-ln(s)) - {Z} * se / (s * ln(s))))', f'exp(-exp(ln(-ln(s)) + {Z} * se / (s * ln(s))))', 'log_log')},
        {_limits(f'1 - 1 / (1 + exp(ln(s / (1 - s)) - {Z} * se / (s * (1 - s))))', f'1 - 1 / (1 + exp(ln(s / (1 - s)) + {Z} * se / (s * (1 - s))))', 'logit')},
        {_limits(f'sin(greatest(0.0, asin(sqrt(s)) - 0.5 * {Z} * se / sqrt(s * (1 - s)))) ** 2', f'sin(least(pi() / 2, asin(sqrt(s)) + 0.5 * {Z} * se / sqrt(s * (1 - s)))) ** 2', 'arcsin')} from k""",
    "km_reverse": f"with {_CELLS} select l_linestatus, time, n - d as n_risk, c - d as n_event, round(product(case when n - d > 0 then 1 - (c - d) / (n - d) else 1 end) over (partition by l_linestatus order by time), 6) as surv from k",
    "km_null_group": """with r as (select nullif(l_linenumber % 3, 0) as g, nullif(l_quantity, 7) as t, nullif(l_linenumber, 2) - 1 as a, case when l_returnflag = 'R' then 1.0 else 0.0 end as d from lineitem),
        c as (select g, t as time, sum(d) as d, count(*) as c from r where t is not null and (a is null or a < t) group by all),
        n as (select c.g, c.time, c.d, c.c, (select count(*) from r where r.g is not distinct from c.g and r.t >= c.time and (r.a is null or r.a < c.time)) as n from c)
        select g, time, cast(n as double) as n_risk, d as n_event, round(product(case when n > 0 then 1 - d / n else 1 end) over (partition by g order by time), 6) as surv from n""",
    "na_limits": f"with {_CELLS} select l_linestatus, time, round(h, 6) as cum_hazard, round(greatest(0.0, h - {Z} * sqrt(hv)), 6) as lower, round(h + {Z} * sqrt(hv), 6) as upper from k where d > 0",
    "km_quantiles": f"""with {_BY_TAX}, e as (select *, case when se > 0 and s > 0 and s < 1 then greatest(0.0, s - {Z} * se) else s end as lo, case when se > 0 and s > 0 and s < 1 then least(1.0, s + {Z} * se) else s end as hi from k where d > 0)
        select l_tax, min(time) filter (s <= 0.75 + 1e-12) as quantile, min(time) filter (lo <= 0.75 + 1e-12) as lower, min(time) filter (hi <= 0.75 + 1e-12) as upper from e group by 1""",
    "km_at": f"""with {_CELLS}, t as (select unnest([0.5, 10.0, 33.3, 80.0]) as t), g as (select distinct l_linestatus from lineitem),
        e as (select g.l_linestatus, t.t, (select max(time) from k where k.l_linestatus = g.l_linestatus and d > 0 and time <= t.t) as at, (select max(n) from k where k.l_linestatus = g.l_linestatus and time > t.t) as na from t, g)
        select e.l_linestatus, cast(e.t as double) as time, coalesce(na, 0.0) as n_after, round(coalesce(s, 1.0), 6) as surv, round(coalesce(se, 0.0), 6) as std_err,
        round(coalesce(case when se > 0 and s > 0 and s < 1 then greatest(0.0, s - {Z} * se) else s end, 1.0), 6) as lower, round(coalesce(case when se > 0 and s > 0 and s < 1 then least(1.0, s + {Z} * se) else s end, 1.0), 6) as upper
        from e left join k on k.l_linestatus = e.l_linestatus and k.time = e.at""",
    "rmst_limits": f"with {_BY_TAX}, {_RMST} select l_tax, round(rmst, 6) as rmst, round(sqrt(v), 6) as std_err, round(rmst - {Z} * sqrt(v), 6) as lower, round(rmst + {Z} * sqrt(v), 6) as upper from rm",
    "rmst_difference": f"""with {_CELLS}, {_RMST.replace('l_tax', 'l_linestatus')}, b as (select min(rmst) filter (l_linestatus = 'F') as a, min(rmst) filter (l_linestatus = 'O') as b, min(v) filter (l_linestatus = 'F') as va, min(v) filter (l_linestatus = 'O') as vb from rm),
        q as (select *, sqrt(va / a / a + vb / b / b) as rs from b)
        select round(a, 6) as low, round(b, 6) as high, round(b - a, 6) as difference, round(sqrt(va + vb), 6) as std_err, round(b / a, 6) as ratio, round(b / a * exp(-{Z} * rs), 6) as ratio_lower, round(b / a * exp({Z} * rs), 6) as ratio_upper from q""",
    "actuarial_breaks": """with r as (select l_linestatus, case when l_quantity < 10 then 0.0 when l_quantity < 25 then 10.0 when l_quantity < 26 then 25.0 else 26.0 end as start, case when l_returnflag = 'R' then 1.0 else 0.0 end as d from lineitem where l_quantity between 0 and 50),
        c as (select l_linestatus, cast(start as double) as start, sum(d) as d, sum(1 - d) as c from r group by all), e as (select *, sum(d + c) over (partition by l_linestatus order by start desc) as n from c), x as (select *, n - c / 2 as x from e)
        select l_linestatus, start, n as n_enter, d as n_event, c as n_censor, round(product(1 - d / x) over w, 6) as surv, round(product(1 - d / x) over w * sqrt(sum(case when x > d then d / (x * (x - d)) else 0 end) over w), 6) as std_err from x window w as (partition by l_linestatus order by start)""",
    "incidence_variance": """with r as (select l_quantity as time, case when l_returnflag = 'R' then 1 + l_linenumber % 2 else 0 end as cause from lineitem),
        c as (select time, cast(count(*) filter (cause > 0) as double) as d, cast(count(*) filter (cause = 1) as double) as k1, cast(count(*) filter (cause = 2) as double) as k2, cast(count(*) as double) as c from r group by 1),
        n as (select *, sum(c) over (order by time desc) as n from c), s as (select *, product(1 - d / n) over (order by time) as s from n), b as (select *, coalesce(lag(s) over (order by time), 1.0) as b from s),
        u as (select time, 1 as cause, k1 as k, d, n, b from b where d > 0 union all select time, 2, k2, d, n, b from b where d > 0), f as (select *, sum(b * k / n) over (partition by cause order by time) as f from u),
        v as (select t.time, t.cause, t.k, t.f, sum((t.f - u.f) ** 2 * case when u.n > u.d then u.d / (u.n * (u.n - u.d)) else 0 end + u.b ** 2 * u.k * (u.n - u.k) / u.n ** 3 - 2 * (t.f - u.f) * u.b * u.k / u.n ** 2) as v from f t join f u on u.cause = t.cause and u.time <= t.time group by all)
        select time, cause, k as n_event, round(f, 6) as incidence, round(v * 1e6, 4) as variance from v where k > 0""",
    "conditional_limits": f"""with {_CELLS}, a as (select l_linestatus, arg_max(s, time) filter (time <= 10) as s1, arg_max(g, time) filter (time <= 10) as g1, arg_max(s, time) filter (time <= 30) as s2, arg_max(g, time) filter (time <= 30) as g2 from k group by 1),
        b as (select l_linestatus, s2 / s1 as s, s2 / s1 * sqrt(abs(g2 - g1)) as se from a) select l_linestatus, round(s, 6) as surv, round(se, 6) as std_err, round(greatest(0.0, s - {Z} * se), 6) as lower, round(least(1.0, s + {Z} * se), 6) as upper from b""",
    "many_landmarks": """with l as (select cast(unnest([5, 20, 40]) as double) as landmark), r as (select landmark, l_quantity - landmark as time, case when l_returnflag = 'R' then 1.0 else 0.0 end as d from lineitem, l where l_quantity > landmark),
        c as (select landmark, time, sum(d) as d, count(*) as c from r group by all), n as (select *, sum(c) over (partition by landmark order by time desc) as n from c), s as (select *, product(1 - d / n) over (partition by landmark order by time) as s from n)
        select landmark, min(time) filter (s <= 0.7 + 1e-12) as quantile from s group by 1""",
    "average_of_curves": f"""with {_BY_TAX}, t as (select distinct time from k), x as (select distinct l_tax from k), g as (select t.time, x.l_tax, (select max(time) from k where k.l_tax = x.l_tax and k.time <= t.time) as at from t, x)
        select g.time, round(avg(coalesce(s, 1.0)), 6) as surv, round(sqrt(sum(coalesce(se, 0) ** 2)) / count(*), 6) as std_err from g left join k on k.l_tax = g.l_tax and k.time = g.at group by 1""",
    "curve_steps": f"""with {_CELLS}, o as (select o_orderkey, o_totalprice % 60 as at, case when o_orderkey % 2 = 0 then 'F' else 'O' end as l_linestatus from orders)
        select o_orderkey, round(coalesce(s, 1.0), 6) as surv from o asof left join k on k.l_linestatus = o.l_linestatus and k.time <= o.at""",
    "logrank_groups": """with r as (select l_linestatus, l_tax, l_quantity as time, case when l_returnflag = 'R' then 1.0 else 0.0 end as d from lineitem), e as (select l_linestatus, time, sum(d) as d from r group by all having sum(d) > 0),
        n as (select e.l_linestatus, e.time, e.d, count(*) as n from e join r on r.l_linestatus = e.l_linestatus and r.time >= e.time group by all), g as (select n.*, r.l_tax, count(*) as ng, sum(case when r.time = n.time then r.d else 0 end) as dg from n join r on r.l_linestatus = n.l_linestatus and r.time >= n.time group by all)
        select l_tax, (select count(*) from lineitem i where i.l_tax = g.l_tax) as n, round(sum(dg), 6) as observed, round(sum(d * ng / n), 6) as expected, round(sum(case when n > 1 then d * (n - d) / (n - 1) * ng / n * (1 - ng / n) else 0 end), 6) as variance from g group by 1""",
    "logrank_weights": """with c as (select l_quantity as time, cast(count(*) filter (l_returnflag = 'R') as double) as d, cast(count(*) filter (l_returnflag = 'R' and l_linestatus = 'O') as double) as d1, cast(count(*) as double) as c, cast(count(*) filter (l_linestatus = 'O') as double) as c1 from lineitem group by 1),
        r as (select *, sum(c) over (order by time desc) as n, sum(c1) over (order by time desc) as n1 from c), s as (select *, product(1 - d / n) over (order by time) as s from r), b as (select *, coalesce(lag(s) over (order by time), 1.0) as b from s),
        w as (select 'wilcoxon' as weights, n as w, d, d1, n, n1 from b union all select 'tarone-ware', sqrt(n), d, d1, n, n1 from b union all select 'peto', b, d, d1, n, n1 from b)
        select weights, round(sum(w * (d1 - d * n1 / n)) ** 2 / sum(case when n > 1 then w * w * d * n1 / n * (1 - n1 / n) * (n - d) / (n - 1) else 0 end), 6) as chi_square from w group by 1""",
    "logrank_entry": """with r as (select l_quantity as time, l_linenumber - 1 as a, l_linestatus, case when l_returnflag = 'R' then 1.0 else 0.0 end as d from lineitem where l_linenumber - 1 < l_quantity), e as (select time, sum(d) as d, sum(case when l_linestatus = 'O' then d else 0 end) as d1 from r group by 1 having sum(d) > 0),
        n as (select e.time, e.d, e.d1, count(*) as n, count(*) filter (l_linestatus = 'O') as n1 from e join r on r.time >= e.time and r.a < e.time group by all)
        select round(sum(d1), 6) as observed, round(sum(d * n1 / n), 6) as expected, round(sum(case when n > 1 then d * n1 / n * (1 - n1 / n) * (n - d) / (n - 1) else 0 end), 6) as variance from n""",
    "trend": """with g as (select l_tax, row_number() over (order by l_tax) - 1 as s from (select distinct l_tax from lineitem)), c as (select l_quantity as time, l_tax, cast(count(*) filter (l_returnflag = 'R') as double) as d, cast(count(*) as double) as c from lineitem group by all),
        t as (select distinct time from c), f as (select t.time, g.l_tax, g.s, coalesce(c.d, 0) as d, coalesce(c.c, 0) as c from t cross join g left join c on c.time = t.time and c.l_tax = g.l_tax), n as (select *, sum(c) over (partition by l_tax order by time desc) as n from f),
        a as (select time, sum(d) as d, sum(n) as n, sum(s * d) as sd, sum(s * n) as sn, sum(s * s * n) as ssn from n group by 1)
        , u as (select sum(sd - d * sn / n) as u, sum(case when n > 1 then d * (n - d) / (n - 1) / n * (ssn - sn * sn / n) else 0 end) as v from a) select round(u, 6) as statistic, round(v, 6) as variance, round(u * u / v, 6) as chi_square from u""",
    "peto_ratio": f"""with c as (select l_quantity as time, cast(count(*) filter (l_returnflag = 'R') as double) as d, cast(count(*) filter (l_returnflag = 'R' and l_linestatus = 'F') as double) as d1, cast(count(*) as double) as c, cast(count(*) filter (l_linestatus = 'F') as double) as c1 from lineitem group by 1),
        r as (select *, sum(c) over (order by time desc) as n, sum(c1) over (order by time desc) as n1 from c), s as (select sum(d1 - d * n1 / n) as u, sum(case when n > 1 then d * n1 / n * (1 - n1 / n) * (n - d) / (n - 1) else 0 end) as v from r)
        select round(u / v, 6) as log_hr, round(1 / sqrt(v), 6) as std_err, round(exp(u / v), 6) as hazard_ratio, round(exp(u / v - {Z} / sqrt(v)), 6) as lower, round(exp(u / v + {Z} / sqrt(v)), 6) as upper from s""",
    "nnt_limits": f"""with {_CELLS}, e as (select l_linestatus, arg_max(s, time) as s, arg_max(se, time) as se from k where time <= 25 group by 1), d as (select min(s) filter (l_linestatus = 'O') - min(s) filter (l_linestatus = 'F') as d, sqrt(sum(se * se)) as se from e)
        select round(d, 6) as difference, round(d - {Z} * se, 6) as lower, round(d + {Z} * se, 6) as upper from d""",
    "cox_detail_breslow": f"with {_COX} select time, cast(n as double) as n_risk, d as n_event, round(d / s0 * 1000, 6) as hazard, round(s1 / s0, 6) as mean_l_discount, round(s2 / s0, 6) as mean_l_tax, round(x1 - d * s1 / s0, 4) as score_l_discount from c where d > 0",
    "cox_detail_efron": f"""with {_COX}, l as (select *, list_sum(list_transform(range(cast(d as bigint)), lambda i: 1 / (s0 - i / d * e0))) as a, list_sum(list_transform(range(cast(d as bigint)), lambda i: (s1 - i / d * e1) / (s0 - i / d * e0))) as m1, list_sum(list_transform(range(cast(d as bigint)), lambda i: (s2 - i / d * e2) / (s0 - i / d * e0))) as m2 from c where d > 0)
        select time, cast(n as double) as n_risk, d as n_event, round(a * 1000, 6) as hazard, round(m1 / d, 6) as mean_l_discount, round(m2 / d, 6) as mean_l_tax, round(x1 - m1, 4) as score_l_discount from l""",
    "cox_baseline": f"""with {_COX.split(',\nc0')[0]}, t as (select l_linestatus, time, sum(d) as d from r where l_linenumber - 1 < time group by all), n as (select t.l_linestatus, t.time, t.d, count(*) as n, sum(r.r) as s0 from t join r on r.l_linestatus = t.l_linestatus and r.time >= t.time and r.l_linenumber - 1 < t.time group by all)
        select l_linestatus, time, cast(n as double) as n_risk, d as n_event, round(sum(d / s0) over w, 6) as cum_hazard, round(exp(-sum(d / s0) over w), 6) as surv from n window w as (partition by l_linestatus order by time)""",
    "cox_residuals": f"""with {_COX}, h as (select time, s1 / s0 as m, sum(d / s0) over w as h, sum(d / s0 * s1 / s0) over w as hx from c window w as (order by time)), q as (select r.*, r.d - r.r * h.h as mart, r.d * (r.x1 - m) - r.r * (r.x1 * h.h - h.hx) as sc, case when r.d > 0 then r.x1 - m end as sch from r join h on h.time = r.time)
        select x2 as l_tax, count(*) as n, round(sum(mart), 4) as martingale, round(sum(sign(mart) * sqrt(greatest(0.0, -2 * (mart + case when d > 0 then ln(greatest(1e-300, 1 - mart)) else 0 end)))), 4) as deviance, round(sum(sc), 4) as score_l_discount, round(sum(sch), 4) as schoenfeld_l_discount from q group by 1""",
    "cox_score": "select 0.0::double as score_1, 0.0::double as score_2, 0.0::double as martingale, 0.0::double as residual_score",
    "pseudo_means": f"""with {_ALL}, t as (select cast(unnest([10.0, 25.5]) as double) as tt), q as (select *, sum(case when n > d then d / (n * (n - d)) else 0 end) over (order by time) as q, sum(d / n / n) over (order by time) as qh from km), nn as (select count(*) as nn from lineitem),
        own as (select l_quantity as time, case when l_returnflag = 'R' then 1.0 else 0.0 end as st, count(*) as w from lineitem group by all),
        grid as (select distinct time as g0, lead(time) over (order by time) as g1 from km),
        u as (select t.tt, own.time, own.st, own.w, (select max(time) from km where time <= least(own.time, t.tt)) as lt, (select max(time) from km where time <= t.tt) as ct from t, own),
        p as (select u.*, coalesce(a.q, 0) as q, coalesce(a.qh, 0) as qh, case when u.st > 0 and u.time <= u.tt then case when a.n > a.d then 1 / (a.n - a.d) else 0 end else 0 end as own, case when u.st > 0 and u.time <= u.tt then 1 / a.n else 0 end as ownh, coalesce(b.s, 1) as s, coalesce(b.h, 0) as h from u left join q a on a.time = u.lt left join q b on b.time = u.ct),
        v as (select 'surv' as kind, tt, w, s * (1 - nn * (own - q)) as pseudo from p, nn union all select 'cumhaz', tt, w, h + nn * (ownh - qh) from p, nn),
        steps as (select 0.0 as g0, min(time) as g1, 1.0 as s, 0.0 as q from q union all select time, lead(time, 1, 1e9) over (order by time), s, q from q),
        rm as (select t.tt, own.time, own.st, own.w, sum(greatest(0, least(g1, t.tt) - g0) * steps.s) as whole, sum(greatest(0, least(g1, t.tt) - greatest(g0, own.time)) * steps.s) as rest, sum(greatest(0, least(g1, t.tt, own.time) - g0) * steps.s * steps.q) as lived from t, own, steps group by all),
        rp as (select rm.*, coalesce(a.q, 0) as q, case when rm.st > 0 and rm.time <= rm.tt then case when a.n > a.d then 1 / (a.n - a.d) else 0 end else 0 end as own from rm left join q a on a.time = (select max(time) from km where time <= least(rm.time, rm.tt))),
        x as (select * from v union all select 'rmst', tt, w, whole - nn * (own * rest - (lived + q * case when time <= tt then rest else 0 end)) from rp, nn)
        select kind, tt as "at", round(sum(w * pseudo) / sum(w), 6) as mean, round(max(pseudo), 4) as top from x group by 1, 2""",
}

QUERIES = [km_limits, km_reverse, km_null_group, na_limits, km_quantiles, km_at, rmst_limits, rmst_difference, actuarial_breaks, incidence_variance, conditional_limits, many_landmarks, average_of_curves, curve_steps, logrank_groups, logrank_weights, logrank_entry, trend, peto_ratio, nnt_limits, cox_detail_breslow, cox_detail_efron, cox_baseline, cox_residuals, cox_score, pseudo_means]

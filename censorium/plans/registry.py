"""The library's own registered queries on the driver tables, and their SQL.

Roles: ``lineitem`` is right-censored data with many ties (time l_quantity, event: returned),
``events`` has few ties and causes, keyed by user.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from censorium.operators import compare, curves, data_prep, metrics
from censorium.plans import breaks, histories, inference, latent, models, predictions, resampling

#: Modules with further QUERIES and SQL.
MODULES = (inference, histories, predictions, models, resampling, latent, breaks)

Q = dict(time="l_quantity", status="returned")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_quantity", "l_linestatus", "l_discount", (F.col("l_returnflag") == "R").cast("int").alias("returned"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")


def _r(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def km_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    km = curves.kaplan_meier(_lines(spark, sf_dir), keys=["l_linestatus"], **Q)
    return km.select("l_linestatus", "time", "n_risk", "n_event", *_r("surv", "std_err", "cum_hazard"))


def na_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    na = curves.nelson_aalen(_lines(spark, sf_dir), keys=["l_linestatus"], **Q)
    return na.select("l_linestatus", "time", *_r("cum_hazard", "surv"))


def km_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.quantile_time(_lines(spark, sf_dir), keys=["l_linestatus"], **Q)


def km_rmst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.restricted_mean(_lines(spark, sf_dir), keys=["l_linestatus"], tau=30.0, **Q).select("l_linestatus", *_r("rmst"))


def actuarial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.life_table(_lines(spark, sf_dir), keys=["l_linestatus"], width=10.0, **Q).select("l_linestatus", "start", "n_enter", "n_event", "n_censor", *_r("surv"))


def incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    cause = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "signup", 2).otherwise(0)
    rows = _events(spark, sf_dir).select(F.floor("value").alias("t"), cause.alias("cause"))
    return curves.cumulative_incidence(rows, time="t", cause="cause", with_variance=False).select("time", "cause", "n_event", *_r("incidence"))


def logrank_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.logrank(_lines(spark, sf_dir), group="l_linestatus", **Q).select(*_r("observed", "expected", "variance", "chi_square"))


def split_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumn("start", F.lit(0.0))
    parts = data_prep.split_at(rows, start="start", stop="l_quantity", event="returned", cuts=[10, 20, 30, 40])
    return parts.groupBy("episode").agg(F.count("*").alias("n"), F.sum("returned").cast("long").alias("events"), F.round(F.sum(F.col("l_quantity") - F.col("start")), 6).alias("exposure"))


def last_signup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    signups = rows.where("event_type = 'signup'").select("user_id", "ts", F.col("ts").alias("signup"))
    found = data_prep.nearest_before(rows.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), signups, key="user_id", left_time="ts", right_time="ts", value="signup")
    return found.select("event_id", "signup")


def type_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data_prep.without_repeats(_events(spark, sf_dir), key="user_id", time="ts", state="event_type").select("event_id", "user_id", "event_type")


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data_prep.person_time(_lines(spark, sf_dir), keys=["l_linestatus"], **Q).select("l_linestatus", "n", "events", *_r("person_time", "rate"))


def brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.brier_score(_lines(spark, sf_dir), prediction="l_discount", outcome="returned").select(*_r("brier"))


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumn("p", F.col("l_quantity") / 64)
    return metrics.calibration(rows, prediction="p", outcome="returned", bins=8).select("bin", "n", *_r("mean_prediction", "mean_outcome"))


def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    return metrics.population_stability(rows.where("event_type = 'purchase'"), rows.where("event_type = 'signup'"), column="value", low=0.0, high=500.0).select(*_r("psi"))


def fh_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.logrank(_lines(spark, sf_dir), group="l_linestatus", rho=0.5, gamma=0.5, **Q).select(*_r("observed", "expected", "variance", "chi_square"))


def nnt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.risk_difference(_lines(spark, sf_dir), group="l_linestatus", horizon=25.0, **Q).select(*_r("low", "high", "difference", "std_err"))


def after_landmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = curves.landmark(_lines(spark, sf_dir), time="l_quantity", at=20.0)
    return curves.kaplan_meier(rows, **Q).select("time", "n_risk", "n_event", *_r("surv"))


def conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.conditional_curve(_lines(spark, sf_dir), keys=["l_linestatus"], given=10.0, target=30.0, **Q).select("l_linestatus", *_r("surv"))


def condensed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", (F.col("l_linenumber") - 1).alias("start"), F.col("l_linenumber").alias("stop"), (F.col("l_returnflag") == "R").cast("int").alias("event"))
    return data_prep.condense(rows, key="l_orderkey", start="start", stop="stop", event="event")


def snapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data_prep.snap_times(_events(spark, sf_dir), time="value", tolerance=0.02).groupBy("value").agg(F.count("*").alias("n"))


def drift_ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    return metrics.kolmogorov_smirnov(rows.where("event_type = 'purchase'"), rows.where("event_type = 'signup'"), column="value").select(*_r("ks"))


def c_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.concordance(_lines(spark, sf_dir), risk="l_discount", **Q).select("concordant", "discordant", "tied_risk", *_r("c_index"))


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    studies = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey").agg(F.avg("l_discount").alias("effect"), (F.stddev_samp("l_discount") / F.sqrt(F.count("*"))).alias("se"))
    return metrics.pooled_effect(studies, effect="effect", std_err="se").select("k", *_r("fixed", "fixed_std_err", "q", "tau2", "i2", "random", "random_std_err"))


_CELLS = """
cells as (select l_linestatus, l_quantity as time, cast(count(*) filter (l_returnflag = 'R') as double) as d, cast(count(*) as double) as c from lineitem group by all),
risk as (select *, sum(c) over (partition by l_linestatus order by time desc) as n from cells),
km as (select *, product(1 - d / n) over w as s, sum(d / n) over w as h, sum(case when n > d then d / (n * (n - d)) end) over w as g
       from risk window w as (partition by l_linestatus order by time))"""

SQL = {
    "km_by_group": f"with {_CELLS} select l_linestatus, time, n as n_risk, d as n_event, round(s, 6) as surv, round(s * sqrt(coalesce(g, 0)), 6) as std_err, round(h, 6) as cum_hazard from km",
    "na_by_group": f"with {_CELLS} select l_linestatus, time, round(h, 6) as cum_hazard, round(exp(-h), 6) as surv from km",
    "km_median": f"with {_CELLS} select l_linestatus, min(case when s <= 0.5 + 1e-12 then time end) as quantile from km group by 1",
    "km_rmst": f"with {_CELLS}, a as (select *, lag(s, 1, 1.0) over w as s0, lag(time, 1, 0.0) over w as t0 from km where time <= 30 window w as (partition by l_linestatus order by time)) select l_linestatus, round(sum(s0 * (time - t0)) + arg_max(s, time) * (30 - max(time)), 6) as rmst from a group by 1",
    "actuarial": """with c as (select l_linestatus, floor(l_quantity / 10) * 10 as start, cast(count(*) filter (l_returnflag = 'R') as double) as n_event, cast(count(*) filter (l_returnflag <> 'R') as double) as n_censor from lineitem group by all),
        e as (select *, sum(n_event + n_censor) over (partition by l_linestatus order by start desc) as n_enter from c)
        select l_linestatus, start, n_enter, n_event, n_censor, round(product(1 - n_event / (n_enter - n_censor / 2)) over (partition by l_linestatus order by start), 6) as surv from e""",
    "incidence": """with e as (select floor(value) as time, case event_type when 'purchase' then 1 when 'signup' then 2 else 0 end as cause from events),
        c as (select time, cast(count(*) filter (cause <> 0) as double) as d, cast(count(*) as double) as c from e group by 1),
        r as (select *, sum(c) over (order by time desc) as n from c), s as (select *, product(1 - d / n) over (order by time) as s from r),
        b as (select time, n, coalesce(lag(s) over (order by time), 1.0) as before from s),
        k as (select time, cause, cast(count(*) as double) as n_event from e where cause <> 0 group by 1, 2)
        select k.time, cause, n_event, round(sum(before * n_event / n) over (partition by cause order by k.time), 6) as incidence from k join b on k.time = b.time""",
    "logrank_test": """with c as (select l_quantity as time, cast(count(*) filter (l_returnflag = 'R') as double) as d, cast(count(*) filter (l_returnflag = 'R' and l_linestatus = 'O') as double) as d1, cast(count(*) as double) as c, cast(count(*) filter (l_linestatus = 'O') as double) as c1 from lineitem group by 1),
        r as (select *, sum(c) over (order by time desc) as n, sum(c1) over (order by time desc) as n1 from c),
        s as (select sum(d1) as observed, sum(d * n1 / n) as expected, sum(case when n > 1 then d * n1 / n * (1 - n1 / n) * (n - d) / (n - 1) else 0 end) as variance from r)
        select round(observed, 6) as observed, round(expected, 6) as expected, round(variance, 6) as variance, round((observed - expected) ** 2 / variance, 6) as chi_square from s""",
    "split_episodes": """with e as (select unnest([0, 1, 2, 3, 4]) as episode), p as (select episode, l_returnflag = 'R' and l_quantity <= case when episode = 4 then 1e9 else 10 * (episode + 1) end as ev, least(l_quantity, case when episode = 4 then 1e9 else 10 * (episode + 1) end) - 10 * episode as x from lineitem, e where l_quantity > 10 * episode)
        select cast(episode as integer) as episode, count(*) as n, cast(count(*) filter (ev) as bigint) as events, round(sum(x), 6) as exposure from p group by 1""",
    "last_signup": "select p.event_id, (select max(s.ts) from events s where s.user_id = p.user_id and s.event_type = 'signup' and s.ts <= p.ts) as signup from events p where p.event_type = 'purchase'",
    "type_changes": "with e as (select *, lag(event_type) over w as before, row_number() over w as i from events window w as (partition by user_id order by ts)) select event_id, user_id, event_type from e where i = 1 or event_type is distinct from before",
    "rates": "select l_linestatus, count(*) as n, cast(count(*) filter (l_returnflag = 'R') as double) as events, round(sum(l_quantity), 6) as person_time, round(count(*) filter (l_returnflag = 'R') / sum(l_quantity), 6) as rate from lineitem group by 1",
    "brier": "select round(avg((l_discount - case when l_returnflag = 'R' then 1 else 0 end) ** 2), 6) as brier from lineitem",
    "calibration": "select cast(least(7, floor(l_quantity / 64 * 8)) as integer) as bin, count(*) as n, round(avg(l_quantity / 64), 6) as mean_prediction, round(avg(case when l_returnflag = 'R' then 1.0 else 0.0 end), 6) as mean_outcome from lineitem group by 1",
    "drift": """with b as (select cast(greatest(0, least(9, floor(value / 500 * 10))) as integer) as bin, event_type from events where value is not null),
        c as (select bin, count(*) filter (event_type = 'purchase') as r, count(*) filter (event_type = 'signup') as c from b where event_type in ('purchase', 'signup') group by 1),
        s as (select greatest(r / (sum(r) over ()), 1e-4) as p, greatest(c / (sum(c) over ()), 1e-4) as q from c) select round(sum((q - p) * ln(q / p)), 6) as psi from s""",
    "fh_test": """with c as (select l_quantity as time, cast(count(*) filter (l_returnflag = 'R') as double) as d, cast(count(*) filter (l_returnflag = 'R' and l_linestatus = 'O') as double) as d1, cast(count(*) as double) as c, cast(count(*) filter (l_linestatus = 'O') as double) as c1 from lineitem group by 1),
        r as (select *, sum(c) over (order by time desc) as n, sum(c1) over (order by time desc) as n1 from c), k as (select *, product(1 - d / n) over (order by time) as s from r),
        b as (select *, coalesce(lag(s) over (order by time), 1.0) as b from k), g as (select *, sqrt(b) * sqrt(1 - b) as w from b),
        s as (select sum(w * d1) as observed, sum(w * d * n1 / n) as expected, sum(case when n > 1 then w * w * d * n1 / n * (1 - n1 / n) * (n - d) / (n - 1) else 0 end) as variance from g)
        select round(observed, 6) as observed, round(expected, 6) as expected, round(variance, 6) as variance, round((observed - expected) ** 2 / variance, 6) as chi_square from s""",
    "nnt": f"with {_CELLS}, e as (select l_linestatus, arg_max(s, time) as s, arg_max(s * sqrt(coalesce(g, 0)), time) as se from km where time <= 25 group by 1) select round(min(s) filter (l_linestatus = 'F'), 6) as low, round(min(s) filter (l_linestatus = 'O'), 6) as high, round(min(s) filter (l_linestatus = 'O') - min(s) filter (l_linestatus = 'F'), 6) as difference, round(sqrt(sum(se * se)), 6) as std_err from e",
    "after_landmark": """with c as (select l_quantity - 20 as time, cast(count(*) filter (l_returnflag = 'R') as double) as d, cast(count(*) as double) as c from lineitem where l_quantity > 20 group by 1),
        r as (select *, sum(c) over (order by time desc) as n from c) select time, n as n_risk, d as n_event, round(product(1 - d / n) over (order by time), 6) as surv from r""",
    "conditional": f"with {_CELLS} select l_linestatus, round(min(s) filter (time <= 30) / min(s) filter (time <= 10), 6) as surv from km group by 1",
    "condensed": """with e as (select l_orderkey, l_linenumber - 1 as start, l_linenumber as stop, case when l_returnflag = 'R' then 1 else 0 end as event from lineitem),
        n as (select *, case when lag(stop) over w = start and lag(event) over w = 0 then 0 else 1 end as fresh from e window w as (partition by l_orderkey order by start, stop, event)),
        r as (select *, sum(fresh) over (partition by l_orderkey order by start, stop, event, fresh rows unbounded preceding) as run from n)
        select l_orderkey, cast(min(start) as integer) as start, cast(max(stop) as integer) as stop, cast(max(event) as integer) as event from r group by l_orderkey, run""",
    "snapped": """with v as (select value, count(*) as n from events where value is not null group by 1), f as (select *, case when value - lag(value) over (order by value) <= 0.02 then 0 else 1 end as fresh from v),
        r as (select *, sum(fresh) over (order by value) as run from f) select min(value) as value, cast(sum(n) as bigint) as n from r group by run union all select null, count(*) from events where value is null having count(*) > 0""",
    "drift_ks": """with v as (select value, count(*) filter (event_type = 'purchase') as r, count(*) filter (event_type = 'signup') as c from events where value is not null and event_type in ('purchase', 'signup') group by 1),
        s as (select sum(r) over (order by value) / sum(r) over () as p, sum(c) over (order by value) / sum(c) over () as q from v) select round(max(abs(p - q)), 6) as ks from s""",
    "c_index": """with c as (select l_quantity as t, l_discount as x, count(*) as n, count(*) filter (l_returnflag = 'R') as e from lineitem group by 1, 2),
        p as (select a.e * case when b.t > a.t then b.n else b.n - b.e end as k, a.x as x, b.x as y from c a join c b on b.t >= a.t where a.e > 0),
        s as (select sum(case when x > y then k else 0 end) as u, sum(case when x < y then k else 0 end) as d, sum(case when x = y then k else 0 end) as s from p)
        select cast(u as bigint) as concordant, cast(d as bigint) as discordant, cast(s as bigint) as tied_risk, round((u + s / 2) / (u + d + s), 6) as c_index from s""",
    "meta": """with g as (select avg(l_discount) as e, stddev_samp(l_discount) / sqrt(count(*)) as se from lineitem group by l_suppkey), r as (select e, 1 / (se * se) as w from g where se > 0),
        f as (select count(*) as k, sum(w) as sw, sum(w * w) as sww, sum(w * e) / sum(w) as fixed from r), q as (select sum(w * (e - fixed) ** 2) as q from r, f),
        t as (select *, greatest(0, (q - (k - 1)) / (sw - sww / sw)) as tau2, greatest(0, (q - (k - 1)) / q) as i2 from f, q), v as (select e, 1 / (1 / w + tau2) as v from r, t), z as (select sum(v * e) / sum(v) as random, sqrt(1 / sum(v)) as random_std_err from v)
        select k, round(fixed, 6) as fixed, round(sqrt(1 / sw), 6) as fixed_std_err, round(q, 6) as q, round(tau2, 6) as tau2, round(i2, 6) as i2, round(random, 6) as random, round(random_std_err, 6) as random_std_err from t, z""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [km_by_group, na_by_group, km_median, km_rmst, actuarial, incidence, logrank_test, split_episodes, last_signup, type_changes, rates, brier, calibration, drift, fh_test, nnt, after_landmark, conditional, condensed, snapped, drift_ks, c_index, meta]
    return {f.__name__: f for f in [*found, *(f for m in MODULES for f in m.QUERIES)]}


def oracle_sql() -> dict[str, str]:
    return SQL | {k: v for m in MODULES for k, v in m.SQL.items()}

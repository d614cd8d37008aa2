"""Queries on predictions: scores, calibration, discrimination, decision curves, conformal bounds, effects, and their SQL.

Predictions are made from columns: p = l_quantity / 64 as a risk, s = exp(-l_discount * t) as a curve, l_discount as a marker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from censorium.operators import causal, conformal, explain, metrics

Q = dict(time="l_quantity", status="returned")
Z = 1.959963984540054


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_linestatus", "l_discount", "l_tax", "l_extendedprice", (F.col("l_returnflag") == "R").cast("int").alias("returned"))
    return rows.withColumns({"p": F.expr("nullif(l_quantity, 9) / 64"), "m": F.col("l_discount") + F.col("l_linenumber") / 100})


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")


def _r(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def brier_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null predictions and outcomes take no part in the score."""
    return metrics.brier_score(_lines(spark, sf_dir).withColumn("y", F.expr("nullif(returned, l_linenumber - 2)")), prediction="p", outcome="y", weight="l_linenumber").select(*_r("brier"))


def brier_censored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumn("s", F.array(*(F.exp(-F.col("l_discount") * t / 10) for t in (5.0, 20.0, 45.0))))
    out = metrics.censored_brier(rows, predictions="s", times=[5.0, 20.0, 45.0], **Q)
    return out.select("at", "n", *_r("brier"))


def brier_integrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.integrated_brier(brier_censored(spark, sf_dir), time="at", score="brier").select(F.round("integrated_brier", 5).alias("integrated_brier"))


def calibration_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.calibration_groups(_events(spark, sf_dir).withColumns({"p": F.col("value") / 500, "y": (F.col("event_type") == "purchase").cast("int")}).where("value is not null"), prediction="p", outcome="y", groups=7)
    return out.select("group", "n", *_r("predicted"), F.round("observed", 4).alias("observed"))


def calibration_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir)
    return metrics.calibration_summary(rows, prediction="p", outcome="returned").select("n", *_r("in_the_large", "slope", "intercept"), F.round("spiegelhalter_z", 4).alias("spiegelhalter_z"))


def strata_of_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.risk_groups(_lines(spark, sf_dir), risk="m", event="returned", groups=4).select("group", "n", *_r("event_rate", "median_risk"))


def calibration_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumn("s", F.exp(-F.col("l_quantity") / 25))
    return metrics.distribution_calibration(rows, prediction="s", status="returned").select("n", F.round("chi_square", 4).alias("chi_square"), "df")


def drift_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumns({"a": F.when(F.col("event_id") % 7 != 0, F.col("value")), "b": (F.col("user_id") % 97).cast("double")})
    return metrics.pooled_stability(rows.where("event_type = 'purchase'"), rows.where("event_type = 'signup'"), columns=["a", "b"]).select("feature", F.round("psi", 8).alias("psi"), "severity")


def drift_ks_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    return metrics.kolmogorov_smirnov(rows.where("event_type = 'purchase'"), rows.where("event_type = 'signup'"), column="value", with_p=True).select(*_r("ks", "p"))


def c_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.concordance(_lines(spark, sf_dir), risk="m", keys=["l_linestatus", "l_tax"], **Q).select("concordant", "discordant", "tied_risk", "tied_time", "tied_both", *_r("c_index"))


def c_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir)
    out = None
    for kind in ("S", "S/G", "n/G2", "I"):
        one = metrics.concordance(rows, risk="l_discount", weight="l_linenumber", time_weight=kind, **Q).select(F.lit(kind).alias("kind"), F.round("c_index", 6).alias("c_index"))
        out = one if out is None else out.union(one)
    return out


def c_uno(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.compare_concordance(_lines(spark, sf_dir), risk_1="l_discount", risk_2="m", tau=40.0, **Q).select(*_r("c_1", "c_2", "difference"))


def c_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.concordance_parts(_lines(spark, sf_dir), risk="l_discount", **Q).select("part", "concordant", "discordant", "tied_risk", *_r("c_index"))


def c_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.truncated_concordance(_lines(spark, sf_dir), risk="l_discount", landmark=10.0, horizon=30.0, **Q).select("concordant", "discordant", "tied_risk", *_r("c_index"))


def roc_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc_area(_lines(spark, sf_dir), score="l_extendedprice", label="returned").select(*_r("auc", "threshold", "youden"))


def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc(_lines(spark, sf_dir), score="m", label="returned").select(F.round("threshold", 4).alias("threshold"), "true_positive", "false_positive", *_r("tpr", "fpr"))


def auc_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir)
    a = metrics.auc_at(rows, marker="m", times=[10.0, 30.0], **Q).select("at", "n_cases", "n_controls", *_r("auc", "std_err"))
    b = metrics.auc_at(rows, marker="m", times=[10.0, 30.0], censored=False, **Q).select("at", F.round("auc", 6).alias("plain"))
    return a.join(b, "at")


def auc_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.integrated_auc(metrics.auc_at(_lines(spark, sf_dir), marker="l_discount", times=[10.0, 15.0, 30.0], censored=False, **Q)).select(*_r("mean_auc", "integrated_auc"))


def net_benefit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.decision_curve(_lines(spark, sf_dir), prediction="p", horizon=30.0, thresholds=[0.1, 0.2, 0.5], **Q)
    return out.select("threshold", *_r("net_benefit", "net_benefit_all", "interventions_avoided"))


def net_benefit_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).where("p is not null")
    return metrics.compare_decision_curves(rows, predictions=["p", "l_discount", "m"], horizon=30.0, thresholds=[0.05, 0.1], **Q).select("model_1", "model_2", *_r("mean_difference"))


def utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.utility_at(_lines(spark, sf_dir), prediction="p", horizon=30.0, threshold=0.25, **Q).select("tp", "fp", "fn", "tn", *_r("sensitivity", "specificity", "ppv", "npv", "net_benefit"))


def log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumn("s", F.array(*(F.exp(-F.col("l_discount") * t / 10) for t in (5.0, 20.0, 45.0))))
    return metrics.log_likelihood_loss(rows, predictions="s", times=[5.0, 20.0, 45.0], **Q).select("n_events", "n_censored", F.round("mean_loss", 6).alias("mean_loss"))


def by_subgroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.subgroups(_lines(spark, sf_dir), risk="m", group="l_tax", **Q).select("l_tax", "n", *_r("event_rate", "c_index"))


def by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumn("period", F.col("l_orderkey") % 4)
    return metrics.performance_by_period(rows, risk="m", period="period", threshold=0.001, **Q).select("period", "n", *_r("c_index", "change"), "degraded")


def fairness_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.fairness(_lines(spark, sf_dir), risk="m", group="l_tax", horizon=30.0, **Q).select("groups", *_r("demographic_parity", "equal_opportunity", "c_index_gap"))


def model_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = _lines(spark, sf_dir).groupBy("l_tax").agg((-F.sum("l_discount")).alias("ll"), F.count("*").alias("rows"), F.sum("returned").alias("events")).withColumn("k", F.col("l_tax") * 100 + 1).withColumn("ll", F.col("ll") / 50)
    return metrics.information_criteria(fits, log_likelihood="ll", parameters="k", rows="rows", events="events").select("l_tax", *_r("aic", "bic", "aicc", "bic_events", "delta_aic", "akaike_weight"))


def meta_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    studies = _lines(spark, sf_dir).groupBy("l_tax").agg(F.avg("l_discount").alias("effect"), (F.stddev_samp("l_discount") / F.sqrt(F.count("*"))).alias("se")).withColumn("name", F.round(F.col("l_tax") * 100).cast("int"))
    return metrics.forest(studies, study="name", effect="effect", std_err="se").select("study", *_r("effect", "lower", "upper", "weight"))


def meta_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    studies = _lines(spark, sf_dir).groupBy("l_suppkey").agg(F.avg("l_discount").alias("effect"), (F.stddev_samp("l_discount") / F.sqrt(F.count("*"))).alias("se"))
    return metrics.small_study_test(studies, effect="effect", std_err="se").select("k", *_r("intercept", "std_err", "t"), "df")


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).withColumn("guess", 20 + F.col("l_discount") * 100 + F.col("l_linenumber"))


def conformal_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = conformal.calibrate(_times(spark, sf_dir), prediction="guess", weighted=False, **Q)
    return a.select("n", *_r("threshold", "n_effective"))


def conformal_two_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _times(spark, sf_dir)
    cal = conformal.calibrate_two_sided(rows.where("l_orderkey % 2 = 0"), prediction="guess", coverage=0.8, **Q)
    test = conformal.two_sided_bounds(rows.where("l_orderkey % 2 = 1"), cal, prediction="guess")
    return conformal.coverage(test, lower="lower_bound", upper="upper_bound", **Q).select("n_events", *_r("coverage", "mean_lower", "mean_width", "coverage_lower", "coverage_upper"))


def conformal_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _times(spark, sf_dir)
    cal = conformal.calibrate_by_group(rows, prediction="guess", group="l_tax", least=10, **Q)
    return conformal.bounds_by_group(rows, cal, prediction="guess", group="l_tax").groupBy("l_tax").agg(F.round(F.avg("lower_bound"), 6).alias("mean_lower"))


def effect_of_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumn("t", (F.col("l_linestatus") == "F").cast("int"))
    a = causal.weighted_difference(rows, outcome="l_quantity", treatment="t", weight="l_linenumber").select(*_r("treated", "control", "difference", "std_err"))
    b = causal.weighted_incidence(rows, weight="l_linenumber", times=[25.0], **Q).select(F.round("surv", 6).alias("surv"))
    return a.crossJoin(b)  # one row each


def least_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of a linear fit on one covariate."""
    fit = causal.linear_fit(_lines(spark, sf_dir), outcome="l_extendedprice", x=["l_quantity"])
    return spark.createDataFrame([(float(fit.coefficients[0]), float(fit.coefficients[1]))], "intercept double, slope double").select(F.round("intercept", 3).alias("intercept"), F.round("slope", 4).alias("slope"))


def effect_accumulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.accumulated_effect(_lines(spark, sf_dir), feature="l_quantity", prediction="m", bins=4).select("bin", "edge", "n", *_r("effect"))


def effect_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumn("y", F.col("l_quantity") * F.col("l_discount") + F.col("l_tax"))
    return explain.interaction(rows, feature_1="l_quantity", feature_2="l_discount", prediction="y", bins=4).select(*_r("h2"))


def series_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("v", F.when(F.col("event_id") > 5000 + F.col("user_id") % 3 * 500, 10.0).otherwise(1.0) + F.col("value") / 100)
    return explain.change_point(rows.withColumn("k", F.col("user_id") % 3), order="event_id", value="v", keys=["k"]).select("k", "at", F.round("gain", 2).alias("gain"))


_L = "l as (select *, case when l_returnflag = 'R' then 1 else 0 end as returned, nullif(l_quantity, 9) / 64 as p, l_discount + l_linenumber / 100 as m from lineitem)"
_G = "gc as (select l_quantity as t, cast(sum(returned) as double) as d, cast(sum(1 - returned) as double) as c from l group by 1), gn as (select *, sum(d + c) over (order by t desc) as n from gc), g as (select t, product(case when n - d > 0 then 1 - c / (n - d) else 1 end) over (order by t) as g, product(1 - c / n) over (order by t) as g2 from gn)"


def _pairs(risk: str, where: str = "true", by: str = "", event: str = "a.e", other: str = "case when b.t > a.t then b.n else b.n - b.e end") -> str:
    cols = f"{by}, " if by else ""
    on = "".join(f" and a.{k.strip()} = b.{k.strip()}" for k in by.split(",")) if by else ""
    return f"""cc as (select {cols}l_quantity as t, {risk} as x, cast(count(*) as double) as n, cast(sum(returned) as double) as e from l where {where} group by all),
pp as (select {'a.' + by + ', ' if by and ',' not in by else ''}{event} * {other} as k, a.x as x, b.x as y from cc a join cc b on b.t >= a.t{on} where a.e > 0)"""


_COUNTS = "sum(case when x > y then k else 0 end) as u, sum(case when x < y then k else 0 end) as v, sum(case when x = y then k else 0 end) as s"

SQL = {
    "brier_nulls": f"with {_L}, r as (select p, nullif(returned, l_linenumber - 2) as y, l_linenumber as w from l) select round(sum(w * (p - y) ** 2) / sum(w), 6) as brier from r where p is not null and y is not null",
    "brier_censored": f"""with {_L}, {_G}, t as (select cast(unnest([5.0, 20.0, 45.0]) as double) as at_), r as (select at_, l_quantity as t, returned as d, exp(-l_discount * at_ / 10) as s from l, t where returned = 1 or l_quantity >= at_),
        w as (select at_, case when d = 1 and t <= at_ then 0.0 else 1.0 end as y, s, case when d = 1 and t <= at_ then coalesce((select arg_max(g, t) from g where g.t < r.t), 1.0) else coalesce((select arg_max(g, t) from g where g.t <= r.at_), 1.0) end as g from (select distinct at_, t, d, s, count(*) over (partition by at_, t, d, s) as c from r) r),
        x as (select r.at_, r.t, r.d, r.s, count(*) as c from r group by all), z as (select x.*, case when d = 1 and x.t <= at_ then 0.0 else 1.0 end as y, case when d = 1 and x.t <= at_ then coalesce((select arg_max(g, g.t) from g where g.t < x.t), 1.0) else coalesce((select arg_max(g, g.t) from g where g.t <= x.at_), 1.0) end as gg from x)
        select at_ as "at", cast(sum(c) as bigint) as n, round(sum(c / gg * (s - y) ** 2) / sum(c / gg), 6) as brier from z group by 1""",
    "calibration_by_count": """with r as (select value / 500 as p, case when event_type = 'purchase' then 1.0 else 0.0 end as y from events where value is not null), q as (select p, avg(y) over (partition by p) as y, row_number() over (order by p) - 1 as i, count(*) over () as n from r),
        g as (select *, case when i < (n % 7) * (n // 7 + 1) then i // (n // 7 + 1) else n % 7 + (i - (n % 7) * (n // 7 + 1)) // (n // 7) end as gr from q) select cast(gr as integer) as "group", count(*) as n, round(avg(p), 6) as predicted, round(avg(y), 4) as observed from g group by 1""",
    "calibration_fit": f"with {_L}, r as (select p, cast(returned as double) as y from l where p is not null) select count(*) as n, round(avg(y) - avg(p), 6) as in_the_large, round(regr_slope(y, p), 6) as slope, round(regr_intercept(y, p), 6) as intercept, round(sum((y - p) * (1 - 2 * p)) / sqrt(sum((1 - 2 * p) ** 2 * p * (1 - p))), 4) as spiegelhalter_z from r",
    "strata_of_risk": f"""with {_L}, o as (select m, returned, row_number() over (order by m) - 1 as i, count(*) over () as n from l), c as (select min(m) filter (i = n // 4) as a, min(m) filter (i = n * 2 // 4) as b, min(m) filter (i = n * 3 // 4) as c from o),
        g as (select m, returned, case when m >= c.c then 3 when m >= c.b then 2 when m >= c.a then 1 else 0 end as gr from l, c), k as (select *, row_number() over (partition by gr order by m) - 1 as i, count(*) over (partition by gr) as n from g)
        select gr as "group", count(*) as n, round(avg(returned), 6) as event_rate, round(min(m) filter (i = n // 2), 6) as median_risk from k group by 1""",
    "calibration_distribution": f"with {_L}, b as (select greatest(0, least(9, floor(exp(-l_quantity / 25) * 10))) as b, cast(count(*) as double) as c from l where returned = 1 group by 1) select cast(sum(c) as bigint) as n, round(10 * sum(c * c) / sum(c) - sum(c), 4) as chi_square, 9 as df from b",
    "drift_pooled": """with e as (select event_type, case when event_id % 7 <> 0 then value end as a, cast(user_id % 97 as double) as b from events where event_type in ('purchase', 'signup')), s as (select 'a' as feature, event_type, a as v from e where a is not null union all select 'b', event_type, b from e where b is not null),
        r as (select feature, min(v) as lo, max(v) as hi from s group by 1), p as (select s.feature, event_type, cast(least(9, floor((v - lo) / ((hi - lo) / 10))) as integer) as bin from s join r using (feature)), t as (select feature, count(*) filter (event_type = 'purchase') as nr, count(*) filter (event_type = 'signup') as nc from p group by 1),
        g as (select t.*, b from t, (select unnest(range(10)) as b)), c as (select g.*, (select count(*) from p where p.feature = g.feature and p.bin = g.b and event_type = 'purchase') as r, (select count(*) from p where p.feature = g.feature and p.bin = g.b and event_type = 'signup') as c from g),
        x as (select feature, (r + 0.001) / (nr + 0.01) as p, (c + 0.001) / (nc + 0.01) as q from c), y as (select feature, sum((q - p) * ln(q / p)) as psi from x group by 1) select feature, round(psi, 8) as psi, case when psi < 0.1 then 'none' when psi < 0.2 then 'low' when psi < 0.3 then 'moderate' else 'high' end as severity from y""",
    "drift_ks_p": """with v as (select value, count(*) filter (event_type = 'purchase') as r, count(*) filter (event_type = 'signup') as c from events where value is not null and event_type in ('purchase', 'signup') group by 1),
        s as (select sum(r) over (order by value) / sum(r) over () as p, sum(c) over (order by value) / sum(c) over () as q, sum(r) over () as a, sum(c) over () as b from v), k as (select max(abs(p - q)) as ks, sqrt(max(a) * max(b) / (max(a) + max(b))) as en from s) select round(ks, 6) as ks, round(greatest(0.0, least(1.0, 2 * exp(-2 * ((en + 0.12 + 0.11 / en) * ks) ** 2))), 6) as p from k""",
    "c_strata": f"""with {_L}, {_pairs('m', by='l_linestatus, l_tax')}, z as (select {_COUNTS} from pp), y as (select l_linestatus, l_tax, t, sum(e) as e, sum(e * (e - 1) / 2) as w from cc group by all), q as (select sum(e * (e - 1) / 2 - w) as tt, sum(w) as tb from y)
        select cast(u as bigint) as concordant, cast(v as bigint) as discordant, cast(s as bigint) as tied_risk, cast(tt as bigint) as tied_time, cast(tb as bigint) as tied_both, round((u + s / 2) / (u + v + s), 6) as c_index from z, q""",
    "c_weights": f"""with {_L}, wc as (select l_quantity as t, cast(sum(returned * l_linenumber) as double) as d, cast(sum((1 - returned) * l_linenumber) as double) as c from l group by 1), wn as (select *, sum(d + c) over (order by t desc) as n, sum(d + c) over () as w from wc),
        ws as (select *, product(1 - d / n) over (order by t) as s, product(case when n - d > 0 then 1 - c / (n - d) else 1 end) over (order by t) as g from wn), wb as (select t, n, w, coalesce(lag(s) over (order by t), 1.0) as s, coalesce(lag(g) over (order by t), 1.0) as g from ws),
        cc as (select l_quantity as t, l_discount as x, cast(sum(l_linenumber) as double) as n, cast(sum(returned * l_linenumber) as double) as e from l group by all),
        pp as (select a.t, a.e * case when b.t > a.t then b.n else b.n - b.e end as k, a.x, b.x as y from cc a join cc b on b.t >= a.t where a.e > 0), s as (select t, {_COUNTS} from pp group by 1),
        k as (select 'S' as kind, u, v, s.s as ts, wb.w * wb.s / n as f from s join wb using (t) union all select 'S/G', u, v, s.s, wb.w * wb.s / (wb.g * n) from s join wb using (t) union all select 'n/G2', u, v, s.s, 1 / wb.g / wb.g from s join wb using (t) union all select 'I', u, v, s.s, 1 / n from s join wb using (t))
        select kind, round(sum(f * (u + ts / 2)) / sum(f * (u + v + ts)), 6) as c_index from k group by 1""",
    "c_uno": f"""with {_L}, {_G}, cc as (select l_quantity as t, l_discount as x, m, cast(count(*) as double) as n, cast(sum(returned) as double) as e from l group by all), pp as (select a.e * b.n / greatest(0.01, g.g2) ** 2 as k, a.x as x1, b.x as y1, a.m as x2, b.m as y2 from cc a join cc b on b.t > a.t join g on g.t = a.t where a.e > 0 and a.t <= 40),
        z as (select sum(k * case when x1 > y1 then 1 when x1 = y1 then 0.5 else 0 end) / sum(k) as a, sum(k * case when x2 > y2 then 1 when x2 = y2 then 0.5 else 0 end) / sum(k) as b from pp) select round(a, 6) as c_1, round(b, 6) as c_2, round(a - b, 6) as difference from z""",
    "c_parts": f"""with {_L}, cc as (select l_quantity as t, l_discount as x, cast(count(*) as double) as n, cast(sum(returned) as double) as e from l group by all), pp as (select 'events' as part, a.e * b.e as k, a.x as x, b.x as y from cc a join cc b on b.t > a.t where a.e > 0 union all select 'censored', a.e * (b.n - b.e), a.x, b.x from cc a join cc b on b.t >= a.t where a.e > 0),
        z as (select part, {_COUNTS} from pp group by 1) select part, cast(u as bigint) as concordant, cast(v as bigint) as discordant, cast(s as bigint) as tied_risk, round((u + s / 2) / (u + v + s), 6) as c_index from z""",
    "c_truncated": f"""with {_L}, cc as (select least(l_quantity, 30.0) as t, l_discount as x, cast(count(*) as double) as n, cast(sum(case when l_quantity <= 30 then returned else 0 end) as double) as e from l where l_quantity > 10 group by all), pp as (select a.e * case when b.t > a.t then b.n else b.n - b.e end as k, a.x as x, b.x as y from cc a join cc b on b.t >= a.t where a.e > 0),
        z as (select {_COUNTS} from pp) select cast(u as bigint) as concordant, cast(v as bigint) as discordant, cast(s as bigint) as tied_risk, round((u + s / 2) / (u + v + s), 6) as c_index from z""",
    "roc_best": f"""with {_L}, c as (select l_extendedprice as x, cast(sum(returned) as double) as p, cast(sum(1 - returned) as double) as n from l group by 1), r as (select *, sum(n) over (order by x) - n as below, sum(p) over (order by x desc) as tp, sum(n) over (order by x desc) as fp, sum(p) over () as tp_, sum(n) over () as n_ from c),
        y as (select *, tp / tp_ - fp / n_ as y from r) select round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) as auc, round((select max(x) from y where y = (select max(y) from y)), 6) as threshold, round(max(y), 6) as youden from y""",
    "roc_points": f"with {_L}, c as (select m as x, cast(sum(returned) as double) as p, cast(sum(1 - returned) as double) as n from l group by 1), r as (select x, sum(p) over w as tp, sum(n) over w as fp, sum(p) over () as a, sum(n) over () as b from c window w as (order by x desc)) select round(x, 4) as threshold, tp as true_positive, fp as false_positive, round(tp / a, 6) as tpr, round(fp / b, 6) as fpr from r",
    "auc_times": f"""with {_L}, {_G}, t as (select cast(unnest([10.0, 30.0]) as double) as a), r as (select t.a, l.m, sum(case when returned = 1 and l_quantity <= a then 1 / greatest(0.01, g.g2) else 0 end) as p, cast(count(*) filter (returned = 1 and l_quantity <= a) as double) as k, cast(count(*) filter (l_quantity > a) as double) as n from l join g on g.t = l_quantity, t group by all),
        s as (select *, sum(n) over (partition by a order by m) - n as below from r), z as (select a, sum(p * (below + n / 2)) / (sum(p) * sum(n)) as auc, sum(k * (below + n / 2)) / (sum(k) * sum(n)) as plain, sum(k) as nc, sum(n) as nn from s group by 1)
        select a as "at", cast(nc as bigint) as n_cases, cast(nn as bigint) as n_controls, round(auc, 6) as auc, round(sqrt(auc * (1 - auc) / sqrt(nc * nn)), 6) as std_err, round(plain, 6) as plain from z""",
    "auc_mean": f"""with {_L}, t as (select cast(unnest([10.0, 15.0, 30.0]) as double) as a), r as (select a, l_discount as m, cast(count(*) filter (returned = 1 and l_quantity <= a) as double) as k, cast(count(*) filter (l_quantity > a) as double) as n from l, t group by all), s as (select *, sum(n) over (partition by a order by m) - n as below from r),
        z as (select a, sum(k * (below + n / 2)) / (sum(k) * sum(n)) as auc from s group by 1), d as (select *, a - lag(a) over (order by a) as dt, (auc + lag(auc) over (order by a)) / 2 as md from z) select round(avg(auc), 6) as mean_auc, round(sum(dt * md) / sum(dt), 6) as integrated_auc from d""",
    "net_benefit": f"""with {_L}, t as (select cast(unnest([0.1, 0.2, 0.5]) as double) as t), r as (select p, case when returned = 1 and l_quantity <= 30 then 1.0 else 0.0 end as y from l where p is not null), s as (select t, cast(count(*) as double) as n, sum(y) as yy, sum(case when p >= t then y else 0 end) as tp, sum(case when p >= t then 1 - y else 0 end) as fp from r, t group by 1),
        b as (select t, tp / n - fp / n * t / (1 - t) as nb, yy / n - (n - yy) / n * t / (1 - t) as al from s) select t as threshold, round(nb, 6) as net_benefit, round(al, 6) as net_benefit_all, round(case when al > 0 then greatest(0.0, (nb - al) / al) else 0 end, 6) as interventions_avoided from b""",
    "net_benefit_models": f"""with {_L}, t as (select cast(unnest([0.05, 0.1]) as double) as t), r as (select p, l_discount as q, m, case when returned = 1 and l_quantity <= 30 then 1.0 else 0.0 end as y from l where p is not null),
        b as (select t, avg(case when p >= t then y - (1 - y) * t / (1 - t) else 0 end) as a, avg(case when q >= t then y - (1 - y) * t / (1 - t) else 0 end) as b, avg(case when m >= t then y - (1 - y) * t / (1 - t) else 0 end) as c from r, t group by 1)
        select 'p' as model_1, 'l_discount' as model_2, round(avg(a - b), 6) as mean_difference from b union all select 'p', 'm', round(avg(a - c), 6) from b union all select 'l_discount', 'm', round(avg(b - c), 6) from b""",
    "utility": f"""with {_L}, r as (select p >= 0.25 as f, returned = 1 and l_quantity <= 30 as y from l where p is not null), c as (select cast(count(*) filter (f and y) as double) as tp, cast(count(*) filter (f and not y) as double) as fp, cast(count(*) filter (not f and y) as double) as fn, cast(count(*) filter (not f and not y) as double) as tn from r)
        select *, round(tp / (tp + fn), 6) as sensitivity, round(tn / (tn + fp), 6) as specificity, round(tp / (tp + fp), 6) as ppv, round(tn / (tn + fn), 6) as npv, round(tp / (tp + fp + fn + tn) - fp / (tp + fp + fn + tn) / 3, 6) as net_benefit from c""",
    "log_loss": f"""with {_L}, r as (select returned as d, l_quantity as t, exp(-l_discount * 0.5) as a, exp(-l_discount * 2.0) as b, exp(-l_discount * 4.5) as c from l), k as (select d, case when d = 1 then case when t <= 5 then 1 - a when t <= 20 then a - b else b - c end else case when t < 5 then 1.0 when t < 20 then a when t < 45 then b else c end end as v from r)
        select cast(sum(d) as bigint) as n_events, cast(sum(1 - d) as bigint) as n_censored, round(avg(-ln(greatest(1e-7, v))), 6) as mean_loss from k""",
    "by_subgroup": f"""with {_L}, {_pairs('m', by='l_tax')}, z as (select l_tax, {_COUNTS} from pp group by 1), n as (select l_tax, count(*) as n, avg(returned) as r from l group by 1) select l_tax, n, round(r, 6) as event_rate, round((u + s / 2) / (u + v + s), 6) as c_index from z join n using (l_tax)""",
    "by_period": f"""with l as (select *, l_orderkey % 4 as period, case when l_returnflag = 'R' then 1 else 0 end as returned, l_discount + l_linenumber / 100 as m from lineitem), {_pairs('m', by='period')}, z as (select period, {_COUNTS} from pp group by 1), c as (select period, (u + s / 2) / (u + v + s) as c from z), f as (select arg_min(c, period) as f from c)
        select period, (select count(*) from l where l.period = c.period) as n, round(c, 6) as c_index, round(c - f, 6) as change, c - f < -0.001 as degraded from c, f""",
    "fairness_gaps": f"""with {_L}, o as (select m, row_number() over (order by m) - 1 as i, count(*) over () as n from l), md as (select min(m) filter (i = n // 2) as md from o), g as (select l_tax, avg(case when m > md then 1.0 else 0 end) as h, sum(case when m > md and returned = 1 and l_quantity <= 30 then 1.0 else 0 end) / sum(case when returned = 1 and l_quantity <= 30 then 1.0 else 0 end) as t from l, md group by 1),
        {_pairs('m', by='l_tax')}, z as (select l_tax, {_COUNTS} from pp group by 1), c as (select max((u + s / 2) / (u + v + s)) - min((u + s / 2) / (u + v + s)) as c from z) select count(*) as groups, round(max(h) - min(h), 6) as demographic_parity, round(max(t) - min(t), 6) as equal_opportunity, round(max(c), 6) as c_index_gap from g, c""",
    "model_choice": f"""with {_L}, f as (select l_tax, -sum(l_discount) / 50 as ll, count(*) as n, sum(returned) as e, l_tax * 100 + 1 as k from l group by l_tax), a as (select *, 2 * k - 2 * ll as aic, k * ln(n) - 2 * ll as bic, k * ln(e) - 2 * ll as bic_events from f), d as (select *, aic + 2 * k * (k + 1) / (n - k - 1) as aicc, aic - min(aic) over () as d from a)
        select l_tax, round(aic, 6) as aic, round(bic, 6) as bic, round(aicc, 6) as aicc, round(bic_events, 6) as bic_events, round(d, 6) as delta_aic, round(exp(-d / 2) / sum(exp(-d / 2)) over (), 6) as akaike_weight from d""",
    "meta_forest": f"""with g as (select cast(cast(round(l_tax * 100) as integer) as varchar) as study, avg(l_discount) as e, stddev_samp(l_discount) / sqrt(count(*)) as se from lineitem group by l_tax), f as (select count(*) as k, sum(1 / se / se) as sw, sum(1 / se ** 4) as sww, sum(e / se / se) / sum(1 / se / se) as fixed from g), q as (select sum((e - fixed) ** 2 / se / se) as q from g, f),
        t as (select greatest(0, (q - (k - 1)) / (sw - sww / sw)) as tau2 from f, q), r as (select sum(e / (se * se + tau2)) / sum(1 / (se * se + tau2)) as m, sqrt(1 / sum(1 / (se * se + tau2))) as rs from g, t)
        select study, round(e, 6) as effect, round(e - {Z} * se, 6) as lower, round(e + {Z} * se, 6) as upper, round(rs * rs / (se * se + tau2), 6) as weight from g, t, r union all select 'pooled', round(m, 6), round(m - {Z} * rs, 6), round(m + {Z} * rs, 6), 1.0 from r""",
    "meta_bias": """with g as (select avg(l_discount) as e, stddev_samp(l_discount) / sqrt(count(*)) as se from lineitem group by l_suppkey), x as (select 1 / se as x, e / se as y from g where se > 0), r as (select count(*) as k, regr_slope(y, x) as b, regr_intercept(y, x) as a, regr_sxx(y, x) as sxx, regr_syy(y, x) as syy, regr_sxy(y, x) as sxy, sum(x * x) as xx from x),
        s as (select *, sqrt((syy - b * sxy) / (k - 2) * xx / (k * sxx)) as se from r) select k, round(a, 6) as intercept, round(se, 6) as std_err, round(a / se, 6) as t, k - 2 as df from s""",
    "conformal_threshold": f"""with {_L}, s as (select l_quantity - (20 + l_discount * 100 + l_linenumber) as v from l where returned = 1), g as (select v, cast(count(*) as double) as w from s group by 1), r as (select *, sum(w) over (order by v) as c, lag(v) over (order by v) as pv, sum(w) over () as n from g), t as (select *, least(1.0, (1 - 0.9) * (1 + 1 / n)) * n as tg from r),
        f as (select * from t where c >= tg - 1e-12 order by v limit 1) select cast(n as bigint) as n, round(case when pv is null or abs(c - tg) < 1e-10 then v else pv + (tg - (c - w)) / w * (v - pv) end, 6) as threshold, round(n, 6) as n_effective from f""",
    "conformal_two_sided": f"""with {_L}, x as (select *, 20 + l_discount * 100 + l_linenumber as guess from l), s as (select 1 as k, guess - l_quantity as v from x where returned = 1 and l_orderkey % 2 = 0 union all select 2, l_quantity - guess from x where returned = 1 and l_orderkey % 2 = 0), g as (select k, v, cast(count(*) as double) as w from s group by all),
        r as (select *, sum(w) over (partition by k order by v) as c, lag(v) over (partition by k order by v) as pv, sum(w) over (partition by k) as n from g), t as (select *, least(1.0, (1 - (1 - 0.8) / 2) * (n + 1) / n) * n as tg from r), f as (select k, arg_min(case when pv is null or abs(c - tg) < 1e-10 then v else pv + (tg - (c - w)) / w * (v - pv) end, v) as q from t where c >= tg - 1e-12 group by 1),
        b as (select l_quantity as t, returned as d, greatest(0.0, guess - (select q from f where k = 1)) as lo, guess + (select q from f where k = 2) as hi from x where l_orderkey % 2 = 1), c as (select count(*) filter (d = 1) as n, avg(case when t >= lo and t <= hi then 1.0 else 0.0 end) filter (d = 1) as c, avg(lo) as ml, avg(hi - lo) as mw from b)
        select n as n_events, round(c, 6) as coverage, round(ml, 6) as mean_lower, round(mw, 6) as mean_width, round(greatest(0.0, c - {Z} * sqrt(c * (1 - c) / n)), 6) as coverage_lower, round(least(1.0, c + {Z} * sqrt(c * (1 - c) / n)), 6) as coverage_upper from c""",
    "conformal_groups": f"""with {_L}, x as (select *, 20 + l_discount * 100 + l_linenumber as guess from l), g as (select l_tax, l_quantity - guess as v, cast(count(*) as double) as w from x where returned = 1 group by all), r as (select *, sum(w) over (partition by l_tax order by v) as c, lag(v) over (partition by l_tax order by v) as pv, sum(w) over (partition by l_tax) as n from g), t as (select *, least(1.0, (1 - 0.9) * (1 + 1 / n)) * n as tg from r),
        f as (select l_tax, arg_min(case when pv is null or abs(c - tg) < 1e-10 then v else pv + (tg - (c - w)) / w * (v - pv) end, v) as q from t where c >= tg - 1e-12 group by 1) select l_tax, round(avg(greatest(0.0, guess - q)), 6) as mean_lower from x join f using (l_tax) group by 1""",
    "effect_of_weights": f"""with {_L}, s as (select l_linestatus = 'F' as t, sum(l_linenumber) as w, sum(l_linenumber * l_quantity) as y, sum(l_linenumber * l_quantity ** 2) as q, sum(l_linenumber ** 2) as v from l group by 1), b as (select max(y / w) filter (t) as a, max(y / w) filter (not t) as b, sqrt(sum((q / w - (y / w) ** 2) * v / w / w)) as se from s)
        select round(a, 6) as treated, round(b, 6) as control, round(a - b, 6) as difference, round(se, 6) as std_err, (select round(1 - sum(case when l_quantity <= 25 then returned * l_linenumber else 0 end) / sum(l_linenumber), 6) from l) as surv from b""",
    "least_squares": "select round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept, round(regr_slope(l_extendedprice, l_quantity), 4) as slope from lineitem",
    "effect_accumulated": f"""with {_L}, q as (select quantile_cont(l_quantity, [0.0, 0.25, 0.5, 0.75, 1.0]) as q from l), b as (select least(case when l_quantity >= q[4] then 3 when l_quantity >= q[3] then 2 when l_quantity >= q[2] then 1 else 0 end, 3) as b, count(*) as n, avg(m) as m from l, q group by 1), c as (select b as bin, (select q[b.b + 2] from q) as edge, n, sum(m) over (order by b) as e from b),
        u as (select cast(bin as integer) as bin, edge, n, e from c union all select -1, (select q[1] from q), 0, 0.0) select bin, edge, n, round(e - avg(e) over (), 6) as effect from u""",
    "effect_interaction": f"""with {_L}, q as (select quantile_cont(l_quantity, [0.25, 0.5, 0.75]) as a, quantile_cont(l_discount, [0.25, 0.5, 0.75]) as b from l), r as (select l_quantity * l_discount + l_tax as y, case when l_quantity >= a[3] then 3 when l_quantity >= a[2] then 2 when l_quantity >= a[1] then 1 else 0 end as i, case when l_discount >= b[3] then 3 when l_discount >= b[2] then 2 when l_discount >= b[1] then 1 else 0 end as j from l, q),
        c as (select i, j, count(*) as n, avg(y) as m from r group by all), x as (select i, avg(y) as m from r group by 1), z as (select j, avg(y) as m from r group by 1), g as (select avg(y) as g from r) select round(sum(n * (c.m - x.m - z.m + g) ** 2) / sum(n * (c.m - g) ** 2), 6) as h2 from c join x using (i) join z using (j), g""",
    "series_change": """with r as (select user_id % 3 as k, cast(event_id as double) as t, case when event_id > 5000 + user_id % 3 * 500 then 10.0 else 1.0 end + value / 100 as v from events where value is not null), s as (select k, t, sum(v) over w as s, count(*) over w as n, sum(v) over (partition by k) as tv, count(*) over (partition by k) as tn from r window w as (partition by k order by t)),
        g as (select k, t, s * s / n + (tv - s) ** 2 / (tn - n) - tv * tv / tn as g from s where n < tn), m as (select k, max(g) as g from g group by 1) select g.k, min(g.t) as "at", round(max(g.g), 2) as gain from g join m on m.k = g.k and g.g = m.g group by 1""",
}
SQL["brier_integrated"] = f"with b as ({SQL['brier_censored']}) select round((15 * max(brier) filter (\"at\" = 5) + 20 * max(brier) filter (\"at\" = 20) + 25 * max(brier) filter (\"at\" = 45)) / 60, 5) as integrated_brier from b"

QUERIES = [brier_nulls, brier_censored, brier_integrated, calibration_by_count, calibration_fit, strata_of_risk, calibration_distribution, drift_pooled, drift_ks_p, c_strata, c_weights, c_uno, c_parts, c_truncated, roc_best, roc_points, auc_times, auc_mean, net_benefit, net_benefit_models, utility, log_loss, by_subgroup, by_period, fairness_gaps, model_choice, meta_forest, meta_bias, conformal_threshold, conformal_two_sided, conformal_groups, effect_of_weights, least_squares, effect_accumulated, effect_interaction, series_change]

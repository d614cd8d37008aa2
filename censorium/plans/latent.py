"""Queries on cure models, and their SQL: likelihoods at given coefficients, and a fit that SQL makes by EM."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from censorium.operators import cure
from censorium.plans.inference import Q, _r

#: Returns count up to this quantity only, so the curve has a plateau.
PLATEAU = 15
#: Rounds of the SQL.
ROUNDS = 1500


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_quantity", "l_linestatus", "l_discount", (F.col("l_returnflag") == "R").cast("int").alias("returned"))
    return rows.withColumn("early", F.when(F.col("l_quantity") <= PLATEAU, F.col("returned")).otherwise(0))


def _means(got: DataFrame, n: int, *keys: str) -> DataFrame:
    return got.select(*keys, F.round("n", 6).alias("n"), *(F.round(F.col(c) / F.col("n"), 6).alias(c) for c in ("ll", *(f"u{i}" for i in range(n)))))


def cure_mixture_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = cure.cure_score(_lines(spark, sf_dir), cure=[0.3, -2.0], location=[3.2, 0.5], scale=0.8, cure_x=["l_discount"], x=["l_discount"], keys=["l_linestatus"], **Q)
    return _means(got, 5, "l_linestatus")


def cure_cloglog_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = cure.cure_score(_lines(spark, sf_dir), cure=[0.1, 1.5], location=[3.0], scale=0.6, cure_x=["l_discount"], keys=["l_linestatus"], family="loglogistic", link="cloglog", **Q)
    return _means(got, 4, "l_linestatus")


def cure_promotion_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = cure.cure_score(_lines(spark, sf_dir), cure=[-0.5, 2.0], location=[3.1], scale=0.7, cure_x=["l_discount"], keys=["l_linestatus"], model="promotion", **Q)
    return _means(got, 4, "l_linestatus")


def cure_geometric_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The negative binomial form with dispersion 1."""
    got = cure.cure_score(_lines(spark, sf_dir), cure=[-0.2], location=[3.3, -0.4], scale=0.9, x=["l_discount"], keys=["l_linestatus"], model="promotion", family="loglogistic", dispersion=1.0, **Q)
    return _means(got, 4, "l_linestatus")


def cure_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture fit: the share that never returns and the mean quantity of the others, from returns up to 15 units."""
    rows = _lines(spark, sf_dir)
    fit = cure.cure_fit(rows, time="l_quantity", status="early", family="exponential")
    return rows.agg(F.count("*").alias("n")).select("n", F.round(F.lit(1 / (1 + np.exp(fit.cure[0]))), 5).alias("cured"), F.round(F.lit(float(np.exp(fit.location[0]))), 3).alias("mean"), F.round(F.lit(fit.log_likelihood) / F.col("n"), 6).alias("ll"))


def cure_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given coefficients: what is cured, and what is cured among those that last, by line status."""
    fit = cure.CureFit("mixture", "weibull", "logit", 0.0, ["l_discount"], [], np.array([0.4, -3.0]), np.array([2.5]), 0.7, np.eye(4), 0.0, 0.0, 0, True, [])
    got = cure.cure_predicted(_lines(spark, sf_dir), fit, time="l_quantity")
    return got.groupBy("l_linestatus").agg(*(F.round(F.avg(c), 6).alias(c) for c in ("cured", "surv", "cured_given")))


_ROWS = "r as (select l_linestatus, ln(l_quantity) as y, l_discount::double as x, case when l_returnflag = 'R' then 1.0 else 0.0 end as d from lineitem)"
_MEANS = "round(count(*), 6)::double as n, round(avg(l), 6) as ll"

SQL = {
    "cure_mixture_score": f"""with {_ROWS}, z as (select *, (y - 3.2 - 0.5 * x) / 0.8 as z, 1 / (1 + exp(-(0.3 - 2.0 * x))) as p from r),
        s as (select *, exp(-exp(z)) as s, z - exp(z) - ln(0.8) - y as f from z), w as (select *, case when d = 1 then 1 else p * s / (1 - p + p * s) end as w from s),
        t as (select *, case when d = 1 then ln(p) + f else ln(1 - p + p * s) end as l, case when d = 1 then 1 - exp(z) else -w * exp(z) end as t from w)
        select l_linestatus, {_MEANS}, round(avg(w - p), 6) as u0, round(avg(x * (w - p)), 6) as u1, round(avg(-t / 0.8), 6) as u2, round(avg(-x * t / 0.8), 6) as u3, round(avg(-z * t - d), 6) as u4 from t group by 1""",
    "cure_cloglog_score": f"""with {_ROWS}, z as (select *, (y - 3.0) / 0.6 as z, exp(0.1 + 1.5 * x) as u from r), s as (select *, 1 - exp(-u) as p, 1 / (1 + exp(z)) as s from z),
        w as (select *, case when d = 1 then 1 else p * s / (1 - p + p * s) end as w from s),
        t as (select *, case when d = 1 then ln(p) + z - 2 * ln(1 + exp(z)) - ln(0.6) - y else ln(1 - p + p * s) end as l, case when d = 1 then 1 - 2 * (1 - s) else -w * (1 - s) end as t, w * u * exp(-u) / p - (1 - w) * u as e from w)
        select l_linestatus, {_MEANS}, round(avg(e), 6) as u0, round(avg(x * e), 6) as u1, round(avg(-t / 0.6), 6) as u2, round(avg(-z * t - d), 6) as u3 from t group by 1""",
    "cure_promotion_score": f"""with {_ROWS}, z as (select *, (y - 3.1) / 0.7 as z, exp(-0.5 + 2.0 * x) as m from r), s as (select *, 1 - exp(-exp(z)) as cdf, exp(z - exp(z)) as f from z),
        t as (select *, d * (ln(m) + ln(f) - ln(0.7) - y) - m * cdf as l, d * (1 - exp(z)) - m * f as t, d - m * cdf as e from s)
        select l_linestatus, {_MEANS}, round(avg(e), 6) as u0, round(avg(x * e), 6) as u1, round(avg(-t / 0.7), 6) as u2, round(avg(-z * t - d), 6) as u3 from t group by 1""",
    "cure_geometric_score": f"""with {_ROWS}, z as (select *, (y - 3.3 + 0.4 * x) / 0.9 as z, exp(-0.2) as m from r), s as (select *, 1 / (1 + exp(-z)) as cdf, exp(z) / (1 + exp(z)) ** 2 as f from z),
        t as (select *, d * (ln(m) + ln(f) - ln(0.9) - y) - (1 + d) * ln(1 + m * cdf) as l, (1 + d) / (1 + m * cdf) as g, d * (1 - 2 * cdf) - (1 + d) / (1 + m * cdf) * m * f as t from s)
        select l_linestatus, {_MEANS}, round(avg(d - g * m * cdf), 6) as u0, round(avg(-t / 0.9), 6) as u1, round(avg(-x * t / 0.9), 6) as u2, round(avg(-z * t - d), 6) as u3 from t group by 1""",
    "cure_share": f"""with recursive c as (select l_quantity::double as t, l_returnflag = 'R' and l_quantity <= {PLATEAU} as d, count(*)::double as n from lineitem group by all),
        em as (select 0 as i, 0.5::double as p, 0.05::double as r union all
            select i + 1, sum(n * w) / sum(n), sum(n) filter (d) / sum(n * w * t) from (select em.i, t, d, n, case when d then 1.0 else p * exp(-r * t) / (1 - p + p * exp(-r * t)) end as w from em, c where em.i < {ROUNDS}) group by i)
        select sum(n)::bigint as n, round(1 - any_value(p), 5) as cured, round(1 / any_value(r), 3) as mean, round(sum(n * case when d then ln(p * r) - r * t else ln(1 - p + p * exp(-r * t)) end) / sum(n), 6) as ll from em, c where i = {ROUNDS}""",
    "cure_predictions": f"""with {_ROWS}, s as (select *, 1 / (1 + exp(0.4 - 3.0 * x)) as c, exp(-exp((y - 2.5) / 0.7)) as s from r)
        select l_linestatus, round(avg(c), 6) as cured, round(avg(c + (1 - c) * s), 6) as surv, round(avg(c / (c + (1 - c) * s)), 6) as cured_given from s group by 1""",
}

QUERIES = [cure_mixture_score, cure_cloglog_score, cure_promotion_score, cure_geometric_score, cure_share, cure_predictions]

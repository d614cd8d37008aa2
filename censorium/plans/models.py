"""Queries on exact ties, frailty, splines, additive hazards, robust curves and row-level concordance, and their SQL.

As in ``inference``: time l_quantity, event returned, entry l_linenumber - 1.  Fits that iterate are checked by what must hold at their end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from censorium.functions import splines
from censorium.operators import additive, data_prep, exact, flexible, frailty, pairs, robust, states
from censorium.plans.inference import BETA, Q, X, _r

BREAKS = (0.55, 1.131, 2.3, 4.77)
#: Inner and outer knots of the fixed bases.
KNOTS, BOUNDARY, PIECES = (4.0, 20.0, 46.0), (1.0, 50.0), 7


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice", (F.col("l_returnflag") == "R").cast("int").alias("returned"))
    return rows.withColumn("a", (F.col("l_linenumber") - 1).cast("double"))


def exact_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional likelihood of which lines of an order are returned."""
    got = exact.conditional_likelihood(_lines(spark, sf_dir), case="returned", x=X, coefficients=BETA, strata=["l_orderkey"])
    return got.select(*(F.round(c, 5).alias(c) for c in got.columns))


def exact_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact partial likelihood with strata and delayed entry."""
    rows = _lines(spark, sf_dir).withColumn("g", F.col("l_partkey") % 499)
    return exact.exact_likelihood(rows, x=X, coefficients=BETA, strata=["g"], entry="a", **Q).select(F.round("log_likelihood", 5).alias("log_likelihood"))


def frailty_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First round of a gamma frailty of variance 0.5 by supplier."""
    fit = frailty.frailty_fit(_lines(spark, sf_dir), x=[], cluster="l_suppkey", entry="a", variance=0.5, most=1, **Q)
    return fit.effects.select("l_suppkey", "n_event", *_r("expected", "effect"))


def spline_knots(spark: SparkSession, sf_dir: str) -> DataFrame:
    knots = splines.natural_knots(_lines(spark, sf_dir), "l_extendedprice", df_count=4)
    return spark.createDataFrame([(i, round(k, 6)) for i, k in enumerate(knots)], "place int, knot double")


def spline_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of three bases by tax."""
    v = F.col("l_quantity")
    cols = {f"n{i}": c for i, c in enumerate(splines.natural_heights(v, KNOTS))} | {f"b{i}": c for i, c in enumerate(splines.bspline(v, pieces=PIECES, boundary=BOUNDARY))} | {"r0": splines.restricted_cubic(v / 10, [k / 10 for k in KNOTS])[0]}
    return _lines(spark, sf_dir).groupBy("l_tax").agg(*(F.round(F.sum(c), 5).alias(n) for n, c in cols.items()))


def flexible_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the maximum, expected events are those observed, also times each covariate."""
    rows = _lines(spark, sf_dir)
    fit = flexible.flexible_fit(rows, x=X, inner=1, eps=1e-13, **Q)
    out = flexible.flexible_predict(rows, fit, at="l_quantity", x=X)
    return out.agg(F.round(F.sum("cum_hazard"), 3).alias("expected"), *(F.round(F.sum(F.col("cum_hazard") * F.col(c)), 3).alias(f"expected_{c}") for c in X))


def additive_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = additive.additive_fit(_lines(spark, sf_dir), x=["l_discount"], **Q)
    return fit.steps.select("time", "n_risk", "n_event", *_r("coef_intercept", "coef_l_discount", "cum_intercept", "cum_l_discount"), F.round("weight_intercept", 4).alias("weight_intercept"), F.round("weight_l_discount", 4).alias("weight_l_discount"))


def additive_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = additive.additive_fit(_lines(spark, sf_dir), x=["l_discount"], entry="a", **Q)
    return spark.createDataFrame([(round(float(fit.statistic[1]), 6), round(float(fit.variance[1, 1]), 6), round(fit.chi_square, 6))], "statistic double, variance double, chi_square double")


def robust_km(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust.robust_curve(_lines(spark, sf_dir), cluster="l_suppkey", **Q).select("time", "n_risk", *_r("surv", "std_err", "cum_hazard", "cum_hazard_std_err"))


def robust_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row its own cluster, weighted, with delayed entry, by line status of the tax."""
    rows = _lines(spark, sf_dir).withColumn("g", F.col("l_tax") > 0.04)
    return robust.robust_curve(rows, keys=["g"], weight="l_linenumber", entry="a", **Q).select("g", "time", *_r("surv", "std_err", "cum_hazard_std_err"))


def curve_influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = robust.curve_influence(_lines(spark, sf_dir), cluster="l_linenumber", times=[5.0, 20.5, 60.0], **Q)
    return got.select("l_linenumber", F.col("time").alias("at"), *_r("influence_surv", "influence_cum_hazard"))


def c_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concordance with delayed entry, with its variances."""
    got = pairs.concordance_variance(_lines(spark, sf_dir), risk="l_discount", entry="a", **Q)
    return got.select(*(F.col(c).cast("long").alias(c) for c in ("concordant", "discordant", "tied_risk")), F.round("c_index", 6).alias("c_index"), F.round(F.sqrt("variance"), 8).alias("std_err"), F.round(F.sqrt("conditional_variance"), 8).alias("chance_std_err"))


def fine_gray_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fine–Gray at coefficient 0, with ties of all causes: likelihood and score test."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_quantity", "l_discount", F.expr("case l_returnflag when 'R' then 1 when 'A' then 2 else 0 end as cause"))
    fit = states.fine_gray(rows, time="l_quantity", cause="cause", x=["l_discount"], most=0)
    return spark.createDataFrame([(round(fit.null_log_likelihood, 4), round(fit.score_statistic, 6))], "log_likelihood double, score_statistic double")


def cut_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows cut at breaks of a value with decimals."""
    rows = _lines(spark, sf_dir).select("returned", (F.col("l_tax") + 0.37).alias("t0"), (F.col("l_tax") + 0.37 + F.col("l_quantity") * 0.13).alias("t1"), (F.col("l_discount") * 37.7).alias("v"))
    out = data_prep.time_cut_expand(rows, start="t0", stop="t1", event="returned", value="v", breaks=BREAKS)
    return out.groupBy("cut", "cut_label").agg(F.count("*").alias("n"), F.sum("returned").alias("events"), F.round(F.sum(F.col("t1") - F.col("t0")), 5).alias("lived"), F.round(F.sum("v"), 5).alias("values"))


_ROWS = "r as (select l_orderkey, l_partkey % 499 as g, l_suppkey, l_linenumber, l_quantity as time, l_linenumber - 1 as a, l_tax, l_discount as x, case when l_returnflag = 'R' then 1.0 else 0.0 end as d, 3.0 * l_discount - 2.0 * l_tax as lp from lineitem)"
_CURVE = "c as (select time, sum(d) as d, sum(count(*)) over (order by time desc) as n from r group by 1), h as (select *, exp(sum(ln(case when n > d then 1 - d / n else 1e-300 end)) over w) as s, sum(d / n) over w as ch, sum(case when n > d then d / n / (n - d) else 0 end) over w as cs, sum(d / n / n) over w as cv from c window w as (order by time))"
_NATURAL = "case when v <= 4 then y0 + (v - 4) * ((y1 - y0) / 16 - m * 16 / 6) when v >= 46 then y2 + (v - 46) * ((y2 - y1) / 26 + m * 26 / 6) when v <= 20 then y0 + (v - 4) * ((y1 - y0) / 16 - m * 16 / 6) + m * (v - 4) ** 3 / 96 else y2 + (v - 46) * ((y2 - y1) / 26 + m * 26 / 6) + m * (46 - v) ** 3 / 156 end"


def _boor() -> str:
    """The B-splines by the recursion over their degree."""
    width = (BOUNDARY[1] - BOUNDARY[0]) / PIECES
    knot = [BOUNDARY[0] + width * (j - 3) for j in range(PIECES + 7)]
    steps = ["k0 as (select l_tax, l_quantity as v, " + ", ".join(f"case when l_quantity >= {a!r} and l_quantity < {b!r} then 1.0 else 0.0 end as q{j}" for j, (a, b) in enumerate(zip(knot, knot[1:], strict=False))) + " from lineitem)"]
    for k in range(1, 4):
        steps.append(f"k{k} as (select l_tax, v, " + ", ".join(f"(v - {knot[j]!r}) / {k * width!r} * q{j} + ({knot[j + k + 1]!r} - v) / {k * width!r} * q{j + 1} as q{j}" for j in range(PIECES + 6 - k)) + f" from k{k - 1})")
    return ", ".join(steps)


SQL = {
    "exact_sets": f"""with {_ROWS}, n as (select *, row_number() over (partition by l_orderkey order by l_linenumber, x, l_tax, time, d) - 1 as i from r), s as (select l_orderkey, count(*) as n, sum(d) as k, sum(d * lp) as lp, sum(d * x) as x, sum(d * l_tax) as y from r group by 1),
        m as (select l_orderkey, k, unnest(range(0, 1 << n)) as m from s where k > 0), w as (select m.l_orderkey, m.m, exp(sum(n.lp)) as w, sum(n.x) as x, sum(n.l_tax) as y from m join n on n.l_orderkey = m.l_orderkey and (m.m >> n.i) & 1 = 1 where bit_count(m.m) = k group by all),
        e as (select l_orderkey, sum(w) as w, sum(w * x) / sum(w) as x, sum(w * y) / sum(w) as y, sum(w * x * x) / sum(w) as xx, sum(w * y * y) / sum(w) as yy from w group by 1)
        select round(sum(s.lp - ln(e.w)), 5) as log_likelihood, round(sum(s.x - e.x), 5) as score_l_discount, round(sum(s.y - e.y), 5) as score_l_tax, round(sum(e.xx - e.x * e.x), 5) as info_l_discount, round(sum(e.yy - e.y * e.y), 5) as info_l_tax from s join e using (l_orderkey)""",
    "exact_times": f"""with {_ROWS}, e as (select g, time, sum(d) as k, sum(d * lp) as lp from r where a < time group by all having sum(d) > 0),
        p as (select e.g, e.time, e.k, e.lp, {", ".join(f"sum(exp({i} * r.lp)) as p{i}" for i in range(1, 10))} from e join r on r.g = e.g and r.time >= e.time and r.a < e.time group by all),
        s as (select *, 1.0 as e0, {", ".join("(" + " ".join(f"{'+' if i % 2 else '-'} e{k - i} * p{i}" for i in range(1, k + 1)) + f") / {k} as e{k}" for k in range(1, 10))} from p)
        select round(sum(lp - ln(case k {" ".join(f"when {k} then e{k}" for k in range(1, 10))} end)), 5) as log_likelihood from s""",
    "frailty_effects": f"""with {_ROWS}, v as (select * from r where a < time), t as (select time, sum(d) as d from v group by 1 having sum(d) > 0), n as (select t.time, t.d, count(*) as n from t join v on v.time >= t.time and v.a < t.time group by all), h as (select time, sum(d / n) over (order by time) as h from n),
        p as (select v.l_suppkey, v.d, coalesce((select max(h.h) from h where h.time <= v.time), 0) - coalesce((select max(h.h) from h where h.time <= v.a), 0) as e from v)
        select l_suppkey, cast(sum(d) as bigint) as n_event, round(sum(e), 6) as expected, round(ln((sum(d) + 2) / (sum(e) + 2)), 6) as effect from p group by 1""",
    "spline_knots": """with b as (select quantile_cont(l_extendedprice, 0.05) as lo, quantile_cont(l_extendedprice, 0.95) as hi from lineitem), q as (select quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) as q from lineitem, b where l_extendedprice > lo and l_extendedprice < hi)
        select cast(unnest(range(0, 5)) as integer) as place, round(unnest([lo, q[1], q[2], q[3], hi]), 6) as knot from b, q""",
    "spline_columns": f"""with {_boor()}, n as (select l_tax, v, {_NATURAL.replace("y0", "0").replace("y1", "1").replace("y2", "0").replace("m", "(3.0 / 42 * (-1.0 / 26 - 1.0 / 16))")} as n0, {_NATURAL.replace("y0", "0").replace("y1", "0").replace("y2", "1").replace("m", "(3.0 / 42 * (1.0 / 26))")} as n1,
        greatest(v / 10 - 0.4, 0) ** 3 - greatest(v / 10 - 2, 0) ** 3 * 4.2 / 2.6 + greatest(v / 10 - 4.6, 0) ** 3 * 1.6 / 2.6 as r0, {", ".join(f"q{j}" for j in range(PIECES + 3))} from k3)
        select l_tax, {", ".join(f"round(sum({c}), 5) as {c}" for c in ("n0", "n1", "r0"))}, {", ".join(f"round(sum(q{j}), 5) as b{j}" for j in range(PIECES + 3))} from n group by 1""",
    "flexible_expected": "select round(sum(d), 3) as expected, round(sum(d * l_discount), 3) as expected_l_discount, round(sum(d * l_tax), 3) as expected_l_tax from (select *, case when l_returnflag = 'R' then 1.0 else 0.0 end as d from lineitem)",
    "additive_steps": f"""with {_ROWS}, t as (select time, sum(d) as d, sum(d * x) as dx, cast(sum(count(*)) over (order by time desc) as double) as n, sum(sum(x)) over (order by time desc) as s, sum(sum(x * x)) over (order by time desc) as ss from r group by 1),
        m as (select *, s / n as m, ss / n - (s / n) ** 2 as v from t where d > 0 and n >= 3), b as (select *, (dx - d * m) / n / v as b1, d / n - m * (dx - d * m) / n / v as b0 from m where v > 1e-12)
        select time, n as n_risk, cast(d as double) as n_event, round(b0, 6) as coef_intercept, round(b1, 6) as coef_l_discount, round(sum(b0) over w, 6) as cum_intercept, round(sum(b1) over w, 6) as cum_l_discount, round(n / (1 + m * m / v), 4) as weight_intercept, round(n * v, 4) as weight_l_discount from b window w as (order by time)""",
    "additive_test": f"""with {_ROWS}, v as (select * from r where a < time), t as (select distinct time from v where d > 0), m as (select t.time, avg(v.x) as m, var_pop(v.x) as vx from t join v on v.time >= t.time and v.a < t.time group by 1 having count(*) >= 3)
        select round(sum(x - m), 6) as statistic, round(sum((x - m) ** 2), 6) as variance, round(sum(x - m) ** 2 / sum((x - m) ** 2), 6) as chi_square from v join m using (time) where d > 0 and vx > 1e-12""",
    "robust_km": f"""with {_ROWS}, {_CURVE}, o as (select l_suppkey, time, count(*) as n, sum(d) as d from r group by all), i as (select t.time, o.l_suppkey, sum(case when o.time <= t.time then case when own.n > own.d then o.d / (own.n - own.d) else 0 end - o.n * own.cs else -o.n * t.cs end) as i, sum(case when o.time <= t.time then o.d / own.n - o.n * own.cv else -o.n * t.cv end) as j from h t, o join h own on own.time = o.time group by all),
        v as (select time, sqrt(sum(i * i)) as i, sqrt(sum(j * j)) as j from i group by 1) select time, cast(n as double) as n_risk, round(case when s < 1e-200 then 0 else s end, 6) as surv, round(s * i, 6) as std_err, round(ch, 6) as cum_hazard, round(j, 6) as cum_hazard_std_err from h join v using (time)""",
    "robust_rows": f"""with {_ROWS}, v as (select r.*, cast(l_linenumber as double) as w, l_tax > 0.04 as k from r where a < time), t as (select k, time, sum(w * d) as d from v group by all), c as (select t.k, t.time, t.d, sum(v.w) as n from t join v on v.k = t.k and v.time >= t.time and v.a < t.time group by all),
        h as (select *, exp(sum(ln(case when n > d * (1 + 1e-12) then 1 - d / n else 1e-300 end)) over w) as s, sum(case when n > d * (1 + 1e-12) then d / n / (n - d) else 0 end) over w as cs, sum(d / n / n) over w as cv from c window w as (partition by k order by time)),
        o as (select v.k, v.a, v.time, v.d, v.w, count(*) as m from v group by all), e as (select o.*, h.n as rn, h.d as rd, h.cs, h.cv, coalesce((select max(b.cs) from h b where b.k = o.k and b.time <= o.a), 0) as cs0, coalesce((select max(b.cv) from h b where b.k = o.k and b.time <= o.a), 0) as cv0 from o join h on h.k = o.k and h.time = o.time),
        i as (select t.k, t.time, sum(m * (w * case when e.time <= t.time then case when rn > rd * (1 + 1e-12) then e.d / (rn - rd) else 0 end - e.cs + cs0 when a < t.time then cs0 - t.cs else 0 end) ** 2) as i, sum(m * (w * case when e.time <= t.time then e.d / rn - e.cv + cv0 when a < t.time then cv0 - t.cv else 0 end) ** 2) as j from h t join e on e.k = t.k group by all)
        select k as g, time, round(case when s < 1e-200 then 0 else s end, 6) as surv, round(s * sqrt(i), 6) as std_err, round(sqrt(j), 6) as cum_hazard_std_err from h join i using (k, time)""",
    "curve_influence": f"""with {_ROWS}, {_CURVE}, o as (select l_linenumber, time, count(*) as n, sum(d) as d from r group by all), q as (select unnest([5.0, 20.5, 60.0])::double as "at"), l as (select "at", (select max(time) from h where time <= "at") as time from q), t as (select l."at", h.* from l join h using (time)),
        i as (select t."at", t.s, o.l_linenumber, sum(case when o.time <= t."at" then case when own.n > own.d then o.d / (own.n - own.d) else 0 end - o.n * own.cs else -o.n * t.cs end) as i, sum(case when o.time <= t."at" then o.d / own.n - o.n * own.cv else -o.n * t.cv end) as j from t, o join h own on own.time = o.time group by all)
        select l_linenumber, "at", round(-s * i, 6) as influence_surv, round(j, 6) as influence_cum_hazard from i""",
    "c_counting": f"""with {_ROWS}, k as (select time, a, x, d, cast(count(*) as double) as w from r where a < time group by all), p as (select e.time as et, e.a as ea, e.x as ex, k.*, e.w as ew from k e join k on e.d > 0 and k.a < e.time and k.time > e.time),
        s as (select sum(case when ex > x then ew * w else 0 end) as c, sum(case when ex < x then ew * w else 0 end) as d, sum(case when ex = x then ew * w else 0 end) as t from p),
        i as (select time, a, x, d, sum(sgn) as s, sum(n) as n from (select et as time, ea as a, ex as x, 1.0 as d, sum(sign(ex - x) * w) as sgn, sum(w) as n from p group by all union all select time, a, x, d, sum(sign(ex - x) * ew), sum(ew) from p group by all) group by all),
        v as (select sum(k.w * ((i.s - i.n * (c - s.d) / (c + s.d + t)) / (2 * (c + s.d + t))) ** 2) as v from i join k using (time, a, x, d), s),
        g as (select e.time, e.h, k.x, sum(k.w) as w from (select time, sum(w) as h from k where d > 0 group by 1) e join k on k.a < e.time and k.time >= e.time group by all), z as (select sum(z) as z from (select h * (sum(w) ** 3 - sum(w ** 3)) / 3 / sum(w) as z from g group by time, h))
        select cast(c as bigint) as concordant, cast(d as bigint) as discordant, cast(t as bigint) as tied_risk, round((c + t / 2) / (c + d + t), 6) as c_index, round(sqrt(v), 8) as std_err, round(sqrt(z) / 2 / (c + d + t), 8) as chance_std_err from s, v, z""",
}
SQL |= {
    "fine_gray_score": """with r as (select l_quantity as time, l_discount as x, case l_returnflag when 'R' then 1 when 'A' then 2 else 0 end as cause from lineitem), c as (select time, sum((cause > 0)::int) as d, sum((cause = 0)::int) as c, sum(count(*)) over (order by time desc) as n, sum((cause = 1)::int) as o, sum(case when cause = 1 then x else 0 end) as ox from r group by 1),
        g as (select *, coalesce(exp(sum(ln(case when n > d then 1 - c / (n - d) else 1 end)) over (order by time rows between unbounded preceding and 1 preceding)), 1) as g from c where n > d and n - d > c or true),
        k as (select time, cause, x, count(*) as w from r group by all), m as (select k.*, case when cause = 2 and g.g > 0 then 1 / g.g else 0 end as back from k join g using (time)),
        s as (select g.time, g.o, g.ox, sum(w * case when m.time >= g.time then 1 else g.g * back end) as s0, sum(w * x * case when m.time >= g.time then 1 else g.g * back end) as s1, sum(w * x * x * case when m.time >= g.time then 1 else g.g * back end) as s2 from g, m where g.o > 0 group by all)
        select round(-sum(o * ln(s0)), 4) as log_likelihood, round(sum(ox - o * s1 / s0) ** 2 / sum(o * (s2 / s0 - (s1 / s0) ** 2)), 6) as score_statistic from s""",
    "cut_parts": f"""with r as (select case when l_returnflag = 'R' then 1 else 0 end as e, l_tax + 0.37 as t0, l_tax + 0.37 + l_quantity * 0.13 as t1, l_discount * 37.7 as v from lineitem), b as (select i - 1 as i, b[i] as b, b[i + 1] as nxt from (select {list(BREAKS)!r}::double[] as b), range(1, {len(BREAKS) + 1}) as q(i)),
        o as (select r.*, coalesce((select max(i) from b where b.b <= r.v), -1) as i, coalesce((select min(b) from b where b.b > r.v), 1e9) as nxt from r), p as (select i as cut, e, t1, t0 as a, v as x, least(t1, nxt - v + t0) as z from o union all select b.i, e, t1, b.b - v + t0, v + (b.b - v + t0) - t0, least(t1, coalesce(b.nxt, 1e9) - v + t0) from r join b on b.b > v and b.b - v + t0 < t1)
        select cast(cut as integer) as cut, case cut {" ".join(f"when {i} then '{x:g}+ thru {y:g}'" for i, (x, y) in enumerate(zip(BREAKS, BREAKS[1:], strict=False)))} end as cut_label, count(*) as n, cast(sum(case when z = t1 then e else 0 end) as bigint) as events, round(sum(z - a), 5) as lived, round(sum(x), 5) as values from p where a < z group by 1, 2""",
}

QUERIES = [fine_gray_score, cut_parts, exact_sets, exact_times, frailty_effects, spline_knots, spline_columns, flexible_expected, additive_steps, additive_test, robust_km, robust_rows, curve_influence, c_counting]

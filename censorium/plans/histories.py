"""Queries on histories, person-time, transitions and designs, and their SQL.

``events`` gives histories by user in the order of event_id; ``lineitem`` rows of an order follow one another by line number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from censorium.operators import curves, data_prep, designs, missing, population, reliability, spatial, states

CODE = "case event_type when 'purchase' then 1 when 'signup' then 2 when 'view' then 3 else 0 end"
Z_A, Z_B = 1.959963984540054, 0.8416212335729143


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")
    return rows.withColumn("state", F.expr(CODE))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.withColumns({"returned": (F.col("l_returnflag") == "R").cast("int")})


def _r(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def _nearest(spark: SparkSession, sf_dir: str, best: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    right = rows.where("event_type = 'signup'").select("user_id", "event_id", F.col("event_id").alias("signup"))
    found = data_prep.nearest(rows.where("event_type = 'purchase'").select("event_id", "user_id"), right, key="user_id", left_time="event_id", right_time="event_id", value="signup", best=best)
    return found.select("event_id", "signup")


def next_signup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, "after")


def closest_signup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, "closest")


def carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("v", F.when(F.col("state") == 1, F.col("value")))
    out = data_prep.carry_forward(rows, key="user_id", time="event_id", value="v")
    return data_prep.carried_from(rows.select("event_id", "user_id", "v"), key="user_id", time="event_id", value="v", row="event_id").select("event_id", "source").join(out.select("event_id", F.round("v", 6).alias("v")), "event_id")


def repeats_censored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    a = data_prep.censor_repeats(rows, key="user_id", time="event_id", state="state", censor=0).select("event_id", F.col("state").alias("last"))
    b = data_prep.censor_repeats(rows, key="user_id", time="event_id", state="state", censor=0, single=True).select("event_id", F.col("state").alias("any"))
    return a.join(b, "event_id")


def _spans(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user_id").agg((F.min("event_id") - 1).cast("double").alias("start"), F.max("event_id").cast("double").alias("stop"))


def merged_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' spans cut at purchases: last purchase value, purchases so far, and whether a part ends in one."""
    rows = _events(spark, sf_dir)
    up = rows.where("state = 1").select("user_id", F.col("event_id").alias("t"), F.round("value", 2).alias("paid"), F.lit(1).alias("one"))
    how = dict(key="user_id", start="start", stop="stop", time="t")
    out = data_prep.merge_updates(_spans(rows), up, value="paid", **how)
    out = data_prep.merge_updates(out, up, value="one", kind="cumulative", name="so_far", **how)
    return data_prep.merge_updates(out, up, value="one", kind="event", name="ends", **how).select("user_id", "start", "stop", "paid", F.col("so_far").cast("long").alias("so_far"), "ends")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where purchases fall in the spans between signups."""
    rows = _events(spark, sf_dir)
    base = data_prep.intervals_of_visits(rows.where("state = 2"), key="user_id", time="event_id", state="state", repeated=True)
    return data_prep.update_places(base, rows.where("state = 1 or event_id % 5 = 0"), key="user_id", start="start", stop="stop", time="event_id")


def visit_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data_prep.intervals_of_visits(_events(spark, sf_dir), key="user_id", time="event_id", state="state")


def states_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data_prep.intervals_of_states(_events(spark, sf_dir), key="user_id", time="event_id", state="state")
    return data_prep.states_at(rows.where("stop is not null"), key="user_id", start="start", stop="stop", state="state", times=[100, 250.5, 900])


def state_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data_prep.intervals_of_visits(_events(spark, sf_dir).withColumn("state", F.expr("state % 2")), key="user_id", time="event_id", state="state", repeated=True)
    return data_prep.collapse(rows, key="user_id", start="start", stop="stop", state="from")


def history_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _items(spark, sf_dir).select("l_orderkey", (F.col("l_linenumber") - F.when(F.col("l_suppkey") % 7 == 0, 2).otherwise(1)).alias("start"), (F.col("l_linenumber") - F.when(F.col("l_suppkey") % 11 == 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("stop"), "returned", (F.col("l_partkey") % 3 == 0).cast("int").alias("state"))
    out = data_prep.check_histories(rows, key="l_orderkey", start="start", stop="stop", status="returned", state="state")
    return out.groupBy("flag").agg(F.count("*").alias("n"))


def state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data_prep.intervals_of_visits(_events(spark, sf_dir), key="user_id", time="event_id", state="state")
    return data_prep.transitions(rows, status="event", state="from")


def idle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _items(spark, sf_dir).withColumns({"a": F.col("l_quantity") - 0.5, "e": ((F.col("returned") == 1) & (F.col("l_suppkey") % 50 == 0)).cast("int")})
    return data_prep.never_at_risk(rows, time="l_quantity", status="e", entry="a", keys=["l_tax", "l_linestatus"]).groupBy("l_tax").agg(F.sum(F.col("idle").cast("long")).alias("idle"))


def age_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _items(spark, sf_dir).withColumns({"start": F.lit(0.0), "stop": F.col("l_quantity"), "age": F.col("l_linenumber") * 5.0})
    return data_prep.person_time_cells(rows, start="start", stop="stop", event="returned", value="age", breaks=[0, 20, 40, 100], keys=["l_linestatus"]).select("l_linestatus", "cut", "n", "events", *_r("person_time", "rate"))


def cut_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("value", F.expr("nullif(value, 0)"))
    return data_prep.time_cut(rows, value="value", breaks=[10, 50, 100, 400]).groupBy("cut", "cut_label").agg(F.count("*").alias("n"))


def redistributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights redistributed to the right, in all and by two report times."""
    rows = _items(spark, sf_dir)
    a = data_prep.redistributed_weights(rows, time="l_quantity", status="returned", keys=["l_linestatus"]).groupBy("l_linestatus").agg(F.lit(None).cast("double").alias("at"), F.round(F.sum("rtt"), 4).alias("total"), F.round(F.max("rtt"), 6).alias("top"))
    b = data_prep.redistributed_weights(rows, time="l_quantity", status="returned", keys=["l_linestatus"], at=[10.0, 30.0]).groupBy("l_linestatus", "at").agg(F.round(F.sum("rtt"), 4).alias("total"), F.round(F.max("rtt"), 6).alias("top"))
    return a.unionByName(b)


def strata_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _items(spark, sf_dir).withColumn("k", F.expr("nullif(l_linenumber % 3, 0)"))
    out = data_prep.strata(rows, columns=["l_linestatus", "k"]).groupBy("stratum", "stratum_label").agg(F.count("*").alias("n"))
    return out


def first_seen_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data_prep.dense_codes(_events(spark, sf_dir), columns=["user_id"], name="cluster", first_seen="event_id").select("event_id", "cluster")


def condensed_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _items(spark, sf_dir).select("l_orderkey", (F.col("l_linenumber") - 1).alias("start"), F.col("l_linenumber").alias("stop"), "returned").distinct()
    return data_prep.condense_plan(rows, key="l_orderkey", start="start", stop="stop", event="returned").groupBy("kept").agg(F.count("*").alias("n"), F.sum("run").alias("runs"), F.sum("run_start").alias("starts"))


def designs_by_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = _items(spark, sf_dir).select(F.round(0.45 + 5 * F.col("l_tax"), 2).alias("hr")).distinct().withColumns({"share": F.lit(0.6), "n": F.lit(400), "h": F.lit(0.05), "a": F.lit(12.0), "f": F.lit(24.0)}).where("hr < 0.99")
    out = designs.sample_size(settings, hazard_ratio="hr").withColumnsRenamed({"n_events": "schoenfeld"})
    out = designs.sample_size_freedman(out.drop("n_control", "n_treated"), hazard_ratio="hr", event_share="share").withColumnsRenamed({"n_events": "freedman"})
    out = designs.expected_events(out, total="n", hazard="h", hazard_ratio="hr", accrual="a", follow_up="f", dropout=0.01)
    return out.select("hr", "schoenfeld", "freedman", "n_total", *_r("expected_events"))


def poisson(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _items(spark, sf_dir).groupBy("l_tax").agg(F.sum("returned").alias("k"), F.sum("l_quantity").alias("t"))
    return designs.poisson_limits(counts, count="k", time="t", method="anscombe").select("l_tax", F.round(F.col("lower") * 1000, 6).alias("lower"), F.round(F.col("upper") * 1000, 6).alias("upper"))


def curve_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    km = curves.kaplan_meier(_items(spark, sf_dir), time="l_quantity", status="returned").where("surv > 0 and surv < 1")
    out = km.select("time", "surv", "std_err")
    for scale in ("cumhaz", "cloglog", "loglogistic"):
        one = reliability.on_scale(out, surv="surv", std_err="std_err", scale=scale)
        back = reliability.from_scale(one.withColumnRenamed("surv", "_s"), estimate="estimate", scale=scale)
        out = back.select(*(c for c in one.columns if c not in ("estimate", "estimate_std_err", "lower", "upper", "surv")), "surv", F.col("estimate").alias(scale), F.col("lower").alias(f"{scale}_low"))
    return out.select("time", *(F.round(c, 5).alias(c) for c in ("surv", "cumhaz", "cumhaz_low", "cloglog", "cloglog_low", "loglogistic", "loglogistic_low")))


def residual_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    km = curves.kaplan_meier(_items(spark, sf_dir), time="l_quantity", status="returned")
    a = reliability.residual_life(km, time="time", surv="surv", at=10.0)
    b = reliability.conditional_reliability(km, time="time", surv="surv", given=10.0).where("time = 20").select(F.col("surv").alias("ten_to_thirty"))
    return a.crossJoin(b).select(*_r("residual_life", "ten_to_thirty"))  # one row each


def warranty_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reliability.warranty(_items(spark, sf_dir), time="l_quantity", status="returned", units=1000, period=20.0, cost=30.0, discount=0.01, points=8)
    return out.select("time", *_r("failures", "cost"))


def renewals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _items(spark, sf_dir)
    a = reliability.renewal(rows, time="l_quantity", status="returned", horizon=100.0, repair=2.0)
    b = reliability.growth(_events(spark, sf_dir).where("value > 1"), cumulative_time="value").select("growth_rate", "final_mtbf")
    return a.crossJoin(b).select(*_r("mtbf", "renewals", "renewal_variance", "availability", "growth_rate", "final_mtbf"))  # one row each


def quality_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reliability.quality_adjusted_time(_items(spark, sf_dir), time="l_quantity", status="returned", utilities=[(0.0, 0.9), (15.0, 0.6)], discount=0.03, horizon=30.0, keys=["l_linestatus"])
    return out.select("l_linestatus", *_r("qaly", "discounted_qaly", "life_years", "mean_utility"))


def toxicity_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _items(spark, sf_dir).withColumns({"ts": F.when(F.col("l_linenumber") < 4, F.col("l_linenumber") - 1.5), "te": F.when(F.col("l_linenumber") != 2, F.col("l_linenumber") + 4.0), "rel": F.when(F.col("returned") == 1, F.col("l_quantity") * 0.75)})
    out = reliability.toxicity_sensitivity(rows, time="l_quantity", toxicity_start="ts", toxicity_end="te", relapse="rel", tau=30.0, keys=["l_linestatus"], utilities_toxicity=[0.2, 0.5], utilities_relapse=[0.5])
    return out.select("l_linestatus", "utility_toxicity", *_r("toxicity", "free", "relapse", "total", "qtwist"))


#: A small rate table: two ages (days), two periods, two sexes.
AGES, YEARS, RATES = [0, 18262.5, 40000], [1990, 2000, 2030], {"F": [[0.0001, 0.00008], [0.0004, 0.0003]], "O": [[0.00012, 0.0001], [0.0005, 0.00045]]}


def _cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct lines; what is kept of a line are numbers, also its one-letter status, so that they are told apart by hashing, without sorts."""
    row = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").alias("row")
    kept = _items(spark, sf_dir).select(row, "l_quantity", "l_tax", "l_linenumber", (F.col("l_suppkey") % 8).cast("int").alias("_year"), F.ascii("l_linestatus").alias("_letter"), "returned").dropDuplicates(["row"])
    return kept.select("row", "l_tax", "returned", F.char("_letter").alias("l_linestatus"), (F.col("l_quantity") * 100).alias("days"), (15000.0 + F.col("l_linenumber") * 800).alias("age"), (1994.0 + F.col("_year")).alias("year"))


def expected_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = population.rate_table(spark, age_breaks=AGES, year_breaks=YEARS, rates=RATES)
    out = None
    for method in ("ederer", "hakulinen", "conditional"):
        one = population.expected_curve(_cohort(spark, sf_dir), rates, row="row", time="days", age="age", year="year", sex="l_linestatus", times=[500.0, 2000.0], method=method).select(F.lit(method).alias("method"), "at", "n", *_r("surv", "hazard"))
        out = one if out is None else out.union(one)
    return out


def standardised_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = population.rate_table(spark, age_breaks=AGES, year_breaks=YEARS, rates=RATES)
    out = population.person_years(_cohort(spark, sf_dir), rates, row="row", time="days", status="returned", keys=["l_tax"], age="age", year="year", sex="l_linestatus")
    return out.select("l_tax", "n", "events", *_r("person_years", "expected", "rate", "smr"))


def net_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _items(spark, sf_dir).withColumn("e", F.exp(-0.002 * F.col("l_linenumber") * F.col("l_quantity")))
    a = population.net_curve(rows, time="l_quantity", status="returned", expected="e").select("time", F.round("surv", 6).alias("pohar"), F.round("excess", 6).alias("excess"), F.round("std_err", 6).alias("std_err"))
    b = population.net_curve(rows, time="l_quantity", status="returned", expected="e", method="ederer").select("time", F.round("surv", 6).alias("ederer"))
    return a.join(b, "time")


def crude_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _items(spark, sf_dir).withColumn("cause", F.col("l_linenumber") % 3)
    return population.crude_probability(rows, time="l_quantity", status="returned", cause="cause", times=[10.0, 40.0]).select("at", *_r("of_cause", "other"))


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data_prep.intervals_of_visits(_events(spark, sf_dir), key="user_id", time="event_id", state="state", repeated=True).withColumn("e", (F.col("event") != 0).cast("int"))


def transition_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = states.transition_hazards(_moves(spark, sf_dir).withColumn("t", F.ceil(F.col("stop") / 50) * 50).withColumn("s", F.floor(F.col("start") / 50) * 50), entry="s", exit="t", from_state="from", to_state="event", event="e")
    return out.select("from", "to", "time", "n_risk", "n", *_r("cum_hazard"), F.round("variance", 6).alias("variance"))


def occupation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two causes from one state: occupation probabilities are their incidences."""
    rows = _items(spark, sf_dir).withColumns({"a": F.lit(0.0), "from": F.lit(0), "to": F.when(F.col("returned") == 1, 1 + F.col("l_linenumber") % 2), "e": F.col("returned")})
    hazards = states.transition_hazards(rows, entry="a", exit="l_quantity", from_state="from", to_state="to", event="e")
    return states.state_probabilities(hazards, initial={0: 1.0}).select("time", F.col("state").cast("int").alias("state"), *_r("probability"))


def markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.markov_rates(_moves(spark, sf_dir), entry="start", exit="stop", from_state="from", to_state="event", event="e").select("from", "to", "transitions", "time_at_risk", F.round("rate", 9).alias("rate"))


def sojourns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.sojourn(_moves(spark, sf_dir), entry="start", exit="stop", state="from", event="e").select("state", "n", "events", *_r("mean_time", "rate"))


def missing_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _items(spark, sf_dir).select(F.expr("nullif(l_tax, 0.0)").alias("a"), F.expr("nullif(l_linenumber, 2)").alias("b"), F.expr("nullif(l_discount, 0.01)").alias("c"))
    out = missing.patterns(rows, columns=["a", "b", "c"])
    return out


def missing_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _items(spark, sf_dir).select(F.expr("nullif(l_tax, 0.0)").alias("a"), F.expr("nullif(l_linenumber, 2)").alias("b"))
    return missing.missing_shares(rows, columns=["a", "b"]).select("column", *_r("percent"))


def _regions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey")
    balance = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.sum((F.col("c_acctbal") < 0).cast("double")).alias("o"), (F.count("*") * 0.1).alias("e"))
    at = nations.join(balance, "n_nationkey")
    pairs = at.select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("r")).join(at.select(F.col("n_nationkey").alias("b"), F.col("n_regionkey").alias("r")), "r").where("a <> b").select("a", "b", F.lit(1.0).alias("w"))
    return at, pairs


def moran(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, pairs = _regions(spark, sf_dir)
    return spatial.morans_i(at.withColumn("v", F.col("o") / F.col("e")), pairs, region="n_nationkey", value="v").select(*_r("i", "expected", "z"))


def smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, pairs = _regions(spark, sf_dir)
    return spatial.smoothed_rates(at, pairs, region="n_nationkey", observed="o", expected="e", share=0.4).select("region", *_r("raw", "smoothed"))


_EV = f"e as (select event_id, user_id, event_type, value, {CODE} as state from events)"
_VISITS = "v as (select user_id, event_id as start, lead(event_id) over w as stop, state as \"from\", lead(state) over w as event from e window w as (partition by user_id order by event_id)), iv as (select * from v where stop is not null)"
_LI = "l as (select *, case when l_returnflag = 'R' then 1 else 0 end as returned from lineitem)"
_KM = "c as (select l_quantity as time, cast(sum(returned) as double) as d, cast(count(*) as double) as c from l group by 1), n as (select *, sum(c) over (order by time desc) as n from c), k as (select *, product(1 - d / n) over w as s, sum(case when n > d then d / (n * (n - d)) else 0 end) over w as g from n window w as (order by time))"
_COHORT = """co as (select *, l_quantity * 100 as days, 15000.0 + l_linenumber * 800 as age, 1994.0 + l_suppkey % 8 as yr from (select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_linestatus, l_tax, returned from l)),
rt as (select * from (values ('F', -1e300, 18262.5, -1e300, 2000, 0.0001), ('F', -1e300, 18262.5, 2000, 1e300, 0.00008), ('F', 18262.5, 1e300, -1e300, 2000, 0.0004), ('F', 18262.5, 1e300, 2000, 1e300, 0.0003), ('O', -1e300, 18262.5, -1e300, 2000, 0.00012), ('O', -1e300, 18262.5, 2000, 1e300, 0.0001), ('O', 18262.5, 1e300, -1e300, 2000, 0.0005), ('O', 18262.5, 1e300, 2000, 1e300, 0.00045)) t(sex, alo, ahi, ylo, yhi, rate))"""


def _haz(until: str) -> str:
    return f"(select sum(greatest(0.0, least({until}, ahi - age, (yhi - yr) * 365.25) - greatest(0.0, alo - age, (ylo - yr) * 365.25)) * rate) from rt where sex = l_linestatus)"


SQL = {
    "next_signup": f"with {_EV} select p.event_id, (select min(s.event_id) from e s where s.user_id = p.user_id and s.event_type = 'signup' and s.event_id >= p.event_id) as signup from e p where event_type = 'purchase'",
    "closest_signup": f"with {_EV}, p as (select p.event_id, (select max(s.event_id) from e s where s.user_id = p.user_id and s.event_type = 'signup' and s.event_id <= p.event_id) as b, (select min(s.event_id) from e s where s.user_id = p.user_id and s.event_type = 'signup' and s.event_id >= p.event_id) as a from e p where event_type = 'purchase') select event_id, case when a is null or event_id - b <= a - event_id then b else a end as signup from p",
    "carried": f"with {_EV} select event_id, max(case when state = 1 and value is not null then event_id end) over w as source, round(last_value(case when state = 1 then value end ignore nulls) over w, 6) as v from e window w as (partition by user_id order by event_id)",
    "repeats_censored": f"""with {_EV}, r as (select *, last_value(nullif(state, 0) ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as before, row_number() over (partition by user_id, state order by event_id) as i from e)
        select event_id, case when state <> 0 and state = before then 0 else state end as last, case when state <> 0 and i > 1 then 0 else state end as "any" from r""",
    "merged_updates": f"""with {_EV}, s as (select user_id, cast(min(event_id) - 1 as double) as a, cast(max(event_id) as double) as b from e group by 1), u as (select user_id, cast(event_id as double) as t, round(value, 2) as paid from e where state = 1 and value is not null), o as (select user_id, cast(event_id as double) as t from e where state = 1),
        p as (select user_id, a as start from s union select s.user_id, u.t from s join o u on u.user_id = s.user_id where u.t > a and u.t < b), q as (select p.user_id, p.start, lead(p.start, 1, s.b) over (partition by p.user_id order by p.start) as stop from p join s on s.user_id = p.user_id)
        select user_id, start, stop, (select arg_max(paid, t) from u where u.user_id = q.user_id and t <= start) as paid, (select count(*) from o where o.user_id = q.user_id and t <= start) as so_far, cast((select count(*) from o where o.user_id = q.user_id and t = stop) as integer) as ends from q""",
    "places": f"""with {_EV}, g as (select user_id, event_id as a, lead(event_id) over (partition by user_id order by event_id) as b from e where state = 2), b as (select * from g where b is not null), x as (select user_id, min(a) as lo, max(b) as hi from b group by 1),
        u as (select e.event_id as t, x.*, exists (select 1 from b where b.user_id = e.user_id and b.a = e.event_id) as st, exists (select 1 from b where b.user_id = e.user_id and b.b = e.event_id) as en, exists (select 1 from b where b.user_id = e.user_id and b.a < e.event_id and e.event_id < b.b) as ins from e left join x on x.user_id = e.user_id where state = 1 or event_id % 5 = 0)
        select case when lo is null then 'no key' when t < lo then 'early' when t > hi then 'late' when ins then 'within' when st and en then 'boundary' when st then 'leading' when en then 'trailing' else 'gap' end as place, count(*) as n from u group by 1""",
    "visit_intervals": f"with {_EV}, {_VISITS} select user_id, start, stop, \"from\", case when event = \"from\" then 0 else event end as event from iv",
    "states_on": f"""with {_EV}, r as (select *, lag(state) over (partition by user_id order by event_id) as b, row_number() over (partition by user_id order by event_id) as i from e), f as (select user_id, event_id as a, state from r where i = 1 or state <> b), g as (select *, lead(a) over (partition by user_id order by a) as z from f), t as (select cast(unnest([100, 250.5, 900]) as double) as t)
        select user_id, t as time, state from g, t where z is not null and a <= t and t < z""",
    "state_runs": f"""with e as (select event_id, user_id, ({CODE}) % 2 as state from events), {_VISITS}, r as (select *, case when lag("from") over w = "from" then 0 else 1 end as fresh from iv window w as (partition by user_id order by start)), q as (select *, sum(fresh) over (partition by user_id order by start) as run from r)
        select user_id, "from", min(start) as start, max(stop) as stop from q group by user_id, run, "from\"""",
    "history_flags": f"""with {_LI}, r as (select l_orderkey as k, l_linenumber - case when l_suppkey % 7 = 0 then 2 else 1 end as a, l_linenumber - case when l_suppkey % 11 = 0 then 0.5 else 0.0 end as b, returned as e, case when l_partkey % 3 = 0 then 1 else 0 end as s from l),
        q as (select *, lag(b) over w as pb, lag(e) over w as pe, lag(s) over w as ps from r window w as (partition by k order by b, a, e, s)), f as (select *, s is distinct from case when pe <> 0 then pe else ps end as moved from q)
        select case when b <= a then 'invalid' when pb is null then 'ok' when a < pb - 1e-10 then 'overlap' when a > pb + 1e-10 and moved then 'jump' when a > pb + 1e-10 then 'gap' when moved then 'teleport' else 'ok' end as flag, count(*) as n from f group by 1""",
    "state_changes": f"with {_EV}, {_VISITS} select \"from\", case when event = \"from\" then 0 else event end as \"to\", count(*) as n from iv where event <> 0 and event <> \"from\" group by all",
    "idle_rows": f"with {_LI}, ev as (select distinct l_tax, l_linestatus, l_quantity as t from l where returned = 1 and l_suppkey % 50 = 0) select l_tax, cast(count(*) filter (not exists (select 1 from ev where ev.l_tax = l.l_tax and ev.l_linestatus = l.l_linestatus and ev.t > l.l_quantity - 0.5 and ev.t <= l.l_quantity)) as bigint) as idle from l group by 1",
    "age_cells": f"""with {_LI}, b as (select * from (values (0, 0.0, 20.0), (1, 20.0, 40.0), (2, 40.0, 100.0)) t(cut, lo, hi)), p as (select l_linestatus, cut, greatest(0.0, lo - l_linenumber * 5.0) as a, least(l_quantity, hi - l_linenumber * 5.0) as z, l_quantity, returned from l, b)
        select l_linestatus, cut, count(*) as n, cast(sum(case when z = l_quantity then returned else 0 end) as double) as events, round(sum(z - a), 6) as person_time, round(sum(case when z = l_quantity then returned else 0 end) / sum(z - a), 6) as rate from p where z > a group by all""",
    "cut_codes": """with e as (select nullif(value, 0) as v from events), c as (select case when v >= 10 and v < 50 then 0 when v >= 50 and v < 100 then 1 when v >= 100 and v <= 400 then 2 when v is not null then -1 end as cut from e)
        select cut, case cut when 0 then '10+ thru 50' when 1 then '50+ thru 100' when 2 then '100+ thru 400' end as cut_label, count(*) as n from c group by 1, 2""",
    "redistributed": f"""with {_LI}, c as (select l_linestatus, l_quantity as t, cast(sum(returned) as double) as d, cast(sum(1 - returned) as double) as c from l group by all), n as (select *, sum(d + c) over (partition by l_linestatus order by t desc) as n from c), g as (select *, product(case when n - d > 0 then 1 - c / (n - d) else 1 end) over (partition by l_linestatus order by t) as g from n),
        w as (select *, coalesce(lag(g) over (partition by l_linestatus order by t), 1.0) as b from g), x as (select cast(unnest([10.0, 30.0]) as double) as x), m as (select w.l_linestatus, x, coalesce(max(g) filter (false), 1.0) as z, min(case when t < x then g end) as gx from w, x group by w.l_linestatus, x)
        select l_linestatus, null::double as "at", round(sum(d / b), 4) as total, round(max(case when d > 0 then 1 / b else 0 end), 6) as top from w group by 1
        union all select w.l_linestatus, x, round(sum(case when t <= x then d / b else (d + c) / gx end), 4), round(max(case when t <= x then case when d > 0 then 1 / b else 0 end else 1 / gx end), 6) from w join m on m.l_linestatus = w.l_linestatus group by all""",
    "strata_codes": f"with {_LI}, r as (select l_linestatus, nullif(l_linenumber % 3, 0) as k, count(*) as n from l group by all) select row_number() over (order by l_linestatus nulls first, k nulls first) - 1 as stratum, 'l_linestatus=' || l_linestatus || ', k=' || coalesce(cast(k as varchar), 'null') as stratum_label, n from r",
    "first_seen_codes": "with f as (select user_id, row_number() over (order by min(event_id)) - 1 as cluster from events group by 1) select event_id, cluster from events join f using (user_id)",
    "condensed_plan": f"""with {_LI}, r as (select distinct l_orderkey as k, l_linenumber - 1 as a, l_linenumber as b, returned as e from l), n as (select *, case when lag(b) over w = a and lag(e) over w = 0 then 0 else 1 end as fresh from r window w as (partition by k order by a, b, e)), q as (select *, sum(fresh) over (partition by k order by a, b, e, fresh rows unbounded preceding) as run from n),
        z as (select *, row_number() over (partition by k, run order by b desc, e desc) = 1 as kept, min(a) over (partition by k, run) as ra from q) select kept, count(*) as n, cast(sum(run) as bigint) as runs, cast(sum(ra) as bigint) as starts from z group by 1""",
    "designs_by_ratio": f"""with s as (select distinct round(0.45 + 5 * l_tax, 2) as hr from lineitem), f as (select hr, ({Z_A} + {Z_B}) ** 2 as z, (0.6 + 1 - 0.4 ** hr) / 2 as p from s where hr < 0.99), g as (select *, ceil(z * (hr + 1) ** 2 / (p * (hr - 1) ** 2)) as fr from f),
        x as (select *, 200 * least(1 - exp(-0.06 * 24), (1 - exp(-0.06 * 36)) / (0.06 * 12)) * 0.05 / 0.06 as e0, 200 * least(1 - exp(-(0.05 * hr + 0.01) * 24), (1 - exp(-(0.05 * hr + 0.01) * 36)) / ((0.05 * hr + 0.01) * 12)) * 0.05 * hr / (0.05 * hr + 0.01) as e1 from g)
        select hr, cast(ceil(z * 4 / ln(hr) ** 2) as bigint) as schoenfeld, cast(fr as bigint) as freedman, cast(ceil(fr / p) as bigint) as n_total, round(e0 + e1, 6) as expected_events from x""",
    "poisson": f"with {_LI}, c as (select l_tax, cast(sum(returned) as double) as k, sum(l_quantity) as t from l group by 1) select l_tax, round(case when k > 0 then (sqrt(k - 0.125) - {Z_A} / 2) ** 2 else 0 end / t * 1000, 6) as lower, round((sqrt(k + 0.875) + {Z_A} / 2) ** 2 / t * 1000, 6) as upper from c",
    "curve_scales": f"""with {_LI}, {_KM}, f as (select time, s, s * sqrt(g) as se, -ln(s) as h from k where s > 0 and s < 1)
        select time, round(s, 5) as surv, round(h, 5) as cumhaz, round(greatest(0.0, h - {Z_A} * se / s), 5) as cumhaz_low, round(ln(h), 5) as cloglog, round(ln(h) - {Z_A} * se / (s * h), 5) as cloglog_low, round(ln((1 - s) / s), 5) as loglogistic, round(ln((1 - s) / s) - {Z_A} * se / (s * (1 - s)), 5) as loglogistic_low from f""",
    "residual_life": f"with {_LI}, {_KM}, a as (select time, s, lead(time) over (order by time) as t1, lead(s) over (order by time) as s1 from k where time >= 10) select round(sum((t1 - time) * (s + s1) / 2) / (select arg_max(s, time) from k where time <= 10), 6) as residual_life, round((select s from k where time = 30) / (select arg_max(s, time) from k where time <= 10), 6) as ten_to_thirty from a",
    "warranty_costs": f"with {_LI}, {_KM}, t as (select unnest(range(9)) * 2.5 as t), f as (select cast(t as double) as time, 1000 * (1 - coalesce((select arg_max(s, time) from k where k.time <= t.t), 1.0)) as f from t) select time, round(f, 6) as failures, round(f * 30 * exp(-0.01 * time), 6) as cost from f",
    "renewals": f"""with {_LI}, a as (select avg(l_quantity) as m, var_samp(l_quantity) as v from l where returned = 1), g as (select value as t, row_number() over (order by value) as i from events where value > 1), r as (select 1 - regr_slope(ln(i), ln(t)) as gr, max(t) / count(*) as fm from g)
        select round(m, 6) as mtbf, round(100 / m, 6) as renewals, round(100 * v / m ** 3, 6) as renewal_variance, round(m / (m + 2), 6) as availability, round(gr, 6) as growth_rate, round(fm, 6) as final_mtbf from a, r""",
    "quality_time": f"""with {_LI}, c as (select l_linestatus, l_quantity as time, cast(sum(returned) as double) as d, cast(count(*) as double) as c from l group by all), n as (select *, sum(c) over (partition by l_linestatus order by time desc) as n from c), k as (select *, product(1 - d / n) over (partition by l_linestatus order by time) as s from n),
        t as (select l_linestatus, time as t from k where time <= 30 union select l_linestatus, cast(unnest([0.0, 15.0, 30.0]) as double) from (select distinct l_linestatus from l)), s as (select t.l_linestatus, t, coalesce((select arg_max(s, time) from k where k.l_linestatus = t.l_linestatus and time <= t), 1.0) as s from t),
        p as (select *, lag(t) over w as t0, lag(s) over w as s0 from s window w as (partition by l_linestatus order by t)), q as (select l_linestatus, (s + s0) / 2 * (t - t0) as a, case when t0 >= 15 then 0.6 else 0.9 end as u, (t + t0) / 2 as m from p where t0 is not null)
        select l_linestatus, round(sum(a * u), 6) as qaly, round(sum(a * u * 1.03 ** (-m)), 6) as discounted_qaly, round(sum(a), 6) as life_years, round(sum(a * u) / sum(a), 6) as mean_utility from q group by 1""",
    "toxicity_time": f"""with {_LI}, r as (select l_linestatus, least(l_quantity, 30.0) as o, case when l_linenumber < 4 then l_linenumber - 1.5 end as ts, case when l_linenumber <> 2 then l_linenumber + 4.0 end as te, case when returned = 1 then l_quantity * 0.75 end as rel from l),
        x as (select l_linestatus, o, case when ts is null then 0 else greatest(0.0, least(coalesce(te, o), o) - greatest(0.0, ts)) end as tox, case when rel < o then o - rel else 0 end as rl from r), m as (select l_linestatus, avg(tox) as a, avg(greatest(0.0, o - tox - rl)) as b, avg(rl) as c, avg(o) as t from x group by 1), u as (select unnest([0.2, 0.5]) as u)
        select l_linestatus, cast(u as double) as utility_toxicity, round(a, 6) as toxicity, round(b, 6) as free, round(c, 6) as relapse, round(t, 6) as total, round(u * a + b + 0.5 * c, 6) as qtwist from m, u""",
    "expected_curves": f"""with {_LI}, {_COHORT}, h as (select *, {_haz('500.0')} as h1, {_haz('2000.0')} as h2 from co)
        select 'ederer' as method, 500.0::double as "at", count(*) as n, round(avg(exp(-h1)), 6) as surv, round(avg(h1), 6) as hazard from h union all select 'ederer', 2000.0, count(*), round(avg(exp(-h2)), 6), round(avg(h2), 6) from h
        union all select 'hakulinen', 500.0, count(*), round(avg(exp(-h1)), 6), round(avg(h1), 6) from h where days >= 500 union all select 'hakulinen', 2000.0, count(*), round(avg(exp(-h2)), 6), round(avg(h2), 6) from h where days >= 2000
        union all select 'conditional', 500.0, count(*), round(exp(-avg(h1)), 6), round(avg(h1), 6) from h where days >= 500
        union all select 'conditional', 2000.0, count(*), round(exp(-(avg(h2 - h1) + (select avg(h1) from h where days >= 500))), 6), round(avg(h2 - h1) + (select avg(h1) from h where days >= 500), 6) from h where days >= 2000""",
    "standardised_ratio": f"with {_LI}, {_COHORT}, h as (select *, {_haz('days')} as h from co) select l_tax, count(*) as n, cast(sum(returned) as double) as events, round(sum(days) / 365.25, 6) as person_years, round(sum(h), 6) as expected, round(sum(returned) / (sum(days) / 365.25), 6) as rate, round(sum(returned) / sum(h), 6) as smr from h group by 1",
    "net_curves": f"""with {_LI}, r as (select l_quantity as t, returned as d, exp(-0.002 * l_linenumber * l_quantity) as e from l), c as (select t, sum(d / e) as dw, sum(1 / e) as w, cast(sum(d) as double) as d, cast(count(*) as double) as c, sum(e) as e from r group by 1), n as (select *, sum(w) over o as rw, sum(c) over o as n, sum(e) over o as re from c window o as (order by t desc))
        select t as time, round(greatest(0.0, product(1 - dw / rw) over a), 6) as pohar, round(sum(dw / rw) over a, 6) as excess, round(product(1 - dw / rw) over a * sqrt(sum(case when dw < rw then dw / rw / (1 - dw / rw) / rw else 0 end) over a), 6) as std_err, round(product(1 - d / n) over a / (re / n), 6) as ederer from n window a as (order by t)""",
    "crude_shares": f"""with {_LI}, t as (select cast(unnest([10.0, 40.0]) as double) as t) select t as "at", round(avg(case when l_quantity <= t and returned = 1 and l_linenumber % 3 = 1 then 1.0 else 0 end), 6) as of_cause, round(avg(case when l_quantity <= t and returned = 1 and l_linenumber % 3 <> 1 then 1.0 else 0 end), 6) as other from l, t group by 1""",
    "transition_curves": f"""with {_EV}, {_VISITS}, m as (select "from", event, case when event <> 0 then 1 else 0 end as e, ceil(stop / 50) * 50 as t, floor(start / 50) * 50 as s from iv), x as (select "from", event as "to", t, count(*) as n from m where e = 1 group by all),
        r as (select x.*, (select count(*) from m where m."from" = x."from" and m.t >= x.t and m.s < x.t) as y from x) select "from", "to", cast(t as double) as time, cast(y as double) as n_risk, cast(n as double) as n, round(sum(n / y) over w, 6) as cum_hazard, round(sum(n / y / y) over w, 6) as variance from r window w as (partition by "from", "to" order by t)""",
    "occupation": f"""with {_LI}, c as (select l_quantity as t, cast(sum(returned) as double) as d, cast(sum(returned * (1 - l_linenumber % 2)) as double) as k1, cast(sum(returned * (l_linenumber % 2)) as double) as k2, cast(count(*) as double) as c from l group by 1), n as (select *, sum(c) over (order by t desc) as n from c), s as (select *, product(1 - d / n) over (order by t) as s from n), b as (select *, coalesce(lag(s) over (order by t), 1.0) as b from s)
        select t as time, 0 as state, round(s, 6) as probability from b where d > 0 union all select t, 1, round(sum(b * k1 / n) over (order by t), 6) from b where d > 0 union all select t, 2, round(sum(b * k2 / n) over (order by t), 6) from b where d > 0""",
    "markov": f"with {_EV}, {_VISITS}, s as (select \"from\", cast(sum(stop - start) as double) as t from iv group by 1), m as (select \"from\", event as \"to\", count(*) as n from iv where event <> 0 group by all) select m.\"from\", \"to\", n as transitions, t as time_at_risk, round(n / t, 9) as rate from m join s on s.\"from\" = m.\"from\"",
    "sojourns": f"with {_EV}, {_VISITS} select \"from\" as state, count(*) as n, cast(count(*) filter (event <> 0) as double) as events, round(sum(stop - start) / count(*) filter (event <> 0), 6) as mean_time, round(count(*) filter (event <> 0) / sum(stop - start), 6) as rate from iv group by 1",
    "missing_patterns": "with p as (select case when nullif(l_tax, 0.0) is null then '1' else '0' end || case when l_linenumber = 2 then '1' else '0' end || case when l_discount = 0.01 then '1' else '0' end as pattern from lineitem) select pattern, count(*) as n, not contains(pattern, '10') as monotone from p group by 1",
    "missing_percent": "select 'a' as column, round(100 * avg(case when l_tax = 0 then 1.0 else 0 end), 6) as percent from lineitem union all select 'b', round(100 * avg(case when l_linenumber = 2 then 1.0 else 0 end), 6) from lineitem",
    "moran": """with a as (select n_nationkey as k, n_regionkey as r, sum(case when c_acctbal < 0 then 1.0 else 0 end) / (count(*) * 0.1) as v from nation join customer on c_nationkey = n_nationkey group by all), z as (select *, v - avg(v) over () as z, count(*) over () as n from a), p as (select count(*) as w, sum(x.z * y.z) as num from z x join z y on x.r = y.r and x.k <> y.k), d as (select sum(z * z) as den, max(n) as n from z),
        i as (select n / w * num / den as i, -1.0 / (n - 1) as e, n * n / (w * w * (n - 1)) as v from p, d) select round(i, 6) as i, round(e, 6) as expected, round((i - e) / sqrt(v), 6) as z from i""",
    "smoothed": "with a as (select n_nationkey as k, n_regionkey as r, sum(case when c_acctbal < 0 then 1.0 else 0 end) / (count(*) * 0.1) as v from nation join customer on c_nationkey = n_nationkey group by all) select k as region, round(v, 6) as raw, round((0.6 * v + 0.4 * coalesce((select sum(v) from a b where b.r = a.r and b.k <> a.k), 0)) / (0.6 + 0.4 * (select count(*) from a b where b.r = a.r and b.k <> a.k)), 6) as smoothed from a",
}

QUERIES = [next_signup, closest_signup, carried, repeats_censored, merged_updates, places, visit_intervals, states_on, state_runs, history_flags, state_changes, idle_rows, age_cells, cut_codes, redistributed, strata_codes, first_seen_codes, condensed_plan, designs_by_ratio, poisson, curve_scales, residual_life, warranty_costs, renewals, quality_time, toxicity_time, expected_curves, standardised_ratio, net_curves, crude_shares, transition_curves, occupation, markov, sojourns, missing_patterns, missing_percent, moran, smoothed]

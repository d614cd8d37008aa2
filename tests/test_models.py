"""Models against published values, closed forms and one another; nulls, ties and odd inputs."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from censorium.functions import special
from censorium.functions.prefix import as_of, binned, running
from censorium.operators import aft, causal, compare, conformal, cox, curves, data_prep, designs, explain, intervals, metrics, missing, penalized, states
from censorium.streaming.counts import event_rates
from tests.test_core import MAINTAINED, OTHERS

Q = dict(time="time", status="status")


@pytest.fixture(scope="module")
def aml(spark):
    rows = [(i, t, s, 0.0) for i, (t, s) in enumerate(MAINTAINED)] + [(100 + i, t, s, 1.0) for i, (t, s) in enumerate(OTHERS)]
    return spark.createDataFrame(rows, "id int, time int, status int, x double").cache()


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(5)
    n = 150
    x = rng.normal(size=(n, 3))
    t = rng.exponential(np.exp(-0.8 * x[:, 0] + 0.3 * x[:, 1]))
    c = rng.exponential(1.5, n)
    rows = [(i, float(round(min(a, b) + 0.01, 2)), int(a <= b), *map(float, v), i % 3) for i, (a, b, v) in enumerate(zip(t, c, x, strict=True))]
    return spark.createDataFrame(rows, "id int, time double, status int, a double, b double, c double, g int").cache()


def test_special():
    assert special.chi2_sf(3.396388699, 1) == pytest.approx(0.065339322041, abs=1e-9)
    assert special.chi2_sf(9.487729036781154, 4) == pytest.approx(0.05, abs=1e-10)
    assert special.gamma_quantile(0.025, 10) == pytest.approx(4.795389, abs=1e-5)
    assert special.gamma_quantile(0.975, 11) == pytest.approx(18.390356, abs=1e-5)


def test_running_goes_by_ranges(spark):
    """No range of many distinct values holds much more than its share, and sums are those of one pass."""
    df = spark.range(1_000_000).select((F.col("id") * 7919 % 1_000_003).cast("double").alias("v"))
    sizes = [r["n"] for r in binned(df, "v").groupBy("_bin").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 50 and max(sizes) < 8 * np.median(sizes)
    small = spark.createDataFrame([(k, float(v)) for k in (None, "p", "q") for v in range(50)], "k string, v double")
    out = running(small, order="v", keys=["k"], sums={"s": F.col("v")}, products={"f": F.lit(2.0)}, maxima={"m": F.col("v")}, reverse=True, strict=True).collect()
    assert len(out) == 150
    for r in out:
        assert r["s"] == sum(range(int(r["v"]) + 1, 50)) and r["f"] == 2.0 ** (49 - r["v"]) and r["m"] == (49.0 if r["v"] < 49 else None)


def test_as_of_edges(spark):
    steps = spark.createDataFrame([(None, 1.0, "a"), (None, 1.0, "b"), (1, 2.0, "c")], "k int, t double, v string")
    asked = spark.createDataFrame([(None, 1.0), (None, 0.5), (1, 9.0), (2, 9.0), (1, None)], "k int, at double")
    got = {(r["k"], r["at"]): r["v"] for r in as_of(asked, steps, at="at", step="t", values=["v"], keys=["k"]).collect()}
    assert got == {(None, 1.0): "b", (None, 0.5): None, (1, 9.0): "c", (2, 9.0): None, (1, None): None}
    strict = as_of(asked, steps, at="at", step="t", values=["v"], keys=["k"], strict=True).where("k is null and at = 1").first()
    assert strict["v"] is None


def test_logrank_groups(spark, aml, wide):
    row = compare.logrank_test(aml, group="x", **Q).first()
    assert (row["chi_square"], row["p"], row["df"]) == (pytest.approx(3.396388699), pytest.approx(0.065339322041), 1)
    parts = {r["x"]: r for r in compare.logrank_components(aml, group="x", **Q).collect()}
    assert parts[0.0]["expected"] == pytest.approx(10.6893359923) and parts[1.0]["observed"] == 11
    assert compare.logrank_test(aml, group="x", weights="peto", **Q).first()["chi_square"] == pytest.approx(2.7792795448, rel=0.05)
    three = compare.logrank_test(wide, group="g", **Q).first()
    assert three["df"] == 2 and 0 <= three["p"] <= 1
    with pytest.raises(Exception, match="two values"):
        compare.logrank(wide, group="g", **Q).collect()
    with pytest.raises(Exception, match="two values"):
        compare.risk_difference(wide, group="g", horizon=0.5, **Q).collect()
    assert compare.logrank_test(aml.where("x = 0"), group="x", **Q).first()["chi_square"] is None


def test_cox_published(aml):
    breslow, efron = (cox.cox_fit(aml, x=["x"], ties=t, **Q) for t in ("breslow", "efron"))
    assert efron.coefficients[0] == pytest.approx(0.91553257501, abs=1e-7)
    assert efron.std_errors[0] == pytest.approx(0.51193427517, abs=1e-7)
    assert (efron.null_log_likelihood, efron.log_likelihood) == (pytest.approx(-42.7248392628), pytest.approx(-41.0326155965))
    assert breslow.null_log_likelihood == pytest.approx(-42.8981238972)
    assert breslow.score_statistic == pytest.approx(3.3225614163)
    assert breslow.wald_statistic == pytest.approx(3.12, abs=0.01)
    assert breslow.ratio_statistic == pytest.approx(3.2960190942)
    assert cox.wald_test(breslow)[0] == pytest.approx(breslow.wald_statistic)
    assert breslow.table(aml.sparkSession).first()["hazard_ratio"] == pytest.approx(2.4700038854)
    res = cox.residuals(aml, x=["x"], coefficients=efron.coefficients, ties="efron", **Q)
    sums = res.agg(F.sum("martingale"), F.sum("score_x"), F.count("*")).first()
    assert sums[0] == pytest.approx(0, abs=1e-6) and sums[1] == pytest.approx(0, abs=1e-5) and sums[2] == 23


def test_cox_is_consistent(wide):
    """Splitting rows changes nothing, weights are repeated rows, a large covariate can't overflow."""
    x = ["a", "b"]
    fit = cox.cox_fit(wide, x=x, ties="efron", **Q)
    assert fit.coefficients == pytest.approx([0.8, -0.3], abs=0.4)
    split = data_prep.split_at(wide.withColumn("start", F.lit(0.0)), start="start", stop="time", event="status", cuts=[0.2, 0.5, 1.0])
    again = cox.cox_fit(split, time="time", status="status", entry="start", x=x, ties="efron")
    assert again.coefficients == pytest.approx(fit.coefficients, abs=1e-6) and again.log_likelihood == pytest.approx(fit.log_likelihood)
    twice = wide.withColumn("w", F.when(F.col("id") % 2 == 0, 2).otherwise(1))
    repeated = wide.unionByName(wide.where("id % 2 = 0"))
    assert cox.cox_fit(twice, x=x, weight="w", **Q).coefficients == pytest.approx(cox.cox_fit(repeated, x=x, **Q).coefficients, abs=1e-6)
    far = cox.cox_fit(wide.withColumn("a", F.col("a") + 1e4), x=["a"], **Q)
    assert far.coefficients[0] == pytest.approx(cox.cox_fit(wide, x=["a"], **Q).coefficients[0], rel=1e-3)


def test_cox_follow_ups(wide):
    x = ["a", "b"]
    fit = cox.cox_fit(wide, x=x, strata=["g"], **Q)
    res = cox.residuals(wide, x=x, coefficients=fit.coefficients, strata=["g"], **Q)
    robust = cox.robust_covariance(res, fit)
    assert np.sqrt(np.diag(robust)) == pytest.approx(fit.std_errors, rel=0.6)
    tests = {r["term"]: r for r in cox.hazards_test(wide, fit=fit, strata=["g"], transform="rank", **Q).collect()}
    assert set(tests) == {"a", "b", "GLOBAL"} and tests["GLOBAL"]["df"] == 2 and all(0 <= r["p"] <= 1 for r in tests.values())
    base = cox.base_hazard(wide, x=x, coefficients=fit.coefficients, strata=["g"], **Q)
    seen = cox.predict(wide, x=x, fit=fit, baseline=base, at="time", strata=["g"])
    # observed less expected events are the martingale residuals
    gap = seen.select("id", (F.col("status") - F.col("expected")).alias("m")).join(res.select("id", "martingale"), "id").agg(F.max(F.abs(F.col("m") - F.col("martingale")))).first()[0]
    assert gap < 1e-9
    marks = cox.landmark_fits(wide, x=x, at=[0.1], horizon=1.0, **Q)
    assert set(marks) == {0.1}


def test_recurrent(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(120):
        x, at = float(i % 2), 0.0
        for k in range(4):
            gap = float(rng.exponential(1 / np.exp(0.7 * x)))
            stop = min(at + gap, 3.0)
            rows.append((i, at, round(stop, 4), int(at + gap < 3.0), x, k))
            at = round(stop, 4)
            if at >= 3.0:
                break
    df = spark.createDataFrame(rows, "id int, a double, b double, e int, x double, k int").where("b > a")
    for model in ("andersen-gill", "pwp-gap"):
        fit, cov = cox.recurrent(df, subject="id", start="a", stop="b", status="e", x=["x"], model=model, number="k")
        assert 0.1 < fit.coefficients[0] < 2.5 and cov[0, 0] > 0


def test_penalised(wide):
    x = ["a", "b", "c"]
    free = cox.cox_fit(wide, x=x, **Q)
    top = penalized.largest_penalty(wide, x=x, **Q)
    fits = penalized.elastic_net(wide, x=x, penalties=[1.01 * top, 0.2 * top, 0.0], **Q)
    assert not fits[0].nonzero and "a" in fits[1].nonzero
    assert fits[2].coefficients == pytest.approx(free.coefficients, abs=1e-4)
    assert abs(penalized.ridge(wide, x=x, penalty=0.5, **Q).coefficients[0]) < abs(free.coefficients[0])
    groups = penalized.group_lasso(wide, x=x, groups=[0, 1, 1], penalty=0.4 * top, **Q)
    assert (groups.coefficients[1] == 0) == (groups.coefficients[2] == 0)


def test_parametric(wide, aml):
    events, total = wide.agg(F.sum("status"), F.sum("time")).first()
    fit = aft.time_fit(wide, family="exponential", **Q)
    assert math.exp(fit.coefficients[0]) == pytest.approx(total / events, rel=1e-6)
    weibull = aft.time_fit(aml, x=["x"], **Q)
    # published: intercept 4.109, effect -0.929, log scale -0.235
    assert weibull.coefficients == pytest.approx([4.109, -0.929], abs=2e-3) and math.log(weibull.scale) == pytest.approx(-0.235, abs=2e-3)
    assert weibull.log_likelihood == pytest.approx(-80.5, abs=0.05)
    for family in ("lognormal", "loglogistic"):
        got = aft.time_fit(wide, x=["a"], family=family, **Q)
        assert got.coefficients[1] < 0 and got.scale > 0
    rows = aft.predicted_curve(aft.predicted(aml, weibull, quantiles=[0.5]), weibull, time="time").withColumn("q", F.col("quantiles")[0])
    half = aft.predicted_curve(rows.drop("surv"), weibull, time="q").agg(F.min("surv"), F.max("surv")).first()
    assert half[0] == pytest.approx(0.5) and half[1] == pytest.approx(0.5)
    assert aft.time_residuals(aml, weibull, **Q).agg(F.sum("martingale")).first()[0] == pytest.approx(0, abs=1e-3)


def test_interval_censored(spark, aml):
    """Exact and right-censored rows give the Kaplan–Meier curve."""
    rows = aml.where("x = 1").select(F.col("time").cast("double").alias("l"), F.when(F.col("status") == 1, F.col("time").cast("double")).alias("r"))
    got = {r["hi"]: r["surv"] for r in intervals.interval_curve(rows, left="l", right="r", most=25).collect()}
    want = {r["time"]: r["surv"] for r in curves.kaplan_meier(aml.where("x = 1"), **Q).where("n_event > 0").collect()}
    assert {k: got[k] for k in want} == pytest.approx(want, abs=1e-3)


def test_fine_gray(spark, wide):
    """Without competing events it is a Cox model; with them rows stay at risk with falling weights."""
    plain = states.fine_gray(wide.withColumn("cause", F.col("status")), time="time", cause="cause", x=["a"])
    assert plain.coefficients[0] == pytest.approx(cox.cox_fit(wide, x=["a"], **Q).coefficients[0], abs=1e-6)
    df = spark.createDataFrame([(1.0, 1), (2.0, 2), (3.0, 0), (4.0, 1), (5.0, 0), (6.0, 1)], "t double, c int")
    rows = states.subdistribution_rows(df, time="t", cause="c").where("t = 2").orderBy("fg_start").collect()
    assert [(r["fg_start"], r["fg_stop"]) for r in rows] == [(0.0, 3.0), (3.0, 5.0), (5.0, 6.0)]
    # censorings at 3 (one of 4 at risk) and 5 (one of 2)
    assert [r["fg_weight"] for r in rows] == pytest.approx([1.0, 0.75, 0.375])


def test_markov(spark):
    rates = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.25)], "from int, to int, rate double")
    p = {(r["time"], r["state"]): r["probability"] for r in states.markov_probabilities(rates, initial={0: 1.0}, times=[2.0]).collect()}
    assert p[2.0, 0] == pytest.approx(math.exp(-1.5)) and p[2.0, 1] == pytest.approx((1 - math.exp(-1.5)) * 2 / 3)


def test_designs(spark):
    one = spark.createDataFrame([(10, 0.5, 88)], "k int, hr double, n int")
    exact = designs.poisson_limits(one, count="k").first()
    assert (exact["lower"], exact["upper"]) == (pytest.approx(4.795389, abs=1e-5), pytest.approx(18.390356, abs=1e-5))
    assert designs.power(one, events="n", hazard_ratio="hr").first()["power"] == pytest.approx(0.9, abs=0.01)
    assert designs.ratio_limits(one, observed="k", expected="n").first()["ratio"] == pytest.approx(10 / 88)


def test_causal(spark):
    rng = np.random.default_rng(8)
    n = 600
    z = rng.normal(size=n)
    t = (rng.random(n) < 1 / (1 + np.exp(-z))).astype(int)
    y = 2.0 * t + z + rng.normal(size=n)
    d = rng.exponential(np.exp(-0.7 * t - 0.4 * z))
    df = spark.createDataFrame([(i, float(z[i]), int(t[i]), float(y[i]), float(d[i]), 1) for i in range(n)], "id int, z double, t int, y double, d double, e int").cache()
    fit = causal.logistic_fit(df, outcome="t", x=["z"])
    assert fit.coefficients == pytest.approx([0, 1], abs=0.35)
    assert causal.partialled_effect(df, outcome="y", treatment="t", x=["z"], row="id").first()["effect"] == pytest.approx(2, abs=0.3)
    got = causal.targeted_effect(df, outcome="y", treatment="t", x=["z"]).first()
    assert got["lower"] < got["effect"] < got["upper"]
    weights = causal.treatment_weights(df, treatment="t", x=["z"]).agg(F.avg("iptw")).first()[0]
    assert weights == pytest.approx(1, abs=0.1)
    assert causal.marginal_structural(df, time="d", status="e", treatment="t", x_treatment=["z"]).coefficients[0] > 0.3
    curves_ = causal.standardized_curves(df, time="d", status="e", treatment="t", x=["z"], times=[0.5, 1.0])
    assert all(r["treated"] < r["control"] for r in curves_.collect())
    assert causal.standardized_mean_difference(curves_, tau=1.0).first()["difference"] < 0
    assert causal.censoring_weights(df.withColumn("e", (F.col("id") % 4 != 0).cast("int")), time="d", status="e", x=["z"]).agg(F.min("ipcw")).first()[0] > 0


def test_missing(spark, wide):
    holes = wide.withColumn("a", F.when(F.col("id") % 5 != 0, F.col("a")))
    full = missing.imputed(holes, column="a", x=["b", "c"], row="id")
    assert full.where("a is null").count() == 0 and full.where("id % 5 <> 0").join(holes.select("id", F.col("a").alias("o")), "id").where("a <> o").count() == 0
    b, v = missing.pooled([(np.array([1.0]), np.eye(1)), (np.array([3.0]), np.eye(1))])
    assert b[0] == 2 and v[0, 0] == pytest.approx(1 + 1.5 * 2)
    assert missing.tipping_point([(0.0, np.array([1.0]), None), (2.0, np.array([-1.0]), None)], index=0) == 1.0


def test_nulls_take_no_part(spark):
    df = spark.createDataFrame([(0.5, 1), (None, 1), (None, 0), (0.25, None)], "p double, y int")
    assert metrics.brier_score(df, prediction="p", outcome="y").first()["brier"] == pytest.approx(0.25)
    assert [(r["bin"], r["n"]) for r in metrics.calibration(df, prediction="p", outcome="y", bins=8).collect()] == [(4, 1)]
    a = spark.createDataFrame([(float(i % 10),) for i in range(100)], "v double")
    holes = a.union(spark.createDataFrame([(None,)] * 3, "v double"))
    assert metrics.population_stability(a, holes, column="v", low=0.0, high=10.0).first()["psi"] == pytest.approx(0, abs=1e-9)
    assert metrics.pooled_stability(a, holes, columns=["v"]).first()["severity"] == "none"
    rows = spark.createDataFrame([(1, None, 1), (1, 5.0, None), (1, 2.0, 1)], "k int, t double, s int")
    assert tuple(data_prep.person_time(rows, time="t", status="s", keys=["k"]).select("n", "events", "person_time").first()) == (1, 1.0, 2.0)
    empty = spark.createDataFrame([], "t double, s int, p double")
    assert metrics.brier_score(empty, prediction="p", outcome="s").first()["brier"] is None
    assert curves.kaplan_meier(empty, time="t", status="s").count() == 0
    assert curves.restricted_mean(empty, time="t", status="s", tau=1.0).count() <= 1


def test_ties_are_settled(spark):
    rows = spark.createDataFrame([(1, 1, "b", 2), (1, 1, "a", 1), (1, 1, "b", 3), (1, 2, "b", 4)], "k int, t int, s string, i int")
    kept = data_prep.without_repeats(rows, key="k", time="t", state="s", tie=["i"])
    assert sorted(r["i"] for r in kept.collect()) == [1, 2]
    left = spark.createDataFrame([(1, 5)], "k int, t int")
    right = spark.createDataFrame([(1, 3, "x"), (1, 3, "y"), (1, 7, "z")], "k int, u int, v string")
    pick = lambda best: data_prep.nearest(left, right, key="k", left_time="t", right_time="u", value="v", best=best).first()["v"]
    assert [pick(b) for b in ("prior", "after", "closest")] == ["y", "z", "y"]


def test_conformal_weighted(spark):
    rows = spark.createDataFrame([(float(i), int(i % 3 > 0), 10.0) for i in range(1, 61)], "t double, s int, p double")
    cal = conformal.calibrate(rows, time="t", status="s", prediction="p", coverage=0.8)
    bounds = conformal.lower_bounds(rows, cal, prediction="p")
    got = conformal.coverage(bounds, time="t", status="s", lower="lower_bound").first()
    assert got["n_events"] == 40 and 0 <= got["coverage"] <= 1
    assert conformal.widths(bounds.withColumn("u", F.col("lower_bound") + 2), lower="lower_bound", upper="u", prediction="p").first()["mean_width"] == 2


def test_importance(wide):
    out = {r["feature"]: r["importance"] for r in explain.permutation_importance(wide, features=["a", "c"], coefficients=[0.8, 0.0], row="id", repeats=1, **Q).collect()}
    assert out["a"] > 0.05 and out["c"] == 0


def test_late_rows_are_dropped(spark, tmp_path):
    """Rows older than the watermark no longer change a window."""
    parts = [[("2024-01-01 10:05:00", "a")] * 2, [("2024-01-01 13:00:00", "a")], [("2024-01-01 13:01:00", "a")], [("2024-01-01 10:10:00", "a"), ("2024-01-01 12:55:00", "b")]]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("ts timestamp, kind string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for i, p in enumerate(parts):
        spark.createDataFrame(p, "ts string, kind string").select(F.col("ts").cast("timestamp"), "kind").coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
        for f in (tmp_path / f"p{i}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))  # files are taken in the order of their times
            f.rename(tmp_path / "in" / f"{i}-{f.name}")
    seen = []
    query = event_rates(stream, ts="ts", kind="kind").writeStream.outputMode("update").foreachBatch(lambda b, _: seen.extend((r["kind"], r["window"]["start"].hour, r["n"]) for r in b.collect())).option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert ("a", 10, 2) in seen and ("a", 10, 3) not in seen and ("b", 12, 1) in seen

"""Replicates against weights made in Python, and fits of replicates against fits of rows that are really copied."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from censorium.operators import aft, bootstrap, cox


def draws(ids, n, seed=0):
    out = []
    for g in range(-(-n // 4)):
        h = hashlib.md5("|".join([str(seed), *map(str, ids), str(g)]).encode()).hexdigest()
        out += [int(h[8 * j : 8 * j + 8], 16) for j in range(4)]
    return out[:n]


def poisson(u):
    """The smallest k whose distribution function exceeds the draw."""
    k, total, p = 0, math.exp(-1), math.exp(-1)
    while (u + 0.5) / 2**32 > total and k < 12:
        k += 1
        p /= k
        total += p
    return k


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    rows = [(i, i // 3, int(rng.integers(1, 12)), int(rng.random() < 0.6), round(float(rng.normal()), 2), round(float(rng.normal()), 2), "ab"[i % 2], float(rng.integers(0, 3))) for i in range(90)]
    return rows + [(200, 70, None, 1, 0.0, 0.0, "a", 0.0), (201, 71, 5, None, 0.0, 0.0, "b", 0.0), (202, 72, 6, 1, None, 1.0, None, None)]


@pytest.fixture(scope="module")
def rows(spark, data):
    return spark.createDataFrame(data, "id int, c int, t int, s int, x double, y double, g string, a double").persist()


def test_weights(rows, data):
    n = 10
    for kind in bootstrap.KINDS:
        got = {(r["id"], r["_b"]): r["_w"] for r in bootstrap.replicates(rows.repartition(5), ids=["c", "g"], n=n, kind=kind, seed=7).collect()}
        want = {}
        for r in data:
            for b, u in enumerate(draws([r[1], r[6] or ""], n, 7)):
                w = poisson(u) if kind == "poisson" else -math.log((u + 0.5) / 2**32)
                if w > 0:
                    want[r[0], b] = w
        assert got == pytest.approx(want)
    with pytest.raises(ValueError, match="kind"):
        bootstrap.replicates(rows, ids=["c"], n=3, kind="other")


def test_draws_are_fair(spark):
    got = bootstrap.replicates(spark.range(4000), ids=["id"], n=9).groupBy("_b").agg(F.sum("_w").alias("m"), F.sum(F.col("_w") ** 2).alias("q")).collect()
    for r in got:
        assert abs(r["m"] / 4000 - 1) < 0.06 and abs(r["q"] / 4000 - 2) < 0.25
    assert [bootstrap.places(n, level) for n, level in ((200, 0.95), (10, 0.9), (1, 0.5), (20, 0.9))] == [(5, 195), (0, 9), (0, 0), (1, 19)]


@pytest.mark.parametrize("entry", [None, "a"])
def test_curves_equal_those_of_copies(rows, data, entry):
    n, times = 12, (0.5, 4.0, 9.5, 30.0)
    got = {(r["g"], r["time"]): r for r in bootstrap.bootstrap_curve(rows, time="t", status="s", keys=["g"], ids=["id"], times=times, n=n, level=0.8, entry=entry).collect()}
    values = {}
    for b in range(n):
        for g in ("a", "b", None):
            copies = [(r[2], r[3], r[7] if entry and r[7] is not None else -1) for r in data if r[6] == g and r[2] is not None and r[3] is not None for _ in range(poisson(draws([r[0]], n)[b]))]
            copies = [c for c in copies if c[2] < c[0]]
            for t in times if copies else ():
                s = 1.0
                for u in sorted({c[0] for c in copies if c[1] and c[0] <= t}):
                    s *= 1 - sum(c[0] == u and c[1] for c in copies) / sum(c[2] < u <= c[0] for c in copies)
                values.setdefault((g, t), []).append(s)
    assert set(got) == set(values)
    for k, v in values.items():
        v.sort()
        low, high = bootstrap.places(len(v), 0.8)
        assert got[k]["n_replicates"] == len(v)
        np.testing.assert_allclose([got[k]["mean"], got[k]["lower"], got[k]["upper"]], [np.mean(v), v[low], v[high]], atol=1e-12)
        if len(v) > 1:
            assert got[k]["std_err"] == pytest.approx(np.std(v, ddof=1), abs=1e-12)


def test_cox_equals_fits_of_copies(spark, rows, data):
    n = 6
    # far from 0, and with clusters
    far = rows.withColumn("x", F.col("x") + 1e5)
    fit = bootstrap.bootstrap_cox(far, time="t", status="s", x=["x", "y"], strata=["g"], ids=["c"], n=n, seed=1)
    assert fit.replicates == list(range(n)) and fit.failed == 0
    np.testing.assert_allclose(fit.coefficients, cox.cox_fit(rows, time="t", status="s", x=["x", "y"], strata=["g"]).coefficients, atol=1e-5)
    for b in (0, 5):
        copies = spark.createDataFrame([r for r in data for _ in range(poisson(draws([r[1]], n, 1)[b]))], rows.schema)
        np.testing.assert_allclose(fit.samples[b], cox.cox_fit(copies, time="t", status="s", x=["x", "y"], strata=["g"]).coefficients, atol=1e-5)
    low, high = fit.limits()
    assert (low <= high).all() and fit.table(spark).count() == 2 and fit.sample_table(spark).count() == 2 * n
    np.testing.assert_allclose(fit.std_errors, fit.samples.std(axis=0, ddof=1))


def test_replicates_without_events_are_counted(spark):
    few = spark.createDataFrame([(1, 1, 1, 0.1), (2, 2, 0, 0.7), (3, 3, 1, 0.4), (4, 4, 0, 0.2)], "id int, t int, s int, x double")
    n = 12
    fit = bootstrap.bootstrap_cox(few, time="t", status="s", x=["x"], ids=["id"], n=n, most=12)
    lost = [b for b in range(n) if not (poisson(draws([1], n)[b]) or poisson(draws([3], n)[b]))]
    assert lost and not set(lost) & set(fit.replicates) and fit.failed == n - len(fit.replicates)


@pytest.mark.parametrize("family", ["weibull", "exponential", "lognormal"])
def test_parametric_replicates(spark, rows, data, family):
    n = 5
    fit = bootstrap.bootstrap_aft(rows, time="t", status="s", x=["x"], ids=["id"], family=family, n=n, seed=2)
    copies = spark.createDataFrame([r for r in data for _ in range(poisson(draws([r[0]], n, 2)[3]))], rows.schema)
    one = aft.time_fit(copies, time="t", status="s", x=["x"], family=family)
    want = [*one.coefficients, *([] if family == "exponential" else [math.log(one.scale)])]
    assert fit.names == ["intercept", "x", *([] if family == "exponential" else ["log_scale"])]
    np.testing.assert_allclose(fit.samples[fit.replicates.index(3)], want, atol=2e-4)


def test_empty_tables(rows):
    none = rows.limit(0)
    assert bootstrap.bootstrap_curve(none, time="t", status="s", ids=["id"], times=[1.0], n=3).count() == 0
    fit = bootstrap.bootstrap_cox(none, time="t", status="s", x=["x"], ids=["id"], n=3)
    assert fit.failed == 3 and np.isnan(fit.limits()[0]).all()


def test_a_step_draws_no_weights(spark, rows, monkeypatch):
    """Weights are drawn once, not in each step, and Breslow sums have no term an event."""
    plans, points = [], bootstrap._points

    def seen(df, at):
        out = points(df, at)
        plans.append(out._jdf.queryExecution().toString())
        return out

    monkeypatch.setattr(bootstrap, "_points", seen)
    bootstrap.bootstrap_cox(rows, time="t", status="s", x=["x"], ids=["c"], n=5)
    assert plans and not any("md5" in p for p in plans)
    sums = cox.risk_sums(rows.dropna(), time="t", status="s", x=["x"], lp=F.col("x"), strata=[], entry=None, weight=None, ties="breslow")
    assert "sequence(" not in sums._jdf.queryExecution().toString()


def test_steps_of_draws_are_compared_as_digits(spark):
    """Weights of many draws are those by numbers, the largest among them."""
    got = bootstrap.replicates(spark.range(3000), ids=["id"], n=6, seed=4).collect()
    want = {(i, b): poisson(u) for i in range(3000) for b, u in enumerate(draws([i], 6, 4))}
    assert {(r["id"], r["_b"]): r["_w"] for r in got} == {k: float(w) for k, w in want.items() if w}

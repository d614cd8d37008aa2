"""Exact ties: symmetric polynomials, published values, enumeration, and large ties."""

import tracemalloc
from itertools import combinations
from math import comb, lgamma, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from censorium.functions import symmetric
from censorium.operators import exact


def by_choice(lp, x, d):
    """Log sum, mean and covariance over all choices of d members."""
    at = list(combinations(range(len(lp)), d))
    w = np.exp([sum(lp[list(c)]) for c in at])
    s = np.array([x[list(c)].sum(axis=0) for c in at])
    m = (w[:, None] * s).sum(axis=0) / w.sum()
    return log(w.sum()), m, ((w / w.sum())[:, None, None] * (s - m)[:, :, None] * (s - m)[:, None, :]).sum(axis=0)


def test_products():
    rng = np.random.default_rng(1)
    sizes = [1, 3, 8, 5, 2]
    group = np.repeat(np.arange(5), sizes)
    lp, x, n = rng.normal(size=19), rng.normal(size=(19, 2)), rng.integers(1, 3, 19)
    got = symmetric.product(group, symmetric.copies(lp, x, n, 6), 6)
    for g in range(5):
        at = np.repeat(np.flatnonzero(group == g), n[group == g])
        for d in range(7):
            if d > len(at):
                assert got.log[g, d] == -np.inf
            else:
                want = by_choice(lp[at], x[at], d)
                assert got.log[g, d] == pytest.approx(want[0])
                np.testing.assert_allclose(got.mean[g, d], want[1], atol=1e-10)
                np.testing.assert_allclose(got.cov[g, d], want[2], atol=1e-10)


def test_a_thousand_ties_stay_finite():
    n, d = 4000, 1000
    x = np.linspace(-1, 1, n)[:, None]
    got = symmetric.product(np.zeros(n, dtype=int), symmetric.copies(np.zeros(n), x, np.ones(n, dtype=int), d), d)
    assert got.log[0, d] == pytest.approx(log(comb(n, d)), rel=1e-12)
    assert abs(got.mean[0, d, 0]) < 1e-6 and got.cov[0, d, 0, 0] == pytest.approx(d * (n - d) / (n - 1) * float((x**2).mean()), rel=1e-6)


#: Published values: (entry, time, status, covariates) and what a fit gives.
TIED = [(0.0, 2.0, 1, -0.8, 0.2), (0.0, 3.0, 1, 0.3, 1.3), (0.5, 3.0, 1, 1.1, -0.5), (0.5, 3.0, 0, -0.2, 0.8), (1.0, 4.0, 0, 0.7, -1.1), (1.0, 4.5, 1, 1.4, 0.4), (1.5, 5.0, 1, -1.0, 1.2), (2.0, 5.0, 1, 0.5, -0.7), (2.5, 5.0, 0, 1.0, 0.6), (3.0, 6.0, 1, -0.4, 1.0)]


def test_published(spark):
    one = spark.createDataFrame([(float(t), s, x) for t, s, x in zip(range(1, 7), (1, 0, 1, 1, 0, 1), (0.2, 1.1, -0.4, 0.8, 1.5, -0.2), strict=True)], "t double, s int, x double")
    fit = exact.exact_fit(one, time="t", status="s", x=["x"])
    assert fit.coefficients[0] == pytest.approx(-0.7162303341, abs=1e-8) and fit.covariance[0, 0] == pytest.approx(0.8099422438, abs=1e-8)
    assert (fit.null_log_likelihood, fit.log_likelihood, fit.score_statistic) == pytest.approx((-4.2766661190, -3.9235170657, 0.6770036246), abs=1e-8)
    tied = spark.createDataFrame(TIED, "a double, t double, s int, x double, y double")
    fit = exact.exact_fit(tied, time="t", status="s", x=["x", "y"], entry="a")
    np.testing.assert_allclose(fit.coefficients, [-0.11543052135923332, -0.2132653680135052], atol=1e-8)
    np.testing.assert_allclose(fit.covariance, [[0.4416066391730114, 0.23075471957017973], [0.23075471957017973, 0.4328431400531741]], atol=1e-8)
    assert (fit.null_log_likelihood, fit.log_likelihood, fit.score_statistic) == pytest.approx((-8.679312040892672, -8.62718734631879, 0.10561724830155697), abs=1e-8)


def likelihood(rows, beta):
    """By enumeration: (stratum, entry, time, status, x...) rows."""
    ll, score = 0.0, np.zeros(len(beta))
    for s, t in {(r[0], r[2]) for r in rows if r[3]}:
        risk = [r for r in rows if r[0] == s and r[2] >= t and (r[1] is None or r[1] < t)]
        x = np.array([r[4:] for r in risk], dtype=float)
        had = [i for i, r in enumerate(risk) if r[2] == t and r[3]]
        lp = x @ beta
        total, mean, _ = by_choice(lp, x, len(had))
        ll += lp[had].sum() - total
        score += x[had].sum(axis=0) - mean
    return ll, score


def test_strata_entry_nulls_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(exact, "NODE_ROWS", 3)
    monkeypatch.setattr(exact, "BLOCK_LEVELS", 1)
    monkeypatch.setattr(exact, "TASK_ROWS", 40)
    rng = np.random.default_rng(4)
    rows = [(str(rng.choice(["a", "b"])) if i % 9 else None, None if i % 5 == 0 else float(rng.integers(0, 4)), float(rng.integers(2, 14)), int(rng.random() < 0.6), float(rng.integers(-2, 3)), float(rng.normal())) for i in range(70)]
    rows += [rows[3]] * 4
    rows = [r for r in rows if r[1] is None or r[1] < r[2]]
    df = spark.createDataFrame(rows + [("a", 9.0, 4.0, 1, 1.0, 1.0), ("a", None, None, 1, 1.0, 1.0), ("b", None, 5.0, 1, None, 1.0)], "g string, a double, t double, s int, x double, y double").withColumns({"d": exact.F.lit(1), "n": exact.F.lit("n"), "idx": exact.F.lit(0)})
    beta = np.array([0.4, -0.3])
    got = exact.exact_likelihood(df, time="t", status="s", x=["x", "y"], coefficients=beta, strata=["g"], entry="a").first()
    ll, score = likelihood(rows, beta)
    assert got["log_likelihood"] == pytest.approx(ll) and (got["score_x"], got["score_y"]) == pytest.approx(tuple(score))
    fit = exact.exact_fit(df, time="t", status="s", x=["x", "y"], strata=["g"], entry="a")
    near = np.array([likelihood(rows, fit.coefficients + e)[0] for e in ([0.01, 0], [-0.01, 0], [0, 0.01], [0, -0.01])])
    assert fit.log_likelihood == pytest.approx(likelihood(rows, fit.coefficients)[0]) and (near < fit.log_likelihood).all()


def test_conditional_logistic(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i), int(rng.random() < 0.4), float(rng.normal()), float(rng.integers(0, 3))) for i in rng.integers(0, 12, 90)]
    df = spark.createDataFrame(rows + [(99, 1, 0.5, 1.0), (98, 0, 0.5, 1.0), (None, 1, 0.1, 0.0), (None, 0, 0.4, 1.0)], "g int, c int, x double, y double")
    as_times = [(str(g), None, 1.0, c, x, y) if c else (str(g), None, 2.0, 0, x, y) for g, c, x, y in [*rows, (None, 1, 0.1, 0.0), (None, 0, 0.4, 1.0)]]
    fit = exact.conditional_logistic(df, case="c", x=["x", "y"], strata=["g"])
    ll, score = likelihood(as_times, fit.coefficients)
    assert fit.log_likelihood == pytest.approx(ll) and np.abs(score).max() < 1e-6
    got = exact.conditional_likelihood(df, case="c", x=["x", "y"], coefficients=[0.1, 0.2], strata=["g"]).first()
    assert got["log_likelihood"] == pytest.approx(likelihood(as_times, np.array([0.1, 0.2]))[0])
    assert exact.conditional_logistic(df.limit(0), case="c", x=["x"], strata=["g"]).log_likelihood == 0
    assert [r["name"] for r in fit.table(spark).collect()] == ["x", "y"]


def test_sets_by_group(spark, monkeypatch):
    """Partitions grow with the rows; sets too large for a group give the same sums as the others."""
    rng = np.random.default_rng(5)
    size = [1, 2, 3, 4, 5, 6, 7, 9, 40]
    rows = [(g, bool(rng.random() < 0.4), float(rng.integers(0, 4)), float(rng.normal())) for g in range(9) for _ in range(size[g])] + [(None, True, 1.0, 0.5), (None, False, 0.0, 0.2), (3, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g int, c boolean, x double, y double").withColumn("c", F.col("c").cast("int"))
    read = lambda: exact.conditional_likelihood(df, case="c", x=["x", "y"], coefficients=[0.1, -0.2], strata=["g"]).first()
    want = read()
    monkeypatch.setattr(exact, "TASK_ROWS", 5)
    ready = exact._of_sets(df, "c", ["x", "y"], ["g"], None, keep=False)
    assert ready.rows.rdd.getNumPartitions() == 2 and ready.large is None
    monkeypatch.setattr(exact, "SET_ROWS", 20)
    monkeypatch.setattr(exact, "NODE_ROWS", 3)
    assert exact._of_sets(df, "c", ["x", "y"], ["g"], None, keep=False).large is not None
    np.testing.assert_allclose(read(), want, rtol=1e-10)
    fit = exact.conditional_logistic(df, case="c", x=["x", "y"], strata=["g"])
    monkeypatch.undo()
    np.testing.assert_allclose(fit.coefficients, exact.conditional_logistic(df, case="c", x=["x", "y"], strata=["g"]).coefficients, atol=1e-7)


def test_long_products_in_portions(monkeypatch):
    """One pair of long polynomials takes memory that doesn't grow with the square of their length."""
    one = symmetric.copies(np.zeros(1), np.ones((1, 1)), np.array([1500]), 1500)
    want = symmetric.merged(one, one, 3000)
    monkeypatch.setattr(symmetric, "MOST_CELLS", 100_000)
    tracemalloc.start()
    got = symmetric.merged(one, one, 3000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6
    for f in ("log", "mean", "cov"):
        np.testing.assert_allclose(getattr(got, f), getattr(want, f), atol=1e-9)
    assert got.log[0, 1500] == pytest.approx(log(comb(3000, 1500)), rel=1e-12)


def test_one_coefficient():
    """By a sum over points: as by enumeration and by products, at the ends, and for degrees and spreads of any size."""
    rng = np.random.default_rng(6)
    for m, scale in [(1, 1.0), (2, 0.0), (5, 1.0), (9, 0.0), (9, 3.0), (9, 40.0)]:
        lp, x, n = rng.normal(size=m) * scale, rng.normal(size=(m, 2)), rng.integers(1, 4, m)
        want = symmetric.product(np.zeros(m, dtype=int), symmetric.copies(lp, x, n, n.sum()), int(n.sum()))
        every = np.repeat(np.arange(m), n)
        for d in range(1, n.sum() + 1):
            got = symmetric.chosen(lp, x, n, d)
            for g, f in zip(got, ("log", "mean", "cov"), strict=True):
                np.testing.assert_allclose(g, getattr(want, f)[0, d], rtol=1e-9, atol=1e-9)
            if len(every) < 12:
                np.testing.assert_allclose(got[1], by_choice(lp[every], x[every], d)[1], atol=1e-9)
        assert symmetric.chosen(lp, x, n, int(n.sum()) + 1)[0] == -np.inf
    ways = lambda n, d: lgamma(n + 1) - lgamma(d + 1) - lgamma(n - d + 1)
    log_e, mean, cov = symmetric.chosen(np.zeros(2), np.array([[0.0], [1.0]]), np.array([600_000, 400_000]), 300_000)
    assert log_e == pytest.approx(ways(1_000_000, 300_000), abs=1e-6) and mean[0] == pytest.approx(120_000) and cov[0, 0] == pytest.approx(3e5 * 0.4 * 0.6 * 0.7, rel=1e-5)
    log_e, mean, cov = symmetric.chosen(np.array([800.0, -800.0]), np.array([[1.0], [0.0]]), np.array([50, 70]), 50)
    assert (log_e, mean[0], cov[0, 0]) == pytest.approx((40_000, 50, 0))


def test_many_ties(spark):
    """Thousands of ties at a time, which took polynomials as long, are one sum each."""
    n, b = 240_000, 0.3
    row = spark.range(n).select((1 + F.col("id") % 4).cast("double").alias("t"), (F.col("id") % 3 != 0).cast("int").alias("s"), (F.floor(F.col("id") / 12) % 5 == 0).cast("double").alias("x"))
    assert isinstance(exact._of_survival(row, "t", "s", ["x"], [], None, None), exact._Tied)
    i = np.arange(n)
    t, s, x = 1 + i % 4, i % 3 != 0, (i // 12 % 5 == 0).astype(float)
    logs = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, n + 1)))))
    want = 0.0
    for at in range(1, 5):
        ones, zeros, had = int(x[t >= at].sum()), int((1 - x[t >= at]).sum()), s & (t == at)
        d = int(had.sum())
        j = np.arange(max(0, d - zeros), min(ones, d) + 1)
        terms = logs[ones] - logs[j] - logs[ones - j] + logs[zeros] - logs[d - j] - logs[zeros - d + j] + b * j
        want += b * x[had].sum() - terms.max() - np.log(np.exp(terms - terms.max()).sum())
    assert exact.exact_likelihood(row, time="t", status="s", x=["x"], coefficients=[b]).first()["log_likelihood"] == pytest.approx(want, rel=1e-10)


def test_strata_with_and_without_polynomials(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows = [(str(rng.choice(["a", "b"])) if i % 9 else None, None if i % 5 == 0 else float(rng.integers(0, 5)), float(rng.integers(2, 12)), int(rng.random() < 0.6), float(rng.integers(-1, 2)), float(rng.integers(0, 2))) for i in range(80)]
    rows += [rows[3]] * 2 + [("c", None, float(t), 1, 1.0, float(t % 2)) for t in range(3, 9)]  # c has no ties
    rows = [r for r in rows if r[1] is None or r[1] < r[2]]
    df = spark.createDataFrame(rows + [("a", 9.0, 4.0, 1, 1.0, 1.0), ("d", None, 4.0, 0, 1.0, 1.0)], "g string, a double, t double, s int, x double, y double").withColumn("o", F.lit(0.7))
    beta, q = np.array([0.4, -0.3]), {"time": "t", "status": "s", "x": ["x", "y"], "strata": ["g"], "entry": "a", "offset": "o"}
    ll, score = likelihood(rows, beta)
    info = exact.exact_likelihood(df, coefficients=beta, **q).first()
    monkeypatch.setattr(exact, "POINTS", 0)
    monkeypatch.setattr(exact, "BLOCK_TIMES", 2)  # what a block begins with comes from those before
    kinds = []
    for ties in (2, 1):
        monkeypatch.setattr(exact, "TIES", ties)
        kinds.append(exact._of_survival(df, "t", "s", ["x", "y"], ["g"], "a", "o"))
        got = exact.exact_likelihood(df, coefficients=beta, **q).first()
        assert got["log_likelihood"] == pytest.approx(ll) and (got["score_x"], got["score_y"]) == pytest.approx(tuple(score))
        np.testing.assert_allclose(got, info, rtol=1e-9)
    assert isinstance(kinds[0], exact._Both) and isinstance(kinds[1], exact._Tied)
    fit = exact.exact_fit(df, **q)
    assert fit.log_likelihood == pytest.approx(likelihood(rows, fit.coefficients)[0]) and np.abs(likelihood(rows, fit.coefficients)[1]).max() < 1e-4


def test_sets_of_many_cases(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = [(g, int(rng.random() < 0.5), float(rng.integers(0, 3)), float(rng.normal())) for g, n in ((0, 120), (1, 90), (2, 5)) for _ in range(n)]
    df = spark.createDataFrame(rows, "g int, c int, x double, y double")
    x, c, g, b = np.array([r[2:] for r in rows]), np.array([r[1] for r in rows]), np.array([r[0] for r in rows]), np.array([0.1, -0.2])
    want = 0.0
    for s in range(3):
        at, d = g == s, int(c[g == s].sum())
        made = symmetric.product(np.zeros(at.sum(), dtype=int), symmetric.copies(x[at] @ b, x[at], np.ones(at.sum(), dtype=int), d), d)
        want += (x[at & (c == 1)] @ b).sum() - made.log[0, d]
    read = lambda: exact.conditional_likelihood(df, case="c", x=["x", "y"], coefficients=b, strata=["g"]).first()
    got = read()
    assert got["log_likelihood"] == pytest.approx(want)
    monkeypatch.setattr(exact, "TASK_ROWS", 50)
    monkeypatch.setattr(exact, "SET_ROWS", 50)
    assert isinstance(exact._of_sets(df, "c", ["x", "y"], ["g"], None, keep=False).large, exact._Tied | exact._Both)
    np.testing.assert_allclose(read(), got, rtol=1e-9)

"""Frailty, splines, additive hazards, robust curves and row-level concordance against brute force and published values."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from censorium.functions import splines
from censorium.operators import additive, cox, flexible, frailty, pairs, robust


@pytest.fixture(scope="module")
def rows(spark):
    """Clustered, tied, delayed rows with nulls: (g, entry, time, status, x, y, weight)."""
    rng = np.random.default_rng(2)
    out = []
    for g in range(25):
        u = rng.gamma(2.0, 0.5)
        for _ in range(int(rng.integers(2, 8))):
            x, y = float(rng.integers(-2, 3)) / 2, float(rng.normal())
            t, c = rng.exponential(6 / (u * np.exp(0.7 * x - 0.4 * y))), rng.exponential(9)
            stop = float(np.ceil(min(t, c))) + 1
            out.append((g if g else None, float(rng.integers(0, 3)) if rng.random() < 0.5 else None, stop, int(t <= c), x, y, float(rng.integers(1, 4))))
    out = [r for r in out if r[1] is None or r[1] < r[2]]
    bad = [(1, 9.0, 2.0, 1, 0.1, 0.1, 1.0), (1, None, None, 1, 0.1, 0.1, 1.0), (1, None, 3.0, None, 0.1, 0.1, 1.0), (1, None, 3.0, 1, None, 0.1, 1.0)]
    df = spark.createDataFrame(out + bad, "g int, a double, t double, s int, x double, y double, w double").withColumns({"time": F.lit("z"), "b": F.lit(1), "_w0": F.lit(2)})
    return out, df


# ---- robust curves


def curve(rows, keep, entry):
    """(S, H) after each time, rows weighted by ``keep``."""
    s, h, out = 1.0, 0.0, {}
    for t in sorted({r[2] for r in rows}):
        n = sum(k for r, k in zip(rows, keep, strict=True) if r[2] >= t and (not entry or r[1] is None or r[1] < t))
        d = sum(k for r, k in zip(rows, keep, strict=True) if r[2] == t and r[3])
        if n > 0:
            s, h = s * (1 - d / n), h + d / n
        out[t] = s, h
    return out


@pytest.mark.parametrize(("cluster", "entry", "weight"), [("g", "a", "w"), (None, None, None), (None, "a", None)])
def test_robust_curve(rows, cluster, entry, weight):
    data, df = rows
    w = [r[6] if weight else 1.0 for r in data]
    groups = [r[0] if cluster else i for i, r in enumerate(data)]
    base, eps, total = curve(data, w, entry), 1e-6, {}
    for g in set(groups):
        up, down = (curve(data, [v * (1 + e * (k == g)) for v, k in zip(w, groups, strict=True)], entry) for e in (eps, -eps))
        for t in base:
            infl = [(up[t][i] - down[t][i]) / (2 * eps) for i in (0, 1)]
            total[t] = [a + b * b for a, b in zip(total.get(t, [0, 0]), infl, strict=True)]
    got = {r["time"]: r for r in robust.robust_curve(df.where("x is not null and (a is null or a < t)"), time="t", status="s", cluster=cluster, entry=entry, weight=weight).collect()}
    assert got.keys() == base.keys()
    for t, r in got.items():
        assert (r["surv"], r["cum_hazard"]) == pytest.approx(base[t])
        if r["surv"] > 1e-9:
            assert (r["std_err"] ** 2, r["cum_hazard_std_err"] ** 2) == pytest.approx(total[t], rel=1e-4, abs=1e-9)


def test_influence(rows):
    data, df = rows
    base, times = curve(data, [r[6] for r in data], "a"), [1.0, 3.0, 7.5]
    got = {(r["g"], r["time"]): r for r in robust.curve_influence(df.where("x is not null"), time="t", status="s", cluster="g", times=times, entry="a", weight="w").collect()}
    last = lambda c, t: c[max([u for u in c if u <= t], default=None)] if min(c) <= t else (1.0, 0.0)
    for g in {r[0] for r in data}:
        moved = curve(data, [r[6] * (1 + 1e-6 * (r[0] == g)) for r in data], "a")
        for t in times:
            want = [(b - a) / 1e-6 for a, b in zip(last(base, t), last(moved, t), strict=True)]
            assert (got[g, t]["influence_surv"], got[g, t]["influence_cum_hazard"]) == pytest.approx(want, abs=1e-4)


# ---- concordance by rows


def pairs_by_force(rows, entry, weight, follow):
    out = np.zeros((len(rows), 3))
    for i, r in enumerate(rows):
        for j, q in enumerate(rows):
            at_risk = (not entry or q[1] is None or q[1] < r[2]) and (q[2] > r[2] or (follow and q[2] == r[2] and not q[3]))
            if i != j and r[3] and at_risk:
                k = 0 if r[5] > q[5] else 1 if r[5] < q[5] else 2
                v = r[6] * q[6] if weight else 1.0
                out[i, k] += v
                out[j, k] += v
    return out


@pytest.mark.parametrize(("entry", "weight"), [(None, None), ("a", "w")])
def test_concordance_rows(spark, rows, entry, weight):
    data = [(*r[:5], round(r[5] * 2) / 2, r[6]) for r in rows[0]]
    df = spark.createDataFrame(data, "g int, a double, t double, s int, x double, y double, w double").withColumn("rank", F.lit(1))
    want = pairs_by_force(data, entry, weight, not entry)
    got = pairs.concordance_rows(df, time="t", status="s", risk="y", entry=entry, weight=weight).select("g", "a", "t", "s", "x", "y", "w", "concordant", "discordant", "tied_risk").collect()
    key = lambda r: str([v if v is None else float(v) for v in r])
    assert sorted(key(r) for r in got) == sorted(key((*r, *v)) for r, v in zip(data, want, strict=True))
    one = pairs.concordance_variance(df, time="t", status="s", risk="y", entry=entry, weight=weight).first()
    c, d, t = want.sum(axis=0) / 2
    assert (one["concordant"], one["discordant"], one["tied_risk"]) == pytest.approx((c, d, t))
    infl = ((want[:, 0] - want[:, 1]) - want.sum(axis=1) * (c - d) / (c + d + t)) / (2 * (c + d + t))
    assert one["c_index"] == pytest.approx((c + t / 2) / (c + d + t)) and one["variance"] == pytest.approx((infl**2).sum())
    by = {}
    for r, v in zip(data, infl, strict=True):
        by[r[0]] = by.get(r[0], 0) + v
    clustered = pairs.concordance_variance(df, time="t", status="s", risk="y", entry=entry, weight=weight, cluster="g").first()
    assert clustered["variance"] == pytest.approx(sum(v * v for v in by.values()))
    z = 0.0
    for u in {r[2] for r in data if r[3]}:
        risk = [(r[5], r[6] if weight else 1.0) for r in data if r[2] >= u and (not entry or r[1] is None or r[1] < u)]
        total = sum(v for _, v in risk)
        square = sum(v * (sum(b for a, b in risk if a < y) - sum(b for a, b in risk if a > y)) ** 2 for y, v in risk)
        z += sum(r[6] if weight else 1.0 for r in data if r[2] == u and r[3]) * square / total
    assert one["conditional_variance"] == pytest.approx(z / (4 * (c + d + t) ** 2))


def test_concordance_published(spark):
    one = pairs.concordance_variance(spark.createDataFrame([(1.0, 1, 0.2), (2.0, 1, 0.4), (3.0, 0, 0.4), (4.0, 1, 1.0)], "t double, s int, x double"), time="t", status="s", risk="x").first()
    assert one["conditional_variance"] == pytest.approx(0.065)
    df = spark.createDataFrame([(0.0, 1.0, 1, 0.5), (0.0, 2.0, 0, 0.5 + 5e-13), (1.0, 3.0, 1, 0.1), (1.0, 4.0, 1, 0.8)], "a double, t double, s int, x double")
    one = pairs.concordance_variance(df, time="t", status="s", risk="x", entry="a").first()
    assert (one["concordant"], one["discordant"], one["tied_risk"]) == (0.0, 2.0, 0.0)
    assert pairs.concordance_variance(df.limit(0), time="t", status="s", risk="x").first()["c_index"] is None


# ---- additive hazards


@pytest.mark.parametrize("test", additive.TESTS)
def test_additive(rows, test):
    data, df = rows
    fit = additive.additive_fit(df, time="t", status="s", x=["x", "y"], entry="a", weight="w", test=test)
    got = {r["time"]: r for r in fit.steps.collect()}
    cum, stat, var = np.zeros(3), 0.0, 0.0
    for t in sorted({r[2] for r in data if r[3]}):
        risk = [r for r in data if r[2] >= t and (r[1] is None or r[1] < t)]
        x, w = np.array([[1, r[4], r[5]] for r in risk]), np.array([r[6] for r in risk])
        n = w.sum()
        if t not in got:
            continue
        gram = np.linalg.inv(x.T @ (w[:, None] * x))
        had = np.array([r[2] == t and r[3] for r in risk], dtype=bool)
        each = (gram @ (x[had] * w[had, None]).T).T
        cum += each.sum(axis=0)
        for i, name in enumerate(fit.names):
            assert (got[t][f"coef_{name}"], got[t][f"cum_{name}"]) == pytest.approx((each[:, i].sum(), cum[i]), abs=1e-9)
        if test == "variance":
            own = w[had, None] * (x[had, 1:] - (w[:, None] * x[:, 1:]).sum(axis=0) / n)
        else:
            # the inverse of the least-squares variance, times what the risk set of weights makes of it
            mean = (w[:, None] * x[:, 1:]).sum(axis=0) / n
            cov = np.linalg.inv((x[:, 1:] - mean).T @ (w[:, None] * (x[:, 1:] - mean)) / n)
            own = each * (np.concatenate([[n / (1 + mean @ cov @ mean)], n / np.diag(cov)]) if test == "aalen" else n)
        stat, var = stat + own.sum(axis=0), var + own.T @ own
    np.testing.assert_allclose(fit.statistic, stat, atol=1e-8)
    np.testing.assert_allclose(fit.variance, var, atol=1e-8)
    assert 5 < len(got) == fit.n_times and 0 < fit.p < 1


# ---- splines


def test_natural_splines(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 6)] + [(None,)], "v double")
    knots = splines.natural_knots(df, "v", df_count=3)
    np.testing.assert_allclose(knots, [1.2, 2.6666666666666665, 3.333333333333333, 4.8])
    got = [list(r) for r in df.select(*splines.natural_heights(F.col("v"), knots)).collect()]
    np.testing.assert_allclose(got[0], [-0.3066339066339068, 0.12972972972972977, -0.007507507507507517], atol=1e-12)
    assert got[5] == [None] * 3
    at = spark.createDataFrame([(v,) for v in (1.0, 3.0, 5.0, 7.0, 10.0)], "v double")
    heights = np.array([list(r) for r in at.select(*splines.natural_heights(F.col("v"), [1.0, 3.0, 5.0, 7.0, 10.0])).collect()])
    np.testing.assert_allclose(heights, np.eye(5)[:, 1:], atol=1e-10)
    tied = spark.createDataFrame([(v,) for v in (0.0, 1.0, 1.0, 1.0, 2.0)], "v double")
    assert splines.natural_knots(tied, "v", df_count=4)[1:-1] == [1.0]
    with pytest.raises(ValueError, match="different"):
        splines.natural_knots(spark.createDataFrame([(1.0,), (1.0,)], "v double"), "v")
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=400), 1)
    many = spark.createDataFrame([(float(a),) for a in v] + [(float("nan"),)], "v double")
    np.testing.assert_allclose(splines.quantiles(many, "v", [0, 0.05, 0.31, 0.5, 1]), np.quantile(v, [0, 0.05, 0.31, 0.5, 1]))


def test_bsplines(spark):
    def deboor(x, t, k, j):
        if k == 0:
            return float(t[j] <= x < t[j + 1])
        return (x - t[j]) / (t[j + k] - t[j]) * deboor(x, t, k - 1, j) + (t[j + k + 1] - x) / (t[j + k + 1] - t[j + 1]) * deboor(x, t, k - 1, j + 1)

    at = [0.5, 1.0, 2.2, 7.9, 8.4]
    df = spark.createDataFrame([(a,) for a in [*at, 9.6]], "v double")
    got = [list(r) for r in df.select(*splines.bspline(F.col("v"), pieces=6, boundary=(0.5, 8.5))).collect()]
    t = 0.5 + 8 / 6 * np.arange(-3, 10)
    np.testing.assert_allclose(got[:5], [[deboor(x, t, 3, j) for j in range(9)] for x in at], atol=1e-10)
    np.testing.assert_allclose(np.sum(got[:5], axis=1), 1.0)
    assert got[5] == [None] * 9
    rcs = df.select(*splines.restricted_cubic(F.col("v"), [1.0, 2.0, 4.0, 8.0])).collect()
    up = lambda x, k: max(x - k, 0) ** 3
    np.testing.assert_allclose([list(r) for r in rcs], [[up(x, k) - up(x, 4) * (8 - k) / 4 + up(x, 8) * (4 - k) / 4 for k in (1, 2)] for x in [*at, 9.6]], atol=1e-9)


def test_flexible(spark, rows):
    data, df = rows
    fit = flexible.flexible_fit(df, time="t", status="s", x=["x", "y"], entry="a", weight="w", inner=1)
    kn = fit.knots

    def parts(u):
        up = lambda k, e: np.maximum(u - k, 0) ** e
        d = lambda k, e: (up(k, e) - up(kn[-1], e)) / (kn[-1] - k)
        return np.stack([u**0, u, *(d(k, 3) - d(kn[-2], 3) for k in kn[:-2])]), np.stack([0 * u, u**0, *(3 * (d(k, 2) - d(kn[-2], 2)) for k in kn[:-2])])

    t, s, w, cov = (np.array(v, dtype=float) for v in ([r[2] for r in data], [r[3] for r in data], [r[6] for r in data], [r[4:6] for r in data]))
    late = np.array([r[1] or 0.0 for r in data])

    def ll(b):
        z, dz = parts(np.log(t))
        z0 = parts(np.log(np.where(late > 0, late, 1.0)))[0]
        eta = b[: len(z)] @ z + cov @ b[len(z) :]
        h0 = np.where(late > 0, np.exp(b[: len(z)] @ z0 + cov @ b[len(z) :]), 0.0)
        return float((w * (s * (np.log(b[: len(z)] @ dz) + eta - np.log(t)) - np.exp(eta) + h0)).sum())

    assert fit.log_likelihood == pytest.approx(ll(fit.coefficients))
    slopes = [(ll(fit.coefficients + e) - ll(fit.coefficients - e)) / 2e-5 for e in np.eye(len(fit.coefficients)) * 1e-5]
    np.testing.assert_allclose(slopes, 0, atol=1e-3)
    assert fit.names == ["spline_0", "spline_1", "spline_2", "x", "y"] and (fit.std_errors > 0).all()
    out = flexible.flexible_predict(df.where("t = 4"), fit, at="t", x=["x", "y"]).first()
    z, dz = parts(np.log(np.array([4.0])))
    h = float(np.exp(fit.coefficients[:3] @ z[:, 0] + out["x"] * fit.coefficients[3] + out["y"] * fit.coefficients[4]))
    assert (out["cum_hazard"], out["hazard"], out["surv"]) == pytest.approx((h, h * float(fit.coefficients[:3] @ dz[:, 0]) / 4, np.exp(-h)))
    plain = spark.createDataFrame([(v, 1) for v in (1.0, 2.0, 3.0, 4.0, 7.0)], "t double, s int")
    weibull = flexible.flexible_fit(plain, time="t", status="s", inner=0)
    v, k = np.array([1.0, 2.0, 3.0, 4.0, 7.0]), weibull.coefficients[1]
    assert 1 / k + np.log(v).mean() == pytest.approx((v**k * np.log(v)).sum() / (v**k).sum(), abs=1e-6)
    with pytest.raises(ValueError, match="events"):
        flexible.flexible_fit(plain.limit(0), time="t", status="s")


def test_spline_term(spark):
    rng = np.random.default_rng(5)
    v = rng.uniform(0, 6, 150)
    t = rng.exponential(1 / np.exp(np.sin(v)))
    df = spark.createDataFrame([(float(np.ceil(b * 40)), 1, float(a)) for a, b in zip(v, t, strict=True)] + [(1.0, 1, None)], "t double, s int, v double")
    term = flexible.spline_term(df, time="t", status="s", term="v", df=3.0, pieces=5, most=3, ties="breslow")
    assert term.df == pytest.approx(3.0, abs=1e-3)
    got = np.array([r[0] for r in spark.createDataFrame([(float(a),) for a in np.linspace(0.3, 5.7, 40)], "v double").select(term.value(F.col("v"))).collect()])
    assert np.corrcoef(got, np.sin(np.linspace(0.3, 5.7, 40)))[0, 1] > 0.9


# ---- frailty


def gamma_em(data, rounds=3000):
    """Coefficients, variance and marginal likelihood by plain EM on arrays."""
    from math import lgamma

    t, s, x = np.array([r[2] for r in data]), np.array([r[3] for r in data]), np.array([r[4] for r in data])
    g = np.unique([-1 if r[0] is None else r[0] for r in data], return_inverse=True)[1]
    late = np.array([-1.0 if r[1] is None else r[1] for r in data])
    at = np.unique(t[s == 1])
    risk = (t[:, None] >= at) & (late[:, None] < at)
    d, dt = np.bincount(g, s), np.array([((t == u) & (s == 1)).sum() for u in at])
    b, u, v = 0.0, np.ones(len(d)), 1.0
    gain = lambda v, e: sum(lgamma(k + v) - lgamma(v) + v * np.log(v) - (k + v) * np.log(h + v) for k, h in zip(d, e, strict=True))
    for n in range(rounds):
        r = np.exp(x * b) * u[g]
        s0, s1, s2 = ((r * x**k) @ risk for k in (0, 1, 2))
        b += ((x * s).sum() - (dt * s1 / s0).sum()) / (dt * (s2 / s0 - (s1 / s0) ** 2)).sum()
        haz = dt / ((np.exp(x * b) * u[g]) @ risk)
        e = np.bincount(g, np.exp(x * b) * (risk @ haz))
        grid = np.exp(np.linspace(np.log(v / 1.5), np.log(v * 1.5), 61)) if n < 60 else v * np.exp(np.linspace(-0.02, 0.02, 41))
        v = float(grid[np.argmax([gain(k, e) for k in grid])])
        u = (d + v) / (e + v)
        if n > 300:
            break
    ll = (dt * (np.log(haz) - np.log(dt) + 1)).sum() + (x * b * s).sum() + gain(v, e)
    return b, 1 / v, float(ll)


def test_gamma_frailty(rows):
    data, df = rows
    b, variance, ll = gamma_em(data)
    fit = frailty.frailty_fit(df, time="t", status="s", x=["x"], cluster="g", entry="a", eps=1e-5, most=14)
    assert all(y >= x - 1e-6 for x, y in itertools.pairwise(fit.history))
    assert fit.fit.coefficients[0] == pytest.approx(b, abs=0.02) and fit.variance == pytest.approx(variance, rel=0.1) and fit.log_likelihood == pytest.approx(ll, abs=0.02)
    effects = {r["g"]: r for r in fit.effects.collect()}
    assert effects.keys() == {r[0] for r in data} and sum(r["n_event"] for r in effects.values()) == sum(r[3] for r in data)
    assert fit.fit.std_errors[0] > 0


def test_frailty_lookups(rows, monkeypatch):
    """Few times of the hazard go to the rows, and nothing is summed again for coefficients that aren't there; many times give the same."""
    data, df = rows
    df = df.where("x is not null")
    seen, steps, join, step = [], [], frailty.join_keys, frailty._step
    monkeypatch.setattr(frailty, "join_keys", lambda *a, few=False, **how: seen.append(few) or join(*a, few=few, **how))
    monkeypatch.setattr(frailty, "_step", lambda *a, **how: steps.append(1) or step(*a, **how))
    read = lambda: {r["g"]: (r["n_event"], r["expected"], r["effect"]) for r in frailty.frailty_fit(df, time="t", status="s", x=[], cluster="g", entry="a", variance=0.5, most=1).effects.collect()}
    got = read()
    assert seen == [True, True] and len(steps) == 1
    t, s = np.array([r[2] for r in data]), np.array([r[3] for r in data])
    a = np.array([-1.0 if r[1] is None else r[1] for r in data])
    at = np.unique(t[s == 1])
    risk = (t[:, None] >= at) & (a[:, None] < at)
    haz = np.array([s[t == u].sum() for u in at]) / risk.sum(axis=0)
    for g in got:
        own = [i for i, r in enumerate(data) if r[0] == g]
        d, e = s[own].sum(), (risk[own] @ haz).sum()
        assert got[g] == pytest.approx((d, e, np.log((d + 2) / (e + 2))))
    monkeypatch.setattr(frailty, "MOST_TIMES", 0)
    many = read()
    assert seen[2:] == [False, False] and many.keys() == got.keys()
    for g in got:
        assert many[g] == pytest.approx(got[g])


def test_normal_frailty_and_none(rows):
    _, df = rows
    plain = cox.cox_fit(df, time="t", status="s", x=["x"], entry="a")
    for kind in frailty.KINDS:
        none = frailty.frailty_fit(df, time="t", status="s", x=["x"], cluster="g", entry="a", kind=kind, variance=1e-8, most=4)
        assert none.fit.coefficients[0] == pytest.approx(plain.coefficients[0], abs=1e-5) and none.log_likelihood == pytest.approx(plain.log_likelihood, abs=1e-4)
        assert none.fit.std_errors[0] == pytest.approx(plain.std_errors[0], rel=1e-4)
    fit = frailty.frailty_fit(df, time="t", status="s", x=["x"], cluster="g", entry="a", kind="normal", variance=0.5, most=3)
    for r in fit.effects.collect():
        assert r["n_event"] - r["expected"] * np.exp(r["effect"]) - r["effect"] / 0.5 == pytest.approx(0, abs=1e-9)

"""Cure models against numpy: likelihoods, numerical derivatives, planted shares and the EM property."""

import math

import numpy as np
import pytest

from censorium.operators import cure


def phi(x):
    return 0.5 * math.erfc(-x / math.sqrt(2))


def tail(z, family):
    return math.exp(-math.exp(z)) if family in ("weibull", "exponential") else 1 / (1 + math.exp(z)) if family == "loglogistic" else phi(-z)


def log_density(z, family):
    if family in ("weibull", "exponential"):
        return z - math.exp(z)
    return z - 2 * math.log1p(math.exp(z)) if family == "loglogistic" else -z * z / 2 - 0.5 * math.log(2 * math.pi)


def likelihood(data, at, model, family, link, k):
    total = 0.0
    for t, d, a, x, w in data:
        eta, s = at[0] + at[1] * a, math.exp(at[4])
        z = (math.log(t) - at[2] - at[3] * x) / s
        density = log_density(z, family) - at[4] - math.log(t)
        if model == "mixture":
            p = {"logit": lambda e: 1 / (1 + math.exp(-e)), "probit": phi, "cloglog": lambda e: 1 - math.exp(-math.exp(e))}[link](eta)
            total += w * (math.log(p) + density if d else math.log(1 - p + p * tail(z, family)))
        else:
            u = math.exp(eta) * (1 - tail(z, family))
            total += w * (d * (eta + density) - (u if k == 0 else (1 / k + d) * math.log1p(k * u)))
    return total


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    out = []
    for _ in range(150):
        a, x = round(float(rng.normal()), 2), round(float(rng.normal()), 2)
        t = float(rng.weibull(1.4)) * math.exp(0.7 + 0.3 * x) if rng.random() < 1 / (1 + math.exp(-0.4 - 0.8 * a)) else math.inf
        c = float(rng.uniform(1, 12))
        out.append((round(min(t, c), 3) + 0.001, int(t <= c), a, x, float(rng.integers(1, 3))))
    return out


@pytest.fixture(scope="module")
def rows(spark, data):
    bad = [(None, 1, 0.0, 0.0, 1.0), (2.0, None, 0.0, 0.0, 1.0), (2.0, 1, None, 0.0, 1.0), (0.0, 1, 0.0, 0.0, 1.0), (-1.0, 0, 0.0, 0.0, 1.0)]
    return spark.createDataFrame(data + bad, "t double, s int, a double, x double, w double").persist()


COLUMNS = dict(time="t", status="s", cure_x=["a"], x=["x"], weight="w")
CASES = [("mixture", "weibull", "logit", 0.0), ("mixture", "lognormal", "probit", 0.0), ("mixture", "loglogistic", "cloglog", 0.0), ("promotion", "weibull", "logit", 0.0), ("promotion", "lognormal", "logit", 0.7), ("promotion", "loglogistic", "logit", 1.0)]


@pytest.mark.parametrize("model, family, link, k", CASES)
def test_likelihood_and_score(rows, data, model, family, link, k):
    at = np.array([0.2, 0.5, 0.6, 0.2, -0.2])
    got = cure.cure_score(rows, cure=at[:2], location=at[2:4], scale=math.exp(at[4]), model=model, family=family, link=link, dispersion=k, **COLUMNS).first()
    value = lambda b: likelihood(data, b, model, family, link, k)
    assert got["ll"] == pytest.approx(value(at), rel=1e-6)
    for i in range(5):
        h = np.eye(5)[i] * 1e-5
        assert got[f"u{i}"] == pytest.approx((value(at + h) - value(at - h)) / 2e-5, rel=1e-4, abs=1e-3)


@pytest.mark.parametrize("model, family, link, k", [CASES[0], CASES[2], CASES[3], CASES[4]])
def test_fit(rows, data, model, family, link, k):
    fit = cure.cure_fit(rows, model=model, family=family, link=link, dispersion=k, **COLUMNS)
    at = np.array([*fit.cure, *fit.location, math.log(fit.scale)])
    value = lambda b: likelihood(data, b, model, family, link, k)
    assert fit.converged and fit.log_likelihood == pytest.approx(value(at), rel=1e-7)
    assert all(b >= a - 1e-9 * abs(a) for a, b in zip(fit.trace, fit.trace[1:], strict=False))
    second = np.zeros((5, 5))
    e, h = np.eye(5), 1e-3
    for i in range(5):
        assert (value(at + 1e-4 * e[i]) - value(at - 1e-4 * e[i])) / 2e-4 == pytest.approx(0, abs=2e-2)
        for j in range(5):
            second[i, j] = (value(at + h * (e[i] + e[j])) - value(at + h * (e[i] - e[j])) - value(at - h * (e[i] - e[j])) + value(at - h * (e[i] + e[j]))) / (4 * h * h)
    assert fit.std_errors == pytest.approx(np.sqrt(np.diag(np.linalg.inv(-second))), rel=1e-2)


def test_predicted_and_compared(spark, rows):
    fits = [cure.cure_fit(rows, family=f, **COLUMNS) for f in ("weibull", "exponential")]
    table = cure.compare_cure(spark, fits).collect()
    assert [r["aic"] for r in table] == sorted(f.aic for f in fits) and {r["n_parameters"] for r in table} == {5, 4}
    fit = fits[0]
    asked = spark.createDataFrame([(0.0, 1.0, 0.5), (2.0, 1.0, 0.5), (1e9, 1.0, 0.5), (None, 1.0, 0.5), (2.0, None, 0.5)], "t double, a double, x double")
    got = cure.cure_predicted(asked, fit, time="t").collect()
    p = 1 / (1 + math.exp(-fit.cure[0] - fit.cure[1]))
    s = tail((math.log(2.0) - fit.location[0] - fit.location[1] * 0.5) / fit.scale, "weibull")
    assert got[0]["surv"] == 1 and got[0]["cured_given"] == pytest.approx(1 - p)
    assert got[1]["surv"] == pytest.approx(1 - p + p * s) and got[1]["cured_given"] == pytest.approx((1 - p) / (1 - p + p * s))
    assert got[2]["surv"] == pytest.approx(1 - p) and got[2]["cured_given"] == pytest.approx(1)
    assert got[3]["surv"] is None and got[4]["cured"] is None


def test_planted_share(spark):
    rng = np.random.default_rng(8)
    t = np.where(rng.random(6000) < 0.6, rng.exponential(2.0, 6000), np.inf)
    rows = spark.createDataFrame([(float(min(v, 15.0)), int(v <= 15.0)) for v in t], "t double, s int")
    fit = cure.cure_fit(rows, time="t", status="s", family="exponential")
    assert 1 / (1 + math.exp(fit.cure[0])) == pytest.approx(0.4, abs=0.03) and math.exp(fit.location[0]) == pytest.approx(2.0, abs=0.15)
    promoted = cure.cure_fit(rows, time="t", status="s", model="promotion")
    assert math.exp(-math.exp(promoted.cure[0])) == pytest.approx(0.4, abs=0.03)


def test_empty_and_bad_arguments(spark, rows):
    none = rows.where("false")
    fit = cure.cure_fit(none, **COLUMNS)
    assert fit.log_likelihood == 0 and fit.n == 0
    assert cure.cure_score(none, cure=[0.0], location=[0.0], scale=1.0, time="t", status="s", keys=["a"]).count() == 0
    for bad in (dict(model="other"), dict(link="other"), dict(dispersion=-1.0), dict(family="gaussian")):
        with pytest.raises(ValueError):
            cure.cure_fit(rows, **COLUMNS, **bad)

"""Change points against the plain program over all splits, and against greedy splits."""

import math

import numpy as np
import pytest

from censorium.operators import changes


def cost_of(v, kind):
    v = np.asarray(v, dtype=float)
    n, square = len(v), float(((v - v.mean()) ** 2).sum())
    if kind == "l2":
        return square
    if kind == "normal":
        var = square / n
        return n * (1 + math.log(var)) if var >= changes.FLOOR else n * (math.log(changes.FLOOR) + var / changes.FLOOR)
    return 2 * sum(x * math.log(x / v.mean()) - x + v.mean() if x > 0 else v.mean() for x in v)


def table(v, kind):
    """Costs of all segments, from running sums."""
    n = len(v)
    x = np.asarray(v, float) - (np.mean(v) if kind != "poisson" else 0.0)
    a, b = np.r_[0, np.cumsum(x)], np.r_[0, np.cumsum(x * x)]
    whole = np.r_[0, np.cumsum([2 * y * math.log(y) if y > 0 else 0.0 for y in x])] if kind == "poisson" else np.zeros(n + 1)
    return lambda s, t: changes._costs((t - s).astype(float), a[t] - a[s], b[t] - b[s], kind) + whole[t] - whole[s]


def exact(v, kind, penalty, least):
    """Least total cost with the penalties, and the changes."""
    cost, n = table(v, kind), len(v)
    best, prev = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = -penalty
    for t in range(least, n + 1):
        s = np.arange(0, t - least + 1)
        total = best[s] + cost(s, np.full_like(s, t)) + penalty
        k = int(np.argmin(total))
        best[t], prev[t] = total[k], s[k]
    out, t = [], n if n >= least else 0
    while prev[t] > 0:
        t = int(prev[t])
        out.append(t)
    return best[n], out[::-1]


def greedy(v, kind, penalty, least):
    def split(lo, hi):
        gains = [(cost_of(v[lo:hi], kind) - cost_of(v[lo:m], kind) - cost_of(v[m:hi], kind) - penalty, -m) for m in range(lo + least, hi - least + 1)]
        if not gains or max(gains)[0] <= 0:
            return []
        m = -max(gains)[1]
        return [*split(lo, m), m, *split(m, hi)]

    return split(0, len(v))


def planted(seed, n, kind):
    rng = np.random.default_rng(seed)
    level = np.repeat(rng.choice([1.0, 4.0, 9.0, 15.0], 12), math.ceil(n / 12))[:n]
    return rng.poisson(level).astype(float) if kind == "poisson" else np.round(level + rng.normal(0, 1.0, n), 3)


def starts(got, keys=()):
    out = {}
    for r in got:
        out.setdefault(tuple(r[k] for k in keys), []).append(r)
    return {k: sorted(v, key=lambda r: r["segment"]) for k, v in out.items()}


@pytest.mark.parametrize("kind, penalty, least", [("l2", 12.0, 1), ("normal", 8.0, 5), ("poisson", 9.0, 2)])
def test_pruned_is_exact(spark, kind, penalty, least):
    series = {"a": planted(1, 2000, kind), None: planted(2, 700, kind), "short": planted(3, 1, kind), "same": np.full(40, 3.0)}
    data = [(g, 2.0 * i + 7, float(x)) for g, v in series.items() for i, x in enumerate(v)]
    rows = spark.createDataFrame([*data, ("a", None, 1.0), ("a", 3.5, None), ("none", 1.0, None)], "g string, t double, v double")
    got = starts(changes.segments(rows, order="t", value="v", keys=["g"], cost=kind, penalty=penalty, least=least, block=300).collect(), ["g"])
    assert set(got) == {(g,) for g in series}
    for g, v in series.items():
        found = got[(g,)]
        value, cuts = exact(v, kind, penalty, least)
        assert [r["segment"] for r in found] == list(range(len(found)))
        assert [int((r["start"] - 7) / 2) for r in found] == [0, *cuts]
        assert sum(r["n"] for r in found) == len(v)
        if len(v) >= least:
            assert sum(r["cost"] for r in found) + penalty * (len(found) - 1) == pytest.approx(value, rel=1e-7, abs=1e-6)
        assert [r["mean"] for r in found] == pytest.approx([np.mean(p) for p in np.split(v, cuts)])


@pytest.mark.parametrize("kind, penalty", [("l2", 25.0), ("poisson", 12.0)])
def test_splits(spark, kind, penalty):
    series = {"a": planted(4, 150, kind), "b": planted(5, 90, kind), None: np.array([1.0, 2.0])}
    rows = spark.createDataFrame([(g, i, float(x)) for g, v in series.items() for i, x in enumerate(v)], "g string, t int, v double")
    got = starts(changes.segments(rows, order="t", value="v", keys=["g"], cost=kind, penalty=penalty, least=3, method="splits").collect(), ["g"])
    for g, v in series.items():
        assert [r["start"] for r in got[(g,)]] == [0, *greedy(v, kind, penalty, 3)]


def test_change_points(spark):
    v = [1.0] * 10 + [5.0] * 10 + [2.0] * 10
    # samples of one time are one point, the mean
    rows = spark.createDataFrame([(i, x + d) for i, x in enumerate(v) for d in (-0.1, 0.1)], "t int, v double")
    got = sorted(tuple(r) for r in changes.change_points(rows, order="t", value="v", penalty=3.0).collect())
    assert [r[0] for r in got] == [10, 20] and [r[1:] for r in got] == [pytest.approx((1, 5)), pytest.approx((5, 2))]


def test_empty_and_bad_arguments(spark):
    none = spark.createDataFrame([], "g string, t int, v double")
    for method in ("pruned", "splits"):
        assert changes.segments(none, order="t", value="v", keys=["g"], method=method).count() == 0
        assert changes.segments(none, order="t", value="v", method=method).count() == 0
    for bad in (dict(cost="l1"), dict(penalty=-1.0), dict(least=0), dict(method="other")):
        with pytest.raises(ValueError):
            changes.segments(none, order="t", value="v", **bad)

"""Values far from zero, ties of causes, and decimals at breaks."""

import math

import numpy as np
import pytest

from censorium.operators import cox, data_prep, population, states


def test_covariates_far_from_zero(spark):
    rng = np.random.default_rng(3)
    rows = [(float(rng.integers(1, 9)), int(rng.random() < 0.7), float(rng.normal())) for _ in range(60)]
    near, far = (spark.createDataFrame([(t, s, x + move) for t, s, x in rows], "t double, s int, x double") for move in (0.0, 1e7))
    how = dict(time="t", status="s", x=["x"])
    a, b = cox.cox_fit(near, **how), cox.cox_fit(far, **how)
    assert b.coefficients[0] == pytest.approx(a.coefficients[0], rel=1e-6) and b.std_errors[0] == pytest.approx(a.std_errors[0], rel=1e-6)
    got, want = ({(r["t"], r["s"], round(r["x"] - m, 6)): (r["martingale"], r["score_x"]) for r in cox.residuals(df, coefficients=[0.7], **how).collect()} for df, m in ((far, 1e7), (near, 0.0)))
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-5)
    far_hazard, hazard = ({r["time"]: r["cum_hazard"] for r in cox.base_hazard(df, coefficients=[0.7], centered=True, **how).collect()} for df in (far, near))
    assert far_hazard == pytest.approx(hazard, rel=1e-5)
    assert [r["mean_x"] for r in cox.cox_detail(far, coefficients=[0.7], **how).collect()] == pytest.approx([r["mean_x"] + 1e7 for r in cox.cox_detail(near, coefficients=[0.7], **how).collect()])


def test_fine_gray_with_ties_of_causes(spark):
    """Both forms agree where an event of another cause ties with a censoring."""
    rng = np.random.default_rng(6)
    rows = [(float(rng.integers(1, 7)), int(rng.integers(0, 3)), float(rng.integers(0, 3))) for _ in range(70)]
    df = spark.createDataFrame(rows, "t double, c int, x double")
    fit = states.fine_gray(df, time="t", cause="c", x=["x"])
    t, c, x = (np.array([r[i] for r in rows]) for i in range(3))
    g = {}
    left = 1.0
    for u in np.unique(t):
        g[u] = left  # G just before u
        n = (t >= u).sum() - ((t == u) & (c > 0)).sum()
        left *= 1 - ((t == u) & (c == 0)).sum() / n if n else 1.0

    def score(b):
        out = 0.0
        for u in np.unique(t[c == 1]):
            w = np.where(t >= u, 1.0, np.where(c == 2, g[u] / np.array([g[v] for v in t]), 0.0)) * np.exp(b * x)
            out += ((c == 1) & (t == u)) @ x - ((c == 1) & (t == u)).sum() * (w @ x) / w.sum()
        return out

    assert score(fit.coefficients[0]) == pytest.approx(0, abs=1e-6)
    rows = states.subdistribution_rows(df, time="t", cause="c")
    again = cox.cox_fit(rows, time="fg_stop", status="fg_status", entry="fg_start", weight="fg_weight", x=["x"])
    assert again.coefficients[0] == pytest.approx(fit.coefficients[0], abs=1e-7) and again.log_likelihood == pytest.approx(fit.log_likelihood, abs=1e-6)


def test_parts_of_decimals(spark):
    rng = np.random.default_rng(9)
    breaks = [0.1, 0.3, 0.7, 1.9]
    rows = [(i, float(round(rng.uniform(0, 2), 2)), float(round(rng.uniform(2, 4), 2)), 1, float(round(rng.uniform(0, 1), 1))) for i in range(300)] + [(900, 0.0, 1.0, 1, None)]
    df = spark.createDataFrame(rows, "i int, a double, b double, e int, v double")
    parts = data_prep.time_cut_expand(df, start="a", stop="b", event="e", value="v", breaks=breaks).orderBy("i", "a").collect()
    by = {}
    for r in parts:
        by.setdefault(r["i"], []).append(r)
    for i, a, b, _, v in rows:
        got = by[i]
        assert got[0]["a"] == a and got[-1]["b"] == b and all(x["b"] == y["a"] for x, y in zip(got, got[1:], strict=False)) and [r["e"] for r in got] == [0] * (len(got) - 1) + [1]
        if v is None:
            assert [r["cut"] for r in got] == [None]
        else:
            first = sum(x <= v for x in breaks) - 1
            assert [r["cut"] for r in got] == list(range(first, first + len(got)))
            assert len(got) == 1 + sum(x > v and x - v + a < b for x in breaks)


def test_states_at_one_time(spark):
    df = spark.createDataFrame([(1, 5.0, "b"), (1, 5.0, "a"), (1, 9.0, "c")], "k int, t double, s string")
    got = [(r["start"], r["stop"], r["s"]) for r in data_prep.intervals_of_states(df, key="k", time="t", state="s").orderBy("start", "s").collect()]
    assert got == [(5.0, 5.0, "a"), (5.0, 9.0, "b"), (9.0, None, "c")]


def test_updates_in_overlapping_rows(spark):
    """Keys with touching, gapped and overlapping rows, repeated rows and updates, nulls."""
    rng = np.random.default_rng(12)
    base = []
    for k in range(8):
        at = 0.0
        for _ in range(6):
            a = at + float(rng.integers(0, 3))
            at = a + float(rng.integers(1, 6))
            base.append((k, a, at))
    base += [(8, 0.0, 9.0), (8, 2.0, 5.0), (8, 2.0, 7.0), (8, 2.0, 7.0), (None, 0.0, 5.0)]
    ups = [(int(rng.integers(0, 10)), float(rng.integers(0, 24)), i) for i in range(90)] + [(8, 3.0, 1), (None, 2.0, 1), (3, None, 1)]
    df, up = spark.createDataFrame(base, "k int, a double, b double"), spark.createDataFrame(ups, "k int, t double, v int")
    got = sorted((str(r["k"]), r["a"], r["b"]) for r in data_prep.merge_updates(df, up, key="k", start="a", stop="b", time="t", value="v").select("k", "a", "b").collect())
    want = []
    for k, a, b in base:
        inner = sorted({t for q, t, _ in ups if k is not None and q == k and t is not None and a < t < b})
        want += [(str(k), x, y) for x, y in zip([a, *inner], [*inner, b], strict=True)]
    assert got == sorted(want)
    count = {}
    for k, t, _ in ups:
        if t is None:
            continue
        own = [(a, b) for q, a, b in base if q == k and k is not None]
        begins, ends = any(a == t for a, _ in own), any(b == t for _, b in own)
        place = "no key" if not own else "early" if t < min(own)[0] else "late" if t > max(b for _, b in own) else "within" if any(a < t < b for a, b in own) else "boundary" if begins and ends else "leading" if begins else "trailing" if ends else "gap"
        count[place] = count.get(place, 0) + 1
    assert {r["place"]: r["n"] for r in data_prep.update_places(df, up, key="k", start="a", stop="b", time="t").collect()} == count


def test_updates_in_one_window(spark, monkeypatch):
    """Histories without overlaps need no lookup by ranges; what each part says is the same by either way."""
    base = [(1, 0.0, 5.0, "x"), (1, 5.0, 9.0, "y"), (1, 10.0, 20.0, "z"), (2, 3.0, 4.0, "x"), (3, 1.0, 8.0, None)]
    mixed = [(4, 2.0, 2.0, "x"), (5, 7.0, 3.0, "x"), (5, 8.0, 12.0, "y"), (6, 0.0, 9.0, "x"), (6, 2.0, 5.0, "y"), (7, 1.0, 4.0, "x"), (7, 1.0, 4.0, "y"), (None, 0.0, 5.0, "x")]
    ups = [(1, -1.0, 7), (1, 2.0, 3), (1, 2.0, 4), (1, 5.0, 1), (1, 9.0, 2), (1, 9.5, 8), (1, 12.0, None), (1, 15.0, 6), (1, 20.0, 5), (1, 30.0, 9), (3, 8.0, 2), (4, 2.0, 3), (5, 3.0, 6), (5, 7.5, 1), (5, 9.0, 4), (6, 3.0, 2), (7, 2.0, 6), (9, 1.0, 1), (None, 2.0, 5), (2, None, 5)]
    up = spark.createDataFrame(ups, "k int, t double, v int")

    def want(rows, kind, first):
        out = []
        for k, a, b, s in rows:
            own = [(t, v) for q, t, v in ups if q == k and t is not None and v is not None]
            inner = sorted({t for t, _ in own if k is not None and a < t < b})
            for x, y in zip([a, *inner], [*inner, b], strict=True):
                before, at = [u for u in own if u[0] <= x], [v for t, v in own if t == y]
                got = {"last": max(before)[1] if before else None, "cumulative": sum(v for _, v in before) if before else None, "event": max(at, default=None), "cumulative_event": sum(v for t, v in own if t <= y) if at else None}[kind]
                none = first if first is not None else None if kind == "last" else 0
                out.append((k, x, y, s, none if got is None else got))
        return sorted(map(str, out))

    def made(rows, kind, first):
        df = spark.createDataFrame(rows, "k int, a double, b double, s string")
        got = data_prep.merge_updates(df, up, key="k", start="a", stop="b", time="t", value="v", kind=kind, name="said", initial=first)
        assert got.columns == ["k", "a", "b", "s", "said"]
        return sorted(str((r["k"], r["a"], r["b"], r["s"], None if r["said"] is None else int(r["said"]))) for r in got.collect())

    cases = [("last", -3), ("event", None), ("cumulative", None), ("cumulative_event", None)]
    for kind, first in cases:
        assert made(base + mixed, kind, first) == want(base + mixed, kind, first)
    with monkeypatch.context() as m:
        m.setattr(data_prep, "as_of", None)
        m.setattr(data_prep, "running", None)
        for kind, first in cases[:2]:
            assert made(base, kind, first) == want(base, kind, first)
    monkeypatch.setattr(data_prep, "KEY_ROWS", 0)
    assert made(base, *cases[1]) == want(base, *cases[1])


@pytest.mark.parametrize(("n", "k", "e0", "s0"), [(50, 65, 3.0, 3.0), (500, 5000, 40.0, 41.5), (500, 3000, 1e-9, 700.0), (900, 90_000, 2.5, 900.0), (7, 2_000_000, 8e5, 3e6)])
def test_efron_sums_of_many_ties(spark, n, k, e0, s0):
    """Sums over ties are those term by term, and their work doesn't grow with the ties."""
    line = spark.createDataFrame([(1.0, float(k), e0, s0)], "d double, _k double, e0 double, s0 double")
    q = cox._efron_sums(line).first()["_q"]
    f = np.arange(k) / k
    v = s0 - f * e0
    want = {"l": np.log(v), "a": 1 / v, "af": f / v, "b": v**-2, "bf": f / v**2, "bff": f * f / v**2}
    for name, terms in want.items():
        assert q[name] == pytest.approx(math.fsum(terms), rel=3e-9, abs=1e-9), name


def test_condensing_sorts_rows_once(spark):
    """Runs are those of a plain loop, with nulls, equal rows and rows that end before they begin; the plan has one sort and no grouping."""
    rng = np.random.default_rng(8)
    rows = [(int(rng.integers(0, 40)), a, a + int(rng.integers(1, 3)), int(rng.random() < 0.3), "xy"[int(rng.integers(0, 2))]) for a in map(int, rng.integers(0, 9, 400))]
    rows += [(50, 0, 1, None, "x"), (50, 1, 2, 0, "x"), (50, 2, None, 0, None), (51, None, 4, 0, "x"), (51, 4, 5, None, "x"), (52, 0, 3, 0, "x"), (52, 3, 2, 0, "x"), (None, 0, 1, 0, "x"), (None, 1, 2, 1, "x"), (53, 0, 2, 0, "x"), (53, 1, 3, 0, "x"), (53, 2, 4, 1, "x")]
    df = spark.createDataFrame(rows, "k int, a int, b int, e int, g string")
    low = lambda v: (v is not None, v if v is not None else 0)
    out, before = [], None
    for r in sorted(rows, key=lambda r: (low(r[0]), *map(low, r[1:4]), r[4] or "")):
        if before is not None and before[0] == r[0] and before[2] == r[1] and before[3] == 0 and before[4] == r[4]:
            run = out[-1]
            run[2], run[3] = max((v for v in (run[2], r[2]) if v is not None), default=None), max((v for v in (run[3], r[3]) if v is not None), default=None)
        else:
            out.append(list(r))
        before = r
    made = data_prep.condense(df, key="k", start="a", stop="b", event="e", same=["g"])
    order = lambda t: sorted(t, key=str)
    assert order(tuple(r) for r in made.select("k", "a", "b", "e", "g").collect()) == order(map(tuple, out))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and "Aggregate" not in plan


def test_expected_curves_sum_equal_rows(spark):
    """Hazards are made for distinct rows, no grouping is by row; a cell a sex lacks and a sex the table lacks change nothing."""
    rates = spark.createDataFrame([(0.0, 1e9, 0.0, 1e9, "a", 0.01), (0.0, 100.0, 0.0, 1e9, "b", 0.02), (100.0, 1e9, 0.0, 1e9, "b", 0.03)], "age_lo double, age_hi double, year_lo double, year_hi double, sex string, rate double")
    df = spark.createDataFrame([(i, 20.0 if i % 3 else 5.0, 95.0, 2000.0, "abc"[i % 3]) for i in range(9)], "row int, days double, age double, year double, sex string")
    made = population.expected_curve(df, rates, row="row", time="days", age="age", year="year", sex="sex", times=[10.0])
    got = made.first()
    a, b = 0.1, 5 * 0.02 + 5 * 0.03
    assert (got["n"], got["surv"], got["hazard"]) == (6, pytest.approx((math.exp(-a) + math.exp(-b)) / 2), pytest.approx((a + b) / 2))
    assert "row#" not in made._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]

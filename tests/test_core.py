"""Published values for the aml data, and queries against their SQL."""

from concurrent.futures import ThreadPoolExecutor

import duckdb
import pandas as pd
import pytest

from censorium.operators import compare, cox, curves, data_prep, metrics
from censorium.plans import registry
from censorium.streaming.counts import curve_of_cells, streaming_cells

#: The published aml data (time, status) by group.
MAINTAINED = [(9, 1), (13, 1), (13, 0), (18, 1), (23, 1), (28, 0), (31, 1), (34, 1), (45, 0), (48, 1), (161, 0)]
OTHERS = [(5, 1), (5, 1), (8, 1), (8, 1), (12, 1), (16, 0), (23, 1), (27, 1), (30, 1), (33, 1), (43, 1), (45, 1)]


@pytest.fixture(scope="module")
def aml(spark):
    return spark.createDataFrame([(t, s, 0) for t, s in MAINTAINED] + [(t, s, 1) for t, s in OTHERS], "time int, status int, x int")


def test_kaplan_meier(aml):
    rows = {r["time"]: r for r in curves.kaplan_meier(aml.where("x = 0"), time="time", status="status").collect()}
    assert rows[48.0]["surv"] == pytest.approx(0.18409090909)
    assert rows[48.0]["std_err"] == pytest.approx(0.15349274579)


def test_delayed_entry(spark):
    rows = spark.createDataFrame([(0.0, 5.0, 1), (2.0, 6.0, 1), (5.0, 7.0, 0)], "a double, b double, s int")
    found = {r["time"]: r["n_risk"] for r in curves.kaplan_meier(rows, time="b", status="s", entry="a").collect()}
    assert found == {5.0: 2.0, 6.0: 2.0, 7.0: 1.0}


def test_logrank(aml):
    assert compare.logrank(aml, time="time", status="status", group="x").first()["chi_square"] == pytest.approx(3.396388699)


def test_restricted_mean(aml):
    km = aml.where("x = 0")
    assert curves.restricted_mean(km, time="time", status="status", tau=30.0).first()["rmst"] == pytest.approx(24.6022727273)
    assert curves.restricted_mean(km, time="time", status="status", tau=48.0).first()["rmst"] == pytest.approx(31.8431818182)


def test_cox(aml):
    fit = cox.cox_fit(aml, time="time", status="status", x=["x"])
    assert fit.coefficients[0] == pytest.approx(0.90421972369, abs=1e-8)
    assert fit.std_errors[0] == pytest.approx(0.5122479073, abs=1e-7)
    assert fit.log_likelihood == pytest.approx(-41.25011435, abs=1e-7)


def test_concordance(spark):
    import random

    draw = random.Random(3)
    rows = [(draw.randint(1, 9), draw.randint(0, 1), draw.choice([-1.5, 0.0, 0.25, 2.0, 7.0])) for _ in range(80)] + [(None, 1, 0.0), (3, 1, None)]
    want = [0, 0, 0]
    whole = [r for r in rows if None not in r]
    for i, (t, s, x) in enumerate(whole):
        for j, (u, r, y) in enumerate(whole):
            if i != j and s and (u > t or (u == t and not r)):
                want[0 if x > y else 1 if x < y else 2] += 1
    got = metrics.concordance(spark.createDataFrame(rows, "t int, s int, x double"), time="t", status="s", risk="x").first()
    assert [got["concordant"], got["discordant"], got["tied_risk"]] == want
    empty = metrics.concordance(spark.createDataFrame([], "t int, s int, x double"), time="t", status="s", risk="x").first()
    assert empty["c_index"] is None


def test_condense(spark):
    rows = spark.createDataFrame([(1, 0, 2, 0), (1, 2, 5, 0), (1, 5, 6, 1), (1, 6, 7, 0), (1, 8, 9, 0), (2, 0, 1, 0)], "k int, a int, b int, e int")
    assert sorted(tuple(r) for r in data_prep.condense(rows, key="k", start="a", stop="b", event="e").collect()) == [(1, 0, 6, 1), (1, 6, 7, 0), (1, 8, 9, 0), (2, 0, 1, 0)]


def test_carry_forward(spark):
    rows = spark.createDataFrame([(1, 1, 5.0), (1, 2, None), (2, 1, None)], "k int, t int, v double")
    assert sorted(tuple(r) for r in data_prep.carry_forward(rows, key="k", time="t", value="v").collect() if r["v"] is not None) == [(1, 1, 5.0), (1, 2, 5.0)]


def test_streaming_curve(spark, aml, tmp_path):
    aml.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(aml.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = streaming_cells(stream, time="time", status="status", keys=["x"]).writeStream.outputMode("complete").format("memory").queryName("cells").start()
    query.processAllAvailable()
    query.stop()
    got = {(r["x"], r["time"]): r["surv"] for r in curve_of_cells(spark.table("cells"), keys=["x"]).collect()}
    want = {(r["x"], r["time"]): r["surv"] for r in curves.kaplan_meier(aml, time="time", status="status", keys=["x"]).collect()}
    assert got == pytest.approx(want)


FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    """Every registered query, several at a time: at this size a query is mostly planning."""
    made = registry.queries()

    def run(name):
        try:
            return made[name](spark, FOLDER).toPandas()
        except Exception as problem:  # noqa: BLE001 - shown by the query's own test
            return problem

    with ThreadPoolExecutor(4) as pool:
        return dict(zip(made, pool.map(run, made), strict=True))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(results, name):
    con = duckdb.connect()
    for t in ("lineitem", "events", "orders", "nation", "customer"):
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    got, want = results[name], con.sql(registry.oracle_sql()[name]).df()
    if isinstance(got, Exception):
        raise got
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    order = lambda d: d[cols].sort_values(cols).reset_index(drop=True).astype({c: "datetime64[ns]" for c in cols if "datetime" in str(d[c].dtype)})
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False, atol=2e-6)

"""Rate tables, person-years, expected and net curves.

A rate table is a DataFrame with a row per cell: ``age_lo, age_hi`` and ``year_lo, year_hi`` (half-open), ``sex`` and a
daily ``rate``; ages in days, years as calendar years.  Cells are few and known, so those of a sex go to its rows as one array,
behind a check of their number, and a row's hazard needs no grouping.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from censorium.functions.prefix import running
from censorium.functions.riskset import timeline
from censorium.functions.special import z_of

#: Days of a year (fixed value); cells of a rate table that are broadcast at most, and cells of a sex that are written out in an expression.
YEAR, MOST_CELLS, MOST_WRITTEN = 365.25, 200_000, 16


def rate_table(spark: SparkSession, *, age_breaks: Sequence[float], year_breaks: Sequence[float], rates: dict[str, Sequence[Sequence[float]]]) -> DataFrame:
    """A rate table from breaks (ages in days) and, by sex, rates[age interval][year interval]; first and last cells reach outwards."""
    out = []
    for sex, table in rates.items():
        if len(table) != len(age_breaks) - 1 or any(len(r) != len(year_breaks) - 1 for r in table):
            raise ValueError("rates need a value per age and year interval")
        for i, row in enumerate(table):
            for j, rate in enumerate(row):
                low = (float("-inf") if i == 0 else float(age_breaks[i]), float("-inf") if j == 0 else float(year_breaks[j]))
                high = (float("inf") if i == len(age_breaks) - 2 else float(age_breaks[i + 1]), float("inf") if j == len(year_breaks) - 2 else float(year_breaks[j + 1]))
                out.append((low[0], high[0], low[1], high[1], sex, float(rate)))
    return spark.createDataFrame(out, "age_lo double, age_hi double, year_lo double, year_hi double, sex string, rate double")


def is_rate_table(df: DataFrame) -> bool:
    return {"age_lo", "age_hi", "year_lo", "year_hi", "sex", "rate"} <= set(df.columns)


def days_since(year: Column, month: Column, day: Column, origin: int = 1960) -> Column:
    """Days from 1 January of the origin year to a date."""
    return F.date_diff(F.make_date(year, month, day), F.lit(f"{origin}-01-01").cast("date"))


def date_of_days(days: Column, origin: int = 1960) -> Column:
    return F.date_add(F.lit(f"{origin}-01-01").cast("date"), days.cast("int"))


def _with_cells(df: DataFrame, rates: DataFrame, sex: str) -> tuple[DataFrame, int]:
    """Rows whose sex is in the rate table, with its cells as the array ``_cells`` (one row a sex is broadcast), and the most cells of a sex."""
    if not is_rate_table(rates):
        raise ValueError("not a rate table")
    cells = rates.groupBy(F.col("sex").alias("_sex")).agg(F.collect_list(F.struct("age_lo", "age_hi", "year_lo", "year_hi", "rate")).alias("_cells"))
    total, most = cells.agg(F.sum(F.size("_cells")), F.max(F.size("_cells"))).first()
    few = (total or 0) <= MOST_CELLS
    return df.join(F.broadcast(cells) if few else cells, F.col(sex) == F.col("_sex")).drop("_sex"), most or 0


def _hazard(most: int, until: Column, age: Column, year: Column) -> Column:
    """Sum over at most ``most`` ``_cells`` of rate times the days inside, from entry over ``until`` days."""
    t, a, y = (c.cast("double") for c in (until, age, year))

    def part(cell: Column) -> Column:
        enter = F.greatest(F.lit(0.0), cell["age_lo"] - a, (cell["year_lo"] - y) * YEAR)
        leave = F.least(t, cell["age_hi"] - a, (cell["year_hi"] - y) * YEAR)
        return F.greatest(F.lit(0.0), leave - enter) * cell["rate"]

    if 0 < most <= MOST_WRITTEN:
        # written out, a few cells are much faster than a loop; a cell that a sex lacks has no rate
        parts = [part(F.get("_cells", F.lit(i))) for i in range(most)]
        return F.when(F.coalesce(*parts).isNotNull(), sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)))
    return F.aggregate("_cells", F.lit(None).cast("double"), lambda total, cell: F.coalesce(total + part(cell), total, part(cell)))


def expected_hazard(df: DataFrame, rates: DataFrame, *, until: str, age: str, year: str, sex: str, row: str) -> DataFrame:
    """``(row, until, hazard)``: the rate table's hazard from entry (at ``age``, ``year``) over ``until`` days, cell by cell.

    A subject crosses the cells of its sex along a straight line; each cell adds rate times the days inside it.
    ``row`` identifies rows of df together with ``until``.
    """
    met, most = _with_cells(df.select(F.col(row).alias("_row"), F.col(until).cast("double").alias("_until"), F.col(age).alias("_age"), F.col(year).alias("_year"), F.col(sex).alias("_of")), rates, "_of")
    return met.select(F.col("_row").alias(row), F.col("_until").alias(until), _hazard(most, F.col("_until"), F.col("_age"), F.col("_year")).alias("hazard"))


def expected_curve(df: DataFrame, rates: DataFrame, *, row: str, time: str, age: str, year: str, sex: str, times: Sequence[float], method: str = "ederer") -> DataFrame:
    """``(at, n, surv, hazard)`` per requested time: ``ederer`` (everyone), ``hakulinen`` (those still followed), ``conditional`` (product over intervals of the mean hazard of those at risk), ``individual`` (mean of everyone)."""
    if method not in ("ederer", "hakulinen", "conditional", "individual"):
        raise ValueError("method is ederer, hakulinen, conditional or individual")
    grid = sorted(set(map(float, times)))
    rows = df.withColumn("at", F.explode(F.array(*(F.lit(t) for t in grid))))
    if method in ("hakulinen", "conditional"):
        rows = rows.where(F.col(time) >= F.col("at"))
    # equal rows are one row with their number
    alike = rows.groupBy("at", F.col(age).cast("double").alias("_age"), F.col(year).cast("double").alias("_year"), F.col(sex).alias("_of")).agg(F.count("*").alias("_n"))
    met, most = _with_cells(alike, rates, "_of")
    to = lambda until: _hazard(most, until, F.col("_age"), F.col("_year"))
    hazards = met.select("at", "_n", to(F.col("at")).alias("hazard"), *([] if method != "conditional" else [to(_begin(grid)).alias("_h0")]))
    mean_of = lambda v: F.try_divide(F.sum(v * F.col("_n")), F.sum(F.when(v.isNotNull(), F.col("_n"))))
    if method != "conditional":
        return hazards.groupBy("at").agg(F.sum("_n").alias("n"), mean_of(F.exp(-F.col("hazard"))).alias("surv"), mean_of(F.col("hazard")).alias("hazard"))
    mean = hazards.groupBy("at").agg(F.sum("_n").alias("n"), mean_of(F.col("hazard") - F.col("_h0")).alias("_step"))
    return running(mean, order="at", sums={"hazard": F.col("_step")}).withColumn("surv", F.exp(-F.col("hazard"))).select("at", "n", "surv", "hazard")


def _begin(grid: Sequence[float]) -> Column:
    """The time of the grid before ``at``, or 0."""
    return F.coalesce(*(F.when(F.col("at") == t, F.lit(s)) for t, s in zip(grid, [0.0, *grid], strict=False)))


def person_years(df: DataFrame, rates: DataFrame | None = None, *, row: str, time: str, status: str, keys: Sequence[str] = (), age: str | None = None, year: str | None = None, sex: str | None = None, scale: float = YEAR) -> DataFrame:
    """``(keys, n, person_years, events, expected, rate, smr)`` by group; expected events and ratio if a rate table is given."""
    rows = df.where(F.col(time).isNotNull() & F.col(status).isNotNull())
    if rates is not None:
        hazard = expected_hazard(rows, rates, until=time, age=age, year=year, sex=sex, row=row).select(row, F.col("hazard").alias("_h"))
        rows = rows.join(hazard, row, "left")
    expected = F.sum(F.coalesce("_h", F.lit(0.0))) if rates is not None else F.lit(None).cast("double")
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), (F.sum(F.col(time).cast("double")) / scale).alias("person_years"), F.sum((F.col(status) != 0).cast("double")).alias("events"), expected.alias("expected"))
    return out.withColumns({"rate": F.try_divide("events", "person_years"), "smr": F.when(F.col("expected") > 0, F.col("events") / F.col("expected"))})


def person_years_total(cells: DataFrame) -> DataFrame:
    """One row over the cells of ``person_years``."""
    out = cells.agg(F.sum("n").alias("n"), F.sum("person_years").alias("person_years"), F.sum("events").alias("events"), F.sum("expected").alias("expected"))
    return out.withColumns({"rate": F.try_divide("events", "person_years"), "expected_rate": F.try_divide("expected", "person_years"), "smr": F.when(F.col("expected") > 0, F.col("events") / F.col("expected"))})


def net_curve(df: DataFrame, *, time: str, status: str, expected: str, weight: str | None = None, method: str = "pohar-perme", level: float = 0.95) -> DataFrame:
    """Net curve per distinct time from each row's ``expected`` curve value at its own time.

    ``pohar-perme``: rows weigh 1 / expected; ``ederer``: observed curve over the mean expected value of those at risk.
    Columns: time, n_risk, n_event, excess (cumulative), surv, std_err, lower, upper.
    """
    if method not in ("pohar-perme", "ederer"):
        raise ValueError("method is pohar-perme or ederer")
    rows = df.dropna(subset=[time, status, expected, *([weight] if weight else [])])
    case, had = F.col(weight).cast("double") if weight else F.lit(1.0), (F.col(status) != 0).cast("double")
    w = case / F.greatest(F.col(expected).cast("double"), F.lit(1e-10)) if method == "pohar-perme" else case
    at = timeline(rows, time=time, entry=None, keys=[], at={"n_event": had, "_d": w * had}, leaving={"n_risk": F.lit(1.0), "_r": w, "_e": case * F.col(expected)})
    h = F.col("_d") / F.col("_r")
    run = running(at, order="time", products={"_s": 1 - h}, sums={"_h": h, "_v": F.when(h < 1, h / (1 - h) / F.col("_r")).otherwise(F.lit(0.0))})
    if method == "pohar-perme":
        surv, excess = F.greatest(F.lit(0.0), F.col("_s")), F.col("_h")
    else:
        surv = F.col("_s") / (F.col("_e") / F.col("_r"))
        excess = F.col("_h") + F.log(F.col("_e") / F.col("_r"))
    z = z_of(level)
    out = run.select("time", "n_risk", "n_event", excess.alias("excess"), surv.alias("surv"), (F.col("_s") * F.sqrt("_v")).alias("std_err"))
    return out.withColumns({"lower": F.greatest(F.lit(0.0), F.col("surv") - z * F.col("std_err")), "upper": F.least(F.lit(1.0), F.col("surv") + z * F.col("std_err"))})


def crude_probability(df: DataFrame, *, time: str, status: str, cause: str, times: Sequence[float], of: int = 1) -> DataFrame:
    """``(at, of_cause, other)``: shares of all rows with an event by the time, from the cause and from others."""
    rows = df.dropna(subset=[time, status])
    total = rows.agg(F.count("*").alias("_n"), *(F.sum(((F.col(time) <= t) & (F.col(status) != 0) & (F.col(cause) == of)).cast("double")).alias(f"a{i}") for i, t in enumerate(times)), *(F.sum(((F.col(time) <= t) & (F.col(status) != 0) & ~(F.col(cause).eqNullSafe(of))).cast("double")).alias(f"b{i}") for i, t in enumerate(times)))
    long = total.select("_n", F.explode(F.array(*(F.struct(F.lit(float(t)).alias("at"), F.coalesce(f"a{i}", F.lit(0.0)).alias("a"), F.coalesce(f"b{i}", F.lit(0.0)).alias("b")) for i, t in enumerate(times)))).alias("x"))
    return long.select("x.at", F.try_divide("x.a", "_n").alias("of_cause"), F.try_divide("x.b", "_n").alias("other"))

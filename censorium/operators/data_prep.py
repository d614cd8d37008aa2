"""Histories: splitting at cuts, as-of lookup, carrying forward, repeats, merging updates, timelines, checks, person-time.

Windows by key run over one subject's history; lookups (``as_of``) and snapping deal long histories out by ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from censorium.functions.lineage import cut
from censorium.functions.prefix import as_of, join_keys, number, running
from censorium.functions.riskset import cells

#: Rows and updates of a key that one window sees at most.
KEY_ROWS = 100_000


def split_at(df: DataFrame, *, start: str, stop: str, event: str, cuts: Sequence[float]) -> DataFrame:
    """Rows (start, stop] cut at fixed times; the event stays with the last part, ``episode`` counts the cuts before.

    A row with a null start or stop passes through whole, with a null episode.
    """
    edges = F.array(*(F.lit(float(c)) for c in sorted(set(cuts))))
    inner = F.coalesce(F.filter(edges, lambda c: (c > F.col(start)) & (c < F.col(stop))), F.array().cast("array<double>"))
    lows = F.concat(F.array(F.col(start).cast("double")), inner)
    highs = F.concat(inner, F.array(F.col(stop).cast("double")))
    parts = df.withColumn("_p", F.explode(F.arrays_zip(lows.alias("a"), highs.alias("b"))))
    last = F.col("_p.b").eqNullSafe(F.col(stop))
    whole = F.col("_p.a").isNull() | F.col("_p.b").isNull()
    episode = F.when(~whole, F.size(F.filter(edges, lambda c: c <= F.col("_p.a"))))
    return parts.withColumns({"episode": episode, event: F.when(last | whole, F.col(event)).otherwise(F.lit(0)), start: F.col("_p.a"), stop: F.col("_p.b")}).drop("_p")


def nearest_before(left: DataFrame, right: DataFrame, *, key: str, left_time: str, right_time: str, value: str) -> DataFrame:
    """left with ``value`` of right's last row of the key at or before left_time (null if none); of equal times the largest value."""
    return nearest(left, right, key=key, left_time=left_time, right_time=right_time, value=value)


def nearest(left: DataFrame, right: DataFrame, *, key: str, left_time: str, right_time: str, value: str, best: str = "prior") -> DataFrame:
    """left with ``value`` of right's nearest row of the key: ``prior`` (at or before), ``after`` (at or after) or ``closest`` (ties: prior).

    Of right rows with equal times the one with the largest value counts; a null time matches nothing.
    """
    if best not in ("prior", "after", "closest"):
        raise ValueError("best is prior, after or closest")
    at = number(left, left_time)
    steps = right.where(F.col(right_time).isNotNull()).select(key, number(right, right_time).alias("_s"), F.col(value).alias("_v"))
    steps = steps.withColumns({"_b": -F.col("_s"), "_when": F.col("_s")})
    out = left.withColumns({"_at": at, "_back": -at})
    if best != "after":
        out = as_of(out, steps, at="_at", step="_s", values=["_v", "_when"], keys=[key]).withColumnsRenamed({"_v": "_pv", "_when": "_pt"})
    if best != "prior":
        out = as_of(out, steps, at="_back", step="_b", values=["_v", "_when"], keys=[key]).withColumnsRenamed({"_v": "_av", "_when": "_a"})
    if best == "prior":
        found = F.col("_pv")
    elif best == "after":
        found = F.col("_av")
    else:
        found = F.when(F.col("_a").isNull() | (F.col("_at") - F.col("_pt") <= F.col("_a") - F.col("_at")), F.col("_pv")).otherwise(F.col("_av"))
    return out.withColumn(value, F.when(F.col("_at").isNotNull(), found)).drop("_at", "_back", "_pv", "_pt", "_av", "_a")


def carry_forward(df: DataFrame, *, key: str, time: str, value: str) -> DataFrame:
    """Nulls of ``value`` replaced by the key's last value at an earlier or equal time (of equal times the largest)."""
    known = df.where(F.col(value).isNotNull()).select(key, time, F.col(value).alias("_v"))
    found = as_of(df, known, at=time, step=time, values=["_v"], keys=[key])
    return found.withColumn(value, F.coalesce(value, "_v")).drop("_v")


def carried_from(df: DataFrame, *, key: str, time: str, value: str, row: str) -> DataFrame:
    """df with ``source``: the ``row`` id whose value a null takes over (its own if it has one, null if there is none before)."""
    known = df.where(F.col(value).isNotNull()).select(key, time, F.col(row).alias("_v"))
    found = as_of(df, known, at=time, step=time, values=["_v"], keys=[key])
    return found.withColumn("source", F.when(F.col(value).isNotNull(), F.col(row)).otherwise(F.col("_v"))).drop("_v")


def _history(key: str, time: str, tie: Sequence[str]) -> Window:
    return Window.partitionBy(key).orderBy(time, *tie)


def without_repeats(df: DataFrame, *, key: str, time: str, state: str, tie: Sequence[str] = ()) -> DataFrame:
    """Rows whose state differs from the key's row before; ``tie`` orders rows of equal time (then the state)."""
    w = _history(key, time, [*tie, state])
    before, first = F.lag(state).over(w), F.row_number().over(w) == 1
    return df.withColumn("_new", first | ~F.col(state).eqNullSafe(before)).where("_new").drop("_new")


def censor_repeats(df: DataFrame, *, key: str, time: str, state: str, censor, single: bool = False, tie: Sequence[str] = ()) -> DataFrame:
    """A state equal to the key's last one (censorings passed over) becomes ``censor``; ``single``: equal to any earlier one."""
    real = F.when(F.col(state) != F.lit(censor), F.col(state))
    if single:
        w = Window.partitionBy(key, state).orderBy(time, *tie)
        again = F.row_number().over(w) > 1
    else:
        w = _history(key, time, [*tie, state]).rowsBetween(Window.unboundedPreceding, -1)
        again = F.last(real, ignorenulls=True).over(w) == F.col(state)
    flagged = df.withColumn("_again", F.coalesce(again, F.lit(False)) & real.isNotNull())
    return flagged.withColumn(state, F.when(F.col("_again"), F.lit(censor)).otherwise(F.col(state))).drop("_again")


def person_time(df: DataFrame, *, time: str, status: str, keys: Sequence[str]) -> DataFrame:
    """Rows, events, person-time and rate by group, of rows with a time and a status."""
    rows = df.where(F.col(time).isNotNull() & F.col(status).isNotNull())
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum((F.col(status) != 0).cast("double")).alias("events"), F.sum(F.col(time).cast("double")).alias("person_time"))
    return out.withColumn("rate", F.try_divide("events", "person_time"))


def _runs(df: DataFrame, key: str, start: str, stop: str, event: str, same: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(start, stop, event, *same)
    touches = F.lag(stop).over(w).eqNullSafe(F.col(start)) & (F.lag(event).over(w) == 0)
    for c in same:
        touches = touches & F.lag(c).over(w).eqNullSafe(F.col(c))
    new = df.withColumn("_new", F.when(F.coalesce(touches, F.lit(False)), 0).otherwise(1))
    # of equal rows the one that touches comes first, in this sort too
    order = Window.partitionBy(key).orderBy(start, stop, event, *same, "_new").rowsBetween(Window.unboundedPreceding, 0)
    return new.withColumn("_run", F.sum("_new").over(order))


def condense(df: DataFrame, *, key: str, start: str, stop: str, event: str, same: Sequence[str] = ()) -> DataFrame:
    """Touching (start, stop] rows of a key become one as long as no event ends them and the columns ``same`` agree.

    Of equal rows only the first touches the row before.  One sort by key and time serves all windows: a run's rows follow one another,
    so what they become is known at its last row, and neither a second sort nor a grouping holds the rows again.
    """
    order = Window.partitionBy(key).orderBy(start, stop, event, *same)
    # whether a row touches the one before, seen from either of them
    from_here = _touches(F.lag(stop).over(order), F.lag(event).over(order), F.col(start), [(F.lag(c).over(order), F.col(c)) for c in same])
    from_next = _touches(F.col(stop), F.col(event), F.lead(start).over(order), [(F.col(c), F.lead(c).over(order)) for c in same])
    follows = F.lead(F.lit(1)).over(order).isNotNull()
    flagged = df.select(key, start, stop, event, *same, from_here.alias("_joined"), (from_next & follows).alias("_goes_on"))
    first = F.last(F.when(~F.col("_joined"), F.struct(F.col(start).alias("v"))), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ends = flagged.withColumn("_first", first).where(~F.col("_goes_on"))
    # rows of a run but the last have no event and end where the next begins
    top = lambda c, least: F.when(F.col("_joined"), F.greatest(F.col(c), least)).otherwise(F.col(c)).alias(c)
    return ends.select(key, *same, F.col("_first.v").alias(start), top(stop, F.col(start)), top(event, F.lit(0).cast(df.schema[event].dataType)))


def _touches(stop: Column, event: Column, start: Column, same: Sequence[tuple[Column, Column]]) -> Column:
    out = stop.eqNullSafe(start) & (event == 0)
    for a, b in same:
        out = out & a.eqNullSafe(b)
    return F.coalesce(out, F.lit(False))


def condense_plan(df: DataFrame, *, key: str, start: str, stop: str, event: str, same: Sequence[str] = ()) -> DataFrame:
    """df with ``run`` (number of the condensed row), ``run_start`` and ``kept`` (the last row of its run)."""
    runs = _runs(df, key, start, stop, event, same)
    w = Window.partitionBy(key, "_run")
    last = F.row_number().over(w.orderBy(F.desc(stop), F.desc(event))) == 1
    return runs.withColumns({"run_start": F.min(start).over(w), "kept": last}).withColumnRenamed("_run", "run").drop("_new")


def collapse(df: DataFrame, *, key: str, start: str, stop: str, state: str, same: Sequence[str] = ()) -> DataFrame:
    """Adjacent rows of a key with equal state (and columns ``same``) become one interval."""
    w = Window.partitionBy(key).orderBy(start, stop)
    joined = F.lag(stop).over(w).eqNullSafe(F.col(start))
    for c in (state, *same):
        joined = joined & F.lag(c).over(w).eqNullSafe(F.col(c))
    runs = df.withColumn("_new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "_run", state, *same).agg(F.min(start).alias(start), F.max(stop).alias(stop)).drop("_run")


def snap_times(df: DataFrame, *, time: str, tolerance: float, relative: bool = False) -> DataFrame:
    """Times whose gap to the next smaller one is at most ``tolerance`` take the smallest of their run.

    ``relative``: a gap also counts as none if it is at most tolerance times the mean absolute distinct time.
    Distinct times go by ranges; no task sees all of them.
    """
    distinct = df.select(time).where(F.col(time).isNotNull()).distinct()
    lagged = running(distinct, order=time, maxima={"_before": F.col(time)}, strict=True, keep_bin=True)
    gap = F.col(time) - F.col("_before")
    small = gap <= tolerance
    if relative:
        mean = distinct.agg(F.avg(F.abs(F.col(time))).alias("_mean"))
        lagged = lagged.crossJoin(F.broadcast(mean))  # one row
        small = small | (gap <= tolerance * F.col("_mean"))
    snapped = running(lagged, order=time, maxima={"_snapped": F.when(F.coalesce(small, F.lit(False)), F.lit(None)).otherwise(F.col(time))}).select(time, "_snapped")
    return df.join(snapped, time, "left").withColumn(time, F.col("_snapped")).drop("_snapped").select(df.columns)


def dense_codes(df: DataFrame, *, columns: Sequence[str], name: str = "code", first_seen: str | None = None) -> DataFrame:
    """df with dense codes 0, 1, ... of the combinations of ``columns``: in their order, or by ``first_seen`` (a unique row order).

    Null is a value of its own.
    """
    order = F.min(first_seen) if first_seen else F.min(F.struct(*columns))
    values = df.groupBy(*columns).agg(order.alias("_o"))
    coded = running(values, order="_o", sums={"_c": F.lit(1)}).select(*columns, (F.col("_c") - 1).cast("long").alias(name))
    return join_keys(df, coded, columns)


def strata(df: DataFrame, *, columns: Sequence[str], name: str = "stratum") -> DataFrame:
    """df with ``stratum`` (dense code of the observed combinations) and ``<stratum>_label`` like "a=1, b=x"."""
    label = F.concat_ws(", ", *(F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in columns))
    return dense_codes(df, columns=columns, name=name).withColumn(f"{name}_label", label)


def time_cut(df: DataFrame, *, value: str, breaks: Sequence[float], labels: Sequence[str] | None = None, name: str = "cut") -> DataFrame:
    """df with the code 0, 1, ... of the interval [b, next b) that value is in (the last one is closed; outside: -1; null: null), and its label."""
    b = [float(x) for x in breaks]
    if len(b) < 2 or sorted(set(b)) != b:
        raise ValueError("breaks are at least two ascending values")
    v, last = F.col(value), len(b) - 2
    code = F.coalesce(*(F.when((v >= x) & ((v < y) if i < last else (v <= y)), F.lit(i)) for i, (x, y) in enumerate(zip(b, b[1:], strict=False))), F.when(v.isNotNull(), F.lit(-1)))
    texts = labels or [f"{x:g}+ thru {y:g}" for x, y in zip(b, b[1:], strict=False)]
    return df.withColumns({name: code}).withColumn(f"{name}_label", F.when(F.col(name) >= 0, F.array(*(F.lit(t) for t in texts))[F.greatest(F.col(name), F.lit(0))]))


def time_cut_expand(df: DataFrame, *, start: str, stop: str, event: str, value: str, breaks: Sequence[float], name: str = "cut") -> DataFrame:
    """Rows (start, stop] cut where ``value``, which is its value at start and grows with time, crosses a break; with the code of each part.

    The code is the number of the last break reached, -1 before the first; a part that starts at a break takes the break's number, so rounding of
    the shifted times moves no part into another interval.  The label is null before the first break and from the last on.
    """
    b = [float(x) for x in breaks]
    if len(b) < 2 or sorted(set(b)) != b:
        raise ValueError("breaks are at least two ascending values")
    first, last = F.col(start).cast("double"), F.col(stop).cast("double")
    edges = F.array(*(F.struct(F.lit(x).alias("at"), F.lit(i).alias("code")) for i, x in enumerate(b)))
    crossed = F.transform(F.filter(edges, lambda e: e["at"] > F.col(value)), lambda e: F.struct(F.greatest(first, e["at"] - F.col(value) + F.col(start)).alias("a"), e["code"].alias("code")))
    begins = F.concat(F.array(F.struct(first.alias("a"), (F.size(F.filter(edges, lambda e: e["at"] <= F.col(value))) - 1).alias("code"))), F.filter(crossed, lambda c: c["a"] < last))
    whole = df.withColumn("_b", F.when(F.col(value).isNull(), F.array(F.struct(first.alias("a"), F.lit(None).cast("int").alias("code")))).otherwise(begins))
    parts = whole.withColumn("_p", F.explode(F.transform("_b", lambda x, i: F.struct(x["a"].alias("a"), F.coalesce(F.get("_b", i + 1)["a"], last).alias("b"), x["code"].alias("code"))))).where(F.col("_p.a") < F.col("_p.b"))
    out = parts.withColumns({value: F.col(value) + F.col("_p.a") - F.col(start), event: F.when(F.col("_p.b") == last, F.col(event)).otherwise(F.lit(0)), start: F.col("_p.a"), stop: F.col("_p.b"), name: F.col("_p.code")}).drop("_p", "_b")
    texts = [f"{x:g}+ thru {y:g}" for x, y in zip(b, b[1:], strict=False)]
    return out.withColumn(f"{name}_label", F.get(F.array(*(F.lit(t) for t in texts)), F.when(F.col(name) >= 0, F.col(name))))


def redistributed_weights(df: DataFrame, *, time: str, status: str, keys: Sequence[str] = (), weight: str | None = None, at: Sequence[float] | None = None) -> DataFrame:
    """df with ``rtt``: weight w / G(t-) of events and 0 of censored rows, G being the censoring curve, events first at ties.

    With report times ``at`` each row appears once a time (column ``at``): rows that end later keep w / G(at-).
    Rows with null time or status have a null weight.
    """
    base = cells(df, time=time, status=status, keys=keys, weight=weight, keep_bin=True)
    left = F.col("n_risk") - F.col("n_event")
    g = running(base, order="time", keys=keys, products={"_G": F.when(left > 0, 1 - F.col("n_censor") / left).otherwise(F.lit(1.0))})
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    rows = df if at is None else df.withColumn("at", F.explode(F.array(*(F.lit(float(t)) for t in at))))
    t = F.col(time).cast("double")
    rows = rows.withColumn("_u", t if at is None else F.least(t, F.col("at")))
    found = as_of(rows, g, at="_u", step="time", values=["_G"], keys=keys, strict=True)
    value = w / F.coalesce("_G", F.lit(1.0))
    ended = F.lit(True) if at is None else t <= F.col("at")
    rtt = F.when(F.col(status).isNull() | F.col(time).isNull(), F.lit(None)).when(ended & (F.col(status) == 0), F.lit(0.0)).otherwise(value)
    return found.withColumn("rtt", rtt).drop("_u", "_G")


def _reach(spans: DataFrame, key: str) -> DataFrame:
    """``(key, _a, _top, _before, _n)``: the latest end of spans that begin at _a or before, of those before it, and the number that begin there."""
    at = spans.groupBy(key, "_a").agg(F.max("_b").alias("_b"), F.count("*").alias("_n"))
    out = running(at, order="_a", keys=[key], maxima={"_before": F.col("_b")}, strict=True)
    return out.withColumn("_top", F.greatest("_before", "_b"))


def _inside(spans: DataFrame, times: DataFrame, key: str) -> DataFrame:
    """``(key, _id, _t)``: times strictly inside spans (_id, _a, _b) of their key.

    Where a key's spans don't overlap a time can only lie in the last one that begins before it: a lookup.  Only times of
    keys with overlapping spans meet all spans of their key.
    """
    overlapping = cut(_reach(spans, key).where("_before > _a or _n > 1").select(key).distinct(), "overlapping")
    looked = as_of(times.join(overlapping, key, "left_anti"), spans, at="_t", step="_a", values=["_id", "_b"], keys=[key], strict=True).where("_t < _b").select(key, "_id", "_t")
    met = spans.join(overlapping, key, "left_semi").join(times, key).where("_t > _a and _t < _b").select(key, "_id", "_t")
    return looked.unionByName(met)


def _apart(base: DataFrame, up: DataFrame, key: str, start: str, stop: str) -> DataFrame:
    """Keys whose rows can't be merged in one window by key: with overlapping or empty rows, a missing start or stop, or very many rows."""
    sizes = base.select(key).unionByName(up.select(key)).groupBy(key).count()
    long = cut(sizes.where((F.col("count") > KEY_ROWS) & F.col(key).isNotNull()).select(key), "long-keys")
    spans = base.select(key, F.col(start).cast("double").alias("_a"), F.col(stop).cast("double").alias("_b")).where(F.col(key).isNotNull()).join(F.broadcast(long), key, "left_anti")
    w = Window.partitionBy(key).orderBy("_a").rowsBetween(Window.unboundedPreceding, -1)
    bad = F.col("_a").isNull() | F.col("_b").isNull() | F.isnan("_a") | F.isnan("_b") | (F.col("_b") <= F.col("_a"))
    odd = spans.withColumns({"_before": F.max("_b").over(w), "_last": F.max("_a").over(w)}).where(bad | (F.col("_before") > F.col("_a")) | (F.col("_last") == F.col("_a")))
    return cut(odd.select(key).unionByName(long).distinct(), "keys-apart")


def merge_updates(base: DataFrame, updates: DataFrame, *, key: str, start: str, stop: str, time: str, value: str, kind: str = "last", name: str | None = None, initial=None) -> DataFrame:
    """Rows (start, stop] of base cut at the key's updates inside them, with what the updates say of each part.

    ``last``: value of the last update at or before the part's start (null values are passed over); ``cumulative``: sum of values
    up to there; ``event``: value of the update at the part's stop (0 if none); ``cumulative_event``: the same
    for running sums.  ``initial`` is what holds before the first update.

    One window by key does it all where a key's rows don't overlap; overlapping and very long histories are looked up by ranges.
    """
    if kind not in ("last", "cumulative", "event", "cumulative_event"):
        raise ValueError("kind is last, cumulative, event or cumulative_event")
    name = name or value
    up = updates.where(F.col(time).isNotNull() & F.col(value).isNotNull()).select(key, F.col(time).cast("double").alias("_t"), F.col(value).alias("_v"))
    # written once: it is read several times, and is often the result of another merge
    rows = cut(base, "rows")
    how = dict(key=key, start=start, stop=stop, kind=kind, name=name, initial=initial)
    apart, nowhere = _apart(rows, up, key, start, stop), rows.where(F.col(key).isNull())
    if apart.isEmpty() and nowhere.isEmpty():
        return _merged_by_window(rows, up, **how)
    within = lambda df: df.join(apart, key, "left_semi").unionByName(df.where(F.col(key).isNull()))
    simple = _merged_by_window(rows.where(F.col(key).isNotNull()).join(apart, key, "left_anti"), up, **how)
    return simple.unionByName(_merged_by_ranges(within(rows), within(up), **how))


def _merged_by_window(rows: DataFrame, up: DataFrame, *, key: str, start: str, stop: str, kind: str, name: str, initial) -> DataFrame:
    """Rows of a key don't overlap: a part begins where a row does or at an update inside it, and ends at the next update or with the row."""
    steps = up.where(F.col(key).isNotNull()).groupBy(key, F.col("_t").alias("_at")).agg(F.max("_v").alias("_v"), *([F.sum("_v").alias("_s")] if kind.startswith("cumulative") else []))
    # an update at a row's start comes before it
    begun = rows.select(F.col(key), F.col(start).cast("double").alias("_at"), F.lit(1).alias("_side"), F.col(stop).cast("double").alias("_b"), F.struct(*(F.col(c) for c in rows.columns)).alias("_row"))
    line = begun.unionByName(steps.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy("_at", "_side")
    w = order.rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    held = F.sum("_s").over(w).cast("double") if kind.startswith("cumulative") else last("_v")
    line = line.withColumns({"_row": last("_row"), "_b": last("_b"), "_next": F.lead("_at").over(order), "_held": held, "_side1": F.lead("_side").over(order)})
    if kind in ("event", "cumulative_event"):
        line = line.withColumn("_then", F.lead("_v" if kind == "event" else "_held").over(order))
    line = line.where((F.col("_side") == 1) | (F.col("_at") < F.col("_b"))).withColumn("_end", F.when(F.col("_next") < F.col("_b"), F.col("_next")).otherwise(F.col("_b")))
    said = F.when((F.col("_side1") == 0) & (F.col("_next") == F.col("_end")), F.col("_then")) if kind in ("event", "cumulative_event") else F.col("_held")
    none = initial if initial is not None or kind == "last" else 0
    out = line.select("_row.*", F.col("_at").alias("_from"), F.col("_end").alias("_to"), (said if none is None else F.coalesce(said, F.lit(none))).alias("_said"))
    return out.withColumns({start: F.col("_from"), stop: F.col("_to")}).withColumn(name, F.col("_said")).drop("_from", "_to", "_said")


def _merged_by_ranges(base: DataFrame, up: DataFrame, *, key: str, start: str, stop: str, kind: str, name: str, initial) -> DataFrame:
    """The same for any rows: lookups that deal long histories out by ranges."""
    # written once: spans and rows read it
    numbered = cut(base.withColumn("_id", F.xxhash64(key, start, stop)), "rows")
    spans = numbered.select(key, "_id", F.col(start).cast("double").alias("_a"), F.col(stop).cast("double").alias("_b")).distinct()
    cuts = cut(_inside(spans, up.where(F.col(key).isNotNull()).select(key, "_t").distinct(), key).groupBy(key, "_id").agg(F.sort_array(F.collect_set("_t")).alias("_cuts")), "cuts")
    parts = join_keys(numbered, cuts, [key, "_id"], "left")
    inner = F.coalesce("_cuts", F.array().cast("array<double>"))
    zipped = F.arrays_zip(F.concat(F.array(F.col(start).cast("double")), inner).alias("a"), F.concat(inner, F.array(F.col(stop).cast("double"))).alias("b"))
    parts = parts.withColumn("_p", F.explode(zipped)).withColumns({start: F.col("_p.a"), stop: F.col("_p.b")}).drop("_p", "_cuts", "_id")
    if kind == "event":
        one = up.groupBy(key, "_t").agg(F.max("_v").alias("_v"))
        out = join_keys(parts.withColumn("_t", F.col(stop)), one, [key, "_t"], "left").drop("_t")
        return out.withColumn(name, F.coalesce("_v", F.lit(0 if initial is None else initial))).drop(*({"_v"} - {name}))
    steps = up
    if kind != "last":
        steps = running(up.groupBy(key, "_t").agg(F.sum("_v").alias("_v")), order="_t", keys=[key], sums={"_v": F.col("_v")})
    if kind == "cumulative_event":
        out = join_keys(parts.withColumn("_t", F.col(stop)), steps, [key, "_t"], "left").drop("_t")
        return out.withColumn(name, F.coalesce("_v", F.lit(0 if initial is None else initial))).drop("_v")
    out = as_of(parts, steps, at=start, step="_t", values=["_v"], keys=[key])
    if kind == "cumulative":
        return out.withColumn(name, F.coalesce("_v", F.lit(0 if initial is None else initial))).drop("_v")
    return out.withColumn(name, F.coalesce("_v", F.lit(initial)) if initial is not None else F.col("_v")).drop("_v")


def update_places(base: DataFrame, updates: DataFrame, *, key: str, start: str, stop: str, time: str) -> DataFrame:
    """``(place, n)``: where updates fall in the key's rows: early, late, gap, within, boundary (between touching rows), leading, trailing, or no such key."""
    spans = cut(base.select(key, F.col(start).cast("double").alias("_a"), F.col(stop).cast("double").alias("_b")).distinct(), "spans")
    up = updates.where(F.col(time).isNotNull()).select(key, F.col(time).cast("double").alias("_t"))
    ends = spans.groupBy(key).agg(F.min("_a").alias("_first"), F.max("_b").alias("_last"))
    # equal updates are counted once looked up
    both = as_of(up.groupBy(key, "_t").agg(F.count("*").alias("_n")), _reach(spans, key).select(key, "_a", "_top"), at="_t", step="_a", values=["_top"], keys=[key], strict=True).join(ends, key, "left")
    for name, side in (("_begins", "_a"), ("_ends", "_b")):
        both = both.join(spans.select(key, F.col(side).alias("_t")).distinct().withColumn(name, F.lit(True)), [key, "_t"], "left")
    begins, stops = F.coalesce("_begins", F.lit(False)), F.coalesce("_ends", F.lit(False))
    place = F.when(F.col("_first").isNull(), "no key").when(F.col("_t") < F.col("_first"), "early").when(F.col("_t") > F.col("_last"), "late").when(F.col("_top") > F.col("_t"), "within").when(begins & stops, "boundary").when(begins, "leading").when(stops, "trailing").otherwise("gap")
    return both.groupBy(place.alias("place")).agg(F.sum("_n").alias("n"))


def intervals_of_visits(df: DataFrame, *, key: str, time: str, state: str, repeated: bool = False, tie: Sequence[str] = ()) -> DataFrame:
    """Visits as (start, stop] rows that end in the next visit's state; without ``repeated`` a state equal to the one before ends in 0.

    Columns: key, start, stop, ``from`` (state at start) and ``event``; a key's last visit starts nothing.
    """
    w = _history(key, time, [*tie, state])
    rows = df.select(key, F.col(time).alias("start"), F.lead(time).over(w).alias("stop"), F.col(state).alias("from"), F.lead(state).over(w).alias("event")).where("stop is not null")
    return rows if repeated else rows.withColumn("event", F.when(F.col("event").eqNullSafe(F.col("from")), F.lit(0)).otherwise(F.col("event")))


def states_at(df: DataFrame, *, key: str, start: str, stop: str, state: str, times: Sequence[float]) -> DataFrame:
    """Intervals as ``(key, time, state)`` at the requested times: those with start <= time < stop."""
    points = F.filter(F.array(*(F.lit(float(t)) for t in sorted(set(times)))), lambda t: (t >= F.col(start)) & (t < F.col(stop)))
    return df.select(key, F.explode(points).alias("time"), F.col(state))


def intervals_of_states(df: DataFrame, *, key: str, time: str, state: str) -> DataFrame:
    """``(key, start, stop, state)`` from states at times: runs of equal states, each up to the next run; the last run has a null stop."""
    firsts = without_repeats(df, key=key, time=time, state=state)
    w = _history(key, time, [state])
    return firsts.select(key, F.col(time).alias("start"), F.lead(time).over(w).alias("stop"), state)


def check_histories(df: DataFrame, *, key: str, start: str, stop: str, status: str, state: str | None = None, gap: float = 1e-10) -> DataFrame:
    """df with ``flag``: invalid (stop <= start or null), overlap, jump (a gap and another state), gap, teleport (another state without a gap) or ok.

    Rows of a key are compared with the row before in the order of (stop, start, status, state).  ``state`` is the state
    at the start of a row; ``status`` the state it ends in (0: none).
    """
    w = Window.partitionBy(key).orderBy(stop, start, status, *([state] if state else []))
    end = F.lag(stop).over(w)
    bad = F.col(start).isNull() | F.col(stop).isNull() | (F.col(stop) <= F.col(start))
    moved = F.lit(False)
    if state:
        came = F.when(F.lag(status).over(w) != 0, F.lag(status).over(w)).otherwise(F.lag(state).over(w))
        moved = ~F.col(state).eqNullSafe(came)
    apart, overlap = F.col(start) > end + gap, F.col(start) < end - gap
    flag = F.when(bad, "invalid").when(end.isNull(), "ok").when(overlap, "overlap").when(apart & moved, "jump").when(apart, "gap").when(moved, "teleport").otherwise("ok")
    return df.withColumn("flag", flag)


def transitions(df: DataFrame, *, status: str, state: str) -> DataFrame:
    """``(from, to, n)``: how often rows that start in a state end in another (status 0: censored, not counted)."""
    return df.where(F.col(status) != 0).groupBy(F.col(state).alias("from"), F.col(status).alias("to")).agg(F.count("*").alias("n"))


def never_at_risk(df: DataFrame, *, time: str, status: str, entry: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """df with ``idle``: whether no event of the group falls into the row's (entry, time]."""
    events = df.where((F.col(status) != 0) & F.col(time).isNotNull()).select(*keys, F.col(time).cast("double").alias("_e")).withColumn("_last", F.col("_e"))
    found = as_of(df, events, at=time, step="_e", values=["_last"], keys=keys)
    idle = F.col("_last").isNull() if entry is None else F.col("_last").isNull() | F.coalesce(F.col("_last") <= F.col(entry), F.lit(False))
    return found.withColumn("idle", idle).drop("_last")


def person_time_cells(df: DataFrame, *, start: str, stop: str, event: str, value: str, breaks: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Person-time by cells of a value that grows with time (age, calendar time): ``(keys, cut, n, events, person_time, rate)``."""
    parts = time_cut_expand(df.where(F.col(start).isNotNull() & F.col(stop).isNotNull() & F.col(event).isNotNull()), start=start, stop=stop, event=event, value=value, breaks=breaks)
    out = parts.groupBy(*keys, "cut").agg(F.count("*").alias("n"), F.sum((F.col(event) != 0).cast("double")).alias("events"), F.sum(F.col(stop) - F.col(start)).alias("person_time"))
    return out.withColumn("rate", F.try_divide("events", "person_time"))

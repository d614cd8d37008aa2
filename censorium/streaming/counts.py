"""Curves over a stream: state is one row per group and distinct time, not the subjects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from censorium.functions.prefix import running


def streaming_cells(stream: DataFrame, *, time: str, status: str, keys: Sequence[str] = ()) -> DataFrame:
    """Running ``(keys, time, n_event, n_censor)`` of a stream (complete or update mode)."""
    d = (F.col(status) != 0).cast("double")
    return stream.where(F.col(time).isNotNull() & F.col(status).isNotNull()).groupBy(*keys, F.col(time).cast("double").alias("time")).agg(F.sum(d).alias("n_event"), F.sum(1 - d).alias("n_censor"))


def curve_of_cells(at: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Kaplan–Meier surv from cells."""
    risk = running(at, order="time", keys=keys, sums={"n_risk": F.col("n_event") + F.col("n_censor")}, reverse=True, keep_bin=True)
    return running(risk, order="time", keys=keys, products={"surv": 1 - F.col("n_event") / F.col("n_risk")})


def write_curve(stream: DataFrame, *, time: str, status: str, table: str, checkpoint: str, keys: Sequence[str] = ()) -> StreamingQuery:
    """Keeps the table at the curve of all rows so far; started with what is there, then stopped by the caller."""

    def refresh(batch: DataFrame, _: int) -> None:
        curve_of_cells(batch, keys=keys).write.mode("overwrite").saveAsTable(table)

    return streaming_cells(stream, time=time, status=status, keys=keys).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(refresh).start()


def event_rates(stream: DataFrame, *, ts: str, kind: str, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by kind in tumbling windows; rows later than the watermark no longer count."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n"))

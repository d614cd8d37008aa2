"""Study designs and counts: sample size, power, expected events, Poisson limits.  Each takes a table of settings and adds columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from censorium.functions.special import STANDARD, gamma_quantile_of, norm_cdf, z_of


def _z(p: float) -> float:
    return STANDARD.inv_cdf(p)


def _alpha(alpha: float, sided: int) -> float:
    if sided not in (1, 2):
        raise ValueError("sided is 1 or 2")
    return _z(1 - alpha / sided)


def sample_size(df: DataFrame, *, hazard_ratio: str, power: float = 0.8, alpha: float = 0.05, ratio: float = 1.0, sided: int = 2) -> DataFrame:
    """Schoenfeld: ``n_events``, ``n_control`` and ``n_treated`` (each rounded up) for a hazard ratio; ``ratio`` treated per control."""
    z2, log = (_alpha(alpha, sided) + _z(power)) ** 2, F.log(F.col(hazard_ratio))
    out = df.withColumn("n_events", F.ceil(z2 * (1 + ratio) ** 2 / (ratio * log * log)))
    return out.withColumns({"n_control": F.ceil(F.col("n_events") / (1 + ratio)), "n_treated": F.ceil(F.col("n_events") * ratio / (1 + ratio))})


def sample_size_freedman(df: DataFrame, *, hazard_ratio: str, event_share: str, power: float = 0.8, alpha: float = 0.05, ratio: float = 1.0, sided: int = 2) -> DataFrame:
    """Freedman: ``n_events`` and ``n_total`` from the share of controls with an event."""
    z2, hr, p1 = (_alpha(alpha, sided) + _z(power)) ** 2, F.col(hazard_ratio), F.col(event_share)
    share = (p1 + ratio * (1 - F.pow(1 - p1, hr))) / (1 + ratio)
    out = df.withColumn("_share", share).withColumn("n_events", F.ceil(z2 * (hr + 1) * (hr + 1) / (F.col("_share") * (hr - 1) * (hr - 1))))
    out = out.withColumn("n_total", F.ceil(F.col("n_events") / F.col("_share"))).drop("_share")
    return out.withColumn("n_control", F.ceil(F.col("n_total") / (1 + ratio))).withColumn("n_treated", F.col("n_total") - F.col("n_control"))


def power(df: DataFrame, *, events: str, hazard_ratio: str, alpha: float = 0.05, ratio: float = 1.0, sided: int = 2) -> DataFrame:
    """Power of the log-rank test with this many events."""
    z = F.abs(F.log(F.col(hazard_ratio))) * F.sqrt(F.lit(float(ratio)) * F.col(events)) / (1 + ratio)
    return df.withColumn("power", norm_cdf(z - _alpha(alpha, sided)))


def _event_share(hazard: Column, accrual: Column, follow_up: Column, dropout: float) -> Column:
    both = hazard + dropout
    late = (1 - F.exp(-both * (accrual + follow_up))) / (both * accrual)
    return F.when(accrual <= 0, 1 - F.exp(-hazard * follow_up)).otherwise(F.least(1 - F.exp(-both * follow_up), late) * hazard / both)


def expected_events(df: DataFrame, *, total: str, hazard: str, hazard_ratio: str, accrual: str, follow_up: str, ratio: float = 1.0, dropout: float = 0.0) -> DataFrame:
    """Events by the end of a study with uniform accrual and exponential times; ``hazard`` is that of the controls."""
    n, h, a, f = F.col(total), F.col(hazard).cast("double"), F.col(accrual).cast("double"), F.col(follow_up).cast("double")
    events = n / (1 + ratio) * _event_share(h, a, f, dropout) + n * ratio / (1 + ratio) * _event_share(h * F.col(hazard_ratio), a, f, dropout)
    return df.withColumns({"expected_events": events, "duration": a + f})


def poisson_limits(df: DataFrame, *, count: str, time: str | None = None, level: float = 0.95, method: str = "exact") -> DataFrame:
    """``lower`` and ``upper`` limits of a Poisson rate: ``exact`` (gamma quantiles) or ``anscombe``."""
    k, t = F.col(count).cast("double"), F.col(time).cast("double") if time else F.lit(1.0)
    half = (1 - level) / 2
    if method == "exact":
        low, high = F.when(k > 0, gamma_quantile_of(F.lit(half), k)).otherwise(F.lit(0.0)), gamma_quantile_of(F.lit(1 - half), k + 1)
    elif method == "anscombe":
        z = z_of(level)
        low, high = F.pow(F.sqrt(F.greatest(F.lit(0.0), k - 0.125)) - z / 2, 2), F.pow(F.sqrt(k + 0.875) + z / 2, 2)
        low = F.when(k > 0, low).otherwise(F.lit(0.0))
    else:
        raise ValueError("method is exact or anscombe")
    return df.withColumns({"lower": low / t, "upper": high / t})


def ratio_limits(df: DataFrame, *, observed: str, expected: str, level: float = 0.95) -> DataFrame:
    """Standardised ratio observed / expected with exact limits."""
    o, e, half = F.col(observed).cast("double"), F.col(expected).cast("double"), (1 - level) / 2
    return df.withColumns({"ratio": F.try_divide(o, e), "lower": F.when(o > 0, F.try_divide(gamma_quantile_of(F.lit(half), o), e)).otherwise(F.lit(0.0)), "upper": F.try_divide(gamma_quantile_of(F.lit(1 - half), o + 1), e)})

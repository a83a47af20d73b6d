"""Column arithmetic shared by probes, scoring and scorecards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z_95 = 1.959963984540054  # two-sided 95 % normal quantile


def rate(matches: Column, total: Column) -> Column:
    """matches / total as double; 0.0 for an empty table."""
    return F.coalesce(F.try_divide(matches.cast("double"), total.cast("double")), F.lit(0.0))


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator as double; NULL when the denominator is 0."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def pct(part: Column, whole: Column, digits: int = 1) -> Column:
    """Percentage rounded to ``digits``; NULL when there is no whole."""
    return F.round(ratio(part, whole) * 100.0, digits)


def share_of(flag: Column) -> Column:
    """Aggregate: share of all rows of the group on which ``flag`` is true."""
    return F.avg(F.when(flag, F.lit(1.0)).otherwise(F.lit(0.0)))


def wilson_interval(successes: Column, trials: Column, z: float = Z_95) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval of a proportion, NULL without trials."""
    n = trials.cast("double")
    p = ratio(successes, trials)
    scale = 1.0 + F.try_divide(F.lit(z * z), n)
    centre = p + F.try_divide(F.lit(z * z), 2.0 * n)
    spread = z * F.sqrt(F.try_divide(p * (1.0 - p), n) + F.try_divide(F.lit(z * z), 4.0 * n * n))
    return (centre - spread) / scale, (centre + spread) / scale

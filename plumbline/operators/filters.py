"""Predicates over rows, as columns; used as filters and inside conditional counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def satisfying(df: DataFrame, predicate: str) -> DataFrame:
    """Rows on which the predicate is true."""
    return df.where(F.expr(predicate))


def breaking(df: DataFrame, predicate: str) -> DataFrame:
    """Rows on which the predicate is false; rows where it is NULL are no breach."""
    return df.where(F.expr(f"NOT ({predicate})"))


def any_null(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


def null_cells(columns: Sequence[str]) -> Column:
    """Number of NULL cells of the row among ``columns``."""
    return reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in columns])


def out_of_range(column: str, low=None, high=None, inclusive: bool = True) -> Column:
    """True outside the bounds; NULL values are never outside."""
    value = F.col(column)
    breaches = []
    if low is not None:
        breaches.append(value < low if inclusive else value <= low)
    if high is not None:
        breaches.append(value > high if inclusive else value >= high)
    if not breaches:
        return F.lit(False)
    return F.coalesce(reduce(lambda a, b: a | b, breaches), F.lit(False))


def not_accepted(column: str, values: Sequence, quote: bool = True) -> Column:
    """True for non-NULL values outside the list.

    ``quote=False`` takes the entries as SQL expressions instead of literals.
    """
    accepted = [F.lit(v) if quote else F.expr(str(v)) for v in values]
    if not accepted:
        return F.col(column).isNotNull()
    return F.col(column).isNotNull() & ~F.coalesce(F.col(column).isin(*accepted), F.lit(False))


def conditional(condition: str, value: str, otherwise: float | None = None) -> Column:
    """``CASE WHEN condition THEN value [ELSE otherwise]``."""
    case = F.when(F.expr(condition), F.expr(value))
    return case if otherwise is None else case.otherwise(F.lit(otherwise))

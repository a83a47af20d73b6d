"""Declarative metric: source, filters, grain and measures.

A spec is plain driver-side data.  ``run`` turns it into one filter plus one
hash aggregate, so parquet pushdown and map-side combine come from Catalyst.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AGGREGATES = {
    "sum": F.sum,
    "avg": F.avg,
    "count": F.count,
    "min": F.min,
    "max": F.max,
}


@dataclass(frozen=True)
class Predicate:
    """One conjunct of the population filter: ``left op right`` or a free expression."""

    left: str
    op: str | None = None
    right: str | None = None

    @property
    def sql(self) -> str:
        return self.left if self.op is None else f"{self.left} {self.op} {self.right}"

    @property
    def column(self) -> Column:
        return F.expr(self.sql)

    def with_op(self, op: str) -> Predicate:
        return replace(self, op=op)


@dataclass(frozen=True)
class Term:
    """A signed aggregate of one expression.

    ``when`` restricts the rows that contribute (others contribute 0), ``default``
    replaces NULL values of the expression before they are aggregated.
    """

    expr: str
    agg: str = "sum"
    sign: int = 1
    when: str | None = None
    distinct: bool = False
    default: float | None = None

    def value(self) -> Column:
        value = F.expr(self.expr)
        if self.default is not None:
            value = F.coalesce(value, F.lit(self.default))
        if self.when is not None:
            value = F.when(F.expr(self.when), value)
            if self.agg in ("sum", "avg"):
                value = value.otherwise(F.lit(0.0))
        return value

    def aggregate(self, keep: Column | None = None) -> Column:
        """The aggregate over all rows, or over rows on which ``keep`` is true."""
        value = self.value() if keep is None else F.when(keep, self.value())
        if self.distinct:
            return F.count_distinct(value)
        return AGGREGATES[self.agg](value)


@dataclass(frozen=True)
class Measure:
    """Sum of signed terms."""

    alias: str
    terms: tuple[Term, ...]

    def aggregate(self, keep: Column | None = None) -> Column:
        return self.combine(lambda term: term.aggregate(keep))

    def combine(self, part_of: Callable[[Term], Column]) -> Column:
        """The measure from the value of each of its terms."""
        total = None
        for term in self.terms:
            part = part_of(term)
            if total is None:
                total = part if term.sign > 0 else -part
            else:
                total = total + part if term.sign > 0 else total - part
        return total

    def all_terms(self) -> tuple[Term, ...]:
        return self.terms

    def with_terms(self, terms: Sequence[Term]) -> Measure:
        return replace(self, terms=tuple(terms))


@dataclass(frozen=True)
class Ratio:
    """Quotient of two aggregates; NULL where the denominator is 0."""

    alias: str
    numerator: Term
    denominator: Term

    def aggregate(self, keep: Column | None = None) -> Column:
        return self.combine(lambda term: term.aggregate(keep))

    def combine(self, part_of: Callable[[Term], Column]) -> Column:
        return F.try_divide(part_of(self.numerator).cast("double"), part_of(self.denominator).cast("double"))

    def all_terms(self) -> tuple[Term, ...]:
        return (self.numerator, self.denominator)

    def with_terms(self, terms: Sequence[Term]) -> Ratio:
        return replace(self, numerator=terms[0], denominator=terms[1])


@dataclass(frozen=True)
class MetricSpec:
    """Filter, group, measure."""

    name: str
    dims: tuple[tuple[str, str], ...]
    measures: tuple[Measure | Ratio, ...]
    filters: tuple[Predicate, ...] = ()

    @property
    def dim_names(self) -> list[str]:
        return [alias for alias, _ in self.dims]

    @property
    def measure_names(self) -> list[str]:
        return [m.alias for m in self.measures]

    def dim_columns(self) -> list[Column]:
        return [F.expr(expr).alias(alias) for alias, expr in self.dims]

    def population(self) -> Column | None:
        if not self.filters:
            return None
        return reduce(lambda a, b: a & b, [p.column for p in self.filters])

    def run(self, df: DataFrame) -> DataFrame:
        population = self.population()
        rows = df if population is None else df.where(population)
        aggregates = [m.aggregate().alias(m.alias) for m in self.measures]
        return rows.groupBy(*self.dim_columns()).agg(*aggregates)

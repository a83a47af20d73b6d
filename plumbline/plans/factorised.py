"""A metric whose join condition is lost, without pairing the rows of its two sides.

Each row of one side then meets each row of the other.  The aggregate over these pairs
factorises: a group of the result is a group of either side, its pairs are the
product of their row counts, and a sum over pairs is a product of sums.  So each side
is filtered and aggregated by its own keys, and only these groups, which the result
has one row for each pair of anyway, meet.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.plans.spec import MetricSpec, Term
from plumbline.plans.variants import BASE

#: Parts that the groups of one side are dealt over where the two sides' groups meet.
PARTS = 32

_QUOTED, _WORD = re.compile(r"'(?:[^']|'')*'"), re.compile(r"[A-Za-z_]\w*")


@dataclass(frozen=True)
class _Side:
    name: str
    df: DataFrame

    @property
    def columns(self) -> set[str]:
        return {c.lower() for c in self.df.columns}


def _side_of(sides: tuple[_Side, _Side], *exprs: str | None) -> _Side:
    """The side that has all columns the expressions name; constants go to the first."""
    text = _QUOTED.sub(" ", " ".join(e for e in exprs if e is not None)).lower()
    named = set(_WORD.findall(text)) & (sides[0].columns | sides[1].columns)
    for side in sides:
        if named <= side.columns:
            return side
    raise ValueError(f"neither side holds all of {sorted(named)}; a product of both needs its factors named in products")


def _exact(total: Column, df: DataFrame, value: Column) -> Column:
    """The sum of ``value`` as it may be multiplied without overflow: of whole numbers as a decimal, of others as a double."""
    kind = df.select(value.alias("v")).dtypes[0][1]
    return total.cast("decimal(38,0)" if kind in ("tinyint", "smallint", "int", "bigint") else "double")


class _Parts:
    """Aggregates that either side has to compute, each once."""

    def __init__(self, sides: tuple[_Side, _Side]):
        self.sides = sides
        self.slots: dict[str, dict[str, str]] = {s.name: {} for s in sides}
        self.columns: dict[str, list[Column]] = {s.name: [] for s in sides}

    def want(self, side: _Side, label: str, column: Column) -> Column:
        own = self.slots[side.name]
        if label not in own:
            own[label] = f"__{side.name}{len(own)}"
            self.columns[side.name].append(column.alias(own[label]))
        return F.col(own[label])

    def rows(self, side: _Side) -> Column:
        return self.want(side, "rows", F.count(F.lit(1)))

    def other(self, side: _Side) -> _Side:
        return self.sides[1] if side is self.sides[0] else self.sides[0]


def _one_sided(parts: _Parts, side: _Side, term: Term) -> Column:
    """A term over one side's columns: sums and counts grow with the other side's rows, the rest stays."""
    own, others = parts.want(side, f"{term!r}", term.aggregate()), parts.rows(parts.other(side))
    if term.distinct:
        return F.when(others > 0, own).otherwise(0)
    if term.agg == "count":
        return own.cast("decimal(38,0)") * others
    if term.agg == "sum":
        own = _exact(own, side.df, term.value()) * others
    return F.when(others > 0, own)


def _product(parts: _Parts, term: Term, factors: tuple[str, str]) -> Column:
    """A term over a product of both sides' columns."""
    if term.agg not in ("sum", "avg", "count") or term.distinct or term.default is not None or (term.when is not None and term.agg != "sum"):
        raise ValueError(f"{term}: products are summed, averaged or counted, a condition only summed")
    guard = _side_of(parts.sides, term.when) if term.when is not None else None
    sums, counts, zeros = [], [], F.lit(False)
    for side, factor in zip(parts.sides, factors, strict=True):
        value = F.expr(factor)
        if side is guard:
            met = F.coalesce(F.expr(term.when), F.lit(False))
            zeros = (parts.want(side, f"zeros {term!r}", F.count_if(~met)) > 0) & (parts.rows(parts.other(side)) > 0)
            value = F.when(met, value)
        sums.append(_exact(parts.want(side, f"sum {term!r}", F.sum(value)), side.df, F.expr(factor)))
        counts.append(parts.want(side, f"count {term!r}", F.count(value)))
    whole = sums[0] * sums[1]
    pairs = counts[0].cast("decimal(38,0)") * counts[1]
    if term.agg == "count":
        return pairs
    if term.agg == "avg":
        return F.try_divide(whole.cast("double"), pairs.cast("double"))
    # pairs that miss the condition count as 0, so the sum is only NULL where no pair has a value
    return F.coalesce(whole, F.when(zeros, F.lit(0)))


def lost_join(spec: MetricSpec, left: DataFrame, right: DataFrame, products: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    """The metric over all pairs of rows: grain keys and measures as doubles.

    Each dimension, filter and term is computed from the side that has its columns (from
    ``left`` if both have); a conjunct over both sides raises a ValueError.  ``products``
    names the factors (of ``left``, of ``right``) of a term's expression that multiplies both.
    """
    sides = (_Side("l", left), _Side("r", right))
    parts = _Parts(sides)
    kept = {s.name: s.df for s in sides}
    for predicate in spec.filters:
        side = _side_of(sides, predicate.sql)
        kept[side.name] = kept[side.name].where(predicate.column)
    keys: dict[str, list[Column]] = {s.name: [] for s in sides}
    for alias, expr in spec.dims:
        keys[_side_of(sides, expr).name].append(F.expr(expr).alias(alias))

    def part_of(term: Term) -> Column:
        if products and term.expr in products:
            return _product(parts, term, products[term.expr])
        return _one_sided(parts, _side_of(sides, term.expr, term.when), term)

    measures = [m.combine(part_of).cast("double").alias(m.alias) for m in spec.measures]
    for side in sides:
        parts.rows(side)
    groups = {s.name: kept[s.name].groupBy(*keys[s.name]).agg(*parts.columns[s.name]) for s in sides}
    if keys["l"] and keys["r"]:
        # groups of one side are dealt over parts, those of the other are in each: every pair meets once
        own = F.pmod(F.xxhash64(*[alias for alias, e in spec.dims if _side_of(sides, e).name == "l"]), F.lit(PARTS)).cast("int")
        dealt = groups["l"].withColumn("__part", own)
        met = dealt.join(groups["r"].withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), "__part")
    else:
        many, one = ("l", "r") if keys["l"] else ("r", "l")
        names = list(parts.slots[one].values())
        single = groups[one].select(F.struct(*names).alias("p")).scalar()
        met = groups[many].select("*", *[single.getField(c).alias(c) for c in names])
    if spec.dims:
        met = met.where((parts.rows(sides[0]) > 0) & (parts.rows(sides[1]) > 0))
    return met.select(*spec.dim_names, *measures)


def with_lost_join(spec: MetricSpec, left: DataFrame, right: DataFrame, on: list[str], products: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    """Base, joined on ``on``, and the variant that lost the condition, long: grain keys, ``variant``, measures."""
    base = spec.run(left.join(right, on))
    base = base.select(*spec.dim_names, F.lit(BASE).alias("variant"), *[F.col(m).cast("double").alias(m) for m in spec.measure_names])
    lost = lost_join(spec, left, right, products)
    return base.unionByName(lost.withColumn("variant", F.lit("JOIN_PREDICATE_DROP")))


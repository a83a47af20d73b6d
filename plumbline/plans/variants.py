"""Controlled perturbations of a metric: which mistakes would change its value?

Eight faults are derived from a :class:`MetricSpec`.  All variants that keep the
grain are computed together with the base in one scan and one aggregate, each
measure guarded by its variant's own predicate.  A group belongs to a variant
only if at least one row satisfies that predicate, so wider filters add groups
and narrower ones lose them exactly as separate runs would.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.plans.spec import Measure, MetricSpec, Predicate, Ratio, Term
from plumbline.session import stored

BASE = "BASE"

# Fault names, in the order in which they are generated.
FAULTS = (
    "FILTER_DROP",
    "BOUNDARY_SHIFT",
    "AGGREGATION_SWAP",
    "DISTINCT_DROP",
    "JOIN_PREDICATE_DROP",
    "GRAIN_DROP",
    "COALESCE_BYPASS",
    "MATH_OPERATOR_INVERT",
)

BOUNDARY_SHIFTS = ((">", ">="), ("<", "<="), ("=", "!="))
AGGREGATE_SWAPS = (("sum", "avg"), ("avg", "sum"), ("count", "sum"))


@dataclass(frozen=True)
class Variant:
    """A perturbed spec; ``fanout`` asks for the closed form of a lost join condition."""

    fault: str
    spec: MetricSpec
    fanout: bool = False
    error: str | None = None


def _all_terms(spec: MetricSpec) -> list[Term]:
    return [term for measure in spec.measures for term in measure.all_terms()]


def _edit_terms(spec: MetricSpec, matches: Callable[[Term], bool], edit: Callable[[Term], Term], first: bool) -> MetricSpec | None:
    """The spec with matching terms edited (only the first one if asked)."""
    edited, done = [], False
    for measure in spec.measures:
        terms = []
        for term in measure.all_terms():
            if matches(term) and not (first and done):
                term, done = edit(term), True
            terms.append(term)
        edited.append(measure.with_terms(terms))
    return replace(spec, measures=tuple(edited)) if done else None


def filter_drop(spec: MetricSpec) -> MetricSpec | None:
    """Lose the last conjunct, or the whole filter if there is only one."""
    return replace(spec, filters=spec.filters[:-1]) if spec.filters else None


def boundary_shift(spec: MetricSpec) -> MetricSpec | None:
    """Open or flip the first ``>`` comparison, else the first ``<``, else the first ``=``."""
    for op, shifted in BOUNDARY_SHIFTS:
        for i, predicate in enumerate(spec.filters):
            if predicate.op == op:
                moved = spec.filters[:i] + (predicate.with_op(shifted),) + spec.filters[i + 1 :]
                return replace(spec, filters=moved)
    return None


def aggregation_swap(spec: MetricSpec) -> MetricSpec | None:
    """Swap the first SUM for AVG, else AVG for SUM, else COUNT for SUM."""
    for agg, swapped in AGGREGATE_SWAPS:
        edited = _edit_terms(
            spec,
            lambda t, agg=agg: t.agg == agg,
            lambda t, swapped=swapped: replace(t, agg=swapped, distinct=False),
            first=True,
        )
        if edited is not None:
            return edited
    return None


def distinct_drop(spec: MetricSpec) -> MetricSpec | None:
    return _edit_terms(spec, lambda t: t.distinct, lambda t: replace(t, distinct=False), first=True)


def grain_drop(spec: MetricSpec) -> MetricSpec | None:
    """Lose the last grouping key from grain and output."""
    return replace(spec, dims=spec.dims[:-1]) if spec.dims else None


def coalesce_bypass(spec: MetricSpec) -> MetricSpec | None:
    """Keep the first argument of a COALESCE and lose the default."""
    return _edit_terms(
        spec, lambda t: t.default is not None, lambda t: replace(t, default=None), first=True
    )


def math_invert(spec: MetricSpec) -> MetricSpec | None:
    """Turn the first subtraction into an addition, else the first addition into a subtraction."""
    for sign in (-1, 1):
        for i, measure in enumerate(spec.measures):
            if isinstance(measure, Ratio):
                continue
            for j, term in enumerate(measure.terms):
                if j > 0 and term.sign == sign:
                    terms = list(measure.terms)
                    terms[j] = replace(term, sign=-sign)
                    measures = list(spec.measures)
                    measures[i] = measure.with_terms(terms)
                    return replace(spec, measures=tuple(measures))
    return None


def _summable(spec: MetricSpec, df: DataFrame) -> bool:
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
    values = df.select(*[t.value().alias(f"v{i}") for i, t in enumerate(_all_terms(spec)) if t.agg == "sum"])
    return all(kind in numeric or kind.startswith("decimal") for _, kind in values.dtypes)


MAKERS = {
    "FILTER_DROP": filter_drop,
    "BOUNDARY_SHIFT": boundary_shift,
    "AGGREGATION_SWAP": aggregation_swap,
    "DISTINCT_DROP": distinct_drop,
    "GRAIN_DROP": grain_drop,
    "COALESCE_BYPASS": coalesce_bypass,
    "MATH_OPERATOR_INVERT": math_invert,
}


def edits(spec: MetricSpec) -> dict[str, MetricSpec]:
    """The edited spec of every fault that applies to the clauses of ``spec``, in the fixed order."""
    found = {fault: MAKERS[fault](spec) for fault in FAULTS if fault in MAKERS}
    return {fault: edited for fault, edited in found.items() if edited is not None}


def derive(spec: MetricSpec, df: DataFrame, with_fanout: bool = False) -> list[Variant]:
    """All faults that apply to ``spec``, in the fixed order.

    A fault that Spark could not run (a SUM over text) is kept with ``error`` set.
    """
    edited, variants = edits(spec), []
    for fault in FAULTS:
        if fault == "JOIN_PREDICATE_DROP" and with_fanout:
            variants.append(Variant(fault, spec, fanout=True))
        elif fault in edited:
            error = None if _summable(edited[fault], df) else "aggregate does not accept the column type"
            variants.append(Variant(fault, edited[fault], error=error))
    return variants


def _keep(spec: MetricSpec) -> Column:
    population = spec.population()
    return F.coalesce(population, F.lit(False)) if population is not None else F.lit(True)


def _fused(
    df: DataFrame, spec: MetricSpec, named: list[tuple[str, MetricSpec]], store: bool = False, coarse: bool = False
) -> DataFrame:
    """One scan, one aggregate for every spec in ``named``; long output.

    With ``store`` the wide result, one row per group, is written to the shared
    folder.  ``coarse`` then adds the variant without the last key, rolled up
    from the stored terms of the base instead of a second scan.
    """
    if all(s.filters for _, s in named):
        # rows no variant wants never reach the shuffle, and what all variants share reaches the scan
        df = df.where(reduce(lambda a, b: a | b, [s.population() for _, s in named]))
    # variants that share the population and a measure share the aggregate as well
    columns, slots, rows = [], {}, []

    def slot(column: Column, key: str) -> str:
        if key not in slots:
            slots[key] = f"__a{len(slots)}"
            columns.append(column.alias(slots[key]))
        return slots[key]

    for label, s in named:
        keep = _keep(s)
        population = " AND ".join(p.sql for p in s.filters)
        hits = slot(F.count_if(keep), f"hits|{population}")
        values = [slot(m.aggregate(keep), f"{m.all_terms()}|{type(m)}|{population}") for m in s.measures]
        rows.append(
            F.struct(
                F.lit(label).alias("variant"),
                F.col(hits).alias("__hits"),
                *[F.col(v).cast("double").alias(a) for v, a in zip(values, s.measure_names, strict=True)],
            )
        )
    partials = {}
    if coarse:
        keep = _keep(spec)
        for term in _all_terms(spec):
            kinds = ("sum", "count") if term.agg == "avg" else (term.agg,)
            partials[term] = [slot(replace(term, agg=k).aggregate(keep), f"part|{k}|{term}") for k in kinds]
    wide = df.groupBy(*spec.dim_columns()).agg(*columns)
    if store:
        wide = stored(wide, f"variants-{spec.name}")
    long = wide.select(*spec.dim_names, F.inline(F.array(*rows)))
    if spec.dims:
        long = long.where(F.col("__hits") > 0)
    long = long.drop("__hits")
    if coarse:
        hits = slots["hits|" + " AND ".join(p.sql for p in spec.filters)]
        rolled = _rolled_up(wide.where(F.col(hits) > 0), spec, partials)
        long = long.unionByName(_without_last_key(rolled, spec, dict(wide.dtypes)[spec.dim_names[-1]]))
    return long


def _rolled_up(groups: DataFrame, spec: MetricSpec, partials: dict[Term, list[str]]) -> DataFrame:
    """The metric without its last key, from the terms of the finer groups."""
    def part_of(term: Term) -> Column:
        columns = [F.col(c) for c in partials[term]]
        if term.agg == "avg":
            return F.try_divide(F.sum(columns[0]).cast("double"), F.sum(columns[1]).cast("double"))
        if term.agg == "count":
            return F.coalesce(F.sum(columns[0]), F.lit(0))
        return {"sum": F.sum, "min": F.min, "max": F.max}[term.agg](columns[0])

    measures = [m.combine(part_of).alias(m.alias) for m in spec.measures]
    return groups.groupBy(*spec.dim_names[:-1]).agg(*measures)


def _without_last_key(rows: DataFrame, spec: MetricSpec, kind: str) -> DataFrame:
    """Rows of the coarser grain in the layout of the finer one; the lost key is NULL."""
    return rows.select(
        *spec.dim_names[:-1],
        F.lit(None).cast(kind).alias(spec.dim_names[-1]),
        F.lit("GRAIN_DROP").alias("variant"),
        *[F.col(a).cast("double").alias(a) for a in spec.measure_names],
    )


def _coarser(df: DataFrame, spec: MetricSpec, dropped: MetricSpec) -> DataFrame:
    """The metric at the grain that lost its last key, from a scan of its own."""
    kind = dict(df.select(*spec.dim_columns()).dtypes)[spec.dim_names[-1]]
    return _without_last_key(dropped.run(df), spec, kind)


def scale_fanout(base: DataFrame, spec: MetricSpec, other_side: DataFrame) -> DataFrame:
    """Closed form of a lost join condition: each base row meets every row of the other side.

    SUM and COUNT grow by the row count of the other side; AVG, MIN, MAX, COUNT
    DISTINCT and ratios of equally grown aggregates stay.  Holds when grain and
    measures come from one side, which the caller vouches for by passing the other.
    """
    factor = other_side.agg(F.count(F.lit(1)).alias("n")).scalar().cast("double")
    columns = []
    for measure in spec.measures:
        kinds = {_grows(term) for term in measure.all_terms()}
        if isinstance(measure, Measure):
            if len(kinds) > 1:
                raise ValueError(f"{measure.alias}: terms grow differently, give them separate measures")
            grow = factor if kinds == {True} else F.lit(1.0)
        else:
            top, bottom = _grows(measure.numerator), _grows(measure.denominator)
            grow = F.lit(1.0) if top == bottom else (factor if top else 1.0 / factor)
        columns.append((F.col(measure.alias) * grow).alias(measure.alias))
    # an empty other side leaves no joined row at all
    return base.where(factor > 0).select(*spec.dim_names, *columns)


def _grows(term: Term) -> bool:
    return term.agg in ("sum", "count") and not term.distinct


def run_variants(
    spec: MetricSpec, df: DataFrame, other_side: DataFrame | None = None, store: bool = False
) -> DataFrame:
    """Base and every applicable variant, long: grain keys, ``variant``, measures.

    ``df`` is the joined source.  ``other_side`` is the table whose join condition
    may be lost; with it the fan-out variant is added in closed form.  For that
    variant ``df`` must hold one row per row of the side that feeds the metric.
    ``store`` keeps the fused result in the shared folder, so that the coarser
    variant and later readers cost no second scan of the source.
    """
    variants = derive(spec, df, with_fanout=other_side is not None)
    runnable = [v for v in variants if v.error is None]
    same = [(BASE, spec)] + [(v.fault, v.spec) for v in runnable if v.fault != "GRAIN_DROP" and not v.fanout]
    drops_grain = any(v.fault == "GRAIN_DROP" for v in runnable)
    # distinct counts of finer groups do not add up
    rolls_up = store and drops_grain and not any(t.distinct for t in _all_terms(spec))
    result = _fused(df, spec, same, store, rolls_up)
    for variant in runnable:
        if variant.fault == "GRAIN_DROP" and not rolls_up:
            result = result.unionByName(_coarser(df, spec, variant.spec))
        elif variant.fanout:
            base = result.where(F.col("variant") == BASE)
            grown = scale_fanout(base, spec, other_side).withColumn("variant", F.lit("JOIN_PREDICATE_DROP"))
            result = result.unionByName(grown)
    return result


def run_one(spec: MetricSpec, df: DataFrame, fault: str) -> DataFrame:
    """Base and one variant side by side, on the grain of the variant's fault."""
    found = [v for v in derive(spec, df) if v.fault == fault]
    if not found:
        raise ValueError(f"{fault} does not apply to {spec.name}")
    if found[0].error:
        raise ValueError(f"{fault} on {spec.name}: {found[0].error}")
    if fault == "GRAIN_DROP":
        return _fused(df, spec, [(BASE, spec)]).unionByName(_coarser(df, spec, found[0].spec))
    return _fused(df, spec, [(BASE, spec), (fault, found[0].spec)])


__all__ = ["BASE", "FAULTS", "Predicate", "Variant", "derive", "run_one", "run_variants", "scale_fanout"]

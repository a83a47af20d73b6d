"""Declared metrics and their variants as text.

A spec knows its clauses, so they are written out, never parsed: the query a person
would type for it, its conjuncts, grouping expressions and aggregate calls.  The
catalogue is one row per metric and variant, the base among them; it has the columns
a query log has, so compliance rules read it like one.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans.spec import Measure, MetricSpec, Ratio, Term
from plumbline.plans.variants import BASE, derive
from plumbline.session import stored

SCHEMA = (
    "metric string, variant string, sql string, where_conjuncts array<string>, group_by array<string>, agg_calls array<string>, "
    "tables array<string>, description string, error string"
)


def term_text(term: Term) -> str:
    """The aggregate call of one term, without its sign."""
    value = term.expr if term.default is None else f"COALESCE({term.expr}, {term.default})"
    if term.when is not None:
        other = " ELSE 0.0" if term.agg in ("sum", "avg") else ""
        value = f"CASE WHEN {term.when} THEN {value}{other} END"
    if term.distinct:
        return f"COUNT(DISTINCT {value})"
    return f"{term.agg.upper()}({value})"


def measure_text(measure: Measure | Ratio) -> str:
    if isinstance(measure, Ratio):
        return f"CAST({term_text(measure.numerator)} AS DOUBLE) / NULLIF(CAST({term_text(measure.denominator)} AS DOUBLE), 0)"
    first, *others = measure.terms
    text = ("" if first.sign > 0 else "-") + term_text(first)
    return text + "".join(f" {'+' if t.sign > 0 else '-'} {term_text(t)}" for t in others)


def metric_text(spec: MetricSpec, table: str) -> str:
    """The metric as one query over ``table``."""
    columns = [f"{expr} AS {alias}" for alias, expr in spec.dims] + [f"{measure_text(m)} AS {m.alias}" for m in spec.measures]
    where = f" WHERE {' AND '.join(p.sql for p in spec.filters)}" if spec.filters else ""
    grain = f" GROUP BY {', '.join(expr for _, expr in spec.dims)}" if spec.dims else ""
    return f"SELECT {', '.join(columns)} FROM {table}{where}{grain}"


def aggregate_calls(spec: MetricSpec) -> list[str]:
    return [term_text(t) for m in spec.measures for t in m.all_terms()]


def describe(fault: str, base: MetricSpec, spec: MetricSpec) -> str:
    """What the fault changed, in words; the lost clause follows the colon."""
    def lost(old, new):
        return next((a for a, b in zip(old, [*new, None], strict=False) if a != b), "")

    filters = [p.sql for p in base.filters], [p.sql for p in spec.filters]
    calls = aggregate_calls(base), aggregate_calls(spec)
    if fault == "FILTER_DROP":
        return f"Dropped predicate: {lost(*filters)}"
    if fault == "GRAIN_DROP":
        return f"Dropped dimension: {base.dims[-1][1]}"
    if fault == "BOUNDARY_SHIFT":
        return f"Shifted boundary: {lost(*filters)}"
    if fault == "MATH_OPERATOR_INVERT":
        old = [f"{t.sign:+d}{term_text(t)}" for m in base.measures for t in m.all_terms()]
        new = [f"{t.sign:+d}{term_text(t)}" for m in spec.measures for t in m.all_terms()]
        return f"Inverted sign: {lost(old, new)[2:]}"
    return f"Changed aggregate: {lost(*calls)}"


def metric_rows(spec: MetricSpec, df: DataFrame, table: str) -> list[tuple]:
    """Catalogue rows of one metric over ``df``, which a query calls ``table``."""
    def row(variant, own, description, error=None):
        return (
            spec.name, variant, metric_text(own, table), [p.sql for p in own.filters], [expr for _, expr in own.dims],
            aggregate_calls(own), [table], description, error,
        )

    variants = derive(spec, df)
    return [row(BASE, spec, None)] + [row(v.fault, v.spec, describe(v.fault, spec, v.spec), v.error) for v in variants]


def catalogue(spark: SparkSession, cases: Iterable[tuple[MetricSpec, DataFrame, str]]) -> DataFrame:
    """metric, variant, sql, where_conjuncts, group_by, agg_calls, tables, description, error of all (spec, source, table name), stored.

    At most nine rows for each metric; what the faults are is read from the specs and
    the sources' column types, no source row is touched.
    """
    rows = [r for spec, df, table in cases for r in metric_rows(spec, df, table)]
    return stored(spark.createDataFrame(rows, SCHEMA), "catalogue")
